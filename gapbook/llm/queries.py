"""The registered queries of the text operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapbook.llm import (
    collocations,
    exact_dedup,
    fingerprint,
    hmm,
    langid,
    mixing,
    ngram_join,
    pii,
    sentencepiece_codec,
    sharding,
    spelling_variants,
    token_counts,
    url_filter,
)
from gapbook.llm.common import table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), words=3, at_least=90)


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's label is that of the document its path names."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    named = pages.select("page_id", F.expr("try_cast(regexp_extract(url, '/([0-9]+)', 1) as bigint)").alias("doc_id"))
    bad = table(spark, sf_dir, "labels").select("doc_id", F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0).alias("bad"))
    found = url_filter.url_verdicts(pages, named.join(bad, "doc_id").select("page_id", "bad"))
    return found.withColumn("purity", F.round("purity", 9))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).withColumn("mix_rate", F.round("mix_rate", 9))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.learn(docs))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprint.edited_fingerprints(table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.round(c, 9) for c in ("near_edited", "near_next")})


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.round_trip(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.spelling_variants(table(spark, sf_dir, "documents"))


def op13_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.language_model(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_exact_dedup,
        op2_pii,
        op3_sharding,
        op4_token_counts,
        op5_ngram_join,
        op6_url_filters,
        op7_mixing,
        op8_langid,
        op9_fingerprints,
        op10_sentencepiece,
        op11_collocations,
        op12_spelling_variants,
        op13_hmm,
    )
    return {f.__name__: f for f in own}


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP1 = r"""
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents) WINDOW g AS (PARTITION BY t)"""

OP5 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 3 THEN array_to_string(ws, ' ') ELSE ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] END AS g
  FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 2, least(len(ws), 1)))) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 90 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS id, doc_id AS to_id FROM n UNION SELECT r.id, e.y FROM r JOIN e ON r.to_id = e.x)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, coalesce(min(r.to_id), d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN r ON r.id = d.doc_id GROUP BY d.doc_id"""


#: Levels of the path tree that the SQL spells out; the tables' paths are no deeper.
SQL_DEPTH = 5


def _op6() -> str:
    rules = [(v, *r.partition("/")[::2], r) for v, r in url_filter.RULES]
    values = ", ".join(f"('{v}', '{h}', '/{p}', '{r}')" for v, h, p, r in rules)
    down, up, z = "", "", url_filter.REJECT_Z
    for k in range(1, SQL_DEPTH + 1):
        star = f"list_concat(list_append(t.t[1:{k - 1}], '*'), t.t[{k + 1}:])"
        down += f"""
n{k} AS (SELECT host, t[1:{k - 1}] AS above, t[{k}] AS here, count(*) AS n FROM g{k - 1} WHERE t[{k}] IS NOT NULL GROUP BY 1, 2, 3),
w{k} AS (SELECT host, above, here FROM (SELECT *, count(*) OVER s AS siblings, sum(n) OVER s AS pages FROM n{k} WINDOW s AS (PARTITION BY host, above))
  WHERE siblings >= {url_filter.MANY} AND n * siblings <= pages AND n < {url_filter.ENOUGH}),
g{k} AS (SELECT t.* REPLACE (CASE WHEN w.here IS NOT NULL THEN {star} ELSE t.t END AS t) FROM g{k - 1} t LEFT JOIN w{k} w ON w.host = t.host AND w.above = t.t[1:{k - 1}] AND w.here = t.t[{k}]),"""
    for k in range(SQL_DEPTH, 0, -1):
        star = f"list_concat(list_append(t.t[1:{k - 1}], '*'), t.t[{k + 1}:])"
        up += f"""
o{k} AS (SELECT *, sum(n) OVER s AS pn, sum(b) OVER s AS pb FROM (SELECT host, t[1:{k - 1}] AS above, t[{k}] AS here, sum(n) AS n, sum(b) AS b FROM m{k} WHERE t[{k}] IS NOT NULL GROUP BY 1, 2, 3) WINDOW s AS (PARTITION BY host, above)),
e{k} AS (SELECT *, pb / nullif(pn, 0) AS share, sqrt(pb / nullif(pn, 0) * (1 - pb / nullif(pn, 0)) * (1 / nullif(n, 0) + 1 / nullif(pn - n, 0))) AS error FROM o{k}),
a{k} AS (SELECT host, above, here FROM e{k} WHERE n >= {url_filter.LEAST} AND error > 0 AND abs(b / nullif(n, 0) - (pb - b) / nullif(pn - n, 0)) > {url_filter.Z} * error),
m{k - 1} AS (SELECT t.* REPLACE (CASE WHEN t.t[{k}] IS NOT NULL AND a.here IS NULL THEN {star} ELSE t.t END AS t) FROM m{k} t LEFT JOIN a{k} a ON a.host = t.host AND a.above = t.t[1:{k - 1}] AND a.here = t.t[{k}]),"""
    return rf"""
WITH u AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, url, regexp_extract(rest, '^[^/?#]*') AS rawhost, rest FROM u),
p AS (SELECT page_id, url, translate(rawhost, '{_UPPER}', '{_LOWER}') AS host, regexp_extract(substr(rest, length(rawhost) + 1), '^[^?#]*') AS path FROM h),
lab AS (SELECT page_id, max(CASE WHEN l.quality = 0 OR l.toxic = 1 THEN 1 ELSE 0 END) AS bad FROM p JOIN labels l ON l.doc_id = try_cast(regexp_extract(url, '/([0-9]+)', 1) AS BIGINT) GROUP BY 1),
g0 AS (SELECT p.page_id, host, path, bad, list_filter(string_split(path, '/'), lambda s: s <> '') AS t FROM p LEFT JOIN lab ON lab.page_id = p.page_id),{down}
m{SQL_DEPTH} AS (SELECT host, t AS raw, t, count(bad) AS n, coalesce(sum(bad), 0) AS b FROM g{SQL_DEPTH} GROUP BY 1, 2),{up}
base AS (SELECT coalesce(sum(b) / nullif(sum(n), 0), 0) AS share FROM m0),
sums AS (SELECT host, t, sum(n) AS n, sum(b) AS b FROM m0 GROUP BY 1, 2),
pure AS (SELECT host, t, 1 - (b + {url_filter.PRIOR} * share) / (n + {url_filter.PRIOR}) AS purity, CASE WHEN n >= {url_filter.LEAST_LABELS} THEN
  (b / n + {z * z} / (2 * n) - {z} * sqrt(b / n * (1 - b / n) / n + {z * z} / (4 * n * n))) / (1 + {z * z} / n) > share ELSE false END AS rejected FROM sums, base),
fit AS (SELECT r.page_id, arg_max(v.rule, length(v.rule)) AS rule, arg_max(v.verdict, length(v.rule)) AS verdict FROM g0 r JOIN (VALUES {values}) AS v(verdict, rhost, rpath, rule)
  ON (r.host = v.rhost OR ends_with(r.host, '.' || v.rhost)) AND starts_with(r.path, v.rpath) GROUP BY r.page_id)
SELECT r.page_id, r.host, r.path, f.rule, coalesce(f.verdict, CASE WHEN pure.rejected THEN 'block' ELSE 'allow' END) AS verdict, array_to_string(m.t, '/') AS template, round(purity, 9) AS purity
FROM g{SQL_DEPTH} r LEFT JOIN fit f ON f.page_id = r.page_id LEFT JOIN m0 m ON m.host = r.host AND m.raw = r.t LEFT JOIN pure ON pure.host = m.host AND pure.t = m.t"""


def _uniform(text: str) -> str:
    return f"CAST('0x' || substr(md5({text}), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE"


#: For rates up to PART_MEAN, where a count is a single variate.
OP7 = f"""
WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
r AS (SELECT source, n, sum(n) OVER () * pow(n, {mixing.POWER}) / sum(pow(n, {mixing.POWER})) OVER () / n AS rate FROM c),
f AS (SELECT source, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf FROM (SELECT source, rate, unnest(generate_series(0, 80)) AS k FROM r)),
d AS (SELECT *, {_uniform(f"'{mixing.SEED}|' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '|count|1'")} AS u FROM documents),
m AS (SELECT d.* EXCLUDE (u), rate, (SELECT count(*) FROM f WHERE f.source = d.source AND cdf < u) AS copies FROM d JOIN r ON r.source = d.source)
SELECT doc_id, text, lang, source, n_chars, round(rate, 9) AS mix_rate, CAST(copy AS INTEGER) AS mix_copy,
  {_uniform(f"'{mixing.SEED}|' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '|order|' || copy")} AS mix_order
FROM (SELECT *, unnest(generate_series(0, copies - 1)) AS copy FROM m WHERE copies > 0)"""


def _op9() -> str:
    lanes = ", ".join(f"coalesce(sum((bits >> {i}) & 1), 0)" for i in range(fingerprint.LANES))
    wide = ", ".join(f"coalesce(sum(CAST('0x' || substr(sha256(p), {8 * i + 1}, 8) AS BIGINT)), 0) % {fingerprint.WIDE_MOD}" for i in range(fingerprint.WIDE))

    def hexes(name: str) -> str:
        return f"array_to_string(list_transform({name}, lambda x: printf('%X', x)), '.')"

    def shown(v: str) -> str:
        return f"printf('%X', {v}.pieces) || '-' || {hexes(v + '.wide')} || '-' || {hexes(v + '.lanes')}"

    def centred(v: str) -> str:
        return f"list_transform({v}.lanes, lambda x: CAST(2 * x - {v}.pieces AS DOUBLE))"

    def near(x: str, y: str) -> str:
        dot = f"list_dot_product({centred(x)}, {centred(y)})"
        norm = f"sqrt(list_dot_product({centred(x)}, {centred(x)})) * sqrt(list_dot_product({centred(y)}, {centred(y)}))"
        same = f"{x}.pieces = {y}.pieces AND {x}.wide = {y}.wide AND {x}.lanes = {y}.lanes"
        return f"round(CASE WHEN {same} THEN 1.0 WHEN {norm} > 0 THEN greatest(0.0, least({fingerprint.MOST_UNEQUAL}, {dot} / ({norm}))) ELSE 0.0 END, 9)"

    return rf"""
WITH d AS (SELECT doc_id AS id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, coalesce(lead(doc_id) OVER (ORDER BY doc_id), min(doc_id) OVER ()) AS next_id FROM documents),
e AS (SELECT d.*, substr(d.text, 1, d.n - d.n // 4) || substr(x.text, 1, d.n // 4) AS edited FROM d JOIN d x ON x.id = d.next_id),
t AS (SELECT id, 0 AS which, text AS t FROM e UNION ALL SELECT id, 1, edited FROM e),
m AS (SELECT id, which, CAST('0x' || substr(md5(unnest(regexp_extract_all(t, '{fingerprint._PIECE}'))), 1, 15) AS BIGINT) AS bits FROM t),
v AS (SELECT id, which, count(*) AS pieces, CAST([{lanes}] AS BIGINT[]) AS lanes FROM m GROUP BY 1, 2),
w AS (SELECT id, which, CAST([{wide}] AS BIGINT[]) AS wide FROM (SELECT id, which, unnest(regexp_extract_all(t, '{fingerprint._PARAGRAPH}')) AS p FROM t) GROUP BY 1, 2),
f AS (SELECT t.id, t.which, coalesce(v.pieces, 0) AS pieces, coalesce(v.lanes, CAST(list_transform(range({fingerprint.LANES}), lambda x: 0) AS BIGINT[])) AS lanes,
    coalesce(w.wide, CAST(list_transform(range({fingerprint.WIDE}), lambda x: 0) AS BIGINT[])) AS wide FROM t LEFT JOIN v ON v.id = t.id AND v.which = t.which LEFT JOIN w ON w.id = t.id AND w.which = t.which)
SELECT e.id AS doc_id, e.n AS n_chars, sha256(e.edited) AS edited_sha256, {shown("o")} AS fingerprint, {shown("c")} AS edited_fingerprint, {near("o", "c")} AS near_edited, {near("o", "x")} AS near_next
FROM e JOIN f o ON o.id = e.id AND o.which = 0 JOIN f c ON c.id = e.id AND c.which = 1 JOIN f x ON x.id = e.next_id AND x.which = 0"""


OP11 = rf"""
WITH t AS (SELECT coalesce(lang, '{collocations.UNDETERMINED}') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM t),
i AS (SELECT lang, ws, unnest(generate_series(1, len(ws))) AS i FROM w),
g AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase FROM (SELECT *, unnest(generate_series(1, least({collocations.MOST_WORDS}, len(ws) - i + 1))) AS k FROM i)),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= {collocations.LEAST}),
n AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
c AS (SELECT lang, phrase, k, a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
j AS (SELECT *, unnest(generate_series(1, k - 1)) AS j FROM c),
s AS (SELECT j.lang, j.phrase, j.a, l.a AS l, r.a AS r, j, {collocations.SCALE}::HUGEINT * j.a // (l.a + r.a) AS score
  FROM j JOIN f l ON l.lang = j.lang AND l.phrase = array_to_string(j.ws[1:j.j], ' ') JOIN f r ON r.lang = j.lang AND r.phrase = array_to_string(j.ws[j.j + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
m AS (SELECT *, unnest(generate_series(2, k - 1)) AS m FROM c WHERE k > 2),
x AS (SELECT lang, array_to_string(ws[o:o + m - 1], ' ') AS phrase, max(a) AS longer FROM (SELECT *, unnest(generate_series(1, k - m + 1)) AS o FROM m) GROUP BY ALL),
y AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank FROM b LEFT JOIN x ON x.lang = b.lang AND x.phrase = b.phrase
  WHERE NOT coalesce(100 * x.longer >= {collocations.INSIDE} * b.a, false))
SELECT y.lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM y JOIN n ON n.lang = y.lang WHERE rank <= {collocations.TOP}"""


_CRC_TABLE = "list_transform(range(256), lambda c: list_reduce(list_prepend(c, [0, 0, 0, 0, 0, 0, 0, 0]), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END))"

OP12 = rf"""
WITH RECURSIVE crc AS (SELECT {_CRC_TABLE} AS t),
r AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
o AS (SELECT id, run, count(*) AS n, hex(encode(id || ':' || run)) AS x FROM r WHERE length(run) >= {spelling_variants.LEAST_LETTERS} GROUP BY ALL),
h AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS h FROM o, crc),
w AS (SELECT CASE WHEN h % {spelling_variants.TYPO} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, CAST(sum(n) AS BIGINT) AS n FROM h GROUP BY 1),
words AS (SELECT word, n FROM w WHERE length(word) >= {spelling_variants.LEAST_LETTERS} AND n >= {spelling_variants.LEAST_COUNT}),
v AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS v FROM (SELECT word, unnest(generate_series(1, length(word))) AS i FROM words)),
p AS (SELECT a.word, b.word AS other FROM v a JOIN v b ON a.v = b.v AND a.i = b.i AND a.word <> b.word UNION SELECT v.word, b.word FROM v JOIN words b ON b.word = v.v UNION SELECT b.word, v.word FROM v JOIN words b ON b.word = v.v),
q AS (SELECT p.word, p.other, x.n AS m, count(*) OVER (PARTITION BY p.word) AS n_near FROM p JOIN words x ON x.word = p.other QUALIFY row_number() OVER (PARTITION BY p.word ORDER BY x.n DESC, p.other) = 1),
f AS (SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= {spelling_variants.MORE_FREQUENT} * n THEN other END AS form, CASE WHEN m >= {spelling_variants.MORE_FREQUENT} * n THEN m END AS form_n FROM words LEFT JOIN q ON q.word = words.word),
g AS (SELECT word, word AS root FROM f UNION SELECT g.word, f.form FROM g JOIN f ON f.word = g.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, g.root, f.n, f.n_near, f.form_n FROM f JOIN g ON g.word = f.word JOIN f l ON l.word = g.root WHERE l.form IS NULL"""


def oracle_sql() -> dict[str, str]:
    """Without SQL: personal data (offsets of matches), sharding, language models and tokenizers."""
    return {"op1_exact_dedup": OP1, "op5_ngram_join": OP5, "op6_url_filters": _op6(), "op7_mixing": OP7, "op9_fingerprints": _op9(), "op11_collocations": OP11, "op12_spelling_variants": OP12}
