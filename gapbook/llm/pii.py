"""Personal data: base patterns, and bootstrapped contextual extraction on top of them.

Base matches are seed entities, credentials beside the base kinds as well. A seed's context induces
patterns: the words on both sides, the word on one side with the seed's shape, and the shape alone.
Patterns and the instances they meet form a graph that Spark scores in rounds: a pattern's confidence
in a kind is the smoothed share of its instances that are known to be of it, and a pattern of high
confidence and enough support makes its other instances known, which lends them to further patterns,
until a round adds none. What the patterns then mark are identifiers that no base pattern knows, and
those a base pattern lost, as a phone number that runs into a card number. One pass reads the texts;
what follows works on mentions alone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapbook.llm.common import materialise, sliced, text_or_empty

KINDS = ("email", "ip", "card", "phone")
#: A further kind of seeds: values assigned to a name that says secret, and keys with a known prefix.
SECRET = "secret"
ALL_KINDS = (*KINDS, SECRET)
#: Smoothing of a pattern's confidence; least confidence and distinct instances of a pattern that
#: marks; least characters of an identifier that is marked, and the most tokens it is made of.
SMOOTHING, CONFIDENCE, SUPPORT, LEAST_CHARS, MOST_TOKENS = 2.0, 0.8, 8, 5, 4
#: Longer patterns are named by a digest.
PATTERN_CHARS = 160

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_RUN = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")
_SPACE = re.compile(r"\s")
_DIGITS = re.compile(r"[0-9]+")
_LETTERS = re.compile(r"[^\W\d_]+")
_ASSIGNED = re.compile(r"(?<![A-Za-z0-9])(?:password|passwd|secret|token|api[_-]?key)[\x20]{0,3}[=:][\x20]{0,3}[\"']?([^\s\"']{8,})", re.IGNORECASE)
_KEYS = re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])")
_EDGE = "\"'`.,;:!?()[]{}<>|*#$%&=_~"


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Each ``@`` in turn with the run of local characters before it, back to the last match at most:
    the leftmost matches, in time linear in the text."""
    low, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            low = m.end()
        at = text.find("@", max(at + 1, low))


def ips(text: str) -> Iterator[tuple[int, int]]:
    """Four runs at a time of each longest chain of dotted digit runs."""
    for chain in _DOTTED.finditer(text):
        if chain.group().count(".") < 3:
            continue
        runs = list(_RUN.finditer(text, chain.start(), chain.end()))
        for k in range(0, len(runs) - 3, 4):
            four = runs[k : k + 4]
            if all(len(d := r.group().lstrip("0")) < 4 and int(d or 0) <= 255 for r in four):
                yield four[0].start(), four[3].end()


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
            yield m.span()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind in KINDS, end) of all base matches, in that order; places are code
    points."""
    if not _ANY.search(text):
        return []
    return sorted((a, k, b) for k, find in enumerate((emails, ips, cards, phones)) for a, b in find(text))


def secrets(text: str) -> list[tuple[int, int]]:
    """Credentials: what is assigned to a name that says so, and access keys of a known form."""
    return sorted({m.span(1) for m in _ASSIGNED.finditer(text)} | {m.span() for m in _KEYS.finditer(text)})


def tokens(text: str) -> Iterator[tuple[int, int]]:
    """Stretches without blanks that hold a digit or ``@``, stripped of punctuation at their edges (a
    ``+`` and a bracket before a digit stay). Each character is read a fixed number of times."""
    low = 0
    while m := _ANY.search(text, low):
        start = m.start()
        while start > low and not text[start - 1].isspace():
            start -= 1
        stop = _SPACE.search(text, m.end())
        low = stop.start() if stop else len(text)
        a, b = start, low
        opened = text.find("(", a, b) >= 0
        while a < b and text[a] in _EDGE and not (text[a] == "(" and text[a + 1 : a + 2].isdigit()):
            a += 1
        while b > a and text[b - 1] in _EDGE and not (text[b - 1] == ")" and opened):
            b -= 1
        if a < b:
            yield a, b


def shape(span: str, exact: bool) -> str:
    """Letter runs as ``a``, digits as ``9``: each one, or (not ``exact``) each run of them."""
    return _DIGITS.sub((lambda m: "9" * len(m.group())) if exact else "9", _LETTERS.sub("a", span))


def _named(kind: str, *parts: str) -> str:
    name = " ".join((kind, *parts))
    return name if len(name) <= PATTERN_CHARS else f"{kind} #{hashlib.blake2b(name.encode('utf-8', 'surrogatepass'), digest_size=12).hexdigest()}"


def _beside(text: str, at: int, step: int) -> str:
    """The word (a run of letters and digits, lower-case) before (step -1) or after (1) a place, blanks
    and punctuation between them passed over; ``^`` or ``$`` where there is none."""
    k = at - 1 if step < 0 else at
    while 0 <= k < len(text) and not text[k].isalnum():
        k += step
    far = k
    while 0 <= far < len(text) and text[far].isalnum():
        far += step
    return (text[far + 1 : k + 1] if step < 0 else text[k:far]).lower() or ("^" if step < 0 else "$")


def patterns_of(span: str, before: str, after: str) -> list[str]:
    """From the most to the least specific: both words; a word with the shape; the shapes."""
    rough = shape(span, False)
    return list(
        dict.fromkeys(
            (_named("both", before, "_", after), _named("left", before, rough), _named("right", rough, after), _named("shape", shape(span, True)), _named("rough", rough))
        )
    )


def mentions(text: str, base: list[tuple[int, int, int]], keys: list[tuple[int, int]]) -> list[dict]:
    """Seeds with their kind, and candidates: up to MOST_TOKENS neighbouring tokens with a digit or
    ``@`` that no seed overlaps, a blank between each; all with their patterns."""
    if not base and not keys and not _ANY.search(text):
        return []
    seeds = [(a, b, KINDS[k]) for a, k, b in base] + [(a, b, SECRET) for a, b in keys]
    covered = sorted((a, b) for a, b, _ in seeds)
    free, k, high = [], 0, 0
    for a, b in tokens(text):
        while k < len(covered) and covered[k][0] < b:
            high, k = max(high, covered[k][1]), k + 1
        if high <= a:
            free.append((a, b))
    found = list(seeds)
    for i, (a, _) in enumerate(free):
        for j in range(i, min(len(free), i + MOST_TOKENS)):
            if j > i and not (free[j][0] == free[j - 1][1] + 1 and text[free[j - 1][1]].isspace()):
                break
            if free[j][1] - a >= LEAST_CHARS:
                found.append((a, free[j][1], None))
    out = []
    for a, b, kind in found:
        span = text[a:b]
        out.append(
            {
                "start": a,
                "end": b,
                "kind": kind,
                "instance": int.from_bytes(hashlib.blake2b(span.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True),
                "patterns": patterns_of(span, _beside(text, a, -1), _beside(text, b, 1)),
            }
        )
    return out


_MENTION = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("instance", pa.int64()), ("patterns", pa.list_(pa.string()))])
_ROW = (
    "doc_id long, row long, n_email long, n_ip long, n_card long, n_phone long, n_secret long, base string, secrets string, "
    "mentions array<struct<start:long,end:long,kind:string,instance:long,patterns:array<string>>>"
)


def _shown(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, k, b in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, "text"):
        texts = batch.column(2).to_pylist()
        base, keys = [base_spans(t) for t in texts], [secrets(t) for t in texts]
        counts = [pa.array([sum(k == kind for _, k, _ in b) for b in base], pa.int64()) for kind in range(4)]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(1),
                *counts,
                pa.array([len(x) for x in keys], pa.int64()),
                pa.array([_shown([(a, KINDS[k], e) for a, k, e in b]) for b in base], pa.string()),
                pa.array([_shown([(a, SECRET, e) for a, e in x]) for x in keys], pa.string()),
                pa.array([mentions(t, b, x) for t, b, x in zip(texts, base, keys, strict=True)], pa.list_(_MENTION)),
            ],
            ["doc_id", "row", "n_email", "n_ip", "n_card", "n_phone", "n_secret", "base", "secrets", "mentions"],
        )


def trusted_patterns(met: DataFrame, confidence: float = CONFIDENCE, support: int = SUPPORT) -> DataFrame:
    """``pattern, kind, confidence, support`` of the patterns that mark, from ``pattern, instance,
    kind`` (kind null: unknown).

    Known instances are the seeds at first. Of each pattern with at least ``support`` distinct
    instances the confidence in a kind is its known instances of that kind over all its instances
    plus SMOOTHING. In each round the instances of patterns that reach ``confidence`` become known
    as of that kind (of several kinds, that of the highest confidence, then the first by name), and
    the round after counts them, until a round adds none: at most as many as there are instances. An
    instance keeps the kind it got first. All joins are on distinct pairs.
    """
    edges = met.select("pattern", "instance").distinct()
    sizes = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("support")).where(F.col("support") >= support)
    edges = materialise(edges.join(sizes, "pattern"), "pii-edges")
    # a string may be a seed of two kinds; it counts for both
    known = materialise(met.where("kind is not null").select("instance", "kind").distinct(), "pii-known")
    while True:
        scored = (
            edges.join(known, "instance")
            .groupBy("pattern", "kind", "support")
            .agg((F.count(F.lit(1)) / (F.first("support") + SMOOTHING)).alias("confidence"))
            .where(F.col("confidence") >= confidence)
            .groupBy("pattern", "support")
            .agg(F.max_by(F.struct("kind", "confidence"), F.struct("confidence", "kind")).alias("best"))
            .select("pattern", "support", "best.kind", "best.confidence")
        )
        scored = materialise(scored, "pii-patterns")
        reached = (
            edges.select("pattern", "instance")
            .join(scored, "pattern")
            .groupBy("instance")
            .agg(F.max_by("kind", F.struct("confidence", "kind")).alias("kind"))
            .join(known.select("instance").distinct(), "instance", "left_anti")
        )
        reached = materialise(reached, "pii-reached")
        if reached.isEmpty():
            return scored
        known = materialise(known.unionByName(reached), "pii-known")


def _without_overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by document and place: of overlapping spans the leftmost, then the longest."""
    last, end = None, 0
    for batch in batches:
        keep = []
        for r, a, b in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2)), strict=True):
            fits = r != last or a >= end
            keep.append(fits)
            if fits:
                last, end = r, b
        yield batch.filter(pa.array(keep, pa.bool_()))


def personal_data(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", confidence: float = CONFIDENCE, support: int = SUPPORT) -> DataFrame:
    """``id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_secret, secrets,
    n_private`` for every row.

    Counts and ``base_sha256`` are of base matches; ``spans`` adds the ``n_added`` ones of the
    contextual method, which overlap no seed and one another neither. ``secrets`` are the spans of
    credentials, of which ``n_secret`` are seeds. ``n_private`` counts the spans in both. A null text
    counts as empty and has no spans. Base matches are the leftmost that do not overlap for each
    kind, and ones that fail their check are dropped; matches of different kinds may overlap. Rows
    that repeat are searched one by one; texts of any length are searched whole, in linear time; other
    columns are ignored.
    """
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), text.alias("text"))
    rows = materialise(rows.mapInArrow(_scan, _ROW), "pii-scan")
    met = rows.where(F.size("mentions") > 0).select("row", F.explode("mentions").alias("m"))
    pairs = met.select(F.explode("m.patterns").alias("pattern"), "m.instance", "m.kind")
    trusted = trusted_patterns(pairs, confidence, support)
    marked = (
        met.where("m.kind is null")
        .select("row", "m.start", "m.end", F.explode("m.patterns").alias("pattern"))
        .join(trusted.select("pattern", "kind", "confidence"), "pattern")
        .groupBy("row", "start", "end")
        .agg(F.max_by("kind", F.struct("confidence", "kind")).alias("kind"))
        .select("row", "start", "end", "kind")
    )
    marked = marked.repartition("row").sortWithinPartitions("row", "start", F.desc("end"))
    added = marked.mapInArrow(_without_overlaps, marked.schema).groupBy("row").agg(F.collect_list(F.struct("start", "end", "kind")).alias("added"))
    place = F.create_map(*(F.lit(x) for pair in ((k, n) for n, k in enumerate(ALL_KINDS)) for x in pair))

    def all_of(column: str, wanted):
        given = F.transform(
            F.filter(F.split(column, ","), lambda s: s != ""),
            lambda s: F.struct(F.split(s, ":")[1].cast("long").alias("start"), F.split(s, ":")[2].cast("long").alias("end"), F.split(s, ":")[0].alias("kind")),
        )
        both = F.concat(given, F.filter("added", wanted))
        order = F.array_sort(F.transform(both, lambda s: F.struct(s["start"], place[s["kind"]].alias("place"), s["kind"], s["end"])))
        shown = F.transform(order, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
        return F.when(F.col("added").isNull(), F.col(column)).otherwise(F.array_join(shown, ","))

    n_base = F.col("n_email") + F.col("n_ip") + F.col("n_card") + F.col("n_phone") + F.col("n_secret")
    more = F.coalesce(F.size("added"), F.lit(0)).cast("long")
    return (
        rows.drop("mentions")
        .join(added, "row", "left")
        .select(
            F.col("doc_id").alias(id_col),
            "n_email",
            "n_ip",
            "n_card",
            "n_phone",
            F.sha2("base", 256).alias("base_sha256"),
            all_of("base", lambda s: s["kind"] != SECRET).alias("spans"),
            F.coalesce(F.size(F.filter("added", lambda s: s["kind"] != SECRET)), F.lit(0)).cast("long").alias("n_added"),
            "n_secret",
            all_of("secrets", lambda s: s["kind"] == SECRET).alias("secrets"),
            (n_base + more).alias("n_private"),
        )
    )


def sha256_of(spans: str) -> str:
    return hashlib.sha256(spans.encode()).hexdigest()
