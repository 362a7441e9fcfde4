"""URL filters: rules, and a path-template tree for the addresses that no rule fits; DataFrame
functions alone.

Each host has a tree of path segments. From the root down, segments that are variable by the counts
of their siblings become wildcards. Then branches under one parent whose labelled share of bad pages
does not differ significantly from that of their siblings are merged into the parent's wildcard. A
template is rejected when its labelled pages, few as they may be, show that its share of bad pages lies
above that of all: when the lower bound of a score interval does.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapbook.llm.common import materialise

RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
#: A segment is variable if it has at least MANY siblings, itself included, no more pages than their
#: mean, and fewer pages than ENOUGH.
MANY, ENOUGH = 8, 20
#: Significance of a difference, and least labelled pages of a branch that stays apart.
Z, LEAST = 2.58, 5
#: Weight in pages of the share of all, in a template's purity.
PRIOR = 10.0
#: Least labelled pages of a template that is rejected, and the width in standard errors of the interval
#: (Wilson, 1927) whose lower bound has to lie above the share of all: as many templates are tried, wide.
LEAST_LABELS, REJECT_Z = 5, 4.0
#: Segments of a path; those from here on are one segment, as a whole.
DEPTH = 12

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host after the first ``://``, A-Z lower-cased, and the path up to ``?`` or ``#``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(raw, _UPPER, _LOWER), path


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule ``(verdict, host/path)`` that fits, as a struct, or null. The rules are a
    list the caller holds; they are looked up by each suffix of the host."""
    by_host: dict[str, list] = {}
    for verdict, rule in rules:
        h, slash, p = rule.partition("/")
        by_host.setdefault(h, []).append((len(rule), rule, slash + p, verdict))
    if not by_host:
        return F.lit(None).cast("struct<size:int,rule:string,path:string,verdict:string>")
    names = ("size", "rule", "path", "verdict")
    table = F.create_map(
        *(
            x
            for h, own in sorted(by_host.items())
            for x in (F.lit(h), F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip(r, names, strict=True))) for r in own)))
        )
    )
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    own = F.flatten(F.transform(suffixes, lambda s: F.coalesce(F.element_at(table, s), F.array().cast("array<struct<size:int,rule:string,path:string,verdict:string>>"))))
    return F.array_max(F.filter(own, lambda r: F.startswith(path, r["path"])))


def segments(path: Column, depth: int = DEPTH) -> Column:
    """The parts of a path between slashes, empty ones left out; from the ``depth``-th on they are one."""
    own = F.filter(F.split(path, "/"), lambda s: s != "")
    tail = F.array_join(F.slice(own, depth, F.size(own)), "/")
    return F.when(F.size(own) <= depth, own).otherwise(F.concat(F.slice(own, 1, depth - 1), F.array(tail)))


def _above(level: Column) -> Column:
    return F.slice("template", F.lit(1), level - 1)


def _generalised(known: DataFrame, depth: int) -> DataFrame:
    """``known`` (host, raw, template, pages and others, a row for each path) with wildcards for variable
    segments, from the root down, until no branch has paths enough for a variable one."""
    for level in range(1, depth + 1):
        here = F.get("template", F.lit(level - 1))
        at = known.select("host", _above(F.lit(level)).alias("above"), here.alias("here"), "pages").where("here is not null")
        nodes = at.groupBy("host", "above", "here").agg(F.sum("pages").alias("n"))
        wide = nodes.groupBy("host", "above").agg(F.count(F.lit(1)).alias("siblings"), F.sum("n").alias("all")).where(F.col("siblings") >= MANY)
        variable = (
            nodes.join(wide, ["host", "above"]).where((F.col("n") * F.col("siblings") <= F.col("all")) & (F.col("n") < ENOUGH)).select("host", "above", "here", F.lit(True).alias("variable"))
        )
        star = F.concat(_above(F.lit(level)), F.array(F.lit("*")), F.slice("template", level + 1, F.greatest(F.size("template"), F.lit(1))))
        known = known.withColumns({"above": _above(F.lit(level)), "here": here}).join(variable, ["host", "above", "here"], "left")
        known = known.withColumn("template", F.when(F.col("variable"), star).otherwise(F.col("template"))).drop("above", "here", "variable")
        known = materialise(known, "url-paths")
        deeper = known.where(F.size("template") > level).groupBy("host", F.slice("template", 1, level)).agg(F.count(F.lit(1)).alias("paths"))
        if deeper.where(F.col("paths") >= MANY).isEmpty():
            break
    return known


def _merged(known: DataFrame) -> DataFrame:
    """``known`` (host, template, n labelled pages, b of them bad) with ``merged``: each segment that does
    not differ from its siblings is a wildcard. What lies above a segment stays as it is, so all levels
    are judged at once."""
    div = F.try_divide
    levels = F.sequence(F.lit(1), F.size("template"))
    each = known.where(F.size("template") > 0).select("host", "template", "n", "b", F.explode(levels).alias("level"))
    nodes = (
        each.select("host", "level", _above(F.col("level")).alias("above"), F.get("template", F.col("level") - 1).alias("here"), "n", "b")
        .groupBy("host", "level", "above", "here")
        .agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
    )
    pool = nodes.groupBy("host", "level", "above").agg(F.sum("n").alias("pn"), F.sum("b").alias("pb"))
    n, b, on, ob = F.col("n"), F.col("b"), F.col("pn") - F.col("n"), F.col("pb") - F.col("b")
    share = div("pb", "pn")
    error = F.sqrt(share * (1 - share) * (div(F.lit(1), n) + div(F.lit(1), on)))
    differs = F.coalesce((n >= LEAST) & (error > 0) & (F.abs(div(b, n) - div(ob, on)) > Z * error), F.lit(False))
    apart = nodes.join(pool, ["host", "level", "above"]).where(differs).select("host", F.concat("above", F.array("here")).alias("branch"), F.lit(True).alias("apart"))
    own = known.select("host", "template").distinct().where(F.size("template") > 0).select("host", "template", F.explode(levels).alias("level"))
    marked = own.withColumn("branch", F.slice("template", F.lit(1), F.col("level"))).join(apart, ["host", "branch"], "left")
    kept = F.when(F.col("apart"), F.get("template", F.col("level") - 1)).otherwise("*")
    merged = marked.groupBy("host", "template").agg(F.array_sort(F.collect_list(F.struct("level", kept.alias("kept")))).alias("m"))
    merged = merged.select("host", "template", F.transform("m", lambda x: x["kept"]).alias("merged"))
    return known.join(merged, ["host", "template"], "left").withColumn("merged", F.coalesce("merged", "template"))


def lower_bound(b: Column, n: Column, z: float = REJECT_Z) -> Column:
    """The lower end of the score interval of a share, of b in n."""
    share = b / n
    return (share + z * z / (2 * n) - z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def judged_templates(rows: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``host, raw, template, purity, rejected`` for each template ``raw`` of ``host, template, bad`` (bad 1,
    0, or null without a label), where ``template`` is that of its merged branch."""
    known = rows.groupBy("host", F.col("template").alias("raw")).agg(
        F.count(F.lit(1)).alias("pages"), F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("b")
    )
    known = _generalised(materialise(known.withColumn("template", F.col("raw")), "url-paths"), depth)
    known = materialise(_merged(known), "url-merged")
    all_n, all_b = known.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0))).first()
    base = all_b / all_n if all_n else 0.0
    n, b = F.sum("n"), F.sum("b")
    known = known.withColumnRenamed("template", "general").withColumnRenamed("merged", "template")
    rejected = F.when(n >= LEAST_LABELS, lower_bound(b, n) > base).otherwise(False)
    purity = known.groupBy("host", "template").agg((1 - (b + PRIOR * base) / (n + PRIOR)).alias("purity"), rejected.alias("rejected"))
    return known.select("host", "raw", "template").join(purity, ["host", "template"])


def url_verdicts(
    pages: DataFrame,
    labels: DataFrame | None = None,
    rules: Sequence[tuple[str, str]] = RULES,
    url_col: str = "url",
    id_col: str = "page_id",
) -> DataFrame:
    """``id_col, host, path, rule, verdict, template, purity`` for every page.

    ``labels`` (``id_col, bad`` as 0 or 1) feeds the purity; without labels everything is as pure as
    the prior and nothing is rejected. A template goes only where LEAST_LABELS of its pages or more show
    it to be worse than all, whatever the share of bad pages: labels that do not depend on addresses
    reject nothing but by rare chance. A null url and one without ``://`` have an empty host and path,
    which no rule fits and which the tree judges like any other. The longest fitting rule wins over
    the tree. Rows that repeat are judged one by one; of labels that repeat an id the worst counts.
    Other columns are ignored. Urls of any length are judged whole: from the DEPTH-th on, segments of a
    path are one, which bounds the number of jobs.
    """
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    if labels is not None:
        worst = labels.groupBy(F.col(id_col).alias("page_id")).agg(F.max("bad").cast("int").alias("bad"))
        rows = rows.join(worst, "page_id", "left")
    else:
        rows = rows.withColumn("bad", F.lit(None).cast("int"))
    rows = materialise(rows.withColumn("template", segments(F.col("path"))), "url-rows")
    trees = materialise(judged_templates(rows), "url-purity")
    fit = fitting_rule(F.col("host"), F.col("path"), rules)
    return rows.withColumnRenamed("template", "raw").withColumn("fit", fit).join(trees, ["host", "raw"], "left").select(
        F.col("page_id").alias(id_col),
        "host",
        "path",
        F.col("fit.rule").alias("rule"),
        F.coalesce("fit.verdict", F.when(F.col("rejected"), F.lit("block")).otherwise("allow")).alias("verdict"),
        F.concat_ws("/", "template").alias("template"),
        "purity",
    )
