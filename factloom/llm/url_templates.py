"""URL filters: block and allow rules, and for all other pages a tree of path templates per host.

A path is its segments, digit runs as #; the last of DEPTH is all that is left of a deeper path. The tree grows a level at a time,
as aggregates over distinct (host, segments) with their numbers of pages, labelled pages and good ones:

1. A segment stays literal below a node when it has LEAST pages and 1 of SHARE of the node's; a node so has at most SHARE literal
   ones, and all others are one wildcard.
2. Literal branches are merged whose statistics are alike: in order of smoothed purity, each begins a new branch unless its purity lies within
   Z standard errors of the one before, and as many of its paths end there, within ENDS.
3. A branch's purity is its share of good pages, smoothed by its parent's as PRIOR pages of that purity; a host's parent is all hosts.

A page is blocked when the purity of its whole path's template is under THRESHOLD.

Defined cases: a null url or one without :// has an empty host and path; no rule fits and its template is that host's. Pages of equal url share a
verdict. Without labels all purities are 1/2, which is not under the threshold, so nothing is blocked. An empty table gives an empty result. Labels of one page that
contradict each other count each. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import kept

#: Fixed values: (verdict, host, path). The longest host and path that fits wins.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Segments of a template; pages of a literal segment; of how many pages of a node a literal segment has one at least.
DEPTH, LEAST, SHARE = 8, 4, 100
#: Standard errors squared that purities of merged branches are apart, and by how much the shares of paths that end there may differ.
Z2, ENDS = 3.84, 0.25
#: Pages that the parent's purity counts for, and the purity under which a template is rejected.
PRIOR, THRESHOLD = 8.0, 0.5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: str) -> tuple[Column, Column]:
    u = F.coalesce(F.col(url).cast("string"), F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise("")
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"\A[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def fitting_rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits (ties: the later one in code-point order) and its verdict, null if none does. rules: a configuration, one expression each."""
    fits = [F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(len(h + p)).alias("n"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for v, h, p in rules]
    if not fits:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    best = F.greatest(*fits, F.lit(None))
    return best["rule"], best["verdict"]


def segments(path: str, depth: int = DEPTH) -> Column:
    """Of /a/12.html: a, #.html. A path that ends with / has an empty last segment; an empty path has none."""
    parts = F.split(F.regexp_replace(F.regexp_replace(F.col(path), r"\A/", ""), "[0-9]+", "#"), "/", -1)
    cut = F.when(F.size(parts) > depth, F.concat(F.slice(parts, 1, depth - 1), F.array(F.array_join(F.slice(parts, F.lit(depth), F.size(parts)), "/")))).otherwise(parts)
    return F.when(F.col(path) == "", F.array().cast("array<string>")).otherwise(cut)


def _smoothed(good: Column, labelled: Column, parent: Column) -> Column:
    return (good + PRIOR * parent) / (labelled + PRIOR)


def template_tree(paths: DataFrame, depth: int = DEPTH) -> DataFrame:
    """host, segs, template, purity of each distinct path. paths: host, segs, n, labelled, good, one row a distinct path.

    Template segments: a literal, literals that were merged joined by |, or *. Levels end with the deepest path.
    """
    all_ = paths.agg(((F.sum("good") + 1) / (F.sum("labelled") + 2)).alias("whole"))  # one row
    host = paths.groupBy("host").agg(F.sum("labelled").alias("l"), F.sum("good").alias("g")).crossJoin(F.broadcast(all_))
    begun = host.select("host", _smoothed(F.col("g"), F.col("l"), F.coalesce("whole", F.lit(0.5))).alias("purity"))
    rows = paths.join(begun, "host").withColumn("template", F.lit(""))
    deepest = paths.agg(F.max(F.size("segs")).alias("d")).first()["d"] or 0
    node = ["host", "template"]
    for level in range(1, min(depth, deepest) + 1):
        rows = kept(rows.withColumn("seg", F.get("segs", F.lit(level - 1))))
        ends = F.sum(F.when(F.size("segs") == level, F.col("n")).otherwise(0))
        children = rows.where("seg is not null").groupBy(*node, "seg").agg(F.first("purity").alias("parent"), F.sum("n").alias("n"), F.sum("labelled").alias("l"), F.sum("good").alias("g"), ends.alias("e"))
        sizes = children.groupBy(*node).agg(F.sum("n").alias("pages"))
        literal = children.join(sizes, node).where((F.col("n") >= LEAST) & (F.col("n") * SHARE >= F.col("pages")))
        merged = _merged(literal, node)
        placed = rows.join(merged, [*node, "seg"], "left").withColumn("branch", F.when(F.col("seg").isNotNull(), F.coalesce("branch", F.lit("*"))))
        stars = placed.where("branch = '*'").groupBy(*node).agg(F.sum("labelled").alias("sl"), F.sum("good").alias("sg"))
        placed = placed.join(stars, node, "left")
        own = F.when(F.col("branch") == "*", _smoothed(F.col("sg"), F.col("sl"), F.col("purity"))).otherwise(F.col("branch_purity"))
        rows = placed.select(
            "host", "segs", "n", "labelled", "good",
            F.when(F.col("branch").isNull(), F.col("purity")).otherwise(own).alias("purity"),
            F.when(F.col("branch").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), "branch")).alias("template"),
        )
    return rows.select("host", "segs", "template", "purity")


def _merged(literal: DataFrame, node: list[str]) -> DataFrame:
    """Adds branch and its purity to the literal segments of each node, SHARE at most a node."""
    order = Window.partitionBy(*node).orderBy("p", "seg")
    p, before = F.col("p"), F.lag("p").over(order)
    spread = p * (1 - p) / (F.col("l") + PRIOR)
    ended = F.col("e") / F.col("n")
    with_p = literal.withColumn("p", _smoothed(F.col("g"), F.col("l"), F.col("parent")))
    gap = (p - before) * (p - before) > Z2 * (spread + F.lag(spread).over(order))
    begins = before.isNull() | gap | (F.abs(ended - F.lag(ended).over(order)) > ENDS)
    numbered = with_p.withColumn("begins", F.when(begins, 1).otherwise(0)).withColumn("b", F.sum("begins").over(order))
    groups = numbered.groupBy(*node, "b").agg(F.array_join(F.array_sort(F.collect_list("seg")), "|").alias("branch"), _smoothed(F.sum("g"), F.sum("l"), F.first("parent")).alias("branch_purity"))
    return numbered.join(groups, [*node, "b"]).select(*node, "seg", "branch", "branch_purity")


def judged(pages: DataFrame, labelled: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity. pages: page_id, url. labelled: url, good (1 or 0), of any pages."""

    def parsed(df: DataFrame, *more: str) -> DataFrame:
        host, path = host_and_path("url")
        return df.select(*more, host.alias("host"), path.alias("path")).withColumn("segs", segments("path"))

    rows = kept(parsed(pages, "page_id"))
    seen = rows.groupBy("host", "segs").agg(F.count("*").alias("n"), F.lit(0).cast("bigint").alias("labelled"), F.lit(0).cast("bigint").alias("good"))
    marks = parsed(labelled.where("good is not null"), "good").groupBy("host", "segs").agg(F.lit(0).cast("bigint").alias("n"), F.count("*").alias("labelled"), F.sum("good").alias("good"))
    paths = kept(seen.unionByName(marks).groupBy("host", "segs").agg(*(F.sum(c).alias(c) for c in ("n", "labelled", "good"))))
    tree = template_tree(paths)
    rule, by_rule = fitting_rule(F.col("host"), F.col("path"), rules)
    by_tree = F.when(F.col("purity") < threshold, "block").otherwise("allow")
    return rows.join(tree, ["host", "segs"]).select("page_id", "host", "path", rule.alias("rule"), F.coalesce(by_rule, by_tree).alias("verdict"), "template", "purity")


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """url, good: pages whose path ends with the id of a labelled document, which they show; good as the document's quality."""
    _, path = host_and_path("url")
    doc = F.expr("try_cast(nullif(regexp_extract(path, '([0-9]+)[^0-9/]*/?$', 1), '') as bigint)")
    named = pages.select("url", path.alias("path")).select("url", doc.alias("doc_id"))
    marks = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("bigint").alias("good"))
    return named.join(marks.where("doc_id is not null and good is not null"), "doc_id").select("url", "good")
