"""Operators over change history: churn, hotspots, ownership, coupling, cadence.

Facts are DataFrames: touches(commit_id, file, grp, day, author), blame(file, author, lines),
files(file, grp, size). The clock is the anchor, a one-row DataFrame (anchor date) or the newest day of the history.
Every operator is one declarative plan; aggregation is partial before each shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def anchored(touches: DataFrame) -> DataFrame:
    """touches with age: days before the newest commit, never negative. The anchor is one row, so its broadcast is bounded."""
    newest = touches.agg(F.max("day").alias("anchor"))
    return touches.crossJoin(F.broadcast(newest)).withColumn("age", F.greatest(F.datediff("anchor", "day"), F.lit(0))).drop("anchor")


def churn(touches: DataFrame, days: int) -> DataFrame:
    """file, commits within the window; a commit exactly at the cutoff is inside."""
    return anchored(touches).where(F.col("age") <= days).groupBy("file").agg(F.count("*").alias("commits"))


def recency_churn(touches: DataFrame, days: int, half_life: float = 90.0) -> DataFrame:
    """file, commits, weight: the sum of 0.5 ** (age / half_life)."""
    return anchored(touches).where(F.col("age") <= days).groupBy("file").agg(F.count("*").alias("commits"), F.sum(F.pow(F.lit(0.5), F.col("age") / F.lit(half_life))).alias("weight"))


def hotspots(touches: DataFrame, complexity: DataFrame, days: int, limit: int = 15) -> DataFrame:
    """The files of the highest complexity times recency weight. Files without churn are dropped; ties go by file."""
    scored = recency_churn(touches, days).join(complexity, "file").withColumn("score", F.round(F.col("complexity") * F.col("weight"), 4))
    return scored.select("file", "complexity", "commits", "score").orderBy(F.desc("score"), "file").limit(limit)


def churn_hotspots(touches: DataFrame, days: int = 14, least: int = 5) -> DataFrame:
    return churn(touches, days).where(F.col("commits") >= least)


def active_authors(touches: DataFrame, days: int) -> DataFrame:
    return anchored(touches).where(F.col("age") <= days).select("author").distinct()


def legacy_freeze(files: DataFrame, touches: DataFrame, days: int = 365, least: int = 2) -> DataFrame:
    """Files without a commit in the window whose group has enough other files with one."""
    seen = churn(touches, days)
    rows = files.join(seen, "file", "left").withColumn("active", F.coalesce(F.col("commits") > 0, F.lit(False)).cast("int"))
    per_group = rows.groupBy("grp").agg(F.sum("active").alias("active_siblings"))
    return rows.where("active = 0").join(per_group, "grp").where(F.col("active_siblings") >= least).select("file", "grp", "active_siblings")


def ownership(blame: DataFrame) -> DataFrame:
    """file, author, lines, total, share."""
    sums = blame.groupBy("file", "author").agg(F.sum("lines").alias("lines"))
    w = Window.partitionBy("file")
    return sums.withColumn("total", F.sum("lines").over(w)).withColumn("share", F.col("lines") / F.col("total"))


def bus_factor(blame: DataFrame) -> DataFrame:
    """file, authors, bus_factor: the fewest authors, by lines then name, who hold more than half."""
    order = Window.partitionBy("file").orderBy(F.desc("lines"), "author")
    ran = ownership(blame).withColumn("n", F.row_number().over(order)).withColumn("held", F.sum("lines").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return ran.groupBy("file").agg(F.count("*").alias("authors"), F.min(F.when(F.col("held") > 0.5 * F.col("total"), F.col("n"))).alias("bus_factor"), F.round(F.max("share"), 6).alias("top_share"))


def low_bus_factor(blame: DataFrame, active: DataFrame) -> DataFrame:
    """Files of bus factor 1 with their owner's activity: Fail if the owner is inactive, else Warn. Off where there is one author only."""
    order = Window.partitionBy("file").orderBy(F.desc("lines"), "author")
    owner = ownership(blame).withColumn("n", F.row_number().over(order)).where("n = 1 and lines > 0.5 * total").select("file", "author")
    several = blame.select("author").distinct().limit(2).agg((F.count("*") >= 2).alias("several"))
    known = active.select("author").distinct().withColumn("is_active", F.lit(True))
    rows = owner.join(known, "author", "left").crossJoin(F.broadcast(several)).where("several")
    return rows.select("file", "author", F.when(F.col("is_active"), "Warn").otherwise("Fail").alias("severity"))


def fragmentation(blame: DataFrame, authors: int = 4, share: float = 0.35, lines: int = 50, top: int = 5) -> DataFrame:
    """Files of many authors none of whom owns much, with the top shares."""
    order = Window.partitionBy("file").orderBy(F.desc("lines"), "author")
    rows = ownership(blame).withColumn("n", F.row_number().over(order))
    per = rows.groupBy("file").agg(F.count("*").alias("authors"), F.max("total").alias("lines"), F.max("share").alias("s"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("n") <= top, F.col("author")))), ",").alias("top_authors"))
    return per.where((F.col("authors") >= authors) & (F.col("s") < share) & (F.col("lines") >= lines)).select("file", "authors", "lines", F.round("s", 6).alias("top_share"), "top_authors")


def _sizes(files: DataFrame, *order: Column) -> DataFrame:
    """grp, size, k (files of that size), before (files of the group ahead of that size in order): counts first, so a window holds the distinct sizes of a group."""
    w = Window.partitionBy("grp").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    counts = files.groupBy("grp", "size").agg(F.count("*").alias("k"))
    return counts.withColumn("before", F.coalesce(F.sum("k").over(w), F.lit(0)))


def gini(files: DataFrame) -> DataFrame:
    """grp, n, gini of size: 0 for one file or no size."""
    k, before = F.col("k"), F.col("before")
    ranks = before * k + (k * (k + 1) / 2).cast("bigint")  # the sum of the ranks of equal sizes
    s = _sizes(files, F.col("size")).groupBy("grp").agg(F.sum("k").alias("n"), F.sum(k * F.col("size")).alias("total"), F.sum(ranks * F.col("size")).alias("weighted"))
    value = F.when((F.col("n") <= 1) | (F.col("total") == 0), F.lit(0.0)).otherwise(2 * F.col("weighted") / (F.col("n") * F.col("total")) - (F.col("n") + 1) / F.col("n"))
    return s.select("grp", "n", F.round(value, 6).alias("gini"))


def size_outliers(files: DataFrame, least: float = 0.6) -> DataFrame:
    """Files in the largest tenth of a group of uneven sizes; of equal sizes at the edge the first ones by file."""
    uneven = gini(files).where(F.col("gini") > least)
    sizes = _sizes(files, F.desc("size")).join(uneven, "grp").withColumn("most", F.col("n") - F.floor(F.col("n") * 9 / 10))
    rows = files.join(sizes.where("before < most"), ["grp", "size"])
    whole = rows.where("before + k <= most")
    edge = rows.where("before + k > most").withColumn("r", F.row_number().over(Window.partitionBy("grp", "size").orderBy("file"))).where("before + r <= most").drop("r")
    return whole.unionByName(edge).select("file", "grp", "size", "gini")


def change_coupling(touches: DataFrame, layer_of: DataFrame, least: int = 5, ratio: float = 0.6) -> DataFrame:
    """Pairs of groups of different layers that change in the same commits.

    The pairs of a commit come from the set of its groups, one row a commit, without a join of the touches with themselves; counts are combined before the shuffle.
    """
    own = touches.groupBy("commit_id").agg(F.sort_array(F.collect_set("grp")).alias("grps"))
    total = own.select(F.explode("grps").alias("grp")).groupBy("grp").agg(F.count("*").alias("total"))
    firsts = own.where("commit_id is not null").select("grps", F.posexplode("grps").alias("i", "a"))
    both = firsts.select("a", F.explode(F.slice("grps", F.col("i") + 2, F.size("grps"))).alias("b"))
    pairs = both.groupBy("a", "b").agg(F.count("*").alias("together")).where(F.col("together") >= least)
    for c in "ab":
        pairs = pairs.join(total.select(F.col("grp").alias(c), F.col("total").alias(f"total_{c}")), c).join(layer_of.select(F.col("grp").alias(c), F.col("layer").alias(f"layer_{c}")), c)
    pairs = pairs.where("layer_a <> layer_b").withColumn("ratio", F.col("together") / F.least("total_a", "total_b"))
    return pairs.where(F.col("ratio") >= ratio).select("a", "b", "together", F.round("ratio", 6).alias("ratio"))


def commit_size_outliers(touches: DataFrame, least: int = 10) -> DataFrame:
    """Commits of more files than mean + 2 population deviations, if there are enough commits."""
    sizes = touches.groupBy("commit_id").agg(F.countDistinct("file").alias("files"))
    limit = sizes.agg(F.count("*").alias("n"), (F.avg("files") + 2 * F.stddev_pop("files")).alias("threshold"))
    return sizes.crossJoin(F.broadcast(limit)).where((F.col("n") >= least) & (F.col("files") > F.col("threshold"))).select("commit_id", "files", F.round("threshold", 6).alias("threshold"))


def regular_cadence(events: DataFrame, least: int = 5, cv: float = 0.15) -> DataFrame:
    """Authors whose gaps between events are suspiciously even: deviation / mean under cv. events: author, second."""
    order = Window.partitionBy("author").orderBy("second", "id")
    gaps = events.withColumn("gap", F.col("second") - F.lag("second").over(order))
    s = gaps.groupBy("author").agg(F.count("*").alias("n"), F.avg("gap").alias("mean"), F.stddev_pop("gap").alias("dev"))
    return s.where((F.col("n") >= least) & (F.col("mean") > 0)).withColumn("cv", F.round(F.col("dev") / F.col("mean"), 6)).where(F.col("cv") < cv).select("author", "n", "cv")
