"""Provenance: which class of author a commit has, and what each class changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How sure each way of telling a class is.
CONFIDENCE = {"label": 0.95, "trailer": 0.85, "heuristic": 0.35, "unknown": 0.0}


def word_in(text: str, word: str) -> Column:
    """Whether a word stands between non-alphanumeric characters, whatever its case."""
    return F.lower(F.col(text)).rlike(r"(^|[^\p{L}\p{N}])" + word.lower() + r"($|[^\p{L}\p{N}])")


def classify(commits: DataFrame, labels: DataFrame, agents: tuple[str, ...], suspicious: Column) -> DataFrame:
    """commits (commit_id, author, body) with class and confidence, by precedence: the first configured label whose
    needle the body or author contains, an agent named in the body, the heuristic, unknown.

    labels (ord, label, needle) is a configuration of bounded size.
    """
    hit = F.lower("body").contains(F.lower("needle")) | F.lower("author").contains(F.lower("needle"))
    label = commits.join(F.broadcast(labels), hit).groupBy("commit_id").agg(F.min_by("label", "ord").alias("label"))
    agent = F.lit(None).cast("string")
    for a in reversed(agents):
        agent = F.when(word_in("body", a), a).otherwise(agent)
    rows = commits.join(label, "commit_id", "left").withColumn("agent", agent)
    way = F.when(F.col("label").isNotNull(), "label").when(F.col("agent").isNotNull(), "trailer").when(suspicious, "heuristic").otherwise("unknown")
    sure = F.element_at(F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv]), way)
    return rows.select("commit_id", F.coalesce("label", "agent", F.when(suspicious, "agent?"), F.lit("unknown")).alias("class"), sure.alias("confidence"))


def _holds(low: str) -> Callable[[Column], Column]:
    return lambda t: F.lower(t).contains(low)


def labelled(commits: DataFrame, labels: DataFrame) -> DataFrame:
    """commit_id, label: of each commit (commit_id, author_email, trailers: array of values) the first configured label of which a needle is in one of its trailers or its author's
    address, whatever the case; null if none is. labels: ord, label, needle, place (trailer or email), a configuration, whose rows become one expression.
    """
    rows = sorted(tuple(r) for r in labels.select("ord", "label", "needle", "place").collect())
    found = F.lit(None).cast("string")
    for _, label, needle, place in rows[::-1]:
        low = needle.lower()
        hit = F.exists("trailers", _holds(low)) if place == "trailer" else F.lower("author_email").contains(low)
        found = F.when(hit, F.lit(label)).otherwise(found)
    return commits.select("commit_id", found.alias("label"))


def by_class(classes: DataFrame, touches: DataFrame) -> DataFrame:
    """class, commits, files touched, least confidence."""
    sizes = touches.groupBy("commit_id").agg(F.countDistinct("file").alias("files"))
    rows = classes.join(sizes, "commit_id", "left")
    return rows.groupBy("class").agg(F.count("*").alias("commits"), F.coalesce(F.sum("files"), F.lit(0)).alias("files"), F.min("confidence").alias("confidence"))


def added_unreferenced(changes: DataFrame) -> DataFrame:
    """commit_id, name: names of the manifest after but not before that no co-touched text contains. changes: commit_id, before, after (arrays), touched (text)."""
    added = changes.select("commit_id", "touched", F.explode(F.array_except("after", F.coalesce("before", F.array().cast("array<string>")))).alias("name"))
    return added.where(~F.coalesce(F.col("touched"), F.lit("")).contains(F.col("name"))).select("commit_id", "name")
