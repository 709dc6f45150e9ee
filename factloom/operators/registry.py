"""Dependency and registry rules over snapshot tables: never a live lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def several(rows: DataFrame, key: str, value: str, least: int = 2) -> DataFrame:
    """key, n, found: keys with enough distinct values (versions in buckets, requirement strings), values sorted."""
    sets = rows.groupBy(key).agg(F.array_sort(F.collect_set(F.col(value).cast("string"))).alias("f"))
    return sets.where(F.size("f") >= least).select(key, F.size("f").alias("n"), F.array_join("f", ",").alias("found"))


def phantom(declared: DataFrame, published: DataFrame) -> DataFrame:
    return declared.select("name").distinct().join(published.select("name"), "name", "left_anti")


def yanked(resolved: DataFrame, versions: DataFrame) -> DataFrame:
    return resolved.join(versions.where("yanked"), ["name", "vers"]).select("name", "vers").distinct()


def fresh_low_reputation(meta: DataFrame, anchor: F.Column, days: int = 90, downloads: int = 1000) -> DataFrame:
    """Young and little used and without a repository; a row without a readable date doesn't count."""
    blank = F.trim(F.coalesce("repository", F.lit(""))) == ""
    return meta.where((F.datediff(anchor, "created") < days) & (F.col("downloads") < downloads) & blank).select("name")


def few_owners(owners: DataFrame, least: int = 2) -> DataFrame:
    return owners.groupBy("name").agg(F.countDistinct("login").alias("owners")).where(F.col("owners") < least)


def unused_everywhere(lint: DataFrame, targets: DataFrame) -> DataFrame:
    """Names that the lint calls unused in every target: relational division. A target without a message clears all."""
    total = targets.select("target").distinct().agg(F.count("*").alias("total"))
    return lint.groupBy("name").agg(F.countDistinct("target").alias("n")).crossJoin(F.broadcast(total)).where("n = total").select("name")


def advisory_state(advisories: DataFrame, resolved: DataFrame, production: DataFrame) -> DataFrame:
    """id, name, state (production, dev_only or unknown), severity. Advisories for unresolved packages stay, as unknown."""
    a = advisories.join(resolved.select("name", F.lit(True).alias("is_resolved")).distinct(), "name", "left").join(production.select("name", F.lit(True).alias("is_production")).distinct(), "name", "left")
    state = F.when(F.col("is_resolved").isNull(), "unknown").when(F.col("is_production"), "production").otherwise("dev_only")
    return a.select("id", "name", state.alias("state"), F.when(state == "production", "Fail").otherwise("Warn").alias("severity"))


def nearest_versions(published: DataFrame, limit: int = 3) -> DataFrame:
    """name, nearest: the highest versions (struct major, minor, patch), highest first."""
    v = published.select("name", F.struct("major", "minor", "patch").alias("v")).distinct()
    top = v.groupBy("name").agg(F.slice(F.sort_array(F.collect_list("v"), False), 1, limit).alias("t"))
    return top.select("name", F.array_join(F.transform("t", lambda x: F.concat_ws(".", x.major.cast("string"), x.minor.cast("string"), x.patch.cast("string"))), ",").alias("nearest"))


def disjoint_implementors(impls: DataFrame, methods: int) -> DataFrame:
    """grp, a, b: the first pair of implementors with non-empty disjoint override sets, of groups of enough methods. impls: grp, type, method."""
    sets = impls.groupBy("grp", "type").agg(F.collect_set("method").alias("m"))
    wide = impls.groupBy("grp").agg(F.countDistinct("method").alias("k")).where(F.col("k") >= methods).select("grp")
    x, y = sets.join(wide, "grp", "left_semi").select("grp", F.col("type").alias("a"), F.col("m").alias("ma")), sets.select("grp", F.col("type").alias("b"), F.col("m").alias("mb"))
    pairs = x.join(y, "grp").where("a < b and not arrays_overlap(ma, mb)")
    return pairs.groupBy("grp").agg(F.min(F.struct("a", "b")).alias("p")).select("grp", "p.a", "p.b")
