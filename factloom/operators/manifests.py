"""Declared dependencies, features and resolved packages: kinds, unused flags, weight, promises, requirements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Features that a dependency may name and still be called misplaced; what makes a dependency heavy.
SHORT_FEATURES, HEAVY_TRANSITIVE, HEAVY_USED = 1, 20, 3
_WIDE = 1_000_000


def dependency_findings(deps: DataFrame, usage: DataFrame, failed: DataFrame) -> DataFrame:
    """krate, name, rule, feature: what declared dependencies say against where they are used.

    deps: krate, name, ident, kind (normal, dev, build), features (array), explicit_defaults. usage: krate, ident, domain (Normal, Dev, Build).
    failed: krate, domain of files that could not be read, which keep a rule from claiming that nothing is used there.
    """

    def has(domain: str, c: str) -> Column:
        return F.coalesce(F.array_contains(c, domain), F.lit(False))

    used = usage.groupBy("krate", "ident").agg(F.collect_set("domain").alias("domains"))
    blind = failed.groupBy("krate").agg(F.collect_set("domain").alias("blind"))
    elsewhere = deps.where("kind <> 'dev'").select("krate", "name", F.lit(True).alias("elsewhere")).distinct()
    rows = deps.join(used, ["krate", "ident"], "left").join(blind, "krate", "left").join(elsewhere, ["krate", "name"], "left")
    seen = F.col("blind").isNull()
    zero = F.col("domains").isNull() & seen
    flags_only = zero & (F.size("features") > 0)
    unused_dev = (F.col("kind") == "dev") & ~has("Dev", "domains") & seen & F.col("elsewhere").isNull()
    only_dev = (F.col("kind") == "normal") & has("Dev", "domains") & ~has("Normal", "domains") & (F.size("features") <= SHORT_FEATURES) & ~has("Normal", "blind")
    not_build = (F.col("kind") == "build") & ~has("Build", "domains") & ~has("Build", "blind")
    found = F.array_compact(
        F.array(
            F.when(zero & F.col("explicit_defaults"), "default-features-unused"),
            F.when(~flags_only & unused_dev, "unused-dev-dependency"),
            F.when(~flags_only & (only_dev | not_build), "misplaced-dependency-kind"),
        )
    )
    whole = rows.select("krate", "name", F.explode(found).alias("rule"), F.lit(None).cast("string").alias("feature"))
    flags = rows.where(flags_only).select("krate", "name", F.lit("unused-feature-flag").alias("rule"), F.explode("features").alias("feature"))
    return whole.unionByName(flags)


def unused_features(features: DataFrame, texts: DataFrame) -> DataFrame:
    """krate, feature: own features without implications that no text asks for. features: krate, feature, implied (array); texts: krate, text."""
    asked = F.regexp_extract_all(F.col("text"), F.lit(r'feature(?: = |=)"([^"]*)"'), F.lit(1))
    named = texts.select("krate", F.explode(asked).alias("feature")).distinct()
    plain = features.where((F.col("feature") != "default") & (F.size("implied") == 0)).select("krate", "feature")
    return plain.join(named, ["krate", "feature"], "left_anti")


def feature_edges(features: DataFrame) -> DataFrame:
    """krate, src, dst: which feature turns on which other of the same package."""
    edges = features.select("krate", F.col("feature").alias("src"), F.explode("implied").alias("dst"))
    return edges.join(features.select("krate", F.col("feature").alias("dst")), ["krate", "dst"], "left_semi").select("krate", "src", "dst").distinct()


def heavy(deps: DataFrame, transitive: DataFrame, used: DataFrame, most: int = HEAVY_TRANSITIVE, least: int = HEAVY_USED) -> DataFrame:
    """krate, name, transitive, used: dependencies that bring in many packages for few items. transitive: name, transitive; used: krate, name, item."""
    items = used.groupBy("krate", "name").agg(F.countDistinct("item").alias("used"))
    rows = deps.select("krate", "name").distinct().join(transitive, "name").join(items, ["krate", "name"], "left").withColumn("used", F.coalesce("used", F.lit(0)))
    return rows.where((F.col("transitive") > most) & (F.col("used") < least)).select("krate", "name", "transitive", "used")


def above_promise(packages: DataFrame, promise: Column) -> DataFrame:
    """Packages (name, needs: a version struct, member) of others that need a later language version than the own promise; none without a promise."""
    return packages.where(~F.col("member") & (F.col("needs") > promise))


def requirers(edges: DataFrame) -> DataFrame:
    """name, requirers: who depends on each package directly, sorted, comma-joined."""
    return edges.groupBy(F.col("dst").alias("name")).agg(F.array_join(F.array_sort(F.collect_set(F.col("src").cast("string"))), ",").alias("requirers"))


def version_key(major: Column, minor: Column, patch: Column) -> Column:
    """One number that is in the order of versions; numbers below a million each."""
    return (major.cast("bigint") * _WIDE + minor) * _WIDE + patch


def requirement_range(requirement: str) -> Column:
    """struct(low, high) of version_key()s: low <= version < high satisfies the requirement, all of its comparators at once; null if it can't be read.

    Comparators are separated by commas; without a sign one means ^. Pre-releases satisfy no requirement here.
    """
    pattern = r"^\s*(\^|~|=|>=|<=|>|<)?\s*([0-9]+|\*)(?:\.([0-9]+|\*|x))?(?:\.([0-9]+|\*|x))?\s*$"

    def one(c: Column) -> Column:
        part = lambda i: F.regexp_extract(c, pattern, i)
        number = lambda i: F.when(part(i).rlike("^[0-9]+$"), part(i).cast("bigint"))
        a, b, p = number(2), number(3), number(4)
        sign = F.when((part(1) == "") & c.contains("*"), "=").when(part(1) == "", "^").otherwise(part(1))
        zero = F.lit(0)
        low = version_key(a, F.coalesce(b, zero), F.coalesce(p, zero))
        after = F.when(b.isNull(), version_key(a + 1, zero, zero)).when(p.isNull(), version_key(a, b + 1, zero)).otherwise(low + 1)  # the first version past all that the numbers name
        caret = F.when((a > 0) | b.isNull(), version_key(a + 1, zero, zero)).when((b > 0) | p.isNull(), version_key(a, b + 1, zero)).otherwise(low + 1)
        tilde = F.when(b.isNull(), version_key(a + 1, zero, zero)).otherwise(version_key(a, b + 1, zero))
        begin = F.when(sign.isin("<", "<="), F.lit(0)).when(sign == ">", after).otherwise(low)
        end = F.when(sign.isin(">", ">="), F.lit(1 << 62)).when(sign == "<", low).when(sign == "^", caret).when(sign == "~", tilde).otherwise(after)
        all_ = F.struct(F.lit(0).cast("bigint").alias("low"), F.lit(1 << 62).alias("high"))
        return F.when(part(2) == "*", all_).when(c.rlike(pattern), F.struct(begin.cast("bigint").alias("low"), end.cast("bigint").alias("high")))

    ranges = F.transform(F.split(F.col(requirement), ","), one)
    whole = F.struct(F.array_max(F.transform(ranges, lambda r: r["low"])).alias("low"), F.array_min(F.transform(ranges, lambda r: r["high"])).alias("high"))
    return F.when(F.forall(ranges, lambda r: r.isNotNull()), whole)


def phantom_versions(declared: DataFrame, published: DataFrame) -> DataFrame:
    """krate, name, requirement: dependencies whose requirement no published version that isn't yanked satisfies.

    declared: krate, name, requirement. published: name, v (version struct), yanked. Names that aren't published at all, and requirements that can't be read, are no matter of this rule.
    """
    have = published.where(~F.col("yanked")).groupBy("name").agg(F.array_sort(F.collect_set(version_key(F.col("v.major"), F.col("v.minor"), F.col("v.patch")))).alias("have"))
    known = published.select("name").distinct().join(have, "name", "left")
    rows = declared.join(known, "name").withColumn("r", requirement_range("requirement")).where("r is not null")
    # the range as a lambda's argument: a column would be read from its text anew for each version
    have = F.coalesce("have", F.array().cast("array<bigint>"))
    met = F.get(F.transform(F.array("r"), lambda r: F.exists(have, lambda v: (v >= r["low"]) & (v < r["high"]))), F.lit(0))
    return rows.where(~met).select("krate", "name", "requirement")
