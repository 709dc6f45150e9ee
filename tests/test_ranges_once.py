"""A requirement is read once for a row, however many versions it is compared with."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import manifests


def test_versions_are_compared_with_a_range_that_is_there(spark):
    declared = spark.createDataFrame([("k", "a", "^1.2.3"), ("l", "a", "=0.0.7"), ("m", "a", "no version"), ("n", "b", "1")], "krate string, name string, requirement string")
    v = F.struct(F.lit(1).alias("major"), (F.col("id") % 50).cast("int").alias("minor"), F.lit(4).alias("patch"))
    published = spark.range(50).select(F.lit("a").alias("name"), v.alias("v"), F.lit(False).alias("yanked"))
    found = manifests.phantom_versions(declared, published)
    assert [tuple(r) for r in found.collect()] == [("l", "a", "=0.0.7")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    tests = [part for part in plan.split("exists(")[1:]]
    assert tests and all("requirement" not in part.split("))")[0] for part in tests)
