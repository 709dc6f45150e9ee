"""Rules on patterns and principles, over tables of signatures (functions/signatures.py): candidates with their evidence, never gating.

Each is grouping with flags: none joins a function with another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.signatures import PRIMITIVES

#: A function is complex from this complexity on, a file has several items from this number on, flags are a cluster from this number on.
COMPLEX, SEVERAL_ITEMS, FLAGS = 10, 3, 3
#: Bits of an item's effects.
IO, OUTPUT, COMPUTES = 1, 2, 4


def primitive_values(functions: DataFrame, owners: DataFrame) -> DataFrame:
    """krate, param, type, signatures, guarded: parameters of primitive type that public functions of a crate share by name and type, two at least, and that one of them checks.

    An inverted index of (crate, name, type) over the signatures with a flag: a signature is a row a parameter, and a group is counted, never paired.
    """
    rows = functions.where("public").join(owners, "file").select("krate", "checked", F.explode("params").alias("p")).where(F.col("p.type").isin(*PRIMITIVES))
    guard = F.array_contains(F.flatten("checked"), F.col("p.name")).cast("int")
    groups = rows.groupBy("krate", F.col("p.name").alias("param"), F.col("p.type").alias("type")).agg(F.count("*").alias("signatures"), F.sum(guard).alias("guarded"))
    return groups.where("signatures >= 2 and guarded >= 1")


def _together(sets: Column, names: Column, least: int = 2) -> Column:
    """Whether one of the sets has so many of the names."""
    return F.exists(sets, lambda s: F.size(F.array_intersect(s, names)) >= least)


def boolean_clusters(functions: DataFrame) -> DataFrame:
    """file, name, flags: functions of FLAGS parameters or more of type bool of which a condition looks at two."""
    flags = F.array_sort(F.array_distinct(F.transform(F.filter("params", lambda p: p["type"] == "bool"), lambda p: p["name"])))
    rows = functions.withColumn("flags", flags).where(F.size("flags") >= FLAGS)
    return rows.where(_together(F.col("conditions"), F.col("flags"))).select("file", "name", "flags")


def invariant_bypasses(structs: DataFrame, functions: DataFrame, owners: DataFrame) -> DataFrame:
    """krate, struct, fields, constructors: public structs of two public fields or more, not closed, that a public function of their crate gives back after checking two of
    them together, by parameters of the fields' names."""
    named = structs.where("public and not non_exhaustive").join(owners, "file")
    open_ = named.groupBy("krate", F.col("name").alias("struct")).agg(F.max(F.array_sort(F.array_distinct("fields"))).alias("fields")).where(F.size("fields") >= 2)
    makers = functions.where("public and returned is not null").join(owners, "file").select("krate", F.col("returned").alias("struct"), F.col("name").alias("constructor"), "checked", F.transform("params", lambda p: p["name"]).alias("given"))
    both = makers.join(open_, ["krate", "struct"]).withColumn("shared", F.array_intersect("given", "fields"))
    hit = both.where(_together(F.col("checked"), F.col("shared")))
    return hit.groupBy("krate", "struct").agg(F.first("fields").alias("fields"), F.array_sort(F.collect_set("constructor")).alias("constructors"))


def manual_lifecycles(functions: DataFrame, drops: DataFrame, owners: DataFrame) -> DataFrame:
    """krate, functions: crates where functions both take and give back a resource by name, and no file implements Drop."""
    guarded = drops.join(owners, "file").select("krate").distinct()
    pairs = functions.where("acquires and releases").join(owners, "file").groupBy("krate").agg(F.count("*").alias("functions"))
    return pairs.join(guarded, "krate", "left_anti")


def mixed_cores(functions: DataFrame, complexity: DataFrame) -> DataFrame:
    """file, name, cyclomatic: functions that are complex and do input or output. complexity: file, name, cyclomatic."""
    return functions.where("io").join(complexity.where(F.col("cyclomatic") >= COMPLEX), ["file", "name"]).select("file", "name", "cyclomatic")


def effects(functions: DataFrame, complexity: DataFrame, declared: DataFrame) -> DataFrame:
    """file, place, name, mask of the public items of each file: functions with their effects, and structs, enums and traits, which have none.

    complexity: file, name, cyclomatic. declared: file, line, kind, name, public, as items.item_table() gives it.
    """
    flag = lambda c, bit: F.when(c, bit).otherwise(0)
    rows = functions.where("public").join(complexity.groupBy("file", "name").agg(F.max("cyclomatic").alias("cyclomatic")), ["file", "name"], "left")
    mask = flag(F.col("io"), IO) + flag(F.col("output"), OUTPUT) + flag(F.col("cyclomatic") >= COMPLEX, COMPUTES)
    others = declared.where("public and kind in ('struct', 'enum', 'trait')").select("file", F.col("line").alias("place"), "name", F.lit(0).alias("mask"))
    return rows.select("file", F.col("line").alias("place"), "name", mask.alias("mask")).unionByName(others)


def incohesive_files(effects: DataFrame) -> DataFrame:
    """file, items, first, second: files of SEVERAL_ITEMS public items or more of which two differ in effects, and the first such pair.

    effects: file, place (of the item in the file), name, mask (bits of IO, OUTPUT and COMPUTES, 0: none). Two items with effects differ unless both have one and the same. If any pair differs, one does with the
    first item that has an effect: so the first pair is that item and the next that differs from it, and no items are joined with one another.
    """
    own = F.when(F.col("mask") != 0, F.struct("place", "name", "mask"))
    rows = effects.groupBy("file").agg(F.count("*").alias("items"), F.min(own).alias("a")).where(F.col("items") >= SEVERAL_ITEMS)
    after = effects.join(rows, "file").where((F.col("mask") != 0) & (F.struct("place", "name") > F.struct("a.place", "a.name")))
    differs = ~F.col("a.mask").isin(IO, OUTPUT, COMPUTES) | (F.col("mask") != F.col("a.mask"))
    found = after.where(differs).groupBy("file").agg(F.first("items").alias("items"), F.first("a").alias("a"), F.min(F.struct("place", "name")).alias("b"))
    return found.select("file", "items", F.col("a.name").alias("first"), F.col("b.name").alias("second"))


def stringly_boundaries(findings: DataFrame, errors: DataFrame, owners: DataFrame) -> DataFrame:
    """krate, findings: crates with two catch-all errors or more that have an error type of their own. findings: file, rule. errors: file."""
    typed = errors.join(owners, "file").select("krate").distinct()
    rows = findings.where("rule = 'catch-all-error'").join(owners, "file").groupBy("krate").agg(F.count("*").alias("findings")).where("findings >= 2")
    return rows.join(typed, "krate", "left_semi")


def dependency_inversions(violations: DataFrame, exposed: DataFrame, modules: DataFrame, rules: DataFrame) -> DataFrame:
    """rule, violations, leaks: module boundaries that are crossed, and whose forbidden modules are named in public signatures of the modules that they hold for.

    violations: rule. exposed: file, name, path. modules: file, module. rules: name, below, forbidden (one row a forbidden module), a configuration, whose rows become one expression."""
    asked = sorted({tuple(r) for r in rules.select("name", "below", "forbidden").collect()})
    under = lambda c, p: (F.col(c) == p) | F.col(c).startswith(p + "::")
    hits = F.array_distinct(F.array_compact(F.array(*(F.when(under("module", below) & under("path", forbidden), F.lit(name)) for name, below, forbidden in asked), F.lit(None).cast("string"))))
    leaks = exposed.join(modules, "file").select(F.explode(hits).alias("rule")).groupBy("rule").agg(F.count("*").alias("leaks"))
    return violations.groupBy("rule").agg(F.count("*").alias("violations")).join(leaks, "rule")
