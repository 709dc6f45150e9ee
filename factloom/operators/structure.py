"""Rules on the shape of code: size against branching, fan-in, implementors, modules, coverage, size trends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graphs import reachable

#: A function of so many lines with so few branches is inflated; a function is complex, churned and uncovered from these on.
MIN_LINES, MAX_CYCLOMATIC = 40, 3
COMPLEX, CHURNED, UNCOVERED = 10, 5, 0.5
#: Traits that are derived, so that a single implementation says nothing.
DERIVABLE = ("Debug", "Clone", "Copy", "Default", "PartialEq", "Eq", "Hash", "PartialOrd", "Ord", "Display", "Serialize", "Deserialize", "FromStr")
BUILDER_FIELDS = 2


def complexity_inflation(functions: DataFrame) -> DataFrame:
    """Functions (lines_of_code, cyclomatic) of many lines and few branches."""
    return functions.where((F.col("lines_of_code") >= MIN_LINES) & (F.col("cyclomatic") <= MAX_CYCLOMATIC))


def fan_in(references: DataFrame) -> DataFrame:
    """target, fan_in: how many other files refer to it. references: target, target_file, file."""
    return references.where("file <> target_file").groupBy("target").agg(F.countDistinct("file").alias("fan_in"))


def unconnected(items: DataFrame, references: DataFrame) -> DataFrame:
    """Items (target) that no other file refers to."""
    return items.join(fan_in(references), "target", "left_anti")


def single_implementors(impls: DataFrame) -> DataFrame:
    """trait, type: traits of a single implementation, but for derivable ones. impls: trait, type."""
    one = impls.where(~F.col("trait").isin(*DERIVABLE)).groupBy("trait").agg(F.count("*").alias("n"), F.min("type").alias("type"))
    return one.where("n = 1").select("trait", "type")


def inflated_builders(builders: DataFrame, fields: DataFrame) -> DataFrame:
    """builder, target, fields: builders (builder, target) of types with two fields or fewer. fields: type, field."""
    n = fields.groupBy(F.col("type").alias("target")).agg(F.count("*").alias("fields"))
    return builders.join(n, "target").where(F.col("fields") <= BUILDER_FIELDS).select("builder", "target", "fields")


def unlinked_files(files: DataFrame, children: DataFrame, roots: DataFrame) -> DataFrame:
    """Files (file) that no module declaration (src, dst) leads to from a root (node)."""
    return files.join(reachable(children, roots).withColumnRenamed("node", "file"), "file", "left_anti")


def orphan_modules(modules: DataFrame, references: DataFrame, entries: DataFrame) -> DataFrame:
    """Modules that nothing outside of them refers to and that hold no entry point.

    modules: krate, module (path), file. references: krate, to (module path), file. A module's own files are those of its path or below it, so a reference
    counts for all modules above the one it names.
    """
    up = lambda c: F.transform(F.sequence(F.lit(1), F.size(F.split(c, "::"))), lambda i: F.array_join(F.slice(F.split(c, "::"), F.lit(1), i), "::"))
    within = modules.select("krate", "file", F.explode(up(F.col("module"))).alias("module"))
    asked = references.select("krate", "file", F.explode(up(F.col("to"))).alias("module")).distinct()
    outside = asked.join(within, ["krate", "module", "file"], "left_anti").select("krate", "module").distinct()
    held = entries.join(within, ["krate", "file"]).select("krate", "module").distinct()
    return modules.select("krate", "module").distinct().join(outside, ["krate", "module"], "left_anti").join(held, ["krate", "module"], "left_anti")


def size_trend(now: DataFrame, before: DataFrame) -> DataFrame:
    """krate, items, change: public items now, and how many more than before (null if it wasn't there)."""
    return now.join(before.select("krate", F.col("items").alias("old")), "krate", "left").select("krate", "items", (F.col("items") - F.col("old")).alias("change"))


def line_coverage(files: DataFrame, lines: DataFrame) -> DataFrame:
    """file, lines, covered, percent (null without lines). lines: file, line, hits."""
    rows = files.join(lines, "file", "left").groupBy("file").agg(F.count("line").alias("lines"), F.count_if(F.col("hits") > 0).alias("covered"))
    return rows.withColumn("percent", F.try_divide(100.0 * F.col("covered"), F.col("lines")))


def uncovered_files(files: DataFrame, lines: DataFrame) -> DataFrame:
    return files.join(lines, "file", "left_anti")


def untested_hotspots(functions: DataFrame, churn: DataFrame, lines: DataFrame, complex_: int = COMPLEX, churned: int = CHURNED, uncovered: float = UNCOVERED) -> DataFrame:
    """file, name, cyclomatic, churn, uncovered: complex functions of churned files most of whose lines no test runs.

    functions: file, name, cyclomatic, start_line, end_line. churn: file, churn. lines: file, line, hits. Without coverage of a file nothing is said.
    """
    rows = functions.where(F.col("cyclomatic") >= complex_).join(churn.where(F.col("churn") >= churned), "file").join(lines, "file").where("line between start_line and end_line")
    share = rows.groupBy("file", "name", "cyclomatic", "churn").agg((F.count_if(F.col("hits") == 0) / F.count("*")).alias("uncovered"))
    return share.where(F.col("uncovered") > uncovered)


def owner_by_prefix(files: DataFrame, roots: DataFrame, key: str) -> DataFrame:
    """Each file (path) with the longest root (root) that its path begins with, or null. Both have the column `key`, on which they meet."""
    best = files.join(roots, key).where(F.startswith("path", "root")).groupBy("path").agg(F.max_by("root", F.struct(F.length("root"), "root")).alias("owner"))
    return files.join(best, "path", "left")


def test_ratios(files: DataFrame, test_modules: DataFrame) -> DataFrame:
    """krate, production_loc, test_loc, ratio (null without production): lines of files (krate, file, lines, domain, kind) that are authored; those of the Dev domain are
    tests, as are the spans (file, from_line, to_line) of test modules in others."""
    inner = test_modules.groupBy("file").agg(F.sum(F.col("to_line") - F.col("from_line") + 1).alias("inner"))
    rows = files.where("kind = 'Authored'").join(inner, "file", "left")
    test = F.when(F.col("domain") == "Dev", F.col("lines")).otherwise(F.coalesce("inner", F.lit(0)))
    production = F.when(F.col("domain") == "Dev", 0).otherwise(F.greatest(F.col("lines") - F.coalesce("inner", F.lit(0)), F.lit(0)))
    sums = rows.groupBy("krate").agg(F.sum(production).alias("production_loc"), F.sum(test).alias("test_loc"))
    return sums.withColumn("ratio", F.try_divide("test_loc", "production_loc"))


#: Re-exports that a walk follows at most, and from how many on a chain is worth a finding.
MAX_HOPS, LONG_CHAIN = 5, 2


def re_export_chains(uses: DataFrame, items: DataFrame, most: int = MAX_HOPS) -> DataFrame:
    """use, hops, status of each public re-export: how many re-exports lie between it and the definition.

    uses: use, module, name, the path that it names. items: module, name, kind ("original", "re_export" or another), to_module, to_name, the first of each module and name counting.
    status: original; capped after `most` hops, which is then a floor and also ends a ring of re-exports; unclassified where the module or the item isn't known, and hops is null.
    """
    order = F.struct("kind", "to_module", "to_name")
    known = items.groupBy("module", "name").agg(F.min(order).alias("i")).select("module", "name", "i.*")
    at = uses.select("use", "module", "name", F.lit(1).alias("hops"), F.lit(None).cast("string").alias("status"))
    for hop in range(1, most):
        step = at.join(known, ["module", "name"], "left")
        on = F.col("status").isNull() & (F.col("kind") == "re_export")
        ended = F.when(F.col("kind") == "original", "original").when(F.col("kind") == "re_export", None).otherwise("unclassified")
        at = step.select(
            "use",
            F.when(on, F.col("to_module")).otherwise(F.col("module")).alias("module"),
            F.when(on, F.col("to_name")).otherwise(F.col("name")).alias("name"),
            F.when(on, hop + 1).otherwise(F.col("hops")).alias("hops"),
            F.coalesce("status", ended).alias("status"),
        )
    status = F.coalesce("status", F.lit("capped"))
    return at.select("use", F.when(status != "unclassified", F.col("hops")).alias("hops"), status.alias("status"))


def long_re_exports(chains: DataFrame) -> DataFrame:
    """Those worth a finding."""
    return chains.where(F.col("hops") >= LONG_CHAIN)


def dead_variants(variants: DataFrame, constructed: DataFrame, owners: DataFrame) -> DataFrame:
    """file, line, name of public variants that no file of their workspace constructs: matching against one is no construction.

    variants: file, line, name, variant, public. constructed: file, variant. owners: file, workspace. A variant counts as constructed where its own name stands, whatever enum it is of.
    """
    made = constructed.join(owners, "file").select("workspace", "variant").distinct()
    return variants.where("public").join(owners, "file").join(made, ["workspace", "variant"], "left_anti").select("file", "line", "name")


def used_items(paths: DataFrame, owners: DataFrame) -> DataFrame:
    """krate, dependency, items, dev_only: how many items of a dependency a crate's files name, and whether only its tests do. paths: file, first, second, in_test. owners: file, krate."""
    rows = paths.join(owners, "file")
    return rows.groupBy("krate", F.col("first").alias("dependency")).agg(F.countDistinct("second").alias("items"), F.bool_and("in_test").alias("dev_only"))
