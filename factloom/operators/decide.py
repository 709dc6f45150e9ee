"""The decision layer over findings: classes, delta, verdicts, gates, score, trend, suppression, cascades.

Evidence class decides gating, severity does not; unknown stays null; new or known is told by rule revision.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Severities in order, and the weights that they deduct.
SEVERITIES = ("Info", "Warn", "Fail")
WEIGHTS = {"Fail": 10, "Warn": 3}
#: Least scores of the grades; below is F.
GRADES = ((90, "A"), (80, "B"), (70, "C"), (60, "D"))
#: Evidence classes; all but the last gate.
CLASSES = ("derived_fact", "bounded_semantic", "external_measurement", "heuristic")


def gates(evidence_class: str = "evidence_class") -> Column:
    return F.col(evidence_class) != "heuristic"


def severity_rank(severity: str = "severity") -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col(severity))


def delta(current: DataFrame, baseline: DataFrame, touched: DataFrame, revisions: DataFrame) -> DataFrame:
    """id, rule, severity, evidence_class, state of every finding of either side.

    unchanged: known, at the same rule revision. rule_introduced: the rule's revision changed and the file
    was not touched. code_introduced: any other current one. resolved: known and gone.
    revisions: rule, before, after; before is null for a rule that the baseline doesn't know.
    """
    old = baseline.select(F.col("id").alias("old_id"), F.col("rule").alias("old_rule"), F.col("severity").alias("old_severity"), F.col("evidence_class").alias("old_class"))
    both = current.join(old, current["id"] == old["old_id"], "full_outer")
    both = both.join(touched.select(F.col("file"), F.lit(True).alias("was_touched")).distinct(), "file", "left")
    both = both.join(revisions, "rule", "left").withColumn("same", F.col("before").eqNullSafe(F.col("after")))
    state = (
        F.when(F.col("id").isNull(), "resolved")
        .when(F.col("old_id").isNotNull() & F.col("same"), "unchanged")
        .when(~F.col("same") & F.col("before").isNotNull() & F.col("was_touched").isNull(), "rule_introduced")
        .otherwise("code_introduced")
    )
    return both.select(F.coalesce("id", "old_id").alias("id"), F.coalesce("rule", "old_rule").alias("rule"), F.coalesce("severity", "old_severity").alias("severity"), F.coalesce("evidence_class", "old_class").alias("evidence_class"), state.alias("state"))


def verdicts(changes: DataFrame) -> DataFrame:
    """One row: verdict (pass or fail) and tri_verdict (pass, warn, fail) over gating, code-introduced findings."""
    new = F.when((F.col("state") == "code_introduced") & gates(), severity_rank())
    top = changes.agg(F.coalesce(F.max(new), F.lit(1)).alias("worst"), F.count_if(new.isNotNull()).alias("gating_new"))
    return top.select("gating_new", F.when(F.col("worst") > 1, "fail").otherwise("pass").alias("verdict"), F.element_at(F.array(F.lit("pass"), F.lit("warn"), F.lit("fail")), F.col("worst").cast("int")).alias("tri_verdict"))


def ratio_gate(rows: DataFrame, numerator: str, sample: str, least: int, most: float) -> DataFrame:
    """rows with gate: not_evaluated_small_sample, fail (ratio strictly over the limit) or pass."""
    small = (F.col(sample) == 0) | (F.col(sample) < least)
    return rows.withColumn("gate", F.when(small, "not_evaluated_small_sample").when(F.col(numerator) / F.col(sample) > most, "fail").otherwise("pass"))


def health_score(findings: DataFrame, loc: DataFrame, multipliers: DataFrame | None = None) -> DataFrame:
    """One row by grp: fails, warns, score (null without lines) and grade.

    score = 100 - deduction per 1000 lines, within 0 and 100; a group without a profile multiplies by 1.
    """
    rows = findings.where(gates()).join(multipliers, "grp", "left") if multipliers is not None else findings.where(gates()).withColumn("multiplier", F.lit(1.0))
    weight = F.when(F.col("severity") == "Fail", WEIGHTS["Fail"]).when(F.col("severity") == "Warn", WEIGHTS["Warn"]).otherwise(0)
    sums = rows.groupBy("grp").agg(F.count_if(F.col("severity") == "Fail").alias("fails"), F.count_if(F.col("severity") == "Warn").alias("warns"), F.sum(weight * F.coalesce("multiplier", F.lit(1.0))).alias("deduction"))
    all_ = loc.join(sums, "grp", "left").withColumns({"fails": F.coalesce("fails", F.lit(0)), "warns": F.coalesce("warns", F.lit(0)), "deduction": F.coalesce("deduction", F.lit(0.0))})
    score = F.when(F.col("loc") > 0, F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 - F.col("deduction") * 1000 / F.col("loc"))))
    grade = F.when(F.col("score").isNull(), "unavailable")
    for least, letter in GRADES:
        grade = grade.when(F.col("score") >= least, letter)
    return all_.withColumn("score", F.round(score, 4)).select("grp", "fails", "warns", "score", grade.otherwise("F").alias("grade"))


def trend(now: DataFrame, before: DataFrame, formula: int = 2) -> DataFrame:
    """grp, state, change (null unless comparable).

    before: grp, score, formula_version, same_profiles, loc. State: comparable, or the first reason against it: missing_score_context (the baseline has no formula
    version), formula_version_changed, profiles_changed, baseline_loc_unavailable.
    """
    b = before.select("grp", F.col("score").alias("old"), "formula_version", "same_profiles", "loc")
    rows = now.join(b, "grp", "left")
    state = (
        F.when(F.col("formula_version").isNull(), "missing_score_context")
        .when(F.col("formula_version") != formula, "formula_version_changed")
        .when(~F.coalesce("same_profiles", F.lit(False)), "profiles_changed")
        .when(F.coalesce("loc", F.lit(0)) == 0, "baseline_loc_unavailable")
        .otherwise("comparable")
    )
    return rows.select("grp", state.alias("state"), F.round(F.when(state == "comparable", F.col("score") - F.col("old")), 4).alias("change"))


def combined_verdict(verdict: str, gates_: str) -> Column:
    """The three-state verdict and an array of gate results in one: a failed gate fails, one with a small sample says nothing."""
    return F.when((F.col(verdict) == "fail") | F.array_contains(gates_, "fail"), "fail").otherwise(F.col(verdict))


def exit_code(verdict: str, errors: str) -> Column:
    """0 clean, 1 the verdict failed, 2 a real error."""
    return F.when(F.col(errors) > 0, 2).when(F.col(verdict) == "fail", 1).otherwise(0)


def outside_ranges(rows: DataFrame, ranges: DataFrame, bin_width: int = 64) -> DataFrame:
    """rows (file, line) not within a range (file, from_line, to_line) of the same file: a binned range anti join."""
    spread = ranges.withColumn("bin", F.explode(F.sequence(F.floor(F.col("from_line") / bin_width), F.floor(F.col("to_line") / bin_width))))
    r = rows.withColumn("bin", F.floor(F.col("line") / bin_width))
    on = (r["file"] == spread["file"]) & (r["bin"] == spread["bin"]) & r["line"].between(spread["from_line"], spread["to_line"])
    return r.join(spread, on, "left_anti").drop("bin")


def innermost(points: DataFrame, spans: DataFrame, bin_width: int = 64) -> DataFrame:
    """Each point (file, line) with the item of the smallest enclosing span (file, from_line, to_line, item), or null."""
    spread = spans.withColumn("bin", F.explode(F.sequence(F.floor(F.col("from_line") / bin_width), F.floor(F.col("to_line") / bin_width))))
    p = points.select("file", "line").distinct().withColumn("bin", F.floor(F.col("line") / bin_width))
    hit = p.join(spread, ["file", "bin"]).where("line between from_line and to_line")
    best = hit.groupBy("file", "line").agg(F.min_by("item", F.struct(F.col("to_line") - F.col("from_line"), "item")).alias("item"))
    return points.join(best, ["file", "line"], "left")


def roots_and_cascades(findings: DataFrame, edges: DataFrame) -> DataFrame:
    """findings with is_root, causes and caused_by (sorted, comma-joined). edges: cause, effect."""
    up = edges.groupBy(F.col("effect").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("cause")), ",").alias("caused_by"))
    down = edges.groupBy(F.col("cause").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("effect")), ",").alias("causes"))
    return findings.join(up, "id", "left").join(down, "id", "left").withColumn("is_root", F.col("caused_by").isNull())


def first_match(rows: DataFrame, rules: DataFrame, matches: Column, key: str) -> DataFrame:
    """Each row's first rule in configured order that matches, or null. rules (ord, label, ...) is a configuration of bounded size."""
    hit = rows.join(F.broadcast(rules), matches).groupBy(key).agg(F.min_by("label", "ord").alias("label"))
    return rows.join(hit, key, "left")
