"""One stream of the findings of all detectors that have a query, with locations and evidence.

Importing this module adds its queries to the catalogue.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import findings
from . import clone_queries, graph_queries, rule_queries, source_queries  # noqa: F401
from .catalogue import ORACLES, QUERIES, query
from .rules import RULES


@dataclass(frozen=True)
class Detector:
    """A query whose rows are findings. rule: a rule, or a column in braces. key, item and evidence: columns. file: a column, or a name in quotes. line and severity: columns or none."""

    query: str
    rule: str
    key: tuple[str, ...]
    file: str
    line: str = ""
    item: str = ""
    evidence: tuple[str, ...] = ()
    severity: str = ""
    where: str = "true"


LOCK, MANIFEST = "'Cargo.lock'", "'Cargo.toml'"
DETECTORS = (
    Detector("hotspot_top15", "hotspot", ("file",), "file", evidence=("commits",)),
    Detector("churn_hotspot_window", "churn-hotspot", ("file",), "file", evidence=("commits",)),
    Detector("legacy_freeze_siblings", "legacy-freeze", ("file",), "file", evidence=("active_siblings",)),
    Detector("size_distribution_outliers", "size-distribution", ("file",), "file", evidence=("size",)),
    Detector("low_bus_factor_severity", "low-bus-factor", ("file",), "file", evidence=("author",), severity="severity"),
    Detector("ownership_fragmentation", "ownership-fragmentation", ("file",), "file", evidence=("authors", "lines")),
    Detector("complexity_inflation", "complexity-inflation", ("file",), "file", evidence=("lines_of_code", "cyclomatic")),
    Detector("change_coupling", "change-coupling-signal", ("a", "b"), MANIFEST, evidence=("together",)),
    Detector("layer_rules_direct", "crate-boundary-violation", ("src", "dst"), MANIFEST, evidence=("src_layer", "dst_layer")),
    Detector("graph_cycles_bounded", "dependency-cycle", ("cycle",), MANIFEST, item="cycle", evidence=("length",)),
    Detector("duplicate_versions", "duplicate-crate-versions", ("name",), LOCK, item="name", evidence=("found",)),
    Detector("requirement_drift", "workspace-dep-drift", ("name",), MANIFEST, item="name", evidence=("n",)),
    Detector("unused_in_every_target", "unused-dependency", ("name",), MANIFEST, item="name"),
    Detector("single_maintainer", "dep-single-maintainer", ("name",), LOCK, item="name", evidence=("owners",)),
    Detector("phantom_antijoin", "phantom-crate", ("name",), MANIFEST, item="name"),
    Detector("yanked_versions", "yanked-dependency", ("name", "vers"), LOCK, item="name", evidence=("vers",)),
    Detector("fresh_low_reputation", "fresh-low-reputation-dep", ("name",), MANIFEST, item="name"),
    Detector("single_member_groups", "abstraction-inflation", ("trait",), "trait", item="trait", evidence=("type",)),
    Detector("untested_hotspot_range_join", "untested-hotspot", ("file", "name"), "file", item="name", evidence=("cyclomatic", "churn")),
    Detector("advisory_reachability", "known-vulnerability", ("id",), LOCK, item="name", evidence=("state",), severity="severity"),
    Detector("secret_patterns_entropy", "hardcoded-secret", ("id",), "id", item="name", evidence=("lane",)),
    Detector("conversational_phrases", "conversational-artifact", ("doc_id", "phrase"), "doc_id", evidence=("phrase", "tier")),
    Detector("restating_jaccard", "restating-comment", ("doc", "line"), "doc", "line"),
    Detector("step_chain_islands", "step-comment-inflation", ("file", "first_line"), "file", "first_line", item="item", evidence=("length", "lines")),
    Detector("name_collision_levenshtein", "name-collision-risk", ("name",), MANIFEST, item="name", evidence=("nearest",)),
    Detector("phantom_version", "phantom-version", ("krate", "name"), MANIFEST, item="name"),
    Detector("dependency_findings", "{rule}", ("krate", "name", "feature"), MANIFEST, item="name"),
    Detector("unused_features", "unused-feature", ("krate", "feature"), MANIFEST, item="feature"),
    Detector("heavy_dependency", "heavy-dependency", ("krate", "name"), MANIFEST, item="name", evidence=("transitive", "used")),
    Detector("msrv_drift", "msrv-drift", ("name",), MANIFEST, item="name"),
    Detector("module_boundary_violation", "module-boundary-violation", ("rule", "file"), "file", "line", evidence=("rule", "forbidden")),
    Detector("unlinked_files", "unlinked-file", ("file",), "file"),
    Detector("orphan_modules", "orphan-module", ("krate", "module"), "module", item="module"),
    Detector("connectivity_drop", "connectivity-drop", ("target",), "target"),
    Detector("re_export_chains", "re-export-chain", ("use",), "use", evidence=("hops", "status"), where="hops >= 2"),
    Detector("dead_enum_variants", "dead-enum-variant", ("file", "name"), "file", "line", item="name"),
    Detector("syntactic_findings", "{rule}", ("file", "line"), "file", "line"),
    Detector("craft_findings", "{rule}", ("file", "line"), "file", "line", item="item"),
    Detector("clone_families_outside_ranges", "duplicate-code", ("family", "id", "start"), "id", evidence=("length", "members")),
    Detector("dependencies_added_unreferenced", "dep-added-by-agent", ("commit_id", "name"), MANIFEST, item="name"),
)


def _text(name: str):
    return F.lit(name[1:-1]) if name.startswith("'") else F.col(name)


def stream(spark: SparkSession, d: str) -> DataFrame:
    """The findings of every detector, in the schema of reports; an id stands once."""
    parts = []
    for x in DETECTORS:
        rows = QUERIES[x.query](spark, d).where(x.where)
        rule = F.col(x.rule[1:-1]) if x.rule.startswith("{") else x.rule
        parts.append(findings.reported(rows, rule, list(x.key), _text(x.file), F.col(x.line) if x.line else None, F.col(x.item) if x.item else None, x.evidence, F.col(x.severity) if x.severity else None))
    return findings.all_of(parts)


def _sql(x: Detector) -> str:
    rule = x.rule[1:-1] if x.rule.startswith("{") else f"'{x.rule}'"
    of = lambda i: f"CASE {rule} " + " ".join(f"WHEN '{r[0]}' THEN '{r[i]}'" for r in RULES if r[i]) + " END" if x.rule.startswith("{") else f"'{next(r[i] for r in RULES if r[0] == x.rule)}'"
    evidence = "json_object(" + ", ".join(f"'{c}', {c}" for c in x.evidence) + ")::VARCHAR" if x.evidence else "NULL"
    file = x.file if x.file.startswith("'") else f"{x.file}::VARCHAR"
    return f"""SELECT concat_ws(':', {rule}, {", ".join(f'"{k}"::VARCHAR' for k in x.key)}) AS id, {rule} AS rule, {x.severity or of(1)} AS severity, {of(2)} AS evidence_class, {file} AS file,
 {x.line or 1}::INTEGER AS line, {x.item + "::VARCHAR" if x.item else "NULL"} AS item_path, {evidence} AS evidence FROM ({ORACLES[x.query]}) WHERE {x.where}"""


_STREAM = " UNION ALL ".join(map(_sql, DETECTORS))


@query(f"SELECT DISTINCT ON (id) * FROM ({_STREAM})")
def combined_report(spark, d):
    """Findings of some fifty detectors with their places and evidence."""
    return stream(spark, d).select("id", "rule", "severity", "evidence_class", "location.file", "location.line", "location.item_path", "evidence")


@query(f"SELECT rule, severity, count(DISTINCT id) AS findings FROM ({_STREAM}) GROUP BY 1, 2")
def findings_by_detector(spark, d):
    return stream(spark, d).groupBy("rule", "severity").agg(F.count("*").alias("findings"))
