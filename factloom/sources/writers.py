"""Writers: JSON and SARIF reports, Markdown deltas, baselines."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.decide import severity_rank

SCHEMA_VERSION = 2
LEVELS = {"Fail": "error", "Warn": "warning", "Info": "note"}


def report_lines(findings: DataFrame) -> DataFrame:
    """One JSON text for each finding (id, rule, severity, evidence_class, file, line), for a distributed sink."""
    return findings.select(F.to_json(F.struct("id", "rule", "severity", "evidence_class", "file", "line")).alias("value"))


def report(findings: DataFrame, errors: list[str]) -> str:
    """The whole report as one JSON text: schema version, findings and errors. It comes to the driver; for more use report_lines()."""
    rows = [json.loads(r[0]) for r in report_lines(findings).collect()]
    return json.dumps({"schema_version": SCHEMA_VERSION, "findings": rows, "errors": errors}, indent=2)


def save_baseline(findings: DataFrame, path: str) -> None:
    """One JSON text with schema version and findings, as readers.baseline() takes it. The findings are one array, made in one task."""
    rows = findings.agg(F.lit(SCHEMA_VERSION).alias("schema_version"), F.collect_list(F.struct(*findings.columns)).alias("findings"))
    rows.coalesce(1).write.mode("overwrite").json(path)


def sarif_results(findings: DataFrame) -> DataFrame:
    """One SARIF 2.1.0 result object for each finding."""
    level = F.element_at(F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv]), F.col("severity"))
    place = F.array(F.struct(F.struct(F.struct(F.translate("file", "\\", "/").alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine")).alias("region")).alias("physicalLocation")))
    return findings.select(F.to_json(F.struct(F.col("rule").alias("ruleId"), level.alias("level"), F.struct(F.col("rule").alias("text")).alias("message"), place.alias("locations"))).alias("value"))


def sarif(findings: DataFrame, name: str = "factloom") -> str:
    """A whole SARIF log. It is one JSON text, so its findings come to the driver; for more use sarif_results()."""
    used = sorted(r[0] for r in findings.select("rule").distinct().collect())
    results = sorted(r[0] for r in sarif_results(findings).collect())
    run = {"tool": {"driver": {"name": name, "rules": [{"id": r} for r in used]}}, "results": [json.loads(r) for r in results]}
    return json.dumps({"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [run]}, sort_keys=True)


def markdown_delta(changes: DataFrame, verdict: str, limit: int = 50, gates: dict[str, str] | None = None) -> str:
    """A pull-request comment: the gates, counts of each state and the first introduced findings."""
    counts = {r[0]: r[1] for r in changes.groupBy("state").count().collect()}
    top = changes.where("state = 'code_introduced'").orderBy(F.desc(severity_rank()), "rule", "id").limit(limit).collect()
    lines = [f"**Verdict: {verdict}**", "", *(f"- gate {g}: {v}" for g, v in (gates or {}).items()), "| state | findings |", "|-|-|", *(f"| {s} | {counts[s]} |" for s in sorted(counts)), ""]
    return "\n".join([*lines, *(f"- {r['severity']} `{r['rule']}` {r['id']}" for r in top)])
