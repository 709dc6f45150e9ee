from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from factloom.functions import names, rust_source
from factloom.operators import boundaries, decide, graphs, history, manifests, registry
from factloom.plans import catalogue, clone_queries, graph_queries, rule_queries, source_queries, stream_queries, rules  # noqa: F401
from factloom.sources import readers, writers
from factloom.streaming.findings import churn_windows
from tests.oracle import compare

DATA = "/root/testdata/sf0.001"
FAST = list(catalogue.ORACLES)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", FAST)
def test_oracle(spark, name):
    got, want, differ = compare(spark, DATA, catalogue.QUERIES[name], catalogue.ORACLES[name])
    assert (got, differ) == (want, [])


def test_registry():
    assert len(rules.RULES) == 74 and len({r[0] for r in rules.RULES}) == 74


RUST = '''//! demo
/// Adds.
pub fn add(a: u32, b: u32) -> u32 {
    if a > 1 && b > 1 { return 0; }
    match a { 0 => 1, 1 => 2, _ => a as u8 as u32 }
}
pub fn bare() { let x = "fn no() { }"; x.parse::<u8>().unwrap(); let _ = go(); }
// SAFETY: fine
fn f() { unsafe { g() } }
fn h() {

    unsafe { g() }
}
#[test]
fn empty() { let a = 1; }
'''


def test_rust_source():
    f = {r[0]: r for r in rust_source.functions(RUST)}
    assert set(f) == {"add", "bare", "f", "h", "empty"}
    assert f["add"][4] == 1 + 1 + 1 + 2 and f["add"][7:] == (3, 2) and f["add"][2]
    found = {(r, line) for line, r, _ in rust_source.findings(RUST)}
    assert {("panic-in-lib", 7), ("swallowed-result", 7), ("undocumented-public-item", 7), ("unsafe-surface", 12), ("assertion-free-test", 15)} <= found
    assert ("unsafe-surface", 9) not in found and ("undocumented-public-item", 3) not in found
    assert [c[3] for c in rust_source.comments(RUST)] == [True, True, False]


def test_rust_tables(spark):
    files = spark.createDataFrame([("a.rs", RUST), ("b.rs", None)], "file string, text string")
    assert rust_source.function_table(files).count() == 5 and rust_source.comment_table(files).count() == 3
    assert rust_source.finding_table(files).count() == len(list(rust_source.findings(RUST)))


def test_lcov_and_audit(spark, tmp_path):
    (tmp_path / "x.info").write_text("SF:./src/a.rs\nDA:1,2\nDA:1,0\nDA:bad\nDA:2,5\nend_of_record\nDA:9,9\nSF:/w/src/b.rs\nDA:3,1\n")
    rows = {(r.file, r.line): r.hits for r in readers.lcov(spark, str(tmp_path / "x.info"), "/w").collect()}
    assert rows == {("src/a.rs", 1): 0, ("src/a.rs", 2): 5, ("src/b.rs", 3): 1}
    (tmp_path / "a.json").write_text('{"vulnerabilities": {"list": [{"advisory": {"id": "R-1", "title": "t"}, "package": {"name": "p", "version": "1.0.0"}}, {"advisory": {}, "package": {"name": "q"}}]}}')
    assert [(r.id, r.name) for r in readers.audit(spark, str(tmp_path / "a.json")).collect()] == [("R-1", "p")]


def test_gate_and_verdict(spark):
    rows = spark.createDataFrame([(0, 0), (3, 5), (5, 10), (6, 10)], "n bigint, s bigint")
    assert [r.gate for r in decide.ratio_gate(rows, "n", "s", 10, 0.5).orderBy("s", "n").collect()] == ["not_evaluated_small_sample"] * 2 + ["pass", "fail"]
    ch = spark.createDataFrame([("a", "r", "Info", "derived_fact", "code_introduced"), ("b", "r", "Fail", "heuristic", "code_introduced")], "id string, rule string, severity string, evidence_class string, state string")
    assert decide.verdicts(ch).first().verdict == "pass"


def test_graph(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "d")], "src string, dst string")
    assert sorted(r.cycle for r in graphs.cycles(e, 4).collect()) == ["a,b,c", "d"]
    assert {r.node: r.reachable for r in graphs.closure_size(e).collect()} == {"a": 4, "b": 4, "c": 4, "d": 1}
    assert graphs.dot(e).first()[0].startswith("digraph {\n") and "a --> b" in graphs.mermaid(e).first()[0]


def test_single_author_and_unknown(spark):
    b = spark.createDataFrame([("f", "x", 10)], "file string, author string, lines bigint")
    r = history.bus_factor(b).first()
    assert (r.bus_factor, r.top_share) == (1, 1.0)
    assert history.low_bus_factor(b, b.select("author")).count() == 0
    adv = spark.createDataFrame([("1", "gone")], "id string, name string")
    none = spark.createDataFrame([], "name string")
    assert registry.advisory_state(adv, none, none).first().state == "unknown"


def test_writers(spark):
    f = spark.createDataFrame([("1", "hotspot", "Info", "heuristic", "a.rs", 3)], "id string, rule string, severity string, evidence_class string, file string, line int")
    assert '"level": "note"' in writers.sarif(f)
    assert '"rule":"hotspot"' in writers.report_lines(f).first()[0]


def test_stream(spark, tmp_path):
    src = spark.createDataFrame([("a", "2020-01-01 00:00:00"), ("a", "2020-01-02 00:00:00"), ("b", "2020-03-01 00:00:00")], "file string, ts string").selectExpr("file", "cast(ts as timestamp) ts")
    src.write.parquet(str(tmp_path / "in"))
    stream = churn_windows(spark.readStream.schema(src.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("churn").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.file, r.commits) for r in spark.table("churn").collect()] == [("a", 2)]


def test_source_tree(spark, tmp_path):
    for path, text in {"a/src/lib.rs": "fn a() {}", "a/target/x.rs": "", "a/.git/y.rs": "", "a/inner/src/lib.rs": "fn b() {}", "a/src/gen.rs": "// Code generated by x\n", "a/src/own.rs": "// code GENERATED BY hand\n"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    for m in ("a/Cargo.toml", "a/inner/Cargo.toml"):
        (tmp_path / m).write_text("[package]\n")
    got = {r.file.removeprefix(str(tmp_path)): r.kind for r in readers.source_files(spark, str(tmp_path / "a")).collect()}
    assert got == {"/a/src/lib.rs": "Authored", "/a/src/gen.rs": "Generated", "/a/src/own.rs": "Authored"}


def test_baselines(spark, tmp_path):
    f = spark.createDataFrame([("1", "hotspot", "Info", "heuristic"), ("2", "phantom-crate", "Fail", "external_measurement")], "id string, rule string, severity string, evidence_class string")
    writers.save_baseline(f, str(tmp_path / "b"))
    assert sorted((r.id, r.evidence_class) for r in readers.baseline(spark, str(tmp_path / "b")).collect()) == [("1", "heuristic"), ("2", "external_measurement")]
    (tmp_path / "old.json").write_text('{"schema_version": 1, "findings": [{"id": "a", "rule": "phantom-crate", "confidence": 0.9}, {"id": "b", "rule": "gone"}]}')
    assert sorted((r.id, r.evidence_class, r.schema_version) for r in readers.baseline(spark, str(tmp_path / "old.json")).collect()) == [("a", "external_measurement", 2), ("b", "heuristic", 2)]
    (tmp_path / "new.json").write_text('{"schema_version": 9, "findings": [{"id": "a", "rule": "r"}]}')
    assert readers.baseline(spark, str(tmp_path / "new.json")).count() == 0


def test_configuration(spark):
    c = readers.config_tables(
        spark,
        """
[[boundary]]
name = "core"
from = ["a"]
forbidden = ["b", "c"]
required = ["d"]
reach = "transitive"
[[module_boundary]]
name = "m"
from = "io"
forbidden = ["ui"]
[layers.assign]
a = "core"
b = "outer"
""",
    )
    assert sorted((r.src, r.dst, r.kind) for r in c["boundaries"].collect()) == [("a", "b", "forbidden"), ("a", "c", "forbidden"), ("a", "d", "required")]
    assert c["modules"].count() == 1 and c["assigned"].count() == 2 and c["profiles"].count() == 0
    edges = spark.createDataFrame([("a", "x"), ("x", "c")], "src string, dst string")
    found = boundaries.violations(edges, c["boundaries"]).collect()
    assert sorted((r.src, str(r.dst), str(r.path)) for r in found) == [("a", "None", "None"), ("a", "c", "a>x>c")]


def test_closures_are_no_operators():
    f = {r[0]: r[4] for r in rust_source.functions("fn a() { map(|| 1); g(move || 2); } fn b(x: bool, y: bool) -> bool { x || y && s == \"a\" || c }")}
    assert f == {"a": 1, "b": 4}


def test_requirements(spark):
    rows = [("1.2.3", "1.9.0", True), ("1.2.3", "2.0.0", False), ("0.2.3", "0.3.0", False), ("0.0.3", "0.0.4", False), ("~1.2", "1.2.9", True), ("~1", "1.9.9", True), ("=1.2", "1.2.7", True), ("> 1.2", "1.2.9", False)]
    rows += [("<=1.2", "1.2.9", True), ("*", "9.9.9", True), ("1.*", "1.4.0", True), (">=1.2, <1.5", "1.5.0", False), ("^0.0", "0.0.9", True), ("0", "0.9.0", True), ("not one", "1.0.0", None)]
    df = spark.createDataFrame(rows, "req string, ver string, met boolean").withColumn("v", names.version("ver")).withColumn("r", manifests.requirement_range("req"))
    key = manifests.version_key(F.col("v.major"), F.col("v.minor"), F.col("v.patch"))
    for r in df.select("req", "ver", "met", ((key >= F.col("r.low")) & (key < F.col("r.high"))).alias("got")).collect():
        assert r.got == r.met, r
