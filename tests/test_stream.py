"""The stream's schema: written as a baseline and read back, with causes."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import items, signatures, syntax_rules
from factloom.operators import findings, flow, patterns
from factloom.plans import rules, stream_queries
from factloom.sources import readers, writers


def test_detectors_name_rules():
    known = {r for r, *_ in rules.RULES}
    named = {x.rule for x in stream_queries.DETECTORS if not x.rule.startswith("{")}
    assert named <= known and len(named) == sum(not x.rule.startswith("{") for x in stream_queries.DETECTORS) >= 36


def test_reports_are_read_back(spark, tmp_path):
    rows = spark.createDataFrame([("a.rs", 3, "f", 7), ("b.rs", None, None, None)], "file string, line int, item string, n int")
    found = findings.reported(rows, "panic-in-lib", ["file", "line"], F.col("file"), F.col("line"), F.col("item"), ("n",)).unionByName(findings.reported(rows, F.lit("phantom-crate"), ["file"], F.lit("Cargo.toml")))
    edges = spark.createDataFrame([("phantom-crate:a.rs", "panic-in-lib:a.rs:3"), ("phantom-crate:a.rs", "panic-in-lib:a.rs:3"), ("phantom-crate:a.rs", "panic-in-lib:b.rs")], "cause string, effect string")
    assert flow.graph_errors(found.select("id"), edges).collect() == [("duplicate_edge", "phantom-crate:a.rs -> panic-in-lib:a.rs:3", "2")]
    whole = findings.with_causes(found, edges)
    writers.save_baseline(whole, str(tmp_path / "b"))
    back = {r["id"]: r for r in readers.baseline(spark, str(tmp_path / "b")).collect()}
    assert set(back) == {"panic-in-lib:a.rs:3", "panic-in-lib:b.rs", "phantom-crate:a.rs", "phantom-crate:b.rs"}
    one = back["panic-in-lib:a.rs:3"]
    assert tuple(one["location"]) == ("a.rs", 3, "f") and one["evidence"] == '{"n":7}' and one["origin"] == "code" and one["caused_by"] == ["phantom-crate:a.rs"] and one["causes"] == []
    assert back["phantom-crate:a.rs"]["causes"] == ["panic-in-lib:a.rs:3", "panic-in-lib:b.rs"] and back["phantom-crate:a.rs"]["severity"] == "Fail" and back["phantom-crate:a.rs"]["evidence_class"] == "external_measurement"
    assert back["phantom-crate:b.rs"]["location"]["line"] == 1 and back["phantom-crate:b.rs"]["evidence"] is None


SOURCE = """
pub fn age(mut age: u8, name: &str, map: HashMap<String, u8>, (a, b): (u8, u8)) -> Result<Self, Error> where X: Y { if let Some(x) = age && name.len() > 1 { return Err(e); } assert!(name != "", map); x }
impl Config { pub fn new(lo: u8, hi: u8) -> std::result::Result<Self, E> { if lo > hi { if x { panic!(); } } match (lo, self.hi) { _ => {} } lo } }
fn effects(p: P) { std::fs::read(p); p.flush(); write!(io::stdout(), p); a::lock(x); y.unlock(); }
fn none(p: P) { fs::read(p); log!(std::fs::read(p)); read_line(p); write!(buf, p); lock; x.println; if !(a) { } }
pub struct Open { pub a: u8, b: u8, pub c: Vec<u8> }
#[non_exhaustive] pub struct Closed { pub a: u8, pub b: u8 }
impl<T> Drop for Guard<T> { fn drop(&mut self) {} }
"""


def test_signatures():
    f = items.Facts(SOURCE)
    rows = {r[1]: r for r in signatures._functions(f)}
    assert [(p["name"], p["type"]) for p in rows["age"][3]] == [("age", "u8"), ("name", "&str"), ("map", "HashMap<String,u8>")]
    assert rows["age"][5] == [["age", "name"], ["map", "name"]] and rows["age"][4] is None
    assert rows["Config::new"][4] == "Config" and rows["Config::new"][5] == [["hi", "lo"]] and rows["Config::new"][6] == [["hi", "lo"], ["lo"]]
    assert rows["effects"][7:] == (True, True, True, True) and rows["none"][7:] == (False, False, False, False)
    assert [(r[1], r[3], r[4]) for r in signatures._structs(f)] == [("Open", False, ["a", "c"]), ("Closed", True, ["a", "b"])] and f.drops


def brute_pair(masks):
    """The first two places whose effects differ: some effect of one isn't some effect of the other."""
    bits = lambda m: [b for b in (1, 2, 4) if m & b]
    for i in range(len(masks)):
        for j in range(i + 1, len(masks)):
            if any(x != y for x in bits(masks[i]) for y in bits(masks[j])):
                return i, j
    return None


def test_first_differing_pair(spark):
    from itertools import product

    files = {f"f{n}": m for n, m in enumerate(product(range(8), repeat=3))} | {"two": (1, 2), "none": (0, 0, 0)}
    rows = [(f, i, f"i{i}", m) for f, masks in files.items() for i, m in enumerate(masks)]
    got = {r["file"]: (r["items"], r["first"], r["second"]) for r in patterns.incohesive_files(spark.createDataFrame(rows, "file string, place int, name string, mask int")).collect()}
    want = {f: (3, f"i{p[0]}", f"i{p[1]}") for f, masks in files.items() if len(masks) == 3 and (p := brute_pair(masks))}
    assert got == want


CRAFT = [
    ("pub fn a() -> Result<(), Box<dyn Error>> { x.map_err(|_| E) }", {"catch-all-error"}),
    ("pub fn a() -> Result<(), Box<dyn std::error::Error + Send + 'static>> { x.map_err(move |_: io::Error| E) }", {"catch-all-error"}),
    ("pub fn a() -> anyhow::Result<Vec<u8>> { if y { x.map_err(|_| E)?; } }", {"catch-all-error"}),
    ("pub fn a() -> Option<Result<u8, anyhow::Error>> { x.map_err(|_| E) }", {"catch-all-error"}),
    ("pub fn a() -> Result<(), Box<dyn Display>> { x.map_err(|_| E) }", set()),
    ("pub fn a() -> Result<(), Known> { x.map_err(|_| E) }", set()),
    ("pub fn a() -> Result<(), Box<dyn Error>> { x.map_err(|e| E(e)) }", set()),
    ("pub fn a() -> Result<(), Box<dyn Error>> { fn b() { x.map_err(|_| E) } b() }", set()),
    ("pub(crate) fn a() -> Result<(), Box<dyn Error>> { x.map_err(|_| E) }", set()),
    ("trait T { fn a() -> anyhow::Result<()> { x.map_err(|_| E) } }", set()),
    ("/// Starts it.\nfn go() { /* later */ }", {"empty-impl"}),
    ("/** Starts it. */ #[inline] fn go() { }", {"empty-impl"}),
    ("trait T { /// Does it.\n fn go(&self) {} }", {"empty-impl"}),
    ("// Starts it.\nfn go() { }", set()),
    ("//// Starts it.\nfn go() { }", set()),
    ("/// Starts it.\nfn go() { () }", set()),
    ("/// Returns the Config.\nfn load() -> a::Config<u8> { x }", {"doc-restates-signature"}),
    ("/// Get the user of the id.\nfn user(&self, id: UserId) { x }", {"doc-restates-signature"}),
    ("/// Get the user of the id.\nfn user(&self, id: UserId, n: u8) { x }", set()),
    ("/// Returns the parsed Config.\nfn load() -> Config { x }", set()),
    ("/// Returns the Config of the Config of Config.\nfn load() -> Config { x }", set()),
    ("/// the a\nfn load() -> Config { x }", set()),
    ("fn k() { if s.contains(\"a\") { } else if t { } }", {"fragile-substring-classification"}),
    ("fn k() { if t { } else if !s.contains(\"a\") && u { } else { } }", {"fragile-substring-classification"}),
    ("fn k() { if s.contains(\"a\") { } else { } }", set()),
    ("fn k() { if s.contains('a') { } else if s.contains(x) { } else if s.contains(\"a\", 1) { } }", set()),
    ("fn k() { if s.contains(\"a\") && s == \"ab\" { } else if t { } }", set()),
    ("fn k() { if s.split_whitespace().any(|w| w.contains(\"a\")) { } else if t { } }", set()),
    ("fn k() { match s { x if x.contains(\"a\") => { } _ => { } } }", set()),
    ("fn k() { m!(if s.contains(\"a\") { } else if t { }); }", set()),
]


def test_craft_rules():
    for source, want in CRAFT:
        assert {rule for _, rule, _, _ in syntax_rules.rules(items.Facts(source))} == want, source


def test_error_types_and_exposed_paths(spark):
    source = """enum LoadError { A } #[derive(Debug, thiserror::Error)] pub struct Failed; mod m { impl<T> std::error::Error for Bad<T> {} } struct ErrorLog; #[derive(ErrorKind)] struct X; impl Error { }
pub fn a(x: &crate::infra::db::Pool<crate::b::C>, y: u8) -> Vec<crate::d::E> { crate::f::G } fn b(x: crate::h::I) {} pub fn c(x: other::crate_::J) {}"""
    f = items.Facts(source)
    assert [n for _, n in f.errors] == ["LoadError", "Failed", "m::Bad"]
    assert [(n, p) for _, n, p in signatures._exposed(f)] == [("a", "b::C"), ("a", "d::E"), ("a", "infra::db::Pool")]
    exposed = spark.createDataFrame([("f", "a", "infra::db::Pool"), ("g", "a", "infra::dbx::Pool"), ("h", "a", "infra::db")], "file string, name string, path string")
    modules = spark.createDataFrame([("f", "domain::x"), ("g", "domain"), ("h", "domainx")], "file string, module string")
    rules = spark.createDataFrame([("r", "domain", "infra::db"), ("s", "domain", "infra")], "name string, below string, forbidden string")
    violations = spark.createDataFrame([("r",), ("r",), ("t",)], "rule string")
    assert [tuple(r) for r in patterns.dependency_inversions(violations, exposed, modules, rules).collect()] == [("r", 2, 1)]
    assert patterns.dependency_inversions(violations, exposed, modules, rules.where("false")).collect() == []
