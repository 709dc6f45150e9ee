"""Queries over source texts: each order is a file whose text is made of its columns, each customer a crate.

Importing this module adds them to the catalogue.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import items, rust_source, signatures, syntax_rules
from ..operators import patterns, structure
from .catalogue import query, t


def _files(spark: SparkSession, d: str, text: str) -> DataFrame:
    """file, text, krate; between § stand expressions of k and c, the order's and the customer's number."""
    parts = []
    for i, part in enumerate(text.split("§")):
        parts.append(F.expr(part).cast("string") if i % 2 else F.lit(part))
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))
    return o.select(F.col("k").cast("string").alias("file"), F.concat(*parts).alias("text"), F.col("c").alias("krate"))


_O = "o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderkey::VARCHAR AS file FROM orders)"


@query(f"""WITH {_O} SELECT file, 2 AS line, false AS public, 'dep' || c % 7 || '::self' AS path, NULL AS alias, false AS glob, false AS in_test FROM o
UNION ALL SELECT file, 2, false, 'dep' || c % 7 || '::a' || k % 5, 'b', false, false FROM o UNION ALL SELECT file, 2, false, 'dep' || c % 7 || '::x::y', NULL, false, false FROM o
UNION ALL SELECT file, 2, false, 'dep' || c % 7 || '::x', NULL, true, false FROM o UNION ALL SELECT file, 3, true, 'crate::m' || k % 3 || '::T', NULL, false, false FROM o
UNION ALL SELECT file, 4, false, 'super', NULL, true, true FROM o""")
def use_tree_leaves(spark, d):
    source = 'const S: &str = r#"use no::thing;"#; /* use nor::this; */\nuse dep§c % 7§::{self, a§k % 5§ as b, x::{y, *}};\npub use crate::m§k % 3§::T;\n#[cfg(all(test, unix))] mod t { use super::*; }\n'
    return items.use_table(_files(spark, d, source))


@query(f"""WITH {_O} SELECT file, 1 AS line, 'struct' AS kind, 'm::S' || k % 9 AS name, true AS public, false AS in_test FROM o UNION ALL SELECT file, 2, 'const', 'm::S' || k % 9 || '::N', true, false FROM o
UNION ALL SELECT file, 2, 'type', 'm::S' || k % 9 || '::Out', false, false FROM o UNION ALL SELECT file, 2, 'fn', 'm::S' || k % 9 || '::go', false, false FROM o UNION ALL SELECT file, 3, 'trait', 'T' || c % 4, true, false FROM o
UNION ALL SELECT file, 3, 'fn', 'T' || c % 4 || '::has', false, false FROM o UNION ALL SELECT file, 4, 'fn', 't::works', false, true FROM o UNION ALL SELECT file, 5, 'static', 'G', false, false FROM o UNION ALL SELECT file, 5, 'enum', 'E' || c % 3, false, false FROM o""")
def item_facts(spark, d):
    source = (
        "pub mod m { pub struct S§k % 9§<T> where T: Fn() -> u8 { a: T }\nimpl<T> Iterator for S§k % 9§<T> { pub const N: u8 = 1; type Out = u8; fn go(&self) { make!(struct Z;); } } }\n"
        "pub trait T§c % 4§ { const K: u8; fn has(&self) {} fn not(&self); }\n#[cfg(test)] mod t { #[test] fn works() {} }\nstatic G: u8 = 1; pub(crate) enum E§c % 3§ { A }\n"
    )
    return items.item_table(_files(spark, d, source))


@query(f"""WITH {_O}, v AS (SELECT file, c, 'A' || k % 3 AS v, 'E' || k % 4 || '::A' || k % 3 AS name FROM o UNION ALL SELECT file, c, 'B' || k % 5, 'E' || k % 4 || '::B' || k % 5 FROM o),
m AS (SELECT c, 'B' || (k + 2) % 5 AS v FROM o UNION SELECT c, 'A' || k % 2 FROM o WHERE c % 2 = 0)
SELECT file, 1 AS line, name FROM v WHERE (c, v) NOT IN (SELECT c, v FROM m)""")
def dead_enum_variants(spark, d):
    """Variants of a crate that are matched and stand in macros and comments, but of which only some are constructed."""
    source = "pub enum E§k % 4§ { A§k % 3§, B§k % 5§(u8) }\nfn f(v: E) -> E { match v { E::A§k % 3§ if x == E::B§(k + 2) % 5§(1) => log!(E::A0), E::A1 | E::A2 => {} /* E::A0 */ _ => §if(c % 2 = 0, concat('E::A', k % 2), '()')§ } }\n"
    files = _files(spark, d, source)
    variants, constructed = items.tables(files, items.VARIANT_ROWS, items.CONSTRUCTED_ROWS)
    return structure.dead_variants(variants, constructed, files.select("file", F.col("krate").alias("workspace")))


@query(f"""WITH {_O}, p AS (SELECT c, 'serde' AS f, CASE WHEN k % 3 = 0 THEN 'de' ELSE 'ser' END AS s, false AS t FROM o UNION ALL SELECT c, 'rand', 'random', true FROM o UNION ALL SELECT c, 'tokio', 'spawn' || k % 4, k % 2 = 0 FROM o UNION ALL SELECT c, 'println', NULL, false FROM o)
SELECT c AS krate, f AS dependency, count(DISTINCT s) AS items, bool_and(t) AS dev_only FROM p GROUP BY 1, 2""")
def dependency_items_used(spark, d):
    """How many items of each dependency a crate names, and what only its tests use."""
    source = 'use serde::{§if(k % 3 = 0, "de", "ser")§::Thing};\nfn f() { println!("tokio::none"); §if(k % 2 = 0, "", concat("tokio::spawn", k % 4, "::<u8>(1);"))§ }\n#[cfg(test)]\nmod tests { fn t() { let x = rand::random(); §if(k % 2 = 0, concat("tokio::spawn", k % 4, "(2);"), "")§ } }\n'
    files = _files(spark, d, source)
    return structure.used_items(items.path_table(files), files.select("file", "krate"))


#: A line of code of each rule, and what the rule calls it; fixed values of this query's own.
_SNIPPETS = (
    ("    let x = y.unwrap();", "panic-in-lib", "Warn"),
    ("    let x = y as u8;", "integer-cast-risk", "Warn"),
    ("    let _ = send(1);", "swallowed-result", "Warn"),
    ("    match r { Ok(v) => v, Err(_) => {} }", "empty-error-arm", "Warn"),
    ("    #[allow(dead_code)] let z = 1;", "suppression-debt", "Info"),
    ("    todo!();", "merged-stub", "Warn"),
    ("    assert!(true);", "tautological-test", "Warn"),
    ("    #[ignore] fn g() {}", "ignored-test-accumulation", "Info"),
    ("    let data2 = 1;", "generic-naming", "Info"),
    ("    unsafe { go() }", "unsafe-surface", "Warn"),
    ("    pub struct U;", "undocumented-public-item", "Info"),
    ("    // x.unwrap() as u8; todo!()", None, None),
    ('    let s = "unsafe { todo!() }";', None, None),
)


@query(f"""WITH {_O}, s(i, rule, severity) AS (VALUES {", ".join(f"({i}, '{r}', '{v}')" for i, (_, r, v) in enumerate(_SNIPPETS) if r)})
SELECT file, 2 AS line, rule, severity FROM o JOIN s ON k % {len(_SNIPPETS)} = i UNION ALL SELECT file, 5, 'assertion-free-test', 'Warn' FROM o WHERE c % 2 = 0""")
def syntactic_findings(spark, d):
    """The rules that need one file's text, on a line chosen by the order's number, and a test that asserts only for odd customers."""
    line = F.element_at(F.array(*(F.lit(s) for s, _, _ in _SNIPPETS)), (F.col("o_orderkey") % len(_SNIPPETS) + 1).cast("int"))
    check = F.when(F.col("o_custkey") % 2 == 0, "run();").otherwise("assert_eq!(run(), 1);")
    text = F.concat(F.lit("fn f() {\n"), line, F.lit("\n}\n#[test]\nfn t() { "), check, F.lit(" }\n"))
    return rust_source.finding_table(t(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("file"), text.alias("text")))


# ---- patterns and principles -------------------------------------------------

#: One text with what all the rules look for, in parts that depend on the order's number.
_PATTERNS = """pub fn age_§k§(age: u8, n§k % 3§: u32, ok: bool, name: &mut str) -> Result<u8, E> { §if(k % 4 = 0, "if age > 9 { return Err(E::Old); }", "if age > 9 { log!(age); }")§ §if(k % 5 = 0, concat("assert!(n", k % 3, " < 5);"), "")§ Ok(age) }
fn flags(a: bool, b: bool, c: bool, d: u8) { §element_at(array("if a && b { }", "if a { if b { } }", "match (b, c) { _ => {} }", "if a == true && self.b { }"), cast(k % 4 + 1 as int))§ }
pub struct R§k % 2§ { pub lo: u8, pub hi: u8, inner: u8 }
impl R§k % 2§ { pub fn new(lo: u8, hi: u8) -> §if(k % 2 = 0, "Result<Self, E>", "Self")§ { §element_at(array("if lo > hi { return Err(E); }", "assert!(lo < hi);", "if lo > hi { fix(); }"), cast(k % 3 + 1 as int))§ go() } }
fn cycle(x: X) { x.§element_at(array("lock", "open", "peek"), cast(k % 3 + 1 as int))§(); x.unlock(); }
§if(k % 30 = 0, "impl Drop for G { fn drop(&mut self) {} }", "")§
pub fn effect(p: P) { §element_at(array("std::fs::read(p);", "p.read_to_end();", "write!(stdout(), p);", "help(p);"), cast(k % 4 + 1 as int))§ §if(k % 6 = 0, "println!(p);", "")§ }
pub fn other(p: P) { §element_at(array("std::env::var(p);", "eprintln!(p);", "write!(buf, p);"), cast(k % 3 + 1 as int))§ }
"""


def _pattern_files(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    files = _files(spark, d, _PATTERNS)
    return files, files.select("file", "krate")


@query(f"""WITH {_O}, p AS (SELECT c, 'age' AS param, 'u8' AS type, (k % 4 = 0)::INTEGER AS g FROM o UNION ALL SELECT c, 'n' || k % 3, 'u32', (k % 5 = 0)::INTEGER FROM o
UNION ALL SELECT c, x, 'u8', (k % 3 < 2)::INTEGER FROM o, (VALUES ('lo'), ('hi')) v(x))
SELECT c AS krate, param, type, count(*) AS signatures, sum(g)::BIGINT AS guarded FROM p GROUP BY 1, 2, 3 HAVING count(*) >= 2 AND sum(g) >= 1""")
def primitive_domain_values(spark, d):
    files, owners = _pattern_files(spark, d)
    return patterns.primitive_values(signatures.signature_table(files), owners)


@query(f"WITH {_O} SELECT file, 'flags' AS name, 'a,b,c' AS flags FROM o WHERE k % 4 IN (0, 2)")
def boolean_state_clusters(spark, d):
    files, _ = _pattern_files(spark, d)
    return patterns.boolean_clusters(signatures.signature_table(files)).withColumn("flags", F.array_join("flags", ","))


@query(f"WITH {_O} SELECT c AS krate, 'R' || k % 2 AS struct, 'hi,lo' AS fields, 'R' || k % 2 || '::new' AS constructors FROM o GROUP BY c, k % 2 HAVING bool_or(k % 3 < 2)")
def public_invariant_bypasses(spark, d):
    files, owners = _pattern_files(spark, d)
    structs, functions = items.tables(files, signatures.STRUCT_ROWS, signatures.FUNCTION_ROWS)
    found = patterns.invariant_bypasses(structs, functions, owners)
    return found.withColumn("fields", F.array_join("fields", ",")).withColumn("constructors", F.array_join("constructors", ","))


@query(f"WITH {_O} SELECT c AS krate, count(*) AS functions FROM o WHERE k % 3 < 2 AND c NOT IN (SELECT c FROM o WHERE k % 30 = 0) GROUP BY 1")
def manual_resource_lifecycles(spark, d):
    files, owners = _pattern_files(spark, d)
    functions, drops = items.tables(files, signatures.FUNCTION_ROWS, signatures.DROP_ROWS)
    return patterns.manual_lifecycles(functions, drops, owners)


_MASKS = """m AS (SELECT *, (CASE WHEN k % 4 < 2 THEN 1 ELSE 0 END) + (CASE WHEN k % 4 = 2 OR k % 6 = 0 THEN 2 ELSE 0 END) + (CASE WHEN k % 20 IN (4, 19) THEN 4 ELSE 0 END) AS a, CASE k % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS b FROM o)"""


def _complexity(files: DataFrame) -> DataFrame:
    """A complexity of 12 for two functions in twenty."""
    return files.select("file", F.lit("effect").alias("name"), F.when((F.col("file").cast("bigint") % 20).isin(4, 19), 12).otherwise(2).alias("cyclomatic"))


@query(f"WITH {_O}, {_MASKS} SELECT file, 5 AS items, 'effect' AS first, 'other' AS second FROM m WHERE a <> 0 AND b <> 0 AND (a <> b OR a NOT IN (1, 2, 4))")
def incohesive_files(spark, d):
    """Five public items a file, two of which have effects."""
    files, _ = _pattern_files(spark, d)
    functions, declared = items.tables(files, signatures.FUNCTION_ROWS, items.ITEM_ROWS)
    return patterns.incohesive_files(patterns.effects(functions, _complexity(files), declared))


@query(f"WITH {_O} SELECT file, 'effect' AS name, 12 AS cyclomatic FROM o WHERE k % 20 IN (4, 19) AND k % 4 < 2")
def mixed_functional_cores(spark, d):
    """Complex functions that read: one of the two in twenty that are complex."""
    files, _ = _pattern_files(spark, d)
    return patterns.mixed_cores(signatures.signature_table(files), _complexity(files))


#: What a public function gives back and does, and its documentation.
_CRAFT = """/// §element_at(array("Returns the u8.", "Gets the total of all parts, with tax", "", "The Order."), cast(c % 4 + 1 as int))§
pub fn total_§k§(order: Order) -> §element_at(array("Result<u8, Box<dyn std::error::Error + Send>>", "anyhow::Result<u8>", "Result<u8, Known>"), cast(k % 3 + 1 as int))§ { §if(k % 2 = 0, "read(order).map_err(|_| Bad)", "read(order).map_err(|e| Bad(e))")§ }
/// Does things.
fn quiet() { §if(k % 5 = 0, "/* nothing */", "run();")§ }
fn kind(s: &str) -> u8 { if s.contains("err") §if(k % 7 = 0, "&& is_word(s)", "")§ { 1 } §if(k % 3 = 0, "", "else if s.len() > 3 ")§ { 2 } match s { x if x.contains("a") => {} _ => {} } 0 }
"""


@query(f"""WITH {_O} SELECT file, 2 AS line, 'catch-all-error' AS rule, 'Warn' AS severity, 'total_' || k AS item FROM o WHERE k % 3 < 2 AND k % 2 = 0
UNION ALL SELECT file, 2, 'doc-restates-signature', 'Info', 'total_' || k FROM o WHERE c % 4 = 3 UNION ALL SELECT file, 4, 'empty-impl', 'Warn', 'quiet' FROM o WHERE k % 5 = 0
UNION ALL SELECT file, 5, 'fragile-substring-classification', 'Warn', 'kind' FROM o WHERE k % 3 <> 0 AND k % 7 <> 0""")
def craft_findings(spark, d):
    """Four rules that need a function's tree."""
    return syntax_rules.rule_table(_files(spark, d, _CRAFT))


@query(f"""WITH {_O} SELECT c AS krate, count(*) AS findings FROM o WHERE k % 3 < 2 AND k % 2 = 0 AND c IN (SELECT c FROM o WHERE k % 4 < 3) GROUP BY 1 HAVING count(*) >= 2""")
def stringly_error_boundaries(spark, d):
    """Crates that give back erased errors twice, of those that have an error type of their own in one of three ways."""
    files = _files(spark, d, _CRAFT + """§element_at(array("enum LoadError { A }", "#[derive(Debug, thiserror::Error)] struct Failed;", "impl std::error::Error for Bad {}", "struct ErrorLog;"), cast(k % 4 + 1 as int))§""")
    found, errors = items.tables(files, syntax_rules.RULE_ROWS, items.ERROR_ROWS)
    return patterns.stringly_boundaries(found, errors, files.select("file", "krate"))


_LEAKS = """pub fn a(x: &crate::infra::§element_at(array("db", "net", "log"), cast(k % 3 + 1 as int))§::Pool<u8>) -> Vec<crate::domain::Thing> { x }
fn b(x: crate::infra::db::Hidden) {} pub fn c(x: infra::db::Relative) -> §if(k % 5 = 0, "Option<crate::infra::db::Row>", "u8")§ { y }
"""
_BOUNDARIES = (("store", "domain", "infra::db"), ("wire", "domain::core", "infra::net"), ("wire", "domain::core", "infra::log"), ("quiet", "ui", "infra"))


@query(f"""WITH {_O}, m AS (SELECT file, k, CASE c % 4 WHEN 0 THEN 'domain' WHEN 1 THEN 'domain::core' WHEN 2 THEN 'domains' ELSE 'ui' END AS module FROM o), p AS (SELECT module, 'infra::' || CASE k % 3 WHEN 0 THEN 'db' WHEN 1 THEN 'net' ELSE 'log' END AS path FROM m
UNION ALL SELECT module, 'domain' FROM m UNION ALL SELECT module, 'infra::db' FROM m WHERE k % 5 = 0), r(name, below, forbidden) AS (VALUES {", ".join(map(str, _BOUNDARIES))}),
l AS (SELECT name AS rule, count(*) AS leaks FROM p JOIN r ON (module = below OR starts_with(module, below || '::')) AND (path = forbidden OR starts_with(path, forbidden || '::')) GROUP BY 1),
v AS (SELECT CASE o_orderkey % 3 WHEN 0 THEN 'store' WHEN 1 THEN 'wire' ELSE 'other' END AS rule, count(*) AS violations FROM orders GROUP BY 1)
SELECT rule, violations, leaks FROM v JOIN l USING (rule)""")
def dependency_inversions(spark, d):
    """Boundaries that are crossed and leak; one that leaks isn't crossed."""
    files = _files(spark, d, _LEAKS)
    module = F.element_at(F.array(*map(F.lit, ("domain", "domain::core", "domains", "ui"))), (F.col("krate") % 4 + 1).cast("int"))
    rule = F.element_at(F.array(*map(F.lit, ("store", "wire", "other"))), (F.col("file").cast("bigint") % 3 + 1).cast("int"))
    rules = spark.createDataFrame(list(_BOUNDARIES), "name string, below string, forbidden string")
    return patterns.dependency_inversions(files.select(rule.alias("rule")), signatures.exposed_table(files), files.select("file", module.alias("module")), rules)
