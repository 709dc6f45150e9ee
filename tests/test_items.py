"""Facts of a source's items on fixtures with nested groups, raw strings, macros and patterns."""

from __future__ import annotations

from factloom.functions.items import Facts, item_table, tree, use_leaves
from factloom.operators import structure

SOURCE = """
use std::{fmt::{self, Display as Show}, io::*, collections::HashMap};
pub use crate::a::b;
use ::serde;
#[cfg(test)] mod tests { use super::*; use proptest::prelude; fn t() { rand::random(); } }
pub struct S<T> where T: Fn() -> u8 { pub a: T }
pub(crate) enum E { A, #[doc = "x"] B(u8, Vec<E>), C { x: i32 }, D = 4 }
impl<'a, T: Into<E>> fmt::Display for S<T> { type Out = u8; const N: usize = 3; fn fmt(&self) -> Result<E, ()> { struct Inner; Ok(E::A) } }
trait Tr { const Z: u8; fn has(&self) { let x = E::B(1, vec![E::C]); } fn not(&self); }
const fn k() -> u8 { match y { E::C { x } if x == E::D => E::E2, E::D | E::Q => { call(E::W) } _ => r#"E::RAW"#.len(), E::Z => x.A, } }
static mut G: E = E::G1; const _: () = ();
fn main() { if let E::P1(a) = E::P2 { } for E::P3 in it {} let c = |E::P4(x)| E::P5; let v = y as E::P6; /* E::COMMENT */ foo!(E::MACRO); Vec::<E::T1>::new(); Some(Foo { f: E::F1, g }); m1::m2::call(); while let E::P7 = x { } }
"""


def test_use_trees():
    found = [(path, alias, glob, test) for _, _, path, alias, glob, test in Facts(SOURCE).uses]
    assert found == [
        ("std::fmt::self", None, False, False), ("std::fmt::Display", "Show", False, False), ("std::io", None, True, False), ("std::collections::HashMap", None, False, False),
        ("crate::a::b", None, False, False), ("serde", None, False, False), ("super", None, True, True), ("proptest::prelude", None, False, True),
    ]
    nested = "a::{b, c::{d as e, f::{g, *}}, {h, i::j}}"
    assert list(use_leaves(tree(nested))) == [
        (("a", "b"), None, False), (("a", "c", "d"), "e", False), (("a", "c", "f", "g"), None, False), (("a", "c", "f"), None, True), (("a", "h"), None, False), (("a", "i", "j"), None, False),
    ]


def test_items():
    found = [(kind, name, public, test) for _, kind, name, public, test in Facts(SOURCE).items]
    assert found == [
        ("fn", "tests::t", False, True), ("struct", "S", True, False), ("enum", "E", False, False), ("type", "S::Out", False, False), ("const", "S::N", False, False),
        ("fn", "S::fmt", False, False), ("struct", "S::Inner", False, False), ("trait", "Tr", False, False), ("fn", "Tr::has", False, False), ("fn", "k", False, False), ("static", "G", False, False), ("fn", "main", False, False),
    ]
    assert [(n, v) for _, n, v, _, _ in Facts(SOURCE).variants] == [("E::A", "A"), ("E::B", "B"), ("E::C", "C"), ("E::D", "D")]


def test_a_pattern_constructs_nothing():
    made = Facts(SOURCE).constructed
    assert {"A", "B", "D", "E2", "W", "G1", "P2", "P5", "F1", "Some", "Ok", "Foo", "g", "new"} <= made
    assert not made & {"C", "Q", "Z", "P1", "P3", "P4", "P6", "P7", "T1", "MACRO", "COMMENT", "RAW", "f", "u8", "crate"}


def test_macros_and_negations():
    made = Facts("fn f() { if !(a == E::A) { return !(E::B); } m!(E::C); m![E::D]; x::m! { E::F } macro_rules! q { () => { E::G } } ok(E::H) }").constructed
    assert {"A", "B", "H"} <= made and not made & {"C", "D", "F", "G"}


def test_paths():
    found = Facts(SOURCE).paths
    assert {("std", "fmt", False), ("serde", None, False), ("proptest", "prelude", True), ("rand", "random", True), ("m1", "m2", False), ("foo", None, False)} <= found
    assert not {f for f, _, _ in found} & {"super", "crate", "self", "m2"}


def test_texts_that_are_no_source():
    for text in ("", "}", "fn f( {", "use ", "use a::{", "enum", "impl", "match {", "pub", "#[", "let", "const", "/* open", '"open', "mod m { fn", "(" * 3000, "a::", "x as"):
        Facts(text)
    deep = "fn f() { " + "(" * 3000 + "E::A" + ")" * 3000 + " } enum E { A }"
    assert "A" in Facts(deep).constructed and [n for _, n, *_ in Facts(deep).variants] == ["E::A"]


def test_dead_variants_and_empty_tables(spark):
    variants = spark.createDataFrame([("a", 1, "E::A", "A", True), ("a", 2, "E::B", "B", True), ("b", 1, "F::C", "C", True), ("a", 3, "H::P", "P", False)], "file string, line int, name string, variant string, public boolean")
    made = spark.createDataFrame([("a2", "A"), ("b", "B")], "file string, variant string")
    owners = spark.createDataFrame([("a", 1), ("a2", 1), ("b", 2)], "file string, workspace int")
    assert {r["name"] for r in structure.dead_variants(variants, made, owners).collect()} == {"E::B", "F::C"}
    files = spark.createDataFrame([("x", None)], "file string, text string")
    assert item_table(files).collect() == [] and item_table(files.where("false")).collect() == []
