"""F1 to F8 of r05: a source is parsed in pieces, those that come again once, and its rows are those of the whole."""

from __future__ import annotations

import random

import pytest

from factloom.functions import items, rust_source, signatures, syntax_rules
from factloom.functions.kept import Kept

KINDS = (items.USE_ROWS, items.ITEM_ROWS, items.VARIANT_ROWS, items.CONSTRUCTED_ROWS, items.PATH_ROWS, items.ERROR_ROWS, signatures.FUNCTION_ROWS, signatures.STRUCT_ROWS, signatures.DROP_ROWS, syntax_rules.RULE_ROWS)
PARTS = (
    "fn f(a: u8, b: bool) -> Result<u8, E> { if a > b { return Err(E::A); } x.lock() }\n", "pub struct S { pub a: u8 }\n", "impl Drop for S { fn drop(&mut self) {} }\n", "use a::{b, c};\n", "#[cfg(test)]\n", "mod t { use x::y; fn g() { h::i(); } }\n",
    "enum Error { A, B(u8) }\n", "const X: u8 =", " {\n1 }\n;\n", "let v = E::B", ";\n", "}\n", "{\n", "pub ", "/// Returns f.\n", "// it's } ;\n", '"a', '"', "'", "'x'", "\\", "b'\\u{", "}'\n", "/*", "*/\n", 'r#"', '"#;\n', "#", "m::", "!", "(", ")\n",
    "::<u8", ">", "x as T", "|a| ", "match x { A => b }\n", "impl X ", "for ", "static Y: u8 = 1;\n\n\n", "macro_rules! m { () => {} }\n", "extern ", "fn ", "e", ":", "trait T { fn k() { z(); } }\n", "m! { a::b }\n", "\r\n", ".",
)


def _rows(texts, kinds, kept):
    out = []
    for whose, rows in items._facts(texts, kinds, kept, [items._struct(k) for k in kinds]):
        own = [[] for _ in texts]
        for i, r in zip(whose.tolist(), rows.to_pylist(), strict=True):
            own[i].append(tuple(r.values()))
        out.append(own)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_rows_are_those_of_the_whole(spark, seed):
    rng = random.Random(seed)
    weights = [6] * 7 + [1] * (len(PARTS) - 7)
    texts = ["".join(rng.choices(PARTS, weights, k=rng.randrange(1, 9))) for _ in range(800)]
    cut = sum(len(list(items._pieces(t, Kept(lambda s: items._Piece(s, KINDS))))) > 1 for t in texts)
    assert cut > 300
    for k, got in zip(KINDS, _rows(texts, KINDS, Kept(lambda s: items._Piece(s, KINDS), 2000)), strict=True):
        for text, rows in zip(texts, got, strict=True):
            want = [tuple(r) for r in k[0](items.Facts(text))]
            assert (rows if items._has_lines(k) else set(rows)) == (want if items._has_lines(k) else set(want)), text


def test_what_comes_again_is_parsed_once(spark, monkeypatch):
    parsed, real = [], items.Facts
    monkeypatch.setattr(items, "Facts", lambda s: parsed.append(s) or real(s))
    texts = [f"pub fn f{i}(a: u8) {{ }}\nfn same(x: X) {{\n    x.lock();\n\n    x.unlock();\n}}\n#[derive(Debug)]\npub struct S {{ pub a: u8 }}\n" for i in range(300)] + [None, ""]
    [functions] = _rows(texts, (signatures.FUNCTION_ROWS,), Kept(lambda s: items._Piece(s, (signatures.FUNCTION_ROWS,))))
    assert len(parsed) == 303 and [[r[:2] for r in own] for own in functions] == [[(1, f"f{i}"), (2, "same")] for i in range(300)] + [[], []]


def test_kept_is_bounded():
    made = []
    kept = Kept(lambda s: made.append(s) or s.upper(), 100)
    for i in range(200):
        assert kept(f"once {i}") == f"ONCE {i}" and kept("again") == "AGAIN"
        assert len(kept._new) + len(kept._old) <= 40
    assert made.count("again") == 1 and len(made) == 201 and kept("x" * 200) == "X" * 200 and "x" * 200 not in kept._new


def test_a_text_that_comes_again_is_read_once(spark, tmp_path):
    log = tmp_path / "read"

    def rows(s):
        with log.open("a") as f:
            f.write("x")
        return [(1, s, "Warn")]

    files = spark.createDataFrame([("a", "t"), ("b", "t"), ("c", None), ("d", "t"), ("e", "u")], "file string, text string")
    real, rust_source.spread = rust_source.spread, lambda f: f.coalesce(1)
    try:
        found = rust_source._table(files, rows, rust_source.FINDINGS, ["file", "line", "rule", "severity"]).collect()
    finally:
        rust_source.spread = real
    assert {(r["file"], r["rule"]) for r in found} == {("a", "t"), ("b", "t"), ("d", "t"), ("e", "u")} and log.read_text() == "xx"
