"""Tokens, streams in four modes, classes of clones against brute force, ranges and families."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from factloom.functions import tokens
from factloom.operators import clones, text

from .test_whole import pair_spans, spans_of_classes


def test_tokens():
    source = """fn f<'a>(x: &'a str) -> u8 { /* a /* nested "*/ b */ let y = b'q'; // "hi
 let z = r#"raw "quoted" text"#; let w = "a\\"b // no comment"; 1..2; x.len(); 1.5e3; 0xffu8; 2f32; 1.; '\\u{1F}'; b"by"; c"cs"; r#type; '\\''; 'ä' }"""
    found = tokens.tokens(source)
    assert found[:13] == ["fn", "f", "<", "'", "a", ">", "(", "x", ":", "&", "'", "a", "str"] and "nested" not in found and "hi" not in found
    kinds = {t: tokens.literal_kind(t) for t in found}
    assert {t: k for t, k in kinds.items() if k} == {
        "b'q'": "byte", 'r#"raw "quoted" text"#': "str", '"a\\"b // no comment"': "str", "1": "int", "2": "int", "1.5e3": "float", "0xffu8": "int", "2f32": "float", "1.": "float",
        "'\\u{1F}'": "char", 'b"by"': "bytestr", 'c"cs"': "verbatim", "'\\''": "char", "'ä'": "char",
    }
    assert "r#type" in found and tokens.tokens("a /* open") == ["a"] and tokens.tokens("") == []
    assert "".join(tokens.with_gaps("a  b /* c */\nd")) == "a  b /* c */\nd"


def test_streams():
    source = 'let total = compute(&items, true) + items.len() + Foo::bar + MAX + self.total + "x"; vec![total]'
    weak = tokens.normalised(tokens.tokens(source), "weak")
    assert "__BOOL_LIT__" in weak and "__STR_LIT__" in weak and "items" in weak
    semantic = tokens.normalised(tokens.tokens(source), "semantic")
    assert semantic[:6] == ["let", "__ID_0__", "=", "compute", "(", "&"] and semantic[6] == "__ID_1__"
    assert [t for t in semantic if t in ("len", "Foo", "bar", "MAX", "self", "total", "vec")] == ["len", "Foo", "bar", "MAX", "self", "total", "vec"]  # total once, as a field
    assert semantic[-2:] == ["__ID_0__", "]"]


@pytest.mark.parametrize("mode", ["mild", "weak", "semantic"])
def test_hashed_streams_are_the_normalised_ones(mode):
    rng = random.Random(5)
    signs = ["(", ")", ":", ":", ".", "!", "a", "b", "Cc", "self", "let", "1", '"s"', "true", "_x", "é", "b'q'", "crate", "r", "cb"]
    rows = [[rng.choice(signs) for _ in range(rng.randint(0, 40))] for _ in range(60)] + [[], ["a"], [":", ":", "a"], ["a", ":", ":"]]
    found = clones._Hashed(pa.array(rows, pa.list_(pa.string())), mode)
    want = [u for r in rows for u in tokens.normalised(r, mode)]
    assert np.array_equal(found.unit, clones._hashes(want)) and found.sizes.tolist() == [len(r) for r in rows]
    texts = [" ".join(r) for r in rows]
    assert np.array_equal(clones._Hashed(pa.array(texts), mode).unit, clones._hashes([u for t in texts for u in tokens.normalised(tokens.tokens(t), mode)]))


def functions(rng, n):
    """Sources of a few statements, some of them copies with other names, literals or spaces."""
    names = ["alpha", "beta", "gamma", "delta"]
    body = lambda: [rng.choice(["let {a} = {b} + 1;", "if {a} > 2 { call({b}); }", "{a}.push(\"x\");", "for {a} in {b} { go!({a}); }", "return Foo::new({a}, 'c');"]) for _ in range(rng.randint(2, 6))]
    bodies = [body() for _ in range(4)]
    out = []
    for _ in range(n):
        a, b = rng.sample(names, 2)
        lines = rng.choice(bodies) + rng.choice(bodies)[: rng.randint(0, 3)]
        s = rng.choice([" ", "\n", "\n"]).join(line.replace("{a}", a).replace("{b}", b) for line in lines)
        out.append(s.replace("2", rng.choice("23")).replace(";", rng.choice([";", ";", "; // note"]), 1 if rng.random() < 0.5 else 0))
    return out + [None, "", "let", out[0], out[0]]


@pytest.mark.parametrize("mode", tokens.MODES)
def test_classes_hold_every_span_of_the_mode(spark, mode):
    sources = dict(enumerate(functions(random.Random(3), 14)))
    frame = spark.createDataFrame([(f"f{i:02}", s) for i, s in sources.items()], "id string, text string").repartition(3)
    got = clones.clone_classes(frame, mode, 6).collect()
    if mode != "strict":
        streams = {f"f{i:02}": tokens.normalised(tokens.tokens(s or ""), mode) for i, s in sources.items()}
        assert spans_of_classes(got, 6) == pair_spans(streams, 6)
        return
    # strict: the source of the spans is equal throughout, and longer ones aren't
    hits = set()
    cut = {f"f{i:02}": list(tokens.spans(s or "")) for i, s in sources.items()}
    source = {f"f{i:02}": s or "" for i, s in sources.items()}
    for a in cut:
        for b in cut:
            if a < b:
                for i in range(len(cut[a]) - 5):
                    for j in range(len(cut[b]) - 5):
                        if source[a][cut[a][i][0] : cut[a][i + 5][1]] == source[b][cut[b][j][0] : cut[b][j + 5][1]]:
                            hits.add((a, b, i, j))
    found = set()
    for a, b, i, j in hits:
        if (a, b, i - 1, j - 1) not in hits:
            n = 1
            while (a, b, i + n, j + n) in hits:
                n += 1
            found.add((a, b, i, j, n + 5))
    assert spans_of_classes(got, 6) == found and found


def test_modes_of_a_renamed_function(spark):
    one = "let mut total = 0; for i in 0..n { total += i; } total"
    rows = [("one", one), ("spaced", one.replace("; ", ";\n    // add\n    ")), ("valued", one.replace("0;", "7;")), ("renamed", one.replace("total", "sum").replace(" i ", " k ").replace("= i", "= k"))]
    frame = spark.createDataFrame(rows, "id string, text string")
    size = len(tokens.tokens(one))
    whole = {m: {r["id"] for r in clones.clone_classes(frame, m, size).collect()} for m in tokens.MODES}
    assert whole == {"strict": set(), "mild": {"one", "spaced"}, "weak": {"one", "spaced", "valued"}, "semantic": {"one", "spaced", "valued", "renamed"}}
    short = {r["id"] for r in clones.clone_classes(frame, "strict", 8).collect()}
    assert {"one", "spaced"} <= short  # a tail without the comment
    assert clones.clone_classes(frame, "mild", size + 1).count() == 0


def brute_ranges(events):
    out, open_ = [], None
    for line, kind in sorted(events):
        if kind == "off":
            open_ = line if open_ is None else open_
        elif open_ is not None:
            out.append((open_, line))
            open_ = None
    return out + ([(open_, clones.OPEN_END)] if open_ is not None else [])


def test_off_ranges(spark):
    rng = random.Random(8)
    lines, want = [], set()
    for f in range(40):
        events = [(n, rng.choice(["off", "on"])) for n in sorted(rng.sample(range(1, 60), rng.randint(0, 9)))]
        bad = f % 7 == 0 and any(k == "off" for _, k in events)
        lines += [(f, n, ("// clones-off: " + ("" if bad else "why // clones-on") if k == "off" else "x(); // clones-on")) for n, k in events] + [(f, 99, "plain"), (f, 100, None)]
        want |= set() if bad else {(f, *r) for r in brute_ranges(events)}
    events = clones.marker_events(spark.createDataFrame(lines, "file int, line int, text string").repartition(5), "// clones-off:", "// clones-on")
    ranges, errors = clones.off_ranges(events)
    assert {tuple(r) for r in ranges.collect()} == want and errors.count() > 2


def test_families_outside_ranges(spark):
    """A pair goes that has one side wholly in a range; a span that reaches over its end stays."""
    body = [f"t{i}" for i in range(12)]
    rows = {"a": body, "b": ["x", *body], "c": body, "d": body[:8]}
    frame = spark.createDataFrame(list(rows.items()), "id string, toks array<string>")
    places = spark.createDataFrame([(k, f"{k}.rs", [i + 1 for i in range(len(v))]) for k, v in rows.items()], "id string, file string, lines array<int>")
    members = lambda ranges: sorted((r["id"], r["start"], r["length"], r["members"]) for r in clones.families(text.clone_spans(frame, 5), frame, places, spark.createDataFrame(ranges, "file string, start int, end int")).collect())
    everyone = [("a", 0, 12, 3), ("b", 1, 12, 3), ("c", 0, 12, 3)]
    assert members([]) == everyone
    assert members([("c.rs", 2, 12)]) == everyone
    assert members([("c.rs", 1, 12)]) == [("a", 0, 12, 2), ("b", 1, 12, 2)]
    assert members([("a.rs", 1, 40), ("c.rs", 1, clones.OPEN_END)]) == [("b", 1, 8, 2), ("d", 0, 8, 2)]
    found = clones.families(text.clone_spans(frame, 5), frame, places, spark.createDataFrame([], "file string, start int, end int"))
    assert clones.duplicated_tokens(found).first()["tokens"] == 36 and clones.largest_families(found).first()["members"] == 3
