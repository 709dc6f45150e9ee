"""Values that rules fix: hashes, chains of steps and of re-exports, markers, roles, configuration keys."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from factloom.functions import names, rust_source
from factloom.operators import boundaries, findings, provenance, structure, text
from factloom.sources import readers, writers


def fnv(raw: bytes) -> str:
    h = 0xCBF29CE484222325
    for b in raw:
        h = (h ^ b) * 0x100000001B3 % 2**64
    return f"{h:016x}"


def test_fnv1a(spark):
    rng = random.Random(1)
    values = ["", "a", "foobar", "é日本", "x" * 5000, *("".join(chr(rng.randrange(1, 0x2FFF)) for _ in range(rng.randint(1, 40))) for _ in range(60))]
    rows = spark.createDataFrame([(v,) for v in [*values, None]], "v string").select("v", names.fnv1a(F.col("v")).alias("h")).collect()
    got = {r["v"]: r["h"] for r in rows}
    assert (got[""], got["a"], got["foobar"]) == ("cbf29ce484222325", "af63dc4c8601ec8c", "85944171f73967e8")
    assert all(got[v] == fnv(v.encode()) for v in values) and got[None] is None


def test_candidate_ids_ignore_order_and_repeats(spark):
    rows = spark.createDataFrame([("app", ["b", "a"], ["f:2", "f:1"]), ("app", ["a", "b"], ["f:1", "f:2", "f:1"]), ("app", ["a"], ["f:1", "f:2"])], "crate string, modules array<string>, evidence array<string>")
    ids = [r[0] for r in rows.select(names.candidate_id(F.lit("p"), F.col("crate"), F.col("modules"), F.col("evidence"))).collect()]
    assert ids[0] == ids[1] == "pattern:p:" + fnv(b"p|app|a,b|f:1,f:2") != ids[2]


def step_rows(spark, source):
    """Comments "Step n" of a text, and its lines; "item" begins a new item."""
    lines, steps, item = [], [], None
    for n, line in enumerate(source.split("\n"), 1):
        lines.append(("f", n, line))
        item = line if line.startswith("item") else item
        if line.startswith("// Step"):
            steps.append(("f", n, int(line.split()[2].rstrip(":")), item))
    return spark.createDataFrame(steps, "file string, line int, number int, item string"), spark.createDataFrame(lines, "file string, line int, text string")


@pytest.mark.parametrize(
    ("source", "chains"),
    [
        ("// Step 1: a\nx\n// Step 2: b\n\n\nx\ny\n// Step 3: c", [[1, 3, 8]]),
        ("// Step 1: a\nx\n// Step 2: b\nx\ny\nz\n// Step 3: c", []),  # three lines apart
        ("// Step 2: b\n// Step 1: a\n// Step 3: c", []),  # not in their order of place
        ("// Step 1: a\n// Step 2: b\nitem two\n// Step 3: c", []),  # another item
        ("// Step 1: a\n// Step 2: b\n// Step 3: c\n// Step 1: a\n// Step 2: b\n// Step 3: c\n// Step 4: d", [[1, 2, 3], [4, 5, 6, 7]]),
        ("// Step 1: a\n// Step 1: a\n// Step 2: b", []),
    ],
)
def test_step_chains(spark, source, chains):
    found = text.step_chains(*step_rows(spark, source)).collect()
    assert sorted(r["lines"] for r in found) == chains and all(r["length"] == len(r["lines"]) and r["first_line"] == r["lines"][0] for r in found)


def test_re_export_chains(spark):
    items = [("m1", "A", "re_export", "m2", "A"), ("m2", "A", "re_export", "m3", "B"), ("m3", "B", "original", None, None), ("r1", "X", "re_export", "r2", "X"), ("r2", "X", "re_export", "r1", "X"), ("m4", "M", "macro", None, None)]
    uses = [("short", "m3", "B"), ("long", "m1", "A"), ("ring", "r1", "X"), ("macro", "m4", "M"), ("nowhere", "m9", "Z")]
    chains = structure.re_export_chains(spark.createDataFrame(uses, "use string, module string, name string"), spark.createDataFrame(items, "module string, name string, kind string, to_module string, to_name string"))
    assert {r["use"]: (r["hops"], r["status"]) for r in chains.collect()} == {"short": (1, "original"), "long": (3, "original"), "ring": (5, "capped"), "macro": (None, "unclassified"), "nowhere": (None, "unclassified")}
    assert {r["use"] for r in structure.long_re_exports(chains).collect()} == {"long", "ring"}


def test_derivable_traits_and_generic_names(spark):
    impls = spark.createDataFrame([("FromStr", "A"), ("Parse", "A"), ("Show", "A"), ("Show", "B")], "trait string, type string")
    assert [r["trait"] for r in structure.single_implementors(impls).collect()] == ["Parse"]
    found = [line for line, rule, _ in rust_source.findings("let Data1 = 1;\nlet tmp2 = 2;\nlet mut helper3 = 3;\nlet total4 = 4;") if rule == "generic-naming"]
    assert found == [1, 3]
    assert names.LITERALS["bool"] == "__BOOL_LIT__"


def test_the_first_marker_counts(spark):
    lines = spark.createDataFrame([("f", 1, "// allow: one-rule — says // allow: other-rule — no"), ("f", 2, "x // allow: short"), ("f", 3, None)], "file string, line int, text string")
    got = {r["line"]: (r["rule"], r["error"]) for r in findings.suppressions(lines, "allow:").collect()}
    assert got == {1: ("one-rule", False), 2: (None, True)}


def test_hexagonal_roles(spark):
    make = lambda rows: spark.createDataFrame(rows, "node string, grp string")
    with pytest.raises(ValueError, match="not domain"):
        boundaries.hexagonal(make([("a", "core"), ("b", "ports"), ("c", "adapters"), ("d", "domain")]))
    with pytest.raises(ValueError, match="none is of ports"):
        boundaries.hexagonal(make([("a", "core"), ("c", "adapters")]))
    assert boundaries.hexagonal(make([("a", "core"), ("b", "ports"), ("c", "adapters")])).count() == 3


CONFIG = """
internal_crates = ["secret"]
[[boundary]]
name = "strict"
from = ["a"]
forbidden = ["gone"]
reach = "direct"
[[boundary]]
name = "loose"
from = ["also-gone"]
required = ["b"]
reach = "transitive"
allow_empty = true
[layers]
preset = "layered"
order = ["x", "y"]
[layers.assign]
a = "x"
[[provenance_label]]
name = "vendor"
trailer_contains = ["Vendor-Bot"]
author_email_contains = ["@vendor.example"]
[[provenance_label]]
name = "bot"
trailer_contains = ["ci-bot"]
"""


def test_configuration_keys(spark):
    c = readers.config_tables(spark, CONFIG)
    assert [tuple(r) for r in c["labels"].collect()] == [(0, "vendor", "Vendor-Bot", "trailer"), (0, "vendor", "@vendor.example", "email"), (1, "bot", "ci-bot", "trailer")]
    assert c["layers"].first()["preset"] == "layered" and c["internal"].first()["krate"] == "secret"
    known = spark.createDataFrame([("a",), ("b",)], "krate string")
    assert {tuple(r) for r in readers.unknown_names(c, known).collect()} == {("strict", "gone"), ("internal_crates", "secret")}
    with pytest.raises(ValueError, match="reach"):
        readers.config_tables(spark, '[[boundary]]\nname = "n"\nfrom = ["a"]')
    commits = spark.createDataFrame([(1, "x@vendor.example", ["ci-bot"]), (2, "y@home", ["by CI-Bot 2"]), (3, "z@home", ["vendor-bot"]), (4, "z@home", []), (5, None, None)], "commit_id int, author_email string, trailers array<string>")
    assert {r["commit_id"]: r["label"] for r in provenance.labelled(commits, c["labels"]).collect()} == {1: "vendor", 2: "bot", 3: "vendor", 4: None, 5: None}


def test_delta_is_worst_first(spark):
    rows = [("1", "r", "Info", "code_introduced"), ("2", "r", "Warn", "code_introduced"), ("3", "r", "Fail", "code_introduced"), ("4", "r", "Fail", "resolved")]
    changes = spark.createDataFrame(rows, "id string, rule string, severity string, state string")
    lines = [line for line in writers.markdown_delta(changes, "fail", limit=2).split("\n") if line.startswith("- ")]
    assert lines == ["- Fail `r` 3", "- Warn `r` 2"]
