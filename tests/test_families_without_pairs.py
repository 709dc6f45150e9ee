"""F14, F15, F16: families are found without a row for each pair of texts."""

from __future__ import annotations

import random

from factloom.operators import clones, text


def _inputs(spark, seed: int):
    rng = random.Random(seed)
    passage = rng.choices("abcdefgh", k=60)
    rows = {i: rng.choices("ab", k=rng.randrange(0, 25)) for i in range(8)}
    for i in range(8, 26):
        rows[i] = rng.choices("xyz", k=i % 4) + passage[i % 3 : 60 - i % 5] + rng.choices("xyz", k=i % 3)
        rows[i][rng.randrange(len(rows[i]))] = "q"
    rows |= {26: rows[8], 27: rows[8], 28: ["a"] * 12, 29: ["a"] * 9, 30: passage[:20] + ["r"] + passage[20:]}
    frame = spark.createDataFrame(list(rows.items()), "id bigint, toks array<string>").repartition(5)
    places = spark.createDataFrame([(i, f"{i}.rs", [k // 3 + 1 for k in range(len(v))]) for i, v in rows.items()], "id bigint, file string, lines array<int>")
    ranges = [(f"{i}.rs", a, a + rng.randrange(12)) for i in rows if rng.random() < 0.5 for a in (rng.randrange(1, 4), 17)]
    return frame, places, spark.createDataFrame([r for r in ranges if r[1] == 17 or r[2] < 17], "file string, start int, end int")


def test_families_are_those_of_pairs(spark):
    several = 0
    for seed in range(2):
        frame, places, ranges = _inputs(spark, seed)
        for r in (ranges, ranges.where("false")):
            want = sorted(map(tuple, clones.families(text.clone_spans(frame, 5), frame, places, r).collect()))
            got = clones.families_of_texts(frame, places, r, 5)
            assert sorted(map(tuple, got.select("family", "id", "start", "length", "members").collect())) == want
            several += len(want)
    assert several > 50
    assert clones.families_of_texts(frame.where("id = 3"), places, ranges, 5).count() == 0


def test_copies_send_no_pairs(spark, monkeypatch):
    """300 copies have 44,850 pairs; what is written grows with the texts."""
    written = []

    class Counted(clones.Stored):
        def __init__(self, df):
            super().__init__(df)
            written.append(self.rows)

    monkeypatch.setattr(clones, "Stored", Counted)
    rows = spark.range(300).selectExpr("id", "transform(sequence(1, 30), i -> concat('t', i)) as toks")
    places = rows.selectExpr("id", "id as file", "transform(toks, t -> 1) as lines")
    found = clones.families_of_texts(rows, places, spark.createDataFrame([], "file bigint, start int, end int"), 6).collect()
    assert {(r["start"], r["length"], r["members"]) for r in found} == {(0, 30, 300)} and len(found) == 300
    assert max(written) <= 3 * 300 * 30
