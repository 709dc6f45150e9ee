"""The whole job against brute force, where a query's SQL covers a part of it or there is none."""

from __future__ import annotations

import random

from factloom.operators import clones, graphs, text
from factloom.plans import catalogue, clone_queries


def test_innermost_span_takes_all_parts(spark, tmp_path):
    parts = [(k, k % 50 + 1) for k in (*range(1, 60), *range(1990, 2120), *range(19_900, 20_001))]
    events = [(i, i * 7 % 120) for i in range(3000)]
    spark.createDataFrame(parts, "p_partkey bigint, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    spark.createDataFrame(events, "event_id bigint, user_id bigint").write.parquet(str(tmp_path / "events.parquet"))
    want = {}
    for event, user in events:
        around = [(size, k) for k, size in parts if k % 50 == user % 50 and k % 900 <= event % 1000 <= k % 900 + size]
        want[event] = min(around)[1] if around else None
    got = {r.event_id: r.item for r in catalogue.innermost_span(spark, str(tmp_path)).collect()}
    assert got == want and max(k or 0 for k in want.values()) > 2000


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_name_collision_from_six_letters(spark, tmp_path):
    rng = random.Random(3)
    popular = {"".join(rng.choices("abcde", k=n)) for n in (5, 6, 7, 8, 9, 10, 12) for _ in range(12)}
    names = {"".join(rng.choices("abcde", k=n)) for n in range(4, 10) for _ in range(20)} | set(sorted(popular)[:9])
    for p in sorted(popular):
        at = rng.randrange(len(p))
        names |= {p[:at] + p[at + 1 :], p[:at] + "z" + p[at:], p[:at] + "y" + p[at + 1 :]}
    for name, rows in (("documents", names), ("benchmark", popular)):
        spark.createDataFrame([(" ".join(sorted(rows)[i::3]),) for i in range(3)], "text string").write.parquet(str(tmp_path / f"{name}.parquet"))
    want = {}
    for n in names:
        near = [p for p in popular if distance(n, p) == 1]
        if len(n) >= 6 and near:
            want[n] = min(near)
    got = {r.name: r.nearest for r in catalogue.name_collision_levenshtein(spark, str(tmp_path)).collect()}
    assert got == want and {6, 7, 8, 9} <= set(map(len, want))


def pair_spans(rows: dict, least: int) -> set:
    """All maximal common spans of two rows, by brute force."""
    found = set()
    for a in rows:
        for b in (x for x in rows if x > a):
            s, u = rows[a], rows[b]
            for i in range(len(s)):
                for j in range(len(u)):
                    if s[i] == u[j] and not (i and j and s[i - 1] == u[j - 1]):
                        n = 0
                        while i + n < len(s) and j + n < len(u) and s[i + n] == u[j + n]:
                            n += 1
                        if n >= least:
                            found.add((a, b, i, j, n))
    return found


def spans_of_classes(members: list, least: int) -> set:
    """The same from classes: windows that two rows share by class, chained on diagonals."""
    hits = set()
    for x in members:
        for y in members:
            if x["class"] == y["class"] and x.id < y.id:
                assert x.length == y.length
                hits |= {(x.id, y.id, y.start - x.start, x.start + k) for k in range(x.length - least + 1)}
    found = set()
    for a, b, by, i in hits:
        if (a, b, by, i - 1) not in hits:
            n = 1
            while (a, b, by, i + n) in hits:
                n += 1
            found.add((a, b, i, i + by, n + least - 1))
    return found


def test_clone_classes_hold_every_span(spark):
    rng = random.Random(5)
    passage, other = rng.choices("abcdefgh", k=30), rng.choices("abcdefgh", k=14)
    rows = {i: rng.choices("ab", k=rng.randrange(3, 25)) for i in range(8)}
    for i in range(8, 20):
        rows[i] = rng.choices("xyz", k=i % 4) + passage[i % 3 :] + rng.choices("xyz", k=i % 3) + other * (i % 3)
    rows |= {20: rows[8], 21: rows[9][:-6] + ["q"] + rows[9][-5:], 22: ["a"] * 12, 23: ["a"] * 9}
    df = spark.createDataFrame(list(rows.items()), "id bigint, toks array<string>")
    got = clones.clone_classes(df, "mild", 5).collect()
    want = pair_spans(rows, 5)
    assert spans_of_classes(got, 5) == want and len(want) > 200
    assert {(r.a, r.b, r.a_from, r.b_from, r.length) for r in text.clone_spans(df, 5).collect()} == want


def test_clone_classes_reads_documents(spark, tmp_path):
    shared = " ".join(f"w{i}" for i in range(25))
    docs = [(k, f"x{k} {shared}\ny{k}") for k in range(300)] + [(300, "w1 w2")]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = [(r.id, r.start, r.length) for r in clone_queries.clone_classes(spark, str(tmp_path)).collect()]
    assert sorted(got) == [(k, 1, 25) for k in range(300)]


def test_clone_families(spark):
    rng = random.Random(7)
    p, q = rng.choices("abcdefgh", k=12), rng.choices("abcdefgh", k=9)
    rows = {i: rng.choices("uvw", k=i % 3) + p + rng.choices("xyz", k=i % 4) for i in range(6)}
    rows |= {6: p[2:9] + ["1"] + q, 7: ["2"] + q, 8: q + ["3"] + p, 9: ["a"] * 9, 10: ["a"] * 7}
    spans = {(i, at, n) for a, b, x, y, n in pair_spans(rows, 5) for i, at in ((a, x), (b, y))}
    kept = [s for s in spans if not any(o[0] == s[0] and o != s and o[1] <= s[1] and s[1] + s[2] <= o[1] + o[2] for o in spans)]
    want = {}
    for i, at, n in kept:
        want.setdefault(tuple(rows[i][at : at + n]), set()).add((i, at, n))
    want = sorted(sorted(m) for m in want.values() if len(m) > 1)
    df = spark.createDataFrame(list(rows.items()), "id bigint, toks array<string>")
    got, families = {}, text.clone_families(df, 5).cache()
    for r in families.collect():
        got.setdefault(r.family, set()).add((r.id, r.start, r.length))
        assert r.members == sum(x.family == r.family for x in families.collect())
    assert sorted(sorted(m) for m in got.values()) == want and max(map(len, want)) >= 3 and len(kept) < len(spans)
    alone = {r.family for r in text.isolated_families(families, spark.createDataFrame([(i, int(i == 7)) for i in range(11) if i != 10], "id bigint, references int")).collect()}
    assert alone == {f for f, m in got.items() if not {7, 10} & {i for i, *_ in m}} and alone


def test_paths_deeper_than_100(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(103)], "src int, dst int").coalesce(1).cache()
    found = graphs.shortest_paths(edges, spark.createDataFrame([(0,)], "node int").coalesce(1))
    assert {r.node: r.depth for r in found.select("node", "depth").collect()} == {i: i for i in range(1, 104)}
