"""Reachability, components and cycles against brute force on small random graphs."""

from __future__ import annotations

import random
from itertools import permutations

import pytest

from factloom.operators import flow



def graph(spark, edges):
    return spark.createDataFrame(edges, "src string, dst string")


def reach(edges, start):
    seen, todo = set(), [start]
    while todo:
        for a, b in edges:
            if a == todo[-1] and b not in seen:
                seen.add(b)
                todo.insert(0, b)
        todo.pop()
    return seen


def random_edges(seed, nodes=9, n=14):
    rng = random.Random(seed)
    return [(rng.choice("abcdefghi"[:nodes]), rng.choice("abcdefghi"[:nodes])) for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    edges = random_edges(seed) + [("p1", "p2"), ("p2", "p3"), ("p3", "p2"), ("x", "x"), ("y", None)]
    got = {r["node"]: r["component"] for r in flow.components(graph(spark, edges)).collect()}
    nodes = {x for e in edges for x in e if x}
    whole = {n: reach(edges, n) for n in nodes}
    assert got == {n: min([n] + [m for m in whole[n] if m and n in whole.get(m, ())]) for n in nodes}


def test_simple_cycles(spark):
    edges = random_edges(3, 6, 15) + [("m", "n"), ("n", "m"), ("n", "o"), ("o", "o"), ("u", "v")]
    pairs = set(edges)
    nodes = sorted({x for e in edges for x in e})
    want = {p for k in range(1, 7) for p in permutations(nodes, k) if p[0] == min(p) and all((a, b) in pairs for a, b in zip(p, p[1:] + p[:1], strict=True))}
    got = [tuple(r["cycle"]) for r in flow.simple_cycles(graph(spark, edges)).collect()]
    assert len(got) == len(want) and set(got) == want


def test_two_rotations_are_one_cycle_and_a_shared_node_gives_two(spark):
    both = [("a", "b"), ("b", "a"), ("b", "c"), ("c", "b"), ("d", "a")]
    assert sorted(tuple(r["cycle"]) for r in flow.simple_cycles(graph(spark, both)).collect()) == [("a", "b"), ("b", "c")]
    assert flow.simple_cycles(graph(spark, [("a", "b"), ("b", "c"), ("a", "c")])).collect() == []


def brute_chain(edges, entries, node):
    """Breadth first over callers in order, as one search from the node."""
    if node in entries:
        return [node]
    seen, queue = {node}, [[node]]
    while queue:
        path = queue.pop(0)
        for caller in sorted({a for a, b in edges if b == path[-1]}):
            if caller in seen:
                continue
            seen.add(caller)
            if caller in entries:
                return [*path, caller]
            queue.append([*path, caller])
    return None


@pytest.mark.parametrize("seed", [4, 5, 6])
def test_chains_to_an_entry(spark, seed):
    edges, entries = random_edges(seed), {"a", "b"}
    edges += [("a", "q0"), *[(f"q{i}", f"q{i + 1}") for i in range(6)]]  # a chain over several doublings
    calls = spark.createDataFrame([(a, b, "static" if a < b else "dynamic") for a, b in edges], "src string, dst string, kind string")
    live = flow.live_from(calls, spark.createDataFrame([(e,) for e in entries], "node string"))
    got: dict[str, dict[int, str]] = {}
    for r in flow.chain_steps(live, live.select("node")).collect():
        assert got.setdefault(r["target"], {}).setdefault(r["step"], r["node"]) == r["node"]
    want = {n: brute_chain(edges, entries, n) for n in {x for e in edges for x in e} | entries}
    assert {n: [s[i] for i in range(len(s))] for n, s in got.items()} == {n: c for n, c in want.items() if c}


def test_dead_items(spark):
    items = [("main", "app", False), ("used", "lib", False), ("inner", "lib", False), ("helper", "lib", False), ("lonely", "lib", True), ("tested", "lib", True), ("cross", "lib", False), ("loop", "lib", False)]
    calls = [("main", "used", False), ("used", "inner", False), ("t1", "tested", True), ("t1", "helper", True), ("app_test", "cross", True), ("loop", "loop", False)]
    owners = [("app_test", "app", False), ("t1", "lib", False)]
    rows = spark.createDataFrame(items + owners, "node string, crate string, published boolean")
    found = flow.dead_items(rows, spark.createDataFrame(calls, "src string, dst string, test boolean"), spark.createDataFrame([("main", False), ("t1", True), ("app_test", True)], "node string, test boolean"))
    got = {(r["node"], r["rule"]) for r in found.collect()} - {(n, x) for n in ("t1", "app_test") for x in ("unused-pub-workspace", "test-only-pub")}
    assert got == {
        ("helper", "unused-pub-workspace"), ("helper", "test-only-pub"), ("lonely", "unused-pub-api"), ("tested", "unused-pub-api"), ("tested", "test-only-pub"),
        ("cross", "unused-pub-workspace"), ("loop", "unused-pub-workspace"),
    }


def test_masks_pass_only_where_they_may(spark):
    edges = spark.createDataFrame([("a", "b", 3), ("b", "c", 1), ("c", "a", 3), ("b", "d", 2), ("d", "c", 3), ("d", "e", 0)], "src string, dst string, mask int")
    seeds = spark.createDataFrame([("a", 1), ("b", 2), ("z", 4), ("y", 0)], "node string, mask int")
    assert {r["node"]: r["mask"] for r in flow.reach_masks(edges, seeds).collect()} == {"a": 3, "b": 3, "c": 3, "d": 2, "z": 4}


def test_graph_errors(spark):
    findings = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("a",)], "id string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "b"), ("d", "d"), ("c", "nobody")], "cause string, effect string")
    got = {tuple(r) for r in flow.graph_errors(findings, edges).collect()}
    assert got == {("duplicate_finding", "a", "2"), ("duplicate_edge", "a -> b", "2"), ("unknown_finding", "nobody", None), ("cycle", "d", "d -> d"), ("cycle", "a", "a -> b -> c -> a")}
    sound = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c")], "cause string, effect string")
    assert flow.graph_errors(findings.distinct(), sound).collect() == []


def test_empty_graphs(spark):
    none = graph(spark, [])
    assert flow.components(none).collect() == [] and flow.simple_cycles(none).collect() == []
    assert flow.live_from(none.selectExpr("*", "'x' as kind"), spark.createDataFrame([], "node string")).collect() == []
    assert flow.reach_masks(none.selectExpr("*", "1 as mask"), spark.createDataFrame([], "node string, mask int")).collect() == []
