"""Graph loops compute their edges once, whatever the number of their rounds."""

from __future__ import annotations

import pytest

from factloom.operators import boundaries, flow, graphs

CHAIN = [(i, i + 1) for i in range(8)]


def _counted(spark, rows, schema, names):
    """The rows as a frame that counts how often each is computed."""
    seen = spark.sparkContext.accumulator(0)

    def run(parts):
        for part in parts:
            seen.add(len(part))
            yield part

    return spark.createDataFrame(rows, schema).coalesce(1).select(*names).mapInPandas(run, schema), seen


@pytest.mark.parametrize("loop", ["shortest_paths", "reachable", "cycles", "closure", "violations"])
def test_edges_of_a_long_chain_are_computed_once(spark, loop):
    edges, seen = _counted(spark, CHAIN, "src bigint, dst bigint", ["src", "dst"])
    start = spark.createDataFrame([(0,)], "node bigint")
    if loop == "shortest_paths":
        assert sorted((r.node, r.depth, r.path) for r in graphs.shortest_paths(edges, start).collect()) == [(i, i, list(range(i + 1))) for i in range(1, 9)]
    elif loop == "reachable":
        assert sorted(r.node for r in graphs.reachable(edges, start).collect()) == list(range(9))
    elif loop == "cycles":
        assert not graphs.cycles(edges, 4).collect()
    elif loop == "closure":
        assert graphs.closure(edges).count() == 36
    else:
        rules = spark.createDataFrame([("r", 0, 8, "forbidden", "transitive"), ("q", 0, 1, "forbidden", "direct"), ("s", 8, 0, "required", "direct")], "name string, src bigint, dst bigint, kind string, reach string")
        assert sorted((r.rule, r.dst) for r in boundaries.violations(edges, rules).collect()) == [("q", 1), ("r", 8), ("s", None)]
    assert seen.value == len(CHAIN)


def test_edges_of_finding_graphs_and_dead_items_are_computed_once(spark):
    edges, seen = _counted(spark, [*CHAIN, (8, 6)], "cause bigint, effect bigint", ["cause", "effect"])
    found = flow.graph_errors(spark.createDataFrame([(i,) for i in range(9)], "id bigint"), edges).collect()
    assert [(r.error, r.detail) for r in found] == [("cycle", "6 -> 7 -> 8 -> 6")] and seen.value == 9
    calls, seen = _counted(spark, [(a, b, False) for a, b in CHAIN], "src bigint, dst bigint, test boolean", ["src", "dst", "test"])
    items = spark.createDataFrame([(i, i % 2, False) for i in range(9)], "node bigint, crate int, published boolean")
    assert [r.node for r in flow.dead_items(items, calls, spark.createDataFrame([(3, False)], "node bigint, test boolean")).collect()] == [0] and seen.value == 8
