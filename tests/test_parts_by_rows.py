"""how many rows of touches one task joins doesn't grow with the table, and the stream of findings makes its touches once."""

from __future__ import annotations

import re

import __spark_entry__ as entry
from factloom.plans import catalogue

from .oracle import compare

D = "/root/testdata/sf0.01"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_partitions_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(catalogue, "parts", lambda df, real=catalogue.parts: real(df, 5000))
    n = -(-catalogue.t(spark, D, "lineitem").count() // 5000)
    assert n > 4
    for facts, keys in ((catalogue.touches, ("commit_id", "file")), (catalogue.blame, ("file",)), (catalogue.trade, ("l_orderkey",))):
        plan = _plan(facts(spark, D))
        for key in keys:
            assert re.search(rf"hashpartitioning\({key}#\d+L?, {n}\)", plan), (facts, key, plan)
    for name in ("churn_window_counts", "hotspot_top15", "ownership_fragmentation", "bus_factor", "graph_cycles_bounded"):
        if name in entry.queries():
            got, want, differ = compare(spark, D, entry.queries()[name], entry.oracle_sql()[name])
            assert got == want and not differ


def test_stream_makes_touches_once(spark, monkeypatch):
    made, real = [], catalogue.touches
    monkeypatch.setattr(catalogue, "touches", lambda *a: made.append(a) or real(*a))
    got, want, differ = compare(spark, D, entry.queries()["findings_by_rule"], entry.oracle_sql()["findings_by_rule"])
    assert got == want and not differ and len(made) == 1
