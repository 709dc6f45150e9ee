"""pairs of a commit's groups come from the set of its groups, without a join of the touches with themselves."""

from __future__ import annotations

import random
from collections import Counter
from itertools import combinations

import __spark_entry__ as entry
from factloom.operators import history

from .oracle import compare


def test_pairs_come_from_sets(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, *range(40)]), rng.choice([None, *"abcdefg"])) for _ in range(300)]
    sets = {}
    for commit, grp in rows:
        sets.setdefault(commit, set()).add(grp)
    total = Counter(g for s in sets.values() for g in s)
    together = Counter(p for c, s in sets.items() if c is not None for p in combinations(sorted(s - {None}), 2))
    want = {(a, b, n, round(n / min(total[a], total[b]), 6)) for (a, b), n in together.items() if n >= 3 and (ord(a) - ord(b)) % 2}
    layers = spark.createDataFrame([(g, ord(g) % 2) for g in "abcdefg"], "grp string, layer int")
    found = history.change_coupling(spark.createDataFrame(rows, "commit_id int, grp string"), layers, 3, 0.0)
    assert {tuple(r) for r in found.collect()} == want and len(want) > 5
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Join" in line and "commit_id" in line]


def test_coupling_is_its_sql(spark):
    d = "/root/testdata/sf0.01"
    got, want, differ = compare(spark, d, entry.queries()["change_coupling"], entry.oracle_sql()["change_coupling"])
    assert got == want and not differ
