"""a short span is a row where its windows meet; of the other matches only the ends of long spans are sent on."""

from __future__ import annotations

import random

from factloom.operators import text


def _brute(texts: dict, least: int) -> set:
    out = set()
    for a, x in texts.items():
        for b, y in texts.items():
            if a < b:
                for i in range(len(x)):
                    for j in range(len(y)):
                        n = 0
                        while i + n < len(x) and j + n < len(y) and x[i + n] == y[j + n]:
                            n += 1
                        if n >= least and not (i and j and x[i - 1] == y[j - 1]):
                            out.add((a, b, i, j, n))
    return out


def test_spans_of_all_lengths(spark):
    rng = random.Random(20)
    texts = {i: [rng.choice("abc") for _ in range(rng.choice([0, 2, 3, 4, 25]))] for i in range(24)}
    for i in range(24, 36):
        source = rng.choice([t for t in texts.values() if len(t) > 20])
        at = rng.randrange(15)
        texts[i] = [rng.choice("de"), *source[at : at + rng.randrange(3, 12)], rng.choice("de")]
    want = _brute(texts, 3)
    assert {x[4] for x in want} >= {3, 4, 5, 6, 8, 9}
    rows = spark.createDataFrame(list(texts.items()), "id int, toks array<string>")
    spans = text.clone_spans(rows, 3)
    found = [(r.a, r.b, r.a_from, r.b_from, r.length) for r in spans.collect()]
    assert len(found) == len(want) and set(found) == want
    windowed = spans._jdf.queryExecution().optimizedPlan().toString().split("Union", 1)
    assert len(windowed) == 2 and "Window" not in windowed[0]
