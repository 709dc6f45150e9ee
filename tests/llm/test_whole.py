"""Bins of many items, and insults of a small language."""

from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from factloom.llm import bin_completion, packing, string_kernel
from factloom.llm.textcore import texts_of


def test_bins_of_many_items():
    """Full bins of 4 to 10 items each: best fit needs one more, and the search finds them."""
    for seed in range(6):
        rng = random.Random(seed)
        ends = [sorted(rng.sample(range(1, 4096), rng.randint(3, 9))) for _ in range(60)]
        lengths = np.array([b - a for e in ends for a, b in zip([0, *e], [*e, 4096], strict=True)])
        found = bin_completion.bin_completion(lengths, 4096)
        assert sorted(n for b in found for n in b) == sorted(lengths.tolist()) and max(map(sum, found)) <= 4096
        assert len(found) == 60 < len(bin_completion.best_fit_decreasing(lengths, 4096))


def test_bins_of_thousands_of_short_items():
    """A bin of more items than Python's calls can be deep."""
    rng = np.random.default_rng(1)
    for lengths in (np.full(32_768, 3), rng.integers(3, 8, 32_768), rng.integers(1, 5, 32_768), rng.integers(1, 3, 32_768)):
        found = bin_completion.bin_completion(lengths, 4096)
        assert sorted(n for b in found for n in b) == sorted(lengths.tolist()) and max(map(sum, found)) <= 4096
        assert len(found) <= len(bin_completion.best_fit_decreasing(lengths, 4096))


def test_fillings_are_all_multisets():
    rng = random.Random(2)
    for _ in range(200):
        items = [rng.randint(1, 9) for _ in range(rng.randint(1, 9))]
        total = rng.randint(1, 25)
        subsets = {tuple(sorted(c, reverse=True)) for k in range(1, len(items) + 1) for c in combinations(items, k) if sum(c) == total}
        found = [tuple(n for n, times in runs for _ in range(times)) for runs in bin_completion._Search(np.array(items), 30, 10**6).exact(total)]
        assert len(found) == len(set(found)) and set(found) == subsets


def test_short_texts_are_packed(spark):
    docs = spark.range(32_768).selectExpr("id as doc_id", "'ok yes' as text")
    rows = packing.pack_documents(docs).groupBy("sequence_id").agg(F.sum("length").alias("n"), F.count("*").alias("k")).collect()
    assert sum(r["k"] for r in rows) == 32_768 and max(r["n"] for r in rows) <= 4096 and len(rows) == 25


def test_toxicity_of_a_small_language():
    """Six of 306 toxic texts are in a language with a word of its own, less than 2 %."""
    rng = random.Random(4)

    def text_of(vowels: str, insult: str) -> str:
        words = ["".join(rng.choice("bdfgklmnprst") + rng.choice(vowels) for _ in range(rng.randint(1, 4))) for _ in range(40)]
        return " ".join([*words[:20], insult, *words[20:]])

    many = [(text_of("aei", rng.choice(["worthless", "stupidly", "moronic"])), 1) for _ in range(300)]
    few = [(text_of("ou", "quixjazvy"), 1) for _ in range(12)]
    clean = [(text_of(v, "plain"), 0) for v in ("aei", "ou") for _ in range(400)]
    rows = [*many, *few[:6], *clean[20:]]
    m = string_kernel.fit(texts_of(pa.array([t for t, _ in rows])), np.array([y for _, y in rows]))
    assert (m.score(texts_of(pa.array([t for t, _ in few[6:]]))) >= 0.5).all()
    assert (m.score(texts_of(pa.array([t for t, _ in clean[:20]]))) < 0.5).all()
