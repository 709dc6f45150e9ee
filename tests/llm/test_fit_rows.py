"""Box and threshold of the quality rules come from all labelled rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from factloom.llm.iforest import calibrate, calibrate_counts
from factloom.llm.quality_rules import BINS, RULES, QualityRules, _steps


def test_threshold_counts_rows_beyond_those_that_trees_draw_from(spark):
    x = F.array(*(F.when((F.col("id") % 50 == 0) & (F.lit(i) == 0), 9.0).otherwise(F.rand(i)) for i in range(len(RULES))))
    stats = spark.range(4000).select(F.col("id").alias("doc_id"), x.alias("x"))
    labels = stats.select("doc_id", (F.col("doc_id") % 50 != 0).cast("int").alias("quality"))
    few = QualityRules.fit(stats, labels, trees=16, subsample=64, drawn=100)
    rows = stats.join(labels, "doc_id").where("crc32(cast(doc_id as string)) % 4 <> 2").toArrow()
    score, y = few.forest.score(np.array(rows["x"].to_pylist())), rows["quality"].to_numpy()
    assert abs(few.threshold - calibrate(score, y == 1)) < 0.03
    assert (score[y == 1] <= few.threshold).mean() >= 0.995 and (score[y == 0] > few.threshold).mean() > 0.9
    assert few.forest.split.max() > 1  # cuts span the box of all labelled rows


def test_counts_calibrate_as_rows_do():
    rng = np.random.default_rng(1)
    score = np.round(rng.random(3000), 3)
    good = rng.random(3000) < 1.2 - score
    steps = _steps(score)
    at = np.unique(steps)
    step = calibrate_counts(at, np.array([(good & (steps == s)).sum() for s in at]), np.array([(~good & (steps == s)).sum() for s in at]))
    kept = score <= (step + 1) / BINS
    want = score <= calibrate(score, good)
    cost = lambda k: (k & ~good).sum() / (~good).sum() + (~k & good).sum() / good.sum()
    assert kept[good].mean() >= 0.995 and cost(kept) <= cost(want) + 1e-9
    assert calibrate_counts(at, np.zeros(len(at)), np.ones(len(at))) is None
