"""The corpus pipeline against brute force, stage after stage."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from factloom.llm import common
from factloom.llm.quality_classifier import QualityClassifier

from . import brute
from .test_edges import prose

pytest.importorskip("public_tokenizers")


def corpus():
    rng = random.Random(12)
    docs = [(i, "\n".join(prose(rng, rng.randint(20, 60)) for _ in range(3))) for i in range(40)]
    passage = prose(rng, 30)
    docs += [(i, f"{prose(rng, 40)} {passage} {prose(rng, 40)}") for i in range(40, 46)]
    docs += [(i, docs[i - 46][1] + " " + prose(rng, 2)) for i in range(46, 52)]  # near copies
    docs += [(52, docs[0][1]), (53, None), (54, ""), (55, "#$% | " * 80), (56, "#&* < " * 90)]
    return docs


def rejected(spark, docs, folder):
    model = QualityClassifier.fit(docs, common.table(spark, folder, "labels"))
    return {r.doc_id for r in model.score_documents(docs).collect() if r.score < 0.7}


def test_stages_equal_brute_force(spark, tmp_path):
    rows = corpus()
    again = [rows[3], rows[3]]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x") for i, t in rows + again], "doc_id bigint, text string, lang string, source string, n_chars int, __key string")
    labels = spark.createDataFrame([(i, int(i < 53)) for i in range(57)], "doc_id bigint, quality int")
    docs.write.parquet(str(tmp_path / "documents.parquet")), labels.write.parquet(str(tmp_path / "labels.parquet"))
    folder, held = str(tmp_path), common.written()
    stages = dict(corpus_pipeline.STAGES)
    table = common.table(spark, folder, "documents")

    bad = rejected(spark, table, folder)
    assert bad and not bad & set(range(53))
    one = stages["quality_classifier"](spark, table, folder)
    left = {i: t for i, t in rows if i not in bad}
    assert {r.doc_id: r.text for r in one.collect()} == left and one.count() == len(left) + 2

    two = common.kept(stages["line_dedup"](spark, one, folder))
    gone = brute.removed_lines(list(left.items()))
    left = {i: t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in left.items()}
    assert {r.doc_id: r.text for r in two.collect()} == left

    three = common.kept(stages["jaccard_join"](spark, two, folder))
    groups = brute.jaccard_components(list(left.items()))
    left = {i: t for i, t in left.items() if groups[i][1] == i}
    assert sorted((r.doc_id, r.text or "") for r in three.collect()) == sorted((i, t or "") for i, t in left.items())

    four = stages["substring_dedup"](spark, three, folder)
    cut = brute.cut_repeats(list(left.items()))
    assert {r.doc_id: len(brute.WORD.findall(r.text or "")) for r in four.collect()} == {i: n - m for i, (n, m, _) in cut.items()}
    assert all(x.columns == table.columns for x in (one, two, three, four))

    five = {r.doc_id for r in corpus_pipeline.run(spark, folder).select("doc_id").collect()}
    assert five == set(left)
    common.release(spark, held)
    assert common.written() == held


def test_an_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1)], "doc_id bigint, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
