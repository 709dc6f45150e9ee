"""The corpus pipeline: five stages over documents, each the whole of what the one before kept.

Quality classifier, line dedup, n-gram Jaccard join, substring dedup, best-fit packing. All but the last
return the columns of documents; the last returns the packed pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factloom.llm.common import kept, release_all_but_last, table, written
from factloom.llm.jaccard_join import keep_first
from factloom.llm.line_dedup import remove_lines
from factloom.llm.packing import pack_documents
from factloom.llm.quality_classifier import QualityClassifier
from factloom.llm.substring_dedup import remove_repeats


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, doesn't reject.

    Null and empty texts are scored by their zero statistics. Rows of equal text are kept or dropped alike, an empty table stays empty,
    all columns pass through, and without labels every document is dropped that scores under the threshold, which 0.5 does.
    """
    return QualityClassifier.fit(docs, table(spark, sf_dir, "labels")).keep_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat, exactly or nearly, an earlier one in order of (doc_id, text hash, line), null ids first.

    Null and empty texts stay. Rows of equal id and text are one document's copies and are cut alike.
    """
    return remove_lines(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of the least id, null last, ties by the text's hash.

    Null and empty texts link with nothing and stay; a repeated row stays once.
    """
    return keep_first(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 13 words or more that a document of a smaller id (null is the smallest) has.

    Null and empty texts and those without a repeat stay as they are; others are their words joined by one space.
    """
    return remove_repeats(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and the sequences that they are packed into. A null or empty text is one end token; repeated rows are packed each for itself."""
    return pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("jaccard_join", jaccard_join),
    ("substring_dedup", substring_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: A fitted model and a tokenizer are stages, which SQL can't express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each result written to the shared folder as Parquet and read by the next.

    What a stage has left in the shared folder goes when its result is written; what the last one reads stays until common.release().
    """
    docs, first = table(spark, sf_dir, "documents"), written()
    for _, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir))
        release_all_but_last(spark, first)
    return STAGES[-1][1](spark, docs, sf_dir)
