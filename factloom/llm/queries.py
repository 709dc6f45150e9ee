"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import score_quality_rules

    return score_quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import line_digest

    return line_digest(table(spark, sf_dir, "documents"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import substring_digest

    return substring_digest(table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_classifier import QualityClassifier

    docs = table(spark, sf_dir, "documents")
    return QualityClassifier.fit(docs, table(spark, sf_dir, "labels")).score_documents(docs)


def op7_direct_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .direct_codes import write_and_read

    return write_and_read(table(spark, sf_dir, "documents"))


def op10_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentence_pieces import encoding_digest

    return encoding_digest(table(spark, sf_dir, "documents"))


def op9_matroska_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import media_digest

    return media_digest(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import Toxicity

    docs = table(spark, sf_dir, "documents")
    return Toxicity.fit(docs, table(spark, sf_dir, "labels")).score_documents(docs)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .importance import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_templates import judged, labelled_pages

    pages = table(spark, sf_dir, "pages")
    return judged(pages, labelled_pages(pages, table(spark, sf_dir, "labels"))).withColumn("purity", F.round("purity", 6))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import spelling_variants

    return spelling_variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_line_dedup": op3_line_dedup,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_direct_codes": op7_direct_codes,
    "op8_toxicity": op8_toxicity,
    "op9_matroska_media": op9_matroska_media,
    "op10_sentence_pieces": op10_sentence_pieces,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_url_filters": op12_url_filters,
    "op13_spelling_variants": op13_spelling_variants,
}
ORACLES: dict[str, str] = {
    "op11_importance_resampling": oracles.OP11,
    "op12_url_filters": oracles.OP12,
    "op13_spelling_variants": oracles.OP13,
}
