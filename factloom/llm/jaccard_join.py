"""N-gram Jaccard join with token-combination prefixes.

shared_sets() gives each distinct shingle set its shared shingles in ascending frequency.
Two sets of Jaccard similarity 0.75 or more have two shingles in common within their extended
prefixes. The least frequent shingle that they have in common is in both prefixes: if it is rare, it indexes the pair alone, and the
pairs of such a shingle, FREQUENT documents at most, are all listed. If not, they have no rare shingle in common at all, and are met by
combinations of two frequent ones: linking.link() tests items against leaders of a frequent shingle's bucket first and then lists pairs that
have two such buckets in common. The combinations are counted there, since an index of them would have a row for any two of
the prefix's shingles, whose number grows with the square of a text's length. Candidates
are verified exactly, and links are joined into components. Equal sets are one item throughout.

Defined cases: null and empty texts have no shingles, link with nothing and are their own
component. Texts of fewer than five words have their whole word sequence as one shingle.
Repeated rows (same doc_id) are one document each and link with each other, and different texts under one doc_id link each for itself.
A null doc_id is compared like any other, but never names a component unless all its members are null. An empty table gives an
empty result. Columns other than doc_id and text are not read. keep_first() passes all columns through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import clear_names, kept
from .linking import link
from .shingle_sets import PERCENT, SHINGLE, shared_sets


def _named_rows(docs: DataFrame, percent: int, n: int) -> DataFrame:
    """doc_id, text_key, n, node (null without shingles), component: a row for each document; equal sets are one node."""
    rows = kept(shared_sets(docs, percent, n))
    # a set's tokens are asked of every chunk that has it and are equal in all
    first = [F.first(c, ignorenulls=True).alias(c) for c in ("tokens", "r", "prefix", "rare")]
    sets = kept(rows.where("n > 0").groupBy("f1", "f2", "n").agg(*first).withColumn("id", F.monotonically_increasing_id()))
    some = sets.where("tokens is not null").select("id", "n", "tokens", "r", "prefix", "rare", (F.col("n") - F.octet_length("tokens") / 8).cast("bigint").alias("own"), F.lit(0).alias("near"))
    rare = some.select("id", F.explode(F.expr("slice(prefix, 1, int(rare))")).alias("key")).select("key", "id")
    often = some.select("id", F.explode(F.expr("slice(prefix, int(rare) + 1, size(prefix))")).alias("key")).select("key", "id")
    _, labels = link(often, some, percent, small=rare, counted=2)
    named = sets.select("f1", "f2", "n", "id").join(labels.withColumnRenamed("node", "id"), "id", "left")
    named = named.select("f1", "f2", "n", F.col("id").alias("node"), F.coalesce("component", "id").alias("component"))
    return rows.select("doc_id", "text_key", "n", "f1", "f2").join(named, ["f1", "f2", "n"], "left").drop("f1", "f2")


def jaccard_components(docs: DataFrame, percent: int = PERCENT, n: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id: a row for each document."""
    rows = kept(_named_rows(docs, percent, n))
    least = rows.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    full = rows.join(least, "component", "left")
    return full.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_first(docs: DataFrame, percent: int = PERCENT, n: int = SHINGLE) -> DataFrame:
    """One document of each component: the one with the least doc_id (null last, ties by the text's hash), once even if its row is repeated."""
    doc, key, row = clear_names(docs, "doc", "key", "row")
    null = F.lit(-(1 << 63))
    rows = kept(_named_rows(docs, percent, n))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("m")
    names = rows.where("component is not null").groupBy("component").agg(first).select("m.doc_id", "m.text_key")
    names = names.unionByName(rows.where("component is null").select("doc_id", "text_key"))
    names = names.select(F.coalesce("doc_id", null).alias(doc), F.col("text_key").alias(key)).distinct()
    keyed = docs.withColumns({doc: F.coalesce(F.col("doc_id").cast("bigint"), null), key: F.xxhash64(F.col("text").cast("string"))})
    one = keyed.join(names.hint("shuffle_hash"), [doc, key], "left_semi").groupBy(doc, key).agg(F.first(F.struct(*docs.columns)).alias(row))
    return one.select(f"{row}.*")
