"""Parsing is dealt over all tasks and done once for several tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import items, rust_source, signatures, tokens

TEXT = 'pub struct S { pub a: u8 }\n/// "two\nlines"\nimpl Drop for S { fn drop(&mut self) { let s = "a\nb"; go(r"x"); } }\npub enum E { A, B }\nfn f() -> E { E::A }\n'


def test_one_partition_of_files_is_parsed_by_several_tasks(spark):
    files = spark.range(64, numPartitions=1).select(F.col("id").cast("string").alias("file"), F.concat(F.lit(TEXT), F.col("id").cast("string")).alias("text"))
    for table in (items.item_table(files), signatures.signature_table(files), rust_source.finding_table(files)):
        assert table.withColumn("p", F.spark_partition_id()).select("p").distinct().count() > 4


def test_tables_of_one_parse_are_those_of_one_each(spark):
    files = spark.createDataFrame([("a", TEXT), ("b", None), ("c", ""), ("d", TEXT[:60])], "file string, text string")
    kinds = (items.ITEM_ROWS, items.VARIANT_ROWS, items.CONSTRUCTED_ROWS, signatures.FUNCTION_ROWS, signatures.DROP_ROWS)
    alone = (items.item_table, items.variant_table, items.constructed_table, signatures.signature_table, signatures.drop_table)
    for got, one in zip(items.tables(files, *kinds), alone, strict=True):
        want = one(files)
        assert sorted(map(repr, got.select(want.columns).collect())) == sorted(map(repr, want.collect()))


def test_lines_of_tokens_do_not_depend_on_how_they_are_found():
    simple = TEXT.replace('r"x"', "x")
    want = [(simple[a:b], simple.count("\n", 0, a) + 1) for a, b in tokens.spans(simple, docs=True)]
    assert list(tokens.with_lines(simple)) == want
    assert list(tokens.with_lines(simple + "/* x\n */ y"))[: len(want)] == want


def test_a_long_texts_hash_takes_time_by_its_length(spark):
    from time import monotonic

    from factloom.functions import names
    from tests.test_values import fnv

    words = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(30_000)), lambda i: F.concat(F.lit("é"), i.cast("string"))).alias("w"))
    began = monotonic()
    got = words.select(names.fnv1a(F.array_join(F.array_sort("w"), ","))).first()[0]
    assert monotonic() - began < 20
    assert got == fnv(",".join(sorted(f"é{i}" for i in range(1, 30_001))).encode())
