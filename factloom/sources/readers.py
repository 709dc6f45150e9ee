"""Readers: source trees, LCOV reports, audit reports, configuration and baselines."""

from __future__ import annotations

import tomllib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.rust_source import source_kind
from ..operators.findings import migrated

FINDING = "id string, rule string, severity string, location struct<file: string, line: int, item_path: string>, evidence_class string, origin string, evidence string, caused_by array<string>, causes array<string>"


def source_files(spark: SparkSession, root: str) -> DataFrame:
    """file, text, kind of all Rust files below root, without build output, dot folders and packages nested in it (folders with a manifest of their own)."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.rs").option("wholetext", True).text(root).withColumn("file", F.col("_metadata.file_path"))
    rel = F.regexp_replace("file", r"^file:/+", "/")
    files = rows.select(rel.alias("file"), F.col("value").alias("text")).where(~F.col("file").rlike(r"/(target|\.[^/]+)/")).withColumn("kind", source_kind("text"))
    top = root.removeprefix("file://").rstrip("/")
    manifests = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "Cargo.toml").load(root).select(F.regexp_replace("path", r"^file:/+", "/").alias("m"))
    nested = manifests.select(F.regexp_replace("m", "[^/]*$", "").alias("folder")).where(F.col("folder") != f"{top}/")
    # each file asks for its own folders, so files and manifests meet on equal folders
    parts = F.split("file", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/")))
    within = files.select("file", F.explode(above).alias("folder")).join(nested, "folder", "left_semi").select("file").distinct()
    return files.join(within, "file", "left_anti")


def lcov(spark: SparkSession, path: str, root: str = "") -> DataFrame:
    """file, line, hits of an LCOV report. Malformed DA records are skipped; of several for a line the last counts."""
    rows = spark.read.option("wholetext", True).text(path).select(F.posexplode(F.split("value", "\n")).alias("n", "s"), F.col("_metadata.file_path").alias("report"))
    order = Window.partitionBy("report").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    name = F.when(F.col("s").startswith("SF:"), F.expr("substring(s, 4)")).when(F.col("s").startswith("end_of_record"), F.lit(""))
    held = rows.withColumn("sf", F.last(name, ignorenulls=True).over(order)).where("sf <> ''")
    file = F.regexp_replace(F.regexp_replace("sf", f"^{root.rstrip('/')}/" if root else "^$", ""), r"^(\./)+", "")
    da = held.select("report", "n", file.alias("file"), F.regexp_extract("s", r"^DA:(\d+),(\d+)", 1).alias("l"), F.regexp_extract("s", r"^DA:(\d+),(\d+)", 2).alias("h")).where("l <> ''")
    return da.groupBy("file", F.col("l").cast("int").alias("line")).agg(F.max_by(F.col("h").cast("long"), F.struct("report", "n")).alias("hits"))


def audit(spark: SparkSession, path: str) -> DataFrame:
    """id, name, version, title of an audit report's vulnerabilities; entries without an id or a package are skipped."""
    schema = "vulnerabilities struct<list: array<struct<advisory: struct<id: string, title: string, url: string>, package: struct<name: string, version: string>>>>"
    v = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("vulnerabilities.list").alias("v"))
    return v.select(F.col("v.advisory.id").alias("id"), F.col("v.package.name").alias("name"), F.col("v.package.version").alias("version"), F.col("v.advisory.title").alias("title")).where("id is not null and name is not null")


def config(text: str) -> dict:
    """Boundary rules, layers, profiles and labels of a TOML configuration."""
    return tomllib.loads(text)


def baseline(spark: SparkSession, path: str) -> DataFrame:
    """Findings of a saved baseline (one JSON text with schema_version and findings), of the first schema too; other versions give none."""
    schema = f"schema_version int, findings array<struct<{FINDING}>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    return migrated(rows.select("schema_version", F.inline("findings")))


def config_tables(spark: SparkSession, text: str) -> dict[str, DataFrame]:
    """The rule tables of a configuration: boundaries (name, src, dst, kind, reach, allow_empty), modules (name, below, forbidden), assigned (node, grp), layers (preset),
    profiles (ord, krate, multiplier), labels (ord, label, needle, place: trailer or email), internal (krate).

    A boundary without a reach, or with another than direct and transitive, is an error.
    """
    c = config(text)
    for r in c.get("boundary", []):
        if r.get("reach") not in ("direct", "transitive"):
            raise ValueError(f"boundary {r.get('name')}: reach must be direct or transitive")
    pairs = [(r["name"], a, b, kind, r["reach"], bool(r.get("allow_empty", False))) for r in c.get("boundary", []) for kind in ("forbidden", "required") for a in r.get("from", []) for b in r.get(kind, [])]
    modules = [(r["name"], r["from"], f) for r in c.get("module_boundary", []) for f in r.get("forbidden", [])]
    profiles = [(i, k, float(p.get("deduction_multiplier", 1))) for i, p in enumerate(c.get("crate_profile", [])) for k in p.get("crates", [])]
    places = (("trailer", "trailer_contains"), ("email", "author_email_contains"))
    labels = [(i, x["name"], m, place) for i, x in enumerate(c.get("provenance_label", [])) for place, key in places for m in x.get(key, [])]
    layers = c.get("layers", {})
    make = spark.createDataFrame
    return {
        "boundaries": make(pairs, "name string, src string, dst string, kind string, reach string, allow_empty boolean"),
        "modules": make(modules, "name string, below string, forbidden string"),
        "assigned": make(list(layers.get("assign", {}).items()), "node string, grp string"),
        "profiles": make(profiles, "ord int, krate string, multiplier double"),
        "layers": make([(layers["preset"],)] if "preset" in layers else [], "preset string"),
        "labels": make(labels, "ord int, label string, needle string, place string"),
        "internal": make([(k,) for k in c.get("internal_crates", [])], "krate string"),
    }


def unknown_names(tables: dict[str, DataFrame], known: DataFrame) -> DataFrame:
    """name, krate: crates that a boundary (but with allow_empty) or the internal ones (name: internal_crates) name and that known (krate) has not."""
    b = tables["boundaries"].where("not allow_empty")
    named = b.select("name", F.col("src").alias("krate")).union(b.select("name", "dst")).union(tables["internal"].select(F.lit("internal_crates"), "krate")).distinct()
    return named.join(known.select("krate"), "krate", "left_anti").select("name", "krate")
