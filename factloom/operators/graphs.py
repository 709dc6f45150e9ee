"""Graph operators over edges (src, dst): reachability, shortest paths, cycles, closure, boundary rules.

Frontier loops: the edges are written once, however they were made; each step joins the frontier with them, drops what is
known and is written too, so lineage stays short and a lost executor costs one step.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import Stored


def shortest_paths(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """start, node, depth, path of every node reachable from each start (column node); the start itself only over a cycle.

    Of paths of equal length the least in order of nodes is kept.
    """
    e = Stored(edges.select("src", "dst").distinct())
    frontier = Stored(starts.select(F.col("node").alias("start"), "node", F.array("node").alias("path")).distinct())
    known: Stored | None = None
    for depth in count(1):
        step = frontier.frame.join(e.frame, F.col("node") == F.col("src")).groupBy("start", F.col("dst").alias("node")).agg(F.min(F.concat("path", F.array("dst"))).alias("path"))
        if known is not None:
            step = step.join(known.frame.select("start", "node"), ["start", "node"], "left_anti")
        fresh = Stored(step)
        frontier.drop()
        frontier = fresh
        if not frontier.rows:
            break
        layer = frontier.frame.withColumn("depth", F.lit(depth))
        grown = Stored(layer if known is None else known.frame.unionByName(layer))
        if known is not None:
            known.drop()
        known = grown
    e.drop()
    return known.frame if known is not None else frontier.frame.withColumn("depth", F.lit(0))


def closure(edges: DataFrame) -> DataFrame:
    """src, dst: all pairs that a path joins, a node with itself over a cycle. Each round joins what is known with itself, so rounds grow with the logarithm of the depth."""
    known = Stored(edges.select("src", "dst").distinct())
    while True:
        further = known.frame.select("src", F.col("dst").alias("via")).join(known.frame.select(F.col("src").alias("via"), "dst"), "via").select("src", "dst")
        grown = Stored(known.frame.unionByName(further).distinct())
        ended = grown.rows == known.rows
        known.drop()
        known = grown
        if ended:
            return known.frame


def closure_size(edges: DataFrame) -> DataFrame:
    """node, reachable: how many nodes it reaches; itself counts if it lies on a cycle."""
    edges = Stored(edges.select("src", "dst").distinct()).frame
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    counts = closure(edges).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("reachable"))
    return nodes.join(counts, "node", "left").select("node", F.coalesce("reachable", F.lit(0)).alias("reachable"))


def reachable(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """Nodes reached from any start, starts included."""
    e = Stored(edges.select("src", "dst").distinct())
    found = frontier = Stored(starts.select("node").distinct())
    while True:
        more = frontier.frame.join(e.frame, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct().join(found.frame, "node", "left_anti")
        fresh = Stored(more)
        if not fresh.rows:
            e.drop()
            return found.frame
        grown = Stored(found.frame.unionByName(fresh.frame))
        found.drop()
        if frontier is not found:
            frontier.drop()
        found, frontier = grown, fresh


def cycles(edges: DataFrame, longest: int) -> DataFrame:
    """cycle (nodes from its least one, comma-joined), length: all simple cycles up to a length. The bound is part of the result's meaning."""
    e = Stored(edges.select("src", "dst").distinct()).frame
    paths = e.where("src <= dst").select(F.col("src").alias("root"), "dst", F.array("src").alias("path"))
    found: list[DataFrame] = []
    for n in range(1, longest + 1):
        paths = Stored(paths).frame
        found.append(paths.where("dst = root").select(F.array_join(F.transform("path", lambda x: x.cast("string")), ",").alias("cycle"), F.lit(n).alias("length")))
        if n < longest:
            grown = paths.where("dst > root").join(e.withColumnsRenamed({"src": "s", "dst": "d"}), F.col("dst") == F.col("s"))
            paths = grown.where("d >= root and not array_contains(path, dst)").select("root", F.col("d").alias("dst"), F.concat("path", F.array("dst")).alias("path"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.distinct()


def forbidden_edges(edges: DataFrame, layers: DataFrame) -> DataFrame:
    """Direct edges from an inner to an outer layer. layers: node, layer."""
    a, b = layers.select(F.col("node").alias("src"), F.col("layer").alias("src_layer")), layers.select(F.col("node").alias("dst"), F.col("layer").alias("dst_layer"))
    return edges.select("src", "dst").distinct().join(a, "src").join(b, "dst").where("src_layer < dst_layer")


def forbidden_paths(edges: DataFrame, layers: DataFrame) -> DataFrame:
    """The shortest path from each node to each node of an outer layer that it reaches."""
    nodes = layers.select("node")
    a, b = layers.select(F.col("node").alias("start"), F.col("layer").alias("src_layer")), layers.select("node", F.col("layer").alias("dst_layer"))
    return shortest_paths(edges, nodes).join(a, "start").join(b, "node").where("src_layer < dst_layer").select("start", "node", "depth", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


def missing_required(edges: DataFrame, rules: DataFrame) -> DataFrame:
    """Nodes (src) that have an edge to none of the nodes that a rule (src, required) lists: any one satisfies it."""
    met = rules.join(edges.select("src", F.col("dst").alias("required")).distinct(), ["src", "required"], "left_semi").select("src").distinct()
    return rules.select("src").distinct().join(met, "src", "left_anti")


def dot(edges: DataFrame) -> DataFrame:
    """One row: the graph in Graphviz DOT, edges sorted."""
    line = F.concat(F.lit('  "'), F.col("src").cast("string"), F.lit('" -> "'), F.col("dst").cast("string"), F.lit('";'))
    rows = edges.select("src", "dst").distinct().agg(F.array_sort(F.collect_list(line)).alias("l"))
    return rows.select(F.concat(F.lit("digraph {\n"), F.array_join("l", "\n"), F.lit("\n}\n")).alias("dot"))


def mermaid(edges: DataFrame) -> DataFrame:
    """One row: the graph in Mermaid, with node ids of letters, digits and underscores."""
    name = lambda c: F.regexp_replace(F.col(c).cast("string"), "[^A-Za-z0-9]", "_")
    line = F.concat(F.lit("  "), name("src"), F.lit(" --> "), name("dst"))
    rows = edges.select("src", "dst").distinct().agg(F.array_sort(F.collect_list(line)).alias("l"))
    return rows.select(F.concat(F.lit("graph TD\n"), F.array_join("l", "\n"), F.lit("\n")).alias("mermaid"))
