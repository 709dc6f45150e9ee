"""Reachability with parents and masks, strongly connected components and cycles, over edges (src, dst) of any number.

Every loop sends a frontier along the edges, keeps a row a node, and writes it to the shared folder; a table of an earlier round is
deleted when the next is there. Rounds grow with the longest shortest path that a loop follows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import Stored


def live_from(calls: DataFrame, entries: DataFrame) -> DataFrame:
    """node, depth, caller, kind of every node that a chain of calls joins with an entry (column node): depth 0 and no caller for entries.

    calls: src, dst and kind, the caller's least kind if it calls twice. caller is the least of those that are one call nearer to an
    entry, so going from caller to caller gives the shortest chain, of several the least in order of callers from the node outwards.
    Null nodes are none. A node without a row is not reachable.
    """
    e = Stored(calls.where("src is not null and dst is not null").groupBy("src", "dst").agg(F.min("kind").alias("kind")))
    begun = entries.where("node is not null").select("node").distinct().withColumns({"depth": F.lit(0), "caller": F.lit(None).cast(e.frame.schema["src"].dataType), "kind": F.lit(None).cast("string")})
    known = frontier = Stored(begun)
    depth = 0
    while frontier.rows:
        depth += 1
        found = frontier.frame.select(F.col("node").alias("src")).join(e.frame, "src").groupBy(F.col("dst").alias("node")).agg(F.min(F.struct("src", "kind")).alias("c"))
        fresh = found.join(known.frame.select("node"), "node", "left_anti")
        step = Stored(fresh.select("node", F.lit(depth).alias("depth"), F.col("c.src").alias("caller"), F.col("c.kind").alias("kind")))
        grown = Stored(known.frame.unionByName(step.frame)) if step.rows else known
        if frontier is not known:
            frontier.drop()
        if grown is not known:
            known.drop()
        known, frontier = grown, step
    return known.frame


def chain_steps(live: DataFrame, targets: DataFrame) -> DataFrame:
    """target, step, node: the chain of each live target (column node) from itself at step 0 to its entry, a row a step.

    live: node, depth, caller, as live_from() gives it. By doubling: after a round all steps under twice as many are known, as each
    node's caller of twice as many steps is; rows are those of the result and one a node.
    """
    want = targets.select("node").distinct().join(live.select("node", "depth"), "node")
    deepest = want.agg(F.max("depth").alias("d")).first()["d"] or 0
    steps = want.select(F.col("node").alias("target"), F.lit(0).alias("step"), "node")
    up = Stored(live.where("caller is not null").select("node", F.col("caller").alias("to")))
    known, reach = Stored(steps), 1
    while reach <= deepest:
        more = known.frame.join(up.frame, "node").select("target", (F.col("step") + reach).alias("step"), F.col("to").alias("node"))
        grown = Stored(known.frame.unionByName(more))
        further = Stored(up.frame.join(up.frame.select(F.col("node").alias("to"), F.col("to").alias("beyond")), "to").select("node", F.col("beyond").alias("to")))
        known.drop(), up.drop()
        known, up, reach = grown, further, 2 * reach
    up.drop()
    return known.frame


def reach_masks(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """node, mask: the bits that arrive at a node. seeds: node, mask. edges: src, dst, mask, the bits that may pass.

    One loop for all bits: a node is sent on only with the bits that are new to it, and each bit at most once.
    """
    e = edges.groupBy("src", "dst").agg(F.bit_or("mask").alias("may"))
    known = frontier = Stored(seeds.where("node is not null").groupBy("node").agg(F.bit_or("mask").alias("mask")).where("mask <> 0"))
    while frontier.rows:
        sent = frontier.frame.join(e, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), F.col("mask").bitwiseAND(F.col("may")).alias("mask"))
        arrived = sent.where("mask <> 0").groupBy("node").agg(F.bit_or("mask").alias("mask"))
        had = known.frame.select("node", F.col("mask").alias("had"))
        fresh = arrived.join(had, "node", "left").select("node", F.col("mask").bitwiseAND(F.bitwise_not(F.coalesce("had", F.lit(0)))).alias("mask"))
        step = Stored(fresh.where("mask <> 0"))
        grown = Stored(known.frame.unionByName(step.frame).groupBy("node").agg(F.bit_or("mask").alias("mask"))) if step.rows else known
        if frontier is not known:
            frontier.drop()
        if grown is not known:
            known.drop()
        known, frontier = grown, step
    return known.frame


#: Bits of reach_masks(): reached from a production entry without test code, reached at all; used by another crate's production code, by any code of another crate.
PRODUCTION, ANY, USED, USED_BY_ANY = 1, 2, 4, 8


def item_masks(items: DataFrame, calls: DataFrame, entries: DataFrame) -> DataFrame:
    """The columns of items (node, crate, ...) and mask. calls: src, dst, test (the call is in test code). entries: node, test."""
    bits = lambda test: F.when(F.col(test), ANY).otherwise(PRODUCTION | ANY)
    reached = reach_masks(calls.select("src", "dst", bits("test").alias("mask")), entries.select("node", bits("test").alias("mask")))
    owner = items.select("node", "crate")
    used = calls.join(owner.withColumnsRenamed({"node": "src", "crate": "by"}), "src").join(owner.withColumnsRenamed({"node": "dst"}), "dst").where("by <> crate")
    used = used.select(F.col("dst").alias("node"), F.when(F.col("test"), USED_BY_ANY).otherwise(USED | USED_BY_ANY).alias("mask"))
    masks = reached.unionByName(used).groupBy("node").agg(F.bit_or("mask").alias("mask"))
    return items.join(masks, "node", "left").withColumn("mask", F.coalesce("mask", F.lit(0)))


def dead_items(items: DataFrame, calls: DataFrame, entries: DataFrame) -> DataFrame:
    """node, crate, rule of public items that nothing outside their crate uses: unused-pub-workspace, or unused-pub-api where the crate is
    published, if no production entry reaches them; test-only-pub if only tests do, and no other crate's tests use them.

    items: node, crate, published, the public ones. Items of one node stand once. The two rules can both hold.
    """
    m = item_masks(items.dropDuplicates(["node"]), Stored(calls.select("src", "dst", "test")).frame, entries)
    has = lambda bit: F.col("mask").bitwiseAND(F.lit(bit)) != 0
    unused = F.when(~has(USED) & ~has(PRODUCTION), F.when(F.col("published"), "unused-pub-api").otherwise("unused-pub-workspace"))
    tests = F.when(~has(USED_BY_ANY) & ~has(PRODUCTION) & has(ANY), F.lit("test-only-pub"))
    return m.select("node", "crate", F.explode(F.array_compact(F.array(unused, tests))).alias("rule"))


def components(edges: DataFrame) -> DataFrame:
    """node, component of every end of an edge: its strongly connected component, named by its least node.

    Rounds of three steps until no edge is left. Trimming: a node without a way in or out is a component alone. Colouring: each node takes the least node
    that reaches it. Backwards: what reaches a colour's own node within the colour is that node's component. A round settles a component a colour, so
    rounds follow the depth of the graph of components, and nodes settled leave with their edges.
    """
    ends = edges.select(F.col("src").alias("node")).union(edges.select("dst")).where("node is not null").distinct()
    left = Stored(edges.where("src <> dst").select("src", "dst").distinct())
    settled: list[Stored] = []
    while True:
        left = _trimmed(left)
        if not left.rows:
            break
        colours = _coloured(left.frame)
        found = Stored(_back_within(left.frame, colours))
        settled.append(found)
        gone = found.frame.select("node")
        rest = left.frame.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti")
        smaller = Stored(rest.select("src", "dst"))
        left.drop()
        left = smaller
    out = ends.withColumn("component", F.col("node"))
    for s in settled:  # every node is settled at most once
        named = s.frame.withColumnRenamed("component", "named")
        out = out.join(named, "node", "left").select("node", F.coalesce("named", "component").alias("component"))
    return out


def _trimmed(left: Stored) -> Stored:
    """Without edges from a node that none goes to, or to one that none leaves, as long as a pass takes a sixteenth of them."""
    while left.rows:
        leaves, arrives = left.frame.select(F.col("src").alias("dst")).distinct(), left.frame.select(F.col("dst").alias("src")).distinct()
        smaller = Stored(left.frame.join(leaves, "dst", "left_semi").join(arrives, "src", "left_semi").select("src", "dst"))
        enough = smaller.rows * 16 > left.rows * 15
        left.drop()
        left = smaller
        if enough:
            break
    return left


def _coloured(e: DataFrame) -> DataFrame:
    """node, colour: the least node that reaches it, itself included."""
    colours = frontier = Stored(e.select(F.col("src").alias("node")).union(e.select("dst")).distinct().withColumn("colour", F.col("node")))
    while frontier.rows:
        sent = frontier.frame.join(e, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("new"))
        better = Stored(sent.join(colours.frame, "node").where("new < colour").select("node", F.col("new").alias("colour")))
        grown = Stored(colours.frame.unionByName(better.frame).groupBy("node").agg(F.min("colour").alias("colour"))) if better.rows else colours
        if frontier is not colours:
            frontier.drop()
        if grown is not colours:
            colours.drop()
        colours, frontier = grown, better
    return colours.frame


def _back_within(e: DataFrame, colours: DataFrame) -> DataFrame:
    """node, component: what reaches a colour's own node by nodes of that colour."""
    a, b = colours.withColumnsRenamed({"node": "src", "colour": "from"}), colours.withColumnsRenamed({"node": "dst", "colour": "to"})
    inner = Stored(e.join(a, "src").join(b, "dst").where("from = to").select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("").alias("kind")))
    members = live_from(inner.frame, colours.where("node = colour").select("node"))
    return members.select("node").join(colours, "node").select("node", F.col("colour").alias("component"))


def inner_edges(edges: DataFrame, comps: DataFrame) -> DataFrame:
    """src, dst, component of the edges that can lie on a cycle: within a component, or from a node to itself."""
    a, b = comps.withColumnsRenamed({"node": "src"}), comps.withColumnsRenamed({"node": "dst", "component": "other"})
    return edges.select("src", "dst").distinct().join(a, "src").join(b, "dst").where("component = other").select("src", "dst", "component")


def simple_cycles(edges: DataFrame) -> DataFrame:
    """cycle (nodes from its least one, as an array), length: all simple cycles, however long.

    Only edges within strongly connected components are followed, from each cycle's least node. There can be exponentially many cycles, and
    then the result and the paths that lead to it are.
    """
    inner = Stored(inner_edges(edges, components(edges)).select("src", "dst")).frame
    paths = Stored(inner.where("src <= dst").select(F.col("src").alias("root"), "dst", F.array("src").alias("path")))
    found: list[DataFrame] = []
    while paths.rows:
        found.append(paths.frame.where("dst = root").select(F.col("path").alias("cycle")))
        on = inner.withColumnsRenamed({"src": "at", "dst": "next"})
        grown = paths.frame.where("dst > root").join(on, F.col("dst") == F.col("at")).where("next = root or (next > root and next <> dst and not array_contains(path, next))")
        paths = Stored(grown.select("root", F.col("next").alias("dst"), F.concat("path", F.array("dst")).alias("path")))
    out = found[0] if found else paths.frame.select(F.col("path").alias("cycle"))
    for f in found[1:]:
        out = out.unionByName(f)
    return out.select("cycle", F.size("cycle").alias("length"))


def named_cycles(edges: DataFrame) -> DataFrame:
    """component, cycle: of each component with a cycle one through its least node, as an array that begins and ends with it.

    A node with an edge to itself gives that; else it is the shortest, of several the one whose last node is least.
    """
    edges = Stored(edges.select("src", "dst").distinct()).frame
    inner = Stored(inner_edges(edges, components(edges))).frame
    roots = inner.select(F.col("component").alias("node")).distinct()
    live = live_from(inner.select("src", "dst", F.lit("").alias("kind")), roots)
    closing = inner.where("dst = component").join(live.select(F.col("node").alias("src"), "depth"), "src").groupBy("component").agg(F.min(F.struct("depth", "src")).alias("c"))
    ends = Stored(closing.select("component", F.col("c.src").alias("node")))
    steps = chain_steps(live, ends.frame).join(ends.frame.withColumnRenamed("node", "target"), "target")
    back = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("step")).alias("k"), "node"))), lambda x: x["node"])
    rows = steps.groupBy("component").agg(back.alias("path"))
    own = inner.where("src = dst").select(F.col("src").alias("component"), F.array("src", "dst").alias("cycle"))
    return rows.join(own.select("component"), "component", "left_anti").select("component", F.concat("path", F.array("component")).alias("cycle")).unionByName(own.join(roots.withColumnRenamed("node", "component"), "component", "left_semi"))


def graph_errors(findings: DataFrame, edges: DataFrame) -> DataFrame:
    """error, id, detail: why findings (id) and the edges from cause to effect between them are no directed acyclic graph.

    duplicate_finding and duplicate_edge (detail: how often), unknown_finding (an end of an edge), cycle (the nodes joined by " -> "). No row: the graph is sound.
    """
    text = lambda c: F.col(c).cast("string")
    edges = Stored(edges.select("cause", "effect")).frame  # read by each check, and by every loop
    twice = findings.groupBy("id").count().where("count > 1").select(F.lit("duplicate_finding").alias("error"), text("id").alias("id"), text("count").alias("detail"))
    pairs = edges.groupBy("cause", "effect").count().where("count > 1")
    again = pairs.select(F.lit("duplicate_edge").alias("error"), F.concat_ws(" -> ", text("cause"), text("effect")).alias("id"), text("count").alias("detail"))
    ends = edges.select(F.col("cause").alias("id")).union(edges.select("effect")).distinct()
    unknown = ends.join(findings.select("id"), "id", "left_anti").select(F.lit("unknown_finding").alias("error"), text("id").alias("id"), F.lit(None).cast("string").alias("detail"))
    e = edges.select(F.col("cause").alias("src"), F.col("effect").alias("dst"))
    self_ = e.where("src = dst").distinct().select(F.lit("cycle").alias("error"), text("src").alias("id"), F.concat_ws(" -> ", text("src"), text("src")).alias("detail"))
    loops = named_cycles(e.where("src <> dst")).select(F.lit("cycle").alias("error"), text("component").alias("id"), F.array_join(F.col("cycle").cast("array<string>"), " -> ").alias("detail"))
    return twice.unionByName(again).unionByName(unknown).unionByName(self_).unionByName(loops)
