"""From candidate buckets to components: verified links and distributed union-find.

Buckets say which items may be similar (rows key, id). A link counts only when the exact
Jaccard similarity of the two items' token sets passes. Large groups of near copies are not
expanded into pairs: in rounds, each item is tested against one leader of the buckets it
shares, buckets whose members are all in one component drop out, and at the end only pairs are listed that still
lie in different components and that no bound on their similarity rules out; so no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, kept, kept_and_counted


#: Items of one pivot in a block.
BLOCK = 1024
#: Rounds of questions to leaders, at most.
ROUNDS = 4
#: Pairs whose items' tokens a task holds at a time.
SLICE_PAIRS = 1024
#: And the bytes of their tokens as they travel; a longer pair is alone.
PAIR_BYTES = 4 << 20
#: Rows of small pivots that a task takes at a time, on the average.
LOT_ROWS = 4096
#: Bytes of an item's tokens, as they travel, that a block of a bucket holds on the average.
BLOCK_BYTES = 1 << 20
#: Bytes of the items of small buckets that a task takes, on the average.
LOT_BYTES = 2 << 20
#: Pairs that are compared at a time.
PAIRS = 1 << 14
#: Edges that one task joins, 4 MB of them; of more, rounds over all tasks leave so many.
LOCAL_EDGES = 1 << 18


def _roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some edges and the least that each reaches."""
    node, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, root = at[: len(a)], at[len(a) :], np.arange(len(node))
    while len(x):
        x, y = root[x], root[y]
        x, y = np.minimum(x, y)[x != y], np.maximum(x, y)[x != y]
        np.minimum.at(root, y, x)
        while (up := root[root] != root).any():
            root[up] = root[root[up]]
    return node, node[root]


def _joined(edges: DataFrame) -> DataFrame:
    """(node, component) of a bounded number of edges, in one task."""

    def run(batches):
        rows = pa.Table.from_batches(batches, pa.schema([("a", pa.int64()), ("b", pa.int64())]))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in _roots(*(c.to_numpy() for c in rows.columns))], ["node", "component"])

    return edges.select("a", "b").coalesce(1).mapInArrow(run, "node bigint, component bigint")


def components(edges: DataFrame, local: int = LOCAL_EDGES) -> DataFrame:
    """(node, component) of edges (a, b): component is the least node reachable. Nodes without an edge are absent.

    Each round every node points to its least neighbour, pointers jump to the fourth ancestor, and edges are
    relabelled by it. The edge from a node to the one that it points to becomes the edge from its ancestor to where that points,
    so nothing comes apart, and the nodes with edges at least halve in every component that isn't done. The last `local` edges are joined by one task.
    """
    order = [F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")]
    e, n = kept_and_counted(edges.select(*order).where("a <> b"))
    whole: DataFrame | None = None

    def renamed(parent: DataFrame) -> DataFrame:
        if whole is None:
            return parent.select("node", F.col("p").alias("component"))
        return whole.join(parent.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("p", "component").alias("component"))

    while n["n"] > local:
        both = e.union(e.select(F.col("b"), F.col("a")))
        parent = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("p"))
        for _ in range(2):
            parent = parent.join(parent.select(F.col("node").alias("p"), F.col("p").alias("pp")), "p").select("node", F.col("pp").alias("p"))
        parent = kept(parent)
        whole = renamed(parent)
        a, b = (parent.select(F.col("node").alias(c), F.col("p").alias(f"p{c}")) for c in "ab")
        moved = e.join(a, "a").join(b, "b").select(F.greatest("pa", "pb").alias("a"), F.least("pa", "pb").alias("b")).where("a <> b")
        e, n = kept_and_counted(moved.distinct())
    if n["n"]:
        whole = renamed(_joined(e).withColumnRenamed("component", "p"))
    return kept(whole) if whole is not None else e.select(F.col("a").alias("node"), F.col("b").alias("component"))


def stored(tokens: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(t, "<u8") for t in tokens]


def _in_common(x: np.ndarray, y: np.ndarray) -> int:
    if len(x) > len(y):
        x, y = y, x
    return int(np.count_nonzero(y.take(y.searchsorted(x), mode="clip") == x)) if len(y) else 0


def verify(pairs: DataFrame, sets: DataFrame, percent: int, read: Callable[[list[bytes]], list[np.ndarray]] = stored, extras: bool = False) -> DataFrame:
    """Of pairs (a, b), how many tokens they have in common, and whether 100 * |A and B| >= percent * |A or B|: a, b, same, ok.

    sets: id, n (set size), tokens; read makes sorted unsigned 64-bit values of tokens, of which those that no other item
    has may be left out. extras: adds the tokens of b that a hasn't, if a has half of b's or more.
    """
    a = sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    b = sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = [np.asarray(batch.column(i).to_numpy()) for i in (0, 1)]
        known, first = np.unique(np.concatenate(ids), return_index=True)  # an item of many pairs is read once
        raw = [batch.column(3), batch.column(5)]
        items = read([raw[k // batch.num_rows][k % batch.num_rows].as_py() for k in first.tolist()])
        x, y = (np.searchsorted(known, i).tolist() for i in ids)
        same = np.fromiter((_in_common(items[i], items[j]) for i, j in zip(x, y, strict=True)), np.int64, len(x))
        nb = batch.column(4).to_numpy()
        ok = 100 * same >= percent * (batch.column(2).to_numpy() + nb - same)
        columns = [batch.column(0), batch.column(1), pa.array(same), pa.array(ok)]
        if extras:
            more = [np.setdiff1d(items[j], items[i], True).view(np.int64) if 2 * k >= n else None for i, j, k, n in zip(x, y, same.tolist(), nb.tolist(), strict=True)]
            columns.append(pa.array(more, pa.list_(pa.int64())))
        return pa.RecordBatch.from_arrays(columns, ["a", "b", "same", "ok", "extra"][: len(columns)])

    def run(batches):
        for batch in batches:
            ends = np.cumsum(pc.binary_length(batch.column(3)).to_numpy().astype(np.int64) + pc.binary_length(batch.column(5)).to_numpy())
            at = 0
            while at < batch.num_rows:
                most = PAIR_BYTES + (int(ends[at - 1]) if at else 0)
                n = min(max(int(np.searchsorted(ends, most, side="right")) - at, 1), SLICE_PAIRS)
                yield one(batch.slice(at, n))
                at += n
        give_back()

    near = pairs.join(a, "a").join(b, "b")
    return near.select("a", "b", "na", "ta", "nb", "tb").mapInArrow(run, "a bigint, b bigint, same bigint, ok boolean" + ", extra array<bigint>" * extras)


def different(buckets: DataFrame) -> DataFrame:
    """One bucket of those with the same items, none with a single one."""
    sums = [F.min("id").alias("lo"), F.max("id").alias("hi"), F.bit_xor(F.xxhash64("id")).alias("sum")]
    items = buckets.groupBy("key").agg(F.count("*").alias("size"), *sums).where("size > 1")
    one = items.groupBy("size", "lo", "hi", "sum").agg(F.min("key").alias("key")).select("key")
    return buckets.join(one, "key", "left_semi")


def _largest(rows: DataFrame) -> DataFrame:
    """(key, main): each bucket's component of most items."""
    parts = rows.groupBy("key", "c").agg(F.count("*").alias("k"))
    return parts.groupBy("key").agg(F.max(F.struct("k", "c")).alias("m")).select("key", F.col("m.c").alias("main"))


def _open(buckets: DataFrame, labels: DataFrame | None, turn: int) -> DataFrame:
    """Rows (key, id, r, c) of the buckets that span components, with the bucket's leader. The first leader is the
    item with the fewest tokens of its own, which lies most in the middle of its near copies; later ones are any, by turns
    one outside the bucket's largest component and one from all."""
    named = buckets.withColumn("c", F.col("id"))
    if labels is not None:
        named = buckets.join(labels.select(F.col("node").alias("id"), "component"), "id", "left")
        named = named.select(*buckets.columns, F.coalesce("component", "id").alias("c"))
    order = [F.col("r"), F.col("id")] if turn == 0 else [F.xxhash64("id", F.lit(turn)), F.col("id")]
    if turn % 2:
        named = named.join(_largest(named), "key")
        order = [F.col("c") == F.col("main"), *order]
    lead = F.min(F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)), F.col("id").alias("leader"), F.col("c").alias("lc"))).alias("lead")
    spans = named.groupBy("key").agg(lead, F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi")
    return named.select(*buckets.columns, "c").join(spans.select("key", "lead.leader", "lead.lc"), "key")


def may_link(percent: int) -> str:
    """Whether the sizes of two items a and b allow a link: what they have in common is at most n - r of
    either, and either's own r tokens are apart."""
    most = "least(na - ra, nb - rb)"
    return f"100 * {most} >= {percent} * ({most} + greatest(ra, na - {most}) + greatest(rb, nb - {most}))"


def _by_pivot(percent: int) -> str:
    """Whether two items may link without a common token besides those of a pivot p that both have been compared with: they
    have at most as many of the pivot's tokens in common as the one that has fewer."""
    return f"(pa is null or pb is null or pa <> pb or 100 * least(sa, sb) >= {percent} * (na + nb - least(sa, sb)))"


def _common(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """How many tokens each of x has in common with each of y."""
    out = np.zeros((len(x), len(y)), np.uint32)
    (tx, ix), (ty, iy) = ((np.concatenate([*v, np.zeros(0, np.int64)]), np.repeat(np.arange(len(v)), [len(k) for k in v])) for v in (x, y))
    order = np.argsort(ty, kind="stable")
    ty, iy = ty[order], iy[order]
    order = np.argsort(tx, kind="stable")
    tx, ix = tx[order], ix[order]
    a, b = np.searchsorted(ty, tx), np.searchsorted(ty, tx, side="right")
    for i, c, d in zip(ix[b > a].tolist(), a[b > a].tolist(), b[b > a].tolist(), strict=True):
        out[i, iy[c:d]] += 1
    return out


def beside_pivot(rows: DataFrame, percent: int, block: int = BLOCK, lots: int = 16) -> DataFrame:
    """Pairs (a, b) of rows (id, c, n, p, s, extra) of one pivot and different components that link if all of the pivot's tokens that either
    has are common: the tokens that they have in common besides are counted.

    The items of a pivot are dealt to blocks of bounded size, and each two blocks meet in a group of their own, so that no task holds more than
    two blocks, whatever the number of near copies; only pairs that pass leave it. Pivots of one block are dealt to lots, as most have a few items.
    """
    sizes = rows.groupBy("p").agg(F.count("*").alias("m")).where("m > 1").select("p", F.ceil(F.col("m") / block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    dealt = rows.join(sizes, "p").withColumn("own", own)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    lot = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("p"), F.lit(lots))).otherwise(F.col("p")).alias("lot")
    cells = dealt.select("id", "c", "n", "p", "s", "extra", "own", lot, (F.col("blocks") == 1).alias("small"), other).withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")})

    def count(group: pd.DataFrame) -> pd.DataFrame:
        ids, c, n, p, s, own = (group[k].to_numpy() for k in ("id", "c", "n", "p", "s", "own"))
        low, high = int(group["low"].iloc[0]), int(group["high"].iloc[0])
        extra = group["extra"].to_numpy()
        order = np.argsort(p, kind="stable")
        found = [np.zeros((2, 0), np.int64)]
        for of in np.split(order, np.flatnonzero(np.diff(p[order])) + 1):
            left, right = of[own[of] == low], of[own[of] == high]
            for at in range(0, len(left), 256):  # a strip of the table at a time
                strip = left[at : at + 256]
                common = _common(list(extra[strip]), list(extra[right]))
                x, y = np.nonzero(common)
                same, x, y = common[x, y], strip[x], right[y]
                same = np.minimum(s[x], s[y]) + same
                yes = (c[x] != c[y]) & (100 * same >= percent * (n[x] + n[y] - same)) & ((low != high) | (ids[x] < ids[y]))
                found.append(np.stack([np.minimum(ids[x], ids[y])[yes], np.maximum(ids[x], ids[y])[yes]]))
        a, b = np.concatenate(found, axis=1)
        del found
        give_back()
        return pd.DataFrame({"a": a, "b": b})

    return cells.groupBy("lot", "small", "low", "high").applyInPandas(count, "a bigint, b bigint")


def cross(rows: DataFrame, about: DataFrame, may: str, few: bool = False) -> DataFrame:
    """Pairs (a, b) of rows (key, id, c) that share a key, lie in different components and are not ruled out by `may` over what is known about them. Each
    bucket's largest component is not paired with itself. few: items have few keys, and a pair is listed by the least that it shares, not by each."""
    largest = _largest(rows)
    if few:
        about = about.join(rows.groupBy("id").agg(F.collect_list("key").alias("keys")), "id")
        may = f"{may} and array_min(array_intersect(keysa, keysb)) = x.key"
    named = rows.join(largest, "key").join(about, "id")
    names = [c for c in about.columns if c != "id"]
    x, y = (named.select("key", F.col("id").alias(s), F.col("c").alias(f"c{s}"), F.col("main").alias(f"main{s}"), *(F.col(n).alias(f"{n}{s}") for n in names)) for s in "ab")
    x, y = x.alias("x"), y.alias("y")
    on = (F.col("x.key") == F.col("y.key")) & F.expr(f"ca <> cb and (cb = mainb or ca < cb) and {may}")
    return x.where("ca <> maina").join(y, on).select("x.key", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def link(
    buckets: DataFrame,
    sets: DataFrame,
    percent: int,
    may: str | None = None,
    small: DataFrame | None = None,
    counted: int = 1,
    read: Callable[[list[bytes]], list[np.ndarray]] = stored,
) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) that were verified, and the components (node, component) of all links that there are.

    buckets: distinct rows (key, id) of any size. sets: id, n, r (tokens that no item has in common by a bucket), near (what `may`, an expression over na, ra, neara
    and nb, rb, nearb, asks besides), tokens as verify() takes them. counted: two linked items share so many buckets. small: rows (key, id) of buckets of bounded size, whose
    pairs are all listed, with own (tokens that no other item has) in the place of r.
    Every pair of items that share a bucket ends in one component, was ruled out by a bound, or was tested.
    """
    may = may or may_link(percent)
    found: list[DataFrame] = []
    tested: list[DataFrame] = []
    labels: DataFrame | None = None
    pivots: DataFrame | None = None
    about = sets.select("id", "n", "r", "near")
    # an item whose shared tokens can't make up a link with any other is in no bucket
    able = about.where(f"100 * (n - r) >= {percent} * n")
    open_, n = kept_and_counted(_open(buckets.join(able.select("id", "r"), "id").select("key", "id", "r"), None, 0))
    turn, going = 0, True
    while going and n["n"]:
        asked = open_.where("c <> lc").groupBy(F.col("id").alias("b"), F.col("leader").alias("a")).agg(F.count("*").alias("shared"))
        if turn:
            x, y = (about.select(F.col("id").alias(s), *(F.col(c).alias(f"{c}{s}") for c in ("n", "r", "near"))) for s in "ab")
            asked = asked.join(x, "a").join(y, "b").where(may).select("a", "b", "shared")
        if tested:
            asked = asked.join(reduce(DataFrame.unionByName, tested), ["a", "b"], "left_anti")
        pairs = asked.groupBy("b").agg(F.max(F.struct("shared", F.negative("a").alias("less"))).alias("m")).select(F.negative("m.less").alias("a"), "b")
        results, told = kept_and_counted(verify(pairs, sets, percent, read, extras=not turn), linked=F.count_if("ok"))
        tested.append(results.select("a", "b"))
        if turn == 0:
            pivots = results.where("extra is not null").select(F.col("b").alias("id"), F.col("a").alias("p"), F.col("same").alias("s"), "extra")
        turn += 1
        if not told["linked"]:
            break
        going = turn < ROUNDS  # what leaders leave is listed under the bounds
        found.append(results.where("ok").select("a", "b"))
        # what is linked already is its component's; only its edges to the least member are needed from here on
        stars = [labels.select(F.col("node").alias("a"), F.col("component").alias("b"))] if labels is not None else []
        labels = components(reduce(DataFrame.unionByName, [*stars, found[-1]]))
        open_, n = kept_and_counted(_open(open_.select("key", "id", "r"), labels, turn))
    more, besides = about, None
    if pivots is not None:
        more = about.join(pivots.drop("extra"), "id", "left")
        may = f"{may} and {_by_pivot(percent)}"
        besides = beside_pivot(open_.select("id", "c").distinct().join(about.select("id", "n"), "id").join(pivots, "id"), percent, lots=max(1, -(-n["n"] // LOT_ROWS)))
    pairs = cross(open_.select("key", "id", "c"), more, may)
    pairs = pairs.groupBy("a", "b").agg(F.count("*").alias("k")).where(f"k >= {counted}").select("a", "b") if counted > 1 else pairs.select("a", "b")
    pairs = (pairs if besides is None else pairs.unionByName(besides)).distinct()
    if small is not None:
        few = different(small).join(sets.select("id", "n", F.col("own").alias("r")), "id").withColumn("c", F.col("id"))
        if labels is not None:
            few = few.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")
        x, y = (few.select("key", F.col("id").alias(s), F.col("c").alias(f"c{s}"), F.col("n").alias(f"n{s}"), F.col("r").alias(f"r{s}")) for s in "ab")
        listed = x.join(y, (x["key"] == y["key"]) & F.expr(f"a < b and ca <> cb and {may_link(percent)}")).select("a", "b")
        pairs = pairs.unionByName(listed).distinct()
    if tested:
        done = reduce(DataFrame.unionByName, tested).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        pairs = pairs.join(done, ["a", "b"], "left_anti")
    links, told = kept_and_counted(verify(pairs, sets, percent, read).where("ok").select("a", "b"))
    if told["n"]:
        found.append(links)
        stars = [labels.select(F.col("node").alias("a"), F.col("component").alias("b"))] if labels is not None else []
        labels = components(reduce(DataFrame.unionByName, [*stars, links]))
    if labels is None:
        return links, links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return reduce(DataFrame.unionByName, found), labels


def _within(key: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of one key, of rows in order of it, some at a time."""
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(head, len(key)))
    left = np.repeat(head + size, size) - np.arange(len(key))  # rows from this one to the bucket's end
    live, step = np.flatnonzero(left > 1), 1
    while len(live):
        yield live, live + step
        step += 1
        live = live[left[live] > step]


def _across(left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for i in left.tolist():
        yield np.full(len(right), i), right


def _shared_least(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least key that each row of x has in common with that of y; negative ones are none."""
    same = x == y[:, :1]
    for c in range(1, y.shape[1]):
        same |= x == y[:, c : c + 1]
    same &= x >= 0
    return np.where(same, x, np.iinfo(np.int64).max).min(axis=1)


class _Forest:
    """Links of some items that join components not joined before; tokens are read when an item is first compared."""

    def __init__(self, c: np.ndarray, n: np.ndarray, tokens: Callable[[list[int]], list[np.ndarray]], percent: int):
        self.root = np.unique(c, return_inverse=True)[1]
        self.n, self.tokens, self.percent = n, tokens, percent
        self.known: dict[int, np.ndarray] = {}
        self.edges: list[tuple[int, int]] = []

    def compare(self, x: np.ndarray, y: np.ndarray) -> None:
        apart = self.root[x] != self.root[y]
        x, y = x[apart], y[apart]
        order = np.lexsort((y, x))
        x, y = x[order], y[order]
        needed = np.unique(np.concatenate([x, y]))
        if fresh := [i for i in needed.tolist() if i not in self.known]:
            self.known |= zip(fresh, self.tokens(fresh), strict=True)
        of = self.known
        if dense := len(x) > 16 * len(needed):  # tokens as small numbers, so that one item's can be marked for all it is compared with
            size = [len(of[i]) for i in needed.tolist()]
            number = np.unique(np.concatenate([of[i] for i in needed.tolist()]), return_inverse=True)[1]
            mark = np.zeros(number.max() + 1, np.int64)
            of = dict(zip(needed.tolist(), np.split(number, np.cumsum(size)[:-1]), strict=True))
        cut = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1], [True]])) if len(x) else np.zeros(1, int)
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            i, others = int(x[a]), y[a:b]
            others = others[self.root[others] != self.root[i]]
            if not len(others):
                continue
            if dense:
                mark[of[i]] = 1
                size = np.array([len(of[j]) for j in others.tolist()])
                same = np.add.reduceat(mark[np.concatenate([of[j] for j in others.tolist()])], np.cumsum(size) - size)
                mark[of[i]] = 0
            else:
                same = np.array([_in_common(of[i], of[j]) for j in others.tolist()])
            for j in others[100 * same >= self.percent * (self.n[i] + self.n[others] - same)].tolist():
                if self.root[i] != self.root[j]:
                    self.edges.append((i, j))
                    self.root[self.root == self.root[j]] = self.root[i]


def link_in_blocks(rows: DataFrame, percent: int, read: Callable[[list[bytes]], list[np.ndarray]], like: Callable[[np.ndarray, np.ndarray], np.ndarray], lots: int = 16) -> DataFrame:
    """Edges (a, b) that join all components of items which share a bucket, are `like` each other and have the similarity: of a task's links
    those that join what wasn't joined before.

    rows: key, id, blocks (of the bucket), c, n (set size), near, tokens, keys (all of the item's buckets, of which a pair is compared in the least that it
    shares). The items of a bucket of several blocks are dealt to them, and each two blocks meet in a task of their own; buckets of one
    block are dealt to lots. So no pair of items is a row: a bucket costs its items a row for each of its blocks, and a task gives fewer edges than it has items.
    """
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("own")
    lot = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("key"), F.lit(lots))).otherwise(F.col("key")).alias("lot")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    cells = rows.select("key", "id", "c", "n", "near", "tokens", "keys", own, lot, (F.col("blocks") == 1).alias("small"), other)
    cells = cells.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")})

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        key, ids, c, n, own = (group[k].to_numpy() for k in ("key", "id", "c", "n", "own"))
        low, high = group["low"][0].as_py(), group["high"][0].as_py()
        item, first, of = np.unique(ids, return_index=True, return_inverse=True)
        near = pc.list_flatten(group["near"]).to_numpy().reshape(len(ids), -1).view(np.uint64)[first]
        many = pc.list_value_length(group["keys"]).to_numpy()
        keys = np.full((len(ids), many.max()), -1, np.int64)
        keys[np.arange(many.max()) < many[:, None]] = pc.list_flatten(group["keys"]).to_numpy()
        keys, n, raw = keys[first], n[first], group["tokens"]
        forest = _Forest(c[first], n, lambda at: read([raw[first[i]].as_py() for i in at]), percent)
        order = np.lexsort((ids, key))
        pairs = _within(key[order]) if low == high else _across(np.flatnonzero(own[order] == low), np.flatnonzero(own[order] == high))
        held, size = [], 0

        def compare() -> None:
            at, x, y = np.concatenate(held, axis=1)
            here = _shared_least(keys[x], keys[y]) == at
            forest.compare(x[here], y[here])

        key, of = key[order], of[order]
        for a, b in pairs:
            for s in range(0, len(a), PAIRS):
                x, y = of[a[s : s + PAIRS]], of[b[s : s + PAIRS]]
                may = forest.root[x] != forest.root[y]
                may &= 100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])
                may[may] = like(near[x[may]], near[y[may]])
                held.append(np.stack([key[a[s : s + PAIRS]], x, y])[:, may])
                size += held[-1].shape[1]
                if size > PAIRS:
                    compare()
                    held, size = [], 0
        if size:
            compare()
        edges = np.array(forest.edges, np.int64).reshape(-1, 2)
        out = pa.table({"a": item[edges[:, 0]], "b": item[edges[:, 1]]})
        del group, raw, forest, near, keys
        give_back()
        return out

    return cells.groupBy("lot", "small", "low", "high").applyInArrow(run, "a bigint, b bigint")


def blocked_components(items: DataFrame, sums: dict[str, int], percent: int, read: Callable[[list[bytes]], list[np.ndarray]], like: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(node, component) of items that share a bucket, are `like` each other and have the similarity; those without a link may be absent.

    items: id, n, near, tokens, keys (array of struct key, blocks: the buckets of the item and how many blocks each makes). sums: rows, bytes and
    large: of the buckets' rows, those of the tokens in them, and the rows in buckets of several blocks. Of these, items are tested against leaders first.
    """
    each = items.select("id", F.explode("keys").alias("at")).select("at.key", "id", "at.blocks")
    labels: DataFrame | None = None
    large = kept(each.where("blocks > 1").withColumn("r", F.lit(0))) if sums["large"] else None
    for turn in range(ROUNDS if large is not None else 0):
        asked = _open(large, labels, turn).where("c <> lc").groupBy(F.col("id").alias("b"), F.col("leader").alias("a")).agg(F.count("*").alias("shared"))
        pairs = asked.groupBy("b").agg(F.max(F.struct("shared", F.negative("a").alias("less"))).alias("m")).select(F.negative("m.less").alias("a"), "b")
        found, told = kept_and_counted(verify(pairs, items, percent, read).where("ok").select("a", "b"))
        if not told["n"]:
            break
        stars = [labels.select(F.col("node").alias("a"), F.col("component").alias("b"))] if labels is not None else []
        labels = components(reduce(DataFrame.unionByName, [*stars, found]))
    named = items.withColumn("c", F.col("id"))
    if labels is not None:
        named = items.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")
    rows = named.select(*(F.col(c) for c in ("id", "c", "n", "near", "tokens")), F.col("keys.key").alias("keys"), F.explode("keys").alias("at")).select("*", "at.key", "at.blocks").drop("at")
    if large is not None:
        still = _open(large, labels, 0).select("key").distinct()
        rows = rows.where("blocks = 1").unionByName(rows.where("blocks > 1").join(still, "key", "left_semi"))
    lots = max(1, -(-sums["rows"] // LOT_ROWS), -(-sums["bytes"] // LOT_BYTES))
    edges = link_in_blocks(rows, percent, read, like, lots)
    if labels is not None:
        edges = edges.unionByName(labels.select(F.col("node").alias("a"), F.col("component").alias("b")))
    return components(edges)
