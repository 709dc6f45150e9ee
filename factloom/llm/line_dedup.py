"""Line dedup: fuzzy lines by MinHash.

Every distinct line with a word gets 64 independent minima of its 5-character shingles, banded 16 x 4: two lines of Jaccard
similarity 0.75 miss each other with a probability of about 0.002. Two bits of 32 of the minima make a sketch that
travels with each band: lines of one band whose sketches differ in more than SKETCH_FAR of these are no candidates (at similarity 0.75 that
loses one pair in 2,000; the mean is 6). Pairs of candidates are told apart by longer sketches before their lines are compared. Candidates are verified by their exact similarity and joined
by distributed union-find; of each component, and so of equal lines, the first line in order of
(doc_id, text hash, line) stays.

Defined cases: null and empty texts and lines without a word are left alone. Lines shorter than five
characters are one shingle, so they are only removed as equal lines. A null doc_id comes
before all others. Rows of equal doc_id and text are one document's copies and are cut alike. An empty
table gives an empty result. Columns other than doc_id and text are not read; remove_lines() passes them through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import clear_names, kept, kept_and_counted, map_batches
from .exchange import DIRECT, cuts, exchange, lot_of
from .linking import BLOCK, BLOCK_BYTES, blocked_components
from .shingle_sets import range_count
from .textcore import SPACE, U64, WORD_PATTERN, Texts, grams, hash_spans, lines_of, mix, texts_of

SHINGLE, MINIMA, ROWS, PERCENT = 5, 64, 4, 75
SKETCH, SKETCH_FAR = 32, 13
#: Minima of a candidate's long sketch, two bits each, and in how many of them two candidates may differ: at similarity
#: 0.75 they differ in 24 on the average, with a deviation of 4.4.
LONG, LONG_FAR = 128, 40
#: And in how many if both have a candidate beside them: their shingles are counted then, which costs less than a lost link.
COUNT_FAR = 54
#: A band of more lines of one chunk asks once, and all its lines are candidates.
HOT = 64
#: So are all lines of a band that has more different ones than this.
MANY = 2048
#: Rows of bands whose sketches are compared in one task.
LOT_ROWS = 100_000
_NULL_ID = -(1 << 63)
_LOW32 = U64(0xFFFFFFFF)
_STEP = U64(0xC2B2AE3D27D4EB4F)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_NULL_ID)).alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("key", F.xxhash64("text"))


def _text_lines(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, length, row and number within the row of each line with a word."""
    lines = lines_of(t)
    has = lines.length > 0
    led = np.flatnonzero(has)
    led = led[SPACE[t.data[lines.start[led]]]]  # few lines begin with white space
    raw, a, n = memoryview(t.data), lines.start[led], lines.length[led]
    has[led] = [bool(bytes(raw[i:j]).strip()) for i, j in zip(a.tolist(), (a + n).tolist(), strict=True)]
    number = np.arange(len(lines.start)) - np.repeat(lines.first[:-1], lines.count)
    return lines.start[has], lines.length[has], lines.row[has], number[has]


def _line_ids(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    return (hash_spans(data, start, length) >> U64(1)).astype(np.int64)


def _line_numbers(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hashes of lines that take a quarter of the time; only chunks and ranges know lines by them."""
    raw = memoryview(data)
    return np.fromiter((xxhash.xxh3_64_intdigest(raw[a:b]) >> 1 for a, b in zip(start.tolist(), (start + length).tolist(), strict=True)), np.int64, len(start))


def _points(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points, and where each line begins and ends among them."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), "<u4")
    at, end = start, start + length
    if len(points) < len(data):
        inner = np.flatnonzero(data.view(np.int8) < -64)  # bytes that begin no code point
        at, end = at - np.searchsorted(inner, at), end - np.searchsorted(inner, end)
    return points, at, end


def shingles(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each line's character shingles, in order, and where each line's begin."""
    points, a, end = _points(data, start, length)
    n = end - a
    top = int(points.max(initial=0)) + 1
    letter = mix(np.arange(1, top + 1, dtype=U64))[points] if top <= len(points) else mix(points.astype(U64) + U64(1))
    g = np.append(grams(letter, SHINGLE), np.zeros(SHINGLE, U64))
    count = np.maximum(n - SHINGLE + 1, 1)
    first = np.concatenate([[0], np.cumsum(count)])
    short = n < SHINGLE
    out = g[np.arange(first[-1]) + np.repeat(a - first[:-1], count)]
    out[first[:-1][short]] = hash_spans(data, start[short], length[short])
    return out, first


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 32-bit mix, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def minima(data: np.ndarray, start: np.ndarray, length: np.ndarray, count: int = MINIMA, block: int = 1 << 16) -> np.ndarray:
    """count x lines: the minima of each line's shingles under so many independent orders. Lines are in order of their start."""
    points, at, end = _points(data, start, length)
    times = (mix(np.arange(1, count + 1, dtype=U64)) >> U64(32)).astype(np.uint32) | np.uint32(1)
    plus = (mix(np.arange(count + 1, 2 * count + 1, dtype=U64)) >> U64(32)).astype(np.uint32)
    size = np.maximum(end - at - SHINGLE + 1, 1)
    short = np.flatnonzero(end - at < SHINGLE)
    whole = (hash_spans(data, start[short], length[short]) >> U64(32)).astype(np.uint32)  # such a line is one shingle
    out = np.empty((count, len(start)), np.uint32)
    held = np.empty(block, np.uint32)
    a = 0
    while a < len(start):
        b = max(int(np.searchsorted(end, at[a] + block, side="right")), a + 1)
        letter = _mixed(points[at[a] : end[b - 1]] * np.uint32(0x9E3779B1))
        gram = letter[: max(len(letter) - SHINGLE + 1, 0)].copy()
        for k in range(1, SHINGLE):
            gram *= np.uint32(0x01000193)
            gram += letter[k : k + len(gram)]
        gram = np.append(_mixed(gram), np.zeros(SHINGLE, np.uint32))
        here = slice(*np.searchsorted(short, [a, b]))
        gram[at[short[here]] - at[a]] = whole[here]
        # only what is in lines, so that each ends where the next begins
        cut = np.concatenate([[0], np.cumsum(size[a:b])])
        gram = gram[np.arange(cut[-1]) + np.repeat(at[a:b] - at[a] - cut[:-1], size[a:b])]
        held = held if len(held) >= len(gram) else np.empty_like(gram)
        x = held[: len(gram)]
        for j in range(count):
            np.bitwise_xor(gram, plus[j], out=x)
            np.multiply(x, times[j], out=x)
            np.minimum.reduceat(x, cut[:-1], out=out[j, a:b])
        a = b
    return out


def signatures(low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (lines x bands) and short sketches of some lines."""
    lines = low.shape[1]
    key = np.empty((lines, MINIMA // ROWS), U64)
    for b in range(MINIMA // ROWS):
        k = np.full(lines, U64(b + 1) * _STEP)
        for r in range(ROWS):
            k = mix(k * U64(0x9E3779B97F4A7C15) + low[b * ROWS + r].astype(U64))
        key[:, b] = k
    return key, sketches(low, SKETCH)[:, 0]


def sketches(low: np.ndarray, count: int) -> np.ndarray:
    """Lines x count / 32: two bits of each of the first `count` minima."""
    out = np.zeros((low.shape[1], count // 32), U64)
    for j in range(count):
        out[:, j // 32] |= (mix(low[j].astype(U64) + U64(j)) >> U64(62)) << U64(2 * (j % 32))
    return out


def _apart(x: np.ndarray) -> np.ndarray:
    """In how many pairs of bits the exclusive or of two sketches says that they differ."""
    return np.bitwise_count((x | x >> U64(1)) & U64(0x5555555555555555))


def _like(x: np.ndarray, y: np.ndarray, far: int = COUNT_FAR) -> np.ndarray:
    """Whether long sketches agree as those of two lines at the threshold do."""
    return _apart(x ^ y).sum(axis=1) <= far


def _near_in_bucket(key: np.ndarray, like: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Which entries, in order of key, are like another of the same key. All of a bucket with more than MANY."""
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(head, len(key)))
    yes = np.repeat(size > MANY, size)
    left = np.repeat(np.where(size > MANY, 0, head + size), size) - np.arange(len(key))  # entries from this one to the bucket's end
    live = np.flatnonzero(left > 1)
    step = 1
    while len(live):
        near = live[like(live, live + step)]
        yes[near] = yes[near + step] = True
        step += 1
        live = live[left[live] > step]
    return yes


def candidate_lines(docs: DataFrame, direct: int = DIRECT) -> DataFrame:
    """id, n (distinct shingles), near (long sketch), line, keys (bands with a candidate): a row for each candidate line; lines of very hot bands have one a chunk."""
    ranges = range_count(docs)

    def lines_in(batch: pa.RecordBatch) -> tuple[Texts, np.ndarray, np.ndarray, np.ndarray]:
        t = texts_of(batch.column(1))
        start, length, *_ = _text_lines(t)
        ids = _line_numbers(t.data, start, length)
        first = np.sort(np.unique(ids, return_index=True)[1])  # in order of their start
        return t, ids[first], start[first], length[first]

    def hot_in(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys in order and, for each, how many lines of the chunk have it."""
        head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        return head, np.diff(np.append(head, len(key)))

    def deal(batch: pa.RecordBatch) -> dict[int, Any]:
        t, ids, start, length = lines_in(batch)
        if not len(ids):
            return {}
        key, sketch = signatures(minima(t.data, start, length))
        key, line = key.ravel(), np.repeat(np.arange(len(ids)), MINIMA // ROWS)
        order = np.argsort(key, kind="stable")
        key, line = key[order], line[order]
        head, count = hot_in(key)
        hot = np.repeat(count > HOT, count)
        asked = {}
        for r, s in cuts(lot_of(key, ranges)):
            cold, at = line[s][~hot[s]], key[s][~hot[s]]
            many, of = key[s][hot[s]], line[s][hot[s]]
            first, size = hot_in(many)
            # a hot band asks once, by its first line, and brings its other lines' ids only to its own chunk
            asked[r] = ((at & _LOW32).astype("<u4").tobytes(), _pack40(ids[cold]), sketch[cold].tobytes(), (many[first] & _LOW32).astype("<u4").tobytes(), _pack40(ids[of]), size.tobytes())
        return asked

    def answer(r: int, asked: list) -> list:
        key = [np.frombuffer(x[0], "<u4") for x in asked]
        ids = [_unpack40(x[1]) for x in asked]
        sketch = [np.frombuffer(x[2], U64) for x in asked]
        of = np.repeat(np.arange(len(asked)), [len(k) for k in key])
        k, i, sk = np.concatenate(key), np.concatenate(ids), np.concatenate(sketch)
        hot = np.unique(np.concatenate([np.frombuffer(x[3], "<u4") for x in asked]))
        order = np.argsort(k)
        k = k[order]
        same = np.zeros(len(k) + 1, bool)
        same[1:-1] = k[1:] == k[:-1]
        many = same[1:] | same[:-1]
        if len(hot):
            many |= np.isin(k, hot)
        met = order[many]  # most bands have one line
        k = k[many]
        i, sk, of = i[met], sk[met], of[met]
        # a line is known by 40 bits of its id and its sketch here; of equal ones of several chunks, the first chunk asks for all
        order = np.lexsort((of, sk, i, k))
        k, i, sk, of = k[order], i[order], sk[order], of[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (i[1:] != i[:-1]) | (sk[1:] != sk[:-1])
        k, i, sk, of = k[new], i[new], sk[new], of[new]
        yes = _near_in_bucket(k, lambda a, b: _apart(sk[a] ^ sk[b]) <= SKETCH_FAR) | np.isin(k, hot)
        by = np.argsort(of[yes], kind="stable")
        k, i, of = k[yes][by], i[yes][by], of[yes][by]
        cut = np.searchsorted(of, np.arange(len(asked) + 1)).tolist()
        out = []
        for n, x in enumerate(asked):
            hot_keys, size = np.frombuffer(x[3], "<u4"), np.frombuffer(x[5], np.int64)
            own_k = np.concatenate([k[cut[n] : cut[n + 1]], np.repeat(hot_keys, size)]).astype(np.int64) | r << 32
            own_i = np.concatenate([i[cut[n] : cut[n + 1]], _unpack40(x[4])])
            out.append((own_k, own_i) if len(own_k) else None)
        return out

    def own(batch: pa.RecordBatch) -> Any:
        t, ids, start, length = lines_in(batch)
        raw = t.data.tobytes()
        return ids, length, zstandard.compress(b"".join(raw[a : a + n] for a, n in zip(start.tolist(), length.tolist(), strict=True)), 1)

    def gather(own: Any, replies: list) -> pd.DataFrame:
        ids, length, raw = own
        if not replies:
            return pd.DataFrame({"id": [], "n": [], "near": [], "line": [], "keys": []}, dtype=object)
        key, of = (np.concatenate(x) for x in zip(*replies, strict=True))
        low40 = ids & ((1 << 40) - 1)
        by = np.argsort(low40, kind="stable")
        begin, end = np.searchsorted(low40[by], of), np.searchsorted(low40[by], of, side="right")
        # two lines of a chunk that agree in 40 bits are both candidates
        key, line = np.repeat(key, end - begin), by[np.arange((end - begin).sum()) - np.repeat(np.cumsum(end - begin) - end, end - begin)]
        order = np.lexsort((key, line))
        key, line = key[order], line[order]
        at, cut = np.unique(line, return_index=True)
        text, end = zstandard.decompress(raw), np.cumsum(length)
        lines = [text[end[i] - length[i] : end[i]] for i in at.tolist()]
        data, size = np.frombuffer(b"".join(lines), np.uint8), length[at]
        spans = data, np.cumsum(size) - size, size
        near = list(sketches(minima(*spans, LONG), LONG).view(np.int64))
        return pd.DataFrame({"id": _line_ids(*spans), "n": _set_sizes(*shingles(*spans)), "near": near, "line": lines, "keys": np.split(key, cut[1:])})

    return exchange(_keyed(docs), ranges, deal, answer, gather, "id bigint, n bigint, near array<bigint>, line binary, keys array<bigint>", own, direct)


def _pack40(v: np.ndarray) -> bytes:
    return np.ascontiguousarray(v.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _unpack40(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // 5, 8), np.uint8)
    wide[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return wide.view("<i8").ravel()


def _in_order(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sorts each line's hashes in place; says which are the first of their value. Every line has one."""
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        h[a:b].sort()
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    new[first[:-1]] = True
    return new


def _set_sizes(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(_in_order(h, first), first[:-1], dtype=np.int64) if len(h) else np.zeros(0, np.int64)


def near_in_buckets(found: DataFrame, n_rows: int, percent: int = PERCENT) -> DataFrame:
    """A row for each band with lines that have another of like size and long sketch in it: key, ids (of these lines, in order; of a band of more than MANY
    all), sizes (their bytes), blocks (how many linking.link_in_blocks() makes of them) and sum (equal for equal ids)."""

    def run(group: pa.Table) -> pa.Table:
        key, ids, n, size = (group[c].to_numpy() for c in ("key", "id", "n", "size"))
        order = np.lexsort((ids, key))
        new = np.ones(len(order), bool)
        new[1:] = (key[order][1:] != key[order][:-1]) | (ids[order][1:] != ids[order][:-1])
        order = order[new]
        key, ids, n, size = key[order], ids[order], n[order], size[order]
        near = pc.list_flatten(group["near"]).to_numpy().reshape(len(new), -1).view(U64)[order]

        def like(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return _like(near[a], near[b], LONG_FAR) & (100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b]))

        yes = _near_in_bucket(key, like)
        key, ids, size = key[yes], ids[yes], size[yes]
        head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        many = np.diff(np.append(head, len(key)))
        blocks = np.maximum(-(-many // BLOCK), -(-np.add.reduceat(size, head) // BLOCK_BYTES)) if len(key) else many
        total = np.bitwise_xor.reduceat(mix(ids.view(U64)), head).view(np.int64) if len(key) else many
        cut = pa.array(np.append(head, len(key)).astype(np.int32))
        lists = (pa.ListArray.from_arrays(cut, pa.array(x)) for x in (ids, size))
        return pa.table([pa.array(key[head]), *lists, pa.array(np.where(many == 2, 1, blocks).astype(np.int32)), pa.array(total)], ["key", "ids", "sizes", "blocks", "sum"])

    lot = F.pmod(F.xxhash64("key"), F.lit(max(1, -(-n_rows // LOT_ROWS))))
    rows = found.select(F.explode("keys").alias("key"), "id", "n", "near", F.octet_length("line").cast("bigint").alias("size"))
    return rows.withColumn("lot", lot).groupBy("lot").applyInArrow(run, "key bigint, ids array<bigint>, sizes array<bigint>, blocks int, sum bigint")


def line_components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(node, component) of the lines' ids that have a link."""
    found, n = kept_and_counted(candidate_lines(docs), keys=F.sum(F.size("keys")))
    near = near_in_buckets(found, n["keys"], percent)
    # of bands with the same lines, one
    bands = near.groupBy("sum", F.size("ids").alias("many"), F.col("ids")[0].alias("least")).agg(F.min(F.struct("key", "blocks", "ids", "sizes")).alias("b"))
    each = bands.select(F.explode(F.arrays_zip("b.ids", "b.sizes")).alias("x"), F.struct("b.key", "b.blocks").alias("b"), F.col("b.ids")[0].alias("lead"))
    of = kept(each.groupBy(F.col("x.ids").alias("id")).agg(F.first("x.sizes").alias("size"), F.collect_list("b").alias("keys"), F.min("lead").alias("lead")))
    # lines that share no band may share one with a third line each: those of the same least one meet as well
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.when(F.count("*") > 2, F.ceil(F.sum("size") / BLOCK_BYTES)).otherwise(1)).cast("int")
    besides = of.groupBy("lead").agg(F.count("*").alias("many"), blocks.alias("blocks")).where("many > 1").select("lead", F.array(F.struct(F.col("lead").alias("key"), "blocks")).alias("more"))
    met = of.join(besides, "lead", "left").select("id", F.when(F.col("more").isNull(), F.col("keys")).otherwise(F.concat("keys", "more")).alias("keys"))
    lines = found.groupBy("id").agg(*(F.first(c).alias(c) for c in ("n", "near", "line"))).withColumnRenamed("line", "tokens")
    size = F.size("keys")
    sums = {"rows": F.sum(size), "bytes": F.sum(size * F.octet_length("tokens")), "large": F.sum(F.size(F.filter("keys", lambda b: b["blocks"] > 1)))}
    items, told = kept_and_counted(lines.join(met, "id"), **sums)
    return blocked_components(items, told, percent, _read, _like)


def _shingles_of(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    length = np.array([len(x) for x in lines], np.int64)
    return shingles(np.frombuffer(b"".join(lines), np.uint8), np.cumsum(length) - length, length)


def _read(lines: list[bytes]) -> list[np.ndarray]:
    """The shingle sets of some lines; so a line travels as its text."""
    h, first = _shingles_of(lines)
    new = _in_order(h, first)
    cut = np.concatenate([[0], np.cumsum(new)])[first]
    return np.split(h[new], cut[1:-1])


def removed_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id (least bigint for null), key (xxhash64 of the text), removed (numbers of the lines to go): a row for each document that loses one.

    Lines travel as one row a chunk and distinct line: its first place there, and the others (more) if it has any, so that a hot line
    costs its key a row a chunk.
    """
    place = "struct<doc_id: bigint, key: bigint, line: int>"

    def number(batch: pa.RecordBatch) -> pa.RecordBatch:
        t = texts_of(batch.column(1))
        start, length, row, line = _text_lines(t)
        ids = _line_ids(t.data, start, length)
        doc, key = batch.column(0).to_numpy()[row], batch.column(2).to_numpy()[row]
        order = np.lexsort((line, key, doc, ids))
        ids, doc, key, line = ids[order], doc[order], key[order], line[order].astype(np.int32)
        distinct, first = np.unique(ids, return_index=True)
        others = np.ones(len(ids), bool)
        others[first] = False
        cut = np.concatenate([[0], np.cumsum(np.diff(np.append(first, len(ids))) - 1)]).astype(np.int32)
        more = pa.StructArray.from_arrays([pa.array(c[others]) for c in (doc, key, line)], ["doc_id", "key", "line"])
        columns = [pa.array(distinct), *(pa.array(c[first]) for c in (doc, key, line)), pa.ListArray.from_arrays(pa.array(cut), more)]
        return pa.RecordBatch.from_arrays(columns, ["node", "doc_id", "key", "line", "more"])

    labels = line_components(docs, percent)
    rows = kept(map_batches(_keyed(docs), number, f"node bigint, doc_id bigint, key bigint, line int, more array<{place}>"))
    # a line that occurs once and has no link stays
    again = rows.groupBy("node").agg(F.sum(F.size("more") + 1).alias("n")).where("n > 1").select("node")
    named = again.join(labels, "node", "full_outer").select("node", F.coalesce("component", "node").alias("c"))
    least = F.struct("doc_id", "key", "line").cast(place)
    hit = kept(rows.join(named.hint("shuffle_hash"), "node").select("c", least.alias("least"), "more"))
    stays = hit.groupBy("c").agg(F.min("least").alias("stays"))
    goes = hit.join(stays, "c").select(F.explode(F.concat(F.array("least"), "more")).alias("p"), "stays").where("p <> stays")
    return goes.groupBy("p.doc_id", "p.key").agg(F.array_sort(F.collect_set("p.line")).alias("removed"))


def line_digest(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_lines (lines with a word), n_removed, removed: a row for each row of docs."""
    text = F.col("text").cast("string")
    n = F.size(F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD_PATTERN)))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_NULL_ID)).alias("doc_id"), F.xxhash64(text).alias("key"), F.when(text.isNull(), 0).otherwise(n).alias("n_lines"))
    full = rows.join(removed_lines(docs, percent).hint("shuffle_hash"), ["doc_id", "key"], "left")
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return full.select(F.col("id").alias("doc_id"), "n_lines", F.size(removed).alias("n_removed"), removed.alias("removed"))


def remove_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs without the removed lines; a text that loses none stays as it is."""
    doc, key, removed = clear_names(docs, "doc", "key", "removed")
    keyed = docs.withColumns({doc: F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_NULL_ID)), key: F.xxhash64(F.col("text").cast("string"))})
    gone = removed_lines(docs, percent).toDF(doc, key, removed)
    joined = keyed.join(gone.hint("shuffle_hash"), [doc, key], "left")
    cut = F.array_join(F.filter(F.split(F.col("text"), "\n", -1), lambda x, i: ~F.array_contains(removed, i)), "\n")
    text = F.when(F.col(removed).isNull(), F.col("text")).otherwise(cut)
    return joined.withColumn("text", text).select(*docs.columns)
