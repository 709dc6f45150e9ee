"""Clones in four modes, as classes of equal spans with members, and the ranges of a file that are left out.

Modes: strict compares the source between the tokens too, mild the tokens, weak leaves out literals' values, semantic also the names of
variables (functions/tokens.py). Every mode is a stream of units per text, and clones are its common windows.

How classes are found, without a row a pair and with few windows sent anywhere:

1. One pass hashes each stream. Texts of equal streams are one, with copies; a window is common when two different
   streams have it or its stream has copies. Equal windows have the same least hash of half-length grams, of which a text has
   few: only those anchors are counted over all texts.
2. A second pass hashes the windows whose anchor is common, and only they are counted.
3. A window and the next one are one class when every occurrence of either lies beside one of the other: the exclusive or of hashes of
   their occurrences' places, one moved by a place, tells.

Windows, anchors and places are told apart by 64-bit hashes, streams by 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain, count

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tokens
from ..functions.names import LITERALS
from ..sources.shared import Stored

#: Text that is hashed at a time; a longer text is alone.
SLICE_BYTES = 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1)
        if pa.types.is_list(texts.type):
            sizes = pc.multiply(pc.list_value_length(texts).cast(pa.int64()), 8)
        else:
            sizes = pc.binary_length(texts).cast(pa.int64())
        begin, held = 0, 0
        for i, n in enumerate(pc.fill_null(sizes, 0).to_pylist()):
            if i > begin and held + n > SLICE_BYTES:
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += n
        if batch.num_rows:
            yield batch.slice(begin)


def _units(column: pa.Array, mode: str) -> list[list[str]]:
    """What a stream of each row is made of: the tokens of a text, an array of tokens as it is, what white space separates, or tokens with the gaps before them."""
    rows = column.to_pylist()
    if mode == "words":
        return [[w.decode() for w in r.encode().split()] if r else [] for r in rows]
    if mode == "strict":
        return [tokens.with_gaps(r) if r else [] for r in rows]
    return [(r if isinstance(r, list) else tokens.tokens(r)) if r else [] for r in rows]


def _hashes(texts: list[str]) -> np.ndarray:
    return pd.util.hash_array(np.array(texts, object), categorize=False) if texts else np.zeros(0, np.uint64)


class _Hashed:
    """A slice's streams as hashes of their units, one after another: those of tokens.normalised(), without making its texts."""

    def __init__(self, column: pa.Array, mode: str) -> None:
        rows = _units(column, mode)
        self.sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        self.ends = np.cumsum(self.sizes)
        self.row = np.repeat(np.arange(len(rows)), self.sizes)
        code = dict(zip(dict.fromkeys(chain.from_iterable(rows)), count(), strict=False))
        distinct = list(code)
        at = np.fromiter(map(code.__getitem__, chain.from_iterable(rows)), np.int64, int(self.sizes.sum()))
        del rows, code
        kinds = tokens.literal_kinds(distinct) if mode in ("weak", "semantic") else [None] * len(distinct)
        own = _hashes([t if k is None else LITERALS[k] for t, k in zip(distinct, kinds, strict=True)])
        self.unit = own[at] if len(at) else np.zeros(0, np.uint64)
        self.first = self.unit
        if mode == "strict" and distinct:  # what stands before a window's first token is no part of it
            self.first = _hashes([tokens.tokens(u)[-1] for u in distinct])[at]
        if mode == "semantic" and distinct:
            self._number(at, distinct, np.array([k is None and v for k, v in zip(kinds, tokens.may_be_variables(distinct), strict=True)]))

    def _number(self, at: np.ndarray, distinct: list[str], variable: np.ndarray) -> None:
        """Gives variables the hashes of their numbers, by first occurrence in their text."""
        sign = {t: i for i, t in enumerate(distinct) if t in ("(", "!", ":", ".")}
        n = len(at)

        def beside(test: np.ndarray, by: int) -> np.ndarray:
            """Where the token `by` places on is one of test, in the same text."""
            out = np.zeros(n, bool)
            if by > 0:
                out[:-by] = test[by:] & (self.row[by:] == self.row[:-by])
            else:
                out[-by:] = test[:by] & (self.row[:by] == self.row[-by:])
            return out

        colon, called = at == sign.get(":", -1), (at == sign.get("(", -1)) | (at == sign.get("!", -1))
        keeps = beside(called, 1) | (beside(colon, 1) & beside(colon, 2)) | beside(at == sign.get(".", -1), -1) | (beside(colon, -1) & beside(colon, -2))
        place = np.flatnonzero(variable[at] & ~keeps)
        if not len(place):
            return
        pair, first, back = np.unique(self.row[place] * len(distinct) + at[place], return_index=True, return_inverse=True)
        rank = np.empty(len(pair), np.int64)
        rank[np.argsort(first)] = np.arange(len(pair))
        owner = pair // len(distinct)
        before = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(self.sizes)))])
        number = (rank - before[owner])[back]
        self.unit = self.unit.copy()
        self.unit[place] = _hashes([f"__ID_{i}__" for i in range(int(number.max()) + 1)])[number]
        self.first = self.unit

    def grams(self, n: int) -> np.ndarray:
        """Hash of each n units in a row, whatever text they are of."""
        m = max(0, len(self.unit) - n + 1)
        out = np.zeros(m, np.uint64)
        for k in range(n):
            out = (out ^ (out >> np.uint64(31))) * _MIX + (self.first if k == 0 else self.unit)[k : k + m]
        return (out ^ (out >> np.uint64(29))) * _MIX

    def within(self, n: int) -> np.ndarray:
        """Whether the n units from each place are of one text."""
        m = max(0, len(self.unit) - n + 1)
        return self.row[:m] == self.row[n - 1 : n - 1 + m]

    def anchors(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Where windows of n units begin, and the least hash of the grams of half the length in each."""
        half = (n + 1) // 2
        g, width = self.grams(half), n - half + 1
        low, have = g, 1
        while have < width:
            step = min(have, width - have)
            low = np.minimum(low[: len(low) - step], low[step:]) if len(low) > step else low[:0]
            have += step
        at = np.flatnonzero(self.within(n))
        return at, low[at]

    def keys(self) -> list[bytes]:
        """128 bits of each stream."""
        place = np.arange(len(self.unit), dtype=np.uint64) - np.repeat((self.ends - self.sizes).astype(np.uint64), self.sizes)
        out = []
        for salt in (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)):
            mixed = (self.unit ^ (place * salt)) * _MIX
            mixed = (mixed ^ (mixed >> np.uint64(32))) * salt
            sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed, dtype=np.uint64)])
            out.append((sums[self.ends] - sums[self.ends - self.sizes]) ^ self.sizes.astype(np.uint64))
        raw = np.stack(out, axis=1).tobytes()
        return [raw[i : i + 16] for i in range(0, len(raw), 16)]


def _pass(rows: DataFrame, fn, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(fn, _slices(batches))

    return rows.mapInArrow(run, schema)


def clone_classes(rows: DataFrame, mode: str = "mild", least: int = 20) -> DataFrame:
    """class, id, start, length: the classes of common spans of `least` units or more, and where they are. rows: id and text (or an array of tokens).

    mode: one of tokens.MODES (strict needs texts), or "words" for what white space separates. The maximal span that two texts have in common is their classes
    that follow one another on a diagonal. Null and empty texts and those shorter than `least` have none; ids are distinct and not null. All members of a class are equal.
    """
    id_type = rows.schema["id"].dataType.simpleString()
    source = rows.select("id", rows.columns[1 - rows.columns.index("id")])

    def summary(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = _Hashed(batch.column(1), mode)
        at, low = s.anchors(least)
        cut = np.searchsorted(s.row[at], np.arange(batch.num_rows + 1)) if len(at) else np.zeros(batch.num_rows + 1, np.int64)
        lows = [np.unique(low[a:b]).view(np.int64) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(s.keys(), pa.binary()), pa.array(lows, pa.list_(pa.int64()))], ["id", "key", "lows"])

    all_ = Stored(_pass(source, summary, f"id {id_type}, key binary, lows array<bigint>").where("size(lows) > 0"))
    keys = Stored(all_.frame.select("id", "key"))
    copies = Stored(keys.frame.groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("n")))
    streams = all_.frame.join(copies.frame.select("id", "n"), "id")  # one of each set of copies
    anchors = streams.select("id", F.explode("lows").alias("low"))
    shared = anchors.groupBy("low").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("low")
    marked = Stored(anchors.join(shared, "low", "left_semi").groupBy("id").agg(F.collect_list("low").alias("lows")))  # a text's own anchors
    wanted = marked.frame.join(copies.frame.select("id", "n"), "id", "right").where("lows is not null or n > 1")

    def windows(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = _Hashed(batch.column(1), mode)
        at, low = s.anchors(least)
        keep = np.zeros(len(at), bool)
        cut = np.searchsorted(s.row[at], np.arange(batch.num_rows + 1)) if len(at) else np.zeros(batch.num_rows + 1, np.int64)
        for i, (own, whole) in enumerate(zip(batch.column(2), batch.column(3).to_pylist(), strict=True)):
            part = slice(int(cut[i]), int(cut[i + 1]))
            keep[part] = whole or (own.is_valid and np.isin(low[part].view(np.int64), own.values.to_numpy()))
        at = at[keep]
        row = s.row[at]
        h = s.grams(least)[at].view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array((at - (s.ends - s.sizes)[row]).astype(np.int32)), pa.array(h)], ["id", "pos", "h"])

    texts = source.join(wanted.select("id", "lows", (F.col("n") > 1).alias("whole")), "id")
    all_.drop()
    w = Stored(_pass(texts, windows, f"id {id_type}, pos int, h bigint"))
    marked.drop()
    here, moved = F.bit_xor(F.xxhash64("id", "pos")).alias("here"), F.bit_xor(F.xxhash64("id", F.col("pos") + 1)).alias("moved")
    times = w.frame.groupBy("h").agg(F.min("id").alias("a"), F.max("id").alias("b"), here, moved)
    several = times.join(copies.frame.where("n > 1").select(F.col("id").alias("a"), "n"), "a", "left").where("a < b or n > 1")
    several = Stored(several.select("h", "here", "moved"))
    found = w.frame.join(several.frame, "h")
    order = Window.partitionBy("id").orderBy("pos")
    goes_on = (F.lag("pos").over(order) == F.col("pos") - 1) & (F.lag("moved").over(order) == F.col("here"))
    parts = found.withColumn("begins", F.when(goes_on, 0).otherwise(1)).withColumn("part", F.sum("begins").over(order))
    runs = parts.groupBy("id", "part").agg(F.min_by("h", "pos").alias("class"), F.min("pos").alias("start"), (F.count("*") + least - 1).cast("int").alias("length"))
    runs = Stored(runs.select("class", "id", "start", "length"))
    w.drop()
    twins = keys.frame.join(copies.frame.where("n > 1").select("key", F.col("id").alias("of")), "key").where("id <> of").select("of", "id")
    more = runs.frame.withColumnRenamed("id", "of").join(twins, "of").select("class", "id", "start", "length")
    return runs.frame.unionByName(more)


def named_by_first(classes: DataFrame) -> DataFrame:
    """first_id, first_start, id, start, length: classes named by their first member instead of a hash."""
    first = classes.groupBy("class").agg(F.min(F.struct("id", "start")).alias("f"))
    return classes.join(first, "class").select(F.col("f.id").alias("first_id"), F.col("f.start").alias("first_start"), "id", "start", "length")


# ---- ranges that are left out ------------------------------------------------

#: A range without an end goes to the last line.
OPEN_END = 2147483647


def marker_events(lines: DataFrame, off: str, on: str) -> DataFrame:
    """file, line, kind, reason of the lines (file, line, text) with a marker; a line with both is off. reason: what follows off, trimmed, null for on."""
    text = F.col("text")
    kind = F.when(F.contains(text, F.lit(off)), "off").when(F.contains(text, F.lit(on)), "on")
    reason = F.trim(F.substring(text, F.locate(off, text) + len(off), F.length(text)))
    return lines.withColumn("kind", kind).where("kind is not null").select("file", "line", "kind", F.when(F.col("kind") == "off", reason).alias("reason"))


def off_ranges(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ranges (file, start, end) from an off to the next on, and errors (file, line): offs without a reason.

    A further off in an open range changes nothing, an on without one neither; a range that stays open ends at OPEN_END. Two states over a
    file's events in order: one begins where the event before isn't off, and ends at the next on. A file with an error has no ranges.
    """
    order = Window.partitionBy("file").orderBy("line")
    before = F.lag("kind").over(order)
    turns = events.withColumn("before", before).where((F.col("kind") != F.coalesce("before", F.lit("on"))))
    ends = turns.withColumn("end", F.lead("line").over(order)).where("kind = 'off'")
    errors = events.where("kind = 'off' and reason = ''").select("file", "line")
    ranges = ends.select("file", F.col("line").alias("start"), F.coalesce(F.col("end").cast("int"), F.lit(OPEN_END)).alias("end"))
    return ranges.join(errors.select("file"), "file", "left_anti"), errors


def within_range(spans: DataFrame, ranges: DataFrame) -> DataFrame:
    """Spans (id, start, length, file, first_line, last_line) that lie wholly within a range of their file.

    Ranges of a file don't overlap, so the one that can hold a span is the last that begins at or before it: found by order and not by a join of all.
    """
    marks = ranges.select("file", F.col("start").alias("at"), F.lit(0).alias("what"), "end")
    ours = spans.withColumn("at", F.col("first_line")).withColumn("what", F.lit(1)).withColumn("end", F.lit(None).cast("int"))
    order = Window.partitionBy("file").orderBy("at", "what").rowsBetween(Window.unboundedPreceding, 0)
    both = ours.unionByName(marks, allowMissingColumns=True).withColumn("last", F.last("end", ignorenulls=True).over(order))
    return both.where("what = 1 and last_line <= last").drop("at", "what", "end", "last")


def families(spans: DataFrame, contents: DataFrame, places: DataFrame, ranges: DataFrame) -> DataFrame:
    """family, id, start, length, members: spans that pairs have in common, grouped by their content.

    spans: a, b, a_from, b_from, length, as text.clone_spans() gives them. contents: id, toks. places: id, file, and lines, the line of each token. A pair of which one
    lies wholly in a range that is left out is none. A member within another reported span of its text goes, then families of one.
    """
    a, b = spans.select(F.monotonically_increasing_id().alias("pair"), "*"), ["pair", "id", "start", "length"]
    pairs = Stored(a)
    sides = pairs.frame.select("pair", F.col("a").alias("id"), F.col("a_from").alias("start"), "length").unionByName(pairs.frame.select("pair", F.col("b").alias("id"), F.col("b_from").alias("start"), "length"))
    lines = F.col("lines")
    placed = sides.join(places, "id").withColumns({"first_line": F.get(lines, F.col("start")), "last_line": F.get(lines, F.col("start") + F.col("length") - 1)}).drop("lines")
    dropped = within_range(placed.select(*b, "file", "first_line", "last_line"), ranges).select("pair").distinct()
    members = sides.join(dropped, "pair", "left_anti").select("id", "start", "length").distinct()
    return _by_content(members, contents)


def _by_content(members: DataFrame, contents: DataFrame) -> DataFrame:
    """Families of the spans (id, start, length) that lie within no other of their text, by content, of two members or more."""
    end = F.col("start") + F.col("length")
    # a span lies within another of its text if one that begins no later ends no earlier: the furthest end so far, longest first at one start
    order = Window.partitionBy("id").orderBy("start", F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    whole = members.withColumn("reach", F.max(end).over(order)).where(F.col("reach").isNull() | (F.col("reach") < end)).drop("reach")
    named = whole.join(contents, "id").select(F.sha2(F.array_join(F.slice("toks", F.col("start") + 1, F.col("length")), "\u0001"), 256).alias("family"), "id", "start", "length")
    sizes = named.groupBy("family").agg(F.count("*").alias("members")).where("members > 1")
    return named.join(sizes, "family")


def families_of_texts(rows: DataFrame, places: DataFrame, ranges: DataFrame, least: int = 20) -> DataFrame:
    """families() of text.clone_spans(rows, least), without listing a pair: what is sent grows with the texts and not with how many pairs have a window in common."""
    return _by_content(reaches(rows, places, ranges, least), rows.select("id", "toks"))


class _Lengths:
    """Hashes of a slice's windows of any length, and which of them count. Columns of the batch: id, toks, lines, starts, ends."""

    def __init__(self, batch: pa.RecordBatch, least: int) -> None:
        s = _Hashed(batch.column(1), "mild")
        self.row, self.least, place = s.row, least, np.arange(len(s.unit))
        begins = s.ends - s.sizes
        self.pos = place - begins[s.row]
        self.room = s.ends[s.row] - place
        self.need = np.full(len(s.unit), least)  # the length from which on a span from here is not wholly in a range
        for i, (lines, starts, ends) in enumerate(zip(*(batch.column(k) for k in (2, 3, 4)), strict=True)):
            if starts.is_valid and lines.is_valid:
                lines, starts, ends = (x.values.to_numpy() for x in (lines, starts, ends))
                k = np.searchsorted(starts, lines, "right") - 1
                upto = np.searchsorted(lines, np.where(k >= 0, ends[k], -1), "right")
                self.need[begins[i] : begins[i] + len(lines)] = np.maximum(least, upto - np.arange(len(lines)) + 1)
        ids = _hashes([f"\u0001{i}" for i in batch.column(0).to_pylist()])  # where a text begins, nothing else stands before
        self.left = np.where(self.pos == 0, ids[s.row], np.roll(s.unit, 1)) if len(s.unit) else s.unit
        grams = s.grams(least)
        self.power, self.back = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(grams), x, np.uint64)])) for x in (int(_MIX), pow(int(_MIX), -1, 1 << 64)))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(grams * self.power[:-1], dtype=np.uint64)])

    def hashes(self, at: np.ndarray, n: int) -> np.ndarray:
        """Of the windows of n units from the places at, by the grams of `least` in them."""
        h = (self.sums[at + n - self.least + 1] - self.sums[at]) * self.back[at] + np.uint64(n)
        return ((h ^ (h >> np.uint64(29))) * _MIX).view(np.int64)


def reaches(rows: DataFrame, places: DataFrame, ranges: DataFrame, least: int = 20) -> DataFrame:
    """id, start, length: spans of `least` units or more that a text shares with another, neither side wholly in a range: all that lie within no other such span, and some that do.

    rows: id, toks. places and ranges: as families() has them. The longest such spans are those of the places whose unit before differs from that of some other occurrence, as far as any
    other text goes along. So windows of a few lengths are counted by their hash, then those of longer ones from the places that are left, twice as many lengths each time: a span sends at
    most some two windows for each of its units from its first place, and places within a passage that all its texts go on with drop out.
    """
    per_file = ranges.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("r")).select("file", F.col("r.start").alias("starts"), F.col("r.end").alias("ends"))
    kind = rows.schema["id"].dataType.simpleString()
    placed = rows.select("id", "toks").join(places.select("id", "file", "lines"), "id", "left").join(per_file, "file", "left")
    texts = Stored(placed.where(F.size("toks") >= least).select("id", "toks", F.when(F.col("starts").isNotNull(), F.col("lines")).alias("lines"), "starts", "ends"))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            x = _Lengths(batch, least)
            at = np.flatnonzero(x.room >= x.need)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(x.row[at])), pa.array(x.pos[at].astype(np.int32)), pa.array(x.hashes(at, least))], ["id", "pos", "h"])

    def longer(low: int, high: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _slices(batches):
                x = _Lengths(batch, least)
                sizes = np.bincount(x.row, minlength=batch.num_rows)
                begins = np.cumsum(sizes) - sizes
                places = np.concatenate([begins[i] + own.values.to_numpy() for i, own in enumerate(batch.column(5))])
                for n in range(low, high + 1):
                    at = places[x.room[places] >= n]
                    columns = [batch.column(0).take(pa.array(x.row[at])), pa.array(x.pos[at].astype(np.int32)), pa.array(np.full(len(at), n, np.int32)), pa.array(x.left[at].view(np.int64)), pa.array(x.need[at] <= n), pa.array(x.hashes(at, n))]
                    yield pa.RecordBatch.from_arrays(columns, ["id", "pos", "n", "left", "free", "h"])

        return run

    w = Stored(texts.frame.mapInArrow(first, f"id {kind}, pos int, h bigint"))
    several = w.frame.groupBy("h").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("h")
    left = Stored(w.frame.join(several, "h", "left_semi").groupBy("id").agg(F.collect_list("pos").alias("places")))
    w.drop()
    found, low, high = [], least, least + 2
    while left.rows:
        tried = Stored(texts.frame.join(left.frame, "id").mapInArrow(longer(low, high), f"id {kind}, pos int, n int, left bigint, free boolean, h bigint"))
        left.drop()
        free = F.when(F.col("free"), F.col("id"))
        meet = tried.frame.groupBy("h").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.min("left").alias("c"), F.max("left").alias("d"), F.min(free).alias("e"), F.max(free).alias("f")).where("a < b and c < d")
        both = tried.frame.join(meet, "h").groupBy("id", "pos").agg(F.max(F.expr("case when free and (e <> id or f <> id) then n end")).alias("length"), F.max("n").alias("n"))
        ends = Stored(both.where(F.col("length").isNotNull() | (F.col("n") == high)))
        tried.drop()
        found.append(ends.frame.where("length is not null").select("id", F.col("pos").alias("start"), "length"))
        left = Stored(ends.frame.where(F.col("n") == high).groupBy("id").agg(F.collect_list("pos").alias("places")))
        low, high = high + 1, high + 2 * (high - low + 1)
    texts.drop()
    none = rows.where("false").select("id", F.lit(0).alias("start"), F.lit(0).alias("length"))
    return reduce(DataFrame.unionByName, found, none)


def largest_families(found: DataFrame, shown: int = 15) -> DataFrame:
    """The `shown` families of most members, which a report prints: family, members, rank; ties by name."""
    sizes = found.select("family", "members").distinct().orderBy(F.desc("members"), "family").limit(shown)
    return sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("members"), "family")))


def duplicated_tokens(found: DataFrame) -> DataFrame:
    """One row: the tokens of all members, a member without a length as one, for the gate."""
    return found.agg(F.coalesce(F.sum(F.coalesce(F.col("length"), F.lit(1))), F.lit(0)).alias("tokens"))


def literal_evidence(toks: Column) -> Column:
    """The distinct literal placeholders in an array of normalised tokens, in order of occurrence: which kinds a weak match left out."""
    return F.array_distinct(F.filter(toks, lambda t: t.isin(*LITERALS.values())))
