"""Edge cases, brute-force comparisons and the promises of the exchange."""

from __future__ import annotations

import random
from hashlib import sha256
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factloom.llm import bin_completion, common, direct_codes, exchange, gam, iforest, jaccard_join, line_dedup, linking, matroska, media, packing, quality_classifier, quality_rules, subwords, substring_dedup
from factloom.llm.textcore import texts_of

from . import brute

pytest.importorskip("public_tokenizers")
SYLLABLES = ["an", "er", "in", "th", "on", "re", "is", "to", "le", "ou"]


def prose(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n))


def optimum(lengths, capacity):
    """Fewest bins, over all subsets."""
    best = [(len(lengths) + 1, 0)] * (1 << len(lengths))
    best[0] = (0, capacity)
    for m, (bins, used) in enumerate(best):
        for i, n in enumerate(lengths):
            if not m >> i & 1:
                new = (bins, used + n) if used + n <= capacity else (bins + 1, n)
                best[m | 1 << i] = min(best[m | 1 << i], new)
    return best[-1][0]


def test_bin_completion_equals_the_optimum():
    rng, better = np.random.default_rng(11), 0
    for k in range(600):
        lengths = rng.integers(1, 101, rng.integers(8, 12)) if k % 3 else rng.integers(15, 60, 11)
        best_fit = len(bin_completion.best_fit_decreasing(lengths, 100))
        if best_fit > bin_completion.lower_bound(lengths, 100):
            bins = bin_completion.bin_completion(lengths, 100)
            assert sorted(n for b in bins for n in b) == sorted(lengths.tolist()) and max(map(sum, bins)) <= 100
            assert len(bins) == optimum(lengths.tolist(), 100)
            better += len(bins) < best_fit
    assert better > 10
    full = np.concatenate([np.diff([0, *np.sort(rng.choice(np.arange(1, 4096), 7, replace=False)), 4096]) for _ in range(30)])
    assert len(bin_completion.bin_completion(full, 4096)) == 30


@pytest.mark.parametrize(("file", "kind"), [("word_bpe_49k.json", "word"), ("byte_bpe_50k.json", "byte")])
def test_added_tokens_as_the_library_has_them(file, kind):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(subwords.public_path(file))
    texts = ["hello <|endoftext|> x", "<|startoftext|><|endoftext|>", " a <|endoftext", "b"]
    want = [np.array(plain.encode(t, add_special_tokens=False).ids, subwords.ID).tobytes() for t in texts]
    assert subwords.ChunkEncoder.of(subwords.public_path(file), kind).encode(texts) == want


def test_media_values_and_faults(spark):
    texts = [(1, "abc"), (2, None), (3, "é" * 5000), (None, "abc"), (1, "abc")]
    rows = media.media_digest(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()
    for (i, text), r in zip(sorted(texts, key=str), sorted(rows, key=lambda r: str((r.doc_id, None))), strict=True):
        own = [x for x in rows if x.doc_id == i]
        raw = media.payload(text)
        assert any(x.payload_sha256 == sha256(raw).hexdigest() and x.tail_crc32 == crc32(raw[-64:]) and x.media_sha256 == sha256(matroska.mux(raw)).hexdigest() for x in own)
        assert all(f"sum={sum(raw)};" in x.feature and f"peak={max(raw)};" in x.feature for x in own if x.payload_sha256 == sha256(raw).hexdigest()) and r
    head = matroska.element(matroska.EBML, b"") + b"\x18\x53\x80\x67\x01" + b"\xff" * 7
    lace = bytes([0x81, 0, 0, matroska.FIXED << 1, 2]) + bytes(10)
    with pytest.raises(ValueError):
        matroska.parse(head + matroska.element(matroska.CLUSTER, matroska.element(matroska.SIMPLE_BLOCK, lace)))
    track = matroska.element(matroska.TRACK_ENTRY, matroska.element(matroska.RATE, b""))
    assert matroska.parse(head + track).tracks == [{matroska.RATE: 0.0}]
    bad = head + matroska.element(matroska.TRACK_ENTRY, matroska.element(matroska.RATE, b"abc"))
    table = media.packet_table(spark.createDataFrame([(1, bad), (2, None)], "doc_id bigint, media binary")).collect()
    assert len(table) == 2 and all(r.error for r in table)


def test_tokens_at(spark, tmp_path):
    rows = spark.createDataFrame([(i, "word " * i) for i in range(40)], "doc_id bigint, text string").repartition(4)
    direct_codes.write_codes(rows, str(tmp_path / "codes"), segment_tokens=50)
    encoder = subwords.ChunkEncoder.of(subwords.public_path("byte_bpe_50k.json"), "byte")
    ids = np.frombuffer(encoder.encode(["word " * 30])[0], subwords.ID).tolist() + [0]
    assert direct_codes.tokens_at(spark, str(tmp_path / "codes"), 30, [0, 7, 29, 30]) == [ids[k] for k in (0, 7, 29, 30)]
    assert direct_codes.tokens_at(spark, str(tmp_path / "codes"), 99, [0]) == []


def test_clashing_names(spark):
    rows = spark.createDataFrame([(1, "a b\nc d\na b", "x", 1, "y", 2, 3)], "doc_id bigint, text string, __doc string, __key int, __row string, __removed int, __spans int")
    for one in (jaccard_join.keep_first(rows), line_dedup.remove_lines(rows), substring_dedup.remove_repeats(rows)):
        assert one.columns == rows.columns and one.drop("text").collect() == rows.drop("text").collect()
    assert line_dedup.remove_lines(rows).first().text == "a b\nc d"


def test_null_ids_and_two_texts_of_one_id(spark):
    a, b = (" ".join(f"{c}{k}" for k in range(80)) for c in "ab")
    rows = [(5, a), (None, a + " more"), (7, a + " other"), (7, b), (3, b + " more"), (9, b + " rest"), (11, None), (None, None)]
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == sorted(
        [("5", 76, "5"), ("None", 77, "5"), ("7", 77, "5"), ("7", 76, "3"), ("3", 77, "3"), ("9", 77, "3"), ("11", 0, "11"), ("None", 0, "None")]
    )


def near_copy_groups(rng):
    """Groups in which many documents link and many just don't."""
    docs = []
    for _ in range(3):
        base = prose(rng, 140).split()
        for _ in range(70):
            w = list(base)
            for _ in range(rng.randint(0, 9)):
                w[rng.randrange(len(w))] = rng.choice(["changed", "other", prose(rng, 1)])
            docs.append(" ".join(w))
    passage = prose(rng, 60)
    docs += [f"{prose(rng, rng.randint(5, 40))} {passage} {prose(rng, rng.randint(5, 40))}" for _ in range(60)]
    return list(enumerate(docs))


def test_near_copy_groups_equal_brute_force(spark):
    docs = near_copy_groups(random.Random(4))
    got = jaccard_join.jaccard_components(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(6)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.jaccard_components(docs)


def test_repeats_equal_brute_force(spark):
    rng = random.Random(8)
    words = ["a", "b", "c"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(60)]
    parts = [prose(rng, n) for n in (12, 13, 14, 40, 300)]
    docs += [(i, " ".join([prose(rng, rng.randint(0, 9)), *rng.sample(parts, 3), prose(rng, 5)])) for i in range(60, 100)]
    docs += [(i, "x y " * rng.randint(3, 40)) for i in range(100, 120)]
    rng.shuffle(docs)
    got = substring_dedup.substring_digest(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(7)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == brute.cut_repeats(docs)


def test_lines_equal_brute_force_and_recall(spark):
    rng = random.Random(6)
    base, pairs, docs = [], 0, []
    for k in range(150):
        line = prose(rng, 200)[: rng.randint(20, 300)]
        letters = list(line)
        near = line
        while True:  # edits until the similarity is just above the threshold
            letters[rng.randrange(len(letters))] = rng.choice("xyzw")
            s, t = ({x[i : i + 5] for i in range(len(x) - 4)} for x in (line, "".join(letters)))
            if len(s & t) < 0.75 * len(s | t):
                break
            near = "".join(letters)
        pairs += near != line
        base.append((line, near))
        docs += [(2 * k, line), (2 * k + 1, near + "\n" + line if k % 3 else near)]
    got = {r.doc_id: r.removed for r in line_dedup.line_digest(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)).collect()}
    want = brute.removed_lines(docs)
    missed = [i for i in want if got[i] != want[i]]
    assert pairs > 100 and len(missed) <= 0.01 * pairs + 1


def test_exchange_rows_grow_with_the_input(spark):
    """With many ranges the rows between tasks are in proportion to the chunks, and the answers are the same."""
    rng = np.random.default_rng(1)

    def run(chunks, ranges, direct, sent):
        table = spark.createDataFrame(pd.DataFrame({"doc_id": range(chunks), "text": [f"t{i}" for i in range(chunks)]})).coalesce(4)

        def deal(batch):
            n = batch.column(0)[0].as_py()
            asked = {r: (n + r) % 7 for r in range(ranges)}
            for _ in asked:
                sent.add(1)
            return n, asked

        return exchange.exchange(table, ranges, deal, lambda at, asked: [sorted(asked)[0]] * len(asked), lambda own, replies: pd.DataFrame({"doc_id": [own], "n": [sum(replies)]}), "doc_id bigint, n bigint", direct=direct, alone=True)

    same = [{r.doc_id: r.n for r in run(30, 40, direct, spark.sparkContext.accumulator(0)).collect()} for direct in (1000, 4)]
    assert same[0] == same[1] and len(same[0]) == 30 and rng is not None
    rows = []
    for chunks, ranges in ((16, 64), (64, 256)):  # four times the input: four times the chunks and the ranges
        dealt = spark.createDataFrame([(c, g) for c in range(chunks) for g in range(int(ranges**0.5))], "chunk bigint, at bigint")
        wide = int(ranges**0.5)
        pack = F.udf(lambda c, g: __import__("pickle").dumps({g * wide + k: [(c, k)] for k in range(wide)}), "binary")
        moved = exchange._deal_on(dealt.select("chunk", "at", pack("chunk", "at").alias("raw")), 2 * wide)
        rows.append(moved.count())
    assert rows[1] <= 4.5 * rows[0]


def test_chunks_do_not_hang_on_the_order_of_a_shuffle(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id bigint, text string")
    assert exchange.steady(docs) is docs and exchange.steady(docs.where("doc_id > 3")).columns == docs.columns
    shuffled = docs.repartition(3, "doc_id")
    assert exchange.steady(shuffled) is not shuffled
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, None], "text": ["a", None]})
    assert exchange.chunk_number(batch) == exchange.chunk_number(batch.slice(0)) != exchange.chunk_number(batch.slice(1))


def test_additive_model_equals_its_tables():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(int)
    m = gam.AdditiveModel.fit(x[:2000], y[:2000])
    assert ((m.score(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.9  # an interaction that no single table has
    b = m.bins(x[:50])
    for row, got in zip(b.tolist(), m.score(x[:50]), strict=True):
        z = m.base + sum(t[i] for t, i in zip(m.single, row, strict=True)) + sum(t[row[i] // m.coarse, row[j] // m.coarse] for (i, j), t in zip(m.pairs, m.double, strict=True))
        assert abs(1 / (1 + np.exp(-z)) - got) < 1e-9


def test_forest_equals_a_walk_by_hand():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 3))
    forest = iforest.IsolationForest.fit(x, trees=16, subsample=64)
    for row, got in zip(x[:20], forest.score(x[:20]), strict=True):
        total = 0.0
        for f, s, c, p in zip(forest.feature, forest.split, forest.left, forest.length, strict=True):
            node = 0
            while f[node] >= 0:
                node = c[node] + int(row[f[node]] > s[node])
            total += p[node]
        assert abs(2 ** (-total / 16 / forest.unit) - got) < 1e-9
    assert forest.score(np.full((1, 3), 9.0))[0] > np.quantile(forest.score(x), 0.95)
    score, good = np.array([0.1, 0.2, 0.3, 0.8, 0.9]), np.array([True, True, True, False, False])
    assert 0.3 <= iforest.calibrate(score, good) < 0.8 and iforest.calibrate(score, ~good & False) == 1.0


def test_models_on_ties_nulls_and_long_texts(spark):
    rng = random.Random(3)
    good = [prose(rng, 80) for _ in range(60)]
    junk = ["#$% | " * 60 for _ in range(20)]
    rows = [(i, t) for i, t in enumerate(good + junk)] + [(None, good[0]), (500, None), (501, ""), (502, prose(rng, 20_000)), (0, good[0])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(80)] + [(None, 1), (3, None)], "doc_id bigint, quality int")
    rules = quality_rules.score_quality_rules(docs, labels).collect()
    kept = {r.doc_id: r.kept for r in rules}
    assert len(rules) == len(rows) and sum(kept[i] for i in range(60)) >= 58 and not any(kept[i] for i in range(60, 80)) and not kept[500] and not kept[501]
    assert all(r.kept == (not r.base_failed and r.kept) for r in rules)
    scored = quality_classifier.QualityClassifier.fit(docs, labels).score_documents(docs).collect()
    assert len(scored) == len(rows) and len({r.score for r in scored if r.doc_id in (500, 501)}) == 1
    held = [r for r in scored if r.held_out and r.doc_id is not None and r.doc_id < 80]
    assert held and all(r.predicted == int(r.doc_id < 60) for r in held)
    assert quality_classifier.QualityClassifier.fit(docs, labels).score_documents(docs.where("false")).count() == 0


def test_packing_of_an_empty_and_a_null_text(spark):
    rows = spark.createDataFrame([(1, None), (1, None), (None, ""), (2, "a b c")], "doc_id bigint, text string")
    got = packing.pack_documents(rows).collect()
    assert len(got) == 4 and sorted(r.length for r in got)[:3] == [1, 1, 1] and len({r.sequence_id for r in got}) == 1


def test_no_session_settings_change(spark):
    before = dict(spark.conf.getAll)
    docs = spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")
    media.packet_table(media.to_media(docs)).count(), direct_codes.write_and_read(docs).count(), common.kept(docs)
    assert dict(spark.conf.getAll) == before


def test_tokens_beside_a_pivot(spark):
    """The blocks' size changes nothing, and all pairs equal brute force."""
    from factloom.llm.linking import beside_pivot

    rng = random.Random(9)
    rows = [(i, i % 7, 20, rng.randrange(2), rng.randint(10, 16), sorted(rng.sample(range(12), rng.randint(0, 6)))) for i in range(80)]
    table = spark.createDataFrame(rows, "id bigint, c bigint, n bigint, p bigint, s bigint, extra array<bigint>")
    want = set()
    for x in rows:
        for y in rows:
            e = len(set(x[5]) & set(y[5]))
            same = min(x[4], y[4]) + e
            if x[0] < y[0] and x[3] == y[3] and x[1] != y[1] and e and 100 * same >= 75 * (40 - same):
                want.add((x[0], y[0]))
    for block in (7, 1000):
        got = [(r.a, r.b) for r in beside_pivot(table, 75, block).collect()]
        assert set(got) == want and len(got) == len(want) > 10


class _Counting:
    """A tokenizer that counts what it is asked to encode."""

    def __init__(self, own):
        self.own, self.asked, self.most = own, 0, 0

    def encode_batch_fast(self, texts, **kw):
        self.asked, self.most = self.asked + len(texts), max(self.most, len(texts))
        return self.own.encode_batch_fast(texts, **kw)


@pytest.mark.parametrize(("file", "kind"), [("word_bpe_49k.json", "word"), ("byte_bpe_50k.json", "byte")])
def test_the_library_sees_parts_of_words_once(file, kind):
    rng = random.Random(4)
    texts = [" ".join(f"so{rng.choice('.,;:!?')} {rng.choice('0123456789')}{rng.choice('abc')}{rng.choice('0123456789')}{rng.choice('abc')}{rng.choice('0123456789')}" for _ in range(50)) for _ in range(200)]
    e = subwords.ChunkEncoder(subwords.public_path(file), kind)
    whole = e.tokenizer.encode_batch(texts, add_special_tokens=False)
    e.tokenizer = _Counting(e.tokenizer)
    assert e.encode(texts) == [np.array(w.ids, subwords.ID).tobytes() for w in whole]
    assert e.tokenizer.asked < 60  # as whole words, some thousands


@pytest.mark.parametrize(("file", "kind"), [("word_bpe_49k.json", "word"), ("byte_bpe_50k.json", "byte")])
def test_cuts_beside_any_character_and_a_full_cache(file, kind):
    rng = random.Random(5)
    signs = " \n\t'saSTrelvmdLéÉ1234<|>._-Ḱ̸̌ \xa0　\x1c\x85 ZßJjİ’你"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(3000)]
    e = subwords.ChunkEncoder(subwords.public_path(file), kind, held=500)
    whole = [np.array(w.ids, subwords.ID).tobytes() for w in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x for a in range(0, 3000, 100) for x in e.encode(texts[a : a + 100])] == whole
    assert len(e.ids) == e.cut[-1] and sum(map(len, e.known.to_pylist())) <= 500
    assert e.encode(pa.array(["a", None, ""])) == [*e.encode(["a"]), b"", b""] and e.encode([]) == []


def test_the_library_holds_few_results_at_a_time():
    e = subwords.ChunkEncoder(subwords.public_path("byte_bpe_50k.json"), "byte")
    texts = ["".join(random.Random(i).choices("abcdefgh", k=8)) for i in range(5000)]
    whole = e.tokenizer.encode_batch(texts, add_special_tokens=False)
    e.tokenizer = _Counting(e.tokenizer)
    assert e.encode(texts) == [np.array(w.ids, subwords.ID).tobytes() for w in whole]
    assert e.tokenizer.asked > 2 * subwords.AT_ONCE >= 2 * e.tokenizer.most


def test_a_pair_of_many_buckets_is_listed_once(spark):
    rng = random.Random(6)
    buckets = {(k, i, i % 7 if i < 20 else i) for k in range(8) for i in range(40) if rng.random() < 0.7}
    rows = spark.createDataFrame(sorted(buckets), "key bigint, id bigint, c bigint")
    about = rows.select("id", F.col("id").alias("n")).distinct()
    listed = [(r.a, r.b) for r in linking.cross(rows, about, "na + nb > 5", True).collect()]
    want = {(i, j) for k, i, c in buckets for m, j, d in buckets if k == m and i < j and c != d and i + j > 5}
    assert len(listed) == len(set(listed)) and set(listed) == want
    assert {(r.a, r.b) for r in linking.cross(rows, about, "na + nb > 5").collect()} == want


def test_verification_reads_a_bounded_part_at_a_time(spark):
    """Pairs of long items are read a few at a time, and a pair that is longer than the bound alone."""
    rng = random.Random(7)
    lines = [bytes(rng.choices(b"abcd", k=60_000 if i else 3 << 20)) for i in range(200)]
    sets = spark.createDataFrame([(i, len(line_dedup._read([x])[0]), x) for i, x in enumerate(lines)], "id bigint, n bigint, tokens binary").coalesce(1)
    pairs = spark.createDataFrame([(i, i + 1) for i in range(199)], "a bigint, b bigint").coalesce(1)

    def read(items):
        if len(items) > 2 and sum(map(len, items)) > 4 << 20:
            raise ValueError("too much at a time")
        return line_dedup._read(items)

    got = linking.verify(pairs, sets, 75, read).collect()
    of = [set(x.tolist()) for x in line_dedup._read(lines)]
    assert {(r.a, r.b): r.same for r in got} == {(i, i + 1): len(of[i] & of[i + 1]) for i in range(199)}


def test_components_of_few_edges_take_one_round(spark):
    """Few edges are joined by one task, many in rounds first, with the same result; a chain of 300 nodes takes two tables instead of some for each round."""
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(300)] + [(rng.randrange(400, 700), rng.randrange(400, 700)) for _ in range(200)] + [(900, 900)]
    node = {x: x for e in edges[:-1] for x in e if e[0] != e[1]}
    while any(node[a] != node[b] for a, b in edges[:-1] if a != b):
        for a, b in edges[:-1]:
            if a != b:
                node[a] = node[b] = min(node[a], node[b])
    table = spark.createDataFrame(edges, "a bigint, b bigint")
    for local in (0, 20, 1000):
        before = common.written()
        got = linking.components(table, local).collect()
        assert {r.node: r.component for r in got} == node and len(got) == len(node)
        assert local < 1000 or common.written() - before == 2
    assert linking.components(table.where("a = 900")).count() == 0


def test_small_pivots_share_a_task(spark):
    """Pivots of a few items are counted many at a time, those of more than a block in groups of their own, and lots change nothing."""
    rng = random.Random(10)
    rows = [(i, i % 9, 20, i // 3 if i < 300 else 1000, rng.randint(10, 16), sorted(rng.sample(range(9), rng.randint(0, 5)))) for i in range(340)]
    table = spark.createDataFrame(rows, "id bigint, c bigint, n bigint, p bigint, s bigint, extra array<bigint>")
    want = set()
    for x in rows:
        for y in rows:
            e = len(set(x[5]) & set(y[5]))
            same = min(x[4], y[4]) + e
            if x[0] < y[0] and x[3] == y[3] and x[1] != y[1] and e and 100 * same >= 75 * (40 - same):
                want.add((x[0], y[0]))
    for lots in (1, 5):
        got = [(r.a, r.b) for r in linking.beside_pivot(table, 75, 16, lots).collect()]
        assert set(got) == want and len(got) == len(want) > 5


def near_lines(rng, n):
    """Lines of one stem: many pairs link and many just don't."""
    stem = prose(rng, 30).split()
    out = set()
    while len(out) < n:
        w = list(stem)
        for _ in range(rng.randint(1, 5)):
            w[rng.randrange(len(w))] = prose(rng, 1)
        out.add(" ".join(w))
    return sorted(out)


def test_pairs_of_near_lines_are_no_rows(spark, monkeypatch):
    """A group of near lines costs rows in proportion to its lines, in one block and in several, and has the components of all its pairs."""
    lines = near_lines(random.Random(21), 400)
    sets = [{x[i : i + 5] for i in range(len(x) - 4)} for x in lines]
    root = list(range(len(lines)))
    for i in range(len(lines)):
        for j in range(i):
            same = len(sets[i] & sets[j])
            if root[i] != root[j] and 100 * same >= 75 * (len(sets[i]) + len(sets[j]) - same):
                root = [root[j] if r == root[i] else r for r in root]
    want = {frozenset(i for i, r in enumerate(root) if r == k) for k in set(root)}
    assert 3 < len(want) < 390
    for blocks, cells in ((1, 1), (5, 15)):
        rows = [(k, i, blocks, i, len(s), [0], x.encode(), [3 + i % 2, 7]) for i, (s, x) in enumerate(zip(sets, lines, strict=True)) for k in (3 + i % 2, 7)]
        table = spark.createDataFrame(rows, "key bigint, id bigint, blocks int, c bigint, n bigint, near array<bigint>, tokens binary, keys array<bigint>")
        edges = [(r.a, r.b) for r in linking.link_in_blocks(table, 75, line_dedup._read, lambda x, y: np.ones(len(x), bool)).collect()]
        parent = list(range(len(lines)))
        for a, b in edges:
            parent = [parent[a] if p == parent[b] else p for p in parent]
        assert {frozenset(i for i, r in enumerate(parent) if r == k) for k in set(parent)} == want
        assert len(edges) < 2 * cells * 2 * len(lines) // blocks
    asked, verify = [], linking.verify

    def counted(pairs, *rest, **named):
        asked.append(pairs.count())
        return verify(pairs, *rest, **named)

    monkeypatch.setattr(linking, "verify", counted)
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string").repartition(3)
    got = {r.doc_id for r in line_dedup.line_digest(docs).where("n_removed = 1").collect()}
    assert sum(asked) <= linking.ROUNDS * len(lines)  # 12,307 before
    assert len(got ^ {i for k in want for i in k if i != min(k)}) <= 2


def test_bands_come_with_their_lines_once(spark):
    """A row a band, of lines that have a like one in it, however its rows are dealt."""
    near = {1: [0] * 4, 2: [0] * 4, 3: [-1] * 4, 4: [0] * 4}
    found = spark.createDataFrame([(i, 50 if i < 4 else 90, near[i], bytes(60), [5, 9 + i // 3]) for i in (2, 1, 3, 4, 1)], "id bigint, n bigint, near array<bigint>, line binary, keys array<bigint>")
    got = sorted((r.key, r.ids, r.sizes, r.blocks) for r in line_dedup.near_in_buckets(found.repartition(3), 10).collect())
    assert got == [(5, [1, 2], [60, 60], 1), (9, [1, 2], [60, 60], 1)]
    assert line_dedup.near_in_buckets(found.where("id = 3"), 1).count() == 0
