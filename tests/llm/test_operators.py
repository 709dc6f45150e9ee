from __future__ import annotations

import random
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest

from factloom.llm import bin_completion, direct_codes, jaccard_join, line_dedup, matroska, media, packing, quality_classifier, quality_rules, sentence_pieces, streaming_viterbi, string_kernel, subwords, substring_dedup, toxicity
from factloom.llm.textcore import texts_of

from . import brute

pytest.importorskip("public_tokenizers")
SYLLABLES = ["an", "er", "in", "th", "on", "re", "is", "to", "le", "ou", "ß", "é"]


def prose(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n))


def make_docs():
    rng = random.Random(5)
    docs = [(i, "\n".join(prose(rng, rng.randint(3, 30)) for _ in range(rng.randint(1, 6)))) for i in range(60)]
    base = prose(rng, 80)
    for i in range(60, 75):  # near copies of one text
        w = base.split()
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = "changed"
        docs.append((i, " ".join(w)))
    passage = prose(rng, 30)
    docs += [(i, prose(rng, 20) + "\n" + passage + "\n" + prose(rng, 20)) for i in range(75, 80)]
    docs += [(80, None), (81, ""), (82, " \n\t "), (83, "one two"), (84, "One TWO"), (85, "a " * 400), (86, docs[0][1]), (87, "x" * 9000 + "日本語"), (88, prose(rng, 6000))]
    return docs


DOCS = make_docs()


@pytest.fixture(scope="module")
def docs(spark):
    """With columns whose names clash with those that operators make."""
    return spark.createDataFrame([(i, t, 1.5, "k", i) for i, t in DOCS], "doc_id bigint, text string, score double, kept string, n bigint").repartition(5)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 5 > 0, i % 7 == 0) for i, _ in DOCS if i % 2], "doc_id bigint, quality boolean, toxic boolean").selectExpr("doc_id", "cast(quality as int) quality", "cast(toxic as int) toxic")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def empty(docs):
    return docs.where("doc_id < 0")


def test_quality_rules(docs, labels):
    got = by_id(quality_rules.score_quality_rules(docs, labels))
    assert len(got) == len(DOCS)
    for i, t in DOCS:
        n, chars, symbols, dup, repeat = brute.rule_counts(t)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat)
        assert r.base_failed == (n < 50 or 100 * repeat > 50 * n) and not (r.base_failed and r.kept)
    assert quality_rules.score_quality_rules(empty(docs), labels.where("false")).count() == 0


def test_quality_classifier(docs, labels):
    model = quality_classifier.QualityClassifier.fit(docs, labels)
    got = by_id(model.score_documents(docs))
    assert all(0 <= r.score <= 1 and r.held_out == (crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert model.keep_documents(docs).columns == docs.columns
    none = quality_classifier.QualityClassifier.fit(docs, labels.where("false")).score_documents(docs.limit(3)).collect()
    assert {r.score for r in none} == {0.5}


def test_packing(docs):
    got = packing.pack_documents(docs, capacity=64).collect()
    encoder = subwords.ChunkEncoder.of(subwords.public_path("word_bpe_49k.json"), "word")
    ids = {i: encoder.encode([t or ""])[0] + (1).to_bytes(4, "little") for i, t in DOCS}
    bins = {}
    for r in got:
        own = ids[r.doc_id][4 * r.start : 4 * (r.start + r.length)]
        assert r.ids_crc32 == crc32(own) and r.start == 64 * r.piece and len(own) == 4 * r.length
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(r.length for r in got) == sum(len(x) // 4 for x in ids.values())
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= -(-sum(r.length for r in got) // 64) + 2
    assert packing.pack_documents(empty(docs)).count() == 0


def test_bin_completion():
    rng = np.random.default_rng(3)
    for lengths in (rng.integers(1, 100, 300), rng.integers(30, 40, 120), np.array([100, 100, 1])):
        bin_of, offset, used = bin_completion.place(lengths, 100)
        assert (np.bincount(bin_of, lengths) == used).all() and used.max() <= 100
        assert len(used) <= len(bin_completion.best_fit_decreasing(lengths, 100)) and len(used) >= bin_completion.lower_bound(lengths, 100)


def test_line_dedup(docs):
    got = by_id(line_dedup.line_digest(docs))
    assert {i: r.removed for i, r in got.items()} == brute.removed_lines(DOCS)
    cut = by_id(line_dedup.remove_lines(docs))
    assert line_dedup.remove_lines(docs).columns == docs.columns and cut[80].text is None
    for i, t in DOCS:
        if t is not None:
            assert cut[i].text == "\n".join(x for k, x in enumerate(t.split("\n")) if k not in got[i].removed)
    assert line_dedup.line_digest(empty(docs)).count() == 0


def test_jaccard_join(docs):
    got = {i: (r.n_shingles, r.component_id) for i, r in by_id(jaccard_join.jaccard_components(docs)).items()}
    want = brute.jaccard_components(DOCS)
    assert got == want
    assert {r.doc_id for r in jaccard_join.keep_first(docs).collect()} == {i for i, (_, c) in want.items() if i == c}
    assert jaccard_join.jaccard_components(empty(docs)).count() == 0


def test_repeated_rows(docs):
    twice = docs.union(docs.where("doc_id in (3, 80, 62)"))
    assert jaccard_join.jaccard_components(twice).count() == len(DOCS) + 3
    assert jaccard_join.keep_first(twice).groupBy("doc_id").count().where("count > 1").count() == 0
    cut = substring_dedup.substring_digest(twice)
    assert cut.count() == len(DOCS) + 3 and cut.distinct().count() == len(DOCS)


def test_substring_dedup(docs):
    got = {i: (r.n_words, r.n_removed, r.kept_sha256) for i, r in by_id(substring_dedup.substring_digest(docs)).items()}
    assert got == brute.cut_repeats(DOCS)
    out = by_id(substring_dedup.remove_repeats(docs))
    assert all(out[i].text == t for i, t in DOCS if got[i][1] == 0) and substring_dedup.remove_repeats(docs).columns == docs.columns
    assert substring_dedup.substring_digest(empty(docs)).count() == 0


def test_null_ids(spark):
    rows = spark.createDataFrame([(None, "a b c d e f g h i j k l m n"), (1, "a b c d e f g h i j k l m n"), (2, None)], "doc_id bigint, text string")
    assert {r.doc_id: r.n_removed for r in substring_dedup.substring_digest(rows).collect()} == {None: 0, 1: 14, 2: 0}
    assert jaccard_join.jaccard_components(rows).count() == 3 and line_dedup.line_digest(rows).count() == 3


def test_direct_codes(docs):
    got = by_id(direct_codes.write_and_read(docs))
    encoder = subwords.ChunkEncoder.of(subwords.public_path("byte_bpe_50k.json"), "byte")
    start = 0
    for i, t in sorted(DOCS):
        ids = encoder.encode([t or ""])[0] + bytes(4)
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids) // 4, crc32(ids))
        start += len(ids) // 4
    ids = np.array([0, 255, 256, 65535, 65536, 50256] * 200)
    s = direct_codes.Segment.from_bytes(direct_codes.Segment.of(np.array([7]), np.array([0, len(ids)]), ids).to_bytes())
    assert (s.decode() == ids).all() and [s.access(i) for i in range(0, 1200, 7)] == ids[::7].tolist()


@pytest.mark.parametrize(("file", "kind"), [("word_bpe_49k.json", "word"), ("byte_bpe_50k.json", "byte")])
def test_chunks_equal_whole_texts(file, kind):
    rng = random.Random(1)
    texts = [t or "" for _, t in DOCS] + ["".join(rng.choice(" \n\t'saé1<|>.\x1c\x85 Z") for _ in range(40)) for _ in range(500)]
    e = subwords.ChunkEncoder(subwords.public_path(file), kind)
    whole = e.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert e.encode(texts) == [np.array(w.ids, subwords.ID).tobytes() for w in whole]


def test_toxicity(docs, labels):
    rng = random.Random(2)
    texts = [prose(rng, 30) + (" you idiot and moron. " if i % 4 == 0 else ". ") + prose(rng, 30) for i in range(400)]
    toxic = np.array([i % 4 == 0 for i in range(400)])
    m = string_kernel.fit(texts_of(pa.array(texts[:300])), toxic[:300])
    assert ((m.score(texts_of(pa.array(texts[300:]))) >= 0.5) == toxic[300:]).mean() > 0.97
    assert (m.score(texts_of(pa.array([prose(rng, 20) + " i-d.i-o-t m o r o n"]))) >= 0.5).all()
    got = by_id(toxicity.Toxicity.fit(docs, labels).score_documents(docs))
    assert len(got) == len(DOCS) and all(0 <= r.score <= 1 and r.held_out == (crc32(str(i).encode()) % 5 == 0) for i, r in got.items())


def test_matroska(docs):
    got = by_id(media.media_digest(docs))
    for i, t in DOCS:
        raw = (t or "").encode()
        assert got[i].n_bytes == len(raw) and got[i].payload_bytes == max(64, -(-len(raw) // 64) * 64)
    frames = [bytes([k]) * k for k in (200, 3, 255, 90)]
    for lacing in (matroska.XIPH, matroska.EBML_LACING):
        body = matroska.number(matroska.TIMESTAMP, 5) + matroska.element(matroska.SIMPLE_BLOCK, matroska.block(1, -2, frames, lacing))
        raw = matroska.element(matroska.EBML, b"") + b"\x18\x53\x80\x67\x01" + b"\xff" * 7 + matroska.element(matroska.CLUSTER, body)
        m = matroska.parse(raw)
        assert m.size == [200, 3, 255, 90] and matroska.samples(raw, m) == b"".join(frames) and m.time_ns[0] == 3_000_000
    with pytest.raises(ValueError):
        matroska.parse(b"no media at all")
    table = media.packet_table(media.to_media(docs.where("doc_id < 3")))
    assert table.where("error is not null").count() == 0 and table.select("doc_id").distinct().count() == 3


def test_sentence_pieces(docs):
    import sentencepiece

    path = subwords.public_path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    model = streaming_viterbi.SentencePieces.of(path)
    texts = [t or "" for _, t in DOCS] + ["  a  b ", "thereationing" * 200, "日本語 \x00 x", "x" * 300]
    got = [np.frombuffer(x, np.uint32).tolist() for x in model.encode(texts)]
    assert got == library.encode(texts)
    assert [model.decode(np.array(g, "<u4").tobytes()) for g in got] == [library.decode(g) for g in got]
    stream = streaming_viterbi.Stream(model.v)
    stream.feed("▁" + "thereationing" * 2000)
    assert stream.finish() == library.encode("thereationing" * 2000) and stream.most < 256
    assert all(r.round_trip for r in sentence_pieces.encoding_digest(docs).collect())
    encoded = sentence_pieces.encode_documents(docs)
    assert {r.doc_id: r.text for r in sentence_pieces.decode_documents(encoded).collect()} == {i: t or "" for i, t in DOCS}


def test_string_kernel_equals_brute_force():
    from itertools import combinations

    def features(word):
        out = {}
        for i, j, k in combinations(range(len(word)), 3):
            if k - i <= string_kernel.REACH:
                key = (word[i], word[j], word[k])
                out[key] = out.get(key, 0) + string_kernel.DECAY ** (k - i + 1)
        return out

    def cosine(a, b):
        dot = lambda x, y: sum(v * y.get(k, 0) for k, v in x.items())
        return dot(a, b) / max(dot(a, a) * dot(b, b), 1e-24) ** 0.5

    t = texts_of(pa.array(["idiot id-i.ot idiiiot moron morons banana ananas thereationing xyz"]))
    w = string_kernel.read_words(t)
    spans = [w.symbols[a : a + n] for a, n in zip(w.start, w.length, strict=True)]
    marks = string_kernel.Landmarks(spans)
    got = marks.kernel(w.symbols, w.start, w.length, exact=True)
    want = np.array([[cosine(features(a.tolist()), features(b.tolist())) ** string_kernel.POWER for b in spans] for a in spans])
    assert np.allclose(got, want, atol=1e-5) and np.linalg.eigvalsh(got.astype(float)).min() > -1e-6
    loose = marks.kernel(w.symbols, w.start, w.length)
    assert np.abs(loose - want).max() < string_kernel.SMALL**string_kernel.POWER


def test_toxicity_edges(spark, labels):
    rows = spark.createDataFrame([(None, "you moron"), (1, None), (2, ""), (3, "?!"), (4, "idiot " * 3000), (4, "idiot " * 3000)], "doc_id bigint, text string")
    machine = toxicity.Toxicity.fit(rows, labels)
    got = machine.score_documents(rows).collect()
    assert len(got) == 6 and len({r.score for r in got if r.doc_id in (1, 2, 3)}) == 1 and not any(r.held_out for r in got if r.doc_id is None)
    assert machine.score_documents(rows.where("false")).count() == 0
    assert toxicity.Toxicity.fit(rows.where("false"), labels).score_documents(rows).count() == 6
