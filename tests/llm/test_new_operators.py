"""Resampling, URL filters and spelling variants against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict
from math import floor, log
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest

from factloom.llm import importance, queries, spelling, url_templates
from factloom.llm.word_trie import WordTrie, words_of

from ..oracle import compare

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    got, want, differ = compare(spark, SMALL, queries.QUERIES[name], queries.ORACLES[name])
    assert (got == want > 0) and not differ


# resampling


def texts(rng, n):
    vocabulary = ["alpha", "Beta", "GAMMA", "ÉTÉ", "日本", "x1", "mp3"]
    return [" ".join(rng.choice(vocabulary) + rng.choice(["", ",", "-", "!"]) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def features(text, n):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def brute_resampled(docs, target, n, buckets, share, least):
    count = lambda rows: Counter(crc32(f.encode()) % buckets for t in rows for f in features(t, n)[1])
    s, t = count(x for _, x in docs), count(target)
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [floor(1000 * log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    rows = []
    for i, x in docs:
        words, own = features(x, n)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[crc32(f.encode()) % buckets] for f in own)
        rows.append((i, len(own), weight, weight + floor(-1000 * log(-log((h + 0.5) / 4294967296))), len(words)))
    order = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = [(*r[:4], k + 1) for k, r in enumerate(order[: share * len(order) // 100])]
    left = [(*r[:4], None) for r in order[len(drawn) :]] + [(*r[:4], None) for r in rows if r[4] < least]
    return sorted(drawn + left, key=str)


@pytest.mark.parametrize("n", [1, 3])
def test_resampling_is_brute_force(spark, monkeypatch, n):
    rng = random.Random(n)
    docs = list(enumerate(texts(rng, 120))) + [(500, None), (501, ""), (502, "?! ,"), (503, "word " * 30_000), (7, "alpha beta " * 15), (None, "beta " * 40), (504, "x1 " * 25), (504, "x1 " * 25)]
    target = texts(rng, 9) + [None]
    monkeypatch.setattr(importance, "NODES", 16)  # every slice begins a trie of its own
    frame = spark.createDataFrame([(i, t, 1.0, "w", 2) for i, t in docs], "doc_id bigint, text string, score double, weight string, part int").repartition(5)
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.resample(frame, wanted, words=n, buckets=97, share=30, least_words=5)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_resampled(docs, target, n, 97, 30, 5)


def test_resampling_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert importance.resample(none, none).collect() == []
    some = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    assert {r["doc_id"]: (r["n_features"], r["rank"]) for r in importance.resample(some, none).collect()} == {1: (2, None), 2: (0, None)}


def test_ranks_are_numbered_across_ranges(spark):
    """Half the rows have one score and id."""
    rows = spark.range(4000).selectExpr("if(id % 2 = 0, 5, id) as score", "if(id % 2 = 0, 1, id) as doc_id", "id as row").repartition(7)
    got = importance.ranked(rows, 2500).where("rank is not null").orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 2501))
    want = sorted(((5, 1, i) if i % 2 == 0 else (i, i, i) for i in range(4000)), key=lambda r: (-r[0], r[1], r[2]))
    assert [(r["score"], r["doc_id"], r["row"]) for r in got] == want[:2500]


def test_trie_states():
    trie = WordTrie(3)
    rows = words_of(pa.array(["a b c a b", None, "b c", ""]))
    levels = trie.walk(rows)
    assert [len(nodes) for nodes, _ in levels] == [7, 5, 3]
    runs = [" ".join(w.decode() for w in r[i : i + n]) for n in (1, 2, 3) for r in rows for i in range(len(r) - n + 1)]
    assert [trie.state[k] for nodes, _ in levels for k in nodes.tolist()] == [crc32(r.encode()) for r in runs]
    assert np.array_equal(trie.walk(rows)[2][0], levels[2][0])  # the same nodes again


# spelling


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(counts):
    out, form = {}, {}
    for w, n in counts.items():
        beside = [v for v in counts if near(w, v)]
        best = min(beside, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= 2 * n else None
        out[w] = (n, len(beside), counts[form[w]] if form[w] else None)
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, *out[w])
    return out


@pytest.mark.parametrize("block", [2, 64])
def test_near_words_are_brute_force(spark, block):
    """Few letters, so that blocks are large and are subdivided to the end."""
    rng = random.Random(block)
    counts = {"".join(rng.choice("abé") for _ in range(rng.randint(5, 8))): rng.choice([3, 4, 9, 20, 50]) for _ in range(260)}
    counts |= {"x" * 300: 3, "x" * 301: 8, "x" * 150 + "y" + "x" * 150: 20}
    words = spelling.kept(spark.createDataFrame(list(counts.items()), "word string, n bigint").repartition(5))
    got = {r["word"]: (r["n_near"], r["form"], r["form_n"]) for r in spelling.near_words(words, block).collect()}
    want = {}
    for w in counts:
        beside = [v for v in counts if near(w, v)]
        if beside:
            best = min(beside, key=lambda v: (-counts[v], v))
            want[w] = (len(beside), best, counts[best])
    assert got == want


def test_blocks_of_a_hot_beginning_stay_bounded(spark, monkeypatch):
    """A thousand words that share their first half: no block that is scanned has more than the bound, or a word a letter and one."""
    rng = random.Random(1)
    words = list({"shared" + "".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(1000)})
    rows = spelling.kept(spark.createDataFrame([(w, 3) for w in words], "word string, n bigint"))
    scan = spelling._scan

    def noted(batches):
        for b in batches:
            block = spelling._blocks(pa.Table.from_batches([b]))
            assert not len(block) or np.bincount(block).max() <= 16
            yield from scan(iter([b]))

    monkeypatch.setattr(spelling, "_scan", noted)
    got = {r["word"]: r["n_near"] for r in spelling.near_words(rows, 16).collect()}
    by_gap = defaultdict(list)
    for w in words:
        for i in range(len(w)):
            by_gap[w[:i] + "?" + w[i + 1 :]].append(w)
    want = Counter()
    for group in by_gap.values():
        for w in group:
            want[w] += len(group) - 1
    assert got == {w: n for w, n in want.items() if n}


def test_spelling_variants(spark):
    rng = random.Random(3)
    stems = ["receive", "separate", "été", "Straße", "naïveté", "definitely"]
    docs = [(i, " ".join(rng.choice(stems)[: rng.choice([99, 99, 6])] + rng.choice(["", "", "s", ";", "\n"]) for _ in range(80))) for i in range(70)]
    docs += [(100, None), (101, ""), (102, "recieve " * 4 + "receve " * 3), (None, "receive " * 9), (None, "receive " * 9), (103, "definitely," * 20_000)]
    frame = spark.createDataFrame([(i, t, 1, "f") for i, t in docs], "doc_id bigint, text string, n int, form string").repartition(4)
    counts = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.spelling_variants(frame, 4).collect()}
    assert got == brute_variants(counts) and any(v[0] for v in got.values())
    assert spelling.spelling_variants(frame.where("doc_id < 0")).collect() == []


# URL filters


def test_rules_and_parsing(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Net/x?y", "https://www.EXAMPLE.net/en/1", "https://example.net/en", "http://badexample.net/en/1", "https://m.example.com/de/3#x", "https://net", "https://x.net:80/a", "https://a.org?u=/fr/", "https://a.org/fr/", "x://y://net/"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(99, "https://a.org/fr/", "r")], "page_id bigint, url string, rule string")
    none = spark.createDataFrame([], "url string, good bigint")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_templates.judged(pages, none).collect()}
    assert got == {
        0: ("", "", None, "allow"), 1: ("", "", None, "allow"), 2: ("", "", None, "allow"), 3: ("", "", None, "allow"),
        4: ("a.net", "/x", "net/", "block"), 5: ("www.example.net", "/en/1", "example.net/en/", "allow"), 6: ("example.net", "/en", "net/", "block"),
        7: ("badexample.net", "/en/1", "net/", "block"), 8: ("m.example.com", "/de/3", "example.com/de/", "block"), 9: ("net", "", None, "allow"),
        10: ("x.net:80", "/a", None, "allow"), 11: ("a.org", "", None, "allow"), 12: ("a.org", "/fr/", "org/fr/", "allow"), 13: ("y:", "//net/", None, "allow"), 99: ("a.org", "/fr/", "org/fr/", "allow"),
    }
    assert url_templates.judged(pages.where("page_id < 0"), none).collect() == []


def brute_tree(pages, marks):
    """The same tree, a host and node at a time."""
    segs = lambda u: tuple(re.sub("[0-9]+", "#", u.split("//", 1)[1].partition("/")[2]).split("/"))
    host = lambda u: u.split("//", 1)[1].split("/")[0]
    rows = Counter((host(u), segs(u)) for u in pages)
    lab, good = Counter((host(u), segs(u)) for u, _ in marks), Counter()
    for u, g in marks:
        good[host(u), segs(u)] += g
    whole = (sum(good.values()) + 1) / (sum(lab.values()) + 2)
    smooth = lambda g, n, p: (g + 8.0 * p) / (n + 8.0)
    out = {}

    def grow(own, level, template, purity):
        for k in own:
            if len(k[1]) == level:
                out[k] = (template, purity)
        own = [k for k in own if len(k[1]) > level]
        kids = defaultdict(list)
        for k in own:
            kids[k[1][level]].append(k)
        total = sum(rows[k] for k in own)
        s = lambda c, ks: sum(c[k] for k in ks)
        literal = [x for x, ks in kids.items() if s(rows, ks) >= 4 and s(rows, ks) * 100 >= total]
        p = {x: smooth(s(good, kids[x]), s(lab, kids[x]), purity) for x in literal}
        e = {x: sum(rows[k] for k in kids[x] if len(k[1]) == level + 1) / s(rows, kids[x]) for x in literal}
        v = {x: p[x] * (1 - p[x]) / (s(lab, kids[x]) + 8.0) for x in literal}
        branches = []
        for x in sorted(literal, key=lambda x: (p[x], x)):
            b = branches[-1][-1] if branches else None
            if b is None or (p[x] - p[b]) ** 2 > 3.84 * (v[x] + v[b]) or abs(e[x] - e[b]) > 0.25:
                branches.append([])
            branches[-1].append(x)
        rest = [x for x in kids if x not in literal]
        for names, label in [(b, "|".join(sorted(b))) for b in branches] + ([(rest, "*")] if rest else []):
            ks = [k for x in names for k in kids[x]]
            grow(ks, level + 1, f"{template}/{label}", smooth(s(good, ks), s(lab, ks), purity))

    for h in {k[0] for k in rows}:
        own = [k for k in rows if k[0] == h]
        grow(own, 0, "", smooth(sum(good[k] for k in own), sum(lab[k] for k in own), whole))
    return {u: out[host(u), segs(u)] for u in pages}


def test_template_tree_is_brute_force(spark):
    rng = random.Random(2)
    pages, bad = [], {"ads": 0.9, "tag": 0.8, "blog": 0.05, "wiki": 0.1, "spam": 0.95}
    for i in range(1500):
        section = rng.choice(list(bad))
        middle = rng.choice([f"{rng.choice('abc')}-{rng.randrange(300)}", f"slug{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}", "top"])
        pages.append(f"https://{rng.choice(['big.com', 'big.com', 'small.org'])}/{section}/{middle}" + rng.choice(["", "/", f"/{i}.html"]))
    marks = [(u, int(rng.random() > bad[u.split("/")[3]])) for u in pages if rng.random() < 0.4]
    frame = spark.createDataFrame([(i, u) for i, u in enumerate(pages)], "page_id bigint, url string").repartition(6)
    got = url_templates.judged(frame, spark.createDataFrame(marks, "url string, good bigint"), ()).collect()
    want = brute_tree(pages, marks)
    for r in got:
        template, purity = want[pages[r["page_id"]]]
        assert r["template"] == template and abs(r["purity"] - purity) < 1e-12
        assert r["verdict"] == ("block" if purity < 0.5 else "allow")
    assert len(got) == len(pages) and len({t for t, _ in want.values()}) == 8
    blocked = {pages[r["page_id"]].split("/")[3] for r in got if r["verdict"] == "block"}
    assert {"ads", "spam"} <= blocked and not blocked & {"blog", "wiki"}


def test_deep_paths_end_in_one_segment(spark):
    urls = [f"https://h.com/{'/'.join('abcdefghijkl')}/{i % 3}" for i in range(20)] + ["https://h.com", "https://h.com/" + "q" * 50_000]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id bigint, url string")
    got = {r["page_id"]: r["template"] for r in url_templates.judged(pages, spark.createDataFrame([], "url string, good bigint"), ()).collect()}
    assert got[0] == "/a/b/c/d/e/f/g/h/i/j/k/l/#" and got[20] == "" and got[21] == "/*"


def test_direct_codes_of_shuffled_rows(spark):
    """Input past a shuffle, with rows of equal ids and equal texts."""
    pytest.importorskip("public_tokenizers")
    from factloom.llm import direct_codes

    rows = [(i % 7, f"text {i % 3} " * (i % 5)) for i in range(400)] + [(None, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6).join(spark.range(7).withColumnRenamed("id", "doc_id"), "doc_id", "left").distinct().repartition(5)
    got = direct_codes.write_and_read(docs).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"] for r in got)) == sorted(-1 if i is None else i for i, _ in set(rows))
    starts = sorted((r["start"], r["n_tokens"]) for r in got)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False))
