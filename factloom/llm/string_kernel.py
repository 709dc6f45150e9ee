"""Subsequence string-kernel support vector machine with Nyström landmarks, over sentences.

Two words are compared by the symbol triples that both have as subsequences: each triple counts with DECAY to the power
of the span it takes (REACH + 1 symbols at most), so gaps and inserted characters lower the similarity without ending it. The
cosine of the two is raised to a power, which mutes chance likeness. The kernel of two sentences is the sum over their distinct words.
Landmarks are sentences of one word. In the feature space that they span (Nyström) a linear support vector machine with
squared hinge loss is trained on labelled sentences; a text is scored by the margins of its two worst sentences.

Words are spans of symbols: lower-case letters, digits read as the letters they stand for, and the bytes of other
letters. Everything else inside a word is skipped, and single letters in a row are one word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .textcore import U64, Texts, hash_spans, mix, words_of

DECAY, REACH, POWER = 0.6, 7, 4
#: Cosines that can't reach this are not told exactly.
SMALL = 0.3
#: Words of a sentence; longer ones go on as further sentences.
SENTENCE = 64
#: Symbols of the beginnings of words that may be landmarks, the sign of a beginning included.
STEMS = range(5, 12)
#: Digits and signs, and the letters they stand for.
_STANDS_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a"}
_SYMBOL = np.zeros(256, np.uint8)
_SYMBOL[97:123] = _SYMBOL[65:91] = np.arange(1, 27)
_SYMBOL[128:] = 27 + (np.arange(128) & 31)
for _c, _letter in _STANDS_FOR.items():
    _SYMBOL[ord(_c)] = _SYMBOL[ord(_letter)]
#: Stands before each word, so that beginnings count for more.
_BEGIN = 61
_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?\n")] = True


@dataclass
class Words:
    """Distinct words of some texts as symbol spans, and where they occur."""

    symbols: np.ndarray
    start: np.ndarray
    length: np.ndarray
    of: np.ndarray  # distinct word of each occurrence
    sentence: np.ndarray  # sentence of each occurrence, numbered over all texts
    row_of_sentence: np.ndarray

    def distinct(self) -> np.ndarray:
        """Occurrences, in order, of which each sentence has no other of the same word."""
        return np.sort(np.unique(self.sentence * len(self.start) + self.of, return_index=True)[1])


def read_words(t: Texts) -> Words:
    w = words_of(t)
    symbol = _SYMBOL[t.data]
    # the second byte of a two-byte capital, made small
    after = np.flatnonzero((t.data[:-1] == 0xC3) & (t.data[1:] >= 0x80) & (t.data[1:] <= 0x9E)) + 1
    symbol[after] = 27 + ((t.data[after] + 0x20) & 31)
    kept = np.concatenate([[0], np.cumsum(symbol > 0)])
    symbols = symbol[symbol > 0]
    start, length = kept[w.start], kept[w.start + w.length] - kept[w.start]
    stop = _ENDS[t.data]
    stop[:-1] &= (t.data[1:] <= 0x20) | (t.data[:-1] == 10)  # a dot inside a word ends nothing
    ends = np.concatenate([[0], np.cumsum(stop)])
    mark = ends[w.start] + w.row  # a row's end ends a sentence
    head = np.flatnonzero(np.concatenate([[True], mark[1:] != mark[:-1]])) if len(mark) else mark
    place = np.arange(len(mark)) - np.repeat(head, np.diff(np.append(head, len(mark))))
    begins = (place % SENTENCE == 0).astype(np.int64)
    sentence = np.cumsum(begins) - 1
    row_of_sentence = w.row[begins == 1]
    some = length > 0
    start, length, sentence = start[some], length[some], sentence[some]
    joins = np.zeros(len(start), bool)
    joins[1:] = (length[1:] == 1) & (length[:-1] == 1) & (sentence[1:] == sentence[:-1])
    head = np.flatnonzero(~joins)
    sizes = np.add.reduceat(length, head) if len(head) else length
    start, sentence = start[head], sentence[head]
    symbols = np.insert(symbols, start, _BEGIN)
    start, sizes = start + np.arange(len(start)), sizes + 1
    h = hash_spans(symbols, start, sizes)
    _, first, of = np.unique(h, return_index=True, return_inverse=True)
    return Words(symbols, start[first], sizes[first], of, sentence, row_of_sentence)


def _passes(symbols: np.ndarray, start: np.ndarray, length: np.ndarray):
    """(word, triple code, weight) arrays for each pair of gaps."""
    if not len(start):
        return
    word = np.repeat(np.arange(len(start)), length)
    at = np.arange(len(word)) - np.repeat(np.cumsum(length) - length, length) + np.repeat(start, length)
    end = np.repeat(start + length, length)
    s = symbols.astype(np.int32)
    for b in range(2, REACH + 1):
        ok = at + b < end
        i, w = at[ok], word[ok]
        outer = s[i] << 12 | s[i + b]
        for a in range(1, b):
            yield w, outer | s[i + a] << 6, DECAY ** (b + 1)


def _exact_norm(symbols: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The norm of each word."""
    out = np.full(len(start), 1e-6)
    for a, own_start, own_length in _blocks(start, length):
        parts = [(w.astype(np.int64) << 18 | c, np.full(len(w), x)) for w, c, x in _passes(symbols, own_start, own_length)]
        if not parts:
            continue
        key, weight = (np.concatenate(p) for p in zip(*parts, strict=True))
        own, place = np.unique(key, return_inverse=True)
        square = np.bincount(own >> 18, np.bincount(place, weight) ** 2, minlength=len(own_start))
        out[a : a + len(own_start)] = np.sqrt(np.maximum(square, 1e-12))
    return out


def _blocks(start: np.ndarray, length: np.ndarray, words: int = 8192, symbols: int = 1 << 17):
    """Begin, starts and lengths of runs of words, bounded in number and, but for a single longer word, in symbols."""
    ends = np.cumsum(length)
    a = 0
    while a < len(start):
        b = int(np.searchsorted(ends, (ends[a - 1] if a else 0) + symbols, side="right"))
        b = min(max(b, a + 1), a + words, len(start))
        yield a, start[a:b], length[a:b]
        a = b


def _norm(n: np.ndarray) -> np.ndarray:
    """The norm of a word of n symbols none of which repeats, the least that a word of that length has."""
    n, total = np.asarray(n), np.zeros(len(n))
    for b in range(2, REACH + 1):
        total += np.maximum(n - b, 0) * (b - 1) * DECAY ** (2 * (b + 1))
    return np.sqrt(np.maximum(total, 1e-12))


class Landmarks:
    """The kernel of words against chosen words: the cosine of their weighted triples, to the power POWER.

    Products of kernels are kernels, and the landmarks among themselves get exact cosines, so their matrix has no negative eigenvalues
    but for rounding. For words whose cosine can't reach SMALL with any landmark, a lower bound stands in for the norm;
    what this adds is under SMALL ** POWER.
    """

    def __init__(self, words: list[np.ndarray]) -> None:
        self.words = words
        symbols, start, length = _joined(words)
        norm = _exact_norm(symbols, start, length)
        parts = [np.stack([w, c, np.full(len(w), x)]) for w, c, x in _passes(symbols, start, length)]
        flat = np.concatenate([*parts, np.zeros((3, 0))], axis=1)
        key, place = np.unique(flat[1].astype(np.int64) * max(len(words), 1) + flat[0].astype(np.int64), return_inverse=True)
        code, self.which = key // max(len(words), 1), key % max(len(words), 1)
        self.value = np.bincount(place, flat[2], minlength=len(key)) / norm[self.which] if len(key) else np.zeros(0)
        self.first = np.searchsorted(code, np.arange((1 << 18) + 1))

    def __reduce__(self):
        return Landmarks, (self.words,)

    def kernel(self, symbols: np.ndarray, start: np.ndarray, length: np.ndarray, exact: bool = False) -> np.ndarray:
        """Words x landmarks."""
        n = max(len(self.words), 1)
        out = np.zeros((len(start), n), np.float32)
        for a, own_start, own_length in _blocks(start, length):
            part = np.zeros(len(own_start) * n)
            for word, code, weight in _passes(symbols, own_start, own_length):
                begin = self.first[code]
                count = self.first[code + 1] - begin
                hit = np.flatnonzero(count)
                count = count[hit]
                at = np.arange(count.sum()) + np.repeat(begin[hit] - np.cumsum(count) + count, count)
                part += np.bincount(np.repeat(word[hit] * n, count) + self.which[at], self.value[at] * weight, minlength=len(part))
            part = part.reshape(-1, n)
            norm = _norm(own_length)
            near = np.arange(len(norm)) if exact else np.flatnonzero(part.max(axis=1) >= SMALL * norm)
            norm[near] = _exact_norm(symbols, own_start[near], own_length[near])
            out[a : a + len(own_start)] = np.minimum(part / norm[:, None], 1) ** POWER
        return out


def _joined(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    length = np.array([len(w) for w in words], np.int64)
    return np.concatenate([*words, np.zeros(0, np.uint8)]), np.cumsum(length) - length, length


def train(x: np.ndarray, y: np.ndarray, penalty: float = 0.0001, steps: int = 30) -> np.ndarray:
    """Weights (the last is the bias) of a linear machine with squared hinge loss, by Newton steps. y: -1 or 1."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1).astype(float)
    cost = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)) * len(y)
    w = np.zeros(x.shape[1])
    ridge = penalty * len(y) * np.eye(x.shape[1])
    ridge[-1, -1] *= 1e-3
    for _ in range(steps):
        inside = y * (x @ w) < 1
        a = x[inside] * cost[inside, None]
        new = np.linalg.solve(ridge + a.T @ x[inside], a.T @ y[inside])
        if np.allclose(new, w, atol=1e-7):
            break
        w = new
    return w


@dataclass
class StringKernelMachine:
    landmarks: Landmarks
    weights: np.ndarray  # by landmark: the Nyström map and the linear machine in one
    bias: float
    slope: np.ndarray  # of the worst and the second worst sentence
    shift: float

    def sentences(self, words: Words) -> np.ndarray:
        """Each sentence's margin. The map is linear in the kernel sums, so each distinct word is valued once."""
        value = self.landmarks.kernel(words.symbols, words.start, words.length) @ self.weights.astype(np.float32)
        once = words.distinct()
        return self.bias + np.bincount(words.sentence[once], value[words.of[once]], minlength=len(words.row_of_sentence))

    def margins(self, t: Texts) -> np.ndarray:
        """Each text's worst and second worst sentence, rows x 2."""
        words = read_words(t)
        return _two_sentences(self.sentences(words), words.row_of_sentence, len(t), self.bias)

    def score(self, t: Texts) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(t) @ self.slope + self.shift, -40, 40)))


def _two_sentences(margin: np.ndarray, row: np.ndarray, rows: int, bias: float) -> np.ndarray:
    """Each text's two worst sentences; past the margin a sentence can't be more than sure."""
    return _worst_two(np.minimum(margin, 1.0), row, rows, bias)


def _worst_two(value: np.ndarray, group: np.ndarray, groups: int, least: float) -> np.ndarray:
    first = _worst(value, group, groups, least)
    top = np.flatnonzero(value >= first[group])
    one = top[np.concatenate([[True], group[top][1:] != group[top][:-1]])] if len(top) else top
    rest = value.copy()
    rest[one] = least
    return np.stack([first, _worst(rest, group, groups, least)], axis=1)


def _worst(value: np.ndarray, group: np.ndarray, groups: int, least: float) -> np.ndarray:
    """The largest value of each group; groups are in ascending order."""
    out = np.full(groups, least)
    if len(value):
        head = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        out[group[head]] = np.maximum.reduceat(value, head)
    return out


def _families(words: Words, row: np.ndarray, texts: int, signatures: int = 8) -> np.ndarray:
    """A family for each text: texts that agree in one of some minima over their pairs of neighbouring words are near copies of
    one another and count as one."""
    after = np.where(np.append(row[1:] == row[:-1], False), np.append(words.of[1:], 0) + 1, 0)
    pair = mix(mix(words.of.astype(U64) + U64(1)) + after.astype(U64))
    head = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else row
    minima = [np.minimum.reduceat(mix(pair + U64(7919 * k)), head) for k in range(signatures)] if len(row) else []
    same = [np.unique(m, return_inverse=True)[1] for m in minima]
    label = np.arange(len(head))
    while True:
        new = label.copy()
        for group in same:
            least = np.full(len(head), len(head))
            np.minimum.at(least, group, new)
            new = least[group]
        if (new == label).all():
            break
        label = new
    out = np.arange(texts) + texts
    out[row[head]] = label
    return np.unique(out, return_inverse=True)[1]


def _families_with(item: np.ndarray, items: int, family: np.ndarray, row: np.ndarray, toxic: np.ndarray) -> list[np.ndarray]:
    """Of each item, how many families of clean and of toxic texts have it. item: of each occurrence, or -1."""
    counts = []
    for y in (0, 1):
        own = (toxic[row] == y) & (item >= 0)
        pair = np.unique(item[own].astype(np.int64) * (len(toxic) + 1) + family[row[own]])
        counts.append(np.bincount(pair // (len(toxic) + 1), minlength=items).astype(float))
    return counts


def choose_landmarks(words: Words, toxic: np.ndarray, count: int, alike: float = 0.8, chance: float = 1e-3) -> tuple[list[np.ndarray], np.ndarray]:
    """Landmarks, and which of the distinct words are or begin as sure ones: words and beginnings of words that toxic texts have and others hardly have, the surest first, no two too much alike.

    Near copies count as one text. One is sure when, by Chernoff's bound, so many toxic ones among the texts that
    have it have less than `chance`; so a small language needs no share of all toxic texts, and an inflected
    insult counts by its stem.
    """
    row = words.row_of_sentence[words.sentence]
    family = _families(words, row, len(toxic))
    all_good, all_bad = (len(np.unique(family[toxic == y])) for y in (0, 1))
    base = all_bad / (all_good + all_bad)
    found: list[tuple[float, int, bytes]] = []
    sure_word = np.zeros(len(words.start), bool)
    for size in (*STEMS, None):  # None: whole words
        long = np.flatnonzero(words.length >= (size or STEMS[0]))
        if not len(long):
            continue
        length = words.length[long] if size is None else np.full(len(long), size)
        _, first, own = np.unique(hash_spans(words.symbols, words.start[long], length), return_index=True, return_inverse=True)
        item = np.full(len(words.start), -1)
        item[long] = own
        good, bad = _families_with(item[words.of], len(first), family, row, toxic)
        n = np.maximum(good + bad, 1)
        q = np.clip(bad / n, 1e-9, 1 - 1e-9)
        evidence = n * (q * np.log(q / base) + (1 - q) * np.log((1 - q) / (1 - base)))
        rate = (bad / all_bad) / ((good + 0.5) / (all_good + 1))
        sure_item = (rate > 8) & (evidence > -np.log(chance))
        sure_word[long] |= sure_item[own]
        for i in np.flatnonzero(sure_item).tolist():
            begin = words.start[long[first[i]]]
            found.append((-evidence[i], -int(length[first[i]]), words.symbols[begin : begin + length[first[i]]].tobytes()))
    sure = [np.frombuffer(x, np.uint8) for *_, x in sorted(set(found))[: 32 * count]]
    if not sure:
        return [], sure_word
    like = Landmarks(sure).kernel(*_joined(sure), exact=True)
    taken: list[int] = []
    for i in range(len(sure)):
        if len(taken) < count and (not taken or like[i, taken].max() < alike**POWER):
            taken.append(i)
    return [sure[i] for i in taken], sure_word


def choose_clean_landmarks(words: Words, toxic: np.ndarray, others: list[np.ndarray], count: int, alike: float = 0.95) -> list[np.ndarray]:
    """Words of clean texts that are like the landmarks, the commonest and likest first, so that the machine can tell them apart."""
    row = words.row_of_sentence[words.sentence]
    good, bad = _families_with(words.of, len(words.start), np.arange(len(toxic)), row, toxic)
    k = Landmarks(others).kernel(words.symbols, words.start, words.length).max(axis=1)
    usual = bad / max((toxic == 1).sum(), 1) < 2 * good / max((toxic == 0).sum(), 1)
    near = np.flatnonzero(usual & (good > 1) & (k > SMALL**POWER))
    near = near[np.argsort(-(good * k)[near], kind="stable")][: 8 * count]
    found = [words.symbols[words.start[i] : words.start[i] + words.length[i]] for i in near]
    like = Landmarks([*others, *found]).kernel(*_joined([*others, *found]), exact=True)
    taken: list[int] = []
    for i in range(len(others), len(others) + len(found)):
        if len(taken) < count and like[i, [*range(len(others)), *taken]].max() < alike**POWER:
            taken.append(i)
    return [found[i - len(others)] for i in taken]


def _constant(toxic: np.ndarray) -> StringKernelMachine:
    rate = (toxic.sum() + 0.5) / (len(toxic) + 2)
    return StringKernelMachine(Landmarks([]), np.zeros(1), 0.0, np.zeros(2), float(np.log(rate / (1 - rate))))


def _sentence_sums(k: np.ndarray, words: Words, block: int = 1 << 17) -> np.ndarray:
    """Sentences x landmarks: the kernel of each sentence, a sum over its distinct words."""
    out = np.zeros((len(words.row_of_sentence), k.shape[1]), np.float32)
    once = words.distinct()
    for a in range(0, len(once), block):
        group, of = words.sentence[once[a : a + block]], words.of[once[a : a + block]]
        head = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        out[group[head]] += np.add.reduceat(k[of], head, axis=0)
    return out


def fit(t: Texts, toxic: np.ndarray, landmarks: int = 48, rounds: int = 4) -> StringKernelMachine:
    """From texts labelled as a whole. Sentences take their text's label, but for those of toxic texts that aren't toxic
    themselves: in rounds, sentences of toxic texts that the machine so far calls toxic (at first: that have a sure word) are the toxic
    ones, the others of these texts are left out, and all sentences of clean texts are clean. Without both labels, the score is a constant."""
    toxic = np.asarray(toxic, np.int64)
    if not len(toxic) or toxic.min() == toxic.max():
        return _constant(toxic)
    words = read_words(t)
    chosen, sure = choose_landmarks(words, toxic, landmarks)
    if not chosen:
        return _constant(toxic)
    chosen += choose_clean_landmarks(words, toxic, chosen, landmarks // 2)
    marks = Landmarks(chosen)
    k = marks.kernel(words.symbols, words.start, words.length)
    values, vectors = np.linalg.eigh(marks.kernel(*_joined(chosen), exact=True).astype(float))
    keep = values > 1e-3 * values.max()
    mapping = vectors[:, keep] / np.sqrt(values[keep])
    x = _sentence_sums(k, words) @ mapping.astype(np.float32)
    row = words.row_of_sentence
    clean = np.flatnonzero(toxic[row] == 0)
    value = np.full(len(row), -1.0)
    value[words.sentence[sure[words.of]]] = 1  # at first, sentences with a sure word
    weights, bias = np.zeros(x.shape[1]), 0.0
    for _ in range(rounds):
        positive = np.flatnonzero((toxic[row] == 1) & (value >= 0))
        if not len(positive):
            return _constant(toxic)
        rows = np.concatenate([positive, clean])
        w = train(x[rows], np.concatenate([np.ones(len(positive)), -np.ones(len(clean))]))
        weights, bias = w[:-1], float(w[-1])
        value = x @ weights + bias
    slope, shift = _logistic(_two_sentences(value, row, len(toxic), bias), toxic)
    return StringKernelMachine(marks, mapping @ weights, bias, slope, shift)


def _logistic(z: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[np.ndarray, float]:
    """Slopes and shift that turn margins into probabilities; a weak prior keeps them finite."""
    a = np.concatenate([z, np.ones((len(z), 1))], axis=1)
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + 1e-2 * w
        h = (a * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ a + 1e-2 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 4 / max(np.abs(step).max(), 1e-9))
    return w[:-1], float(w[-1])
