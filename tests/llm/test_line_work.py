"""What op3 does for each line: the same values as in plain steps, in blocks that a processor's cache holds."""

import re
import tracemalloc

import numpy as np
import pyarrow as pa

from factloom.llm import line_dedup, linking, textcore

ODD = ["", None, "\n", "a\n\n b\n \t\n\x0b\n", "é\nab\n日本語テキスト\n😀😀😀😀😀😀\n", "\n\nabc", " \n", "a\r\nb\r\n\x0c\r\n", "  led by white space"]


def _minima(line: str, count: int) -> list[int]:
    low = (1 << 32) - 1

    def mixed(x: int) -> int:
        for shift, times in ((16, 0x7FEB352D), (15, 0x846CA68B)):
            x = ((x ^ x >> shift) * times) & low
        return x ^ x >> 16

    gram = []
    for k in range(len(line) - 4):
        g = 0
        for c in line[k : k + 5]:
            g = (g * 0x01000193 + mixed(ord(c) * 0x9E3779B1 & low)) & low
        gram.append(mixed(g))
    times, plus = (textcore.mix(np.arange(a, a + count, dtype=np.uint64)) >> np.uint64(32) for a in (1, count + 1))
    return [min(((g ^ p) * (t | 1)) & low for g in gram) for t, p in zip(times.tolist(), plus.tolist(), strict=True)]


def test_lines_with_a_word():
    start, length, row, number = line_dedup._text_lines(t := textcore.texts_of(pa.array(ODD)))
    got = [(r, k, t.data[a : a + n].tobytes().decode()) for r, k, a, n in zip(row.tolist(), number.tolist(), start.tolist(), length.tolist(), strict=True)]
    assert got == [(r, k, x) for r, text in enumerate(ODD) for k, x in enumerate((text or "").split("\n")) if re.search(textcore.WORD_PATTERN, x)]


def test_minima_and_shingles_in_blocks():
    lines = [f"Zeile {i} mit é und 日本語 {'x' * (i % 90)}" if i % 7 else "ab"[: 1 + i % 2] for i in range(20_000)]
    start, length, *_ = line_dedup._text_lines(t := textcore.texts_of(pa.array(["\n".join(lines)])))
    peaks, h = [], np.arange(1 << 20, dtype=np.uint64)
    for make in (lambda: line_dedup.minima(t.data, start, length, 8), lambda: textcore.grams(h, 5)):
        make()
        tracemalloc.start()
        out = make()
        peaks.append(tracemalloc.get_traced_memory()[1] - out.nbytes)
        tracemalloc.stop()
    low = line_dedup.minima(t.data, start, length, 8)
    assert all(low[:, i].tolist() == _minima(lines[i], 8) for i in range(1, 20_000, 997) if i % 7)
    assert (low == line_dedup.minima(t.data, start, length, 8, 100)).all()
    # when each step made whole arrays, these were 22 bytes for each byte of text and 16 for each gram
    assert peaks[0] < 10 * len(t.data) and peaks[1] < 1 << 20


def test_least_shared_bucket():
    x = np.array([[1, 5, 9], [2, 4, -1], [3, -1, -1]])
    y = np.array([[5, 9, 1], [4, -1, -1], [7, 8, -1]])
    assert linking._shared_least(x, y).tolist() == [1, 4, np.iinfo(np.int64).max]
    a, b = (np.array(v, np.uint64) for v in ([1, 4, 9], [4, 9, 10, 12]))
    assert linking._in_common(a, b) == 2 and linking._in_common(a, b[:0]) == 0
