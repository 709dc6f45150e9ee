"""Per-document rule statistics, computed in one vectorised pass over a batch."""

from __future__ import annotations

import numpy as np

from .textcore import U64, Texts, gram_mask, grams, hash_spans, later_copies, lines_of, mix, per_row_sum, repeated, words_of

#: The symbols counted by the rule.
SYMBOLS = "#*$%&|<>"
_ROW = U64(0xD6E8FEB86659FD93)


def _member(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars.encode())] = True
    return table


_IS = {
    "n_symbols": _member(SYMBOLS),
    "n_upper": _member("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    "n_lower": _member("abcdefghijklmnopqrstuvwxyz"),
    "n_digits": _member("0123456789"),
    "n_stops": _member(".?"),
    "n_commas": _member(",;:"),
    "n_bangs": _member("!"),
    "n_pipes": _member("|"),
    "n_marks": _member("@/\\_=+{}[]~^`\"'()-"),
}


def statistics(t: Texts) -> dict[str, np.ndarray]:
    """Counts by row, all int64. Windows and lines are compared within their own row."""
    w, lines = words_of(t), lines_of(t)
    out = {"n_words": w.count.astype(np.int64), "n_lines": lines.count.astype(np.int64), "n_bytes": np.diff(t.offs)}
    begins = (t.data & 0xC0) != 0x80
    out["n_chars"] = per_row_sum(begins, t.offs)
    space = np.zeros(256, bool)
    space[[0x20, *range(0x09, 0x0E)]] = True
    out["word_chars"] = per_row_sum(begins & ~space[t.data], t.offs)
    for name, table in _IS.items():
        out[name] = per_row_sum(table[t.data], t.offs)

    salt = mix(np.arange(len(t), dtype=U64) * _ROW + U64(1))
    at = np.searchsorted(w.start, lines.start)
    has_word = at < np.searchsorted(w.start, lines.start + lines.length)
    row = lines.row[has_word]
    keys = hash_spans(t.data, lines.start[has_word], lines.length[has_word]) + salt[row]
    out["n_dup_lines"] = np.bincount(row[later_copies(keys)], minlength=len(t)).astype(np.int64)
    out["n_text_lines"] = np.bincount(row, minlength=len(t)).astype(np.int64)

    h, wrow = hash_spans(t.data, w.start, w.length), w.row
    tri = grams(h, 3)
    ok = np.flatnonzero(gram_mask(w.first, 3))
    hit = ok[repeated(tri[ok] + salt[wrow[ok]])]
    covered = np.zeros(len(h) + 2, bool)
    for k in range(3):
        covered[hit + k] = True
    out["n_repeat_words"] = per_row_sum(covered[: len(h)], w.first)
    out["n_distinct"] = out["n_words"] - np.bincount(wrow[later_copies(h + salt[wrow])], minlength=len(t))
    out["n_long_words"] = per_row_sum(w.length > 14, w.first)
    out["n_tiny_words"] = per_row_sum(w.length <= 3, w.first)
    return out


#: The model inputs derived from the counts, by name.
FEATURES = (
    "log_words",
    "chars_per_word",
    "symbol_rate",
    "upper_rate",
    "digit_rate",
    "stop_rate",
    "comma_rate",
    "bang_rate",
    "pipe_rate",
    "mark_rate",
    "dup_line_rate",
    "repeat_rate",
    "distinct_rate",
    "words_per_line",
    "long_rate",
    "tiny_rate",
)


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    """Rows x FEATURES, float64; an empty text gives zeros."""
    words = np.maximum(s["n_words"], 1).astype(float)
    chars = np.maximum(s["word_chars"], 1).astype(float)
    letters = np.maximum(s["n_upper"] + s["n_lower"], 1).astype(float)
    lines = np.maximum(s["n_text_lines"], 1).astype(float)
    columns = (
        np.log1p(s["n_words"]),
        s["word_chars"] / words,
        s["n_symbols"] / words,
        s["n_upper"] / letters,
        s["n_digits"] / chars,
        s["n_stops"] / words,
        s["n_commas"] / words,
        s["n_bangs"] / words,
        s["n_pipes"] / words,
        s["n_marks"] / words,
        s["n_dup_lines"] / lines,
        s["n_repeat_words"] / words,
        s["n_distinct"] / words,
        s["n_words"] / lines,
        s["n_long_words"] / words,
        s["n_tiny_words"] / words,
    )
    return np.stack([np.asarray(c, float) for c in columns], axis=1) if len(words) else np.zeros((0, len(FEATURES)))
