"""A trie over the words of a task's documents, whose nodes are runs of words with the CRC of their text.

A node's state is the CRC-32 of its run; a child's is its parent's, carried on by a space and the child's word, so a run's
text is never put together. Walking a slice goes level by level: the nodes of one depth and the word after each give the
next depth, and Python looks up only the distinct steps.
"""

from __future__ import annotations

from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa

#: Lower-cases A-Z and makes a space of every byte that is no part of a word: words are digits, letters and all code points over 0x7F.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(column: pa.Array) -> list[list[bytes]]:
    """The words of each text of a string column; null has none."""
    raw = column.cast(pa.large_binary()).to_pylist()
    return [t.translate(FOLD).split() if t else [] for t in raw]


class WordTrie:
    """depth: words of the longest run. Nodes are numbered from 1 as they are made; 0 is the root."""

    def __init__(self, depth: int) -> None:
        self.depth = depth
        self._word: dict[bytes, int] = {}  # children of the root
        self._text: dict[int, bytes] = {}  # their words
        self._step: dict[int, int] = {}  # (parent, child of the root that has the word) to node, below the root
        self.state = [0]

    def __len__(self) -> int:
        return len(self.state)

    def _first(self, word: bytes) -> int:
        node = self._word.get(word)
        if node is None:
            node = self._word[word] = len(self.state)
            if self.depth > 1:
                self._text[node] = word
            self.state.append(crc32(word))
        return node

    def _next(self, key: int) -> int:
        node = self._step.get(key)
        if node is None:
            node = self._step[key] = len(self.state)
            self.state.append(crc32(b" " + self._text[key & 0xFFFFFFFF], self.state[key >> 32]))
        return node

    def walk(self, rows: list[list[bytes]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each depth, the nodes of all runs of so many words in order, and how many of them each row has."""
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        words = pa.array(chain.from_iterable(rows), pa.binary(), size=int(sizes.sum())).dictionary_encode()
        known = np.array([self._first(w) for w in words.dictionary.to_pylist()], np.int64)
        word = known[words.indices.to_numpy()] if len(known) else np.zeros(0, np.int64)
        levels, nodes, at = [(word, sizes)], word, np.arange(len(word))
        last = np.repeat(np.cumsum(sizes), sizes)  # where each word's row ends
        for n in range(2, self.depth + 1):
            goes = at + n - 1 < last[at]
            nodes, at = nodes[goes], at[goes]
            steps, back = np.unique(nodes << 32 | word[at + n - 1], return_inverse=True)
            nodes = np.array([self._next(k) for k in steps.tolist()], np.int64)[back] if len(steps) else nodes
            levels.append((nodes, np.maximum(sizes - n + 1, 0)))
        return levels

    def states(self) -> np.ndarray:
        return np.array(self.state, np.int64)
