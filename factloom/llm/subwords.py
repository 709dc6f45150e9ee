"""Public tokenizers, applied to whole texts through a bounded cache of chunks.

A text is cut where no token of the given vocabulary can reach across, each distinct
chunk is encoded once by the tokenizers library, and a text's ids are its chunks' ids
joined. The result equals encoding the text at once; tests hold the two together.

Cuts are found in the UTF-8 bytes of a whole slice. Between two ASCII characters a cut lies where the pre-tokenizer's classes
(letters, digits, other signs) change, but for an apostrophe before a letter, which may begin a contraction; beside any other
character only white space cuts.
"""

from __future__ import annotations

import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .textcore import SPACE, Texts, texts_of

ID = np.dtype("<u4")
#: Chunks that the library encodes at a time: its results take some hundred bytes each.
AT_ONCE = 2048
_BLANK, _LETTER, _DIGIT, _SIGN, _OTHER = range(5)
#: Classes of bytes: white space, ASCII letters, digits and other signs; control characters and bytes of longer code points.
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[0x21:0x7F] = _SIGN
_CLASS[[*range(65, 91), *range(97, 123)]] = _LETTER
_CLASS[48:58] = _DIGIT
_CLASS[SPACE] = _BLANK
#: The characters of Unicode's White_Space beyond ASCII, which the byte-level pattern calls \s.
_UNICODE_SPACE = [c.encode() for c in "\x85\xa0                　"]


def _class_changes(data: np.ndarray, kind: np.ndarray, each_digit: bool) -> np.ndarray:
    """Whether a token must end before each byte, both it and the one before being ASCII and no white space."""
    cut = np.zeros(len(data), bool)
    if len(data) > 1:
        a, b = kind[:-1], kind[1:]
        change = a != b
        if each_digit:
            change |= b == _DIGIT
        seen = (kind != _BLANK) & (kind != _OTHER)
        cut[1:] = change & seen[:-1] & seen[1:] & ~((data[:-1] == 39) & (b == _LETTER))
    return cut


def word_chunks(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the chunks, where each begins and where each text begins in them. White space is dropped and no token spans it; each digit
    is alone and letters are lower-cased, by the library where a longer character follows, which might compose with them."""
    data, kind = t.data, _CLASS[t.data]
    cut = _class_changes(data, kind, True)
    full = kind != _BLANK
    cut[1:] |= full[1:] & ~full[:-1]
    cut[:1] = True
    edge = t.offs[:-1]
    cut[edge[edge < len(data)]] = True
    upper = (data >= 65) & (data <= 90)
    upper[:-1] &= data[1:] < 0x80
    lower = data + (upper.astype(np.uint8) << np.uint8(5))
    before = np.concatenate([[0], np.cumsum(full)])
    return lower[full], np.flatnonzero(cut[full]), before[t.offs]


def byte_chunks(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same; nothing is dropped. One space may lead a word; a run of white space stands alone but for its last character."""
    data, kind = t.data, _CLASS[t.data]
    cut = _class_changes(data, kind, False)
    blank = kind == _BLANK
    begins = (data & 0xC0) != 0x80
    for c in _UNICODE_SPACE:
        at = np.flatnonzero(data[: len(data) - len(c) + 1] == c[0])
        for k in range(1, len(c)):
            at = at[data[at + k] == c[k]]
        for k in range(len(c)):
            blank[at + k] = True
    first = np.zeros(len(data) + 1, bool)
    first[t.offs] = True
    first = first[:-1]
    cut |= first
    cut[1:] |= blank[1:] & ~blank[:-1]
    word = ~blank & ~first  # a word after white space of its text
    word[1:] &= blank[:-1]
    word = np.flatnonzero(word)
    word = word[word > 0]
    cut[word[data[word - 1] != 32]] = True
    last = word - 1
    while len(back := np.flatnonzero(~begins[last])):
        last[back] -= 1
    cut[last] = True
    return data, np.flatnonzero(cut), t.offs


CHUNKS = {"word": word_chunks, "byte": byte_chunks}


class ChunkEncoder:
    """Ids of texts as little-endian unsigned 32-bit bytes. The cache holds `held` bytes of chunks and one slice's besides; when it is
    full, chunks go that weren't asked for again since it last was."""

    _made: dict[tuple[str, str], ChunkEncoder] = {}

    def __init__(self, path: str, kind: str, held: int = 2_000_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.chunks, self.held = CHUNKS[kind], held
        self.forget()

    @classmethod
    def of(cls, path: str, kind: str) -> ChunkEncoder:
        """One encoder a process and vocabulary."""
        if (path, kind) not in cls._made:
            cls._made[path, kind] = cls(path, kind)
        return cls._made[path, kind]

    def forget(self) -> None:
        """Empties the cache."""
        self.known = pa.array([], pa.large_string())
        self.ids, self.cut, self.again = np.zeros(0, ID), np.zeros(1, np.int64), np.zeros(0, bool)

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """The library's ids of each text, of which a null is empty. A text that spells out an added token goes to the library whole."""
        column = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts
        spelt = np.zeros(len(column), bool)
        for a in self.added:
            spelt |= pc.fill_null(pc.match_substring(column, a), False).to_numpy(zero_copy_only=False)
        whole = column.filter(pa.array(spelt)).to_pylist()
        out = self._by_chunks(texts_of(pc.if_else(pa.array(spelt), "", column) if whole else column))
        for i, t in zip(np.flatnonzero(spelt).tolist(), whole, strict=True):
            out[i] = np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, ID).tobytes()
        return out

    def _by_chunks(self, t: Texts) -> list[bytes]:
        data, start, offs = self.chunks(t)
        if not len(start):
            return [b""] * len(t)
        ends = np.append(start, len(data))
        chunks = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
        of = self._places(chunks.dictionary)[chunks.indices.to_numpy()]
        begin, count = self.cut[of], self.cut[of + 1] - self.cut[of]
        total = np.concatenate([[0], np.cumsum(count)])
        ids = self.ids[np.repeat(begin - total[:-1], count) + np.arange(total[-1])].tobytes()
        edge = (4 * total[np.searchsorted(start, offs)]).tolist()
        self._make_room()
        return [ids[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)]

    def _places(self, distinct: pa.Array) -> np.ndarray:
        """Where each chunk is in the cache; new ones are encoded."""
        at = pc.index_in(distinct, value_set=self.known)
        new = at.is_null()
        fresh = distinct.filter(new)
        place, new = at.fill_null(0).to_numpy().astype(np.int64), new.to_numpy(zero_copy_only=False)
        self.again[place[~new]] = True
        place[new] = len(self.known) + np.arange(len(fresh))
        ids, count = array("I"), array("q")
        for a in range(0, len(fresh), AT_ONCE):
            for e in self.tokenizer.encode_batch_fast(fresh.slice(a, AT_ONCE).to_pylist(), add_special_tokens=False):
                ids.extend(own := e.ids)
                count.append(len(own))
        self.known = pa.concat_arrays([self.known, fresh])
        self.ids = np.concatenate([self.ids, np.array(ids, ID)])
        self.cut = np.concatenate([self.cut, self.cut[-1] + np.cumsum(np.array(count, np.int64))])
        self.again = np.concatenate([self.again, np.zeros(len(fresh), bool)])
        return place

    def _make_room(self) -> None:
        size = pc.binary_length(self.known).to_numpy()
        if size.sum() <= self.held:
            return
        stay = self.again & (size[self.again].sum() <= self.held)
        count = np.diff(self.cut)
        self.ids, self.known = self.ids[np.repeat(stay, count)], self.known.filter(pa.array(stay))
        self.cut = np.concatenate([[0], np.cumsum(count[stay])])
        self.again = np.zeros(len(self.known), bool)


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
