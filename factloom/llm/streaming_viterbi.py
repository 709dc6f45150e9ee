"""Streaming Viterbi segmentation over a byte-pair SentencePiece vocabulary.

One pass over the characters keeps, for each end position in a window of the longest
piece's length, the piece that ends there on the surviving path and so its backpointer.
Whenever all surviving paths of the window run through one boundary, the pieces before it
are final: their ids are committed and the state before it is dropped.

In a byte-pair vocabulary the right path is not the one of the highest sum of scores: it is
the only one on which every two neighbouring pieces would also come out of merging the
characters of those two alone. So at most one piece survives at each position, and the
neighbour test takes the place of the sum. Unknown characters fall back to UTF-8 bytes.
"""

from __future__ import annotations

import re
from os.path import commonprefix

import numpy as np

SPACE = "▁"
_SEGMENT = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
ID = np.dtype("<u4")
NONE, UNKNOWN = -1, -2
_INF = float("inf")
#: (piece at the boundary, score of the merge that ends it) over time
Spine = tuple[tuple[str, float], ...]


class Vocabulary:
    """Pieces that merging can lead to, and which of them may stand side by side."""

    def __init__(self, path: str | None = None, proto: bytes | None = None, held: int = 500_000) -> None:
        from sentencepiece import SentencePieceProcessor

        if proto is None:
            with open(path, "rb") as f:
                proto = f.read()
        model = SentencePieceProcessor(model_proto=proto)
        self.pieces = [model.id_to_piece(i) for i in range(model.vocab_size())]
        self.bytes_ = [0] * 256
        self.score: dict[str, float] = {}
        ids = {}
        for i, piece in enumerate(self.pieces):
            if model.is_byte(i):
                self.bytes_[int(piece[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unused(i) or model.is_unknown(i)):
                ids[piece], self.score[piece] = i, model.get_score(i)
        self.left: dict[int, Spine] = {}
        self.right: dict[int, Spine] = {}
        self.ids = {p: i for p, i in ids.items() if self._derive(p, i)}
        self.longest = max(map(len, self.ids))
        self.longest_by_end: dict[str, int] = {}
        for p in self.ids:
            self.longest_by_end[p[-1]] = max(len(p), self.longest_by_end.get(p[-1], 0))
        self.known, self.held = {}, held

    def _derive(self, piece: str, i: int) -> bool:
        """Merges a piece's characters, best score first and leftmost on ties, keeping what stood at either edge.
        False if merging leads elsewhere."""
        score, parts = self.score, list(piece)
        left, right = [[parts[0], -_INF]], [[parts[-1], -_INF]]
        while len(parts) > 1:
            found = [score.get(a + b, -_INF) for a, b in zip(parts, parts[1:], strict=False)]
            best = max(found)
            if best == -_INF:
                return False
            at = found.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            if at == 0:
                left[-1][1] = best
                left.append([parts[0], -_INF])
            if at == len(parts) - 1:
                right[-1][1] = best
                right.append([parts[-1], -_INF])
        self.left[i], self.right[i] = tuple(map(tuple, left)), tuple(map(tuple, right))
        return True

    def neighbours(self, a: int, b: int) -> bool:
        """Whether merging the characters of pieces a and b gives a, b again: no two pieces that stand at the
        boundary at one time merge before one of them is merged away. Higher scores merge earlier, on ties the left."""
        score, born_x = self.score, _INF
        for x, end_x in self.right[a]:
            born_y = _INF
            for y, end_y in self.left[b]:
                if (s := score.get(x + y)) is not None and (when := min(s, born_x, born_y)) > end_x and when >= end_y:
                    return False
                born_y = end_y
            born_x = end_x
        return True

    def survive(self, text: str, last: list[int], size: list[int]) -> None:
        """Extends last (the piece that survives at each position) and size (its length) to all of text.

        Position 0 holds the piece before the text, or UNKNOWN."""
        ids, known, by_end = self.ids, self.known, self.longest_by_end
        for i in range(len(last), len(text) + 1):
            for n in range(min(by_end.get(text[i - 1], 0), i), 0, -1):
                piece = ids.get(text[i - n : i])
                if piece is None or (before := last[i - n]) == NONE:
                    continue
                if before >= 0:
                    pair = before << 20 | piece
                    fit = known.get(pair)
                    if fit is None:
                        if len(known) > self.held:
                            known.clear()
                        fit = known[pair] = self.neighbours(before, piece)
                    if not fit:
                        continue
                last.append(piece)
                size.append(n)
                break
            else:
                unknown = text[i - 1] not in ids
                last.append(UNKNOWN if unknown else NONE)
                size.append(int(unknown))

    def emit(self, text: str, last: list[int], size: list[int], end: int) -> list[int]:
        """Ids of the path that survives at a position."""
        out: list[int] = []
        while end:
            if not size[end]:
                raise ValueError("no path of pieces leads here")
            out += [last[end]] if last[end] >= 0 else [self.bytes_[b] for b in reversed(text[end - 1].encode("utf-8", "replace"))]
            end -= size[end]
        return out[::-1]


class Stream:
    """Segmentation of one text fed in parts; its spaces are replaced already."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v, self.text, self.ids = vocabulary, "", []
        self.last, self.size = [UNKNOWN], [0]
        self.most = 0  # largest window held

    def feed(self, text: str, step: int = 64) -> None:
        for a in range(0, len(text), step):
            self.text += text[a : a + step]
            self.v.survive(self.text, self.last, self.size)
            self.most = max(self.most, len(self.text))
            self._commit(self._shared())

    def _shared(self) -> int:
        """The last boundary that the paths of all positions of the window have in common."""
        end, size = len(self.text), self.size
        alive = [p for p in range(max(1, end - self.v.longest + 1), end + 1) if size[p]]
        if not alive:
            return 0
        path, p = [alive[-1]], alive[-1]
        while p:
            p -= size[p]
            path.append(p)
        on, shared = set(path), alive[-1]
        for p in alive:
            while p not in on or p > shared:
                p -= size[p]
            shared = min(shared, p)
        return shared

    def _commit(self, upto: int) -> None:
        if upto:
            self.ids += self.v.emit(self.text, self.last, self.size, upto)
            self.text, self.last, self.size = self.text[upto:], self.last[upto:], [0, *self.size[upto + 1 :]]

    def finish(self) -> list[int]:
        self._commit(len(self.text))
        return self.ids


class SentencePieces:
    """Encoding and decoding with a cache of segments (bounded by their characters)."""

    _made: dict[str, SentencePieces] = {}
    #: Segments up to this length are a window of their own and share the states of a common beginning.
    short = 64

    def __init__(self, vocabulary: Vocabulary, held: int = 4_000_000) -> None:
        self.v, self.held, self.used = vocabulary, held, 0
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        #: No piece has a space after another character, so segments that begin with spaces are independent.
        self.split = not any(SPACE in p.lstrip(SPACE) for p in vocabulary.ids)
        at = {i: bytes([b]) for b, i in enumerate(vocabulary.bytes_)}
        self.bytes_of = [at.get(i) or (p.replace(SPACE, " ") if p in vocabulary.ids else "").encode() for i, p in enumerate(vocabulary.pieces)]

    @classmethod
    def of(cls, path: str) -> SentencePieces:
        if path not in cls._made:
            cls._made[path] = cls(Vocabulary(path))
        return cls._made[path]

    def _segments(self, fresh: list[str]) -> None:
        """Ids of new segments, in sorted order, each from where it parts from the one before."""
        v, before, last, size = self.v, "", [UNKNOWN], [0]
        for text in sorted(fresh):
            if len(text) > self.short:
                stream = Stream(v)
                stream.feed(text)
                self.young[text] = np.array(stream.finish(), ID).tobytes()
                continue
            same = len(commonprefix((before, text))) + 1
            del last[same:], size[same:]
            v.survive(text, last, size)
            self.young[text] = np.array(v.emit(text, last, size, len(text)), ID).tobytes()
            before = text

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit bytes."""
        ready = [SPACE + t.replace(" ", SPACE) if t else "" for t in texts]
        parts = [_SEGMENT.findall(t) if self.split else [t] * bool(t) for t in ready]
        missing = set().union(*parts) - self.young.keys()
        for p in missing & self.old.keys():
            self.young[p] = self.old[p]
        self._segments([p for p in missing if p not in self.young])
        self.used += sum(map(len, missing))
        out = [b"".join(map(self.young.__getitem__, p)) for p in parts]
        if self.used > self.held:
            self.old, self.young, self.used = self.young, {}, 0
        return out

    def decode(self, ids: bytes) -> str:
        """Bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, ID).tolist())).decode("utf-8", "replace")[1:]
