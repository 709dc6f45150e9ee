"""Matroska files: a writer for sample payloads and a parser to packet tables.

The parser walks the variable-length EBML elements flat: it steps into container elements and over
all others by their size, so containers of unknown size need no special case. Blocks are
split by their lacing (none, Xiph, fixed, EBML); frames get their track, time and byte range.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

# Element ids of the public Matroska specification.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TRACK_ENTRY, AUDIO, BLOCK_GROUP, CUE_POINT, CUE_POSITIONS = 0xAE, 0xE1, 0xA0, 0xBB, 0xB7
TIMESTAMP_SCALE, TIMESTAMP, SIMPLE_BLOCK, BLOCK, REFERENCE = 0x2AD7B1, 0xE7, 0xA3, 0xA1, 0xFB
TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC, DEFAULT_DURATION = 0xD7, 0x73C5, 0x83, 0x86, 0x23E383
RATE, CHANNELS, BIT_DEPTH, DURATION, MUXER, WRITER = 0xB5, 0x9F, 0x6264, 0x4489, 0x4D80, 0x5741
CUE_TIME, CUE_TRACK, CUE_CLUSTER, DOC_TYPE, DOC_VERSION, DOC_READ_VERSION = 0xB3, 0xF7, 0xF1, 0x4282, 0x4287, 0x4285
CONTAINERS = {SEGMENT, INFO, TRACKS, CLUSTER, CUES, TRACK_ENTRY, AUDIO, BLOCK_GROUP, CUE_POINT, CUE_POSITIONS}
UNLACED, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3

SAMPLE_RATE, FRAME, FRAMES_A_BLOCK, FRAMES_A_CLUSTER = 8000, 512, 8, 64
SCALE = 1_000_000
FRAME_NS = FRAME * 1_000_000_000 // SAMPLE_RATE


def size_bytes(n: int, width: int = 0) -> bytes:
    """A variable-length size; all-ones values mean unknown and are avoided."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(kind: int, body: bytes) -> bytes:
    return kind.to_bytes(-(-kind.bit_length() // 8), "big") + size_bytes(len(body)) + body


def number(kind: int, n: int) -> bytes:
    return element(kind, n.to_bytes(max(1, -(-n.bit_length() // 8)), "big"))


def _signed_size(n: int) -> bytes:
    width = next(w for w in range(1, 9) if abs(n) < (1 << (7 * w - 1)) - 1)
    return size_bytes(n + (1 << (7 * width - 1)) - 1, width)


def block(track: int, time: int, frames: list[bytes], lacing: int, key: bool = True) -> bytes:
    """The body of a SimpleBlock."""
    head = size_bytes(track) + struct.pack(">hB", time, (0x80 if key else 0) | lacing << 1)
    if lacing == UNLACED:
        return head + frames[0]
    sizes = [len(f) for f in frames]
    laces = bytes([len(frames) - 1])
    if lacing == XIPH:
        laces += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif lacing == EBML_LACING:
        laces += size_bytes(sizes[0]) + b"".join(_signed_size(b - a) for a, b in zip(sizes[:-1], sizes[1:-1], strict=False))
    return head + laces + b"".join(frames)


def mux(payload: bytes, frame: int = FRAME) -> bytes:
    """A file of one track of 8-bit samples at 8 kHz. Equal payloads give equal files."""
    frames = [payload[a : a + frame] for a in range(0, len(payload), frame)]
    ms = frame * 1000 // SAMPLE_RATE
    head = element(EBML, element(DOC_TYPE, b"matroska") + number(DOC_VERSION, 4) + number(DOC_READ_VERSION, 2))
    info = element(INFO, number(TIMESTAMP_SCALE, SCALE) + element(DURATION, struct.pack(">d", len(payload) * 1000 / SAMPLE_RATE)) + element(MUXER, b"factloom") + element(WRITER, b"factloom"))
    audio = element(AUDIO, element(RATE, struct.pack(">d", SAMPLE_RATE)) + number(CHANNELS, 1) + number(BIT_DEPTH, 8))
    track = number(TRACK_NUMBER, 1) + number(TRACK_UID, 1) + number(TRACK_TYPE, 2) + element(CODEC, b"A_PCM/INT/LIT") + number(DEFAULT_DURATION, ms * 1_000_000) + audio
    parts = [info, element(TRACKS, element(TRACK_ENTRY, track))]
    at, cues = sum(map(len, parts)), b""
    for c in range(0, len(frames), FRAMES_A_CLUSTER):
        body = number(TIMESTAMP, c * ms)
        for b in range(c, min(c + FRAMES_A_CLUSTER, len(frames)), FRAMES_A_BLOCK):
            own = frames[b : min(b + FRAMES_A_BLOCK, c + FRAMES_A_CLUSTER)]
            lacing = UNLACED if len(own) == 1 else FIXED if len(own[-1]) == len(own[0]) else EBML_LACING
            body += element(SIMPLE_BLOCK, block(1, (b - c) * ms, own, lacing))
        cues += element(CUE_POINT, number(CUE_TIME, c * ms) + element(CUE_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER, at)))
        parts.append(element(CLUSTER, body))
        at += len(parts[-1])
    return head + element(SEGMENT, b"".join(parts) + element(CUES, cues))


@dataclass
class Media:
    """Packets as columns, tracks and cues."""

    track: list[int] = field(default_factory=list)
    time_ns: list[int] = field(default_factory=list)
    offset: list[int] = field(default_factory=list)
    size: list[int] = field(default_factory=list)
    key: list[bool] = field(default_factory=list)
    lacing: list[int] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)
    tracks: list[dict[int, object]] = field(default_factory=list)
    cues: list[dict[int, int]] = field(default_factory=list)
    scale: int = SCALE
    segment: int = 0


class _Reader:
    def __init__(self, raw: bytes) -> None:
        self.raw, self.at = raw, 0

    def vint(self, keep: bool = False) -> tuple[int, int]:
        """A variable-length number and its width; keep leaves the length mark in, as ids do."""
        if self.at >= len(self.raw):
            raise ValueError("an element is cut off")
        first = self.raw[self.at]
        width = 9 - first.bit_length()
        if width > 8 or self.at + width > len(self.raw):
            raise ValueError("not a variable-length number")
        n = int.from_bytes(self.raw[self.at : self.at + width], "big")
        self.at += width
        return (n if keep else n & ((1 << 7 * width) - 1)), width

    def header(self) -> tuple[int, int | None]:
        kind, _ = self.vint(keep=True)
        n, width = self.vint()
        return kind, None if n == (1 << 7 * width) - 1 else n


#: By length; an empty float is zero.
_FLOATS = {0: "", 4: ">f", 8: ">d"}


def parse(raw: bytes) -> Media:
    """The packet table of a file. Raises ValueError on bytes that are no Matroska."""
    r, m, cluster = _Reader(raw), Media(), 0
    kind, n = r.header()
    if kind != EBML or n is None:
        raise ValueError("no EBML header")
    r.at += n
    blocks: list[tuple[int, int, int, bool | None]] = []
    while r.at < len(raw):
        begin = r.at
        kind, n = r.header()
        if kind in CONTAINERS:
            if kind == SEGMENT:
                m.segment = r.at
            elif kind == CLUSTER:
                m.clusters.append(begin - m.segment)
            elif kind == TRACK_ENTRY:
                m.tracks.append({})
            elif kind == CUE_POINT:
                m.cues.append({})
            continue
        if n is None or r.at + n > len(raw):
            raise ValueError("an element is cut off")
        body = r.at
        r.at += n
        if kind == TIMESTAMP_SCALE:
            m.scale = int.from_bytes(raw[body : r.at], "big")
        elif kind == TIMESTAMP:
            cluster = int.from_bytes(raw[body : r.at], "big")
        elif kind in (SIMPLE_BLOCK, BLOCK):
            blocks.append((body, n, cluster, None if kind == SIMPLE_BLOCK else True))
        elif kind == REFERENCE and blocks:
            blocks[-1] = (*blocks[-1][:3], False)
        elif kind in (TRACK_NUMBER, TRACK_TYPE, DEFAULT_DURATION, CHANNELS, BIT_DEPTH) and m.tracks:
            m.tracks[-1][kind] = int.from_bytes(raw[body : r.at], "big")
        elif kind == CODEC and m.tracks:
            m.tracks[-1][kind] = raw[body : r.at].decode("ascii", "replace")
        elif kind == RATE and m.tracks:
            if n not in _FLOATS:
                raise ValueError("a float of no legal length")
            m.tracks[-1][kind] = struct.unpack(_FLOATS[n], raw[body : r.at])[0] if n else 0.0
        elif kind in (CUE_TIME, CUE_TRACK, CUE_CLUSTER) and m.cues:
            m.cues[-1][kind] = int.from_bytes(raw[body : r.at], "big")
    step = {t.get(TRACK_NUMBER): int(t.get(DEFAULT_DURATION, 0)) for t in m.tracks}
    for body, n, base, key in blocks:
        _frames(raw, body, n, base, key, step, m)
    return m


def _frames(raw: bytes, body: int, n: int, cluster: int, key: bool | None, step: dict, m: Media) -> None:
    r, end = _Reader(raw), body + n
    r.at = body
    track, _ = r.vint()
    if r.at + 3 > end:
        raise ValueError("a block is cut off")
    time, flags = struct.unpack_from(">hB", raw, r.at)
    r.at += 3
    lacing = flags >> 1 & 3
    if lacing == UNLACED:
        sizes = [end - r.at]
    else:
        count = raw[r.at] + 1
        r.at += 1
        if lacing == FIXED:
            if (end - r.at) % count:
                raise ValueError("a fixed-size lace doesn't divide its block")
            sizes = [(end - r.at) // count] * count
        else:
            sizes = []
            for i in range(count - 1):
                if lacing == XIPH:
                    total = 0
                    while raw[r.at] == 255:
                        total, r.at = total + 255, r.at + 1
                    total, r.at = total + raw[r.at], r.at + 1
                else:
                    v, width = r.vint()
                    total = v if not i else sizes[-1] + v - ((1 << (7 * width - 1)) - 1)
                sizes.append(total)
            sizes.append(end - r.at - sum(sizes))
    if min(sizes) < 0 or r.at + sum(sizes) > end:
        raise ValueError("lacing sizes exceed their block")
    start = (cluster + time) * m.scale
    for i, s in enumerate(sizes):
        m.track.append(track), m.time_ns.append(start + i * step.get(track, 0)), m.offset.append(r.at), m.size.append(s)
        m.key.append(bool(flags & 0x80) if key is None else key), m.lacing.append(lacing)
        r.at += s


def samples(raw: bytes, m: Media, track: int = 1) -> bytes:
    """The stored bytes of a track, by its packets' byte ranges in order of time."""
    order = sorted((t, i) for i, (t, k) in enumerate(zip(m.time_ns, m.track, strict=True)) if k == track)
    return b"".join(raw[m.offset[i] : m.offset[i] + m.size[i]] for _, i in order)


def feature(m: Media, stored: bytes) -> str:
    """Whole numbers of the packet table and the samples."""
    x = np.frombuffer(stored, np.uint8).astype(np.int64)
    above = x >= 128
    last = m.time_ns[-1] // 1_000_000 if m.time_ns else 0
    found = sum(c.get(CUE_CLUSTER) in set(m.clusters) for c in m.cues)
    return f"packets={len(m.size)};clusters={len(m.clusters)};cues={found};laced={sum(v > 0 for v in m.lacing)};last_ms={last};sum={int(x.sum())};energy={int((x * x).sum())};peak={int(x.max(initial=0))};crossings={int((above[1:] != above[:-1]).sum())}"
