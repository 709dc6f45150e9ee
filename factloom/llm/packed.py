"""Objects as compressed binaries."""

from __future__ import annotations

import pickle
from typing import Any

import zstandard


def squeeze(x: Any) -> bytes:
    return zstandard.compress(pickle.dumps(x, protocol=5), 1)


def expand(raw: bytes) -> Any:
    return pickle.loads(zstandard.decompress(raw))
