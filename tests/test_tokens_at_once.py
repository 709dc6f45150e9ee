"""F31 to F33: a slice holds a megabyte; a text without comments and raw strings is read by one findall(), and gives the tokens that the reading one by one gives."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest

from factloom.functions import tokens
from factloom.operators import clones

SIGNS = ['r"', '"', "#", "/", "//", "*", "'", "\\", "b", "c", "x", "1", ".", "e", "_", " ", "\n", "\t", "\x1c", "é", "😀", "0x", "::", "!", "(", "\xa0", "true", "Self", "fn"]


def _texts() -> list[str]:
    rng = random.Random(31)
    return ["".join(rng.choice(SIGNS) for _ in range(rng.randrange(40))) for _ in range(20_000)]


def test_as_one_by_one(monkeypatch):
    texts, seen = _texts(), []
    real = tokens.spans
    monkeypatch.setattr(tokens, "spans", lambda *a: seen.append(a[0]) or real(*a))
    for t in texts:
        spans = list(real(t))
        own = [t[a:b] for a, b in spans]
        assert tokens.tokens(t) == own
        assert tokens.with_gaps(t) == [t[(spans[i - 1][1] if i else a) : b] for i, (a, b) in enumerate(spans)]
    plain = [t for t in texts if "//" not in t and "/*" not in t and 'r"' not in t and "r#" not in t]
    assert len(plain) > 5000 and not set(plain) & set(seen)


def test_kinds_of_all():
    each = sorted({w for t in _texts() for w in tokens.tokens(t)} | {"true", "false", "self", "match", "Name", "name", "É"})
    assert tokens.literal_kinds(each) == [tokens.literal_kind(t) for t in each]
    assert tokens.may_be_variables(each) == [tokens.may_be_variable(t) for t in each]


@pytest.mark.parametrize("mode", ["mild", "weak", "semantic"])
def test_units_are_those_of_normalised(mode):
    texts = _texts()[:400]
    s = clones._Hashed(pa.array(texts), mode)
    want = [u for t in texts for u in tokens.normalised(tokens.tokens(t), mode)]
    assert (s.unit == clones._hashes(want)).all() and len(want) > 3000


def test_slices_hold_a_megabyte():
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(["ab " * 100_000] * 8 + ["x" * 3_000_000])], ["id", "text"])
    sizes = [sum(len(t) for t in s.column(1).to_pylist()) for s in clones._slices([batch])]
    assert sum(sizes) == 5_400_000 and max(sizes[:-1]) <= 1 << 20
