"""Hashes of word n-grams, many documents at a time."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX = np.uint64(0xD6E8FEB86659FD93)

SLICE_BYTES = 1 << 20


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return h ^ (h >> np.uint64(32))


def _byte_values() -> np.ndarray:
    """A random 64-bit value per byte; A-Z have those of a-z."""
    values = np.random.default_rng(20).integers(1, 1 << 63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    values[65:91] = values[97:123]
    return values


_VALUES = _byte_values()
_IS_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_CACHE: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_CACHE.get("up", ())) < n:
        _CACHE["up"], _CACHE["down"] = _powers(_BASE, n), _powers(_INVERSE, n)
    return _CACHE["up"], _CACHE["down"]


def word_hashes(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (lower case for A-Z) of the texts, and where each text's words begin (one entry more than texts)."""
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join([b"", *parts, b""]), np.uint8)
    begins = np.cumsum([1, *[len(p) + 1 for p in parts]])
    space = _IS_SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = edge[0::2], edge[1::2]
    up, down = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[data] * up[: len(data)], out=sums[1:], dtype=np.uint64)
    hashes = mixed((sums[ends] - sums[starts]) * down[starts])
    return hashes, np.searchsorted(starts, begins)


def sets(texts: Sequence[str | None], words: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's word n-grams; a shorter text is one n-gram as a whole, none if it has no words."""
    h, at = word_hashes(texts)
    n = max(0, len(h) - words + 1)
    grams = np.zeros(n, np.uint64)
    for k in range(words):
        grams = grams * _BASE + h[k : k + n]
    grams = mixed(grams)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(grams[a : b - words + 1]))
        elif b > a:
            whole = np.full(1, b - a, np.uint64)
            for x in h[a:b]:
                whole = whole * _BASE + x
            out.append(mixed(whole))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sliced(texts: Sequence[str | None]) -> Iterator[slice]:
    """Slices of about `SLICE_BYTES` of text, one document at least."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "") + 1
        if size >= SLICE_BYTES:
            yield slice(begin, i + 1)
            begin, size = i + 1, 0
    if begin < len(texts):
        yield slice(begin, len(texts))
