"""Words of texts and sets of word shingles as 64-bit hashes, for whole columns of texts at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .presplit import flat

SHINGLE = 5
_rng = np.random.default_rng(2024)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_PLACE = _rng.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) | np.uint64(1)
_GAP = np.zeros(256, bool)
_GAP[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _powers(base: int) -> np.ndarray:
    steps = np.full(1 << 16, base, np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


_BASE = 0x9E3779B97F4A7C15
_FINE, _COARSE = _powers(_BASE), _powers(pow(_BASE, 1 << 16, 1 << 64))  # of a place in a word: low and high half


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts side by side, and where the words of each text begin and the last end.

    Words are runs of anything but space and U+0009 to U+000D. ``bounds``: where texts
    begin and the last ends.
    """
    gap = np.empty(len(raw) + 1, bool)
    gap[:-1] = _GAP[raw]
    gap[-1] = True
    begins = ~gap[:-1]
    begins[1:] &= gap[:-2]
    inner = bounds[:-1][bounds[:-1] < len(raw)]
    begins[inner] = ~gap[inner]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    first, size = starts[0], np.diff(starts, append=len(raw))
    kind = np.int32 if len(raw) < 1 << 31 else np.int64
    place = np.arange(first, len(raw), dtype=kind) - np.repeat(starts.astype(kind), size)
    value = _BYTE[raw[first:]]
    value *= _FINE[place & 0xFFFF]
    if size.max() >> 16:
        value *= _COARSE[place >> 16]
    value[gap[first:-1]] = 0
    length = np.add.reduceat(~gap[first:-1], starts - first, dtype=np.int64)
    out = mix(np.add.reduceat(value, starts - first) + length.astype(np.uint64))
    return out, np.searchsorted(starts, bounds)


def shingle_sets(text: pa.Array) -> list[np.ndarray]:
    """Sorted distinct hashes of the shingles of each text; a null text counts as the empty one.

    A-Z count as lower case. A text of fewer words than a shingle has is one shingle;
    one without words has none.
    """
    raw, bounds = flat(text.fill_null(b"" if pa.types.is_binary(text.type) else ""))
    found, at = words(_LOWER[raw], bounds)
    n = max(len(found) - SHINGLE + 1, 0)
    whole = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        whole += found[k : n + k] * _PLACE[k]
    whole = mix(whole)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            own = np.sort(whole[a : b - SHINGLE + 1])
            out.append(own[np.append(True, own[1:] != own[:-1])])
        elif b > a:
            out.append(mix((found[a:b] * _PLACE[: b - a]).sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def shingle_set(text: str | bytes | None) -> np.ndarray:
    """As :func:`shingle_sets`, of one text."""
    raw = text.encode("utf-8", "replace") if isinstance(text, str) else text
    return shingle_sets(pa.array([raw], pa.binary()))[0]


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sets have ``percent`` of their union in common; no empty set has."""
    if not len(a) or not len(b):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)
