"""CRC-32C (Castagnoli), which Spark's ``crc32`` is not: over long buffers and over whole columns, in numpy.

A buffer is cut into lanes that go in step, a table look-up for all of them a byte;
lanes are put together by what a lane of zeros does to a remainder, which is linear.
A column's values go in step in the same way, longest first.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

POLYNOMIAL = 0x82F63B78  # fixed value: reflected
_ALL = np.uint32(0xFFFFFFFF)


def remainders() -> np.ndarray:
    """What each byte leaves behind."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = out >> np.uint32(1) ^ np.where(out & 1, np.uint32(POLYNOMIAL), np.uint32(0))
    return out


_TABLE = remainders()


def _in_step(crc: np.ndarray, columns) -> np.ndarray:
    for c in columns:
        crc = _TABLE[(crc ^ c) & np.uint32(0xFF)] ^ crc >> np.uint32(8)
    return crc


@lru_cache(maxsize=64)
def _zeros(n: int) -> np.ndarray:
    """What ``n`` bytes of zeros make of a remainder, for each value of each of its four bytes."""
    one = np.uint32(1) << np.arange(32, dtype=np.uint32)
    step, out = _in_step(one, [np.zeros(32, np.uint32)]), one

    def apply(by: np.ndarray, x: np.ndarray) -> np.ndarray:
        return np.bitwise_xor.reduce(np.where(x[:, None] >> np.arange(32, dtype=np.uint32) & 1, by[None, :], 0), axis=1).astype(np.uint32)

    while n:
        if n & 1:
            out = apply(step, out)
        step, n = apply(step, step), n >> 1
    values = np.arange(256, dtype=np.uint32)
    return np.stack([apply(out, values << np.uint32(8 * k)) for k in range(4)])


def crc32c(data: bytes | memoryview) -> int:
    """Checksum of one buffer."""
    raw = np.frombuffer(data, np.uint8)
    lanes = int(len(raw) ** 0.5) // 2
    if lanes < 8:
        lanes, width, crc = 0, 0, 0xFFFFFFFF
    else:
        width = len(raw) // lanes
        start = np.zeros(lanes, np.uint32)
        start[0] = _ALL
        done = _in_step(start, raw[: lanes * width].reshape(lanes, width).T.astype(np.uint32))
        shift, crc = _zeros(width).tolist(), int(done[0])
        for own in done[1:].tolist():
            crc = shift[0][crc & 255] ^ shift[1][crc >> 8 & 255] ^ shift[2][crc >> 16 & 255] ^ shift[3][crc >> 24] ^ own
    table = _TABLE.tolist() if len(raw) > lanes * width else []
    for b in raw[lanes * width :].tolist():
        crc = table[(crc ^ b) & 0xFF] ^ crc >> 8
    return crc ^ 0xFFFFFFFF


def crc32c_each(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Checksums of spans of bytes."""
    order = np.argsort(-lengths, kind="stable")
    at, size = starts[order], lengths[order]
    crc = np.full(len(order), _ALL, np.uint32)
    longer = np.searchsorted(-size, -np.arange(1, int(size.max(initial=0)) + 1), "right")
    for k, n in enumerate(longer.tolist()):
        crc[:n] = _TABLE[(crc[:n] ^ raw[at[:n] + k]) & np.uint32(0xFF)] ^ crc[:n] >> np.uint32(8)
    out = np.empty_like(crc)
    out[order] = crc ^ _ALL
    return out


def crc32c_column(c: Column) -> Column:
    """Checksum of a binary column; null for null."""

    @F.pandas_udf("long")
    def of(data: pd.Series) -> pd.Series:
        some = data.notna()
        values = [bytes(b) for b in data[some]]
        lengths = np.array([len(v) for v in values], np.int64)
        found = crc32c_each(np.frombuffer(b"".join(values), np.uint8), np.cumsum(lengths) - lengths, lengths)
        out = pd.Series([None] * len(data), index=data.index, dtype="Int64")
        out[some] = found.astype(np.int64)
        return out

    return of(c)
