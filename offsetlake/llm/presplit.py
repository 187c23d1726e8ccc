"""Code points of texts and the words they are split into before merges, for whole batches of texts at a time."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex

#: The split of text before merges that the vocabulary was made with, with white space by the Unicode property.
_SPACE = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
PRE_SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
LETTER, NUMBER, OTHER, SPACE = range(4)


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of every code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, range(0x110000)))
    for kind, members in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, f"[{_SPACE}]+")):
        for run in regex.finditer(members, every):
            out[run.start() : run.end()] = kind
    return out


def flat(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column without nulls, and where each text begins and the last ends."""
    text = text.cast(pa.large_binary())
    ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
    data = text.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and ends[-1] > ends[0] else np.zeros(0, np.uint8)
    return raw, ends - ends[0]


def code_points(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """Code points of UTF-8, and the byte each begins at (None: every one is a byte)."""
    if not len(raw) or raw.max() < 128:
        return raw.astype(np.int32), None
    at = np.flatnonzero((raw & 0xC0) != 0x80)
    first = raw[at].astype(np.int32)
    out = first.copy()
    for lead, mask, more in ((0xC0, 0x1F, 1), (0xE0, 0x0F, 2), (0xF0, 0x07, 3)):
        own = np.flatnonzero((first >= lead) & (first < (lead | mask) + 1))
        value = first[own] & mask
        for k in range(1, more + 1):
            value = value << 6 | raw[at[own] + k] & 0x3F
        out[own] = value
    return out, at


def word_starts(raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The byte every word begins at; words cover the texts, which begin at ``bounds``."""
    cp, at = code_points(raw)
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[cp]
    begins = np.unique(bounds[bounds < len(raw)])
    begins = begins if at is None else np.searchsorted(at, begins)
    first = np.zeros(n + 1, bool)
    first[begins] = True
    first[n] = True
    start = first.copy()
    start[1:n] |= kind[1:] != kind[:-1]
    runs = np.flatnonzero(start)
    begin, end = runs[:-1], runs[1:]
    # the last of some spaces before a word stands alone; a plain one joins the word
    last = end[(kind[begin] == SPACE) & ~first[end]] - 1
    start[last] = True
    start[last[cp[last] == 32] + 1] = False
    # an apostrophe by itself takes up to two letters of some words
    q = end[(cp[begin] == 39) & (end - begin == 1) & start[begin] & ~first[end]]
    pad = np.append(cp, [0, 0])
    one = np.isin(pad[q], [ord(c) for c in "stmd"])
    two = ~first[q + 1] & np.isin(pad[q] << 8 | pad[q + 1] & 0xFF, [ord(a) << 8 | ord(b) for a, b in ("re", "ve", "ll")]) & (pad[q + 1] < 128)
    for q, size in ((q[one], 1), (q[two], 2)):
        start[q] = False
        start[q + size] = True
    found = np.flatnonzero(start[:n])
    return found if at is None else at[found]
