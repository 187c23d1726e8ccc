"""Byte-pair encoding as a deterministic automaton.

The token automaton accepts a sequence of tokens exactly if byte-pair encoding of its
bytes gives that sequence. It is built from the merges in order of rank, one gadget
each. The gadget of the merge (a, b) at rank k

* gives ``a`` a state of its own, a clone of the state it led to without the
  arc ``b`` (after ``a`` the token ``b`` can no longer follow), and
* adds the arc ``ab`` wherever ``a`` could be followed by ``b``; it leads where
  ``b`` led.

A table of its states by tokens has 2.5 billion cells for 50,000 merges, so rows and
columns are kept as what the gadgets did: a clone is its parent and the arc it
lost, and a new column is the column it was copied from and the rank. An arc
``y`` out of the state of ``x`` exists unless some lost arc (z, w, k) applies,
with ``z`` on the right spine of ``x`` and ``w`` on the left spine of ``y``, each
older than the rank at which the spine left it.

What is driven is the automaton over bytes that comes of spelling the arcs out
(:class:`~.tables.Machine`): integer states, a table of transitions on bytes, a label
on each. Every byte of every pre-split word is one look-up; the words of a batch go
in step. The labels spell the accepted path from its end, and decoding puts the
bytes of labels side by side.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .presplit import flat, word_starts
from .shared import give_back, sliced, small_batches, table, text_of
from .tables import Machine, trace

FOREVER = 1 << 60


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class BpeAutomaton:
    """Compiled merges: which token may follow which, and the table over bytes that spells it out."""

    def __init__(self, single: dict[int, int], merges: list[tuple[int, int, int]], names: dict[int, bytes], most: int = 1 << 19):
        """single: id of each byte; merges: (left, right, made) ids by rank; names: the bytes of each id; most: transitions to hold."""
        self.parts: dict[int, tuple[int, int, int]] = {}  # made: rank, left, right
        self.lost: dict[tuple[int, int], int] = {}  # (state's token, arc): rank
        live = set(single.values())
        for rank, (left, right, made) in enumerate(merges):
            if left not in live or right not in live or not self.follows(left, right):
                continue  # the pair never stands side by side, so the token is never made
            if made in live:
                raise ValueError(f"two merges make the token {made}")
            self.lost[left, right] = rank
            self.parts[made] = rank, left, right
            live.add(made)
        self.table = Machine(((names[i], i) for i in sorted(live)), self.follows, most=most)
        self.names = [names.get(i, b"") for i in range(max(names, default=-1) + 1)]
        self.sizes = np.array([len(n) for n in self.names], np.int64)
        self.spelt = np.frombuffer(b"".join(self.names), np.uint8)
        self.firsts = np.cumsum(self.sizes) - self.sizes

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The token and its outermost parts on one side, each with the rank at which the spine left it."""
        out = [(token, FOREVER)]
        while part := self.parts.get(token):
            token = part[side]
            out.append((token, part[0]))
        return out

    def follows(self, last: int, nxt: int) -> bool:
        """Whether the state of ``last`` has the arc ``nxt``."""
        lost, left = self.lost, self._spine(nxt, 1)
        for z, z_until in self._spine(last, 2):
            for w, w_until in left:
                k = lost.get((z, w))
                if k is not None and k < z_until and k <= w_until:
                    return False
        return True

    def paths(self, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The label at every byte of words, and which bytes end a token of the accepted paths."""
        labels = self.table.labels(raw, starts, lengths)
        return labels, trace(labels, starts, lengths, self.sizes)

    def encode(self, word: bytes) -> list[int]:
        labels, ends = self.paths(np.frombuffer(word, np.uint8), np.zeros(1, np.int64), np.array([len(word)]))
        return labels[ends].tolist()

    def spell(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of arc labels, side by side."""
        sizes = self.sizes[ids]
        return self.spelt[np.repeat(self.firsts[ids] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]


class Encoder:
    """Whole texts: special tokens, pre-split words, automaton."""

    def __init__(self, automaton: BpeAutomaton, special: dict[str, int]):
        self.automaton, self.special = automaton, {k.encode(): v for k, v in special.items()}

    def _special(self, raw: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int]]:
        """Where special tokens stand inside texts: (first byte, end, id), leftmost and longest first."""
        whole, found = raw.tobytes(), []
        for name, number in self.special.items():
            at = whole.find(name)
            while at >= 0:
                found.append((at, -len(name), number))
                at = whole.find(name, at + 1)
        out, free = [], 0
        for at, size, number in sorted(found):
            inside = np.searchsorted(bounds, at, "right") == np.searchsorted(bounds, at - size, "left")
            if at >= free and inside:  # not over the end of a text
                out.append((at, at - size, number))
                free = at - size
        return out

    def encode_batch(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where each text's ids begin and the last end."""
        raw, bounds = flat(text)
        special = self._special(raw, bounds)
        cuts = np.array([x for a, b, _ in special for x in (a, b)], np.int64)
        starts = word_starts(raw, np.sort(np.concatenate([bounds[:-1], cuts])) if special else bounds[:-1])
        lengths = np.diff(starts, append=len(raw))
        if special:
            first, size, _ = (np.array(x) for x in zip(*special, strict=True))
            own = np.searchsorted(first, starts, "right") - 1
            plain = (own < 0) | (starts >= size[own])
            starts, lengths = starts[plain], lengths[plain]
        labels, ends = self.automaton.paths(raw, starts, lengths)
        for _, end, number in special:
            labels[end - 1] = number
            ends[end - 1] = True
        return labels[ends], np.concatenate([[0], np.cumsum(ends)])[bounds]

    def decode_batch(self, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """The text of each list of ids; bytes that are no UTF-8 are replaced."""
        raw = self.automaton.spell(ids)
        sizes = np.concatenate([[0], np.cumsum(self.automaton.sizes[ids])])[bounds]
        out = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(sizes.astype(np.int64).tobytes()), pa.py_buffer(raw)])
        try:
            return out.cast(pa.large_string())
        except pa.ArrowInvalid:
            return pa.array([b.decode("utf-8", "replace") for b in out.to_pylist()], pa.large_string())

    def encode(self, text: str) -> list[int]:
        return self.encode_batch(pa.array([text]))[0].tolist()

    def decode(self, ids) -> str:
        return self.decode_batch(np.asarray(ids, np.int64), np.array([0, len(ids)]))[0].as_py()


def load(path: str) -> tuple[BpeAutomaton, dict[str, int]]:
    """Compiles a byte-level vocabulary file; also gives its special tokens."""
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    letters = byte_letters()
    vocab: dict[str, int] = said["model"]["vocab"]
    names = {i: bytes(letters[c] for c in token) for token, i in vocab.items()}
    special = {t["content"]: t["id"] for t in said["added_tokens"]}
    names |= {i: t.encode() for t, i in special.items()}
    single = {letters[t]: i for t, i in vocab.items() if len(t) == 1}
    merges = []
    for merge in said["model"]["merges"]:
        left, right = merge.split(" ") if isinstance(merge, str) else merge
        merges.append((vocab[left], vocab[right], vocab[left + right]))
    return BpeAutomaton(single, merges, names), special


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One to a worker process; compiling takes under a second."""
    own = Encoder(*load(path))
    give_back()
    return own


def encode_documents(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Ids of every whole text and the text that they decode to.

    Returns one row for each row of ``docs``: the id column, ``ids`` array<int>,
    ``decoded`` string. A null text counts as the empty one (no ids, empty
    string); ids are passed through, null or repeated; other columns are not
    read, so their names cannot clash. Texts of any length are taken whole, in time
    that grows as the length of a word (one look-up a byte); a task holds the slice
    of a batch (256 rows and 1 MB, or one text) and tables of bounded size. Nothing is
    shuffled.
    """
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in sliced(batches):
            ids, bounds = own.encode_batch(batch.column(1))
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids, pa.int32()))
            decoded = own.decode_batch(ids, bounds).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, decoded], names=["id", "ids", "decoded"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_column).alias("id"), text_of(text_column).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, ids array<int>, decoded string").withColumnRenamed("id", id_column)


def tokenizer_path(name: str) -> str:
    """Where the vocabulary file lies on this machine; the package is installed on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_bpe_automaton(spark, sf_dir: str) -> DataFrame:
    out = encode_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
