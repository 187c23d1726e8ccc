"""Exact deduplication with two passes over a Bloom filter.

Pass 1 hashes every text and counts, in each slot of the filter, whether no, one
or more rows fell there. Counting saturates at two, so filters of any partitions
merge by OR and AND in any order. A hash that came twice has all its slots at two.
Pass 2 looks every row up: a row with a slot below two is surely the only one of
its text and passes straight through; only the others shuffle, by their hash, and
are grouped exactly, so a false positive costs a shuffled row and never a result.

A filter has 8 slots a row up to ``max_slots`` (by default 2^29: 64 MB to broadcast,
two such fields of bits in a task). More rows than that have several filters, each
of a range of hashes and used alone, on the narrow rows of that range, so the share
of rows that shuffle does not grow with the table.

Groups that hold a large part of the rows that shuffle are few; what was decided of
them is broadcast, so their rows do not meet in one task.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize, sliced, table

MAX_SLOTS = 1 << 29
SEGMENT = 1 << 18  # slots that travel together
PROBES = 2
HOT, MOST_HOT = 256, 20_000  # groups above HOT rows and the 20,000th part of all: so many at most


def digest(text: str | None) -> bytes:
    """SHA-256 of the text with A-Z in lower case; a null text counts as the empty one."""
    return hashlib.sha256((text or "").encode().lower()).digest()  # bytes.lower() changes A-Z alone


def slots(digests: list[bytes], m: int) -> np.ndarray:
    """The slots of each digest, a row each."""
    words = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 4)
    return (words[:, :PROBES] & np.uint64(m - 1)).astype(np.int64)


def _digests(text: pa.Array) -> list[bytes]:
    raw = text.cast(pa.binary()).to_pylist()
    return [hashlib.sha256((t or b"").lower()).digest() for t in raw]


def hashed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_digests(b.column(1)), pa.binary())], names=["id", "digest"])

    return docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text")).mapInArrow(run, f"id {kind}, digest binary")


def sizes(rows: int, max_slots: int) -> tuple[int, int]:
    """Ranges of hashes that have a filter each, and the slots of one; both powers of two."""
    m, ranges = 1 << 16, 1
    while m * ranges < 8 * rows:
        if m < max_slots:
            m *= 2
        else:
            ranges *= 2
    return ranges, m


def of_range(ranges: int):
    """The range of a hash, by a hash of it that chooses no slot."""
    return F.pmod(F.xxhash64("digest"), F.lit(ranges))


def _mark(field: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a field of bits that slots (sorted, different) fall in, and their bits there."""
    at = found >> 3
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else at
    return at[first], np.bitwise_or.reduceat(np.left_shift(1, found & 7).astype(np.uint8), first) if len(at) else at.astype(np.uint8)


def slot_filter(digests: DataFrame, m: int, least: int = 2):
    """Pass 1: the broadcast filter of the slots that ``least`` rows or more (1 or 2) fell into."""
    size = min(SEGMENT, m)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(m // 8, np.uint8), np.zeros(m // 8, np.uint8)
        for b in batches:
            if not b.num_rows:
                continue
            found = slots(b.column(0).to_pylist(), m)
            found, n = np.unique(np.concatenate([found[:, 0], *(np.where((found[:, [k]] == found[:, :k]).any(1), -1, found[:, k]) for k in range(1, PROBES))]), return_counts=True)
            found, n = found[found >= 0], n[found >= 0]
            at, bits = _mark(once, found)
            twice[at] |= once[at] & bits
            once[at] |= bits
            at, bits = _mark(twice, found[n > 1])
            twice[at] |= bits
        part = size // 8
        yield from _segments((k, once[k * part : (k + 1) * part], twice[k * part : (k + 1) * part]) for k in range(m // size))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole: dict[int, list] = defaultdict(lambda: [np.zeros(size // 8, np.uint8), np.zeros(size // 8, np.uint8)])
        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            for k, once, twice in zip(*(c.to_pylist() for c in b.columns), strict=True):
                own, (a, c) = whole[k], (np.frombuffer(unpack(x), np.uint8) for x in (once, twice))
                own[1] |= c | own[0] & a
                own[0] |= a
        yield from _segments((k, *v) for k, v in whole.items())

    schema = "segment int, once binary, twice binary"
    parts = digests.select("digest").mapInArrow(count, schema).repartition("segment").mapInArrow(merge, schema).select("segment", "once" if least == 1 else "twice")
    bits = np.zeros(m // 8, np.uint8)
    for segment, field in parts.toLocalIterator():  # max_slots / 8 bytes at most
        bits[segment * size // 8 : (segment + 1) * size // 8] = np.frombuffer(zstandard.decompress(field), np.uint8)
    return digests.sparkSession.sparkContext.broadcast(bits.tobytes())


def _segments(found) -> Iterator[pa.RecordBatch]:
    shrink = zstandard.ZstdCompressor(level=1).compress
    for k, once, twice in found:
        if once.any():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([shrink(once.tobytes())], pa.binary()), pa.array([shrink(twice.tobytes())], pa.binary())], names=["segment", "once", "twice"])


def in_filter(digests: list[bytes], bloom, m: int) -> np.ndarray:
    """Pass 2: False only for digests with a slot that is not in the filter."""
    bits = np.frombuffer(bloom.value, np.uint8)
    if not digests:
        return np.zeros(0, bool)
    found = slots(digests, m)
    return ((bits[found >> 3] >> (found & 7).astype(np.uint8)) & 1).all(1)


def _looked(found: DataFrame, rows: int, max_slots: int) -> DataFrame:
    """Hashed rows (``id``, ``digest``) and whether they may be repeated, ``again``: each range by its own filter."""
    ranges, m = sizes(rows, max_slots)
    kind = found.schema["id"].dataType.simpleString()

    def look(bloom):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(in_filter(b.column(1).to_pylist(), bloom, m))], names=["id", "digest", "again"])

        return run

    parts = []
    for k in range(ranges):
        own = found if ranges == 1 else found.where(of_range(ranges) == k)
        bloom = slot_filter(own, m)
        parts.append(materialize(own.mapInArrow(look(bloom), f"id {kind}, digest binary, again boolean"), "looked"))
        bloom.unpersist()
    return reduce(DataFrame.unionByName, parts)


def _groups(again: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``digest``, ``keep_id``, ``group_size``) of the groups of rows, and those that hold many, to broadcast.

    Rows are counted and their largest id taken before they shuffle.
    """
    groups = materialize(again.groupBy("digest").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")
    total = groups.agg(F.sum("group_size").alias("n")).first()["n"] or 0
    return groups, F.broadcast(groups.where(F.col("group_size") > max(HOT, total // MOST_HOT)))


def exact_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", max_slots: int = MAX_SLOTS) -> DataFrame:
    """Which row of each group of equal texts stays.

    One row for each row of ``docs``: the id column, ``keep_id`` (the largest id of
    the rows with an equal text), ``group_size`` long, ``kept`` boolean, ``digest``
    binary. Texts are equal when identical after lower-casing A-Z; null counts as
    empty. Null ids lose to any other id; where a group has none but null ids,
    ``keep_id`` is null and all its rows are kept. Repeated rows share one id, so
    all of them are kept here and count in ``group_size``; :func:`drop_copies`
    leaves one. Other columns are not read.
    """
    found = materialize(hashed(docs, id_column, text_column), "digests")
    looked = _looked(found, found.count(), max_slots)
    again = looked.where("again").select("id", "digest")
    groups, hot = _groups(again)
    told = again.join(hot, "digest", "left")
    many = told.where("group_size is not null")
    few = told.where("group_size is null").select("id", "digest").join(groups, "digest")
    shuffled = many.unionByName(few).select("id", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")
    straight = looked.where("not again").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
    return straight.unionByName(shuffled).withColumnRenamed("id", id_column)


def _winner(digest_: bytes, id_) -> bytes:
    return hashlib.sha256(digest_ + repr(id_).encode()).digest()


def drop_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", max_slots: int = MAX_SLOTS) -> DataFrame:
    """``docs`` with one row for each group of equal texts, the one with the largest id; columns as they were.

    Winners are found on narrow rows of ids and hashes. Texts then pass two filters:
    one of hashes that came twice, which rows that are surely alone pass straight, and
    one of winners, which lets go of nearly all other copies where they are; what is
    left, a row a group or so, shuffles and is decided exactly. Null and repeated ids
    as in :func:`exact_groups`, but of rows that tie, one stays. Beyond ``max_slots``
    / 8 rows these two filters fill up: more texts shuffle, the result is the same.
    """
    found = materialize(hashed(docs, id_column, text_column), "digests")
    rows = found.count()
    kind = docs.schema[id_column].dataType.simpleString()
    m = min(max_slots, sizes(rows, max_slots)[1])
    bloom = slot_filter(found, m)

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(in_filter(b.column(1).to_pylist(), bloom, m)))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([_winner(d, i) for d, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)], pa.binary())], names=["digest"])

    groups, _ = _groups(found.mapInArrow(repeated, f"id {kind}, digest binary"))
    winners = slot_filter(groups.select("digest", "keep_id").mapInArrow(named, "digest binary"), m, 1)
    names = docs.columns
    inner = [f"c{i}" for i in range(len(names))]
    at, key = names.index(text_column), names.index(id_column)
    schema = ", ".join(f"{n} {docs.schema[c].dataType.simpleString()}" for n, c in zip(inner, names, strict=True))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            own = _digests(b.column(at))
            again = in_filter(own, bloom, m)
            stays = ~again | in_filter([_winner(d, i) for d, i in zip(own, b.column(key).to_pylist(), strict=True)], winners, m)
            whole = pa.RecordBatch.from_arrays([*b.columns, pa.array(own, pa.binary()), pa.array(again)], names=[*inner, "digest", "again"])
            yield whole.filter(pa.array(stays))

    looked = docs.toDF(*inner).mapInArrow(look, f"{schema}, digest binary, again boolean")
    again = looked.where("again").drop("again")
    stays = again.join(groups.select("digest", "keep_id"), "digest").where(F.col(inner[key]).eqNullSafe(F.col("keep_id"))).dropDuplicates(["digest"])
    return looked.where("not again").select(*inner).unionByName(stays.select(*inner)).toDF(*names)


def op10_bloom_dedup(spark, sf_dir: str) -> DataFrame:
    out = exact_groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP10_SQL = """
WITH d AS (
    SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
    FROM documents
)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept,
       text_sha256
FROM d
"""
