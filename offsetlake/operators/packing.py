"""Greedy packing of records to batches, batches to segments, and sampling of index entries.

The folds carry state that starts again at every cut, which no window has. They
stream over partitions in order, with the order and the size of rows alone, and find
a cut at a time by search in running sums; what comes back is the cuts, which the rows
then meet in ranges of offsets. A task holds one Arrow batch of two numbers a row; rows
of one log partition are one sequence, as in the log itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.schema import BATCH_FIXED, SEGMENT_HEADER
from .integrity import previous


def cut_by_size(fixed: int, size: int, records: int | None, active: dict[int, tuple[int, int]] | None = None) -> Callable:
    """Cuts where the next row would take a run above ``size`` bytes, ``fixed`` ones included, or above ``records`` rows.

    A run has one row at least. ``active``: for a partition, the first row and the bytes
    of a run that goes on. Returns what :func:`_cuts` takes.
    """

    def begin(part):
        return (*active[part], 1) if active and part in active else None  # first row, bytes, rows

    def step(state, at: np.ndarray, n: np.ndarray):
        upto, found, i = np.cumsum(n), [], 0
        while i < len(at):
            had = upto[i - 1] if i else 0
            if state is None:
                state, first = (int(at[i]), fixed, 0), True
                found.append(i)
            else:
                first = False
            base, held, rows = state
            j = int(np.searchsorted(upto, had + size - held, "right"))
            if records is not None:
                j = min(j, i + records - rows)
            j = max(j, i + 1) if first or held == fixed else j
            if j >= len(at):
                return (base, held + int(upto[-1] - had), rows + len(at) - i), found
            state, i = None, j
        return state, found

    return begin, step


def _cuts(rows: DataFrame, order: str, size: str, how: Callable) -> DataFrame:
    """Rows (``part``, ``base``) where runs begin."""
    begin, step = how

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, state = None, None
        for b in batches:
            parts, at, n = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            edges = [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1).tolist(), len(parts)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if lo == hi:
                    continue
                if parts[lo] != part:
                    part = parts[lo]
                    state = begin(int(part))
                state, found = step(state, at[lo:hi], n[lo:hi])
                if found:
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo).take(pa.array(found)), pa.array(at[lo:hi][found].astype(np.int64))], names=["part", "base"])

    kind = rows.schema["part"].dataType.simpleString()
    narrow = rows.select("part", F.col(order).cast("long").alias("at"), F.col(size).cast("long").alias("n"))
    return narrow.repartition("part").sortWithinPartitions("part", "at").mapInArrow(run, f"part {kind}, base long")


def _based(rows: DataFrame, order: str, cuts: DataFrame, name: str) -> DataFrame:
    """Rows with the cut that they come behind, as ``name``."""
    marked = rows.join(cuts.select(F.col("part"), F.col("base").alias(order), F.col("base").alias("_cut")), ["part", order], "left")
    return previous(marked, ["part"], order, "_cut", own=True).withColumnRenamed("before", name).drop("_cut").select(*rows.columns, name)


def pack_batches(log: DataFrame, records: int, size: int) -> DataFrame:
    """``batch_base`` of every record: a batch closes when it has ``records`` or the next would take it above ``size`` bytes."""
    return _based(log, "off", _cuts(log, "off", "encoded_bytes", cut_by_size(BATCH_FIXED, size, records)), "batch_base")


def batch_stats(packed: DataFrame) -> DataFrame:
    """Per batch: ``end`` (exclusive), ``n``, ``bytes`` encoded, ``max_ts``."""
    return packed.groupBy("part", "batch_base").agg((F.max("off") + 1).alias("end"), F.count(F.lit(1)).alias("n"), (F.sum("encoded_bytes") + BATCH_FIXED).alias("bytes"), F.max("ts_ms").alias("max_ts"))


def roll_segments(batches: DataFrame, size: int, active: dict[int, tuple[int, int]] | None = None) -> DataFrame:
    """``segment_base`` of every batch: a segment that is not empty rolls when the next batch would take it above ``size`` bytes.

    ``active``: base and bytes, header included, of the segment that a partition goes on with.
    """
    based = _based(batches, "batch_base", _cuts(batches, "batch_base", "bytes", cut_by_size(SEGMENT_HEADER, size, None, active)), "segment_base")
    if not active:
        return based
    known = F.create_map(*(F.lit(x) for part, (base, _) in active.items() for x in (part, base)))
    return based.withColumn("segment_base", F.coalesce("segment_base", F.try_element_at(known, F.col("part").cast("int"))))


def sample_index(batches: DataFrame, stride: int) -> DataFrame:
    """``position`` of every batch in its partition, and in ``sampled`` whether the index has an entry for it.

    The first batch has one; another has one when its position is ``stride`` or more
    behind that of the last.
    """

    def step(state, at: np.ndarray, n: np.ndarray):
        start, last = (SEGMENT_HEADER, None) if state is None else state
        places = start + np.cumsum(n) - n
        found, i = [], 0 if last is None else int(np.searchsorted(places, last + stride, "left"))
        while i < len(at):
            found.append(i)
            last = int(places[i])
            i = int(np.searchsorted(places, last + stride, "left"))
        return (int(places[-1] + n[-1]), last), found

    cuts = _cuts(batches, "batch_base", "bytes", (lambda _: None, step))
    ranged = batches.withColumn("_range", F.floor(F.col("batch_base") / 65_536))
    ends = ranged.groupBy("part", "_range").agg(F.sum("bytes").alias("_n"))
    ahead = ends.select("part", "_range", (F.sum("_n").over(Window.partitionBy("part").orderBy("_range")) - F.col("_n")).alias("_ahead"))
    inside = F.sum("bytes").over(Window.partitionBy("part", "_range").orderBy("batch_base").rowsBetween(Window.unboundedPreceding, 0)) - F.col("bytes")
    placed = ranged.withColumn("_inside", inside).join(ahead, ["part", "_range"])
    placed = placed.select(*batches.columns, (F.col("_ahead") + F.col("_inside") + SEGMENT_HEADER).cast("long").alias("position"))
    marked = placed.join(cuts.select("part", F.col("base").alias("batch_base"), F.lit(True).alias("sampled")), ["part", "batch_base"], "left")
    return marked.select(*batches.columns, "position", F.coalesce("sampled", F.lit(False)).alias("sampled"))


def segment_stats(rolled: DataFrame) -> DataFrame:
    """Per segment: ``end``, ``n`` records, ``bytes`` with its header, ``max_ts``."""
    return rolled.groupBy("part", "segment_base").agg(F.max("end").alias("end"), F.sum("n").alias("n"), (F.sum("bytes") + SEGMENT_HEADER).alias("bytes"), F.max("max_ts").alias("max_ts"))
