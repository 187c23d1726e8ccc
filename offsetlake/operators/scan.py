"""Bounded reads of an offset-ordered log."""

from __future__ import annotations

import threading
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.schema import FETCH_BYTES, FETCH_BYTES_MOST, FETCH_RECORDS, FETCH_RECORDS_MOST, Closed, ConcurrentOperation, FetchLimitTooSmall, InvalidArgument, OffsetOutOfRange
from ..functions.scalar import start_position


def fetch_limits(max_records: int = 0, max_bytes: int = 0) -> tuple[int, int]:
    """Limits with defaults for 0; what exceeds the most allowed is refused."""
    if max_records < 0 or max_bytes < 0 or max_records > FETCH_RECORDS_MOST or max_bytes > FETCH_BYTES_MOST:
        raise InvalidArgument(f"limits of {max_records} records and {max_bytes} bytes")
    return max_records or FETCH_RECORDS, max_bytes or FETCH_BYTES


def fetch(log: DataFrame, part: int, offset: int, max_records: int = 0, max_bytes: int = 0) -> DataFrame:
    """The longest run of whole records from ``offset`` on within both limits, with ``next_offset``.

    Offsets are contiguous, so the limit of records is a range on ``off`` that
    reaches the scan; the running sum of bytes then sees that range alone.
    """
    records, size = fetch_limits(max_records, max_bytes)
    near = log.where((F.col("part") == part) & (F.col("off") >= offset) & (F.col("off") < offset + records))
    along = Window.partitionBy("part").orderBy("off")
    kept = near.withColumn("_upto", F.sum("encoded_bytes").over(along.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("_upto") <= size).drop("_upto")
    return kept.withColumn("next_offset", F.max("off").over(Window.partitionBy("part")) + 1)


def read_range(log: DataFrame, offset: int, records: int = 0) -> DataFrame:
    """Records ``offset`` to ``offset + records - 1`` of every partition."""
    n = records or FETCH_RECORDS_MOST
    return log.where(F.col("off").between(offset, offset + n - 1))


def bounds(log: DataFrame, parts: DataFrame) -> DataFrame:
    """Start and end of every partition of the catalog; an empty one starts and ends at 0."""
    found = log.groupBy("part").agg(F.min("off").alias("low"), (F.max("off") + 1).alias("high"), F.count(F.lit(1)).alias("n"), F.sum("encoded_bytes").alias("bytes"))
    return parts.join(found, "part", "left").na.fill(0, ["low", "high", "n", "bytes"])


def end_offset(log: DataFrame, part: int) -> int:
    found = log.where(F.col("part") == part).agg(F.max("off")).first()[0]
    return 0 if found is None else found + 1


def pages(log: DataFrame, records: int) -> DataFrame:
    """The number of the page on which each record comes when a partition is read ``records`` at a time."""
    return log.withColumn("page", F.floor(F.col("off") / records).cast("long"))


def first_by_key(log: DataFrame) -> DataFrame:
    """The first offset of each key of each partition."""
    return log.groupBy("part", "key").agg(F.min("off").alias("first_off"))


def start_positions(ends: DataFrame, explicit: int) -> DataFrame:
    """Where consumers of each mode start in each partition, from the output of :func:`bounds`."""
    modes = F.explode(F.array(*map(F.lit, ("earliest", "latest", "explicit")))).alias("mode")
    return ends.select("part", "low", "high", modes).withColumn("position", start_position(F.col("mode"), F.col("low"), F.col("high"), F.lit(explicit).cast("long")))


def seek(probes: DataFrame, index: DataFrame) -> DataFrame:
    """For each probe (part, off) the last index entry (part, base, position) not above it.

    Both sides meet once, in order, in a window that carries the last entry forward,
    inside ranges of 65,536 offsets; the last entry of each earlier range is carried
    over from a table of one row a range.
    """
    width = 65_536
    both = probes.select("part", "off", F.lit(1).alias("probe"), F.lit(None).cast("struct<base:bigint,position:bigint>").alias("entry")).unionByName(
        index.select("part", F.col("base").alias("off"), F.lit(0).alias("probe"), F.struct(F.col("base").cast("long").alias("base"), F.col("position").cast("long").alias("position")).alias("entry"))
    ).withColumn("range", F.floor(F.col("off") / width))
    ranges = both.groupBy("part", "range").agg(F.max("entry").alias("last"))
    carried = ranges.select("part", "range", F.max("last").over(Window.partitionBy("part").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    along = Window.partitionBy("part", "range").orderBy("off", "probe").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("entry", F.last("entry", ignorenulls=True).over(along)).where("probe = 1")
    return found.join(carried, ["part", "range"], "left").select("part", "off", F.coalesce("entry", "carried").alias("entry")).select("part", "off", F.col("entry.base").alias("base"), F.col("entry.position").alias("position"))


class Reader:
    """A cursor over one partition; it moves on success alone, and one call at a time.

    ``ends`` tells the start and end of the partition; without it each call asks the log.
    """

    def __init__(self, log: DataFrame, part: int, offset: int = 0, ends: Callable[[], tuple[int, int]] | None = None):
        self.log, self.part, self.next_offset, self.closed = log, part, offset, False
        self._ends, self._busy = ends or self._ask, threading.Lock()

    def _ask(self) -> tuple[int, int]:
        row = self.log.where(F.col("part") == self.part).agg(F.min("off"), F.max("off")).first()
        return (0, 0) if row[0] is None else (row[0], row[1] + 1)

    def _inside(self, offset: int) -> int:
        low, high = self._ends()
        if not low <= offset <= high:
            raise OffsetOutOfRange(f"{offset} is outside [{low}, {high}]")
        return high

    def seek(self, offset: int) -> None:
        self._inside(offset)
        self.next_offset = offset

    def fetch(self, max_records: int = 0, max_bytes: int = 0) -> list:
        """Rows of the next fetch, at most the limit of records; none at the end."""
        if not self._busy.acquire(blocking=False):
            raise ConcurrentOperation("the reader is busy with another call")
        try:
            if self.closed:
                raise Closed("the reader is closed")
            limits = fetch_limits(max_records, max_bytes)
            if self.next_offset == self._inside(self.next_offset):
                return []
            rows = fetch(self.log, self.part, self.next_offset, *limits).orderBy("off").collect()
            if not rows:
                raise FetchLimitTooSmall(f"the record at {self.next_offset} exceeds the limit")
            self.next_offset = rows[-1]["off"] + 1
            return rows
        finally:
            self._busy.release()

    def close(self) -> None:
        self.closed = True


def read_pages(log: DataFrame, part: int, records: int, size: int = 0) -> list[tuple[int, int, int]]:
    """(first offset, records, next offset) of each fetch of a :class:`Reader` from the start to the end of a partition."""
    reader = Reader(log, part)
    reader.next_offset = reader._ends()[0]
    out = []
    while rows := reader.fetch(records, size):
        out.append((rows[0]["off"], len(rows), reader.next_offset))
    return out


def _fetch_ends(at: np.ndarray, n: np.ndarray, begin: np.ndarray, records: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a fetch from each offset of ``begin``: its first row, the row behind its last, and the next offset (the same where it has no row)."""
    upto = np.concatenate(([0], np.cumsum(n)))
    i = np.searchsorted(at, begin)
    j = np.minimum(np.searchsorted(at, begin + records), np.searchsorted(upto, upto[i] + size, "right") - 1)
    return i, j, np.where(j > i, at[np.maximum(j, 1) - 1] + 1, begin)


def fetches(log: DataFrame, records: int = 0, size: int = 0, width: int = 65_536) -> DataFrame:
    """``first_off``, ``n`` and ``next_offset`` of each fetch of a :class:`Reader` from the start to the end of every partition.

    A fetch begins where the one before ends, but the first to begin in a range of
    offsets does so at one of its first ``records``. Ranges (of ``width``, more for
    large fetches) find side by side where each of these leads behind them; a walk over
    these maps, one row of 4 bytes times ``records`` a range, finds the one where a
    reader comes in; ranges then list their fetches from there.
    """
    records, size = fetch_limits(records, size)
    width = max(width, 16 * records)
    largest = log.agg(F.max("encoded_bytes")).first()[0]
    if largest is not None and largest > size:
        raise FetchLimitTooSmall(f"a record of {largest} bytes exceeds the limit of {size}")

    def ordered(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        first = rows["range"][0].as_py() * width
        at, n = rows["off"].to_numpy(), rows["n"].to_numpy()
        along = np.argsort(at)
        return at[along], n[along], np.arange(first, first + width)

    def lead(rows: pa.Table) -> pa.Table:
        at, n, begin = ordered(rows)
        first, low = int(begin[0]), int(at[0])
        to = np.concatenate((_fetch_ends(at, n, begin, records, size)[2] - first, np.arange(width, width + records)))
        while not np.array_equal(further := to[to], to):
            to = further
        from_low = int(to[low - first]) if low < first + width else None
        return pa.table({"part": rows["part"].slice(0, 1), "range": rows["range"].slice(0, 1), "low": [low], "high": [int(at[-1]) + 1], "from_low": pa.array([from_low], pa.int64()), "to": [to[:records].astype("<i4").tobytes()]})

    def walk(maps: pa.Table) -> pa.Table:
        maps = maps.sort_by("range")
        ranges, begins, begin = [], [], maps["low"][0].as_py()
        for i, (at, low, high, from_low) in enumerate(zip(*(maps[c].to_pylist() for c in ("range", "low", "high", "from_low")), strict=True)):
            first = at * width
            if begin == high or begin >= first + width:
                continue
            if begin >= first:
                ranges.append(at)
                begins.append(begin)
                begin = first + (from_low if begin == low else int(np.frombuffer(maps["to"][i].as_py(), "<i4")[begin - first]))
            if begin < min(first + width, high):
                raise FetchLimitTooSmall(f"no record in the {records} offsets from {begin} on")
        return pa.table({"part": maps["part"].slice(0, len(ranges)), "range": pa.array(ranges, pa.int64()), "begin": pa.array(begins, pa.int64())})

    def listed(rows: pa.Table, entry: pa.Table) -> pa.Table:
        found = []
        if entry.num_rows:
            at, n, begin = ordered(rows)
            first, last, after = _fetch_ends(at, n, begin, records, size)
            k = entry["begin"][0].as_py() - int(begin[0])
            while k < width and first[k] < len(at):
                found.append(k)
                k = int(after[k] - begin[0])
        taken = pa.table({"first_off": at[first[found]], "n": (last - first)[found], "next_offset": after[found]}) if found else pa.table({c: pa.array([], pa.int64()) for c in ("first_off", "n", "next_offset")})
        return taken.add_column(0, "part", rows["part"].slice(0, len(found)))

    kind = log.schema["part"].dataType.simpleString()
    own = F.floor(F.col("off") / width)
    ranges = F.when((F.col("off") % width < records) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))  # a fetch may end in the next range
    rows = log.select("part", F.explode(ranges).alias("range"), F.col("off").cast("long").alias("off"), F.coalesce(F.col("encoded_bytes").cast("long"), F.lit(0)).alias("n"))
    maps = rows.groupBy("part", "range").applyInArrow(lead, f"part {kind}, range long, low long, high long, from_low long, to binary")
    entries = maps.groupBy("part").applyInArrow(walk, f"part {kind}, range long, begin long")
    return rows.groupBy("part", "range").cogroup(entries.groupBy("part", "range")).applyInArrow(listed, f"part {kind}, first_off long, n long, next_offset long")


def verify(log: DataFrame, part: int, low: int, high: int) -> DataFrame:
    """What a scan of [``low``, ``high``) of a partition has to find: records, whether they are contiguous, and the digest of their order."""
    from . import integrity, metrics

    own = log.where((F.col("part") == part) & (F.col("off") >= low) & (F.col("off") < high))
    found = own.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("off").alias("first"), F.max("off").alias("last"))
    whole = (F.col("n") == high - low) & (F.col("first") == low) & (F.col("last") == high - 1) & F.col("gaps").isNull()
    return found.join(integrity.gaps(own).select("part", "gaps"), "part", "left").join(metrics.digest(own), "part").select("part", "n", whole.alias("whole"), "digest")


def matching(log: DataFrame, key: Column) -> DataFrame:
    """The first record of a key, to find out whether an append came through."""
    return log.where(F.col("key") == key).orderBy("off").limit(1)
