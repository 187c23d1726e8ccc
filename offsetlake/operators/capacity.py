"""Limits on what a store holds, and pressure on its disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pressure(samples: DataFrame, stop: int, resume: int, width: int = 65_536) -> DataFrame:
    """Whether writes are refused at each sample (part, at, free): from below ``stop`` on, until ``resume`` is reached again.

    The state is that of the last sample outside the band between the two, so it is
    carried forward, inside ranges of ``at`` side by side and over them by one row a
    range. Before any such sample writes are taken.
    """
    said = F.when(F.col("free") < stop, True).when(F.col("free") >= resume, False)
    ranged = samples.withColumn("_said", said).withColumn("_range", F.floor(F.col("at") / width))
    along = Window.partitionBy("part", "_range").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    ends = ranged.groupBy("part", "_range").agg(F.max_by("_said", F.when(F.col("_said").isNotNull(), F.col("at"))).alias("_end"))
    carried = ends.select("part", "_range", F.last("_end", ignorenulls=True).over(Window.partitionBy("part").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
    seen = ranged.withColumn("_inside", F.last("_said", ignorenulls=True).over(along)).join(carried, ["part", "_range"], "left")
    return seen.withColumn("refused", F.coalesce("_inside", "_carried", F.lit(False))).drop("_said", "_range", "_inside", "_carried")


def over_limits(totals: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Rows of totals with the names of those that exceed their limit in ``over``."""
    over = F.array_join(F.filter(F.array(*(F.when(F.col(c) > n, F.lit(c)) for c, n in sorted(limits.items()))), lambda c: c.isNotNull()), ",")
    return totals.withColumn("over", over)


def history_fits(events: DataFrame, incoming: int, limit: int) -> DataFrame:
    """Whether a history of events (``bytes``) takes ``incoming`` more: bytes, remaining, fits."""
    used = F.coalesce(F.sum("bytes"), F.lit(0))
    return events.agg(used.alias("bytes"), F.greatest(limit - used, F.lit(0)).alias("remaining"), (used + incoming <= limit).alias("fits"))


def partition_stats(log: DataFrame, parts: DataFrame, segment_records: int) -> DataFrame:
    """Per partition of the catalog: segments, records, bytes, start, end, newest time; an empty one has one segment."""
    found = log.groupBy("part").agg(F.count_distinct(F.floor(F.col("off") / segment_records)).alias("segments"), F.count(F.lit(1)).alias("n"), F.sum("encoded_bytes").alias("bytes"), F.min("off").alias("low"), (F.max("off") + 1).alias("high"), F.max("ts_ms").alias("newest_ms"))
    return parts.join(found, "part", "left").na.fill(1, ["segments"]).na.fill(0, ["n", "bytes", "low", "high"])


def store_stats(stats: DataFrame) -> DataFrame:
    """All partitions together: partitions, those with records, segments, records, bytes."""
    return stats.agg(F.count(F.lit(1)).alias("partitions"), F.count_if(F.col("n") > 0).alias("with_records"), F.sum("segments").alias("segments"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
