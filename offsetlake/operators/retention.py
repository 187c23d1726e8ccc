"""Which segments may go."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.schema import BY_SIZE, BY_TIME, DIAGNOSTICS_MOST, RETIRED_MOST
from ..functions.scalar import elapsed_at_least


def plan(segments: DataFrame, now_ms, mask: int, retention_ms: int = 0, retention_bytes: int = 0) -> DataFrame:
    """The longest run of first segments of each partition for which the rule of time or of size holds.

    ``segments``: part, segment_base, end, bytes, max_ts. The rule of size sees what
    is left when all before are gone; the last segment never goes; the run stops at
    the first segment that must stay; at most 65,536 go at once. Adds ``retired``
    and ``reason``, a mask of the rules that hold.
    """
    along = Window.partitionBy("part").orderBy("segment_base")
    before = F.coalesce(F.sum("bytes").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("bytes").over(Window.partitionBy("part"))
    by_time = elapsed_at_least(now_ms, F.col("max_ts"), F.lit(retention_ms)) if mask & BY_TIME else F.lit(False)
    by_size = F.col("left_bytes") > retention_bytes if mask & BY_SIZE else F.lit(False)
    seen = segments.withColumn("left_bytes", total - before).withColumn("_i", F.row_number().over(along)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("part")))
    seen = seen.withColumn("reason", F.when(by_time, BY_TIME).otherwise(0).bitwiseOR(F.when(by_size, BY_SIZE).otherwise(0)))
    may = (F.col("reason") > 0) & (F.col("_i") < F.col("_n")) & (F.col("_i") <= RETIRED_MOST)
    run = F.min(may.cast("int")).over(along.rowsBetween(Window.unboundedPreceding, 0)) == 1
    return seen.withColumn("retired", run).drop("_i", "_n", "left_bytes")


def summary(planned: DataFrame) -> DataFrame:
    """Per partition: segments that go, the new start, bytes that stay, and the reasons together."""
    gone = F.col("retired")
    return planned.groupBy("part").agg(
        F.count_if(gone).alias("n_retired"),
        F.coalesce(F.max(F.when(gone, F.col("end"))), F.min("segment_base")).alias("new_low"),
        F.coalesce(F.sum(F.when(~gone, F.col("bytes"))), F.lit(0)).alias("bytes_left"),
        F.coalesce(F.bit_or(F.when(gone, F.col("reason"))), F.lit(0)).alias("reason_mask"),
    )


def must_roll(active: DataFrame, now_ms, age_ms: int, limit: int) -> DataFrame:
    """Active segments to close before a plan: those that have records and are too old or, with the rest, above the limit."""
    return active.withColumn("roll", (F.col("n") > 0) & (elapsed_at_least(now_ms, F.col("max_ts"), F.lit(age_ms)) | (F.col("total_bytes") > limit) | F.lit(limit == 0)))


def cleanup_debt(retired: DataFrame, most: int = DIAGNOSTICS_MOST) -> DataFrame:
    """Retired segments that still have files, of the first ``most``: n, bytes, least base, and whether more were left out."""
    first = retired.orderBy("part", "segment_base").limit(most)
    seen = first.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.min("segment_base").alias("min_base"))
    return seen.join(retired.agg((F.count(F.lit(1)) > most).alias("truncated")), F.lit(True))


def check_interval(configs: DataFrame, most_ms: int = 3_600_000) -> DataFrame:
    """The least interval of partitions that have a policy, an hour at most."""
    return configs.agg(F.least(F.coalesce(F.min(F.when(F.col("retention_mask") > 0, F.col("check_interval_ms"))), F.lit(most_ms)), F.lit(most_ms)).alias("check_interval_ms"))
