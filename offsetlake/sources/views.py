"""Log views over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import millis, record_bytes

PARTS = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ROWS = 1 << 20  # of a table that is numbered without buckets, and of a bucket


def spans(rows: DataFrame, column: str, most: int = 10_000) -> Column | None:
    """The number of the span that a row's ``column`` (a number or time) falls in: about ``ROWS`` rows each; None for a small table.

    Bounds are approximate quantiles, ``most`` numbers at most; any bounds are right, they only deal the rows.
    """
    n = min(most, rows.count() // ROWS)
    if n < 2:
        return None
    at = F.unix_micros(F.col(column).cast("timestamp")) if dict(rows.dtypes)[column].startswith("timestamp") else F.col(column).cast("long")
    found = rows.agg(F.percentile_approx(at, [i / n for i in range(1, n)], 10 * n)).first()[0]
    bounds = F.array(*(F.lit(int(b)).cast("long") for b in sorted(set(found))))
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(n.bit_length()))))
    return F.aggregate(steps, F.lit(0), lambda i, step: F.when((i + step <= F.size(bounds)) & (F.get(bounds, i + step - 1) <= at), i + step).otherwise(i))


def number(rows: DataFrame, part: str, order: list[str], bucket: Column | None) -> DataFrame:
    """Offsets 0, 1, ... along ``order`` in each partition, as ``off``.

    ``bucket`` must not fall along ``order``. Rows are numbered inside buckets, and a
    running sum of the buckets' counts is added, so a partition of any size is as
    many tasks as it has buckets instead of one. Rows with a null bucket come first.
    Without a bucket a partition is one.
    """
    if bucket is None:
        return rows.withColumn("off", (F.row_number().over(Window.partitionBy(part).orderBy(*order)) - 1).cast("long"))
    rows = rows.withColumn("_bucket", bucket)
    counts = rows.groupBy(part, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    ahead = counts.select(F.col(part).alias("_part"), F.col("_bucket").alias("_at"), (F.sum("_n").over(Window.partitionBy(part).orderBy("_bucket")) - F.col("_n")).alias("_ahead"))
    inside = F.row_number().over(Window.partitionBy(part, "_bucket").orderBy(*order))
    same = F.col(part).eqNullSafe(F.col("_part")) & F.col("_bucket").eqNullSafe(F.col("_at"))
    numbered = rows.withColumn("_row", inside).join(ahead, same)
    return numbered.withColumn("off", (F.col("_ahead") + F.col("_row") - 1).cast("long")).drop("_bucket", "_row", "_ahead", "_part", "_at")


def log_events(spark: SparkSession, sf_dir: str, keep: Column | None = None) -> DataFrame:
    """``events`` as a log of four partitions in order of time."""
    events = table(spark, sf_dir, "events").withColumn("part", (F.col("user_id") % PARTS).cast("int"))
    log = number(events, "part", ["ts", "event_id"], spans(events, "ts"))
    if keep is not None:
        log = log.where(keep)
    return log.select("event_id", "part", "off", millis(F.col("ts")).alias("ts_ms"), F.col("event_type").alias("key"), F.col("props").alias("value"), record_bytes(F.col("event_type"), F.col("props")).alias("encoded_bytes"), F.col("value").alias("amount"))


def log_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as a log with large values."""
    turns = table(spark, sf_dir, "conversations").withColumn("part", (F.col("conv_id") % PARTS).cast("int"))
    log = number(turns, "part", ["conv_id", "turn"], spans(turns, "conv_id"))
    return log.select("part", "off", F.col("role").alias("key"), F.col("text").alias("value"), record_bytes(F.col("role"), F.col("text")).alias("encoded_bytes"))


def commits(log: DataFrame) -> DataFrame:
    """One commit for every third event: its type is the group, its offset is done."""
    return log.where("event_id % 3 = 0").select(F.col("key").alias("group_id"), "part", (F.col("off") + 1).alias("next"), F.col("event_id").alias("seq"))


def catalog_parts(spark: SparkSession, n: int = PARTS) -> DataFrame:
    return spark.range(n).select(F.col("id").cast("int").alias("part"))
