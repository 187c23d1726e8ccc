"""Structured Streaming over log rows: assignment of offsets and running bounds.

Each micro-batch is committed under its number, so a batch that runs again after a
failure replaces what it wrote. State is the table of partitions' next offsets, one
row a partition, read from what earlier batches committed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.files import Files


def _last(spark: SparkSession, folder: str, batch: int) -> str | None:
    """The folder of the last batch before ``batch`` that has been written whole."""
    files = Files(spark, folder)
    done = [int(n.split("=")[1]) for n in files.names("") if n.startswith("batch=") and files.exists(f"{n}/_SUCCESS")]
    before = [b for b in done if b < batch]
    return f"{folder}/batch={max(before)}" if before else None


def assign_stream(stream: DataFrame, folder: str, checkpoint: str, part: str, order: list[str], span) -> None:
    """Numbers rows in order of arrival per partition, and appends them under ``folder``; runs until the input is read.

    ``span`` cuts a batch's partitions into ranges along ``order`` that are numbered
    side by side. The state, the next offset of every partition, is written whole with
    each batch, so a batch reads that of the one before and no other.
    """
    from ..sources.views import number

    state_schema = f"{part} int, next long"

    def append(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        last = _last(spark, f"{folder}/next", batch)
        before = spark.read.schema(state_schema).parquet(last) if last else spark.createDataFrame([], state_schema)
        fresh = number(rows, part, order, span).join(before.withColumnRenamed("next", "_base"), part, "left").withColumn("off", F.col("off") + F.coalesce("_base", F.lit(0))).drop("_base")
        fresh.write.mode("overwrite").parquet(f"{folder}/rows/batch={batch}")
        done = spark.read.parquet(f"{folder}/rows/batch={batch}").groupBy(part).agg((F.max("off") + 1).alias("next"))
        done.unionByName(before).groupBy(part).agg(F.max("next").alias("next")).write.mode("overwrite").parquet(f"{folder}/next/batch={batch}")

    stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def lingering(spark: SparkSession, schema, files: int = 1000, size: str | None = None):
    """A reader of files whose micro-batches close by a number of files or by bytes, as batches of a log do."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    return reader.option("maxBytesPerTrigger", size) if size else reader


def bounds_stream(stream: DataFrame, folder: str, checkpoint: str, part: str) -> None:
    """Start, end, count and bytes of each partition as they grow: a stateful aggregation, its last result kept under ``folder``."""
    running = stream.groupBy(part).agg(F.min("off").alias("low"), (F.max("off") + 1).alias("high"), F.count(F.lit(1)).alias("n"), F.sum("encoded_bytes").alias("bytes"))

    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/batch={batch}")

    running.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def last_state(spark: SparkSession, folder: str, part: str) -> DataFrame:
    """The newest row of each partition that :func:`bounds_stream` has written."""
    seen = spark.read.option("basePath", folder).parquet(folder)
    newest = F.row_number().over(Window.partitionBy(part).orderBy(F.col("batch").desc()))
    return seen.withColumn("_i", newest).where("_i = 1").drop("_i", "batch")


def group_commit_stream(log_stream: DataFrame, folder: str, checkpoint: str, group: str) -> None:
    """A consumer group as a streaming query: after each micro-batch, the offsets done are appended as commits."""

    def commit(rows: DataFrame, batch: int) -> None:
        done = rows.groupBy("part").agg((F.max("off") + 1).alias("next")).withColumn("group_id", F.lit(group))
        done.write.mode("overwrite").parquet(f"{folder}/batch={batch}")

    log_stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
