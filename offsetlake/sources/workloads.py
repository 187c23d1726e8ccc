"""Deterministic workloads: the same numbers give the same records, on any number of tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LARGE, SMALL, KEY_BYTES = 64 << 10, 1024, 64


def soak(spark: SparkSession, records: int, producers: int, seed: int, run: int, parts: int = 4) -> DataFrame:
    """Keyed records of producers in turn; of 64 in sequence one is large, one null, one empty, the others small.

    One in eight of the small ones is up to 127 bytes longer, by a hash of the key. A
    value is its key and then, byte by byte, the place in it modulo 256.
    """
    n = F.col("id")
    sequence = F.floor(n / producers)
    producer = n % producers
    key = F.format_string("soak-%016x-%016x-%08x-%016x", F.lit(seed), F.lit(run), producer, sequence)
    turn = sequence % 64
    h = F.xxhash64(F.lit(seed), key)
    small = SMALL + F.when(F.pmod(h, F.lit(8)) == 0, F.pmod(F.shiftright(h, 8), F.lit(128))).otherwise(0)
    size = F.when(turn == 0, LARGE).when(turn == 1, F.lit(None)).when(turn == 2, 0).otherwise(small).cast("int")
    cycle = bytes(range(256))
    filler = F.repeat(F.lit(cycle.hex()), LARGE // 256)
    value = F.when(size == 0, F.lit(b"")).when(size > 0, F.concat(key.cast("binary"), F.unhex(F.substring(filler, 2 * KEY_BYTES + 1, 2 * (size - KEY_BYTES)))))
    return spark.range(records).select((producer % parts).cast("int").alias("part"), producer.alias("producer"), sequence.alias("sequence"), key.alias("key"), value.alias("value"))


def soak_key(key):
    """Seed, run, producer and sequence of a key; null where it is none."""
    ok = key.rlike("^soak-[0-9a-f]{16}-[0-9a-f]{16}-[0-9a-f]{8}-[0-9a-f]{16}$")
    cells = F.split(key, "-")
    return F.when(ok, F.struct(*(F.conv(F.get(cells, i + 1), 16, 10).cast("long").alias(c) for i, c in enumerate(("seed", "run", "producer", "sequence")))))


def history(spark: SparkSession, records: int, value_bytes: int = 256, batch: int = 32) -> DataFrame:
    """A log of one partition with values of one size, in batches of one length."""
    return spark.range(records).select(F.lit(0).alias("part"), F.col("id").alias("off"), (F.col("id") - F.col("id") % batch).alias("batch_base"), F.repeat(F.lit("x"), value_bytes).alias("value"), F.col("id").alias("ts_ms"))
