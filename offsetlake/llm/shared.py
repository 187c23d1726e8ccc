"""Helpers that the operators of this subpackage share.

Everything here is bounded by a documented parameter or streams: no helper
collects rows of a corpus, and intermediate tables go to the folder that the
cluster names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.workspace import remove, work_path

WORD = r"[^\x20\x09-\x0D]+"


#: Rows of an Arrow batch; whole texts are large, and the JVM and the worker each hold a batch.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's rows of an Arrow batch to ``BATCH_ROWS``, if they are more."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cuts lineage: writes a table to the shared folder and reads it again.

    Executors can be lost at any time; what is read again does not depend on them.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = work_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def forget(df: DataFrame) -> None:
    """Removes a table that :func:`materialize` wrote and nothing reads any more."""
    remove(df.sparkSession, df.written_to)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text"):
    """The text, a null one as the empty one."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def give_back() -> None:
    """Returns memory that Arrow and the C library keep for themselves; workers outlive their tasks."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def sliced(batches, rows: int = 256, size: int = 1 << 20):
    """Arrow batches cut to some rows and bytes, or to one row, so that what a task makes of whole texts at a time is small."""

    def halves(b):
        if b.num_rows > 1 and b.nbytes > size:
            yield from halves(b.slice(0, b.num_rows // 2))
            yield from halves(b.slice(b.num_rows // 2))
        elif b.num_rows:
            yield b

    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield from halves(b.slice(at, rows))
    give_back()


def key_runs(batches, key: int = 0):
    """Runs of rows with one key, from batches sorted by it: each a list of slices of batches."""
    import numpy as np

    held, last = [], None
    for b in batches:
        if not b.num_rows:
            continue
        keys = b.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if held and keys[lo] != last:
                yield held
                held = []
            last = keys[lo]
            held.append(b.slice(lo, hi - lo))
    if held:
        yield held
        held = []
    give_back()
