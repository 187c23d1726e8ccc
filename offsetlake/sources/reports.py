"""Reports of runs and benchmarks: JSON and text to DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.schema import InvalidArgument
from .files import Files

RUN = "version int, duration_ns long, measurement_ns long, warmup_ns long, offered long, acknowledged long, samples array<struct<elapsed_ns:bigint,offered:bigint,acknowledged:bigint>>"


def runs(spark: SparkSession, path: str) -> DataFrame:
    """Run reports of versions 1 and 2 that lasted; a missing measurement is the whole duration."""
    seen = spark.read.schema(RUN).json(path, multiLine=True)
    return seen.where(F.col("version").isin(1, 2) & (F.col("duration_ns") > 0)).withColumn("measurement_ns", F.coalesce("measurement_ns", "duration_ns"))


def benchmark_lines(spark: SparkSession, path: str) -> DataFrame:
    """``name``, ``runs``, ``unit``, ``value``: a row for each tagged number of a benchmark's output line."""
    lines = spark.read.text(path).where(F.col("value").rlike(r"^Benchmark\S+\s+\d+\s"))
    cells = F.split(F.trim("value"), r"\s+")
    pairs = F.transform(F.sequence(F.lit(2), F.size(cells) - 2, F.lit(2)), lambda i: F.struct(F.get(cells, i + 1).alias("unit"), F.try_to_number(F.get(cells, i), F.lit("999999999999.999999")).cast("double").alias("value")))
    return lines.select(F.regexp_replace(F.regexp_replace(F.get(cells, 0), "^Benchmark", ""), r"-\d+$", "").alias("name"), F.get(cells, 1).cast("long").alias("runs"), F.explode(pairs).alias("p")).select("name", "runs", "p.unit", "p.value")


def settings(spark: SparkSession, path: str) -> DataFrame:
    """``name=value`` lines; what follows the first sign belongs to the value."""
    cells = F.split("value", "=", 2)
    return spark.read.text(path).where(F.col("value").contains("=")).select(F.trim(F.get(cells, 0)).alias("name"), F.trim(F.get(cells, 1)).alias("value"))


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    """Number and bytes of segment files (20 digits and ``.log``) below a folder, without reading them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    return files.where(F.regexp_extract("path", r"/([0-9]{20}\.log)$", 1) != "").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def merge_settings(first: DataFrame, second: DataFrame) -> DataFrame:
    """Settings of both; where both have one, the first wins."""
    joined = first.select("name", F.col("value").alias("a")).join(second.select("name", F.col("value").alias("b")), "name", "full_outer")
    return joined.select("name", F.coalesce("a", "b").alias("value"))


def markdown(rows: DataFrame, order: str, most: int = 1000) -> str:
    """A report's rows as a Markdown table, in order, ``most`` of them at most; a last line says how many are left out."""
    columns = rows.columns
    lines = ["| " + " | ".join(columns) + " |", "|" + "-|" * len(columns)]
    for row in rows.orderBy(order).limit(most).collect():
        lines.append("| " + " | ".join("" if v is None else f"{v:g}" if isinstance(v, float) else str(v) for v in row) + " |")
    total = rows.count()
    if total > most:
        lines.append(f"\n{total - most} more rows are left out.")
    return "\n".join(lines) + "\n"


def append_section(spark: SparkSession, folder: str, name: str, marker: str, text: str) -> None:
    """Adds a section to a report file; one with the same marker is refused."""
    files = Files(spark, folder)
    have = files.read(name).decode() if files.exists(name) else ""
    line = f"<!-- {marker} -->"
    if line in have:
        raise InvalidArgument(f"{name} has {marker} already")
    files.swap(name, f"{have}{line}\n{text.rstrip()}\n".encode())


def save_json(rows: DataFrame, folder: str, name: str, most: int = 100_000) -> None:
    """A report as one file of JSON lines in canonical order; a table of more than ``most`` rows is refused, write that with Spark."""
    if rows.count() > most:
        raise InvalidArgument(f"a report of more than {most} rows")
    Files(rows.sparkSession, folder).swap(name, "".join(line + "\n" for line in sorted(r[0] for r in rows.select(F.to_json(F.struct(*sorted(rows.columns)))).collect())).encode())
