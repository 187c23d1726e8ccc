"""Checks of logs, catalogs and indexes. Each returns rows that are wrong, or flags beside rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gaps(log: DataFrame, width: int = 65_536) -> DataFrame:
    """Per partition: ``gaps`` (runs of missing offsets) and ``missing`` offsets between its first and last.

    Steps between neighbours are counted inside ranges of offsets, and those between
    ranges over one row a range.
    """
    ranged = log.select("part", "off", F.floor(F.col("off") / width).alias("range"))
    step = F.col("off") - F.lag("off").over(Window.partitionBy("part", "range").orderBy("off"))
    spans = ranged.withColumn("step", step).groupBy("part", "range").agg(F.count_if(F.col("step") > 1).alias("inside"), F.coalesce(F.sum(F.when(F.col("step") > 1, F.col("step") - 1)), F.lit(0)).alias("lost"), F.min("off").alias("low"), F.max("off").alias("high"))
    between = F.col("low") - F.lag("high").over(Window.partitionBy("part").orderBy("range")) - 1
    found = spans.withColumn("between", F.coalesce(between, F.lit(0)))
    return found.groupBy("part").agg((F.sum("inside") + F.count_if(F.col("between") > 0)).alias("gaps"), F.sum(F.col("lost") + F.col("between")).alias("missing")).where("gaps > 0")


def duplicates(rows: DataFrame, *columns: str) -> DataFrame:
    """Values of ``columns`` that more than one row has, with ``n``."""
    return rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def running_max(log: DataFrame, value: str, order: list[str], span: Column) -> Column:
    """Greatest ``value`` so far in each partition; ``span`` cuts partitions of a sorted window (constant for none)."""
    return F.max(value).over(Window.partitionBy("part", span).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def prefix_max(log: DataFrame, value: str = "ts_ms", width: int = 65_536) -> DataFrame:
    """``prefix_max``: the greatest ``value`` up to each record. Ranges of offsets run side by side."""
    ranged = log.withColumn("_range", F.floor(F.col("off") / width))
    tops = ranged.groupBy("part", "_range").agg(F.max(value).alias("_top"))
    carried = tops.select("part", "_range", F.max("_top").over(Window.partitionBy("part").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
    inside = running_max(ranged, value, ["off"], F.col("_range"))
    return ranged.withColumn("_inside", inside).join(carried, ["part", "_range"], "left").withColumn("prefix_max", F.greatest("_inside", "_carried")).drop("_range", "_inside", "_carried")


def previous(rows: DataFrame, keys: list[str], order: str, value: str | Column, width: int = 65_536, own: bool = False) -> DataFrame:
    """``before``: the last ``value`` that is not null, of the rows of a key that come earlier by the whole number ``order``.

    With ``own`` a row's own value counts, too. Ranges of ``order`` run side by side, and the last value of each is carried to
    those behind it in a table of one row a range that has any, so the history of one
    key is many tasks.
    """
    rows = rows.withColumn("_value", F.col(value) if isinstance(value, str) else value).withColumn("_range", F.floor(F.col(order) / width))
    ends = rows.where("_value is not null").groupBy(*keys, "_range").agg(F.max_by("_value", order).alias("_end"))
    spans = rows.select(*keys, "_range").distinct().join(ends, [*keys, "_range"], "left")
    over = Window.partitionBy(*keys).orderBy("_range") if keys else Window.partitionBy(F.lit(0)).orderBy("_range")
    carried = spans.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_range").alias("_at"), F.last("_end", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
    inside = F.last("_value", ignorenulls=True).over(Window.partitionBy(*keys, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0 if own else -1))
    same = F.col("_range") == F.col("_at")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    met = rows.withColumn("_inside", inside).join(carried, same)
    return met.withColumn("before", F.coalesce("_inside", "_carried")).drop("_value", "_range", "_inside", "_carried", "_at", *(f"_k{i}" for i in range(len(keys))))


def chain(events: DataFrame, keys: list[str], order: str, value: str, expected: str) -> DataFrame:
    """Rows whose ``expected`` differs from ``value`` of the row before, per key; ``found`` is what stands there.

    Of the first row of a key nothing is expected.
    """
    seen = previous(events, keys, order, value)
    return seen.withColumnRenamed("before", "found").where(F.col("found").isNotNull() & (F.col("found") != F.col(expected)))


def only_in(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that one of two tables lacks: ``side`` is 'left' or 'right', the one that has them."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    return a.join(b, keys, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, keys, "left_anti").withColumn("side", F.lit("right")))


def compare(expected: DataFrame, found: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Rows of two inventories that do not agree: ``problem`` is 'missing', 'unknown' or the differing columns."""
    a, b = expected.select(*keys, F.struct(*values).alias("_want")), found.select(*keys, F.struct(*values).alias("_have"))
    both = a.join(b, keys, "full_outer")
    differ = F.array_join(F.filter(F.array(*(F.when(~F.col(f"_want.{v}").eqNullSafe(F.col(f"_have.{v}")), F.lit(v)) for v in values)), lambda v: v.isNotNull()), ",")
    problem = F.when(F.col("_have").isNull(), F.lit("missing")).when(F.col("_want").isNull(), F.lit("unknown")).otherwise(differ)
    return both.select(*keys, problem.alias("problem")).where(F.col("problem") != "")


def tiles(retired: DataFrame) -> DataFrame:
    """Whether lists of retired segments (``old_low``, ``new_low``, ``retired`` array<struct<base, end, ...>>) tile the range that went."""
    s = F.col("retired")
    steps = F.transform(s, lambda x, i: F.when(i == 0, x["base"] == F.col("old_low")).otherwise(x["base"] == F.get(s, i - 1)["end"]) & (x["end"] > x["base"]))
    ok = (F.size(s) > 0) & F.forall(steps, lambda x: x) & (F.get(s, F.size(s) - 1)["end"] == F.col("new_low"))
    return retired.withColumn("tiles", F.coalesce(ok, F.lit(False)))


def canonical(column: Column) -> Column:
    """Whether an array is in order and without repeats."""
    return column == F.array_sort(F.array_distinct(column))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables have the same rows, each as often."""
    return a.exceptAll(b).limit(1).count() == 0 and b.exceptAll(a).limit(1).count() == 0


def same_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> bool:
    """Whether two tables have the same set of keys."""
    return only_in(a, b, keys).limit(1).count() == 0


def outside(rows: DataFrame, allowed: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not among those allowed."""
    return rows.join(allowed.select(*keys).distinct(), keys, "left_anti")
