"""Rates, percentiles, histograms and reports."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import rate

#: Upper bounds of latency buckets in nanoseconds, each exclusive; one more bucket is open.
STORE_BOUNDS = tuple(10**k for k in range(3, 10))
RUN_BOUNDS = (*(10**k for k in range(3, 10)), 5 * 10**9, 10 * 10**9, 30 * 10**9, 60 * 10**9)


def at_ranks(rows: DataFrame, value: str, ranks: dict[str, Column], *keys: str) -> DataFrame:
    """Values at ranks (from 1) of each key's values in order, a column for each; ``ranks`` are of the column ``n``, their number.

    Equal values are counted first; counts then run up inside spans of values, each a
    4,096th of the whole range, and over one row a span, so no task holds the values of
    a key.
    """
    seen = rows.where(F.col(value).isNotNull())
    ends = seen.agg(F.min(value).cast("double").alias("low"), F.max(value).cast("double").alias("high")).first()
    width = max(((ends["high"] or 0) - (ends["low"] or 0)) / 4096, 1e-300) if ends["low"] is not None else 1.0
    counted = seen.groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c")).withColumn("_span", F.floor((F.col("_v").cast("double") - F.lit(ends["low"] or 0.0)) / width))
    spans = counted.groupBy(*keys, "_span").agg(F.sum("_c").alias("_s"))
    along = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    spans = spans.withColumn("_ahead", F.sum("_s").over(along.orderBy("_span").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_s")).withColumn("n", F.sum("_s").over(along)).drop("_s")
    inside = F.sum("_c").over(Window.partitionBy(*keys, "_span").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    placed = _met(counted.withColumn("_inside", inside), spans, *keys, "_span").withColumn("_upto", F.col("_ahead") + F.col("_inside"))
    return placed.groupBy(*keys).agg(*(F.min(F.when(F.col("_upto") >= rank, F.col("_v"))).alias(name) for name, rank in ranks.items()))


def nearest(thousandths: int) -> Column:
    """The rank ceil(p n), 1 at least: of one of the values, never between two."""
    return F.greatest(F.expr(f"(n * {thousandths} + 999) div 1000"), F.lit(1))


def _met(base: DataFrame, more: DataFrame, *keys: str) -> DataFrame:
    if not keys:
        return base.join(more, F.lit(True), "left")
    renamed = more.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), *(c for c in more.columns if c not in keys))
    on = F.lit(True)
    for i, k in enumerate(keys):
        on &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return base.join(renamed, on, "left").drop(*(f"_k{i}" for i in range(len(keys))))


def exact_summary(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """Count, total, whole average, extremes and nearest-rank percentiles of a long column."""
    ranks = {"p50": 500, "p90": 900, "p95": 950, "p99": 990, "p999": 999}
    total = F.coalesce(F.sum(value), F.lit(0)).cast("long")
    n = F.count(value)
    base = rows.groupBy(*keys).agg(n.alias("n"), total.alias("total"), F.when(n > 0, F.floor(total / n)).otherwise(0).cast("long").alias("average"), F.coalesce(F.min(value), F.lit(0)).alias("least"), F.coalesce(F.max(value), F.lit(0)).alias("most"))
    found = _met(base, at_ranks(rows, value, {c: nearest(p) for c, p in ranks.items()}, *keys), *keys)
    return found.select(*keys, "n", "total", "average", "least", "most", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ranks))


def spread_summary(rows: DataFrame, value: str, *keys: str, warn_at: float = 10.0, digits: int = 6) -> DataFrame:
    """Median, P10, P90, extremes and population coefficient of variation in percent, and whether it reaches ``warn_at``.

    Quantiles lie at p (n - 1), between two values where that falls between.
    """
    cv = F.coalesce(F.try_divide(F.stddev_pop(value) * 100, F.avg(value)), F.lit(0.0))
    base = rows.groupBy(*keys).agg(F.count(value).alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), cv.alias("cv"))
    tenths = {"median": 5, "p10": 1, "p90": 9}
    ranks = {f"_{side}{c}": F.expr(f"(n - 1) * {t} div 10 + {extra}") for c, t in tenths.items() for side, extra in (("a", 1), ("b", 2))}
    ranks = {c: F.least(rank, F.col("n")) for c, rank in ranks.items()}
    found = _met(base, at_ranks(rows, value, ranks, *keys), *keys)
    between = {c: F.col(f"_a{c}") + (F.col(f"_b{c}") - F.col(f"_a{c}")) * (F.expr(f"(n - 1) * {t} % 10") / 10) for c, t in tenths.items()}
    out = found.select(*keys, "n", *(F.round(q, digits).alias(c) for c, q in between.items()), "least", "most", F.round("cv", digits).alias("cv"))
    return out.withColumn("warn", F.col("cv") >= warn_at)


def bucket(value: Column, bounds: tuple[int, ...]) -> Column:
    """The number of the bucket of a value; bounds are exclusive and need not be even."""
    return reduce(lambda n, b: n + (value >= b).cast("int"), bounds, F.lit(0))


def histogram(rows: DataFrame, value: str, bounds: tuple[int, ...], *keys: str) -> DataFrame:
    """Counts and totals by bucket; histograms of parts add up."""
    return rows.where(F.col(value).isNotNull()).groupBy(*keys, bucket(F.col(value), bounds).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))


def histogram_quantile(counts: DataFrame, bounds: tuple[int, ...], p: float, rule: str, *keys: str) -> DataFrame:
    """The upper bound of the bucket in which the count reaches ceil(p n) or floor(p n), at least 1; 0 for the open bucket.

    Both rules exist side by side; ``rule`` is 'ceil' or 'floor'.
    """
    n = F.sum("n").over(Window.partitionBy(*keys))
    target = F.greatest((F.ceil(n * p) if rule == "ceil" else F.floor(n * p)).cast("long"), F.lit(1))
    upto = F.sum("n").over(Window.partitionBy(*keys).orderBy("bucket"))
    reached = counts.withColumn("_target", target).withColumn("_upto", upto).where(F.col("_upto") >= F.col("_target"))
    at = reached.groupBy(*keys).agg(F.min("bucket").alias("_at"))
    return at.select(*keys, F.coalesce(F.get(F.array(*map(F.lit, bounds)), "_at"), F.lit(0)).cast("long").alias("bound"))


def throughput(log: DataFrame, digits: int = 6) -> DataFrame:
    """Records and bytes a second of each partition over its span of time."""
    found = log.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("encoded_bytes").alias("bytes"), (F.max("ts_ms") - F.min("ts_ms")).alias("span_ms"))
    return found.select("part", "n", "bytes", "span_ms", F.round(rate(F.col("n"), F.col("span_ms")), digits).alias("records_s"), F.round(rate(F.col("bytes"), F.col("span_ms")), digits).alias("bytes_s"))


def backlog(samples: DataFrame, *keys: str, digits: int = 9) -> DataFrame:
    """How a backlog went over samples (``elapsed_ms``, ``offered``, ``acked``): start, end, most, slope, and reasons against a run.

    The slope is from the first to the last sample, per second; a run whose backlog
    grows, or of one moment, is not valid.
    """
    seen = samples.withColumn("backlog", F.greatest(F.col("offered") - F.col("acked"), F.lit(0)))
    found = seen.groupBy(*keys).agg(F.min_by("backlog", "elapsed_ms").alias("backlog_start"), F.max_by("backlog", "elapsed_ms").alias("backlog_end"), F.max("backlog").alias("backlog_most"), (F.max("elapsed_ms") - F.min("elapsed_ms")).alias("span_ms"))
    slope = rate(F.col("backlog_end") - F.col("backlog_start"), F.col("span_ms"))
    reasons = F.array_join(F.filter(F.array(F.when(F.col("span_ms") <= 0, F.lit("no time")), F.when(slope > 0, F.lit("backlog grows"))), lambda r: r.isNotNull()), ",")
    return found.withColumn("slope", F.round(slope, digits)).withColumn("reasons", reasons).withColumn("valid", F.col("reasons") == "")


def run_analysis(reports: DataFrame) -> DataFrame:
    """Run reports with their rates, drain and verification, and every reason against them; ``valid`` if there is none.

    ``reports``: ``measurement_ns``, ``offered``, ``acknowledged``, ``acknowledged_bytes``,
    ``completed``, ``failure``, ``warmup_ns``, ``warmup_elapsed_ns``, ``samples`` (``elapsed_ns``,
    ``offered``, ``acknowledged``), ``samples_dropped``, ``oracles`` (their number), ``phases``
    (``name``, ``duration_ns``), ``compaction`` (``interval_ns``, ``completed``,
    ``pending_files``, ``pending_bytes``, ``truncated``, ``error``, ``timed``); nulls are
    what a report leaves out.
    """
    s, c = F.col("samples"), F.col("compaction")
    at = lambda x: F.greatest(x["offered"] - x["acknowledged"], F.lit(0))
    first, last = F.get(s, 0), F.get(s, F.size(s) - 1)
    span = last["elapsed_ns"] - first["elapsed_ns"]
    phase = lambda n: F.coalesce(F.get(F.filter("phases", lambda p: p["name"] == n), 0)["duration_ns"], F.lit(0))
    per_s = lambda x: F.try_divide(F.col(x) * 1e9, F.col("measurement_ns"))
    seen = reports.withColumns({
        "offered_s": per_s("offered"), "acknowledged_s": per_s("acknowledged"), "acknowledged_bytes_s": per_s("acknowledged_bytes"), "drain_ns": phase("drain"), "verify_ns": phase("verify"),
        "backlog_start": F.coalesce(at(first), F.lit(0)), "backlog_end": F.coalesce(at(last), F.lit(0)), "backlog_most": F.coalesce(F.array_max(F.transform(s, at)), F.lit(0)),
        "slope": F.when(span > 0, (at(last) - at(first)) * 1e9 / span).otherwise(0.0),
    })
    compacting = c["interval_ns"] > 0
    rules = {
        "did not complete": ~F.coalesce("completed", F.lit(True)),
        "warm-up is missing": (F.col("warmup_ns") > 0) & F.col("warmup_elapsed_ns").isNull(),
        "warm-up was short": F.col("warmup_elapsed_ns") < F.col("warmup_ns"),
        "samples were dropped": F.col("samples_dropped") != 0,
        "backlog grows": F.col("slope") > 0,
        "oracles are missing": F.coalesce("oracles", F.lit(0)) == 0,
        "no compaction completed": compacting & (c["completed"] == 0),
        "cleanup debt": compacting & ((c["pending_files"] != 0) | (c["pending_bytes"] != 0) | c["truncated"] | c["error"]),
        "compaction was not timed": compacting & (F.coalesce(c["timed"], F.lit(0)) < c["completed"]),
    }
    reasons = F.filter(F.array(*(F.when(bad, F.lit(name)) for name, bad in rules.items())), lambda r: r.isNotNull())
    return seen.withColumn("reasons", reasons).withColumn("valid", F.size("reasons") == 0)


def merged_samples(*parts: DataFrame) -> DataFrame:
    """Samples of several runs together, each as often as it comes."""
    return reduce(DataFrame.unionByName, parts)


def bucket_counts(counts: DataFrame, bounds: tuple[int, ...], *keys: str) -> DataFrame:
    """A histogram's counts as one array a key, a place for each bucket, empty ones too."""
    at = F.map_from_entries(F.collect_list(F.struct("bucket", "n")))
    places = F.sequence(F.lit(0), F.lit(len(bounds)))
    return counts.groupBy(*keys).agg(at.alias("_m")).select(*keys, F.transform(places, lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0).cast("long"))).alias("counts"))


def lag_samples(samples: DataFrame, *keys: str) -> DataFrame:
    """Count, sum and most of ``lag``, for each key and, with null keys, for all."""
    found = samples.rollup(*keys).agg(F.count("lag").alias("n"), F.sum("lag").alias("total"), F.max("lag").alias("most"), F.grouping_id().alias("_level"))
    return found.where(F.col("_level").isin(0, (1 << len(keys)) - 1)).drop("_level")


def outcomes(rows: DataFrame, kind: str, kinds: list[str], *keys: str) -> DataFrame:
    """A column of counts for each kind of outcome."""
    return rows.groupBy(*keys).agg(*(F.count_if(F.col(kind) == k).alias(f"n_{k}") for k in kinds))


def partition_report(log: DataFrame, records: int) -> DataFrame:
    """Per partition: records, bytes, batches of ``records``, whole average batch, whole average and greatest lag to the end."""
    ended = log.join(log.groupBy("part").agg((F.max("off") + 1).alias("high")), "part").withColumn("lag", F.col("high") - F.col("off") - 1)
    n = F.count(F.lit(1))
    batches = F.count_distinct(F.floor(F.col("off") / records))
    return ended.groupBy("part").agg(n.alias("n"), F.sum("encoded_bytes").alias("bytes"), batches.alias("batches"), F.floor(n / batches).cast("long").alias("batch_average"), F.floor(F.sum("lag") / n).cast("long").alias("lag_average"), F.max("lag").alias("lag_most"))


def matched_latency(offers: DataFrame, acks: DataFrame, deliveries: DataFrame) -> DataFrame:
    """Offer to acknowledgement and to delivery, by key (``k``, ``ms``): distances in milliseconds, null where one is missing."""
    joined = offers.withColumnRenamed("ms", "offer_ms").join(acks.withColumnRenamed("ms", "ack_ms"), "k", "left").join(deliveries.withColumnRenamed("ms", "delivery_ms"), "k", "left")
    return joined.select("k", (F.col("ack_ms") - F.col("offer_ms")).alias("ack_latency"), (F.col("delivery_ms") - F.col("offer_ms")).alias("delivery_latency"))


def digest(log: DataFrame, fan: int = 256) -> DataFrame:
    """A digest of each partition's records in order, as a tree of SHA-256.

    Leaves hash ``fan`` records each (key, NUL, value, NUL), a second level ``fan``
    leaves, and the root those; so no task gathers more than a two-hundredth of a
    percent of a partition's bytes.
    """

    def joined(what: Column, at: str) -> Column:
        rows = F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), what.alias("x"))))
        return F.sha2(F.array_join(F.transform(rows, lambda r: r["x"]), ""), 256)

    nul = F.char(F.lit(0))
    text = F.concat(F.coalesce(F.col("key").cast("string"), F.lit("")), nul, F.coalesce(F.col("value").cast("string"), F.lit("")), nul)
    leaves = log.groupBy("part", F.floor(F.col("off") / fan).alias("leaf")).agg(joined(text, "off").alias("h"))
    upper = leaves.groupBy("part", F.floor(F.col("leaf") / fan).alias("node")).agg(joined(F.col("h"), "leaf").alias("h"))
    return upper.groupBy("part").agg(joined(F.col("h"), "node").alias("digest"))


def ordered_digest(log: DataFrame) -> DataFrame:
    """SHA-256 over key, NUL, value, NUL of each partition's records in order, as one stream: ``part``, ``digest``.

    The hash of a stream cannot be cut, so a partition is one task that holds an Arrow
    batch; :func:`digest` is the form for large ones.
    """
    kind = log.schema["part"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, running = None, None
        for b in batches:
            for p, k, v in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if running is None or p != part:
                    if running is not None:
                        yield pa.RecordBatch.from_pydict({"part": pa.array([part], b.column(0).type), "digest": [running.hexdigest()]})
                    part, running, typed = p, hashlib.sha256(), b.column(0).type
                running.update((k or b"") + b"\0" + (v or b"") + b"\0")
        if running is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], typed), "digest": [running.hexdigest()]})

    rows = log.select("part", F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"), "off").repartition("part").sortWithinPartitions("part", "off")
    return rows.drop("off").mapInArrow(run, f"part {kind}, digest string")


def prefix_digest(log: DataFrame, upto: int, store_id: str, topic_id: str) -> DataFrame:
    """The digest of each partition's records below ``upto``, bound to a store, topic, partition and end."""
    own = digest(log.where(F.col("off") < upto))
    said = F.concat_ws("/", F.lit(store_id), F.lit(topic_id), F.col("part").cast("string"), F.lit(str(upto)), F.col("digest"))
    return own.select("part", F.sha2(said, 256).alias("digest"))
