"""The queries over the driver's tables, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import distance, millis, valid_topic_name
from ..functions.schema import BY_SIZE, BY_TIME, RECORD, SEGMENT_HEADER
from ..functions.workspace import work_path
from ..operators import capacity, consumer, history, integrity, metrics, packing, replay, retention, scan
from ..sources import binary, workloads
from ..sources.files import Files
from ..sources.views import PARTS, catalog_parts, commits, log_events, log_turns, table
from ..streaming import offsets

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


# Parameters that the SQL of plans/oracle.py repeats.
PACK_RECORDS, PACK_BYTES, ROLL_BYTES, STRIDE = 64, 4000, 20_000, 12_000
SEGMENT_RECORDS, RETAIN_BYTES = 256, 30_000
LATENCY = "cast(floor(amount * 1000000) as bigint)"
BOUNDS = (1_000_000, 5_000_000, 20_000_000, 50_000_000, 100_000_000, 300_000_000)
KINDS = ["click", "purchase", "view", "signup", "error"]


def _batches(log: DataFrame) -> DataFrame:
    """Batches of 64 records."""
    return log.withColumn("batch_base", F.col("off") - F.col("off") % PACK_RECORDS)


def _segments(log: DataFrame) -> DataFrame:
    return log.groupBy("part", (F.col("off") - F.col("off") % SEGMENT_RECORDS).alias("segment_base")).agg((F.max("off") + 1).alias("end"), F.count(F.lit(1)).alias("n"), (F.sum("encoded_bytes") + SEGMENT_HEADER).alias("bytes"), F.max("ts_ms").alias("max_ts"))


@query
def fetch_bounded(spark: SparkSession, sf: str) -> DataFrame:
    return scan.fetch(log_events(spark, sf), 1, 10, 50, 1500).select("off", "ts_ms", "key", "value", "encoded_bytes", "next_offset")


@query
def read_range(spark: SparkSession, sf: str) -> DataFrame:
    return scan.read_range(log_events(spark, sf), 100, 50).select("part", "off", "ts_ms", "key", "value")


@query
def log_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return scan.bounds(log_events(spark, sf), catalog_parts(spark, PARTS + 1))


@query
def large_value_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return scan.bounds(log_turns(spark, sf), catalog_parts(spark))


@query
def offset_assignment(spark: SparkSession, sf: str) -> DataFrame:
    return log_events(spark, sf).select("event_id", "part", "off")


@query
def fetch_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Every fetch of a reader of 1,024 records a time, over all partitions."""
    folder = work_path(spark, "pages")
    log_events(spark, sf).select("part", "off", "encoded_bytes").write.parquet(folder)
    return scan.fetches(spark.read.schema("part int, off long, encoded_bytes long").parquet(folder), 1024)


@query
def start_positions(spark: SparkSession, sf: str) -> DataFrame:
    return scan.start_positions(scan.bounds(log_events(spark, sf), catalog_parts(spark, PARTS + 1)), 100)


@query
def key_first_match(spark: SparkSession, sf: str) -> DataFrame:
    return scan.first_by_key(log_events(spark, sf))


@query
def encoded_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return log_events(spark, sf).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("encoded_bytes").alias("bytes"), F.min("encoded_bytes").alias("least"), F.max("encoded_bytes").alias("most"))


@query
def gap_report(spark: SparkSession, sf: str) -> DataFrame:
    return integrity.gaps(log_events(spark, sf, F.col("event_id") % 97 != 0))


@query
def duplicate_keys(spark: SparkSession, sf: str) -> DataFrame:
    return integrity.duplicates(log_events(spark, sf), "part", "value")


@query
def topic_name_check(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "part").select(F.col("p_name").alias("name")).unionByName(table(spark, sf, "customer").select(F.col("c_name").alias("name"))).distinct()
    return names.withColumn("valid", valid_topic_name(F.col("name")))


@query
def prefix_max_timestamp(spark: SparkSession, sf: str) -> DataFrame:
    return integrity.prefix_max(log_events(spark, sf)).select("part", "off", "prefix_max")


@query
def time_regressions(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as a log by key: rows older than one before them."""
    orders = table(spark, sf, "orders").select((F.col("o_custkey") % PARTS).cast("int").alias("part"), F.col("o_orderkey").alias("off"), millis(F.col("o_orderdate")).alias("ts_ms"))
    return integrity.prefix_max(orders).where("ts_ms < prefix_max").select("part", F.col("off").alias("o_orderkey"), "ts_ms", "prefix_max")


@query
def batch_stats(spark: SparkSession, sf: str) -> DataFrame:
    return packing.batch_stats(_batches(log_events(spark, sf)))


@query
def index_asof_seek(spark: SparkSession, sf: str) -> DataFrame:
    """Every offset against an index of every fourth batch."""
    folder = work_path(spark, "numbered")
    log_events(spark, sf).select("part", "off", "encoded_bytes", "ts_ms").write.parquet(folder)  # numbered once
    log = spark.read.schema("part int, off long, encoded_bytes long, ts_ms long").parquet(folder)
    stats = packing.batch_stats(_batches(log))
    along = Window.partitionBy("part").orderBy("batch_base").rowsBetween(Window.unboundedPreceding, -1)
    index = stats.withColumn("position", F.coalesce(F.sum("bytes").over(along), F.lit(0)) + SEGMENT_HEADER).where(f"batch_base % {4 * PACK_RECORDS} = 0").select("part", F.col("batch_base").alias("base"), "position")
    return scan.seek(log.select("part", "off"), index)


@query
def batch_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.batch_stats(packing.pack_batches(log_events(spark, sf), PACK_RECORDS, PACK_BYTES))


@query
def segment_rolling(spark: SparkSession, sf: str) -> DataFrame:
    batches = packing.batch_stats(packing.pack_batches(log_events(spark, sf), PACK_RECORDS, PACK_BYTES))
    return packing.segment_stats(packing.roll_segments(batches, ROLL_BYTES))


@query
def index_sampling(spark: SparkSession, sf: str) -> DataFrame:
    batches = packing.batch_stats(packing.pack_batches(log_events(spark, sf), PACK_RECORDS, PACK_BYTES))
    return packing.sample_index(batches, STRIDE).where("sampled").select("part", "batch_base", "position")


@query
def catalog_crossref(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as a catalog, orders as its storage; either lacks some."""
    catalog = table(spark, sf, "customer").where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("entry"))
    storage = table(spark, sf, "orders").where("o_custkey % 7 <> 0").select(F.col("o_custkey").alias("entry"))
    return integrity.only_in(catalog, storage, ["entry"])


@query
def retired_inventory_check(spark: SparkSession, sf: str) -> DataFrame:
    """Segments of the log against those of a copy that lost rows."""
    want, have = _segments(log_events(spark, sf)), _segments(log_events(spark, sf, (F.col("event_id") % 500 != 0) & ~((F.col("part") == 2) & (F.col("off") < SEGMENT_RECORDS))))
    return integrity.compare(want, have, ["part", "segment_base"], ["bytes", "end", "max_ts", "n"])


@query
def index_validation(spark: SparkSession, sf: str) -> DataFrame:
    """Index entries of batches, of which every fifth is off by one record, against the batches."""
    batches = packing.batch_stats(_batches(log_events(spark, sf))).select("part", "batch_base", "n", "max_ts")
    entries = batches.where("batch_base % 128 = 0").withColumn("n", F.col("n") + (F.col("batch_base") % 640 == 0).cast("int"))
    return integrity.compare(entries, batches.join(entries.select("part", "batch_base"), ["part", "batch_base"], "left_semi"), ["part", "batch_base"], ["max_ts", "n"])


@query
def progress_latest(spark: SparkSession, sf: str) -> DataFrame:
    return replay.latest(commits(log_events(spark, sf)), ["group_id", "part"], "next", "seq")


@query
def commit_chain_check(spark: SparkSession, sf: str) -> DataFrame:
    """Commits that know the one before, of which every eleventh is lost."""
    done = commits(log_events(spark, sf))
    expected = F.lag("next").over(Window.partitionBy("group_id", "part").orderBy("seq"))
    broken = done.withColumn("expected", expected).where("seq % 11 <> 0")
    return integrity.chain(broken, ["group_id", "part"], "seq", "next", "expected").select("group_id", "part", "seq", "next", "expected", "found")


@query
def generation_chain_check(spark: SparkSession, sf: str) -> DataFrame:
    """A customer's orders as generations, some of them lost."""
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("group_id"), "o_orderkey")
    numbered = orders.withColumn("generation", F.row_number().over(Window.partitionBy("group_id").orderBy("o_orderkey")).cast("long"))
    kept = numbered.where("o_orderkey % 7 <> 0").withColumn("expected", F.col("generation") - 1)
    return integrity.chain(kept, ["group_id"], "generation", "generation", "expected").select("group_id", "generation", "found")


@query
def consumer_lag(spark: SparkSession, sf: str) -> DataFrame:
    log = log_events(spark, sf)
    done = log.groupBy(F.col("key").alias("group_id"), "part").agg((F.max("off") + 1).alias("delivered"), (F.max(F.when(F.col("event_id") % 3 == 0, F.col("off"))) + 1).alias("committed"))
    return consumer.lag(done.where("committed is not null"), scan.bounds(log, catalog_parts(spark)))


@query
def group_assignments(spark: SparkSession, sf: str) -> DataFrame:
    members = table(spark, sf, "region").select(F.col("r_name").alias("member"))
    parts = table(spark, sf, "nation").select(F.col("n_nationkey").cast("int").alias("part"))
    dealt = consumer.assign(members, parts)
    return dealt.groupBy("member").agg(F.array_join(F.array_sort(F.collect_list("part")).cast("array<string>"), ",").alias("parts"), F.count(F.lit(1)).alias("n"))


@query
def catalog_temporal_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as events of a revision that name a nation as topic, created at twice its key."""
    events = table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 27).cast("int").alias("topic"), (F.col("o_orderkey") % 60).alias("catalog_next"))
    topics = table(spark, sf, "nation").select(F.col("n_nationkey").alias("topic"), (F.col("n_nationkey").cast("long") * 2).alias("creation"))
    return replay.revision_check(events, topics).select("o_orderkey", "topic", "catalog_next", "creation")


@query
def projection_usage(spark: SparkSession, sf: str) -> DataFrame:
    done = commits(log_events(spark, sf))
    starts = table(spark, sf, "region").select(F.concat(F.lit("start-"), F.col("r_name")).alias("group_id"), F.col("r_regionkey").cast("int").alias("part"))
    return replay.usage(done, starts)


def _planned(spark: SparkSession, sf: str, mask: int) -> DataFrame:
    segments = _segments(log_events(spark, sf))
    # The log's own clock: now is its newest record, and the first half of its time may go.
    ends = segments.groupBy().agg(F.max("max_ts").alias("now"), F.min("max_ts").alias("first"))
    segments = segments.join(F.broadcast(ends), F.lit(True)).withColumn("age", F.floor((F.col("now") - F.col("first")) / 2))
    shifted = segments.withColumn("max_ts", F.col("max_ts") + F.col("age"))
    return retention.plan(shifted, F.col("now"), mask, 0, RETAIN_BYTES)


@query
def retention_plan_time(spark: SparkSession, sf: str) -> DataFrame:
    return retention.summary(_planned(spark, sf, BY_TIME))


@query
def retention_plan_size(spark: SparkSession, sf: str) -> DataFrame:
    return retention.summary(_planned(spark, sf, BY_SIZE))


@query
def retention_plan_both(spark: SparkSession, sf: str) -> DataFrame:
    return retention.summary(_planned(spark, sf, BY_TIME | BY_SIZE))


@query
def cleanup_debt(spark: SparkSession, sf: str) -> DataFrame:
    return retention.cleanup_debt(_planned(spark, sf, BY_TIME).where("retired"))


@query
def latency_summary(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.exact_summary(log_events(spark, sf).withColumn("latency", F.expr(LATENCY)), "latency", "key")


@query
def benchmark_summary(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.spread_summary(table(spark, sf, "orders"), "o_totalprice", "o_orderpriority")


def _histogram(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.histogram(log_events(spark, sf).withColumn("latency", F.expr(LATENCY)), "latency", BOUNDS, "key")


@query
def latency_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return _histogram(spark, sf)


@query
def histogram_quantiles_ceil(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.histogram_quantile(_histogram(spark, sf), BOUNDS, 0.95, "ceil", "key")


@query
def histogram_quantiles_floor(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.histogram_quantile(_histogram(spark, sf), BOUNDS, 0.5, "floor", "key")


@query
def throughput_rate(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.throughput(log_events(spark, sf))


@query
def backlog_analysis(spark: SparkSession, sf: str) -> DataFrame:
    """A sample a batch: offered what the log has, acknowledged what is committed by then."""
    log = _batches(log_events(spark, sf))
    batches = log.groupBy("part", "batch_base").agg(F.max("ts_ms").alias("elapsed_ms"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_id") % 3 != 1).alias("done"))
    along = Window.partitionBy("part").orderBy("batch_base").rowsBetween(Window.unboundedPreceding, 0)
    samples = batches.select("part", "elapsed_ms", F.sum("n").over(along).alias("offered"), F.sum("done").over(along).alias("acked"))
    return metrics.backlog(samples, "part")


@query
def outcome_counters(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.outcomes(log_events(spark, sf), "key", KINDS, "part")


@query
def partition_report(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.partition_report(log_events(spark, sf), PACK_RECORDS)


@query
def delivery_latency(spark: SparkSession, sf: str) -> DataFrame:
    """Three events in a row are offer, acknowledgement and delivery of one key."""
    seen = table(spark, sf, "events").select("event_id", F.floor(F.col("event_id") / 3).alias("k"), millis(F.col("ts")).alias("ms"))
    each = [seen.where(F.col("event_id") % 3 == i).select("k", "ms") for i in range(3)]
    return metrics.matched_latency(*each)


@query
def partition_digest(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.digest(log_events(spark, sf))


@query
def expired_distance(spark: SparkSession, sf: str) -> DataFrame:
    """What retention takes from groups that are behind: the new start against their last commit."""
    starts = retention.summary(_planned(spark, sf, BY_TIME)).select("part", "new_low")
    progress = replay.latest(commits(log_events(spark, sf)).where("seq % 2 = 0"), ["group_id", "part"], "next", "seq")
    return progress.join(starts, "part").select("group_id", "part", "next", "new_low", distance(F.col("new_low"), F.col("next")).alias("skipped"))


@query
def partition_stats(spark: SparkSession, sf: str) -> DataFrame:
    return capacity.partition_stats(log_events(spark, sf), catalog_parts(spark, PARTS + 1), SEGMENT_RECORDS)


@query
def store_stats(spark: SparkSession, sf: str) -> DataFrame:
    return capacity.store_stats(capacity.partition_stats(log_events(spark, sf), catalog_parts(spark, PARTS + 1), SEGMENT_RECORDS))


@query
def disk_pressure(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of a clerk as samples of free space."""
    samples = table(spark, sf, "orders").select((F.col("o_custkey") % PARTS).cast("int").alias("part"), F.col("o_orderkey").alias("at"), F.floor("o_totalprice").cast("long").alias("free"))
    return capacity.pressure(samples, 30_000, 350_000)


@query
def workload_keys(spark: SparkSession, sf: str) -> DataFrame:
    made = workloads.soak(spark, 2000, 7, 0x5EED, 3).withColumn("k", workloads.soak_key(F.col("key")))
    size = F.octet_length("value")
    kind = F.when(size.isNull(), "null").when(size == 0, "empty").when(size == workloads.LARGE, "large").when(size.between(workloads.SMALL, workloads.SMALL + 127), "small")
    return made.select("part", "key", "k.producer", "k.sequence", kind.alias("size"))


@query
def sequence_check(spark: SparkSession, sf: str) -> DataFrame:
    """A user's events as a producer's sequence, some out of place: steps that do not rise."""
    events = table(spark, sf, "events").select("user_id", "event_id", (F.col("event_id") - F.when(F.col("event_id") % 13 == 0, 60).otherwise(0)).alias("sequence"))
    return integrity.previous(events, ["user_id"], "event_id", "sequence").where("sequence <= before")


@query
def group_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """Nations' customers as members of groups that subscribe to market segments; some have a key twice or share one."""
    customers = table(spark, sf, "customer").where("c_custkey % 4 = 0 or c_nationkey < 12")
    rows = customers.select(F.col("c_nationkey").alias("group_id"), (F.col("c_custkey") % 5).cast("int").alias("member"), F.col("c_mktsegment").alias("topic_id"), F.when(F.col("c_nationkey") % 3 == 0, F.col("c_custkey")).otherwise(F.col("c_custkey") % 200).cast("int").alias("part"))
    found = consumer.snapshots(rows)
    text = F.array_join(F.transform("members", lambda m: F.array_join(F.transform(m, lambda k: F.concat_ws(":", k["topic_id"], F.lpad(k["part"].cast("string"), 9, "0"))), ",")), ";")
    return found.select("group_id", "n_members", "keys", "problem", F.sha2(text, 256).alias("canonical"))


@query
def retention_applied(spark: SparkSession, sf: str) -> DataFrame:
    """What readers of the log find once the planned starts hold: bounds, records and the first of them."""
    starts = retention.summary(_planned(spark, sf, BY_TIME | BY_SIZE)).select("part", "new_low", "reason_mask")
    log = log_events(spark, sf).join(F.broadcast(starts), "part")  # a row a partition
    kept = log.groupBy("part", "new_low", "reason_mask").agg((F.max("off") + 1).alias("high"), F.count_if(F.col("off") >= F.col("new_low")).alias("n"), F.min(F.when(F.col("off") >= F.col("new_low"), F.col("off"))).alias("first_off"), F.count_if(F.col("off") < F.col("new_low")).alias("refused"))
    return kept.select("part", F.col("new_low").alias("low"), "high", "n", "first_off", "refused", "reason_mask")


def _history(spark: SparkSession, sf: str) -> DataFrame:
    """Events of groups over the log: each is created, assigned all partitions, and commits; every eleventh commit is lost, every 17th is another's."""
    log = log_events(spark, sf)
    done = integrity.previous(commits(log), ["group_id", "part"], "seq", "next")
    names = done.select("group_id").distinct()
    commit = done.where("seq % 11 <> 0").select(
        (F.col("seq") + 10).alias("offset"), F.lit(5).alias("event_type"), "group_id", F.lit("i").alias("instance"), F.when(F.col("seq") % 17 == 0, "other").otherwise("s").alias("session"), F.lit(1).cast("long").alias("generation"),
        F.lit("t").alias("topic_id"), "part", F.col("before").isNotNull().cast("int").alias("previous_kind"), F.coalesce("before", F.lit(0)).cast("long").alias("expected_previous"), "next",
    )
    given = F.array(*(F.struct(F.lit("t").alias("topic_id"), F.lit(p).alias("part"), F.lit("s").alias("owner"), F.lit(0).cast("long").alias("resume"), F.lit(1).alias("baseline"), F.lit(0).cast("long").alias("initial")) for p in range(PARTS)))
    keys = F.array(*(F.struct(F.lit("t").alias("topic_id"), F.lit(p).alias("part")) for p in range(PARTS)))
    assigned = names.select(F.lit(5).cast("long").alias("offset"), F.lit(4).alias("event_type"), "group_id", F.lit("i").alias("instance"), F.lit(0).cast("long").alias("expected_generation"), F.lit(1).cast("long").alias("new_generation"), F.lit(1).alias("reason"), F.array(F.struct(F.lit("s").alias("session"), keys.alias("keys"))).alias("members"), given.alias("assignments"))
    created = names.select(F.lit(0).cast("long").alias("offset"), F.lit(3).alias("event_type"), "group_id", F.lit(1).alias("start_mode"), F.array().cast("array<struct<topic_id:string,part:int,next:bigint>>").alias("starts"))
    return commit.unionByName(assigned, True).unionByName(created, True)


@query
def history_validation(spark: SparkSession, sf: str) -> DataFrame:
    events = _history(spark, sf)
    return history.offsets_shape(events).unionByName(history.offsets_chains(events))


@query
def assignment_validation(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as saved assignments, against nations as topics, some members and some progress."""
    orders = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("group_id"), (F.col("o_custkey") % 27).cast("int").alias("topic_id"), F.col("o_orderkey").cast("long").alias("part"), (F.col("o_custkey") % 7).cast("int").alias("owner"), (F.col("o_orderkey") % 50).cast("long").alias("resume"), "o_orderkey")
    topics = table(spark, sf, "nation").select(F.col("n_nationkey").cast("int").alias("topic_id"), (F.col("n_regionkey") * 10_000 + 20_000).cast("long").alias("n_partitions"))
    members = orders.where("owner <> 3").select("group_id", F.col("owner").alias("session"))
    progress = orders.where("o_orderkey % 13 <> 0").select("group_id", "topic_id", "part", F.when(F.col("o_orderkey") % 19 == 0, F.col("resume") - 1).otherwise(F.col("resume") + 5).alias("next"))
    return history.assignment_problems(orders.drop("o_orderkey"), members, topics, progress)


@query
def monotone_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as samples of a partition's bounds, some of which go back."""
    at = F.col("o_orderkey")
    samples = table(spark, sf, "orders").select((F.col("o_custkey") % PARTS).cast("int").alias("part"), at.alias("at"), (F.floor(at / 8) - F.when(at % 97 == 0, 50).otherwise(0)).alias("low"), (F.floor(at / 4) + F.when(at % 89 == 0, 500).otherwise(0) - F.when(at % 101 == 0, 2 * at).otherwise(0)).alias("high"))
    return history.monotone_bounds(samples, "part")


@query
def ordered_digest(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.ordered_digest(log_events(spark, sf))


@query
def prefix_digests(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.prefix_digest(log_events(spark, sf), 1000, "0" * 31 + "1", "0" * 31 + "9")


@query
def stream_offsets(spark: SparkSession, sf: str) -> DataFrame:
    folder = work_path(spark, "stream-offsets")
    events = table(spark, sf, "events")
    days = events.select(F.date_trunc("month", "ts").alias("_day")).distinct().withColumn("_batch", F.row_number().over(Window.orderBy("_day")))
    dealt = events.withColumn("_day", F.date_trunc("month", "ts")).join(F.broadcast(days), "_day").drop("_day")  # a row a month
    for row in days.select("_batch").orderBy("_batch").collect():  # files in order of time: a batch each
        dealt.where(F.col("_batch") == row["_batch"]).drop("_batch").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = offsets.lingering(spark, events.schema, 1).parquet(f"{folder}/in").withColumn("part", (F.col("user_id") % PARTS).cast("int"))
    offsets.assign_stream(stream, f"{folder}/out", f"{folder}/checkpoint", "part", ["ts", "event_id"], F.date_trunc("day", "ts").cast("timestamp_ntz"))
    return spark.read.parquet(f"{folder}/out/rows").select("event_id", "part", "off")


@query
def stream_bounds(spark: SparkSession, sf: str) -> DataFrame:
    folder = work_path(spark, "stream-bounds")
    log_events(spark, sf).select("part", "off", "encoded_bytes").write.parquet(f"{folder}/log")
    stream = spark.readStream.schema("part int, off long, encoded_bytes long").parquet(f"{folder}/log")
    offsets.bounds_stream(stream, f"{folder}/out", f"{folder}/checkpoint", "part")
    return offsets.last_state(spark, f"{folder}/out", "part")


@query
def binary_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """The log written as segment files by the data source's writer, and read back from them."""
    folder = work_path(spark, "segments")
    log = log_events(spark, sf)
    records = log.select(F.lit(f"{7:032x}").alias("topic_id"), F.col("part").alias("partition"), F.col("off").alias("offset"), F.col("ts_ms").alias("timestamp_ms"), F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"), F.array().cast(RECORD["headers"].dataType).alias("headers"))
    binary.write_segments(records, folder, batch_records=PACK_RECORDS, segment_bytes=ROLL_BYTES * 10)
    found = binary.read_segments(spark, folder)
    return found.select(F.col("partition").alias("part"), F.col("offset").alias("off"), F.col("timestamp_ms").alias("ts_ms"), F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


@query
def segment_preflight(spark: SparkSession, sf: str) -> DataFrame:
    """What a report finds in segment files of the log, of which one a partition has lost its last byte."""
    folder = work_path(spark, "segments")
    log = log_events(spark, sf)
    records = log.select(F.lit(f"{7:032x}").alias("topic_id"), F.col("part").alias("partition"), F.col("off").alias("offset"), F.col("ts_ms").alias("timestamp_ms"), F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"), F.array().cast(RECORD["headers"].dataType).alias("headers"))
    binary.write_segments(records, folder, batch_records=PACK_RECORDS, segment_bytes=1 << 40)
    files = Files(spark, folder)
    for place in files.names(""):
        for name in files.names(place):
            files.swap(f"{place}/{name}", files.read(f"{place}/{name}")[:-1])
    report = binary.preflight(spark, folder)
    return report.select(F.col("partition").alias("part"), "base", "end", "batches", "records", "kind")


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return consumer_lag(spark, sf)

