"""DuckDB SQL for the queries of the catalogue, over the same tables."""

from __future__ import annotations

from .catalogue import BOUNDS, KINDS, PACK_BYTES, PACK_RECORDS, RETAIN_BYTES, ROLL_BYTES, SEGMENT_RECORDS, STRIDE

LOG = """log AS (
    SELECT event_id, CAST(user_id % 4 AS INTEGER) AS part,
           row_number() OVER (PARTITION BY user_id % 4 ORDER BY ts, event_id) - 1 AS "off",
           epoch_us(ts) // 1000 AS ts_ms, event_type AS key, props AS value, value AS amount,
           CAST(36 + octet_length(encode(event_type)) + octet_length(encode(props)) AS BIGINT) AS encoded_bytes
    FROM events
)"""

PARTS_4 = "parts AS (SELECT CAST(range AS INTEGER) AS part FROM range(4))"
PARTS_5 = "parts AS (SELECT CAST(range AS INTEGER) AS part FROM range(5))"

ENDS = """ends AS (
    SELECT p.part, coalesce(min("off"), 0) AS low, coalesce(max("off") + 1, 0) AS high,
           count("off") AS n, CAST(coalesce(sum(encoded_bytes), 0) AS BIGINT) AS bytes
    FROM parts p LEFT JOIN log USING (part) GROUP BY p.part
)"""

BATCHES = f"""batches AS (
    SELECT part, "off" - "off" % {PACK_RECORDS} AS batch_base, max("off") + 1 AS "end", count(*) AS n,
           CAST(sum(encoded_bytes) + 52 AS BIGINT) AS bytes, max(ts_ms) AS max_ts
    FROM log GROUP BY ALL
)"""

COMMITS = """commits AS (
    SELECT key AS group_id, part, "off" + 1 AS next, event_id AS seq FROM log WHERE event_id % 3 = 0
)"""


def _segments(name: str, where: str = "true") -> str:
    return f"""{name} AS (
    SELECT part, "off" - "off" % {SEGMENT_RECORDS} AS segment_base, max("off") + 1 AS "end", count(*) AS n,
           CAST(sum(encoded_bytes) + 72 AS BIGINT) AS bytes, max(ts_ms) AS max_ts
    FROM log WHERE {where} GROUP BY ALL
)"""


def _planned(mask: int) -> str:
    time = "shifted <= now AND now - shifted >= 0" if mask & 1 else "false"
    size = f"total - before > {RETAIN_BYTES}" if mask & 2 else "false"
    return f"""{LOG}, {_segments("segments")}, clock AS (
    SELECT max(max_ts) AS now, (max(max_ts) - min(max_ts)) // 2 AS age FROM segments
), seen AS (
    SELECT s.*, max_ts + age AS shifted, now,
           coalesce(sum(bytes) OVER (PARTITION BY part ORDER BY segment_base ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
           sum(bytes) OVER (PARTITION BY part) AS total,
           row_number() OVER (PARTITION BY part ORDER BY segment_base) AS i, count(*) OVER (PARTITION BY part) AS m
    FROM segments s, clock
), judged AS (
    SELECT *, (CASE WHEN {time} THEN 1 ELSE 0 END) | (CASE WHEN {size} THEN 2 ELSE 0 END) AS reason FROM seen
), planned AS (
    SELECT *, min(CASE WHEN reason > 0 AND i < m THEN 1 ELSE 0 END) OVER (PARTITION BY part ORDER BY segment_base) = 1 AS retired FROM judged
)"""


def _retention(mask: int) -> str:
    return f"""WITH {_planned(mask)}
SELECT part, count(*) FILTER (retired) AS n_retired,
       coalesce(max("end") FILTER (retired), min(segment_base)) AS new_low,
       CAST(coalesce(sum(bytes) FILTER (NOT retired), 0) AS BIGINT) AS bytes_left,
       CAST(coalesce(bit_or(reason) FILTER (retired), 0) AS INTEGER) AS reason_mask
FROM planned GROUP BY part"""


_BUCKET = " + ".join(f"CAST(latency >= {b} AS INTEGER)" for b in BOUNDS)

HISTOGRAM = f"""{LOG}, hist AS (
    SELECT key, {_BUCKET} AS bucket, count(*) AS n, CAST(sum(latency) AS BIGINT) AS total
    FROM (SELECT key, CAST(floor(amount * 1000000) AS BIGINT) AS latency FROM log) GROUP BY ALL
)"""


def _quantile(p: float, rule: str) -> str:
    return f"""WITH {HISTOGRAM}, upto AS (
    SELECT *, sum(n) OVER (PARTITION BY key ORDER BY bucket) AS upto,
           greatest(1, CAST({rule}(sum(n) OVER (PARTITION BY key) * {p}) AS BIGINT)) AS target
    FROM hist
)
SELECT key, CAST(coalesce(list_extract({list(BOUNDS)}, min(bucket) + 1), 0) AS BIGINT) AS bound
FROM upto WHERE upto >= target GROUP BY key"""


PACKED = f"""{LOG}, packing AS (
    SELECT part, CAST(0 AS BIGINT) AS "off", CAST(0 AS BIGINT) AS batch_base, CAST(1 AS BIGINT) AS n, CAST(52 + encoded_bytes AS BIGINT) AS bytes
    FROM log WHERE "off" = 0
    UNION ALL
    SELECT l.part, l."off",
           CASE WHEN p.n = {PACK_RECORDS} OR p.bytes + l.encoded_bytes > {PACK_BYTES} THEN l."off" ELSE p.batch_base END,
           CASE WHEN p.n = {PACK_RECORDS} OR p.bytes + l.encoded_bytes > {PACK_BYTES} THEN 1 ELSE p.n + 1 END,
           CASE WHEN p.n = {PACK_RECORDS} OR p.bytes + l.encoded_bytes > {PACK_BYTES} THEN 52 + l.encoded_bytes ELSE p.bytes + l.encoded_bytes END
    FROM packing p JOIN log l ON l.part = p.part AND l."off" = p."off" + 1
), batches AS (
    SELECT part, batch_base, max("off") + 1 AS "end", count(*) AS n, CAST(sum(encoded_bytes) + 52 AS BIGINT) AS bytes, max(ts_ms) AS max_ts
    FROM packing JOIN (SELECT part, "off", encoded_bytes, ts_ms FROM log) USING (part, "off") GROUP BY ALL
), numbered AS (
    SELECT *, row_number() OVER (PARTITION BY part ORDER BY batch_base) AS i FROM batches
)"""

SQL = {
    "fetch_bounded": f"""WITH {LOG}, near AS (
    SELECT *, sum(encoded_bytes) OVER (ORDER BY "off") AS upto FROM log WHERE part = 1 AND "off" >= 10 AND "off" < 60
)
SELECT "off", ts_ms, key, value, encoded_bytes, max("off") OVER () + 1 AS next_offset FROM near WHERE upto <= 1500""",
    "read_range": f"""WITH {LOG} SELECT part, "off", ts_ms, key, value FROM log WHERE "off" BETWEEN 100 AND 149""",
    "log_bounds": f"""WITH {LOG}, {PARTS_5}, {ENDS} SELECT * FROM ends""",
    "large_value_bounds": f"""WITH log AS (
    SELECT CAST(conv_id % 4 AS INTEGER) AS part, row_number() OVER (PARTITION BY conv_id % 4 ORDER BY conv_id, turn) - 1 AS "off",
           36 + coalesce(octet_length(encode(role)), 0) + coalesce(octet_length(encode(text)), 0) AS encoded_bytes
    FROM conversations
), {PARTS_4}, {ENDS} SELECT * FROM ends""",
    "offset_assignment": f"""WITH {LOG} SELECT event_id, part, "off" FROM log""",
    "fetch_pages": f"""WITH {LOG} SELECT part, min("off") AS first_off, count(*) AS n, max("off") + 1 AS next_offset FROM log GROUP BY part, "off" // 1024""",
    "start_positions": f"""WITH {LOG}, {PARTS_5}, {ENDS}
SELECT part, low, high, mode,
       CASE mode WHEN 'earliest' THEN low WHEN 'latest' THEN high ELSE CASE WHEN 100 BETWEEN low AND high THEN 100 END END AS position
FROM ends, (VALUES ('earliest'), ('latest'), ('explicit')) m(mode)""",
    "key_first_match": f"""WITH {LOG} SELECT part, key, min("off") AS first_off FROM log GROUP BY ALL""",
    "encoded_sizes": f"""WITH {LOG} SELECT key, count(*) AS n, CAST(sum(encoded_bytes) AS BIGINT) AS bytes, min(encoded_bytes) AS least, max(encoded_bytes) AS most FROM log GROUP BY key""",
    "gap_report": f"""WITH {LOG}, seen AS (
    SELECT part, "off" - lag("off") OVER (PARTITION BY part ORDER BY "off") AS step FROM log WHERE event_id % 97 <> 0
)
SELECT part, count(*) AS gaps, CAST(sum(step - 1) AS BIGINT) AS missing FROM seen WHERE step > 1 GROUP BY part""",
    "duplicate_keys": f"""WITH {LOG} SELECT part, value, count(*) AS n FROM log GROUP BY ALL HAVING count(*) > 1""",
    "topic_name_check": """WITH names AS (SELECT p_name AS name FROM part UNION SELECT c_name FROM customer)
SELECT name, coalesce(regexp_full_match(name, '[A-Za-z0-9._-]{1,249}') AND name NOT IN ('.', '..') AND NOT starts_with(name, '__'), false) AS valid FROM names""",
    "prefix_max_timestamp": f"""WITH {LOG} SELECT part, "off", max(ts_ms) OVER (PARTITION BY part ORDER BY "off") AS prefix_max FROM log""",
    "time_regressions": """WITH seen AS (
    SELECT CAST(o_custkey % 4 AS INTEGER) AS part, o_orderkey, epoch_us(o_orderdate) // 1000 AS ts_ms FROM orders
), run AS (
    SELECT *, max(ts_ms) OVER (PARTITION BY part ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS prefix_max FROM seen
)
SELECT * FROM run WHERE ts_ms < prefix_max""",
    "batch_stats": f"""WITH {LOG}, {BATCHES} SELECT * FROM batches""",
    "index_asof_seek": f"""WITH {LOG}, {BATCHES}, placed AS (
    SELECT part, batch_base AS base,
           CAST(coalesce(sum(bytes) OVER (PARTITION BY part ORDER BY batch_base ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 72 AS BIGINT) AS position
    FROM batches
)
SELECT l.part, l."off", p.base, p.position
FROM (SELECT part, "off" FROM log) l
ASOF LEFT JOIN (SELECT * FROM placed WHERE base % {4 * PACK_RECORDS} = 0) p ON l.part = p.part AND l."off" >= p.base""",
    "batch_packing": f"""WITH RECURSIVE {PACKED} SELECT * FROM batches""",
    "segment_rolling": f"""WITH RECURSIVE {PACKED}, rolled AS (
    SELECT part, i, batch_base AS segment_base, CAST(72 + bytes AS BIGINT) AS size FROM numbered WHERE i = 1
    UNION ALL
    SELECT b.part, b.i, CASE WHEN r.size + b.bytes > {ROLL_BYTES} AND r.size > 72 THEN b.batch_base ELSE r.segment_base END,
           CASE WHEN r.size + b.bytes > {ROLL_BYTES} AND r.size > 72 THEN 72 + b.bytes ELSE r.size + b.bytes END
    FROM rolled r JOIN numbered b ON b.part = r.part AND b.i = r.i + 1
)
SELECT part, segment_base, max(b."end") AS "end", CAST(sum(b.n) AS BIGINT) AS n, CAST(sum(b.bytes) + 72 AS BIGINT) AS bytes, max(b.max_ts) AS max_ts
FROM rolled r JOIN numbered b USING (part, i) GROUP BY part, segment_base""",
    "index_sampling": f"""WITH RECURSIVE {PACKED}, placed AS (
    SELECT part, i, batch_base, CAST(72 + coalesce(sum(bytes) OVER (PARTITION BY part ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS position
    FROM numbered
), sampled AS (
    SELECT part, i, batch_base, position, position AS last, true AS taken FROM placed WHERE i = 1
    UNION ALL
    SELECT p.part, p.i, p.batch_base, p.position, CASE WHEN p.position - s.last >= {STRIDE} THEN p.position ELSE s.last END, p.position - s.last >= {STRIDE}
    FROM sampled s JOIN placed p ON p.part = s.part AND p.i = s.i + 1
)
SELECT part, batch_base, position FROM sampled WHERE taken""",
    "catalog_crossref": """WITH catalog AS (SELECT DISTINCT c_custkey AS entry FROM customer WHERE c_custkey % 5 <> 0),
storage AS (SELECT DISTINCT o_custkey AS entry FROM orders WHERE o_custkey % 7 <> 0)
SELECT entry, 'left' AS side FROM catalog WHERE entry NOT IN (SELECT entry FROM storage)
UNION ALL SELECT entry, 'right' FROM storage WHERE entry NOT IN (SELECT entry FROM catalog)""",
    "retired_inventory_check": f"""WITH {LOG}, {_segments("want")}, {_segments("have", 'event_id % 500 <> 0 AND NOT (part = 2 AND "off" < ' + str(SEGMENT_RECORDS) + ")")}, both_ AS (
    SELECT coalesce(w.part, h.part) AS part, coalesce(w.segment_base, h.segment_base) AS segment_base,
           CASE WHEN h.part IS NULL THEN 'missing' WHEN w.part IS NULL THEN 'unknown' ELSE
           array_to_string(list_filter([CASE WHEN w.bytes <> h.bytes THEN 'bytes' END, CASE WHEN w."end" <> h."end" THEN 'end' END,
                                        CASE WHEN w.max_ts <> h.max_ts THEN 'max_ts' END, CASE WHEN w.n <> h.n THEN 'n' END], lambda x: x IS NOT NULL), ',') END AS problem
    FROM want w FULL JOIN have h ON w.part = h.part AND w.segment_base = h.segment_base
)
SELECT * FROM both_ WHERE problem <> ''""",
    "index_validation": f"""WITH {LOG}, {BATCHES} SELECT part, batch_base, 'n' AS problem FROM batches WHERE batch_base % 128 = 0 AND batch_base % 640 = 0""",
    "progress_latest": f"""WITH {LOG}, {COMMITS} SELECT group_id, part, arg_max(next, seq) AS next FROM commits GROUP BY ALL""",
    "commit_chain_check": f"""WITH {LOG}, {COMMITS}, known AS (
    SELECT *, lag(next) OVER (PARTITION BY group_id, part ORDER BY seq) AS expected FROM commits
), seen AS (
    SELECT *, lag(next) OVER (PARTITION BY group_id, part ORDER BY seq) AS found FROM known WHERE seq % 11 <> 0
)
SELECT group_id, part, seq, next, expected, found FROM seen WHERE found <> expected""",
    "generation_chain_check": """WITH numbered AS (
    SELECT o_custkey AS group_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS generation FROM orders
), seen AS (
    SELECT group_id, generation, lag(generation) OVER (PARTITION BY group_id ORDER BY generation) AS found FROM numbered WHERE o_orderkey % 7 <> 0
)
SELECT * FROM seen WHERE found <> generation - 1""",
    "consumer_lag": f"""WITH {LOG}, {PARTS_4}, {ENDS}, done AS (
    SELECT key AS group_id, part, max("off") + 1 AS delivered, max("off") FILTER (event_id % 3 = 0) + 1 AS committed FROM log GROUP BY ALL
)
SELECT group_id, part, low, high, delivered, committed, greatest(high - delivered, 0) AS delivery_lag,
       greatest(high - committed, 0) AS commit_lag, greatest(low - committed, 0) AS expired
FROM done JOIN ends USING (part) WHERE committed IS NOT NULL""",
    "group_assignments": """WITH names AS (SELECT list_sort(list(DISTINCT r_name)) AS names FROM region),
dealt AS (
    SELECT names[1 + (row_number() OVER (ORDER BY n_nationkey) - 1) % len(names)] AS member, n_nationkey AS part FROM nation, names
)
SELECT member, string_agg(CAST(part AS VARCHAR), ',' ORDER BY part) AS parts, count(*) AS n FROM dealt GROUP BY member""",
    "catalog_temporal_lookup": """SELECT o_orderkey, CAST(o_custkey % 27 AS INTEGER) AS topic, o_orderkey % 60 AS catalog_next, CAST(n_nationkey AS BIGINT) * 2 AS creation
FROM orders LEFT JOIN nation ON o_custkey % 27 = n_nationkey
WHERE n_nationkey IS NULL OR n_nationkey * 2 + 1 > o_orderkey % 60""",
    "projection_usage": f"""WITH {LOG}, {COMMITS}, keys AS (
    SELECT group_id, part FROM commits UNION SELECT 'start-' || r_name, r_regionkey FROM region
)
SELECT count(DISTINCT group_id) AS groups, count(*) AS keys FROM keys""",
    "retention_plan_time": _retention(1),
    "retention_plan_size": _retention(2),
    "retention_plan_both": _retention(3),
    "cleanup_debt": f"""WITH {_planned(1)}, gone AS (SELECT * FROM planned WHERE retired), first_ AS (
    SELECT * FROM gone ORDER BY part, segment_base LIMIT 1024
)
SELECT count(*) AS n, CAST(coalesce(sum(bytes), 0) AS BIGINT) AS bytes, min(segment_base) AS min_base, (SELECT count(*) > 1024 FROM gone) AS truncated FROM first_""",
    "latency_summary": f"""WITH {LOG}, seen AS (SELECT key, CAST(floor(amount * 1000000) AS BIGINT) AS latency FROM log)
SELECT key, count(*) AS n, CAST(sum(latency) AS BIGINT) AS total, CAST(floor(sum(latency) / count(*)) AS BIGINT) AS average, min(latency) AS least, max(latency) AS most,
       quantile_disc(latency, 0.5) AS p50, quantile_disc(latency, 0.9) AS p90, quantile_disc(latency, 0.95) AS p95,
       quantile_disc(latency, 0.99) AS p99, quantile_disc(latency, 0.999) AS p999
FROM seen GROUP BY key""",
    "benchmark_summary": """WITH seen AS (
    SELECT o_orderpriority, count(*) AS n, round(quantile_cont(o_totalprice, 0.5), 6) AS median, round(quantile_cont(o_totalprice, 0.1), 6) AS p10,
           round(quantile_cont(o_totalprice, 0.9), 6) AS p90, min(o_totalprice) AS least, max(o_totalprice) AS most,
           round(stddev_pop(o_totalprice) * 100 / avg(o_totalprice), 6) AS cv
    FROM orders GROUP BY o_orderpriority
)
SELECT *, cv >= 10 AS warn FROM seen""",
    "latency_histogram": f"""WITH {HISTOGRAM} SELECT * FROM hist""",
    "histogram_quantiles_ceil": _quantile(0.95, "ceil"),
    "histogram_quantiles_floor": _quantile(0.5, "floor"),
    "throughput_rate": f"""WITH {LOG}, seen AS (
    SELECT part, count(*) AS n, CAST(sum(encoded_bytes) AS BIGINT) AS bytes, max(ts_ms) - min(ts_ms) AS span_ms FROM log GROUP BY part
)
SELECT *, round(CASE WHEN span_ms <= 0 THEN 0.0 ELSE n * CAST(1000 AS DOUBLE) / span_ms END, 6) AS records_s,
       round(CASE WHEN span_ms <= 0 THEN 0.0 ELSE bytes * CAST(1000 AS DOUBLE) / span_ms END, 6) AS bytes_s
FROM seen""",
    "backlog_analysis": f"""WITH {LOG}, each AS (
    SELECT part, "off" - "off" % {PACK_RECORDS} AS batch_base, max(ts_ms) AS elapsed_ms, count(*) AS n, count(*) FILTER (event_id % 3 <> 1) AS done FROM log GROUP BY ALL
), samples AS (
    SELECT part, elapsed_ms, greatest(sum(n - done) OVER (PARTITION BY part ORDER BY batch_base), 0) AS backlog FROM each
), seen AS (
    SELECT part, CAST(arg_min(backlog, elapsed_ms) AS BIGINT) AS backlog_start, CAST(arg_max(backlog, elapsed_ms) AS BIGINT) AS backlog_end,
           CAST(max(backlog) AS BIGINT) AS backlog_most, max(elapsed_ms) - min(elapsed_ms) AS span_ms
    FROM samples GROUP BY part
), sloped AS (
    SELECT *, CASE WHEN span_ms <= 0 THEN 0.0 ELSE (backlog_end - backlog_start) * CAST(1000 AS DOUBLE) / span_ms END AS raw FROM seen
)
SELECT part, backlog_start, backlog_end, backlog_most, span_ms, round(raw, 9) AS slope,
       CASE WHEN span_ms <= 0 THEN 'no time' WHEN raw > 0 THEN 'backlog grows' ELSE '' END AS reasons, span_ms > 0 AND raw <= 0 AS valid
FROM sloped""",
    "outcome_counters": f"""WITH {LOG} SELECT part, {", ".join(f"count(*) FILTER (key = '{k}') AS n_{k}" for k in KINDS)} FROM log GROUP BY part""",
    "partition_report": f"""WITH {LOG}, ended AS (SELECT *, max("off") OVER (PARTITION BY part) - "off" AS lag FROM log)
SELECT part, count(*) AS n, CAST(sum(encoded_bytes) AS BIGINT) AS bytes, count(DISTINCT "off" // {PACK_RECORDS}) AS batches,
       count(*) // count(DISTINCT "off" // {PACK_RECORDS}) AS batch_average, CAST(sum(lag) // count(*) AS BIGINT) AS lag_average, max(lag) AS lag_most
FROM ended GROUP BY part""",
    "delivery_latency": """WITH seen AS (SELECT event_id // 3 AS k, event_id % 3 AS step, epoch_us(ts) // 1000 AS ms FROM events)
SELECT o.k, a.ms - o.ms AS ack_latency, d.ms - o.ms AS delivery_latency
FROM (SELECT * FROM seen WHERE step = 0) o LEFT JOIN (SELECT * FROM seen WHERE step = 1) a USING (k) LEFT JOIN (SELECT * FROM seen WHERE step = 2) d USING (k)""",
    "partition_digest": f"""WITH {LOG}, leaves AS (
    SELECT part, "off" // 256 AS leaf, sha256(string_agg(coalesce(key, '') || chr(0) || coalesce(value, '') || chr(0), '' ORDER BY "off")) AS h FROM log GROUP BY ALL
), upper_ AS (
    SELECT part, leaf // 256 AS node, sha256(string_agg(h, '' ORDER BY leaf)) AS h FROM leaves GROUP BY ALL
)
SELECT part, sha256(string_agg(h, '' ORDER BY node)) AS digest FROM upper_ GROUP BY part""",
    "expired_distance": f"""WITH {_planned(1)}, starts AS (
    SELECT part, coalesce(max("end") FILTER (retired), min(segment_base)) AS new_low FROM planned GROUP BY part
), {COMMITS}, progress AS (SELECT group_id, part, arg_max(next, seq) AS next FROM commits WHERE seq % 2 = 0 GROUP BY ALL)
SELECT group_id, part, next, new_low, greatest(new_low - next, 0) AS skipped FROM progress JOIN starts USING (part)""",
    "partition_stats": f"""WITH {LOG}, {PARTS_5}
SELECT p.part, greatest(count(DISTINCT "off" // {SEGMENT_RECORDS}), 1) AS segments, count("off") AS n, CAST(coalesce(sum(encoded_bytes), 0) AS BIGINT) AS bytes,
       coalesce(min("off"), 0) AS low, coalesce(max("off") + 1, 0) AS high, max(ts_ms) AS newest_ms
FROM parts p LEFT JOIN log USING (part) GROUP BY p.part""",
    "store_stats": f"""WITH {LOG}, {PARTS_5}, each AS (
    SELECT p.part, greatest(count(DISTINCT "off" // {SEGMENT_RECORDS}), 1) AS segments, count("off") AS n, sum(encoded_bytes) AS bytes FROM parts p LEFT JOIN log USING (part) GROUP BY p.part
)
SELECT count(*) AS partitions, count(*) FILTER (n > 0) AS with_records, CAST(sum(segments) AS BIGINT) AS segments, CAST(sum(n) AS BIGINT) AS n, CAST(sum(bytes) AS BIGINT) AS bytes FROM each""",
    "disk_pressure": """WITH samples AS (
    SELECT CAST(o_custkey % 4 AS INTEGER) AS part, o_orderkey AS "at", CAST(floor(o_totalprice) AS BIGINT) AS free FROM orders
)
SELECT *, coalesce(last_value(CASE WHEN free < 30000 THEN true WHEN free >= 350000 THEN false END IGNORE NULLS)
                   OVER (PARTITION BY part ORDER BY "at" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS refused
FROM samples""",
    "workload_keys": """SELECT CAST(range % 7 % 4 AS INTEGER) AS part, printf('soak-%016x-%016x-%08x-%016x', 24301, 3, range % 7, range // 7) AS key,
       range % 7 AS producer, range // 7 AS sequence,
       CASE range // 7 % 64 WHEN 0 THEN 'large' WHEN 1 THEN 'null' WHEN 2 THEN 'empty' ELSE 'small' END AS size
FROM range(2000)""",
    "sequence_check": """WITH seen AS (
    SELECT user_id, event_id, event_id - CASE WHEN event_id % 13 = 0 THEN 60 ELSE 0 END AS sequence FROM events
), lagged AS (SELECT *, lag(sequence) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM seen)
SELECT * FROM lagged WHERE sequence <= before""",
    "stream_offsets": f"""WITH {LOG} SELECT event_id, part, "off" FROM log""",
    "stream_bounds": f"""WITH {LOG}, {PARTS_4}, {ENDS} SELECT * FROM ends WHERE n > 0""",
    "binary_roundtrip": f"""WITH {LOG} SELECT part, "off", ts_ms, key, value FROM log""",
    "group_snapshots": """WITH rows_ AS (
    SELECT c_nationkey AS group_id, c_custkey % 5 AS member, c_mktsegment AS topic_id, CASE WHEN c_nationkey % 3 = 0 THEN c_custkey ELSE c_custkey % 200 END AS part
    FROM customer WHERE c_custkey % 4 = 0 OR c_nationkey < 12
), times AS (SELECT *, count(*) AS times FROM rows_ GROUP BY ALL),
shared AS (SELECT group_id, topic_id, part, count(*) AS owners, max(times) AS times, sum(times) AS n FROM times GROUP BY ALL),
flags AS (SELECT group_id, max(times) > 1 AS repeated, max(owners) > 1 AS overlap, CAST(sum(n) AS BIGINT) AS keys FROM shared GROUP BY group_id),
each AS (SELECT group_id, member, string_agg(topic_id || ':' || lpad(CAST(part AS VARCHAR), 9, '0'), ',' ORDER BY topic_id, part) AS keys FROM times GROUP BY ALL),
whole AS (SELECT group_id, count(*) AS n_members, sha256(string_agg(keys, ';' ORDER BY keys)) AS canonical FROM each GROUP BY group_id)
SELECT group_id, n_members, f.keys, CASE WHEN repeated THEN 'repeated' WHEN overlap THEN 'overlap' ELSE '' END AS problem, canonical FROM flags f JOIN whole USING (group_id)""",
    "retention_applied": f"""WITH {_planned(3)}, starts AS (
    SELECT part, coalesce(max("end") FILTER (retired), min(segment_base)) AS low, CAST(coalesce(bit_or(reason) FILTER (retired), 0) AS INTEGER) AS reason_mask FROM planned GROUP BY part
)
SELECT part, low, max("off") + 1 AS high, count(*) FILTER ("off" >= low) AS n, min("off") FILTER ("off" >= low) AS first_off, count(*) FILTER ("off" < low) AS refused, reason_mask
FROM log JOIN starts USING (part) GROUP BY part, low, reason_mask""",
    "history_validation": f"""WITH {LOG}, {COMMITS}, known AS (
    SELECT *, lag(next) OVER (PARTITION BY group_id, part ORDER BY seq) AS before FROM commits
), left_ AS (SELECT * FROM known WHERE seq % 11 <> 0),
seen AS (
    SELECT *, lag(next) OVER (PARTITION BY group_id, part ORDER BY seq) AS stands FROM left_
)
SELECT seq + 10 AS "offset", 'commit by no owner' AS problem FROM left_ WHERE seq % 17 = 0
UNION ALL
SELECT seq + 10, 'commit does not agree' FROM seen
WHERE coalesce(stands, 0) <> coalesce(before, 0) OR (before IS NULL) <> (stands IS NULL)""",
    "assignment_validation": """WITH a AS (
    SELECT o_orderpriority AS group_id, CAST(o_custkey % 27 AS INTEGER) AS topic_id, CAST(o_orderkey AS BIGINT) AS part, o_custkey % 7 AS owner, o_orderkey % 50 AS resume FROM orders
), m AS (SELECT DISTINCT group_id, owner FROM a WHERE owner <> 3),
p AS (SELECT group_id, topic_id, part, CASE WHEN part % 19 = 0 THEN resume - 1 ELSE resume + 5 END AS next FROM a WHERE part % 13 <> 0),
met AS (
    SELECT a.*, n.n_regionkey * 10000 + 20000 AS n_partitions, m.owner AS known, p.next
    FROM a LEFT JOIN nation n ON n.n_nationkey = a.topic_id LEFT JOIN m USING (group_id, owner) LEFT JOIN p USING (group_id, topic_id, part)
)
SELECT group_id, topic_id, part, 'unknown partition' AS problem FROM met WHERE n_partitions IS NULL OR part >= n_partitions
UNION ALL SELECT group_id, topic_id, part, 'owner is no member' FROM met WHERE known IS NULL
UNION ALL SELECT group_id, topic_id, part, 'no progress' FROM met WHERE next IS NULL
UNION ALL SELECT group_id, topic_id, part, 'resume does not agree' FROM met WHERE next < resume""",
    "monotone_bounds": """WITH samples AS (
    SELECT CAST(o_custkey % 4 AS INTEGER) AS part, o_orderkey AS "at", o_orderkey // 8 - CASE WHEN o_orderkey % 97 = 0 THEN 50 ELSE 0 END AS low,
           o_orderkey // 4 + CASE WHEN o_orderkey % 89 = 0 THEN 500 ELSE 0 END - CASE WHEN o_orderkey % 101 = 0 THEN 2 * o_orderkey ELSE 0 END AS high
    FROM orders
), seen AS (
    SELECT *, lag(low) OVER (PARTITION BY part ORDER BY "at") AS low_before, lag(high) OVER (PARTITION BY part ORDER BY "at") AS high_before FROM samples
)
SELECT * FROM seen WHERE low > high OR low < low_before OR high < high_before""",
    "ordered_digest": f"""WITH {LOG} SELECT part, sha256(string_agg(coalesce(key, '') || chr(0) || coalesce(value, '') || chr(0), '' ORDER BY "off")) AS digest FROM log GROUP BY part""",
    "prefix_digests": f"""WITH {LOG}, leaves AS (
    SELECT part, "off" // 256 AS leaf, sha256(string_agg(coalesce(key, '') || chr(0) || coalesce(value, '') || chr(0), '' ORDER BY "off")) AS h FROM log WHERE "off" < 1000 GROUP BY ALL
), upper_ AS (
    SELECT part, leaf // 256 AS node, sha256(string_agg(h, '' ORDER BY leaf)) AS h FROM leaves GROUP BY ALL
), whole AS (SELECT part, sha256(string_agg(h, '' ORDER BY node)) AS digest FROM upper_ GROUP BY part)
SELECT part, sha256('{"0" * 31}1/{"0" * 31}9/' || part || '/1000/' || digest) AS digest FROM whole""",
    "segment_preflight": f"""WITH {LOG}, bounds AS (SELECT part, max("off") AS last FROM log GROUP BY part)
SELECT part, CAST(0 AS BIGINT) AS base, last // {PACK_RECORDS} * {PACK_RECORDS} AS "end", last // {PACK_RECORDS} AS batches, last // {PACK_RECORDS} * {PACK_RECORDS} AS records, 'tail' AS kind FROM bounds""",
}
