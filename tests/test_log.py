"""Every query of the catalogue against DuckDB, and the operators on small histories."""

import random
import re

import duckdb
import pandas as pd
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from offsetlake.functions import scalar
from offsetlake.functions.schema import Corrupt, FetchLimitTooSmall, InvalidArgument, OffsetOutOfRange, RecordTooLarge
from offsetlake.functions.workspace import work_path
from offsetlake.operators import capacity, consumer, groups, history, integrity, metrics, packing, replay, retention, scan
from offsetlake.plans import catalogue, oracle
from offsetlake.sources import reports, views, workloads
from offsetlake.streaming import offsets

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents conversations".split()
KINDS = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_catalogue(spark, duck, name):
    found = catalogue.QUERIES[name](spark, SF)
    rel = duck.sql(oracle.SQL[name])
    want = rel.df()
    columns = sorted(want.columns)
    assert columns == sorted(found.columns)
    kinds = {c: KINDS.get(str(t), str(t)) for c, t in zip(rel.columns, rel.types, strict=True)}
    assert kinds == dict(found.dtypes)
    got = found.toPandas()[columns].sort_values(columns).reset_index(drop=True)
    pd.testing.assert_frame_equal(want[columns].sort_values(columns).reset_index(drop=True), got, check_dtype=False, check_exact=True)


def log_of(spark, sizes, part=0):
    return spark.createDataFrame([(part, i, n, 1000 + i) for i, n in enumerate(sizes)], "part int, off long, encoded_bytes long, ts_ms long")


def test_fetch_takes_the_longest_run_and_never_skips(spark):
    log = log_of(spark, [40, 41, 42])
    assert [r.off for r in scan.fetch(log, 0, 0, 0, 80).collect()] == [0]
    assert scan.fetch(log, 0, 0, 0, 81).first().next_offset == 2
    reader = scan.Reader(log, 0)
    with pytest.raises(RecordTooLarge):
        reader.fetch(max_bytes=39)
    assert reader.next_offset == 0
    seen = []
    while rows := reader.fetch(max_records=2):
        seen += [r.off for r in rows]
    assert seen == [0, 1, 2] and reader.next_offset == scan.end_offset(log, 0) == 3
    with pytest.raises(OffsetOutOfRange):
        reader.seek(4)
    with pytest.raises(InvalidArgument):
        scan.fetch_limits(-1, 0)
    assert scan.fetch_limits() == (1024, 4 << 20) and scan.matching(log.withColumn("key", F.col("off")), F.lit(2)).first().off == 2


def test_fetches_are_those_of_a_reader(spark):
    """Over ranges that a fetch crosses, from a start above 0, across missing offsets and of a null partition; limits of bytes and of records cut."""
    rnd = random.Random(3)
    logs = {None: (0, 900), -1: (5, 1), 0: (0, 300), 1: (611, 1000), 2: (128, 129)}
    rows = [(p, i, rnd.choice([0, 36, 40, 99, 300]), 0) for p, (low, n) in logs.items() for i in range(low, low + n) if i == low or i % 50 > 2]
    log = spark.createDataFrame(rows, "part int, off long, encoded_bytes long, ts_ms long").repartition(3)
    for records, size in ((4, 700), (8, 300), (7, 1 << 20)):
        want = set()
        for p in logs:
            own = [(off, n) for q, off, n, _ in rows if q == p]
            at = own[0][0]
            while at <= own[-1][0]:
                seen, upto = [], 0
                for off, n in own:
                    if at <= off < at + records:
                        upto += n
                        seen += [off] if upto <= size else []
                at = seen[-1] + 1
                want.add((p, seen[0], len(seen), at))
        got = [tuple(r) for r in scan.fetches(log, records, size, 64).collect()]
        assert len(got) == len(want) and set(got) == want
    with pytest.raises(PythonException, match="FetchLimitTooSmall"):  # the cursor cannot pass a gap as long as a fetch
        scan.fetches(log, 3, 300, 64).collect()
    whole = log.where("part = 2 and off between 153 and 199")
    assert [tuple(r) for r in scan.fetches(whole, 1, 300, 16).orderBy("first_off").collect()] == [(2, i, 1, i + 1) for i in range(153, 200)]
    short = log.where("part = 2 and off < 160")
    assert sorted(tuple(r)[1:] for r in scan.fetches(short, 8, 300).collect()) == scan.read_pages(short, 2, 8, 300)
    assert scan.fetches(log.where("false")).count() == 0
    with pytest.raises(FetchLimitTooSmall):
        scan.fetches(log, 8, 299)
    with pytest.raises(InvalidArgument):
        scan.fetches(log, -1)


def test_fetch_pages_has_no_job_for_each_fetch(spark, duck, tmp_path):
    """24 fetches and more take the jobs that 4 do."""
    jobs = []
    for copies in (1, 24):
        folder = tmp_path / str(copies)
        folder.mkdir()
        duck.execute(f"COPY (SELECT * REPLACE (event_id + 1000000 * k AS event_id) FROM events, range({copies}) t(k)) TO '{folder}/events.parquet'")
        spark.sparkContext.setJobGroup(f"fetches-{copies}", "")
        got = {tuple(r) for r in catalogue.fetch_pages(spark, str(folder)).select("part", "first_off", "n", "next_offset").collect()}
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"fetches-{copies}")))
        own = duckdb.connect()
        own.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
        assert got == set(own.execute(f"SELECT part, first_off, n, next_offset FROM ({oracle.SQL['fetch_pages']})").fetchall()) and len(got) >= copies
    assert jobs[0] == jobs[1] > 0


def test_numbers_follow_the_order_over_buckets(spark):
    rnd = random.Random(1)
    rows = [(rnd.randint(0, 2), t, rnd.randint(0, 9)) for t in rnd.sample(range(10_000), 500)]
    got = views.number(spark.createDataFrame(rows, "part int, t long, x int"), "part", ["t"], F.floor(F.col("t") / 700)).collect()
    for p in range(3):
        assert [r.t for r in sorted((r for r in got if r.part == p), key=lambda r: r.off)] == sorted(t for q, t, _ in rows if q == p)


def test_packing_is_greedy(spark):
    rnd = random.Random(5)
    sizes = [rnd.choice([30, 60, 200]) for _ in range(400)]
    log = log_of(spark, sizes).unionByName(log_of(spark, sizes[::-1], 1))
    got = {(r.part, r.off): r.batch_base for r in packing.pack_batches(log, 7, 500).collect()}
    for part, own in ((0, sizes), (1, sizes[::-1])):
        base, n, size = 0, 0, 52
        for off, s in enumerate(own):
            if n == 7 or off and size + s > 500:
                base, n, size = off, 0, 52
            n, size = n + 1, size + s
            assert got[part, off] == base


def test_segments_roll_with_their_header(spark):
    """Two batches of 89 bytes do not fit a segment of 161 with its header of 72."""
    batches = spark.createDataFrame([(0, 0, 1, 1, 89, 5), (0, 1, 2, 1, 89, 6)], "part int, batch_base long, end long, n long, bytes long, max_ts long")
    assert sorted(r.segment_base for r in packing.roll_segments(batches, 161).collect()) == [0, 1]
    assert [r.bytes for r in packing.segment_stats(packing.roll_segments(batches, 250)).collect()] == [250]


def test_prefix_max_of_times_that_go_back(spark):
    log = spark.createDataFrame([(0, i, t) for i, t in enumerate([-10, -20, -5, -30])], "part int, off long, ts_ms long")
    assert [r.prefix_max for r in integrity.prefix_max(log, width=2).orderBy("off").collect()] == [-10, -10, -5, -5]


def test_gaps_of_sparse_logs(spark):
    log = spark.createDataFrame([(0, o) for o in (3, 4, 7, 9, 10)] + [(1, 0)], "part int, off long")
    assert [tuple(r) for r in integrity.gaps(log).collect()] == [(0, 2, 3)]


def test_retired_lists_tile(spark):
    kind = "old_low long, new_low long, retired array<struct<base:bigint,end:bigint>>"
    rows = [(0, 2, [(0, 1), (1, 2)]), (0, 1, [(1, 1)]), (0, 3, [(0, 1), (2, 3)]), (0, 1, []), (0, 1, [(0, 1)])]
    assert [r.tiles for r in integrity.tiles(spark.createDataFrame(rows, kind)).collect()] == [True, False, False, False, True]


def plan_rows(spark, rows, *how):
    segments = spark.createDataFrame([(0, i, i + 1, b, t) for i, (b, t) in enumerate(rows)], "part int, segment_base long, end long, bytes long, max_ts long")
    return [r.retired for r in retention.plan(segments, F.lit(100), *how).orderBy("segment_base").collect()]


def test_retention_is_a_prefix_and_keeps_the_last(spark):
    assert plan_rows(spark, [(10, 1), (10, 99), (10, 1), (10, 1)], 1, 50) == [True, False, False, False]
    assert plan_rows(spark, [(10, 1)] * 4, 2, 0, 0) == [True, True, True, False]
    assert plan_rows(spark, [(10, 1)] * 4, 2, 0, 25) == [True, True, False, False]
    assert plan_rows(spark, [(10, 3_600_100), (10, 1)], 1, 0) == [False, False]  # not in the future
    rnd = random.Random(8)
    for _ in range(5):
        rows = [(rnd.randint(1, 30), rnd.randint(0, 120)) for _ in range(rnd.randint(1, 12))]
        left, want, on = sum(b for b, _ in rows), [], True
        for i, (b, t) in enumerate(rows):
            on = on and i < len(rows) - 1 and (t <= 100 and 100 - t >= 40 or left > 60)
            want.append(on)
            left -= b
        assert plan_rows(spark, rows, 3, 40, 60) == want


def test_summaries(spark):
    rows = spark.createDataFrame([(v,) for v in (40, 10, 30, 20, 50)], "v long")
    got = metrics.exact_summary(rows, "v").first().asDict()
    assert got == {"n": 5, "total": 150, "average": 30, "least": 10, "most": 50, "p50": 30, "p90": 50, "p95": 50, "p99": 50, "p999": 50}
    assert set(metrics.exact_summary(rows.limit(0), "v").first().asDict().values()) == {0}
    counts = metrics.histogram(spark.createDataFrame([(v,) for v in (1, 10, 99, 100, 1000)], "v long"), "v", (10, 100))
    assert sorted((r.bucket, r.n) for r in counts.collect()) == [(0, 1), (1, 2), (2, 2)] and counts.agg(F.sum("total")).first()[0] == 1210
    assert metrics.histogram_quantile(counts, (10, 100), 0.5, "ceil").first().bound == 100
    late = metrics.histogram(spark.createDataFrame([(20 * 10**9,)], "v long"), "v", metrics.RUN_BOUNDS)
    assert metrics.histogram_quantile(late, metrics.RUN_BOUNDS, 0.99, "floor").first().bound == 30 * 10**9
    assert spark.range(1).select(scalar.rate(F.lit(250), F.lit(2000)), scalar.rate(F.lit(1), F.lit(0))).first()[:] == (125.0, 0.0)


def test_backlog(spark):
    kind = "elapsed_ms long, offered long, acked long"
    good = metrics.backlog(spark.createDataFrame([(1000, 10, 4), (9000, 20, 15)], kind)).first()
    assert (good.backlog_start, good.backlog_end, good.backlog_most, good.valid) == (6, 5, 6, True)
    bad = metrics.backlog(spark.createDataFrame([(0, 1, 0), (1000, 3, 0)], kind)).first()
    assert bad.slope > 0 and not bad.valid


OFFSET_EVENTS = """offset long, event_type int, store_id string, catalog_next long, group_id string, start_mode int, starts array<struct<topic_id:string,part:int,next:bigint>>, instance string,
expected_generation long, new_generation long, reason int, members array<struct<session:string,keys:array<struct<topic_id:string,part:int>>>>,
assignments array<struct<topic_id:string,part:int,owner:string,resume:bigint,baseline:int,initial:bigint>>, session string, generation long, topic_id string, part int, previous_kind int, expected_previous long, next long"""


def created(offset, group, mode=1, starts=(), revision=2, store="s"):
    return (offset, 3, store, revision, group, mode, list(starts), *[None] * 13)


def assigned(offset, group, expected, members, assignments, new=None, reason=1, revision=2):
    return (offset, 4, "s", revision, group, None, None, "i", expected, expected + 1 if new is None else new, reason, members, assignments, *[None] * 7)


def committed(offset, group, generation, part, previous, next_, kind=1, session="m", instance="i", revision=2):
    return (offset, 5, "s", revision, group, None, None, instance, None, None, None, None, None, session, generation, "t", part, kind, previous, next_)


def keys(*parts):
    return [("m", [("t", p) for p in parts])]


def test_replay(spark):
    rows = [
        created(0, "g"),
        assigned(1, "g", 0, keys(0, 1), [("t", 0, "m", 0, 1, 0), ("t", 1, "m", 5, 1, 5)]),
        committed(2, "g", 1, 0, 0, 3, 0),
        assigned(3, "g", 1, keys(0), [("t", 0, "m", 3, 0, 0)]),
        committed(4, "g", 2, 0, 3, 4),
    ]
    events = spark.createDataFrame(rows, OFFSET_EVENTS)
    assert {(r.part, r.next) for r in replay.commits_from(events).collect()} == {(0, 4), (1, 5)}
    assert [(r.generation, r.part, r.owner) for r in replay.assignments_from(events).collect()] == [(2, 0, "m")]
    assert replay.entry_counts(events).first()[:] == ("g", 0, 1, 1, 2)
    folder = work_path(spark, "checkpoint")
    done = events.where("event_type = 5")
    for upto in (3, 5):
        replay.save_checkpoint(replay.latest(done.where(F.col("offset") < upto), ["group_id", "part"], "next", "offset"), folder, upto)
        state, covered = replay.load_checkpoint(spark, folder)
        assert covered == upto
        assert [r.next for r in replay.resume(state, covered, done, ["group_id", "part"], "next", "offset").collect()] == [4]


def problems(spark, rows, revision=2):
    topics = spark.createDataFrame([("t", 2, 1)], "topic_id string, n_partitions int, creation_offset long")
    found = history.offsets_problems(spark.createDataFrame(rows, OFFSET_EVENTS), topics, "s", revision).collect()
    return sorted((r.offset, r.problem) for r in found)


def folded(rows):
    """What the state on the driver says of the same events: the first that it refuses, and nothing behind it."""
    state = groups.Groups("s", lambda key, revision: key[0] == "t" and 0 <= key[1] < 2 and 1 < revision)
    names = [c.strip().split()[0] for c in re.sub(r"<[^ ]*>", "", OFFSET_EVENTS.replace("\n", " ")).split(",")]
    for row in rows:
        event = dict(zip(names, row, strict=True))
        for field, parts in (("starts", ("topic_id", "part", "next")), ("assignments", ("topic_id", "part", "owner", "resume", "baseline", "initial"))):
            event[field] = [dict(zip(parts, x, strict=True)) for x in event[field] or []]
        event["members"] = [{"session": s, "keys": [{"topic_id": t, "part": p} for t, p in ks]} for s, ks in event["members"] or []]
        try:
            state.apply(event["offset"], event)
        except Corrupt:
            return event["offset"]
    return None


GOOD = [created(0, "g"), assigned(1, "g", 0, keys(0, 1), [("t", 0, "m", 0, 1, 0), ("t", 1, "m", 5, 1, 5)]), committed(2, "g", 1, 0, 0, 3, 0), committed(3, "g", 1, 0, 3, 3)]
WRONG = [
    (created(4, "g"), "group created twice"),
    (created(4, "h", 3), "start mode"),
    (created(4, "h", 3, [("t", 1, 0), ("t", 0, 0)]), "starts out of order"),
    (created(4, "h", 3, [("t", 7, 0)]), "unknown partition"),
    (created(4, "h", store="x"), "store"),
    (created(5, "h"), "gap"),
    (committed(4, "x", 1, 0, 0, 1), "unknown group"),
    (assigned(4, "g", 1, keys(0, 1), [("t", 0, "m", 3, 0, 0), ("t", 1, "m", 5, 0, 0)], new=3), "generation step"),
    (assigned(4, "g", 5, [], []), "generation chain"),
    (assigned(4, "g", 1, [], [], reason=9), "reason"),
    (assigned(4, "g", 1, [("n", []), ("m", [])], []), "members out of order"),
    (assigned(4, "g", 1, [("m", [("t", 1), ("t", 0)])], [("t", 0, "m", 3, 0, 0), ("t", 1, "m", 5, 0, 0)]), "subscriptions out of order"),
    (assigned(4, "g", 1, [("m", [("t", 0)]), ("n", [("t", 0)])], [("t", 0, "m", 3, 0, 0)]), "key with two owners"),
    (assigned(4, "g", 1, keys(0, 1), [("t", 1, "m", 5, 0, 0), ("t", 0, "m", 3, 0, 0)]), "assignments out of order"),
    (assigned(4, "g", 1, keys(0), [("t", 0, "n", 3, 0, 0)]), "owner without subscription"),
    (assigned(4, "g", 1, keys(0, 1), [("t", 0, "m", 3, 0, 0)]), "keys left out"),
    (assigned(4, "g", 1, keys(0), [("t", 0, "m", 3, 0, 9)]), "baseline"),
    (assigned(4, "g", 1, keys(0), [("t", 0, "m", 3, 1, 3)]), "baseline exists"),
    (assigned(4, "g", 1, keys(0), [("t", 0, "m", 2, 0, 0)]), "baseline does not agree"),
    (committed(4, "g", 2, 0, 3, 4), "commit by no owner"),
    (committed(4, "g", 1, 0, 3, 4, session="n"), "commit by no owner"),
    (committed(4, "g", 1, 0, 3, 4, instance="j"), "commit by no owner"),
    (committed(4, "g", 1, 0, 2, 4), "commit does not agree"),
    (committed(4, "g", 1, 0, 3, 4, kind=0), "commit does not agree"),
    (committed(4, "g", 1, 1, 5, 6, kind=1), "commit does not agree"),
    (committed(4, "g", 1, 0, 3, 2), "commit goes back"),
    (committed(4, "g", 1, 5, 3, 4), "unknown partition"),
    (committed(4, "g", 1, 0, 3, 4, revision=9), "revision"),
]


def test_histories_of_groups(spark):
    assert problems(spark, GOOD) == [] and folded(GOOD) is None
    every = spark.createDataFrame([(*row, k) for k, (bad, _) in enumerate(WRONG) for row in [*GOOD, bad]], OFFSET_EVENTS + ", case int")
    for k, (bad, problem) in enumerate(WRONG):
        rows = [*GOOD, bad]
        if problem not in ("revision",):
            assert folded(rows) == bad[0], problem
        found = problems(spark, rows) if k % 4 == 0 else None
        assert found is None or (bad[0], problem) in found and all(o == bad[0] for o, _ in found), (problem, found)
    topics = spark.createDataFrame([("t", 2, 1)], "topic_id string, n_partitions int, creation_offset long")
    found = {}
    for r in history.offsets_shape(every.withColumn("offset", F.col("offset") + F.col("case") * 100)).unionByName(history.keys_known(every.withColumn("offset", F.col("offset") + F.col("case") * 100), topics, 2)).collect():
        found.setdefault(r.offset // 100, set()).add(r.problem)
    told = {"start mode", "starts out of order", "unknown partition", "generation step", "reason", "members out of order", "subscriptions out of order", "key with two owners", "assignments out of order", "owner without subscription", "keys left out", "baseline", "commit goes back", "revision"}
    assert all(problem in found.get(k, ()) for k, (_, problem) in enumerate(WRONG) if problem in told)
    chained = every.withColumn("offset", F.col("offset") + F.col("case") * 100).withColumn("group_id", F.concat_ws("/", "group_id", F.col("case").cast("string")))
    links = {}
    for r in history.offsets_chains(chained).collect():
        links.setdefault(r.offset // 100, set()).add(r.problem)
    told = {"group created twice", "unknown group", "generation chain", "baseline exists", "baseline does not agree", "commit by no owner", "commit does not agree"}
    assert all(problem in links.get(k, ()) for k, (_, problem) in enumerate(WRONG) if problem in told)


def test_chains_run_over_ranges(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice("ab"), i, rnd.choice([None, i])) for i in rnd.sample(range(300), 200)]
    frame = spark.createDataFrame(rows, "k string, o long, v long")
    for width in (7, 1000):
        got = {(r.k, r.o): r.before for r in integrity.previous(frame, ["k"], "o", "v", width).collect()}
        own = {(r.k, r.o): r.before for r in integrity.previous(frame, ["k"], "o", "v", width, own=True).collect()}
        for k in "ab":
            last = None
            for o, v in sorted((o, v) for j, o, v in rows if j == k):
                assert got[k, o] == last
                last = v if v is not None else last
                assert own[k, o] == last


CATALOG_EVENTS = """offset long, event_type int, store_id string, expected_next long, topic_id string, name string, partitions array<struct<part:int,config:struct<record_bytes:bigint,batch_bytes:bigint,batch_records:int,segment_bytes:bigint,linger_ms:bigint,retention_mask:int,retention_ms:bigint,retention_bytes:bigint,segment_age_ms:bigint,check_interval_ms:bigint>,anchor:struct<id:string,hash:string>>>,
part int, old_low long, new_low long, durable_end long, anchor struct<id:string,hash:string>, reason_mask int, retired array<struct<base:bigint,end:bigint,bytes:bigint,anchor:struct<id:string,hash:string>>>"""
CONF = (1 << 20, 4 << 20, 10, 64 << 20, 0, 1, 5, 0, 5, 5)


def topic_event(offset, topic="t", name="orders", config=CONF, part=0, expected=None):
    return (offset, 1, "s", offset if expected is None else expected, topic, name, [(part, config, ("a0", "h"))], *[None] * 7)


def start_event(offset, old, new, ids, end=100, mask=1, topic="t", part=0, cut=None, anchor=None):
    step = (new - old) // len(ids)
    retired = cut or [(old + i * step, old + (i + 1) * step, 9, (x, "h")) for i, x in enumerate(ids)]
    return (offset, 2, "s", offset, topic, None, None, part, old, new, end, anchor or (f"a{new}", "h"), mask, retired)


def test_histories_of_catalogs(spark):
    first = (0, 6, "s", None, None, None, None, *[None] * 7)
    good = [first, topic_event(1), start_event(2, 0, 4, ["a0", "a2"]), start_event(3, 4, 6, ["a4"])]

    def found(rows):
        return {(r.offset, r.problem) for r in history.catalog_problems(spark.createDataFrame(rows, CATALOG_EVENTS), "s").collect()}

    assert found(good) == set()
    assert [(r.low, r.anchor.id, r.durable_end) for r in replay.log_starts(spark.createDataFrame(good, CATALOG_EVENTS)).collect()] == [(6, "a6", 100)]
    assert [r[:] for r in replay.topics(spark.createDataFrame(good, CATALOG_EVENTS)).collect()] == [("t", "orders", 1, 1)]
    wrong = [
        (topic_event(4, "u"), "name twice"), (topic_event(4, "t", "x"), "topic_id twice"), (topic_event(4, "u", "x", part=1), "partitions"), (topic_event(4, "u", "x", expected=9), "revision"),
        (topic_event(4, "u", "x", CONF[:2] + (0,) + CONF[3:]), "configuration"), (topic_event(9, "u", "x"), "gap"), (start_event(4, 5, 7, ["a5"]), "start chain"), (start_event(4, 6, 8, ["x"]), "anchor chain"),
        (start_event(4, 6, 8, ["a6"], end=99), "end goes back"), (start_event(4, 6, 8, ["a6"], mask=2), "reason not enabled"), (start_event(4, 6, 8, ["a6"], mask=0), "reason"), (start_event(4, 6, 8, ["a6"], part=3), "unknown partition"),
        (start_event(4, 6, 10, ["a6", "a6"]), "retired twice"), (start_event(4, 6, 8, ["a6"], anchor=("a6", "h")), "retired anchor"), (start_event(4, 6, 8, ["a6"], cut=[(6, 7, 9, ("a6", "h"))]), "tiles"), (start_event(4, 6, 6, ["a6"]), "start"),
    ]
    for bad, problem in wrong[::3] + wrong[1::5]:
        said = found([*good, bad])
        assert (bad[0], problem) in said and {o for o, _ in said} == {bad[0]}, (problem, said)


def test_assignments_and_leases(spark):
    members, parts = spark.createDataFrame([("b",), ("a",), ("a",)], "member string"), spark.range(5).select(F.col("id").cast("int").alias("part"))
    assert sorted((r.member, r.part) for r in consumer.assign(members, parts).collect()) == [("a", 0), ("a", 2), ("a", 4), ("b", 1), ("b", 3)]
    assert consumer.assign(members.limit(0), parts).count() == 0
    beats = spark.createDataFrame([("x", 0, False), ("x", 50, False), ("y", 0, True), ("z", 0, False)], "session string, at_ms long, busy boolean")
    assert [r.session for r in consumer.expired_sessions(beats, 100, 60).collect()] == ["z"]
    reason = spark.createDataFrame([(True, False, False), (False, True, True), (False, False, True), (False, False, False)], "f boolean, e boolean, a boolean")
    assert [r[0] for r in reason.select(consumer.assignment_reason(F.col("f"), F.col("e"), F.col("a"))).collect()] == [1, 4, 3, 5]


def test_reports(spark, tmp_path):
    (tmp_path / "b.txt").write_text("goos: linux\nBenchmarkFetch/segment-8  100  71.6 ns/op  458.03 MB/s  3 allocs/op\nPASS\n")
    got = {(r.name, r.runs, r.unit): r.value for r in reports.benchmark_lines(spark, str(tmp_path / "b.txt")).collect()}
    assert got == {("Fetch/segment", 100, "ns/op"): 71.6, ("Fetch/segment", 100, "MB/s"): 458.03, ("Fetch/segment", 100, "allocs/op"): 3.0}
    (tmp_path / "e.txt").write_text("a=1\nb = x=y\nnothing\n")
    assert {tuple(r) for r in reports.settings(spark, str(tmp_path / "e.txt")).collect()} == {("a", "1"), ("b", "x=y")}
    (tmp_path / "r.json").write_text('{"version": 2, "duration_ns": 10, "offered": 30, "acknowledged": 25, "samples": []}')
    assert reports.runs(spark, str(tmp_path / "r.json")).first().measurement_ns == 10


def test_settings_merge_and_reports(spark):
    a, b = spark.createDataFrame([("x", "1")], "name string, value string"), spark.createDataFrame([("x", "2"), ("y", "3")], "name string, value string")
    merged = reports.merge_settings(a, b)
    assert {tuple(r) for r in merged.collect()} == {("x", "1"), ("y", "3")}
    assert reports.markdown(merged, "name") == "| name | value |\n|-|-|\n| x | 1 |\n| y | 3 |\n"


def test_limits(spark):
    totals = spark.createDataFrame([(5, 9), (1, 1)], "topics int, partitions int")
    assert [r.over for r in capacity.over_limits(totals, {"topics": 4, "partitions": 8}).collect()] == ["partitions,topics", ""]
    events = spark.createDataFrame([(60,), (30,)], "bytes long")
    assert capacity.history_fits(events, 10, 100).first()[:] == (90, 10, True) and not capacity.history_fits(events, 11, 100).first().fits


def test_pressure_has_a_band(spark):
    free = [50, 9, 20, 29, 30, 15, 9, 30, 31]
    samples = spark.createDataFrame([(0, i, f) for i, f in enumerate(free)], "part int, at long, free long")
    for width in (2, 100):
        assert [r.refused for r in capacity.pressure(samples, 10, 30, width).orderBy("at").collect()] == [False, True, True, True, False, False, True, False, False]


def test_offsets_go_on_over_batches(spark):
    folder = work_path(spark, "stream")
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("part", (F.col("user_id") % 4).cast("int"))
    for i in range(3):
        events.where(F.col("event_id") % 3 == i).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(events.schema).parquet(f"{folder}/in")
        offsets.assign_stream(stream, f"{folder}/out", f"{folder}/checkpoint", "part", ["ts", "event_id"], F.date_trunc("day", "ts").cast("timestamp_ntz"))
    got = spark.read.parquet(f"{folder}/out/rows")
    assert got.count() == events.count() and integrity.gaps(got).count() == 0
    assert got.where("batch = 0").groupBy("part").agg(F.max("off").alias("m")).join(got.where("batch = 1").groupBy("part").agg(F.min("off").alias("n")), "part").where("n <> m + 1").count() == 0


def test_topic_names(spark):
    names = {"a": True, "A.b_c-9": True, "": False, ".": False, "..": False, "__x": False, "_x": True, "a b": False, "x" * 249: True, "x" * 250: False, None: False}
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", scalar.valid_topic_name(F.col("n")).alias("v")).collect()
    assert {r.n: r.v for r in got} == names


def test_seek_of_every_offset(spark):
    """Borders of batches and of ranges, offsets below the first entry, and ranges without an entry."""
    bases = [b for b in range(512, 280_000, 256) if not 66_000 < b < 200_000]
    index = spark.createDataFrame([(p, b, 3 * b + p) for p in (0, 1) for b in bases], "part int, base long, position long")
    probes = spark.range(280_000).select(F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("part"), F.col("id").alias("off"))
    got = scan.seek(probes, index).toPandas().sort_values(["part", "off"])
    at = pd.Series(bases).searchsorted(range(280_000), side="right") - 1
    base = pd.Series([float(bases[i]) if i >= 0 else None for i in at], dtype="float")
    assert len(got) == 840_000 and got.off.tolist() == list(range(280_000)) * 3
    for p in (0, 1):
        own = got[got.part == p].reset_index()
        assert own.base.astype(float).equals(base) and own.position.astype(float).equals(3 * base + p)
    assert got[got.part == 2].base.isna().all()


def test_cleanup_debt_is_cut_at_its_default(spark):
    for n in (1023, 1024, 1025):
        retired = spark.range(n).selectExpr("cast(id % 2 AS int) AS part", "id * 10 AS segment_base", "id + 1 AS bytes")
        row = retention.cleanup_debt(retired).first()
        kept = sorted((i % 2, i * 10, i + 1) for i in range(n))[:1024]
        assert (row.n, row.bytes, row.min_base, row.truncated) == (len(kept), sum(b for _, _, b in kept), 0, n > 1024)


def test_rules_that_are_columns(spark):
    assert [spark.range(1).select(scalar.next_power_of_two(F.lit(n))).first()[0] for n in (0, 1, 2, 3, 4, 5, 1 << 40, (1 << 40) + 1)] == [1, 1, 2, 4, 4, 8, 1 << 40, 1 << 41]
    texts = spark.createDataFrame([("ab",), ("",), ("a\0",), ("é" * 3,), (None,)], "t string")
    assert [r[0] for r in texts.select(scalar.valid_text(F.col("t"), 5)).collect()] == [True, True, False, False, False]
    most = (1 << 63) - 1
    assert spark.range(1).select(scalar.add_saturating(F.lit(most), F.lit(1)), scalar.add_saturating(F.lit(2), F.lit(3)), scalar.valid_offset_range(F.lit(most - 1), F.lit(1)), scalar.valid_offset_range(F.lit(most - 1), F.lit(2)), scalar.valid_id(F.lit("0" * 32)), scalar.valid_id(F.lit("0" * 31 + "a"))).first()[:] == (most, 5, True, False, False, True)
    arrays = spark.createDataFrame([([1, 2],), ([2, 1],), ([1, 1],), ([],)], "a array<int>")
    assert [r[0] for r in arrays.select(integrity.canonical(F.col("a"))).collect()] == [True, False, False, True]
    active = spark.createDataFrame([(1, 50, 10), (0, 0, 10), (1, 99, 10), (1, 99, 90)], "n int, max_ts long, total_bytes long")
    assert [r.roll for r in retention.must_roll(active, F.lit(100), 20, 80).collect()] == [True, False, False, True]
    configs = spark.createDataFrame([(0, 1), (1, 5000), (2, 7000)], "retention_mask int, check_interval_ms long")
    assert retention.check_interval(configs).first()[0] == 5000 and retention.check_interval(configs.limit(1)).first()[0] == 3_600_000
    sizes = spark.createDataFrame([(10, [("x",)]), (99, [(None,)])], "n long, h array<struct<name:string>>").withColumn("c", F.struct(F.lit(50).alias("record_bytes")))
    assert [r[0] for r in sizes.select(scalar.record_reasons(F.col("n"), F.transform("h", lambda h: F.struct(h["name"].alias("name"), F.lit(None).cast("binary").alias("value"))), F.col("c"))).collect()] == [[], ["record_bytes", "header name"]]


def test_sets_and_members(spark):
    a, b = spark.createDataFrame([(1,), (1,), (2,)], "k int"), spark.createDataFrame([(2,), (1,)], "k int")
    assert integrity.same_keys(a, b, ["k"]) and not integrity.same_rows(a, b) and integrity.same_rows(a, a.repartition(2))
    assert [r.k for r in integrity.outside(a, b.where("k = 1"), ["k"]).collect()] == [2]
    rows = spark.createDataFrame([(1, "m"), (2, "x")], "part int, owner string")
    assert [r.part for r in consumer.unknown_owners(rows, spark.createDataFrame([("m",)], "member string")).collect()] == [2]


def test_snapshots_of_groups(spark):
    rows = [("g", "m", "b", 1), ("g", "m", "a", 2), ("g", "n", "a", 1), ("r", "m", "a", 0), ("r", "m", "a", 0), ("o", "m", "a", 0), ("o", "n", "a", 0), ("t", "m", "a", 0), ("t", "n", "a", 1), ("t", "k", "a", 2)]
    got = {r.group_id: r for r in consumer.snapshots(spark.createDataFrame(rows, "group_id string, member string, topic_id string, part int"), most_members=2).collect()}
    assert {g: r.problem for g, r in got.items()} == {"g": "", "r": "repeated", "o": "overlap", "t": "too many"}
    assert [[tuple(k) for k in m] for m in got["g"].members] == [[("a", 1)], [("a", 2), ("b", 1)]] and got["t"].members is None


def test_latency_buckets(spark):
    rows = spark.createDataFrame([(v,) for v in (999, 1000, 10**9 - 1, 10**9, 61 * 10**9)], "v long")
    counts = metrics.histogram(rows, "v", metrics.STORE_BOUNDS)
    assert metrics.bucket_counts(counts, metrics.STORE_BOUNDS).first().counts == [1, 1, 0, 0, 0, 0, 1, 2]
    assert metrics.bucket_counts(metrics.histogram(rows, "v", metrics.RUN_BOUNDS), metrics.RUN_BOUNDS).first().counts[-1] == 1
    merged = metrics.merged_samples(rows, rows)
    assert merged.count() == 10 and metrics.exact_summary(merged, "v").first().p50 == 10**9 - 1
    lags = spark.createDataFrame([("a", 1, 5), ("a", 2, 7), ("b", 1, 1)], "t string, p int, lag long")
    assert {(r.t, r.p): (r.n, r.total, r.most) for r in metrics.lag_samples(lags, "t", "p").collect()} == {("a", 1): (1, 5, 5), ("a", 2): (1, 7, 7), ("b", 1): (1, 1, 1), (None, None): (3, 13, 7)}


def test_percentiles_are_those_of_sorting(spark):
    rnd = random.Random(4)
    values = {k: [rnd.choice([rnd.randint(-50, 50), rnd.randint(-(10**9), 10**9)]) for _ in range(n)] for k, n in (("a", 1), ("b", 2), ("c", 997), (None, 10))}
    rows = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs] + [("c", None)], "k string, v long")
    got = {r.k: r for r in metrics.exact_summary(rows, "v", "k").collect()}
    spread = {r.k: r for r in metrics.spread_summary(rows, "v", "k").collect()}
    for k, vs in values.items():
        own = sorted(vs)
        assert [got[k][f"p{p}"] for p in (50, 90, 95, 99, 999)] == [own[max(-(-len(own) * p // 1000), 1) - 1] for p in (500, 900, 950, 990, 999)]
        for c, p in (("median", 0.5), ("p10", 0.1), ("p90", 0.9)):
            at = p * (len(own) - 1)
            low = int(at + 1e-9)
            want = own[low] + (own[min(low + 1, len(own) - 1)] - own[low]) * (at - low)
            assert abs(spread[k][c] - want) < 1e-3


def test_run_analysis(spark):
    kind = "measurement_ns long, offered long, acknowledged long, acknowledged_bytes long, completed boolean, warmup_ns long, warmup_elapsed_ns long, samples array<struct<elapsed_ns:bigint,offered:bigint,acknowledged:bigint>>, samples_dropped long, oracles int, phases array<struct<name:string,duration_ns:bigint>>, compaction struct<interval_ns:bigint,completed:bigint,pending_files:bigint,pending_bytes:bigint,truncated:boolean,error:boolean,timed:bigint>"
    good = (2 * 10**9, 40, 30, 3000, True, 5, 6, [(0, 9, 4), (10**9, 20, 17)], 0, 3, [("drain", 7), ("verify", 8)], (1, 2, 0, 0, False, False, 2))
    rows = [good, (*good[:4], False, 5, None, [(0, 1, 1), (10**9, 9, 1)], 2, 0, [], (1, 0, 1, 0, False, False, 0)), (*good[:5], 5, 4, [], 0, 1, None, None)]
    got = metrics.run_analysis(spark.createDataFrame(rows, kind)).collect()
    assert (got[0].offered_s, got[0].acknowledged_bytes_s, got[0].drain_ns, got[0].verify_ns, got[0].backlog_most, got[0].slope, got[0].valid) == (20.0, 1500.0, 7, 8, 5, -2.0, True)
    assert got[1].reasons == ["did not complete", "warm-up is missing", "samples were dropped", "backlog grows", "oracles are missing", "no compaction completed", "cleanup debt"]
    assert got[2].reasons == ["warm-up was short"] and got[2].backlog_most == 0


def test_verification_of_a_range(spark):
    log = spark.createDataFrame([(0, i, b"k", b"v") for i in range(600)], "part int, off long, key binary, value binary")
    whole = scan.verify(log, 0, 100, 500).first()
    assert whole.n == 400 and whole.whole
    assert not scan.verify(log.where("off <> 300"), 0, 100, 500).first().whole and not scan.verify(log, 0, 100, 700).first().whole
    assert scan.verify(log.withColumn("value", F.when(F.col("off") == 300, F.lit(b"w")).otherwise(F.col("value"))), 0, 100, 500).first().digest != whole.digest
    assert scan.read_pages(log_of(spark, [50] * 10), 0, 4) == [(0, 4, 4), (4, 4, 8), (8, 2, 10)]


def test_workloads(spark):
    rows = workloads.soak(spark, 640, 2, 5, 6).collect()
    for r in rows:
        value = r.value
        if r.sequence % 64 == 1:
            assert value is None
        elif r.sequence % 64 == 2:
            assert value == b""
        else:
            assert value[:64].decode() == r.key and all(value[i] == i % 256 for i in range(64, len(value)))
            assert len(value) == 65_536 if r.sequence % 64 == 0 else 1024 <= len(value) < 1152
    longer = sum(len(r.value or b"") > 1024 and r.sequence % 64 > 2 for r in rows)
    assert 40 < longer < 120 and workloads.soak(spark, 640, 2, 5, 6).repartition(3).exceptAll(workloads.soak(spark, 640, 2, 5, 6)).count() == 0
    assert spark.range(1).select(workloads.soak_key(F.lit("soak-x")).alias("k")).first().k is None
    made = workloads.history(spark, 70, 8).collect()
    assert [r.off for r in made] == list(range(70)) and {r.batch_base for r in made} == {0, 32, 64} and len(made[0].value) == 8


def test_sections_and_json(spark):
    folder = work_path(spark, "reports")
    reports.append_section(spark, folder, "r.md", "one", "first")
    reports.append_section(spark, folder, "r.md", "two", "second")
    with pytest.raises(InvalidArgument):
        reports.append_section(spark, folder, "r.md", "one", "again")
    rows = spark.createDataFrame([(2, "b"), (1, "a")], "x int, y string")
    reports.save_json(rows, folder, "r.json")
    assert [tuple(r) for r in spark.read.schema("x int, y string").json(f"{folder}/r.json").collect()] == [(1, "a"), (2, "b")]
    with pytest.raises(InvalidArgument):
        reports.save_json(rows, folder, "r.json", most=1)
    assert reports.markdown(rows, "x", 1).endswith("1 more rows are left out.\n")


def test_commits_of_a_stream(spark):
    folder = work_path(spark, "commits")
    for lo in (0, 5):
        spark.range(lo, lo + 5).selectExpr("cast(id % 2 as int) as part", "id as off").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = offsets.lingering(spark, "part int, off long", 1).parquet(f"{folder}/in")
    offsets.group_commit_stream(stream, f"{folder}/out", f"{folder}/checkpoint", "g")
    got = spark.read.parquet(f"{folder}/out").groupBy("group_id", "part").agg(F.max("next").alias("next"), F.count(F.lit(1)).alias("n")).collect()
    assert {(r.group_id, r.part, r.next, r.n) for r in got} == {("g", 0, 9, 2), ("g", 1, 10, 2)}
