"""The binary form of segments, indexes and events."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from offsetlake.functions import checksum
from offsetlake.functions.schema import RECORD, Corrupt, InvalidArgument, LogError, Unsupported
from offsetlake.sources import binary, system

TOPIC = "0123456789abcdef0123456789abcdef"


def slowly(data):
    crc, table = 0xFFFFFFFF, checksum.remainders().tolist()
    for b in data:
        crc = table[(crc ^ b) & 0xFF] ^ crc >> 8
    return crc ^ 0xFFFFFFFF


def test_checksums(spark):
    assert checksum.crc32c(b"123456789") == 0xE3069283
    rnd = random.Random(1)
    found = [rnd.randbytes(n) for n in (0, 1, 3, 63, 64, 255, 256, 257, 1000, 4097, 70_001)]
    assert [checksum.crc32c(d) for d in found] == [slowly(d) for d in found]
    lengths = np.array([len(d) for d in found])
    assert checksum.crc32c_each(np.frombuffer(b"".join(found), np.uint8), np.cumsum(lengths) - lengths, lengths).tolist() == [slowly(d) for d in found]
    rows = spark.createDataFrame([(b"123456789",), (None,), (b"",)], "b binary").select(checksum.crc32c_column(F.col("b")).alias("c")).collect()
    assert [r.c for r in rows] == [0xE3069283, None, 0]
    assert zlib.crc32(b"123456789") != 0xE3069283


def record(offset, ts=1, key=None, value=b"v", headers=()):
    return {"offset": offset, "timestamp_ms": ts, "key": key, "value": value, "headers": list(headers)}


ROWS = [record(100, -7, None, b""), record(101, 9, b"k", b"value", [{"name": "x", "value": None}, {"name": "x", "value": b""}])]
OWN = binary.Segment(TOPIC, 3, 100, binary.segment_id(TOPIC, 3, 100))


class _File:
    def __init__(self, data):
        import io

        self.raw = io.BytesIO(data)
        self.seek, self.read = self.raw.seek, self.raw.read


def rows_of(data, **how):
    return [r for _, _, rows in binary.scan_segment(_File(data), len(data), **how) for r in rows]


def test_layout():
    """Places of fields that the format fixes."""
    data = binary.encode_segment(OWN, [ROWS, [record(102)]])
    assert data[:8] == b"IELSEG00" and data[8:12] == bytes([1, 0, 72, 0]) and data[16:32].hex() == TOPIC and int.from_bytes(data[40:48], "little") == 100
    batch = data[72:]
    assert batch[:4] == b"IELB" and batch[6:8] == bytes([48, 0]) and int.from_bytes(batch[12:16], "little") == 2 and int.from_bytes(batch[24:32], "little", signed=True) == 9
    first = binary.encode_record(ROWS[0], 100)
    assert len(first) == 36 and first[28:32] == b"\xff" * 4 and first[32:36] == b"\0" * 4
    assert len(binary.encode_record(ROWS[1], 100)) == 28 + 4 + 1 + 4 + 5 + 2 * (8 + 1)
    assert rows_of(data) == [*ROWS, record(102)]
    assert binary.decode_segment_header(data, TOPIC, 3) == OWN
    with pytest.raises(Corrupt):
        binary.decode_segment_header(data, TOPIC, 4)


def test_every_byte_that_changes_shows():
    data = binary.encode_segment(OWN, [ROWS, [record(102)]])
    for at in range(len(data)):
        wrong = bytearray(data)
        wrong[at] ^= 1
        with pytest.raises((Corrupt, Unsupported)):
            rows_of(bytes(wrong), strict=False)


def test_only_a_last_batch_cut_short_may_be_dropped():
    data = binary.encode_segment(OWN, [ROWS])
    more = binary.encode_batch([record(102)])
    for n in range(1, len(more)):
        cut = data + more[:n]
        with pytest.raises(Corrupt):
            rows_of(cut)
        if n < binary.BATCH_BYTES:
            with pytest.raises(Corrupt):
                rows_of(cut, strict=False)
        else:
            assert rows_of(cut, strict=False) == ROWS
    for wrong in ([record(5)], [record(102), record(104)]):
        with pytest.raises(LogError):
            rows_of(data + binary.encode_batch(wrong))
    with pytest.raises(InvalidArgument):
        binary.encode_batch([])


def written(spark, folder, n=2000):
    rows = spark.range(n).select(
        F.lit(TOPIC).alias("topic_id"), (F.col("id") % 2).cast("int").alias("partition"), F.floor(F.col("id") / 2).alias("offset"), (F.col("id") * 7 % 1000 - 500).alias("timestamp_ms"),
        F.when(F.col("id") % 5 != 0, F.col("id").cast("string").cast("binary")).alias("key"), F.when(F.col("id") % 7 != 0, F.repeat(F.lit("v"), (F.col("id") % 50).cast("int")).cast("binary")).alias("value"),
        F.when(F.col("id") % 3 == 0, F.array(F.struct(F.lit("h").alias("name"), F.lit(None).cast("binary").alias("value")))).otherwise(F.array().cast(RECORD["headers"].dataType)).alias("headers"),
    )
    binary.write_segments(rows, folder, batch_records=64, segment_bytes=8000)
    return rows


def test_files_give_back_what_was_written(spark, tmp_path):
    folder = f"file://{tmp_path}"
    rows = written(spark, folder)
    files = binary.segment_files(folder)
    assert len(files) > 4 and not [p for p in tmp_path.rglob("*.log.*")]
    found = binary.read_segments(spark, folder)
    assert found.exceptAll(rows.select(*found.columns)).count() == 0 and found.count() == 2000
    some = binary.read_segments(spark, folder, low=300, high=310).collect()
    assert sorted((r.partition, r.offset) for r in some) == [(p, o) for p in (0, 1) for o in range(300, 310)]
    batches = binary.read_segments(spark, folder, read="batches")
    assert batches.agg(F.sum("records"), F.max("records")).first()[:] == (2000, 64)
    report = binary.preflight(spark, folder).collect()
    assert len(report) == len(files) and not any(r.problem for r in report) and sum(r.records for r in report) == 2000
    index = binary.index_table(batches, 1000).collect()
    at = {(r.partition, r.batch_base): r for r in batches.collect()}
    assert all(r.position == at[r.partition, r.base].position and r.records == at[r.partition, r.base].records for r in index) and {r.segment_base for r in index} == {b for _, b, _ in files}


def test_report_says_what_is_wrong_where(spark, tmp_path):
    folder = f"file://{tmp_path}"
    written(spark, folder)
    paths = [p for p, _, _ in binary.segment_files(folder)]
    for path, change in zip(paths, (lambda d: d[:200] + bytes([d[200] ^ 1]) + d[201:], lambda d: d[:-3], lambda d: d[:8] + b"\x02" + d[9:], lambda d: d[: 72 + 10]), strict=False):
        with open(path, "rb") as f:
            data = f.read()
        with open(path, "wb") as f:
            f.write(change(data))
    import os

    os.rename(paths[4], paths[4].replace(f"{binary.segment_files(folder)[4][1]:020d}", f"{10**9:020d}"))
    kinds = {r.path: r.kind for r in binary.preflight(spark, folder).collect()}
    assert [kinds[p] for p in paths[:4]] == ["corrupt", "tail", "corrupt", "corrupt"] and "misplaced" in kinds.values() and "" in kinds.values()


def test_indexes():
    store = "f" * 32
    entries = [{"base": 100, "position": 72, "bytes": 90, "records": 2}, {"base": 102, "position": 162, "bytes": 80, "records": 1}]
    data = binary.encode_index(store, OWN, entries)
    assert len(data) == 128 + 64 and binary.decode_index(data, store, OWN) == entries
    timed = [{"prefix_max": -5, **e} for e in entries]
    assert binary.decode_index(binary.encode_index(store, OWN, timed, True), store, OWN) == timed
    for at in range(len(data)):
        wrong = bytearray(data)
        wrong[at] ^= 1
        with pytest.raises((Corrupt, Unsupported)):
            binary.decode_index(bytes(wrong), store, OWN)
    with pytest.raises(Corrupt):
        binary.decode_index(data, "e" * 32, OWN)


CONFIG = {"record_bytes": 1 << 20, "batch_bytes": 4 << 20, "batch_records": 10, "segment_bytes": 64 << 20, "linger_ms": 5, "retention_mask": 3, "retention_ms": 9, "retention_bytes": 10, "segment_age_ms": 11, "check_interval_ms": 12}
ANCHOR = {"id": "a" * 32, "hash": "b" * 64}
EVENTS = [
    {"event_type": 6, "store_id": "1" * 32, "catalog_anchor": ANCHOR, "offsets_anchor": ANCHOR, "catalog_config": CONFIG, "offsets_config": CONFIG},
    {"event_type": 1, "store_id": "1" * 32, "expected_next": 4, "topic_id": TOPIC, "name": "orders", "partitions": [{"part": 0, "config": CONFIG, "anchor": ANCHOR}]},
    {"event_type": 2, "store_id": "1" * 32, "expected_next": 5, "topic_id": TOPIC, "part": 0, "old_low": 0, "new_low": 7, "durable_end": 9, "anchor": ANCHOR, "reason_mask": 2, "at_ms": -4, "retained_bytes": 3, "retired": [{"base": 0, "end": 7, "bytes": 99, "anchor": ANCHOR}]},
    {"event_type": 3, "store_id": "1" * 32, "catalog_next": 6, "group_id": "g", "start_mode": 3, "starts": [{"topic_id": TOPIC, "part": 0, "next": 8}]},
    {"event_type": 4, "store_id": "1" * 32, "catalog_next": 6, "group_id": "g", "instance": "2" * 32, "expected_generation": 0, "new_generation": 1, "reason": 1, "members": [{"session": "3" * 32, "keys": [{"topic_id": TOPIC, "part": 0}]}], "assignments": [{"topic_id": TOPIC, "part": 0, "owner": "3" * 32, "resume": 8, "baseline": 1, "initial": 8}]},
    {"event_type": 5, "store_id": "1" * 32, "catalog_next": 6, "group_id": "g", "instance": "2" * 32, "session": "3" * 32, "generation": 1, "topic_id": TOPIC, "part": 0, "previous_kind": 0, "expected_previous": 8, "next": 9},
]


def test_events(spark):
    assert len(system.encode(EVENTS[0])) == 16 + 240
    for e in EVENTS:
        value = system.encode(e)
        assert value[:4] == b"IELE" and system.decode(value) == e
        for n in range(len(value)):
            with pytest.raises((Corrupt, Unsupported)):
                system.decode(value[:n])
        with pytest.raises(Corrupt):
            system.decode(value + b"\0")
    with pytest.raises(Corrupt):
        system.decode(system.encode(EVENTS[3]), "catalog")
    with pytest.raises(InvalidArgument):
        system.encode(EVENTS[1] | {"name": ""})
    with pytest.raises(InvalidArgument):
        system.encode(EVENTS[0] | {"catalog_config": CONFIG | {"batch_records": 0}})
    for log, own in (("catalog", EVENTS[:3]), ("offsets", EVENTS[3:])):
        rows = [(i, system.encode(e)) for i, e in enumerate(own)] + [(3, b"nothing")]
        found = system.events(spark.createDataFrame(rows, "offset long, value binary"), log).orderBy("offset").collect()
        assert [r.event_type for r in found] == [*(e["event_type"] for e in own), None] and found[3].problem
        back = [{k: v for k, v in r.asDict(True).items() if k in e} for r, e in zip(found, own, strict=False)]
        assert back == own


def test_configurations(spark):
    bad = {"record_bytes": 1, "batch_bytes": 10, "batch_records": 0, "segment_bytes": 5, "retention_mask": 4, "check_interval_ms": 0, "segment_age_ms": 0}
    rows = [CONFIG, *(CONFIG | {k: v} for k, v in bad.items()), CONFIG | {"retention_mask": 0}, CONFIG | {"retention_ms": 1 << 62}]
    from offsetlake.functions.schema import CONFIG as KIND

    frame = spark.createDataFrame([(i, tuple(r[f.name] for f in KIND)) for i, r in enumerate(rows)], f"i int, c {KIND.simpleString()}")
    got = {r.i: r.w for r in frame.select("i", system.config_reasons(F.col("c")).alias("w")).collect()}
    assert got == {i: system.config_problems(r) for i, r in enumerate(rows)} and not got[0] and all(got[i] for i in range(1, len(rows)))
