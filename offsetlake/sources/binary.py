"""The binary form of segments, version 1: a Spark data source, a writer, and reports of what is wrong.

A segment is a header of 72 bytes and batches; a batch is a header of 48, records and
a checksum; a record has a prefix of 28, then key, value and headers. Integers are
little-endian, a length of 0xffffffff stands for null, checksums are CRC-32C. Files
are named by their first offset, in 20 digits, under ``<topic id>-<partition>``.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..functions.checksum import crc32c
from ..functions.schema import RECORD, Corrupt, InvalidArgument, RecordTooLarge, Unsupported

# Fixed values of the format: magic numbers, sizes and limits.
SEGMENT_MAGIC, BATCH_MAGIC, INDEX_MAGIC, VERSION = b"IELSEG00", b"IELB", b"IELIDX00", 1
SEGMENT_BYTES, BATCH_BYTES, TRAILER_BYTES, RECORD_BYTES = 72, 48, 4, 28
BATCH_MOST, RECORD_MOST, RECORDS_MOST, HEADERS_MOST, NAME_MOST = 64 << 20, 16 << 20, 65_536, 1024, 65_535
OFFSET_MOST, PART_MOST, NULL = (1 << 63) - 1, (1 << 31) - 1, 0xFFFFFFFF
# magic, version, header size, 0, topic, partition, batch version, 0, base, segment id, 0, checksum
_SEGMENT = struct.Struct("<8sHHI16sIHHQ16sII")
# magic, version, header size, bytes, records, base, greatest time, 0, record version, 0, 0, checksum
_BATCH = struct.Struct("<4sHHIIQqIHHII")
# bytes, offset in the batch, time, 0, headers
_RECORD = struct.Struct("<IIqQI")
# magic, version, header size, kind, entry size, 0, 0, store, topic, partition, 0, segment, base, header hash, stride, checksum
_INDEX = struct.Struct("<8sHHHHII16s16sII16sQ32sII")
_BY_OFFSET, _BY_TIME = struct.Struct("<QQIIII"), struct.Struct("<qQQIIII")
_U32 = struct.Struct("<I")
_NAME = re.compile(r"[0-9]{20}\.log")


def segment_id(topic_id: str, part: int, base: int) -> str:
    """An identity for a segment that this library makes: the same place, the same identity."""
    return hashlib.sha256(f"{topic_id}/{part}/{base}".encode()).hexdigest()[:32]


@dataclass(frozen=True)
class Segment:
    topic_id: str  # 32 hexadecimal digits, as all identities
    part: int
    base: int
    id: str

    def encode(self) -> bytes:
        topic, own = bytes.fromhex(self.topic_id), bytes.fromhex(self.id)
        if len(topic) != 16 or len(own) != 16 or not any(topic) or not any(own) or not 0 <= self.part <= PART_MOST or not 0 <= self.base <= OFFSET_MOST:
            raise InvalidArgument(f"no segment: {self}")
        head = _SEGMENT.pack(SEGMENT_MAGIC, VERSION, SEGMENT_BYTES, 0, topic, self.part, VERSION, 0, self.base, own, 0, 0)
        return head[:-4] + _U32.pack(crc32c(head[:-4]))

    def header_hash(self) -> str:
        return hashlib.sha256(self.encode()).hexdigest()


def decode_segment_header(data: bytes, topic_id: str | None = None, part: int | None = None) -> Segment:
    if len(data) < SEGMENT_BYTES:
        raise Corrupt("a segment header is cut short")
    magic, version, size, zero, topic, found, records, zero2, base, own, zero3, crc = _SEGMENT.unpack_from(data)
    if magic != SEGMENT_MAGIC or size != SEGMENT_BYTES or crc != crc32c(data[: SEGMENT_BYTES - 4]):
        raise Corrupt("a segment header is wrong")
    if version != VERSION or records != VERSION:
        raise Unsupported(f"segment version {version} of batch version {records}")
    if zero or zero2 or zero3 or not any(topic) or not any(own) or found > PART_MOST or base > OFFSET_MOST:
        raise Corrupt("a segment header has no valid identity or range")
    if topic_id is not None and topic_id != topic.hex() or part is not None and part != found:
        raise Corrupt("a segment of another partition")
    return Segment(topic.hex(), found, base, own.hex())


def _put(data: bytes | None) -> bytes:
    return _U32.pack(NULL) if data is None else _U32.pack(len(data)) + data


def encode_record(row: dict, base: int) -> bytes:
    """``row``: offset, timestamp_ms, key, value, headers (name, value); null is not empty."""
    headers = row.get("headers") or []
    if not 0 <= row["offset"] - base <= NULL or len(headers) > HEADERS_MOST:
        raise InvalidArgument(f"offset {row['offset']} with {len(headers)} headers in a batch from {base}")
    out = [_put(row["key"]), _put(row["value"])]
    for h in headers:
        name = h["name"].encode()
        if len(name) > NAME_MOST:
            raise InvalidArgument("the name of a header is too long")
        out += [_U32.pack(len(name)), _U32.pack(NULL if h["value"] is None else len(h["value"])), name, h["value"] or b""]
    body = b"".join(out)
    size = RECORD_BYTES + len(body)
    if size > RECORD_MOST:
        raise RecordTooLarge(f"{size} bytes")
    return _RECORD.pack(size, row["offset"] - base, row["timestamp_ms"], 0, len(headers)) + body


def encode_batch(rows: list[dict]) -> bytes:
    """Rows of contiguous offsets."""
    if not 0 < len(rows) <= RECORDS_MOST:
        raise InvalidArgument(f"a batch of {len(rows)} records")
    base = rows[0]["offset"]
    if base < 0 or base + len(rows) > OFFSET_MOST or any(r["offset"] != base + i for i, r in enumerate(rows)):
        raise InvalidArgument("records of a batch are not contiguous")
    body = b"".join(encode_record(r, base) for r in rows)
    size = BATCH_BYTES + len(body) + TRAILER_BYTES
    if size > BATCH_MOST:
        raise RecordTooLarge(f"a batch of {size} bytes")
    head = _BATCH.pack(BATCH_MAGIC, VERSION, BATCH_BYTES, size, len(rows), base, max(r["timestamp_ms"] for r in rows), 0, VERSION, 0, 0, 0)
    whole = head[:-4] + _U32.pack(crc32c(head[:-4])) + body
    return whole + _U32.pack(crc32c(whole))


@dataclass(frozen=True)
class Batch:
    base: int
    records: int
    bytes: int
    max_ts: int


def decode_batch_header(data: bytes) -> Batch:
    if len(data) < BATCH_BYTES:
        raise Corrupt("a batch header is cut short")
    magic, version, head, size, records, base, newest, zero, kind, zero2, zero3, crc = _BATCH.unpack_from(data)
    if magic != BATCH_MAGIC or head != BATCH_BYTES or crc != crc32c(data[: BATCH_BYTES - 4]):
        raise Corrupt("a batch header is wrong")
    if version != VERSION or kind != VERSION:
        raise Unsupported(f"batch version {version} of record version {kind}")
    if zero or zero2 or zero3 or not 0 < records <= RECORDS_MOST or not BATCH_BYTES + TRAILER_BYTES + records * RECORD_BYTES <= size <= BATCH_MOST or base + records > OFFSET_MOST:
        raise Corrupt("a batch header has sizes outside their limits")
    return Batch(base, records, size, newest)


def _field(data: memoryview, at: int, size: int) -> tuple[bytes | None, int]:
    if size == NULL:
        return None, at
    if at + size > len(data):
        raise Corrupt("a field exceeds its record")
    return bytes(data[at : at + size]), at + size


def decode_record(data: memoryview, base: int, delta: int | None = None) -> dict:
    """One whole record; ``delta`` is where it has to stand in its batch."""
    if len(data) < RECORD_BYTES + 8:
        raise Corrupt("a record is cut short")
    size, own, ts, zero, n = _RECORD.unpack_from(data)
    if size != len(data) or zero or n > HEADERS_MOST or delta is not None and own != delta:
        raise Corrupt("a record's prefix is wrong")
    at, fields = RECORD_BYTES, []
    for _ in range(2):
        if at + 4 > len(data):
            raise Corrupt("a record is cut short")
        value, at = _field(data, at + 4, _U32.unpack_from(data, at)[0])
        fields.append(value)
    headers = []
    for _ in range(n):
        if at + 8 > len(data):
            raise Corrupt("a header is cut short")
        a, b = _U32.unpack_from(data, at)[0], _U32.unpack_from(data, at + 4)[0]
        if a > NAME_MOST:
            raise Corrupt("the name of a header is too long")
        name, at = _field(data, at + 8, a)
        value, at = _field(data, at, b)
        try:
            headers.append({"name": name.decode(), "value": value})
        except UnicodeDecodeError as error:
            raise Corrupt("the name of a header is no text") from error
    if at != len(data):
        raise Corrupt("bytes behind a record")
    return {"offset": base + own, "timestamp_ms": ts, "key": fields[0], "value": fields[1], "headers": headers}


def decode_batch(data: bytes) -> list[dict]:
    """Records of one whole batch, checked throughout."""
    head = decode_batch_header(data)
    if head.bytes != len(data):
        raise Corrupt("a batch is cut short or followed by bytes")
    end = len(data) - TRAILER_BYTES
    if _U32.unpack_from(data, end)[0] != crc32c(memoryview(data)[:end]):
        raise Corrupt("a batch's checksum is wrong")
    body, at, rows = memoryview(data), BATCH_BYTES, []
    for i in range(head.records):
        size = _U32.unpack_from(data, at)[0] if at + 4 <= end else 0
        if size < RECORD_BYTES or at + size > end:
            raise Corrupt("a record exceeds its batch")
        rows.append(decode_record(body[at : at + size], head.base, i))
        at += size
    if at != end:
        raise Corrupt("bytes behind the records of a batch")
    if max(r["timestamp_ms"] for r in rows) != head.max_ts:
        raise Corrupt("a batch's greatest time is wrong")
    return rows


def encode_segment(segment: Segment, batches: list[list[dict]]) -> bytes:
    return segment.encode() + b"".join(map(encode_batch, batches))


def scan_segment(file, size: int, strict: bool = True, low: int = 0, high: int = OFFSET_MOST, bodies: bool = True) -> Iterator[tuple[int, Batch, list[dict]]]:
    """(position, header, records) of the batches of a file that meet [low, high), one in memory at a time.

    Others are passed over by their headers. Not strict: a whole, valid header of a
    last batch whose body is not all there ends the file; anything else is an error.
    """
    file.seek(0)
    expected, at = decode_segment_header(file.read(SEGMENT_BYTES)).base, SEGMENT_BYTES
    while at < size:
        file.seek(at)
        head = decode_batch_header(file.read(min(BATCH_BYTES, size - at)))
        if head.base != expected:
            raise Corrupt(f"the batch at {at} begins at {head.base}, not at {expected}")
        if at + head.bytes > size:
            if strict:
                raise Corrupt(f"the batch at {at} is cut short")
            return
        expected += head.records
        if head.base < high and expected > low:
            rows: list[dict] = []
            if bodies:
                file.seek(at)
                rows = decode_batch(file.read(head.bytes))
            yield at, head, rows
        elif head.base >= high:
            return
        at += head.bytes


def _system(url: str):
    import pyarrow.fs

    return pyarrow.fs.FileSystem.from_uri(url if "://" in url or url.startswith("file:") else f"file://{url}")


def segment_files(folder: str) -> list[tuple[str, int, int]]:
    """(path, base, bytes) of segment files below a folder, by path: names of 20 digits and ``.log``, no base twice in a place."""
    import pyarrow.fs

    system, root = _system(folder)
    found = [f for f in system.get_file_info(pyarrow.fs.FileSelector(root, recursive=True)) if f.type == pyarrow.fs.FileType.File]
    out = sorted((f.path, int(f.base_name[:20]), f.size) for f in found if _NAME.fullmatch(f.base_name))
    if any(base > OFFSET_MOST for _, base, _ in out):
        raise Corrupt("the name of a segment exceeds all offsets")
    return out


class _File(InputPartition):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size


BATCHES = "topic_id string, partition int, segment_base long, batch_base long, position long, bytes long, records long, max_ts long"


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.folder, self.strict, self.what = options["path"], options.get("mode", "strict") == "strict", options.get("read", "records")
        self.low, self.high = int(options.get("low", 0)), int(options.get("high", OFFSET_MOST))

    def partitions(self):
        """A file each, without those whose offsets all lie outside [low, high)."""
        files = segment_files(self.folder)
        follows = {}
        for (path, _, _), (after, base, _) in zip(files, files[1:], strict=False):
            if path.rsplit("/", 1)[0] == after.rsplit("/", 1)[0]:
                follows[path] = base
        return [_File(p, n) for p, base, n in files if base < self.high and follows.get(p, OFFSET_MOST) > self.low] or [_File("", 0)]

    def read(self, partition):
        if not partition.path:
            return
        system, _ = _system(self.folder)
        with system.open_input_file(partition.path) as f:
            own = decode_segment_header(f.read(SEGMENT_BYTES))
            for at, head, rows in scan_segment(f, partition.size, self.strict, self.low, self.high, self.what == "records"):
                if self.what == "batches":
                    yield own.topic_id, own.part, own.base, head.base, at, head.bytes, head.records, head.max_ts
                    continue
                rows = [r for r in rows if self.low <= r["offset"] < self.high]
                headers = pa.array([[(h["name"], h["value"]) for h in r["headers"]] for r in rows], pa.list_(pa.struct([("name", pa.string()), ("value", pa.binary())])))
                columns = [pa.array([r[c] for r in rows], t) for c, t in (("offset", pa.int64()), ("timestamp_ms", pa.int64()), ("key", pa.binary()), ("value", pa.binary()))]
                yield pa.RecordBatch.from_arrays([pa.array([own.topic_id] * len(rows)), pa.array([own.part] * len(rows), pa.int32()), *columns, headers], names=RECORD.names)


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class _Writer(DataSourceArrowWriter):
    """Tasks write files under names of their own; the commit gives them their names, so no reader sees part of one."""

    def __init__(self, options):
        self.folder = options["path"]
        self.records, self.size, self.segment = int(options.get("batch_records", 1024)), int(options.get("batch_bytes", 4 << 20)), int(options.get("segment_bytes", 64 << 20))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        system, root = _system(self.folder)
        files: list[tuple[str, str]] = []
        state = {"key": None, "file": None, "bytes": 0, "rows": [], "size": 0}

        def flush() -> None:
            rows = state["rows"]
            if not rows:
                return
            data, (topic, part) = encode_batch(rows), state["key"]
            if state["file"] is None or state["bytes"] + len(data) > self.segment and state["bytes"] > SEGMENT_BYTES:
                close()
                base = rows[0]["offset"]
                place = f"{root}/{topic}-{part}"
                system.create_dir(place, recursive=True)
                files.append((f"{place}/{base:020d}.log.{uuid.uuid4().hex}", f"{place}/{base:020d}.log"))
                state["file"] = system.open_output_stream(files[-1][0])
                state["bytes"] = state["file"].write(Segment(topic, part, base, segment_id(topic, part, base)).encode())
            state["bytes"] += state["file"].write(data)
            state["rows"], state["size"] = [], 0

        def close() -> None:
            if state["file"] is not None:
                state["file"].close()
                state["file"] = None

        for b in iterator:
            for row in b.to_pylist():
                own = {"offset": row["offset"], "timestamp_ms": row["timestamp_ms"], "key": row["key"], "value": row["value"], "headers": row["headers"] or []}
                key, size = (row["topic_id"], row["partition"]), len(encode_record(own, row["offset"]))
                if key != state["key"]:
                    flush()
                    close()
                    state["key"] = key
                elif len(state["rows"]) == self.records or state["rows"] and state["size"] + size + BATCH_BYTES + TRAILER_BYTES > self.size:
                    flush()
                state["rows"].append(own)
                state["size"] += size
        flush()
        close()
        return _Written(files)

    def commit(self, messages) -> None:
        system, _ = _system(self.folder)
        for m in messages:
            for temporary, name in m.files if m else []:
                system.move(temporary, name)

    def abort(self, messages) -> None:
        system, _ = _system(self.folder)
        for m in messages:
            for temporary, _name in m.files if m else []:
                system.delete_file(temporary)


class SegmentSource(DataSource):
    """``spark.read.format("offsetlake_segments").load(folder)`` and ``df.write.format(...).mode("append").save(folder)``.

    Reading: a task a file, a batch in memory at a time; ``mode`` 'strict' or 'tail'
    (drops a last batch that is cut short), ``low`` and ``high`` bound the offsets,
    ``read`` 'records' or 'batches' (their headers alone). Writing takes rows of
    :data:`RECORD` in order of topic, partition and offset, a partition in one task
    (:func:`write_segments` sees to it).
    """

    @classmethod
    def name(cls) -> str:
        return "offsetlake_segments"

    def schema(self):
        return BATCHES if self.options.get("read") == "batches" else RECORD

    def reader(self, schema):
        return _Reader(self.options)

    def writer(self, schema, overwrite):
        if overwrite:
            raise InvalidArgument("segments are only appended")
        return _Writer(self.options)


def write_segments(records: DataFrame, folder: str, **limits: int) -> None:
    """Writes rows of :data:`RECORD` as segment files; ``limits``: batch_records, batch_bytes, segment_bytes."""
    records.sparkSession.dataSource.register(SegmentSource)
    rows = records.select(*RECORD.names).repartition("topic_id", "partition").sortWithinPartitions("topic_id", "partition", "offset")
    rows.write.format("offsetlake_segments").options(**limits).mode("append").save(folder)


def read_segments(spark: SparkSession, folder: str, **options) -> DataFrame:
    spark.dataSource.register(SegmentSource)
    return spark.read.format("offsetlake_segments").options(**options).load(folder)


def preflight(spark: SparkSession, folder: str) -> DataFrame:
    """What every segment file holds and what is wrong with it; nothing is repaired.

    A row a file: ``path``, ``topic_id``, ``partition``, ``base``, ``end``, ``batches``,
    ``records``, ``bytes`` read as valid, ``problem`` (empty if none) and ``kind``:
    'corrupt', 'unsupported', 'tail' (a last batch cut short, which may be dropped) or
    'misplaced' (the name or folder says something else than the header).
    """
    files = spark.createDataFrame(segment_files(folder), "path string, named long, size long")

    def run(frames):
        system, _ = _system(folder)
        for b in frames:
            for path, named, size in zip(*(c.to_pylist() for c in b.columns), strict=True):
                row = {"path": path, "topic_id": None, "partition": None, "base": None, "end": None, "batches": 0, "records": 0, "bytes": 0, "problem": "", "kind": ""}
                with system.open_input_file(path) as f:
                    try:
                        own = decode_segment_header(f.read(SEGMENT_BYTES))
                        row |= {"topic_id": own.topic_id, "partition": own.part, "base": own.base, "end": own.base, "bytes": SEGMENT_BYTES}
                        if own.base != named or path.split("/")[-2] != f"{own.topic_id}-{own.part}":
                            row |= {"problem": "the name is not that of the header", "kind": "misplaced"}
                        for at, head, _rows in scan_segment(f, size, strict=False):
                            row |= {"end": head.base + head.records, "batches": row["batches"] + 1, "records": row["records"] + head.records, "bytes": at + head.bytes}
                        if row["bytes"] < size:
                            row |= {"problem": f"the batch at {row['bytes']} is cut short", "kind": "tail"}
                    except Unsupported as error:
                        row |= {"problem": str(error), "kind": "unsupported"}
                    except Corrupt as error:
                        row |= {"problem": str(error), "kind": "corrupt"}
                yield pa.RecordBatch.from_pylist([row], schema=_REPORT)

    kinds = "path string, topic_id string, partition int, base long, end long, batches long, records long, bytes long, problem string, kind string"
    return files.repartition(max(1, min(len(segment_files(folder)), 1000))).mapInArrow(run, kinds)


_REPORT = pa.schema([("path", pa.string()), ("topic_id", pa.string()), ("partition", pa.int32()), *((c, pa.int64()) for c in ("base", "end", "batches", "records", "bytes")), ("problem", pa.string()), ("kind", pa.string())])


def encode_index(store_id: str, segment: Segment, entries: list[dict], by_time: bool = False, stride: int = 4096) -> bytes:
    """An index file: entries (``base``, ``position``, ``bytes``, ``records``, and ``prefix_max`` by time) of a segment's batches."""
    size = _BY_TIME.size if by_time else _BY_OFFSET.size
    head = _INDEX.pack(INDEX_MAGIC, VERSION, _INDEX.size, 1 + by_time, size, 0, 0, bytes.fromhex(store_id), bytes.fromhex(segment.topic_id), segment.part, 0, bytes.fromhex(segment.id), segment.base, bytes.fromhex(segment.header_hash()), stride, 0)
    out = [head[:-4] + _U32.pack(crc32c(head[:-4]))]
    for e in entries:
        body = _BY_TIME.pack(e["prefix_max"], e["base"], e["position"], e["bytes"], e["records"], 0, 0) if by_time else _BY_OFFSET.pack(e["base"], e["position"], e["bytes"], e["records"], 0, 0)
        out.append(body[:-4] + _U32.pack(crc32c(body[:-4])))
    return b"".join(out)


def decode_index(data: bytes, store_id: str, segment: Segment) -> list[dict]:
    """Entries of an index file, which has to be the given segment's; raises :class:`Corrupt` for anything else."""
    if len(data) < _INDEX.size:
        raise Corrupt("an index header is cut short")
    magic, version, head, kind, size, zero, zero2, store, topic, part, zero3, own, base, hashed, stride, crc = _INDEX.unpack_from(data)
    if magic != INDEX_MAGIC or head != _INDEX.size or crc != crc32c(data[: _INDEX.size - 4]) or zero or zero2 or zero3:
        raise Corrupt("an index header is wrong")
    if version != VERSION or kind not in (1, 2):
        raise Unsupported(f"index version {version} of kind {kind}")
    layout = _BY_OFFSET if kind == 1 else _BY_TIME
    if size != layout.size or not stride or (len(data) - head) % size:
        raise Corrupt("an index has entries of another size")
    if (store.hex(), Segment(topic.hex(), part, base, own.hex()), hashed.hex()) != (store_id, segment, segment.header_hash()):
        raise Corrupt("an index of another segment")
    out = []
    for at in range(head, len(data), size):
        *fields, zero, crc = layout.unpack_from(data, at)
        if zero or crc != crc32c(data[at : at + size - 4]):
            raise Corrupt(f"the index entry at {at} is wrong")
        out.append(dict(zip(("base", "position", "bytes", "records") if kind == 1 else ("prefix_max", "base", "position", "bytes", "records"), fields, strict=True)))
    return out


def index_table(batches: DataFrame, stride: int) -> DataFrame:
    """Sampled index entries of batches as read with ``read`` 'batches', with the greatest time of all batches up to each."""
    from pyspark.sql import Window

    from ..operators import packing

    place = F.struct("topic_id", "partition", "segment_base")
    rows = batches.withColumn("prefix_max", F.max("max_ts").over(Window.partitionBy("topic_id", "partition", "segment_base").orderBy("batch_base")))
    sampled = packing.sample_index(rows.withColumn("part", F.xxhash64(place)).drop("position"), stride).where("sampled")
    return sampled.select("topic_id", "partition", "segment_base", F.col("batch_base").alias("base"), "position", "bytes", "records", "prefix_max")
