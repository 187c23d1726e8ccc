"""System events, version 1: their binary form and their columns.

An event is the value of a record without key and headers: an envelope of 16 bytes
and a body. A body is described as a list of fields, and one pair of functions writes
and reads them all. What a field alone cannot say (order, owners, chains) is checked
by :mod:`..operators.history` over columns and by :mod:`..operators.groups` as state.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.schema import CONFIG, Corrupt, InvalidArgument, Unsupported

# Fixed values of the format.
EVENT_MAGIC, EVENT_VERSION = b"IELE", 1
TOPIC_CREATED, START_ADVANCED, GROUP_CREATED, ASSIGNED, COMMITTED, INITIALIZED = 1, 2, 3, 4, 5, 6
CATALOG_TYPES, OFFSETS_TYPES = (INITIALIZED, TOPIC_CREATED, START_ADVANCED), (GROUP_CREATED, ASSIGNED, COMMITTED)
CATALOG_ID, OFFSETS_ID = f"{1:032x}", f"{2:032x}"
NAME_MOST, GROUP_MOST, PARTITIONS_MOST, MEMBERS_MOST, KEYS_MOST = 249, 255, 65_536, 4096, 65_536
_ENVELOPE = struct.Struct("<4sHHII")
# version, size, record bytes, batch bytes, batch records, segment bytes, linger ms, mask, 0, 0, retention ms, retention bytes, segment age ms, check interval ms
_CONFIG = struct.Struct("<HHIIIQIBBHQQQQ")
_CONFIG_FIELDS = ("record_bytes", "batch_bytes", "batch_records", "segment_bytes", "linger_ms", "retention_mask", "retention_ms", "retention_bytes", "segment_age_ms", "check_interval_ms")

_KEY = [("topic_id", "id"), ("part", "u32")]
_HEAD = [("store_id", "id"), ("catalog_next", "u64"), ("group_id", ("text", GROUP_MOST))]
BODIES: dict[int, list] = {
    INITIALIZED: [("store_id", "id"), ("catalog_anchor", "anchor"), ("offsets_anchor", "anchor"), ("catalog_config", "config"), ("offsets_config", "config")],
    TOPIC_CREATED: [("store_id", "id"), ("expected_next", "u64"), ("topic_id", "id"), ("name", ("text", NAME_MOST)), ("partitions", [("part", "u32"), ("config", "config"), ("anchor", "anchor")])],
    START_ADVANCED: [
        ("store_id", "id"), ("expected_next", "u64"), *_KEY, ("old_low", "u64"), ("new_low", "u64"), ("durable_end", "u64"), ("anchor", "anchor"), ("reason_mask", "u8"), ("at_ms", "i64"), ("retained_bytes", "u64"),
        ("retired", [("base", "u64"), ("end", "u64"), ("bytes", "u64"), ("anchor", "anchor")]),
    ],
    GROUP_CREATED: [*_HEAD, ("start_mode", "u8"), ("starts", [*_KEY, ("next", "u64")])],
    ASSIGNED: [
        *_HEAD, ("instance", "id"), ("expected_generation", "u64"), ("new_generation", "u64"), ("reason", "u8"), ("members", [("session", "id"), ("keys", _KEY)]),
        ("assignments", [*_KEY, ("owner", "id"), ("resume", "u64"), ("baseline", "u8"), ("initial", "u64")]),
    ],
    COMMITTED: [*_HEAD, ("instance", "id"), ("session", "id"), ("generation", "u64"), *_KEY, ("previous_kind", "u8"), ("expected_previous", "u64"), ("next", "u64")],
}
_NUMBERS = {"u32": struct.Struct("<I"), "u64": struct.Struct("<Q"), "i64": struct.Struct("<q"), "u8": struct.Struct("<B3x")}  # a byte has three zeros behind it


def belongs(event_type: Column, log: str) -> Column:
    """Whether events of a type stand in the log 'catalog' or 'offsets'."""
    return event_type.isin(*(CATALOG_TYPES if log == "catalog" else OFFSETS_TYPES))


def config_problems(c: dict, system: bool = False) -> list[str]:
    """Limits of a partition's configuration that it breaks; none for one that may be used."""
    mask = c["retention_mask"]
    wrong = {
        "record_bytes": not 28 <= c["record_bytes"] <= 16 << 20,
        "batch_bytes": not 80 <= c["batch_bytes"] <= 64 << 20 or c["record_bytes"] + 52 > c["batch_bytes"],
        "batch_records": not 0 < c["batch_records"] <= 65_536,
        "segment_bytes": not 72 + c["batch_bytes"] <= c["segment_bytes"] < 1 << 63,
        "retention_mask": mask & ~3 != 0 or system and mask != 0,
        "check_interval_ms": (mask == 0) != (c["check_interval_ms"] == 0),
        "segment_age_ms": mask & 1 != 0 and c["segment_age_ms"] == 0,
        "retention_ms": mask & 1 == 0 and c["retention_ms"] != 0,
        "retention_bytes": mask & 2 == 0 and c["retention_bytes"] != 0 or c["retention_bytes"] >= 1 << 63,
        "durations": any(c[k] > ((1 << 63) - 1) // 1_000_000 for k in ("retention_ms", "segment_age_ms", "check_interval_ms")),
    }
    return [k for k, bad in wrong.items() if bad]


def config_reasons(config: Column, system: bool = False) -> Column:
    """As :func:`config_problems`, for a column of configurations: an array of names."""
    c, mask = config, config["retention_mask"]
    wrong = {
        "record_bytes": ~c["record_bytes"].between(28, 16 << 20),
        "batch_bytes": ~c["batch_bytes"].between(80, 64 << 20) | (c["record_bytes"] + 52 > c["batch_bytes"]),
        "batch_records": ~c["batch_records"].between(1, 65_536),
        "segment_bytes": c["segment_bytes"] < 72 + c["batch_bytes"],
        "retention_mask": (mask.bitwiseAND(F.lit(~3)) != 0) | (F.lit(system) & (mask != 0)),
        "check_interval_ms": (mask == 0) != (c["check_interval_ms"] == 0),
        "segment_age_ms": (mask.bitwiseAND(F.lit(1)) != 0) & (c["segment_age_ms"] == 0),
        "retention_ms": (mask.bitwiseAND(F.lit(1)) == 0) & (c["retention_ms"] != 0),
        "retention_bytes": (mask.bitwiseAND(F.lit(2)) == 0) & (c["retention_bytes"] != 0),
        "durations": F.greatest(c["retention_ms"], c["segment_age_ms"], c["check_interval_ms"]) > ((1 << 63) - 1) // 1_000_000,
    }
    return F.filter(F.array(*(F.when(bad, F.lit(k)) for k, bad in wrong.items())), lambda k: k.isNotNull())


def _write(fields: list, row: dict, out: list[bytes]) -> None:
    for name, kind in fields:
        value = row[name]
        if isinstance(kind, list):
            out.append(_NUMBERS["u32"].pack(len(value)))
            for item in value:
                _write(kind, item, out)
        elif kind == "id":
            data = bytes.fromhex(value)
            if len(data) != 16 or not any(data):
                raise InvalidArgument(f"{name} is no identity")
            out.append(data)
        elif kind == "anchor":
            data, hashed = bytes.fromhex(value["id"]), bytes.fromhex(value["hash"])
            if len(data) != 16 or len(hashed) != 32 or not any(data) or not any(hashed):
                raise InvalidArgument(f"{name} is no anchor")
            out += [data, hashed]
        elif kind == "config":
            if wrong := config_problems(value):
                raise InvalidArgument(f"{name}: {', '.join(wrong)}")
            head, tail = [value[f] for f in _CONFIG_FIELDS[:6]], [value[f] for f in _CONFIG_FIELDS[6:]]
            out.append(_CONFIG.pack(1, _CONFIG.size, *head, 0, 0, *tail))
        elif isinstance(kind, tuple):
            data = value.encode()
            if not 0 < len(data) <= kind[1] or b"\0" in data:
                raise InvalidArgument(f"{name} is empty, too long or has a NUL")
            out += [_NUMBERS["u32"].pack(len(data)), data]
        else:
            try:
                out.append(_NUMBERS[kind].pack(value))
            except struct.error as error:
                raise InvalidArgument(f"{name} is {value}") from error


def encode(event: dict) -> bytes:
    """The value of a record for an event (``event_type`` and the fields of its body)."""
    kind = event["event_type"]
    if kind not in BODIES:
        raise InvalidArgument(f"event type {kind}")
    out: list[bytes] = []
    _write(BODIES[kind], event, out)
    body = b"".join(out)
    return _ENVELOPE.pack(EVENT_MAGIC, kind, EVENT_VERSION, len(body), 0) + body


def _take(data: bytes, at: int, n: int) -> tuple[bytes, int]:
    if at + n > len(data):
        raise Corrupt("an event is cut short")
    return data[at : at + n], at + n


def _read(fields: list, data: bytes, at: int) -> tuple[dict, int]:
    row: dict = {}
    for name, kind in fields:
        if isinstance(kind, list):
            raw, at = _take(data, at, 4)
            n = _NUMBERS["u32"].unpack(raw)[0]
            if n > KEYS_MOST:
                raise Corrupt(f"{n} {name}")
            row[name] = []
            for _ in range(n):
                item, at = _read(kind, data, at)
                row[name].append(item)
        elif kind == "id":
            raw, at = _take(data, at, 16)
            if not any(raw):
                raise Corrupt(f"{name} is zero")
            row[name] = raw.hex()
        elif kind == "anchor":
            raw, at = _take(data, at, 48)
            if not any(raw[:16]) or not any(raw[16:]):
                raise Corrupt(f"{name} is zero")
            row[name] = {"id": raw[:16].hex(), "hash": raw[16:].hex()}
        elif kind == "config":
            raw, at = _take(data, at, _CONFIG.size)
            version, size, *rest = _CONFIG.unpack(raw)
            if version != 1:
                raise Unsupported(f"configuration version {version}")
            if size != _CONFIG.size or rest[6] or rest[7]:
                raise Corrupt(f"{name} is wrong")
            row[name] = dict(zip(_CONFIG_FIELDS, rest[:6] + rest[8:], strict=True))
            if wrong := config_problems(row[name]):
                raise Corrupt(f"{name}: {', '.join(wrong)}")
        elif isinstance(kind, tuple):
            raw, at = _take(data, at, 4)
            n = _NUMBERS["u32"].unpack(raw)[0]
            if not 0 < n <= kind[1]:
                raise Corrupt(f"{name} has {n} bytes")
            raw, at = _take(data, at, n)
            try:
                row[name] = raw.decode()
            except UnicodeDecodeError as error:
                raise Corrupt(f"{name} is no text") from error
            if "\0" in row[name]:
                raise Corrupt(f"{name} has a NUL")
        else:
            raw, at = _take(data, at, _NUMBERS[kind].size)
            row[name] = _NUMBERS[kind].unpack(raw)[0]
            if kind == "u8" and any(raw[1:]):
                raise Corrupt(f"bytes behind {name} are not zero")
            if kind in ("u32", "u64") and row[name] > (1 << 31) - 1 + (kind == "u64") * ((1 << 63) - (1 << 31)):
                raise Corrupt(f"{name} is {row[name]}")
    return row, at


def decode(value: bytes, log: str | None = None) -> dict:
    """The event of a record's value; ``log`` ('catalog' or 'offsets') is where it stands."""
    if len(value) < _ENVELOPE.size or value[:4] != EVENT_MAGIC:
        raise Corrupt("no event")
    _, kind, version, size, flags = _ENVELOPE.unpack_from(value)
    if not kind or not version:
        raise Corrupt("an event without type or version")
    if version != EVENT_VERSION or flags:
        raise Unsupported(f"event version {version} with flags {flags}")
    if size != len(value) - _ENVELOPE.size:
        raise Corrupt("an event's length is wrong")
    if kind not in BODIES:
        raise Unsupported(f"event type {kind}")
    if log is not None and kind not in (CATALOG_TYPES if log == "catalog" else OFFSETS_TYPES):
        raise Corrupt("an event of another log")
    row, at = _read(BODIES[kind], value, _ENVELOPE.size)
    if at != len(value):
        raise Corrupt("bytes behind an event")
    return {"event_type": kind, **row}


_ANCHOR = pa.struct([("id", pa.string()), ("hash", pa.string())])
_CONFIG_ARROW = pa.struct([(f.name, {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32()}[f.dataType.simpleString()]) for f in CONFIG])
_ARROW = {"id": pa.string(), "u32": pa.int32(), "u64": pa.int64(), "i64": pa.int64(), "u8": pa.int32(), "anchor": _ANCHOR, "config": _CONFIG_ARROW}


def _arrow(kind) -> pa.DataType:
    if isinstance(kind, list):
        return pa.list_(pa.struct([(n, _arrow(k)) for n, k in kind]))
    return pa.string() if isinstance(kind, tuple) else _ARROW[kind]


def arrow_schema(log: str) -> pa.Schema:
    """Columns of a log's events: the fields of all its types, ``problem`` for one that cannot be read."""
    fields = {n: _arrow(k) for t in (CATALOG_TYPES if log == "catalog" else OFFSETS_TYPES) for n, k in BODIES[t]}
    return pa.schema([("offset", pa.int64()), ("event_type", pa.int32()), *fields.items(), ("problem", pa.string())])


def events(records: DataFrame, log: str) -> DataFrame:
    """Events of the log 'catalog' or 'offsets' as typed columns, from its records (``offset``, ``value``).

    A row a record; one that is no event has its reason in ``problem`` and nulls.
    """
    from pyspark.sql.pandas.types import from_arrow_schema

    schema = arrow_schema(log)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for offset, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    rows.append({"offset": offset, **decode(value or b"", log)})
                except (Corrupt, Unsupported) as error:
                    rows.append({"offset": offset, "problem": str(error)})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return records.select(F.col("offset").cast("long"), "value").mapInArrow(run, from_arrow_schema(schema))
