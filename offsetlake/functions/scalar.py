"""Column functions over record envelopes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .schema import BATCH_FIXED, FIELD_LENGTH, HEADER_FIXED, RECORD_FIXED


def length(c: Column) -> Column:
    """Bytes of a nullable field; a null one has none."""
    return F.coalesce(F.octet_length(c), F.lit(0)).cast("long")


def record_bytes(key: Column, value: Column, headers: Column | None = None) -> Column:
    """Encoded size of a record."""
    size = F.lit(RECORD_FIXED + 2 * FIELD_LENGTH) + length(key) + length(value)
    if headers is not None:
        each = F.aggregate(headers, F.lit(0).cast("long"), lambda n, h: n + HEADER_FIXED + length(h["name"]) + length(h["value"]))
        size = size + F.coalesce(each, F.lit(0))
    return size.cast("long")


def batch_bytes(records: Column) -> Column:
    """Encoded size of a batch, from the sum of its records' sizes."""
    return (records + BATCH_FIXED).cast("long")


def millis(ts: Column) -> Column:
    """Whole milliseconds since 1970, rounded down."""
    return F.unix_millis(ts.cast("timestamp"))


def valid_topic_name(c: Column) -> Column:
    """1 to 249 letters, digits, dots, underlines or dashes; neither ``.`` nor ``..`` nor with two underlines first."""
    return F.coalesce(c.rlike(r"^[A-Za-z0-9._-]{1,249}$") & ~c.isin(".", "..") & ~c.startswith("__"), F.lit(False))


def valid_text(c: Column, most: int) -> Column:
    """UTF-8 without NUL of at most ``most`` bytes."""
    return F.coalesce(F.is_valid_utf8(c.cast("string")) & (F.instr(c.cast("string"), chr(0)) == 0) & (F.octet_length(c) <= most), F.lit(False))


def elapsed_at_least(now: Column, then: Column, least: Column) -> Column:
    """Whether a time is known, not in the future, and long enough ago."""
    return F.coalesce(then.isNotNull() & (then <= now) & (now - then >= least), F.lit(False))


def distance(ahead: Column, behind: Column) -> Column:
    """How far an offset is ahead; never below zero."""
    return F.greatest(ahead - behind, F.lit(0)).cast("long")


def rate(units: Column, millis_: Column) -> Column:
    """Units a second; 0 where no time has passed."""
    return F.when(millis_ <= 0, F.lit(0.0)).otherwise(units * 1000.0 / millis_)


def start_position(mode: Column, low: Column, high: Column, explicit: Column) -> Column:
    """Where a consumer starts: the first offset, the end, or an explicit one inside; null if that is outside."""
    return F.when(mode == "earliest", low).when(mode == "latest", high).when(explicit.between(low, high), explicit)


def next_power_of_two(n: Column) -> Column:
    """The least power of two that is not below a whole number."""
    return F.when(n <= 1, F.lit(1).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(n - 1))))


def add_saturating(a: Column, b: Column) -> Column:
    """The sum of two longs, or the greatest long where it exceeds that."""
    return F.coalesce(F.try_add(a, b), F.when(a.isNotNull() & b.isNotNull(), F.lit((1 << 63) - 1)))


def valid_id(c: Column) -> Column:
    """32 hexadecimal digits in lower case, not all zero."""
    return F.coalesce(c.rlike("^[0-9a-f]{32}$") & (c != "0" * 32), F.lit(False))


def valid_offset_range(base: Column, count: Column) -> Column:
    """Whether ``count`` records from ``base`` on, one at least, stay within all offsets."""
    return F.coalesce((base >= 0) & (count > 0) & (count <= F.lit((1 << 63) - 1) - base), F.lit(False))


def record_reasons(bytes_: Column, headers: Column, config: Column) -> Column:
    """Limits of a configuration that a record breaks: an array of names."""
    names = F.exists(F.coalesce(headers, F.array().cast("array<struct<name:string,value:binary>>")), lambda h: h["name"].isNull() | (F.octet_length(h["name"]) > 65_535))
    return F.filter(F.array(F.when(bytes_ > config["record_bytes"], F.lit("record_bytes")), F.when(F.size(headers) > 1024, F.lit("headers")), F.when(names, F.lit("header name"))), lambda r: r.isNotNull())
