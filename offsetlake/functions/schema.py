"""Types, limits and errors of an append-only, partitioned log."""

from __future__ import annotations

from pyspark.sql import types as T

HEADER = T.StructType([T.StructField("name", T.StringType(), False), T.StructField("value", T.BinaryType())])

#: The record envelope. Keys, values and header values may be null, which is not the same as empty;
#: headers are an ordered list, names may repeat.
RECORD = T.StructType([
    T.StructField("topic_id", T.StringType(), False),
    T.StructField("partition", T.IntegerType(), False),
    T.StructField("offset", T.LongType(), False),
    T.StructField("timestamp_ms", T.LongType(), False),
    T.StructField("key", T.BinaryType()),
    T.StructField("value", T.BinaryType()),
    T.StructField("headers", T.ArrayType(HEADER)),
])

#: Limits of one topic's partitions.
CONFIG = T.StructType([
    T.StructField("record_bytes", T.LongType()),
    T.StructField("batch_bytes", T.LongType()),
    T.StructField("batch_records", T.IntegerType()),
    T.StructField("segment_bytes", T.LongType()),
    T.StructField("linger_ms", T.LongType()),
    T.StructField("retention_mask", T.IntegerType()),
    T.StructField("retention_ms", T.LongType()),
    T.StructField("retention_bytes", T.LongType()),
    T.StructField("segment_age_ms", T.LongType()),
    T.StructField("check_interval_ms", T.LongType()),
])

# Fixed values of the format and of its limits.
RECORD_FIXED = 28
FIELD_LENGTH = 4
HEADER_FIXED = 8
BATCH_FIXED = 52
SEGMENT_HEADER = 72
FETCH_RECORDS, FETCH_RECORDS_MOST = 1024, 65_536
FETCH_BYTES, FETCH_BYTES_MOST = 4 << 20, 64 << 20
RETIRED_MOST = 65_536
DIAGNOSTICS_MOST = 1024
CHECK_INTERVAL_MS = 3_600_000
BY_TIME, BY_SIZE = 1, 2


class LogError(Exception):
    """Any error about a log."""


class InvalidArgument(LogError):
    """An argument is outside its limits."""


class OffsetOutOfRange(LogError):
    """The offset is below the start or above the end of the log."""


class RecordTooLarge(LogError):
    """A record or batch exceeds its limit."""


class FetchLimitTooSmall(RecordTooLarge):
    """The first record alone exceeds the limit of a fetch."""


class TopicExists(LogError):
    """The name is taken."""


class TopicNotFound(LogError):
    """No topic has this name."""


class PartitionUnavailable(LogError):
    """A partition does not agree with its catalog, or a write to it failed half-way."""


class MetadataUnavailable(LogError):
    """The catalog cannot be changed any more before it is opened again."""


class GroupUnavailable(LogError):
    """The history of groups cannot be changed any more before it is opened again."""


class AppendOutcomeUnknown(LogError):
    """A write of records failed and may have happened."""


class MetadataOutcomeUnknown(MetadataUnavailable):
    """A write to the catalog failed and may have happened."""


class CommitOutcomeUnknown(GroupUnavailable):
    """A write to the history of groups failed and may have happened."""


class Corrupt(LogError):
    """Bytes or events contradict each other."""


class Unsupported(LogError):
    """A version or flag this code does not know."""


class AssignmentLost(LogError):
    """Another session has taken over the assignment."""


class CommitRegression(LogError):
    """A commit lies below the committed offset."""


class InvalidCommit(CommitRegression):
    """A commit lies above what was delivered, or above the end."""


class ConcurrentOperation(LogError):
    """The handle is busy with another call."""


class ResourceLimit(LogError):
    """A number of topics, partitions, groups or keys is at its limit."""


class HistoryFull(ResourceLimit):
    """The history of the catalog or of groups has used up its bytes."""


class Backpressure(ResourceLimit):
    """More records are offered at a time than may wait."""


class DiskPressure(ResourceLimit):
    """Too little space is left to write."""


class Closed(InvalidArgument):
    """The handle or store is closed."""


class StoreLocked(LogError):
    """Another process has the store open."""
