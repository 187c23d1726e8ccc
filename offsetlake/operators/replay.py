"""Current state from histories of events, and checkpoints of it."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import Files


def latest(events: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """The last ``value`` of each key, by partial aggregation."""
    return events.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def topics(catalog: DataFrame) -> DataFrame:
    """Topics of a history of catalog events (:mod:`..sources.system`), each by its creation."""
    return catalog.where("event_type = 1").select("topic_id", "name", F.col("offset").alias("creation_offset"), F.size("partitions").alias("n_partitions"))


def log_starts(catalog: DataFrame) -> DataFrame:
    """Start, anchor and greatest recorded end of each partition: of the last event that advanced it, or of its topic's creation."""
    created = catalog.where("event_type = 1").select("topic_id", F.posexplode("partitions").alias("part", "p")).select("topic_id", "part", F.col("p.anchor").alias("first"))
    moved = catalog.where("event_type = 2").groupBy("topic_id", "part").agg(F.max_by(F.struct("new_low", "anchor"), "offset").alias("last"), F.max("durable_end").alias("durable_end"))
    met = created.join(moved, ["topic_id", "part"], "left")
    return met.select("topic_id", "part", F.coalesce("last.new_low", F.lit(0)).alias("low"), F.coalesce("last.anchor", "first").alias("anchor"), F.coalesce("durable_end", F.lit(0)).alias("durable_end"))


def revision_check(events: DataFrame, topics: DataFrame) -> DataFrame:
    """Events that refer to a topic that no catalog of their revision (``catalog_next``) has.

    ``topics``: ``topic``, ``creation``. A topic counts from the revision behind its
    creation on; topics nobody created count as never. The catalog is small and
    joins by broadcast where its size says so.
    """
    return events.join(topics, "topic", "left").where(F.col("creation").isNull() | (F.col("creation") + 1 > F.col("catalog_next")))


def usage(progress: DataFrame, starts: DataFrame) -> DataFrame:
    """Groups, and keys that have progress or an explicit start: one row."""
    keys = progress.select("group_id", "part").unionByName(starts.select("group_id", "part")).distinct()
    return keys.agg(F.count_distinct("group_id").alias("groups"), F.count(F.lit(1)).alias("keys"))


def commits_from(events: DataFrame) -> DataFrame:
    """Progress of groups: the last commit of a key, or the offset its first assignment began with."""
    keys = ["group_id", "topic_id", "part"]
    given = events.where("event_type = 4").select("group_id", F.col("offset").alias("at"), F.explode("assignments").alias("a"))
    begun = given.where("a.baseline = 1").groupBy("group_id", F.col("a.topic_id").alias("topic_id"), F.col("a.part").alias("part")).agg(F.max_by("a.initial", "at").alias("initial"))
    committed = events.where("event_type = 5").groupBy(*keys).agg(F.max_by("next", "offset").alias("committed"))
    return begun.join(committed, keys, "full_outer").select(*keys, F.coalesce("committed", "initial").alias("next"))


def assignments_from(events: DataFrame) -> DataFrame:
    """The current assignment of each group, a row a key: generation, instance and owner; a group that was closed has none."""
    last = events.where("event_type = 4").groupBy("group_id").agg(F.max_by(F.struct("new_generation", "instance", "assignments"), "offset").alias("l"))
    each = last.select("group_id", F.col("l.new_generation").alias("generation"), F.col("l.instance").alias("instance"), F.explode("l.assignments").alias("a"))
    return each.select("group_id", "generation", "instance", F.col("a.topic_id").alias("topic_id"), F.col("a.part").alias("part"), "a.owner", "a.resume")


def entry_counts(events: DataFrame) -> DataFrame:
    """Per group, the entries a saved projection of its history would have: explicit starts, members and keys."""
    last = events.where("event_type = 4").groupBy("group_id").agg(F.max_by(F.struct(F.size("members").alias("members"), F.size("assignments").alias("owners")), "offset").alias("l"))
    starts = events.where("event_type = 3").groupBy("group_id").agg(F.max(F.size("starts")).alias("starts"))
    keys = commits_from(events).groupBy("group_id").agg(F.count(F.lit(1)).alias("keys"))
    return starts.join(last, "group_id", "left").join(keys, "group_id", "left").select("group_id", "starts", F.coalesce("l.members", F.lit(0)).alias("members"), F.coalesce("l.owners", F.lit(0)).alias("owners"), F.coalesce("keys", F.lit(0)).alias("keys"))


def save_checkpoint(state: DataFrame, folder: str, covered_next: int) -> None:
    """Writes a new generation of a projection and then points the manifest at it.

    The manifest is one small file; readers go through it, so they see the old
    generation or the new one whole.
    """
    spark = state.sparkSession
    name = f"generation-{uuid.uuid4().hex}"
    state.write.parquet(f"{folder}/{name}")
    Files(spark, folder).swap("manifest.json", json.dumps({"generation": name, "covered_next": covered_next}).encode())


def load_checkpoint(spark: SparkSession, folder: str) -> tuple[DataFrame, int]:
    said = json.loads(Files(spark, folder).read("manifest.json"))
    return spark.read.parquet(f"{folder}/{said['generation']}"), said["covered_next"]


def resume(checkpoint: DataFrame, covered_next: int, events: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """A checkpointed :func:`latest` brought up to date with the events behind it; only those are scanned."""
    newer = latest(events.where(F.col(order) >= covered_next), keys, value, order)
    return checkpoint.withColumnRenamed(value, "_old").join(newer, keys, "full_outer").select(*keys, F.coalesce(value, "_old").alias(value))
