"""Consumers: assignments, commits and lag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import distance


def lag(progress: DataFrame, ends: DataFrame) -> DataFrame:
    """Lag of each (group_id, part) with ``delivered`` and ``committed``, as distances in offsets that stop at zero."""
    met = progress.join(ends.select("part", "low", "high"), "part")
    return met.select("group_id", "part", "low", "high", "delivered", "committed", distance(F.col("high"), F.col("delivered")).alias("delivery_lag"), distance(F.col("high"), F.col("committed")).alias("commit_lag"), distance(F.col("low"), F.col("committed")).alias("expired"))


def assign(members: DataFrame, parts: DataFrame) -> DataFrame:
    """Partitions dealt to members in order, one after another: ``member``, ``part``.

    Both are small (a group's membership and one topic's partitions); they are put
    in order as arrays of one row, and joined by position.
    """
    names = members.agg(F.array_sort(F.collect_set("member")).alias("names"))
    every = parts.agg(F.array_sort(F.collect_set("part")).alias("parts"))
    dealt = names.join(every, F.lit(True)).select("names", F.posexplode("parts").alias("i", "part"))
    return dealt.where(F.size("names") > 0).select(F.get("names", (F.col("i") % F.size("names")).cast("int")).alias("member"), "part")


def snapshots(subscriptions: DataFrame, most_members: int = 4096, most_keys: int = 65_536) -> DataFrame:
    """Each group's members in canonical order, from rows (``group_id``, ``member``, ``topic_id``, ``part``).

    ``members`` is an array of arrays of keys, both in order; ``problem`` says what
    refuses the group: 'repeated' (a member has a key twice), 'overlap' (two have one),
    'too many', or nothing. Keys are counted before they are gathered, and only groups
    within the limits are.
    """
    key = F.struct("topic_id", "part")
    times = subscriptions.groupBy("group_id", "member", "topic_id", "part").agg(F.count(F.lit(1)).alias("times"))
    shared = times.groupBy("group_id", "topic_id", "part").agg(F.count(F.lit(1)).alias("owners"), F.max("times").alias("times"), F.sum("times").alias("n"))
    flags = shared.groupBy("group_id").agg((F.max("times") > 1).alias("repeated"), (F.max("owners") > 1).alias("overlap"), F.sum("n").alias("keys"))
    members = times.groupBy("group_id").agg(F.count_distinct("member").alias("n_members"))
    judged = flags.join(members, "group_id").withColumn("problem", F.when((F.col("n_members") > most_members) | (F.col("keys") > most_keys), "too many").when(F.col("repeated"), "repeated").when(F.col("overlap"), "overlap").otherwise(""))
    whole = times.join(judged.where("problem <> 'too many'").select("group_id"), "group_id", "left_semi")
    each = whole.groupBy("group_id", "member").agg(F.array_sort(F.collect_list(key)).alias("keys"))
    ordered = each.groupBy("group_id").agg(F.array_sort(F.collect_list("keys")).alias("members"))
    return judged.join(ordered, "group_id", "left").select("group_id", "n_members", "keys", "problem", "members")


def assignment_reason(first: Column, expired: Column, active: Column) -> Column:
    """Why a generation begins: 1 the first, 4 the one before expired, 3 it was active and is replaced, 5 it is opened again."""
    return F.when(first, 1).when(expired, 4).when(active, 3).otherwise(5)


def expired_sessions(heartbeats: DataFrame, now_ms: int, timeout_ms: int) -> DataFrame:
    """Sessions without progress for ``timeout_ms`` that no operation protects: (session, at_ms, busy)."""
    last = heartbeats.groupBy("session").agg(F.max("at_ms").alias("last_ms"), F.max_by("busy", "at_ms").alias("busy"))
    return last.where(~F.col("busy") & (F.lit(now_ms) - F.col("last_ms") >= timeout_ms)).select("session", "last_ms")


def unknown_owners(assignments: DataFrame, members: DataFrame) -> DataFrame:
    """Assignments whose owner is no member."""
    return assignments.join(members.select(F.col("member").alias("owner")), "owner", "left_anti")
