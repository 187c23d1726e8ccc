"""Whole histories of events checked as columns: each function gives a row for each thing that is wrong.

Events are those of :mod:`..sources.system` (:func:`~..sources.system.events`), or any
table with their columns. Problems are rows (``offset``, ``problem``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.system import ASSIGNED, CATALOG_TYPES, COMMITTED, GROUP_CREATED, INITIALIZED, KEYS_MOST, MEMBERS_MOST, OFFSETS_TYPES, START_ADVANCED, TOPIC_CREATED, config_reasons
from .integrity import canonical, previous, tiles


def _said(events: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """A row for each rule that an event breaks; a rule that is null is not broken."""
    broken = F.filter(F.array(*(F.when(bad, F.lit(name)) for name, bad in rules.items())), lambda r: r.isNotNull())
    return events.select("offset", F.explode(broken).alias("problem"))


def contiguous(events: DataFrame) -> DataFrame:
    """Events that do not stand behind the one before; the first stands at 0."""
    before = previous(events, [], "offset", "offset")
    return before.where(F.col("offset") != F.coalesce(F.col("before") + 1, F.lit(0))).select("offset", F.lit("gap").alias("problem"))


def offsets_shape(events: DataFrame) -> DataFrame:
    """What events of groups say that no event may say, each by itself."""
    kind = F.col("event_type")
    order = lambda a, f: canonical(F.transform(a, f))
    key = lambda k: F.struct(k["topic_id"], k["part"])
    keys = F.flatten(F.transform("members", lambda m: m["keys"]))
    owners = F.transform("assignments", lambda a: F.struct(a["topic_id"].alias("topic_id"), a["part"].alias("part"), a["owner"].alias("owner")))
    subscribed = F.flatten(F.transform("members", lambda m: F.transform(m["keys"], lambda k: F.struct(k["topic_id"].alias("topic_id"), k["part"].alias("part"), m["session"].alias("owner")))))
    created, assigned, committed = kind == GROUP_CREATED, kind == ASSIGNED, kind == COMMITTED
    return _said(events, {
        "placement": ~kind.isin(*OFFSETS_TYPES),
        "group name": F.coalesce(F.octet_length("group_id"), F.lit(0)) == 0,
        "start mode": created & (~F.col("start_mode").between(1, 3) | ((F.col("start_mode") == 3) != (F.size("starts") > 0))),
        "starts out of order": created & ~order("starts", key),
        "starts above limit": created & (F.size("starts") > KEYS_MOST),
        "generation step": assigned & (F.col("new_generation") != F.col("expected_generation") + 1),
        "reason": assigned & ~F.col("reason").between(1, 6),
        "members out of order": assigned & ~order("members", lambda m: m["session"]),
        "members above limit": assigned & (F.size("members") > MEMBERS_MOST),
        "subscriptions out of order": assigned & ~F.forall("members", lambda m: canonical(F.transform(m["keys"], key))),
        "key with two owners": assigned & (F.size(F.array_distinct(F.transform(keys, key))) != F.size(keys)),
        "assignments out of order": assigned & ~order("assignments", key),
        "owner without subscription": assigned & (F.size(F.array_except(owners, subscribed)) > 0),
        "keys left out": assigned & (F.size(F.array_except(subscribed, owners)) > 0),
        "baseline": assigned & F.exists("assignments", lambda a: ~a["baseline"].isin(0, 1) | ((a["baseline"] == 0) & (a["initial"] != 0)) | ((a["baseline"] == 1) & (a["initial"] != a["resume"]))),
        "commit kind": committed & ~F.col("previous_kind").isin(0, 1),
        "commit goes back": committed & (F.col("next") < F.col("expected_previous")),
    })


def keys_known(events: DataFrame, topics: DataFrame, revision: int | None = None) -> DataFrame:
    """Events that name a partition that the catalog of their revision does not have, or a revision that is not there yet.

    ``topics``: ``topic_id``, ``n_partitions``, ``creation_offset``.
    """
    one = F.array(F.struct("topic_id", "part"))
    pick = lambda a: F.transform(a, lambda k: F.struct(k["topic_id"].alias("topic_id"), k["part"].alias("part")))
    keys = F.when(F.col("event_type") == GROUP_CREATED, pick("starts")).when(F.col("event_type") == ASSIGNED, F.flatten(F.transform("members", lambda m: pick(m["keys"])))).otherwise(one)
    each = events.select("offset", "catalog_next", F.explode(keys).alias("k")).select("offset", "catalog_next", "k.*")
    met = each.join(topics, "topic_id", "left")
    known = F.col("n_partitions").isNotNull() & F.col("part").between(0, F.col("n_partitions") - 1) & (F.col("creation_offset") + 1 <= F.col("catalog_next"))
    out = met.where(~F.coalesce(known, F.lit(False))).select("offset").distinct().select("offset", F.lit("unknown partition").alias("problem"))
    if revision is not None:
        out = out.unionByName(events.where(~F.col("catalog_next").between(1, revision)).select("offset", F.lit("revision").alias("problem")))
    return out


def _steps(events: DataFrame) -> DataFrame:
    """What assignments and commits do to each key of each group, in one column layout."""
    given = events.where(F.col("event_type") == ASSIGNED).select("offset", "group_id", F.col("new_generation").alias("generation"), "instance", F.explode("assignments").alias("a"))
    given = given.select("offset", "group_id", "generation", "instance", F.col("a.topic_id").alias("topic_id"), F.col("a.part").alias("part"), F.col("a.owner").alias("session"), F.lit(0).alias("done"), (F.col("a.baseline") == 1).alias("fresh"), F.col("a.resume").alias("expected"), F.col("a.resume").alias("value"))
    done = events.where(F.col("event_type") == COMMITTED).select("offset", "group_id", "generation", "instance", "topic_id", "part", "session", F.lit(1).alias("done"), (F.col("previous_kind") == 0).alias("fresh"), F.col("expected_previous").alias("expected"), F.col("next").alias("value"))
    return given.unionByName(done)


def offsets_chains(events: DataFrame) -> DataFrame:
    """Events of groups that do not follow what came before: creations, generations, baselines, commits, owners."""
    start = events.where(F.col("event_type") == GROUP_CREATED).groupBy("group_id").agg(F.min("offset").alias("created"))
    known = events.join(start, "group_id", "left")
    twice = known.where((F.col("event_type") == GROUP_CREATED) & (F.col("offset") > F.col("created"))).select("offset", F.lit("group created twice").alias("problem"))
    orphan = known.where((F.col("event_type") != GROUP_CREATED) & (F.col("created").isNull() | (F.col("created") > F.col("offset")))).select("offset", F.lit("unknown group").alias("problem"))
    generations = previous(events.where(F.col("event_type") == ASSIGNED), ["group_id"], "offset", "new_generation")
    broken = generations.where(F.col("expected_generation") != F.coalesce("before", F.lit(0))).select("offset", F.lit("generation chain").alias("problem"))
    keys = ["group_id", "topic_id", "part"]
    steps = previous(_steps(events), keys, "offset", F.struct("value", "done"))
    before, had = F.col("before.value"), F.col("before").isNotNull()
    rules = {
        "baseline exists": (F.col("done") == 0) & F.col("fresh") & had,
        "baseline does not agree": (F.col("done") == 0) & ~F.col("fresh") & (~had | (before != F.col("expected"))),
        "commit without baseline": (F.col("done") == 1) & ~had,
        "commit does not agree": (F.col("done") == 1) & had & ((before != F.col("expected")) | (F.col("fresh") == (F.col("before.done") == 1))),
    }
    current = previous(events.where(F.col("event_type").isin(ASSIGNED, COMMITTED)).withColumn("at", F.when(F.col("event_type") == ASSIGNED, F.struct("new_generation", "instance"))), ["group_id"], "offset", "at")
    done = current.where(F.col("event_type") == COMMITTED)
    owned = _steps(events).where("done = 0").select("group_id", "topic_id", "part", "generation", F.col("session").alias("owner"))
    own = done.join(owned, [*keys, "generation"], "left")
    token = F.coalesce((F.col("before.new_generation") == F.col("generation")) & (F.col("before.instance") == F.col("instance")) & (F.col("owner") == F.col("session")), F.lit(False))
    lost = own.where(~token).select("offset", F.lit("commit by no owner").alias("problem"))
    return twice.unionByName(orphan).unionByName(broken).unionByName(_said(steps, rules)).unionByName(lost)


def catalog_problems(events: DataFrame, store_id: str) -> DataFrame:
    """Events of a catalog that are wrong by themselves or do not follow what came before."""
    kind = F.col("event_type")
    created, advanced = kind == TOPIC_CREATED, kind == START_ADVANCED
    parts = F.transform("partitions", lambda p: p["part"])
    retired = F.col("retired")
    ids = F.transform(retired, lambda r: r["anchor"]["id"])
    alone = _said(tiles(events), {
        "placement": ~kind.isin(*CATALOG_TYPES),
        "store": F.coalesce(F.col("store_id") != store_id, F.lit(True)),
        "initialized": (kind == INITIALIZED) != (F.col("offset") == 0),
        "revision": kind.isin(TOPIC_CREATED, START_ADVANCED) & (F.col("expected_next") != F.col("offset")),
        "partitions": created & ((F.size("partitions") == 0) | (parts != F.sequence(F.lit(0), F.size("partitions") - 1))),
        "configuration": created & F.exists("partitions", lambda p: F.size(config_reasons(p["config"])) > 0),
        "start": advanced & ~((F.col("old_low") < F.col("new_low")) & (F.col("new_low") <= F.col("durable_end"))),
        "reason": advanced & ~F.col("reason_mask").between(1, 3),
        "tiles": advanced & ~F.col("tiles"),
        "retired twice": advanced & (F.size(F.array_distinct(ids)) != F.size(ids)),
        "retired anchor": advanced & F.array_contains(ids, F.col("anchor.id")),
    })
    topics = events.where(created)
    repeated = [previous(topics, [c], "offset", "offset").where("before is not null").select("offset", F.lit(f"{c} twice").alias("problem")) for c in ("name", "topic_id")]
    whole = topics.groupBy("topic_id").agg(F.min("offset").alias("offset"), F.min_by("partitions", "offset").alias("partitions"))
    each = whole.select("topic_id", F.col("offset").alias("creation_offset"), F.explode("partitions").alias("p")).select("topic_id", "creation_offset", F.col("p.part").alias("part"), F.col("p.config.retention_mask").alias("mask"), F.col("p.anchor").alias("first"))
    moves = previous(events.where(advanced), ["topic_id", "part"], "offset", F.struct("new_low", "anchor", "durable_end")).join(each, ["topic_id", "part"], "left")
    follows = _said(moves, {
        "unknown partition": F.col("first").isNull() | (F.col("creation_offset") > F.col("offset")),
        "start chain": F.col("old_low") != F.coalesce("before.new_low", F.lit(0)),
        "anchor chain": ~F.get(retired, 0)["anchor"].eqNullSafe(F.coalesce(F.col("before.anchor"), F.col("first"))),
        "end goes back": F.col("durable_end") < F.col("before.durable_end"),
        "reason not enabled": F.col("reason_mask").bitwiseAND(F.bitwise_not("mask")) != 0,
    })
    out = alone.unionByName(follows).unionByName(contiguous(events))
    for r in repeated:
        out = out.unionByName(r)
    return out


def offsets_problems(events: DataFrame, topics: DataFrame, store_id: str, revision: int) -> DataFrame:
    """All that is wrong with a history of groups against a catalog (``topics`` as in :func:`keys_known`)."""
    store = events.where(F.coalesce(F.col("store_id") != store_id, F.lit(True))).select("offset", F.lit("store").alias("problem"))
    return offsets_shape(events).unionByName(keys_known(events, topics, revision)).unionByName(offsets_chains(events)).unionByName(contiguous(events)).unionByName(store)


def monotone_bounds(samples: DataFrame, *keys: str) -> DataFrame:
    """Samples (``at``, ``low``, ``high``) of bounds that go back, or whose start is above the end."""
    seen = previous(samples, list(keys), "at", F.struct("low", "high"))
    bad = (F.col("low") > F.col("high")) | (F.col("low") < F.col("before.low")) | (F.col("high") < F.col("before.high"))
    return seen.where(bad).select(*keys, "at", "low", "high", F.col("before.low").alias("low_before"), F.col("before.high").alias("high_before"))


def anchors_agree(retained: DataFrame, segments: DataFrame) -> DataFrame:
    """Partitions whose first segment is not the one that the catalog retains.

    ``retained``: ``topic_id``, ``part``, ``low``, ``id``, ``hash``; ``segments``: ``topic_id``,
    ``part``, ``base``, ``id``, ``hash``. Segments below the retained start are being cleaned
    up and do not count.
    """
    here = segments.select("topic_id", "part", F.col("base").alias("low"), F.col("id").alias("found_id"), F.col("hash").alias("found_hash"))
    met = retained.join(here, ["topic_id", "part", "low"], "left")
    problem = F.when(F.col("found_id").isNull(), "missing").when(F.col("found_id") != F.col("id"), "another segment").when(F.col("found_hash") != F.col("hash"), "another header")
    return met.withColumn("problem", problem).where("problem is not null").select("topic_id", "part", "low", "problem")


def assignment_problems(assignments: DataFrame, members: DataFrame, topics: DataFrame, progress: DataFrame) -> DataFrame:
    """Saved assignments against their catalog, members and progress: (``group_id``, ``topic_id``, ``part``, ``problem``).

    ``assignments``: ``group_id``, ``topic_id``, ``part``, ``owner``, ``resume``; ``members``:
    ``group_id``, ``session``; ``topics``: ``topic_id``, ``n_partitions``; ``progress``:
    ``group_id``, ``topic_id``, ``part``, ``next``.
    """
    key = ["group_id", "topic_id", "part"]
    met = assignments.join(members.select("group_id", F.col("session").alias("owner"), F.lit(True).alias("is_member")).distinct(), ["group_id", "owner"], "left")
    met = met.join(topics.select("topic_id", "n_partitions"), "topic_id", "left").join(progress.select(*key, "next"), key, "left")
    met = met.withColumn("times", F.count(F.lit(1)).over(Window.partitionBy(*key)))
    rules = {
        "unknown partition": ~F.coalesce(F.col("part").between(0, F.col("n_partitions") - 1), F.lit(False)),
        "owner is no member": F.col("is_member").isNull(),
        "two owners": F.col("times") > 1,
        "no progress": F.col("next").isNull(),
        "resume does not agree": F.col("next") < F.col("resume"),
    }
    broken = F.filter(F.array(*(F.when(bad, F.lit(name)) for name, bad in rules.items())), lambda r: r.isNotNull())
    return met.select(*key, F.explode(broken).alias("problem"))
