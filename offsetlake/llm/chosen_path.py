"""Near duplicates by a chosen-path set similarity join.

Documents with one set of shingles are one class, and classes are joined. A class
has minwise tokens of its set. Each of ten independent trees puts it into the node of
one selected token; a node of more than ``LIMIT`` classes branches, every class
following two further tokens that the node selects (one at every other level), and so
on down to ``DEPTH`` levels. Nodes of up to ``LIMIT`` are compared exhaustively: all
pairs by a sketch of 128 minwise bytes, with a margin of 4.75 standard deviations below
the threshold, which leaves clusters of at most ``LIMIT`` classes; then each cluster,
once however many nodes found it, exactly on full sets.

Two sets of similarity s meet in a node that needed no branching with probability s a
tree, and after all levels with 0.74 at s = 0.85 and 0.60 at 0.8, so ten trees miss a
pair with a chance of 6e-9 to 2e-6 at 0.85 and 1e-7 to 1e-4 at 0.8. The sketch, which
all trees share, misses a pair at the threshold with one of 6.5e-6 at s = 0.85 and
3.2e-6 at 0.80 (binomial tails of 128 bytes that are equal with a chance of
s + (1 - s) / 256; least 90 and 81).

No branching splits a large family of near copies. So at every other level, the first
one too, a large node has a pivot, the most central class of a sample of it, and all classes that are at
all near the pivot (``WIDE`` = 0.35 below the threshold, with the same margin) are
compared exactly with it and among themselves, where they are ``CLUSTER`` at most. By
the triangle inequality of Jaccard distances a class within ``WIDE`` of the pivot can
be linked with those alone, so it is finished in that node; the others branch. Larger
families are compared ``CLUSTER`` at a time, each part with the pivot, which gives those
linked with it one label, and branch whole. What has been compared so is not compared
again, and links are looked for between different labels (components so far) alone: a
node of one label is done.
A large node is not branched where that is cheaper: it is dealt into blocks by label, and
only blocks that may differ in label meet, if a member is in ``WHOLE`` pairs of blocks at
most on the average, or at the last level. Small nodes and pairs of blocks are compared in
two rounds of trees, the second of which knows the labels that the first has found.

A node or cluster gives its members or a spanning forest of links, never its pairs;
components are found in one task where they have ``ALONE`` links at most and by rounds of
joins else, and nothing is collected.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import forget, key_runs, materialize, sliced, table, text_of
from .shingles import shingle_sets

TREES, TOKENS, SKETCH = 10, 32, 128
FIRST = 3  # trees of the first round
LIMIT, DEPTH, BRANCHES = 256, 8, (2, 1)  # branches in turn
CLUSTER, CLUSTER_BYTES, SAMPLE, WIDE = 2048, 64 << 20, 64, 35
HOT, MOST_HOT, SALTS = 1 << 16, 100_000, 64  # a node above HOT members is joined in parts
WHOLE, ALONE = 8, 1 << 20
_rng = np.random.default_rng(85)
_TIMES = _rng.integers(1, 1 << 63, TOKENS + SKETCH, dtype=np.uint64) | np.uint64(1)
_FLIP = _rng.integers(1, 1 << 63, TOKENS + SKETCH, dtype=np.uint64)


def minwise(sets: list[np.ndarray]) -> np.ndarray:
    """Minwise hashes of non-empty sets: a row each."""
    every = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), TOKENS + SKETCH), np.uint64)
    for k in range(TOKENS + SKETCH):
        out[:, k] = np.minimum.reduceat((every ^ _FLIP[k]) * _TIMES[k], starts)
    return out


def _prepare(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            sets = shingle_sets(part.column(1))
            full = [s for s in sets if len(s)]
            found = iter(minwise(full) if full else [])
            keys, tokens, sketches = [], [], []
            for s in sets:
                m = next(found) if len(s) else None
                keys.append(blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                tokens.append(None if m is None else (m[:TOKENS] >> np.uint64(32)).astype(np.uint32).view(np.int32))
                sketches.append(None if m is None else (mixed(m[TOKENS:]) & np.uint64(255)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(tokens, pa.list_(pa.int32())), pa.array(sketches, pa.binary())],
                names=["id", "n", "cls", "tokens", "sketch"],
            )

    return run, f"id {kind}, n long, cls binary, tokens array<int>, sketch binary"


def mixed(x: np.ndarray) -> np.ndarray:
    """Low bits of a minimum that do not follow its size."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(28))


def components_of(near: np.ndarray) -> np.ndarray:
    """The least index that each row of a symmetric matrix of links reaches."""
    n = len(near)
    label = np.arange(n)
    while True:
        new = np.minimum(label, np.where(near, label, n).min(1))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def least_equal(percent: int) -> float:
    """Bytes of a sketch that are equal, at least, for a pair that alike to be looked at."""
    s = percent / 100
    return SKETCH * (s - 4.75 * (s * (1 - s) / SKETCH) ** 0.5)


def _name(kind: str, *parts) -> int:
    return int.from_bytes(blake2b("|".join([kind, *map(str, parts)]).encode(), digest_size=8).digest(), "big", signed=True)


def _sketches(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, SKETCH)


def _clusters(least: float):
    """Members of a small node that near sketches of different labels tie together, under a name made of them.

    Pairs that share a group of ``done`` have been compared exactly before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in key_runs(batches):
            node = pa.Table.from_batches(parts)
            sketch = _sketches(node["sketch"])
            _, label = np.unique(np.array(list(map(str, node["label"].to_pylist()))), return_inverse=True)
            n = len(sketch)
            near = np.zeros((n, n), bool)
            for i in range(0, n, 64):
                same = (sketch[i : i + 64, None, :] == sketch[None, :, :]).sum(2)
                near[i : i + 64] = (same >= least) & (label[i : i + 64, None] != label)
            groups: dict[int, list[int]] = {}
            for i, done in enumerate(node["done"].to_pylist()):
                for g in done or ():
                    groups.setdefault(g, []).append(i)
            for own in groups.values():
                near[np.ix_(own, own)] = False
            tied = components_of(near)
            order = np.argsort(tied, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(tied[order])) + 1):
                if len(own) > 1:
                    found = node["id"].take(pa.array(own)).combine_chunks()
                    name = _name("node", *sorted(map(str, found.to_pylist())))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), name)), found], names=["cluster", "id"])

    return run


def _central(least: float):
    """The pivot of each node from a sample of it: the class that the most are near to; none where no two are near."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in key_runs(batches):
            node = pa.Table.from_batches(parts)
            sketch = _sketches(node["sketch"])
            order = np.argsort(np.array(list(map(str, node["id"].to_pylist()))), kind="stable")
            same = np.stack([(sketch == one).sum(1) for one in sketch])
            score = (same >= least).sum(1) * 1000.0 + same.mean(1)
            best = int(order[np.argmax(score[order])])
            if score[best] >= 2000:
                yield pa.RecordBatch.from_arrays([node[c].combine_chunks().slice(best, 1) for c in ("key", "m", "id", "sketch")], names=["key", "m", "pivot", "of"])

    return run


def _near_pivot(least: float):
    """Members of large nodes whose sketch is near that of the node's pivot: (pivot, id, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = b.filter(pa.array((_sketches(b.column(0)) == _sketches(b.column(1))).sum(1) >= least))
            yield pa.RecordBatch.from_arrays([near.column(2), near.column(3), near.column(4)], names=["pivot", "id", "n"])

    return run


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two sets have in common.

    Elements that few sets have are counted over pairs of their owners, the others by
    products of blocks of columns.
    """
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, term, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    out = np.diag([len(s) for s in sets]).astype(np.float32)
    dense = np.flatnonzero(many * 32 > n) if n > 32 else np.flatnonzero(many > 1)
    column = np.full(len(many), -1)
    column[dense] = np.arange(len(dense))
    at = column[term]
    np.fill_diagonal(out, 0)
    for low in range(0, len(dense), 2048):
        block = np.zeros((n, min(2048, len(dense) - low)), np.float32)
        some = (at >= low) & (at < low + 2048)
        block[owner[some], at[some] - low] = 1
        out += block @ block.T
    few = (many[term] > 1) & (at < 0)
    order = np.flatnonzero(few)[np.argsort(term[few], kind="stable")]
    who, of = owner[order], term[order]
    size = many[of]
    first = np.searchsorted(of, of)
    ends = np.cumsum(size)
    lo = 0
    while lo < len(who):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + (1 << 22), "right")))
        length = size[lo:hi]
        partner = who[np.repeat(first[lo:hi] - (np.cumsum(length) - length), length) + np.arange(length.sum())]
        out += np.bincount(np.repeat(who[lo:hi], length) * n + partner, minlength=n * n).reshape(n, n)
        lo = hi
    np.fill_diagonal(out, [len(s) for s in sets])
    return out


def alike(both: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Which sets have ``percent`` of their union in common, as a matrix, from their overlaps."""
    both = both.astype(np.int64)
    return (both > 0) & (100 * both >= percent * (sizes[:, None] + sizes - both))


def exact_links(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each set the least index of its component under links of ``percent``."""
    return components_of(alike(overlaps(sets), np.array([len(s) for s in sets]), percent))


def _links(percent: int, kind: str):
    """A spanning forest of each cluster, and where it has a ``pivot`` also who is within ``WIDE`` of that (``direct``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in key_runs(batches):
            group = pa.Table.from_batches(parts)
            ids = group["id"].combine_chunks()
            sets = [np.frombuffer(s, np.uint64) for s in group["set"].to_pylist()]
            order = sorted(range(len(sets)), key=lambda i: (ids[i].as_py(), len(sets[i])))
            sets = [sets[i] for i in order]
            both, sizes = overlaps(sets), np.array([len(s) for s in sets])
            label = components_of(alike(both, sizes, percent))
            some = [(i, order[k], False) for i, k in zip(order, label.tolist(), strict=True) if i != order[k] and ids[i] != ids[order[k]]]
            pivot = group["pivot"][0].as_py()
            if pivot is not None:
                near = alike(both, sizes, 100 - WIDE)
                for k in np.flatnonzero([ids[i].as_py() == pivot for i in order]).tolist():
                    some += [(order[j], order[k], True) for j in np.flatnonzero(near[k]).tolist()]
            if some:
                a, b, direct = zip(*some, strict=True)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(a)), ids.take(pa.array(b)), pa.array(direct)], names=["a", "b", "direct"])

    return run, f"a {kind}, b {kind}, direct boolean"


def _sized(keyed: DataFrame, name: str, *carried: str) -> DataFrame:
    """Members of nodes of several labels (``key``, ``id``, ``label``, carried columns), with the node's size ``m``.

    Sizes are counted before rows shuffle. Nodes above ``HOT`` members (and above the
    hundred thousandth part of all, so that such nodes are few) meet their size in
    ``SALTS`` parts.
    """
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("label").alias("low"), F.max("label").alias("high"))
    sizes = materialize(sizes.where("low <> high").drop("low", "high"), f"{name}-sizes")
    told = sizes.agg(F.sum("m").alias("all"), F.max("m").alias("most")).first()
    least = max(HOT, (told["all"] or 0) // MOST_HOT)
    if (told["most"] or 0) <= least:
        out = keyed.select("key", "id", "label", *carried).join(sizes, "key")
    else:
        hot = F.broadcast(sizes.where(F.col("m") > least).select("key", F.lit(SALTS).alias("salts")))
        salts = F.coalesce("salts", F.lit(1))
        salted_sizes = sizes.join(hot, "key", "left").select("key", "m", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
        salted = keyed.join(hot, "key", "left").select("key", "id", "label", *carried, F.pmod(F.xxhash64("id"), salts).cast("int").alias("salt"))
        out = salted.join(salted_sizes, ["key", "salt"]).drop("salt")
    out = materialize(out, name)
    forget(sizes)
    return out


def _labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Rows with the label of their ``id``; an id without one is its own."""
    if labels is None:
        return rows.withColumn("label", F.col("id"))
    return rows.join(labels, "id", "left").withColumn("label", F.coalesce("component", "id")).drop("component")


def _first(classes: DataFrame) -> DataFrame:
    """Nodes of the first level of all trees: ``key``, ``id``, ``label``, ``tree``, ``m``."""
    chosen = F.posexplode(F.slice("tokens", 1, TREES)).alias("tree", "token")
    keyed = classes.select("id", chosen).select(F.xxhash64("tree", "token").alias("key"), "id", "tree")
    return _sized(_labelled(keyed, None), "first", "tree")


def _branched(big: DataFrame, classes: DataFrame, labels: DataFrame | None, level: int) -> DataFrame:
    """The nodes below large ones of a level, but for those of one label."""
    branch = F.explode(F.array(*map(F.lit, range(BRANCHES[level % len(BRANCHES)])))).alias("branch")
    spread = big.select("key", "id", "tree", branch).join(classes.select("id", "tokens"), "id")
    chosen = F.element_at("tokens", (F.pmod(F.xxhash64("key", "branch"), F.lit(TOKENS - TREES)) + TREES + 1).cast("int"))
    keyed = _labelled(spread.select(F.xxhash64("key", "branch", chosen).alias("key"), "id", "tree"), labels)
    keyed = materialize(keyed, "branches")
    out = _sized(keyed, "nodes", "tree")
    forget(keyed)
    return out


def _with_pivot(members: DataFrame, pivots: DataFrame, how: str) -> DataFrame:
    """Members of nodes (``key``, ``id``, ``m``) and the columns of the node's pivot; large nodes meet them in parts."""
    salts = F.when(F.col("m") > HOT, SALTS).otherwise(1)
    many = pivots.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("m")
    return members.withColumn("salt", F.pmod(F.xxhash64("id"), salts).cast("int")).join(many, ["key", "salt"], how).drop("salt")


def families(big: DataFrame, classes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Clusters (``cluster`` long, ``id``, ``pivot``) of classes near the pivots of large nodes, and those pivots (``key``, ``m``, ``pivot``).

    The pivot of a cluster is null where that has only a part of its classes.
    """
    kind = classes.schema["id"].dataType.simpleString()
    big = big.select("key", "id", "m")
    sketch = classes.select("id", "sketch")
    sample = big.where(F.pmod(F.xxhash64("id", "key"), F.col("m")) < SAMPLE).join(sketch, "id").select("key", "m", "id", "sketch")
    run = _central(least_equal(percent))
    pivots = materialize(sample.repartition("key").sortWithinPartitions("key").mapInArrow(run, f"key long, m long, pivot {kind}, of binary"), "pivots")
    rows = _with_pivot(big, pivots, "inner").join(classes.select("id", "sketch", "n"), "id").select("sketch", "of", "pivot", "id", "n")
    near = materialize(rows.mapInArrow(_near_pivot(least_equal(percent - WIDE)), f"pivot {kind}, id {kind}, n long").distinct(), "near-pivots")
    size = near.groupBy("pivot").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("n"))
    parts = F.greatest(F.ceil(F.col("members") / (CLUSTER - 1)), F.ceil(F.col("n") * 8 / CLUSTER_BYTES)).cast("int").alias("parts")
    dealt = near.join(size.where("members > 1").select("pivot", parts), "pivot")
    own = dealt.select("pivot", "id", "parts", F.pmod(F.xxhash64("id"), "parts").alias("part"))
    pivot = dealt.select("pivot", "parts").distinct().select("pivot", F.col("pivot").alias("id"), "parts", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    every = own.unionByName(pivot).distinct()
    return every.select(F.xxhash64("pivot", "part").alias("cluster"), "id", F.when(F.col("parts") == 1, F.col("pivot")).alias("pivot")), pivots.drop("of")


def join_classes(nodes: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Candidate clusters (``cluster`` long, ``id``) of classes of different labels.

    ``nodes``: members of small nodes (``key``, ``id``, ``label``); ``classes``: ``id``,
    ``sketch``, ``done``.
    """
    placed = nodes.join(classes.select("id", "sketch", "done"), "id").select("key", "id", "label", "sketch", "done")
    kind = classes.schema["id"].dataType.simpleString()
    return placed.repartition("key").sortWithinPartitions("key").mapInArrow(_clusters(least_equal(percent)), f"cluster long, id {kind}").distinct()


def _groups(big: DataFrame) -> DataFrame:
    """How large nodes (``key``, ``id``, ``label``) are dealt into blocks: ``key``, ``own``, ``parts``, and of the node ``m`` and ``met``, the rows of all its pairs of blocks.

    A block has some ``2 * LIMIT`` members. A label with more than half a block of members
    has blocks to itself (``own``), the others of a node share some.
    """
    half = 2 * LIMIT
    own = F.when(F.col("n") > half // 2, F.col("label"))
    counted = big.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n")).withColumn("own", own)
    groups = counted.groupBy("key", "own").agg(F.sum("n").alias("n")).withColumn("parts", F.ceil(F.col("n") / half).cast("int"))
    node = Window.partitionBy("key")
    alone = F.when(F.col("own").isNotNull(), F.col("n") * F.col("parts")).otherwise(0)
    met = F.sum("n").over(node) * F.sum("parts").over(node) - F.sum(alone).over(node)
    return materialize(groups.select("key", "own", "parts", F.sum("n").over(node).alias("m"), met.alias("met")), "groups")


def _blocks(big: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Members of large nodes (``key``, ``id``, ``label``) in pairs of blocks (:func:`_groups`, nodes that it lacks are left out), a node each; two blocks of one and the same label do not meet."""
    groups = _groups(big) if groups is None else groups
    counted = big.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    block = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    blocks = groups.select("key", "own", block.alias("part"))
    other = blocks.select(F.col("key").alias("k"), F.col("own").alias("with"), F.col("part").alias("at"))
    a, b = F.struct("own", "part"), F.struct(F.col("with").alias("own"), F.col("at").alias("part"))
    apart = F.col("own").isNull() | F.col("with").isNull() | (F.col("own") != F.col("with"))
    met = blocks.join(other, (F.col("key") == F.col("k")) & apart).select("key", "own", "part", F.xxhash64("key", F.least(F.xxhash64(a), F.xxhash64(b)), F.greatest(F.xxhash64(a), F.xxhash64(b))).alias("pair"))
    named = big.join(counted.select("key", "label", F.when(F.col("n") > LIMIT, F.col("label")).alias("own")), ["key", "label"])
    placed = named.join(groups, (named["key"] == groups["key"]) & named["own"].eqNullSafe(groups["own"])).select(named["key"], "id", "label", named["own"], F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"))
    dealt = placed.join(met, (placed["key"] == met["key"]) & placed["own"].eqNullSafe(met["own"]) & (placed["part"] == met["part"]))
    return dealt.select(F.col("pair").alias("key"), "id", "label")


def _alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of all links (a, b) of a task: (id, component)."""
    links = [b for b in batches if b.num_rows]
    if not links:
        return
    ends = pa.chunked_array([b.column(k) for k in (0, 1) for b in links]).combine_chunks().dictionary_encode()
    ids = ends.dictionary
    order = pa.compute.array_sort_indices(ids)
    rank = np.empty(len(ids), np.int64)
    rank[order.to_numpy()] = np.arange(len(ids))
    u, v = rank[ends.indices.to_numpy()].reshape(2, -1)
    label = np.arange(len(ids))
    while True:
        new = label.copy()
        low = np.minimum(label[u], label[v])
        for end in (u, v):
            np.minimum.at(new, end, low)
            np.minimum.at(new, label[end], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    ids = ids.take(order)
    yield pa.RecordBatch.from_arrays([ids, ids.take(pa.array(label))], names=["id", "component"])


def components(links: DataFrame) -> DataFrame:
    """For each id of ``links`` (a, b) the least id it reaches: ``id``, ``component``.

    Up to ``ALONE`` links meet in a task; more are joined in rounds, written between.
    """
    if links.count() <= ALONE:
        kind = links.schema["a"].dataType.simpleString()
        return materialize(links.select("a", "b").repartition(1).mapInArrow(_alone, f"id {kind}, component {kind}"), "labels")
    edges = materialize(links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a")).distinct(), "edges")
    last = edges.groupBy(F.col("u").alias("id")).agg(F.least(F.min("v"), F.col("u")).alias("component"))
    last = materialize(last, "labels")
    while True:
        label = last.select("id", "component")
        heard = edges.join(label.select(F.col("id").alias("v"), F.col("component").alias("c")), "v").groupBy(F.col("u").alias("id")).agg(F.min("c").alias("c"))
        near = label.join(heard, "id").select("id", F.least("component", "c").alias("new"), F.col("component").alias("old"))
        jump = near.join(label.select(F.col("id").alias("new"), F.col("component").alias("far")), "new", "left")
        step = materialize(jump.select("id", F.least("new", F.coalesce("far", "new")).alias("component"), "old"), "labels")
        forget(last)
        last = step
        if step.where("component <> old").limit(1).count() == 0:
            forget(edges)
            return step.select("id", "component")


def confirmed(clusters: DataFrame, source: DataFrame, percent: int) -> DataFrame:
    """Links (``a``, ``b``, ``direct``) between ids whose full sets are ``percent`` alike: see :func:`_links`.

    ``clusters``: ``cluster``, ``id``, ``pivot`` (null for none); ``source``: ``id``, ``text``.
    Only texts of ids that are in clusters are read again. A task holds the sets of one
    cluster.
    """
    kind = source.schema["id"].dataType.simpleString()

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in shingle_sets(part.column(1))], pa.binary())], names=["id", "set"])

    sets = source.join(clusters.select("id").distinct(), "id", "left_semi").mapInArrow(full, f"id {kind}, set binary").where(F.octet_length("set") > 0)
    placed = clusters.join(sets, "id").select("cluster", "id", "set", "pivot").repartition("cluster").sortWithinPartitions("cluster")
    run, schema = _links(percent, kind)
    return materialize(placed.mapInArrow(run, schema), "links")


def _relabelled(labels: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """Labels (``id``, ``component``) with more links, which are contracted to links between the labels there are."""
    links = links.select("a", "b")
    if links.isEmpty():
        return labels
    if labels is None:
        return components(links)
    if links.count() + labels.count() <= ALONE:
        return components(links.union(labels))
    for end in ("a", "b"):
        known = labels.select(F.col("id").alias(end), F.col("component").alias("c"))
        links = links.join(known, end, "left").withColumn(end, F.coalesce("c", end)).drop("c")
    links = links.where("a <> b")
    if links.isEmpty():
        return labels
    more = components(links)
    moved = labels.join(more.select(F.col("id").alias("component"), F.col("component").alias("new")), "component", "left").select("id", F.coalesce("new", "component").alias("component"))
    return materialize(moved.unionByName(more.join(labels.select("id"), "id", "left_anti")), "labels")


def near_duplicates(docs: DataFrame, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Components of documents whose sets of shingles have ``percent`` of their union in common.

    One row for each row of ``docs``: the id column, ``n_shingles`` long (distinct),
    ``component_id`` (the smallest id reachable), ``kept`` (the id is that one), and
    ``links`` (whether it is linked with a different set). Texts without words, null
    ones too, are linked with nothing. A row with a null id is no document to link
    to; it takes the component of its text's others, or null. Rows that share an id
    are one document: what either is linked with, both are. Repeated rows all
    appear. Other columns are not read.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    source = docs.select(F.col(id_column).alias("id"), text_of(text_column).alias("text"))
    run, schema = _prepare(kind)
    found = materialize(source.mapInArrow(run, schema), "shingled")
    classes = found.where("cls is not null and id is not null").groupBy("cls").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("tokens").alias("tokens"), F.first("sketch").alias("sketch"))
    classes = materialize(classes, "classes")
    nodes, labels, small, blocks, done = _first(classes), None, [], [], []
    for level in range(DEPTH):
        small.append(nodes.where(F.col("m") <= LIMIT).select("key", "id", "tree"))
        big = nodes.where(F.col("m") > LIMIT)
        if big.isEmpty():
            break
        if level % 2 == 0:
            clusters, pivots = families(big, classes, percent)
            clusters = materialize(clusters, "clusters")
            if not clusters.isEmpty():
                done.append(clusters.select("cluster", "id"))
                links = confirmed(clusters, source, percent)
                labels = _relabelled(labels, links.where("not direct"))
                finished = links.where("direct").select(F.col("b").alias("pivot"), F.col("a").alias("id")).distinct()
                big = _with_pivot(big, pivots, "left").join(finished, ["pivot", "id"], "left_anti")
                big = materialize(_labelled(big.select("key", "id", "tree"), labels), "large")
        groups = _groups(big)
        dear = (F.col("met") > WHOLE * F.col("m")) & F.lit(level < DEPTH - 1)
        blocks.append(_blocks(big, groups.where(~dear)).select("key", "id"))
        rest = groups.where(dear).select("key").distinct()
        if rest.isEmpty():
            break
        nodes = _branched(big.join(rest, "key", "left_semi"), classes, labels, level)
    known = classes.withColumn("done", F.lit(None).cast("array<long>"))
    if done:
        known = classes.join(reduce(DataFrame.unionByName, done).groupBy("id").agg(F.collect_set("cluster").alias("done")), "id", "left")
    small = reduce(DataFrame.unionByName, small)
    for trees, met in ((F.col("tree") < FIRST, []), (F.col("tree") >= FIRST, blocks)):
        nodes = _sized(_labelled(small.where(trees).select("key", "id"), labels), "nodes").drop("m")
        if met:
            nodes = nodes.unionByName(_labelled(reduce(DataFrame.unionByName, met), labels))
        clusters = join_classes(nodes, known, percent)
        clusters = materialize(clusters.withColumn("pivot", F.lit(None).cast(kind)), "clusters")
        if not clusters.isEmpty():
            labels = _relabelled(labels, confirmed(clusters, source, percent))
    named = classes.select("cls", F.col("id").alias("rep"))
    if labels is None:
        named = named.select("cls", F.col("rep").alias("component_id"), F.lit(False).alias("links"))
    else:
        named = named.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("cls", F.coalesce("component", "rep").alias("component_id"), F.col("component").isNotNull().alias("links"))
    out = found.select("id", F.col("n").alias("n_shingles"), "cls").join(named, "cls", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_column), "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"), F.coalesce("links", F.lit(False)).alias("links"))


def drop_near_copies(docs: DataFrame, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with one document of each component, the one of the smallest id; columns as they were.

    Only ids of documents that go are joined against. Rows that share an id stay or
    go together, repeated ones too; rows with a null id stay.
    """
    found = near_duplicates(docs, percent, id_column, text_column)
    gone = materialize(found.where(~F.col("kept") & F.col(id_column).isNotNull()).select(F.col(id_column).alias("_gone_id")).distinct(), "gone")
    stays = docs.join(gone, docs[id_column] == gone["_gone_id"], "left_anti")
    return stays.select(*docs.columns)


def op5_chosen_path(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85).drop("links")
