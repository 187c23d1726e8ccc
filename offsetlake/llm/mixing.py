"""Mixing sources to target weights with Sainte-Laguë quotas.

A source's documents are put in a seeded order and its words cut into blocks of
equal size. The words of the mix go to sources by the highest quotients
target / (2k + 1): integer quotas, within a word or so of the targets, that add up
to the mix. A source's blocks, in the order of a seeded permutation and again from
the first when none is left, fill as many seats as hold its quota; the last block
is cut to it. The seats are dealt to shards by the same quotients, so each shard
has an integer quota of seats of each source, and quotas add up over shards.

What quotients decide is said by a few numbers (:class:`Cut`): the least quotient
that has a seat, and among equal ones the last source. Any source's quota follows
from these and from its own size and rank, so no table of sources leaves the
cluster: sources are numbered in ranges, the driver sees how many of them have each
size and weight (there are far fewer sizes than sources), and equal quotients are cut
by counting ranks. Documents are placed by running sums inside buckets of some 8,000
rows, so a source that holds a third of all rows is as many tasks as its share.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, materialize, sliced, table, text_of

BUCKET_ROWS = 8_192
WEIGHTS = (5, 2, 1)  # of sources in order, repeating
FEW = 1 << 17  # sources whose numbers the driver holds; of more it sees counts alone, with the same result
NOBODY, ANYBODY = -2, -1  # the last source of a tie that nobody wins; a rank that wins any other


@dataclass(frozen=True)
class Level:
    """Targets as a level of water: a source has ``left`` * weight / ``by`` words, or ``most`` times its size if that is less."""

    left: float
    by: float
    most: float

    def of(self, sizes: np.ndarray, weights: np.ndarray) -> np.ndarray:
        n, w = np.asarray(sizes, float), np.asarray(weights, float)
        if not self.by:
            return np.where(w > 0, self.most * n, 0.0)
        return np.where(w > 0, np.minimum(self.left * w / self.by, self.most * n), 0.0)


def level(sizes: np.ndarray, weights: np.ndarray, many: np.ndarray, total: float, most: float) -> Level:
    """The level at which shares of ``total`` by weight, none above ``most`` times its size, add up; ``many`` sources are alike."""
    n, w = np.asarray(sizes, float), np.asarray(weights, float)
    open_, left = (n > 0) & (w > 0), float(total)
    while open_.any():
        by = float((w * many)[open_].sum())
        full = open_ & (left * w / by >= most * n)
        if not full.any():
            return Level(left, by, most)
        left -= float((most * n * many)[full].sum())
        open_ &= ~full
    return Level(0.0, 0.0, most)


def targets(sizes: list[float], weights: list[float], total: float, most: float = 2.0) -> list[float]:
    """Shares of ``total`` by weight, none above ``most`` times its size; what is above is shared by weight again."""
    return level(np.array(sizes, float), np.array(weights, float), np.ones(len(sizes)), total, most).of(sizes, weights).tolist() if sizes else []


@dataclass(frozen=True)
class Cut:
    """Which seats are taken: those whose (2k + 1) / share is below ``at``, and, where it is ``at``, the sources up to ``last``."""

    low: float  # seats up to this (2k + 1) / share are counted by a division
    at: float
    last: int

    def of(self, shares: np.ndarray, rank: np.ndarray) -> np.ndarray:
        t = np.asarray(shares, float)
        have = np.where(t > 0, np.floor((self.low * t + 1) / 2), 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            next_ = np.where(t > 0, (2 * have + 1) / t, np.inf)
        return (have + ((next_ < self.at) | (next_ == self.at) & (rank <= self.last))).astype(np.int64)


def cut(shares: np.ndarray, many: np.ndarray, seats: int, ranked) -> Cut:
    """Sainte-Laguë: ``seats`` to the highest quotients share / (2k + 1); the earlier source wins a tie.

    ``many[i]`` sources have the share ``shares[i]``; ``ranked(classes, k)`` is the rank of the
    k-th source, in order, of those classes together.
    """
    t, many = np.asarray(shares, float), np.asarray(many, np.int64)
    if seats <= 0 or not (t * many).sum() > 0:
        return Cut(0.0, 0.0, NOBODY)
    low, high = 0.0, 2.0 * seats / t.max() + 2.0 / t[t > 0].min()

    def held(x: float) -> np.ndarray:  # seats whose (2k + 1) / share is x at most
        return np.floor((x * t + 1) / 2)

    for _ in range(200):
        mid = (low + high) / 2
        if (held(mid) * many).sum() <= seats:
            low = mid
        else:
            high = mid
        if high - low <= 1e-15 * high:
            break
    have = np.where(t > 0, held(low), 0)
    rest = int(seats - (have * many).sum())
    with np.errstate(divide="ignore"):
        next_ = np.where(t > 0, (2 * have + 1) / t, np.inf)
    for q in np.unique(next_).tolist():  # a seat each, of the next quotients in order
        same = np.flatnonzero(next_ == q)
        n = int(many[same].sum())
        if rest < n:
            return Cut(low, q, ranked(same, rest) if rest else NOBODY)
        rest -= n
    return Cut(low, np.inf, NOBODY)


def _alone(classes: np.ndarray, k: int) -> int:
    """The k-th of classes of one source each, whose ranks are their places."""
    return int(np.sort(classes)[k - 1])


def quotas(shares: list[float], seats: int) -> list[int]:
    """Seats of each share by :func:`cut`."""
    return cut(np.array(shares, float), np.ones(len(shares), int), seats, _alone).of(shares, np.arange(len(shares))).tolist() if shares else []


@dataclass(frozen=True)
class Words:
    """Quotas of words: a cut of the targets, but for sources that have all they may."""

    cuts: tuple[Cut, ...]  # the last one says; one before has filled those that it takes above their most

    def of(self, want: np.ndarray, most: np.ndarray, rank: np.ndarray) -> np.ndarray:
        out = np.zeros(len(np.asarray(want)), np.int64)
        open_ = np.asarray(want) > 0
        for k, c in enumerate(self.cuts):
            full = open_ & (c.of(want, np.full(len(out), ANYBODY)) > most)  # without a tie's seat such a source has its most, too
            out[full] = np.asarray(most)[full]
            open_ &= ~full
            if k + 1 == len(self.cuts):
                out[open_] = c.of(want, rank)[open_]
        return out


def word_cuts(want: np.ndarray, most: np.ndarray, many: np.ndarray, total: int, ranked) -> Words:
    """Quotas of ``total`` words, none above its ``most``; what is above goes to the others."""
    open_, left, cuts = np.asarray(want) > 0, total, []
    while open_.any():
        found = cut(np.where(open_, want, 0.0), many, left, ranked)
        cuts.append(found)
        full = open_ & (found.of(want, np.full(len(open_), ANYBODY)) > most)
        if not full.any():
            break
        left -= int((np.asarray(most) * many)[full].sum())
        open_ &= ~full
    return Words(tuple(cuts))


def word_quotas(want: list[float], most: list[int]) -> list[int]:
    """Quotas of the words that ``want`` adds up to, none above its ``most``."""
    n = len(want)
    if not n:
        return []
    w, m, one = np.array(want, float), np.array(most, np.int64), np.ones(n, np.int64)
    return word_cuts(w, m, one, round(sum(want)), _alone).of(w, m, np.arange(n)).tolist()


def permuted(k: np.ndarray, n: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Where a seeded permutation of [0, n) puts k: a Feistel network over the next square, walked until inside."""
    k, n, seed = (np.asarray(x, np.uint64) for x in (k, n, seed))
    half = np.maximum(np.ceil(np.sqrt(n.astype(float))), 1).astype(np.uint64)
    half += half * half < n
    out, walking = k.copy(), np.ones(len(k), bool)
    with np.errstate(over="ignore"):
        while walking.any():
            h, s, x = half[walking], seed[walking], out[walking]
            a, b = x // h, x % h
            for turn in range(4):
                mix = (b + s * np.uint64(4) + np.uint64(turn)) * np.uint64(0x9E3779B97F4A7C15)
                mix ^= mix >> np.uint64(29)
                mix *= np.uint64(0xBF58476D1CE4E5B9)
                a, b = b, (a + (mix >> np.uint64(32))) % h
            out[walking] = a * h + b
            walking[walking] = out[walking] >= n[walking]
    return out


@dataclass(frozen=True)
class Quota:
    """What sources take: words wanted and taken, blocks, where the permutation puts the short one, and seats over all passes."""

    want: np.ndarray
    take: np.ndarray
    per: np.ndarray
    odd: np.ndarray
    seats: np.ndarray


@dataclass(frozen=True)
class Plan:
    """A few numbers that say what any source takes, from its size and its rank by code point, null last."""

    weights: tuple[float, ...]
    level: Level
    words: Words
    block: int
    seed: int
    shards: tuple[Cut, ...] = ()  # of all seats up to each shard

    def of(self, rank: np.ndarray, sizes: np.ndarray) -> Quota:
        n = np.asarray(sizes, np.int64)
        want = self.level.of(n, np.array(self.weights, float)[rank % len(self.weights)])
        take = self.words.of(want, (self.level.most * n).astype(np.int64), rank)
        per = -(-n // self.block)
        odd = permuted(np.maximum(per - 1, 0), np.maximum(per, 1), self.seed + rank).astype(np.int64) if len(n) else per
        passes, rest = np.divmod(take, np.maximum(n, 1))
        last = -(-rest // self.block)
        return Quota(want, take, per, odd, passes * per + np.where(last <= odd, last, -(-(rest + per * self.block - n) // self.block)))

    def bounds(self, rank: np.ndarray, seats: np.ndarray) -> np.ndarray:
        """Seats of each source up to each shard, a row a source."""
        return np.stack([c.of(seats, rank) for c in self.shards], 1)


def _words_of_mix(share: float, most: float, every: int, open_: int) -> int:
    """Words of the whole mix; ``open_`` of ``every`` lie in sources with a weight."""
    return math.floor(min(share * every, most * open_) + 0.5)


def plan(sizes: list[int], weights=WEIGHTS, share: float = 1.5, most: float = 2.0, block: int = 256, shards: int = 64, seed: int = 17) -> Plan:
    """The plan for sources in order, each a class of its own."""
    n, rank = np.array(sizes, np.int64), np.arange(len(sizes))
    w = np.array(weights, float)[rank % len(weights)]
    one = np.ones(len(n), np.int64)
    found = level(n, w, one, share * float(n.sum()), most)
    words = word_cuts(found.of(n, w), (most * n).astype(np.int64), one, _words_of_mix(share, most, int(n.sum()), int(n[w > 0].sum())), _alone)
    own = Plan(tuple(weights), found, words, block, seed)
    seats = own.of(rank, n).seats
    every = int(seats.sum())
    return replace(own, shards=tuple(cut(seats, one, every * (j + 1) // shards, _alone) for j in range(shards)))


def taken(own: Plan, source: np.ndarray, sizes: np.ndarray, start: np.ndarray, size: np.ndarray):
    """Pieces of documents that the mix takes: (row, first word, end word, pass, shard), words counted within the row.

    ``source`` and ``sizes``: rank and size of each row's source.
    """
    b = own.block
    known, first_row, of = np.unique(source, return_index=True, return_inverse=True)
    n_source = np.asarray(sizes, np.int64)[first_row]
    q = own.of(known, n_source)
    bounds = own.bounds(known, q.seats)
    first, last = start // b, (start + np.maximum(size, 1) - 1) // b
    n = np.where(size > 0, last - first + 1, 0)
    row = np.repeat(np.arange(len(size)), n)
    block = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[row]
    src = of[row]
    rank = permuted(block, q.per[src], own.seed + known[src]).astype(np.int64)
    short = b * q.per - n_source
    before = rank * b - np.where(rank > q.odd[src], short[src], 0)  # words of the blocks that come first
    lo, hi = np.maximum(block * b, start[row]), np.minimum((block + 1) * b, (start + size)[row])
    pieces = []
    turns = -(-q.take // np.maximum(n_source, 1))
    for turn in range(int(turns.max(initial=0))):
        end = np.minimum(hi, block * b + q.take[src] - turn * n_source[src] - before)
        some = end > lo
        seat = (turn * q.per[src] + rank)[some]
        shard = (bounds[src[some]] <= seat[:, None]).sum(1)
        pieces.append(np.stack([row[some], lo[some] - start[row[some]], end[some] - start[row[some]], np.full(some.sum(), turn), shard], 1))
    return np.concatenate(pieces) if pieces else np.zeros((0, 5), np.int64)


def _numbered(totals: DataFrame) -> DataFrame:
    """Sources with their rank by code point, null last, as ``src``: numbered inside ranges, and ranges by their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i = 0
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.arange(i, i + b.num_rows))], names=[*b.schema.names, "i"])
            i += b.num_rows

    order = F.col("source").asc_nulls_last()
    ranged = totals.repartitionByRange(order).sortWithinPartitions(order).withColumn("part", F.spark_partition_id())
    placed = materialize(ranged.mapInArrow(run, "source string, n long, rows long, part int, i long"), "sources")
    counts = sorted((r["part"], r["count"]) for r in placed.groupBy("part").count().collect())  # a row a partition
    ahead = np.cumsum([0] + [c for _, c in counts]).tolist()
    known = totals.sparkSession.createDataFrame([(p, a) for (p, _), a in zip(counts, ahead, strict=False)], "part int, ahead long")
    return placed.join(F.broadcast(known), "part").select("source", "n", "rows", (F.col("ahead") + F.col("i")).alias("src"))


def _kth(rows: DataFrame, k: int, end: int) -> int:
    """The k-th ``src`` of rows in order, by counting in ever finer ranges."""
    low, width = 0, end
    while width > 1:
        width = -(-width // 256)
        found = sorted((r["at"], r["count"]) for r in rows.where((F.col("src") >= low) & (F.col("src") < low + 256 * width)).groupBy(F.floor((F.col("src") - low) / width).alias("at")).count().collect())
        for at, n in found:
            if k <= n:
                low += at * width
                break
            k -= n
    return low


def _plan_of(numbered: DataFrame, weights, share: float, most: float, block: int, shards: int, seed: int) -> Plan:
    """As :func:`plan`, from counts of sources that are alike; equal results for any number of sources."""
    spark = numbered.sparkSession
    end = numbered.count()
    if end <= FEW:
        rows = sorted((r["src"], r["n"]) for r in numbered.select("src", "n").collect())
        return plan([n for _, n in rows], weights, share, most, block, shards, seed)
    kinds = numbered.groupBy("n", (F.col("src") % len(weights)).alias("w")).count().collect()  # sizes differ far less than sources
    n, w, many = (np.array([r[c] for r in kinds], np.int64) for c in ("n", "w", "count"))

    def by_size(classes: np.ndarray, k: int) -> int:
        own = spark.createDataFrame([(int(n[c]), int(w[c])) for c in classes], "n long, w long")
        return _kth(numbered.withColumn("w", F.col("src") % len(weights)).join(F.broadcast(own), ["n", "w"]), k, end)

    weight = np.array(weights, float)[w]
    every = int((n * many).sum())
    found = level(n, weight, many, share * float(every), most)
    words = word_cuts(found.of(n, weight), (most * n).astype(np.int64), many, _words_of_mix(share, most, every, int((n * many)[weight > 0].sum())), by_size)
    own = Plan(tuple(weights), found, words, block, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            src, size = (b.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own.of(src, size).seats)], names=["src", "seats"])

    seated = materialize(numbered.select("src", "n").mapInArrow(run, "src long, seats long"), "seats")
    kinds = seated.groupBy("seats").count().collect()
    seats, many = (np.array([r[c] for r in kinds], np.int64) for c in ("seats", "count"))

    def by_seats(classes: np.ndarray, k: int) -> int:
        return _kth(seated.join(F.broadcast(spark.createDataFrame([(int(seats[c]),) for c in classes], "seats long")), "seats"), k, end)

    every = int((seats * many).sum())
    return replace(own, shards=tuple(cut(seats, many, every * (j + 1) // shards, by_seats) for j in range(shards)))


def placed(docs: DataFrame, carried: dict, source_column: str, id_column: str, text_column: str, whole: bool, *, weights=WEIGHTS, share: float = 1.5, most: float = 2.0, block: int = 256, shards: int = 64, seed: int = 17):
    """The plan, and rows with ``size``, ``src`` and ``n`` (rank and words of the source) and ``start`` (words of it before the row).

    ``whole``: the carried columns have texts, which then are not written between.
    """
    size = F.regexp_count(text_of(text_column), F.lit(WORD)).cast("long")
    rows = docs.select(
        *(c.alias(n) for n, c in carried.items()),
        F.col(source_column).cast("string").alias("source"),
        size.alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_column)).alias("h"),
        F.xxhash64(text_of(text_column)).alias("tie"),
    )
    if not whole:
        rows = materialize(rows, "sizes")
    sums = materialize(rows.select("source", "size"), "sizes") if whole else rows
    numbered = materialize(_numbered(sums.groupBy("source").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("rows"))), "numbered")
    own = _plan_of(numbered, weights, share, most, block, shards, seed)
    known = numbered.select(F.col("source").alias("known"), "src", "n", F.ceil(F.col("rows") / BUCKET_ROWS).cast("int").alias("buckets"), "rows")
    same = F.col("source").eqNullSafe(F.col("known"))
    total = known.agg(F.count(F.lit(1)).alias("sources"), F.sum("rows").alias("rows")).first()
    if total["sources"] <= FEW:  # some 10 MB
        rows = rows.join(F.broadcast(known.drop("rows")), same).drop("known")
    else:  # sources that hold a ten thousandth part of all rows are few; the others shuffle
        large = F.col("rows") > total["rows"] // 10_000
        told = rows.join(F.broadcast(known.where(large).drop("rows")), same, "left").drop("known")
        few = told.where("src is null").drop("src", "n", "buckets").join(known.where(~large).drop("rows"), same).drop("known")
        rows = told.where("src is not null").unionByName(few)
    rows = rows.withColumn("bucket", F.pmod("h", "buckets").cast("int"))
    sums = rows.groupBy("src", "bucket").agg(F.sum("size").alias("words"))
    ahead = sums.select("src", "bucket", (F.sum("words").over(Window.partitionBy("src").orderBy("bucket")) - F.col("words")).alias("ahead"))
    order = Window.partitionBy("src", "bucket").orderBy("h", "tie").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("upto", F.sum("size").over(order)).join(ahead, ["src", "bucket"])
    return own, out.withColumn("start", F.col("ahead") + F.col("upto") - F.col("size")).drop("ahead", "upto", "h", "tie", "bucket", "buckets")


def mix_counts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", **how) -> DataFrame:
    """How many words of each document the mix takes, and into which shards.

    One row for each row of ``docs``: the id column, ``source``, ``size`` long,
    ``source_size`` long, ``target`` double, ``quota`` long (words) and ``seats``
    long (blocks; these four its source's), ``taken`` long, ``shards`` array of
    (``shard`` int, ``words`` long), those that take some in order. A null
    text counts as empty: size 0, nothing taken. Null sources are one source, last
    in order. Ids may be null or repeat. Empty tables give empty results. Other
    columns are not read. The same rows give the same result in any partitioning.
    """
    own, rows = placed(docs, {"id": F.col(id_column)}, source_column, id_column, text_column, False, **how)
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            src, n, size, start = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 3, 4, 5))
            pieces = taken(own, src, n, start, size)
            words = np.zeros(b.num_rows, np.int64)
            np.add.at(words, pieces[:, 0], pieces[:, 2] - pieces[:, 1])
            dealt, of = np.unique(pieces[:, [0, 4]], axis=0, return_inverse=True)
            shares = np.zeros(len(dealt), np.int64)
            np.add.at(shares, of.reshape(-1), pieces[:, 2] - pieces[:, 1])
            ends = np.searchsorted(dealt[:, 0], np.arange(b.num_rows + 1)).astype(np.int32)
            inner = pa.StructArray.from_arrays([pa.array(dealt[:, 1].astype(np.int32)), pa.array(shares)], names=["shard", "words"])
            q = own.of(src, n)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(4), b.column(3), pa.array(q.want), pa.array(q.take), pa.array(q.seats), pa.array(words), pa.ListArray.from_arrays(pa.array(ends), inner)], names=["id", "source", "size", "source_size", "target", "quota", "seats", "taken", "shards"])

    return rows.select("id", "source", "src", "n", "size", "start").mapInArrow(run, f"id {kind}, source string, size long, source_size long, target double, quota long, seats long, taken long, shards array<struct<shard: int, words: long>>").withColumnRenamed("id", id_column)


def mix_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", shard_column: str | None = None, **how) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each run of words taken, its text cut to them.

    ``n_chars``, if there is one, becomes the new length. Documents of which
    nothing is taken have no row; one that is taken twice has a row for each time.
    With ``shard_column`` a run lies in one shard, whose number (int) is a last column.
    Nulls and repeated rows as in :func:`mix_counts`.
    """
    names = docs.columns
    inner = {f"c{i}": F.col(f"`{c}`") for i, c in enumerate(names)}
    own, rows = placed(docs, inner, source_column, id_column, text_column, True, **how)
    kept = list(inner)
    at = names.index(text_column)
    chars = names.index("n_chars") if "n_chars" in names else None
    words = re.compile(WORD).finditer
    fields = [f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(names)]
    added = [] if shard_column is None else [shard_column]
    schema = ", ".join([*fields, *(f"c{len(names)} int" for _ in added)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            src, n, size, start = (b.column(len(kept) + i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4))
            pieces = taken(own, src, n, start, size)
            pieces = pieces[np.lexsort((pieces[:, 1], pieces[:, 3], pieces[:, 0]))]
            if not added:
                pieces[:, 4] = 0
            texts, spans, before, rows_, cut, shards = b.column(at), [], -1, [], [], []
            for row, lo, hi, turn, shard in pieces.tolist():
                if rows_ and (row, shard, turn, lo) == (rows_[-1], shards[-1], *last):  # blocks side by side are one run
                    lo = cut.pop()[1]
                    rows_.pop()
                    shards.pop()
                if row != before:
                    before, spans = row, [m.span() for m in words(texts[row].as_py())]
                rows_.append(row)
                shards.append(shard)
                cut.append((texts[row].as_py()[spans[lo][0] : spans[hi - 1][1]], lo))
                last = turn, hi
            found = b.take(pa.array(rows_, pa.int64())) if rows_ else b.slice(0, 0)
            columns = found.columns[: len(kept)]
            columns[at] = pa.array([c for c, _ in cut], pa.string())
            if chars is not None:
                columns[chars] = pa.array([len(c) for c, _ in cut], pa.int64()).cast(columns[chars].type)
            columns += [pa.array(shards, pa.int32()) for _ in added]
            yield pa.RecordBatch.from_arrays(columns, names=[f"c{i}" for i in range(len(columns))])

    return rows.select(*kept, "src", "n", "size", "start").mapInArrow(run, schema).toDF(*names, *added)


def op2_sainte_lague_mix(spark, sf_dir: str) -> DataFrame:
    return mix_counts(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "quota", "seats", "taken", "shards", "source")
