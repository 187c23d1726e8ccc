"""Threshold-scaled sketches of documents, with DataFrame functions alone.

A sketch keeps every hash of a text's shingles (five words; fewer words are one
shingle) below a fixed fraction of the hash range, so sketches of very unequal
texts compare, their containment can be estimated, and the sketch of a union is
the union of sketches. It also has the number of shingles hashed and the least
hash, which stands in where no hash is below the threshold.

Sketches are structs ``n`` int, ``least`` long, ``kept`` array<long> in order, of
hashes shifted to 48 bits; :func:`text_form` writes one as a string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import table, text_of

WORDS = 5
SCALE_BITS = 2  # a quarter of all hashes is kept
SHIFT = 16  # 64-bit hashes are cut to 48 bits
GAP = r"[\x20\x09-\x0D]+"
ROWS = 4096  # of a bucket; a window holds as many in memory before it spills
MOST_BUCKETS = 1 << 14


def word_hashes(text: Column) -> Column:
    """Hashes of the words of a text in lower case, in order."""
    words = F.filter(F.split(F.lower(text), GAP), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def shingle_hashes(words: Column) -> Column:
    """48-bit hashes, 0 and up, of all shingles of an array of word hashes."""
    n = F.size(words)
    many = F.transform(F.sequence(F.lit(0), n - WORDS), lambda i: F.shiftrightunsigned(F.xxhash64(*(F.get(words, i + k) for k in range(WORDS))), SHIFT))
    few = F.array(F.shiftrightunsigned(F.xxhash64(F.array_join(words.cast("array<string>"), " ")), SHIFT))
    return F.when(n >= WORDS, many).when(n > 0, few).otherwise(F.array().cast("array<long>"))


def sketch_of(hashes: Column) -> Column:
    limit = 1 << (64 - SHIFT - SCALE_BITS)
    kept = F.array_sort(F.array_distinct(F.filter(hashes, lambda h: h < limit)))
    return F.struct(F.size(hashes).alias("n"), F.array_min(hashes).alias("least"), kept.alias("kept"))


def merged(a: Column, b: Column) -> Column:
    """The sketch of two texts' shingles together."""
    return F.struct((a["n"] + b["n"]).alias("n"), F.least(a["least"], b["least"]).alias("least"), F.array_sort(F.array_union(a["kept"], b["kept"])).alias("kept"))


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of the shingles of either text that both have; 1.0 for two without words, 0.0 for one."""
    both = F.size(F.array_intersect(a["kept"], b["kept"]))
    either = F.size(a["kept"]) + F.size(b["kept"]) - both
    bare = F.when((a["n"] == 0) & (b["n"] == 0), 1.0).when((a["n"] == 0) | (b["n"] == 0), 0.0)
    return bare.when(either > 0, both / either).otherwise((a["least"] == b["least"]).cast("double"))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the first text's shingles that the second has; null if the first keeps no hash."""
    return F.try_divide(F.size(F.array_intersect(a["kept"], b["kept"])), F.size(a["kept"]))


def text_form(s: Column) -> Column:
    """Number of shingles, least hash and kept hashes, as ``n:hex:hexhex...`` with 12 digits a hash."""

    def digits(h: Column) -> Column:
        return F.lpad(F.lower(F.hex(h)), 12, "0")

    return F.concat_ws(":", s["n"].cast("string"), F.coalesce(digits(s["least"]), F.lit("")), F.array_join(F.transform(s["kept"], digits), ""))


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The id column and ``sketch`` of every whole text, a row for each row; a null text counts as empty. No shuffle."""
    hashed = docs.select(F.col(id_column), word_hashes(text_of(text_column)).alias("words"))
    return hashed.select(id_column, shingle_hashes(F.col("words")).alias("hashes")).select(id_column, sketch_of(F.col("hashes")).alias("sketch"))


def _bucket(bounds: list, kind: str) -> Column:
    """The number of the last bound that is not above ``id`` (0 for a null id), by halving."""
    some = F.array(*map(F.lit, bounds)).cast(f"array<{kind}>")
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(max(len(bounds) - 1, 1).bit_length()))))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step < len(bounds)) & (F.get(some, at + step) <= F.col("id")), at + step).otherwise(at))


def with_next(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", rows: int = ROWS):
    """Rows ``id``, ``text``, ``next``: the text of the next document in ascending id order, the first after the last.

    Null ids come first; ids that tie order by text. The ids alone are ranged to find
    bounds of buckets of about ``rows`` documents (at most ``MOST_BUCKETS`` bounds
    reach the driver); the texts then shuffle once, by bucket, each bucket with a copy
    of the next one's first row behind its own. ``copy`` marks those; the window
    ``along`` is returned so that more can be read along it without a shuffle.
    """
    source = docs.select(F.col(id_column).alias("id"), text_of(text_column).alias("text"))
    ids = docs.select(F.col(id_column).alias("id"))
    kind = ids.schema["id"].dataType.simpleString()
    n = min(MOST_BUCKETS, -(-ids.count() // rows))
    first = ids.where("id is not null").repartitionByRange(max(n, 1), "id").groupBy(F.spark_partition_id().alias("p")).agg(F.min("id").alias("id"))
    bounds = sorted(r["id"] for r in first.select("id").collect())
    lone = source.where("id is null").limit(1).count() > 0
    bucket = _bucket(bounds, kind) if bounds else F.lit(0)
    placed = source.select("id", "text", bucket.alias("bucket"), F.lit(0).alias("copy"))
    last = max(len(bounds) - 1, 0)
    starts = bounds[1:] if lone else bounds
    edges = source.where(F.col("id").isin(starts) if len(starts) <= 256 else F.get(F.array(*map(F.lit, bounds)).cast(f"array<{kind}>"), bucket) == F.col("id")) if starts else source.limit(0)
    edges = edges.groupBy("id").agg(F.min("text").alias("text"))
    if lone:  # then the first of all has a null id
        zero = source.where("id is null").groupBy("id").agg(F.min("text").alias("text"))
        edges = (edges.where(F.col("id") > F.lit(bounds[0])) if bounds else edges).unionByName(zero)
    before = F.when(bucket == 0, last).otherwise(bucket - 1)
    copies = edges.select("id", "text", before.cast("int").alias("bucket"), F.lit(1).alias("copy"))
    along = Window.partitionBy("bucket").orderBy("copy", F.col("id").asc_nulls_first(), "text")
    return placed.unionByName(copies).withColumn("next", F.lead("text").over(along)), along


def edited(text: Column, following: Column) -> Column:
    """The text with its last quarter of code points replaced by the first as many, or all, of another."""
    k = F.floor(F.char_length(text) / 4).cast("int")
    return F.concat(F.left(text, F.char_length(text) - k), F.left(following, k))


def edited_fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", rows: int = ROWS) -> DataFrame:
    """Sketches of every whole text, of its edited text and of the next document, in ascending order of ids.

    One row for each row of ``docs``: the id column, ``n_chars`` long (code points),
    ``edited_sha256`` (of the edited text in UTF-8, see :func:`edited`), ``sketch``,
    ``edited_sketch`` and ``next_sketch``. A null text counts as empty: its edited text
    is empty and its sketches are those of no words. The first document follows the
    last, so a table of one row follows itself; ids that tie order by text, null ids
    come first, repeated rows follow one another. An empty table gives no rows. Other
    columns are not read. Texts shuffle once, by buckets of about ``rows`` documents; a
    task holds a bucket's window.
    """
    found, along = with_next(docs, id_column, text_column, rows)
    found = found.select("id", "copy", "bucket", "text", F.coalesce(edited(F.col("text"), F.col("next")), "text").alias("edited"))
    found = found.select("id", "copy", "bucket", "text", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), word_hashes(F.col("text")).alias("w"), word_hashes(F.col("edited")).alias("we"))
    found = found.withColumns({"s": shingle_hashes(F.col("w")), "se": shingle_hashes(F.col("we"))}).drop("w", "we")
    found = found.withColumns({"s": sketch_of(F.col("s")), "se": sketch_of(F.col("se"))})
    found = found.withColumn("sn", F.lead("s").over(along)).where("copy = 0")
    return found.select(F.col("id").alias(id_column), "n_chars", "edited_sha256", F.col("s").alias("sketch"), F.col("se").alias("edited_sketch"), F.coalesce("sn", "s").alias("next_sketch"))


def op6_threshold_sketch(spark, sf_dir: str) -> DataFrame:
    rows = edited_fingerprints(table(spark, sf_dir, "documents"))
    s, e, n = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return rows.select("doc_id", "n_chars", "edited_sha256", text_form(s).alias("fingerprint"), text_form(e).alias("edited_fingerprint"), likeness(s, e).alias("near_edited"), likeness(s, n).alias("near_next"))
