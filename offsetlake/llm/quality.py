"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

A text has terms of two families: its subwords, that is, every three characters that
follow one another (hashed to ``SUBWORDS`` terms), and for each word how many words
ago it came last (a class for each doubling, and one for words that are new).
Square roots of the shares of a family's terms, weighted by inverse document
frequency, are projected on the leading singular vectors of a bounded sample of
labelled texts, each scaled by the root of its singular value, so that no few
directions drown the others. Every document's vector is compared with all labelled
vectors by exact cosine products, a block of documents at a time, and the nearest
vote with a power of their similarity.

The sample has ``most_labelled`` rows at most, those with the smallest seeded hash of
both labels together, so it has the labels' own shares in an input of any size. The
basis and the labelled vectors are bounded, and all that is collected or broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .presplit import code_points, flat
from .shared import materialize, sliced, table, text_of
from .shingles import mix, words

SUBWORDS, AGES = 8192, 32
TERMS = SUBWORDS + AGES
LEAST = 8  # texts of the sample that a term must be in
_TURN = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def counts(raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How often each term comes in each of some texts side by side: a row a text."""
    n = len(bounds) - 1
    out = np.zeros((n, TERMS), np.float32)
    cp, at = code_points(raw)
    text = np.repeat(np.arange(n), np.diff(bounds if at is None else np.searchsorted(at, bounds)))
    if len(cp) > 2:
        c = cp.astype(np.uint32)
        h = c[:-2] * _TURN[0] + c[1:-1] * _TURN[1] + c[2:] * _TURN[2]
        h ^= h >> np.uint32(15)
        h *= _TURN[1]
        inside = text[:-2] == text[2:]
        out[:, :SUBWORDS] = np.bincount(text[:-2][inside] * SUBWORDS + (h[inside] >> np.uint32(19)), minlength=n * SUBWORDS).reshape(n, SUBWORDS)
    found, at = words(raw, bounds)
    of = np.repeat(np.arange(n), np.diff(at))
    key = mix(found + of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    again = np.flatnonzero(key[order][1:] == key[order][:-1])
    age = np.zeros(len(found), np.int64)
    age[order[again + 1]] = np.log2(order[again + 1] - order[again]).astype(np.int64) + 1
    out[:, SUBWORDS:] = np.bincount(of * AGES + np.minimum(age, AGES - 1), minlength=n * AGES).reshape(n, AGES)
    return out


def terms(text: pa.Array) -> np.ndarray:
    """Square roots of the shares of terms, a row for each whole text; zeros for a family that it has none of."""
    x = counts(*flat(text))
    for part in (x[:, :SUBWORDS], x[:, SUBWORDS:]):
        total = part.sum(1, keepdims=True)
        np.divide(part, total, out=part, where=total > 0)
    return np.sqrt(x, out=x)


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 1e-9)


@dataclass
class Model:
    basis: np.ndarray  # terms by dimensions, inverse document frequencies worked in
    vectors: np.ndarray
    labels: np.ndarray
    share: float  # of label 1: the score where nothing is near
    neighbours: int
    power: int

    def scores(self, text: pa.Array, block: int = 128) -> np.ndarray:
        """From 0 to 1 for each text: how the nearest labelled vectors vote."""
        k = min(self.neighbours, len(self.labels))
        if not k or not len(text):
            return np.full(len(text), self.share)
        out = []
        for part in sliced([pa.RecordBatch.from_arrays([text], names=["text"])], block):
            near = unit(terms(part.column(0)) @ self.basis) @ self.vectors.T
            at = np.argpartition(-near, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(near, at, 1), 0).astype(np.float64) ** self.power
            total = weight.sum(1)
            out.append(np.divide((weight * self.labels[at]).sum(1), total, out=np.full(len(total), self.share), where=total > 0))
        return np.clip(np.concatenate(out), 0, 1)


def _fit(x: np.ndarray, labels: np.ndarray, share: float, dimensions: int, neighbours: int, power: int) -> Model:
    """x: terms of the sample, a row a text."""
    n = (x > 0).sum(0)
    idf = np.where(n >= min(LEAST, len(x)), np.log((1 + len(x)) / (1 + n)), 0).astype(np.float32)
    x = x * idf
    rng = np.random.default_rng(5)
    d = min(dimensions, max(len(x), 1))
    q = rng.standard_normal((TERMS, d + 8)).astype(np.float32)
    for _ in range(6):  # subspace iteration
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, size, turn = np.linalg.svd(x @ q, full_matrices=False)
    basis = (q @ turn.T)[:, :d] / np.sqrt(np.maximum(size[:d], 1e-6 * size.max(initial=1)))
    return Model((basis * idf[:, None]).astype(np.float32), unit(x @ basis), labels, share, neighbours, power)


def held_out(id_column: str):
    """Whether the id's text has a CRC-32 that 5 divides; such labels are never learnt from. False for a null id."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", most_labelled: int = 4096, dimensions: int = 48, neighbours: int = 15, power: int = 32, seed: int = 11) -> Model:
    """Learns from labelled rows that are not held out; at most ``most_labelled``, by a seeded hash of the id.

    Rows of ``labels`` with a null id or label, or whose id no document has, do not count;
    a document that repeats counts once for each time. Without any, every score is 0.5.
    """
    known = labels.select(F.col(id_column).alias("id"), F.col(label_column).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("id").isNotNull() & ~held_out("id"))
    known = materialize(known.join(docs.select(F.col(id_column).alias("id")), "id", "left_semi"), "labelled")
    order = F.xxhash64(F.lit(seed), "id"), F.col("id"), F.col("label")
    chosen = F.broadcast(known.orderBy(*order).limit(most_labelled))  # rows of two numbers
    texts = docs.select(F.col(id_column).alias("id"), text_of(text_column).alias("text")).join(chosen, "id").select("id", "text", "label")

    def run(batches):
        for b in sliced(batches, 128):
            found = terms(b.column(1))
            k = [np.flatnonzero(row).astype(np.uint16) for row in found]
            v = [row[i].tobytes() for row, i in zip(found, k, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([i.tobytes() for i in k], pa.binary()), pa.array(v, pa.binary())], names=["id", "label", "k", "v"])

    kind = docs.schema[id_column].dataType.simpleString()
    rows = texts.mapInArrow(run, f"id {kind}, label int, k binary, v binary").orderBy(*order, "k", "v").limit(most_labelled).collect()
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    share = counts.get(1, 0) / sum(counts.values()) if counts else 0.5
    x = np.zeros((len(rows), TERMS), np.float32)
    for row, r in zip(x, rows, strict=True):
        row[np.frombuffer(r["k"], np.uint16)] = np.frombuffer(r["v"], np.float32)
    if not rows:
        return Model(np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), share, neighbours, power)
    return _fit(x, np.array([r["label"] for r in rows], np.float64), share, dimensions, neighbours, power)


def score(model: Model, spark):
    """A function from a text column to scores; a null text counts as empty."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def of(text: pa.Array) -> pa.Array:
        return pa.array(shared.value.scores(text))

    return of


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_column: str = "doc_id", text_column: str = "text", **how) -> DataFrame:
    """One row for each row of ``docs``: id, ``held_out``, ``score``, ``predicted`` (1 from ``threshold`` on).

    Scores use whole texts and nothing else. Texts without a term that the sample has, empty
    and null ones too, get the share of label 1 among labels. Ids pass through, null or repeated;
    other columns are not read.
    """
    of = score(fit(docs, labels, id_column, text_column, **how), docs.sparkSession)
    out = docs.select(F.col(id_column), held_out(id_column).alias("held_out"), of(text_of(text_column)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_column: str = "doc_id", text_column: str = "text", **how) -> DataFrame:
    """The rows of ``docs``, as they are, whose score reaches ``threshold``."""
    of = score(fit(docs, labels, id_column, text_column, **how), docs.sparkSession)
    return docs.where(of(text_of(text_column)) >= threshold)


def op4_knn_quality(spark, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
