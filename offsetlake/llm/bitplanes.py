"""Token ids in files of bit planes or byte planes.

A file holds the ids of a run of documents, in order, cut into blocks of a fixed
number of ids. A block is turned into planes: plane k has bit (or byte) k of every
id. Planes that are zero throughout at the top are left out; the others are
compressed one by one with zstandard. Layout, little-endian:

    "BPL1" | planes of all blocks | footer | footer length u64 | "1LPB"

The footer, itself compressed, is an Arrow stream of the chunk index (offset, ids,
sizes of the planes), one of the documents (id, number of ids), and says how long
the first is. Any block can be read alone by its index entry.

Files are written by the tasks that hold the documents, each under a name of its
own attempt. A file counts only once the table of files, which Spark commits, has
its name: attempts that fail, run twice or are lost leave files nobody reads.
"""

from __future__ import annotations

import io
import struct
import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe_automaton import tokenizer_path
from .presplit import flat, word_starts
from .shared import materialize, sliced, table, text_of, work_path

BLOCK = 1 << 16
PARTS = 3  # of eight bytes, of words that the table keeps
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
HEAD, TAIL = b"BPL1", b"1LPB"


def to_planes(ids: np.ndarray, kind: str = "bit") -> list[bytes]:
    """Planes of a block of unsigned 32-bit ids, lowest first, without those that are zero above the highest id."""
    width = int(ids.max(initial=0)).bit_length()
    if kind == "byte":
        columns = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
        return [columns[:, k].tobytes() for k in range((width + 7) // 8)]
    return [np.packbits((ids >> np.uint32(k)).astype(np.uint8) & 1).tobytes() for k in range(width)]


def from_planes(planes: list[bytes], n: int, kind: str = "bit") -> np.ndarray:
    ids = np.zeros(n, np.uint32)
    for k, plane in enumerate(planes):
        raw = np.frombuffer(plane, np.uint8)
        ids |= (raw if kind == "byte" else np.unpackbits(raw, count=n)).astype(np.uint32) << np.uint32(8 * k if kind == "byte" else k)
    return ids


def _stream(batch: pa.RecordBatch) -> bytes:
    out = io.BytesIO()
    with pa.ipc.new_stream(out, batch.schema) as w:
        w.write_batch(batch)
    return out.getvalue()


class Writer:
    """Appends documents to a file; holds one block and the lists of the footer."""

    def __init__(self, file, id_type: pa.DataType, kind: str = "bit", block: int = BLOCK, level: int = 1):
        self.file, self.kind, self.block, self.id_type = file, kind, block, id_type
        self.shrink = zstandard.ZstdCompressor(level=level).compress
        self.at = file.write(HEAD)
        self.held: list[np.ndarray] = []
        self.n_held = self.total = 0
        self.chunks: list[tuple[int, int, list[int]]] = []
        self.ids: list = []
        self.counts: list[int] = []

    def add(self, docs: list, counts: list[int], ids: np.ndarray) -> None:
        """Documents in order: their ids side by side, and how many each has."""
        self.ids += docs
        self.counts += counts
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.block:
            every = np.concatenate(self.held)
            whole = len(every) // self.block * self.block
            for i in range(0, whole, self.block):
                self._put(every[i : i + self.block])
            self.held, self.n_held = [every[whole:]], len(every) - whole

    def _put(self, ids: np.ndarray) -> None:
        planes = [self.shrink(p) for p in to_planes(ids, self.kind)]
        self.chunks.append((self.at, len(ids), [len(p) for p in planes]))
        for p in planes:
            self.at += self.file.write(p)
        self.total += len(ids)

    def close(self) -> None:
        if self.n_held:
            self._put(np.concatenate(self.held))
        index = _stream(pa.RecordBatch.from_arrays([pa.array([c[i] for c in self.chunks], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.list_(pa.int64())))], names=["offset", "n_ids", "sizes"]))
        docs = _stream(pa.RecordBatch.from_arrays([pa.array(self.ids, self.id_type), pa.array(self.counts, pa.int64())], names=["id", "n_ids"]))
        footer = self.shrink(struct.pack("<BQ", self.kind == "bit", len(index)) + index + docs)
        self.file.write(footer + struct.pack("<Q", len(footer)) + TAIL)


class Reader:
    """The chunk index and documents of a file; blocks are read when asked for."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        file.seek(size - 12)
        length, tail = struct.unpack("<Q4s", file.read(12))
        file.seek(0)
        if tail != TAIL or file.read(4) != HEAD:
            raise ValueError("not a file of planes, or cut short")
        file.seek(size - 12 - length)
        footer = zstandard.decompress(file.read(length))
        bit, n = struct.unpack_from("<BQ", footer)
        self.kind = "bit" if bit else "byte"
        self.chunks = pa.ipc.open_stream(footer[9 : 9 + n]).read_all().to_pylist()
        self.docs = pa.ipc.open_stream(footer[9 + n :]).read_all()
        self.starts = np.cumsum([0] + [c["n_ids"] for c in self.chunks])
        self.unpack = zstandard.ZstdDecompressor().decompress

    def block(self, k: int) -> np.ndarray:
        c = self.chunks[k]
        self.file.seek(c["offset"])
        raw, at, planes = self.file.read(sum(c["sizes"])), 0, []
        for size in c["sizes"]:
            planes.append(self.unpack(raw[at : at + size]))
            at += size
        return from_planes(planes, c["n_ids"], self.kind)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids [start, stop) of the file, from the blocks that hold them."""
        first = int(np.searchsorted(self.starts, start, "right")) - 1
        last = int(np.searchsorted(self.starts, stop, "left"))
        parts = [self.block(k) for k in range(first, last)]
        return np.concatenate(parts)[start - self.starts[first] : stop - self.starts[first]] if parts else np.zeros(0, np.uint32)

    def documents(self) -> Iterator[tuple[object, np.ndarray]]:
        """Every document in order; one block and one document are held."""
        held, k = np.zeros(0, np.uint32), 0
        for doc_id, n in zip(self.docs["id"].to_pylist(), self.docs["n_ids"].to_pylist(), strict=True):
            parts, have = [held], len(held)
            while have < n:
                parts.append(self.block(k))
                have += len(parts[-1])
                k += 1
            whole = np.concatenate(parts) if len(parts) > 1 else held
            yield doc_id, whole[:n]
            held = whole[n:]


class LibraryEncoder:
    """The tokenizers library behind a table of words.

    Texts are split into the words that the vocabulary is split by. The table has a
    slot for the bytes of a word of up to 24, found by a hash of them and compared
    whole, and where its ids lie in a pool; a later word takes the slot of an earlier
    one. The library encodes the words of a batch that the table does not have, each
    once, and texts with special tokens whole.
    """

    def __init__(self, path: str, slots: int = 1 << 20, most: int = 1 << 23):
        """most: ids in the pool; a full one is emptied with the table."""
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library, self.slots, self.most = Tokenizer.from_file(path), slots, most
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self._empty()

    def _empty(self) -> None:
        self.keys = np.zeros((PARTS, self.slots), np.uint64)
        self.size = np.zeros(self.slots, np.int16)  # of the word, 0: free
        self.first = np.zeros(self.slots, np.int64)
        self.n = np.zeros(self.slots, np.int64)
        self.pool = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def _pooled(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Encodes texts into the pool: where the ids of each begin, and how many they are."""
        found = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        n = np.fromiter(map(len, found), np.int64, len(found))
        total = int(n.sum())
        while self.used + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + total] = np.fromiter(chain.from_iterable(found), np.uint32, total)
        first = self.used + np.cumsum(n) - n
        self.used += total
        return first, n

    def encode(self, text: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts without nulls, side by side, each text's with ``end`` behind them; and how many each text has."""
        if self.used > self.most:
            self._empty()
        raw, bounds = flat(text)
        whole = raw.tobytes()
        starts = word_starts(raw, bounds[:-1])
        sizes = np.diff(starts, append=len(raw))
        of = np.searchsorted(bounds, starts, "right") - 1  # the text of a word
        odd = []
        if any(s in whole for s in self.special):
            odd = [i for i in range(len(text)) if any(s in whole[bounds[i] : bounds[i + 1]] for s in self.special)]
            plain = ~np.isin(of, odd)
            starts, sizes, of = starts[plain], sizes[plain], of[plain]
        first, n = self._words(whole, starts, sizes)
        if odd:
            at, more = self._pooled([whole[bounds[i] : bounds[i + 1]].decode() for i in odd])
            place = np.searchsorted(of, odd)
            first, n, of = np.insert(first, place, at), np.insert(n, place, more), np.insert(of, place, odd)
        ids = self.pool[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        counts = np.bincount(of, weights=n, minlength=len(text)).astype(np.int64)
        if end is not None:
            ids = np.insert(ids, np.cumsum(counts), np.uint32(end))
            counts += 1
        return ids, counts

    def _words(self, whole: bytes, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in the pool the ids of each word lie, and how many they are."""
        eight = np.ndarray(len(whole) + 8 * PARTS - 7, "<u8", whole + bytes(8 * PARTS), strides=(1,))  # eight bytes from any place
        short = sizes <= 8 * PARTS
        key, h = [], np.zeros(len(starts), np.uint64)
        for k in range(PARTS):
            part = np.where(sizes > 8 * k, eight[np.minimum(starts + 8 * k, len(eight) - 1)] & _LOW[np.clip(sizes - 8 * k, 0, 8)], np.uint64(0))
            key.append(part)
            h = (h ^ part) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
        slot = (h & np.uint64(self.slots - 1)).astype(np.int64)
        known = short & (self.size[slot] == sizes)
        for k in range(PARTS):
            known &= self.keys[k][slot] == key[k]
        first, n = self.first[slot], self.n[slot]
        new = np.flatnonzero(~known)
        if len(new):
            place: dict[bytes, int] = {}
            of = np.array([place.setdefault(whole[a : a + s], len(place)) for a, s in zip(starts[new].tolist(), sizes[new].tolist(), strict=True)])
            at, many = self._pooled([w.decode() for w in place])
            first[new], n[new] = at[of], many[of]
            new = new[short[new]]
            slots, one = np.unique(slot[new], return_index=True)
            new = new[one]
            for k in range(PARTS):
                self.keys[k][slots] = key[k][new]
            self.size[slots], self.first[slots], self.n[slots] = sizes[new], first[new], n[new]
        return first, n


@lru_cache(maxsize=2)
def _encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def _open(url: str):
    """The file system of a path: file, hdfs, s3 and others that Arrow reaches from executors."""
    return pyarrow.fs.FileSystem.from_uri(url if "://" in url or url.startswith("file:") else f"file://{url}")


def write_token_files(docs: DataFrame, folder: str, path: str, end_id: int = 0, kind: str = "bit", block: int = BLOCK, id_column: str = "doc_id", text_column: str = "text", part_bytes: int = 1 << 24, most_parts: int = 20_000, file_ids: int = 1 << 26) -> DataFrame:
    """Encodes every whole text and writes the ids, ``end_id`` behind each document's, in ascending id order.

    Returns the table of files: ``shard`` long in that order, ``file``, ``n_docs``,
    ``n_ids``. Documents are ranged by id over a partition for every ``part_bytes`` of
    text, ``most_parts`` at most, and a task begins another file behind ``file_ids``
    ids, so files, and the lists of their footers, are bounded by size; the order
    holds across files. Ids that tie or are null (first) order by text. A null text
    counts as the empty one and has the end id alone. No rows: no files. Other columns
    are not read. A task holds a slice of an Arrow batch (256 rows and 1 MB, or one
    text), one block and the footer of its file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = file = name = None
        rolled = 0

        def done() -> pa.RecordBatch:
            writer.close()
            file.close()
            shard = (TaskContext.get().partitionId() << 24) + rolled
            return pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64()), "file": [f"{folder}/{name}"], "n_docs": pa.array([len(writer.ids)], pa.int64()), "n_ids": pa.array([writer.total], pa.int64())})

        for batch in sliced(batches):
            if writer is None:
                system, root = _open(folder)
                system.create_dir(root, recursive=True)
                name = f"{uuid.uuid4().hex}.bpl"
                file = system.open_output_stream(f"{root}/{name}")
                writer = Writer(file, batch.schema.field(0).type, kind, block)
            ids, counts = _encoder(path).encode(batch.column(1), end_id)
            writer.add(batch.column(0).to_pylist(), counts.tolist(), ids)
            if writer.total >= file_ids:
                yield done()
                writer = None
                rolled += 1
        if writer is not None:
            yield done()

    rows = docs.select(F.col(id_column).alias("id"), text_of(text_column).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    ranged = rows.repartitionByRange(max(1, min(most_parts, -(-size // part_bytes))), F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "text")
    return ranged.mapInArrow(run, "shard long, file string, n_docs long, n_ids long")


def read_token_files(files: DataFrame, id_kind: str = "long") -> DataFrame:
    """Per document of the files: ``doc_id``, ``start`` (ids of all documents before it), ``ids`` binary, little-endian u32.

    A row for each document written, those with a null or repeated id too; no rows for a table of no files.
    """
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    placed = files.withColumn("before", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long")).select("file", "before")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for url, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                system, place = _open(url)
                with system.open_input_file(place) as file:
                    own = Reader(file)
                    kind, held, size = own.docs.schema.field("id").type, [], 0
                    for doc_id, ids in own.documents():
                        held.append((doc_id, start, ids.astype("<u4").tobytes()))
                        start += len(ids)
                        size += 4 * len(ids)
                        if size > 1 << 24:
                            yield _rows(held, kind)
                            held, size = [], 0
                    if held:
                        yield _rows(held, kind)

    n = max(1, files.count())
    return placed.repartition(n).mapInArrow(run, f"doc_id {id_kind}, start long, ids binary")


def _rows(held: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    ids, starts, raw = zip(*held, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(starts, pa.int64()), pa.array(raw, pa.binary())], names=["doc_id", "start", "ids"])


def op1_bitplane_tokens(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    files = materialize(write_token_files(docs, work_path(spark, "planes"), tokenizer_path("byte_bpe_50k.json")), "files")
    out = read_token_files(files, docs.schema["doc_id"].dataType.simpleString())
    return out.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
