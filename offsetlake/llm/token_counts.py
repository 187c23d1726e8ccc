"""Token counts by a finite-state transducer compiled from a piece vocabulary.

The transducer reads code points (:class:`~.tables.Machine`): a state holds, for each
place a piece may still have begun at, the node of the piece trie reached since, the
piece before it and how many tokens more or less its prefix has. One piece fits
where a symbol ends; the change in the number of tokens of the prefix is the
annotation of the transition, so adding up annotations counts the tokens. States and
transitions are compiled when first met, in a table of bounded size.

No piece has a space mark behind another character, so such a mark leads back to the
start state whatever the state was: runs between them are driven side by side.

What has no such mark, or is long, is cut into chunks. The map of a chunk takes the
states that it may be entered in to (count, state): arrays of both. Which states
those are is found from the symbols before the cut: behind the last return to the
start there is one, and without a return in the window they come of every place a
piece may have begun at its beginning, which soon agree. Maps compose associatively,
pair by pair; a state that a map lacks is driven through its chunk then and added, so
the count is exact. A long text is many rows, whose maps tasks make in parallel.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_automaton import tokenizer_path
from .presplit import code_points, flat
from .shared import key_runs, materialize, sliced, table, text_of
from .tables import Machine

MARK = 0x2581  # stands for a space in pieces
CHUNK = 1 << 12  # code points of a chunk that is driven beside others
ROW = 1 << 16  # of a row of a long text
WINDOW = 256  # read before a chunk to find the states it may be entered in
ANY = b""  # entered in any state: the chunk begins with a return to the start


@dataclass
class ChunkMap:
    """From the states a chunk is entered in (their items as bytes) to tokens and the states it is left in."""

    enter: list[bytes]
    count: np.ndarray
    leave: list[bytes]

    def at(self, state: bytes) -> int | None:
        """The place of a state among those of ``enter``, if the map has it."""
        if self.enter[:1] == [ANY]:
            return 0
        return self.enter.index(state) if state in self.enter else None


def compose(first: ChunkMap, second: ChunkMap) -> ChunkMap:
    """The map of two chunks that follow one another, on the states that get through both."""
    through = [(i, j) for i, s in enumerate(first.leave) if (j := second.at(s)) is not None]
    i, j = ([k[side] for k in through] for side in (0, 1))
    return ChunkMap([first.enter[k] for k in i], first.count[i] + second.count[j], [second.leave[k] for k in j])


def composed(maps: list[ChunkMap]) -> ChunkMap:
    """The map of all chunks in order: neighbours are composed, then neighbours of those, and so on."""
    while len(maps) > 1:
        maps = [compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
    return maps[0]


def lacking(maps: list[ChunkMap], state: bytes) -> tuple[int, bytes] | None:
    """The first chunk that is entered in a state its map has not, and that state."""
    for k, m in enumerate(maps):
        i = m.at(state)
        if i is None:
            return k, state
        state = m.leave[i]
    return None


class CountTransducer:
    def __init__(self, scores: dict[str, float], most: int = 1 << 19):
        """scores: of each ordinary piece; higher merges first, then the leftmost. most: transitions to hold."""
        self.scores, self.pieces = scores, list(scores)
        self.reach = max(map(len, scores), default=1)
        for piece in scores:
            if chr(MARK) in piece.lstrip(chr(MARK)):
                raise ValueError(f"{piece!r} has a space mark inside")
            if any(c not in scores for c in piece):
                raise ValueError(f"{piece!r} has characters that are no pieces")
        self.machine = Machine((([ord(c) for c in p], i) for i, p in enumerate(self.pieces)), self.fits, foreign=lambda c: len(chr(c).encode()), counted=True, most=most)
        self.start = self.machine.states[self.machine.start]

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text by merging, one by one, the pair of best score."""
        parts = list(text)
        score = [self.scores.get(a + b) for a, b in zip(parts, parts[1:], strict=False)]
        while True:
            best, i = max(((s, -k) for k, s in enumerate(score) if s is not None), default=(None, 0))
            if best is None:
                return parts
            i = -i
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del score[i]
            if i:
                score[i - 1] = self.scores.get(parts[i - 1] + parts[i])
            if i < len(score):
                score[i] = self.scores.get(parts[i] + parts[i + 1])

    def fits(self, last: int, piece: int) -> bool:
        a, b = self.pieces[last], self.pieces[piece]
        return b[0] == chr(MARK) != a[-1] or self.merged(a + b) == [a, b]

    def maps(self, symbols: np.ndarray, spans: list[tuple[int, int, int]], enter: list[list[bytes]] | None = None) -> list[ChunkMap]:
        """Maps of chunks: (where reading may begin, begin, end) of each in ``symbols``.

        A chunk whose text begins where reading may begin is entered in what its symbols
        before ``begin`` lead to, so give the place of ``begin`` for the first of a text.
        ``enter`` has the states to map, instead of those found.
        """
        marks = symbols == MARK
        back = np.flatnonzero(marks & np.append(True, ~marks[:-1]))  # returns to the start, and maybe the first symbol
        tasks: list[tuple[int, int, int, bytes]] = []  # chunk, from, to, state
        if enter is None:
            for k, (low, begin, _) in enumerate(spans):
                r = int(np.searchsorted(back, begin, "right")) - 1
                if low < begin and r >= 0 and back[r] > low:
                    tasks.append((k, int(back[r]), begin, self.start))
                else:
                    tasks += [(k, p, begin, self.start) for p in range(low, min(low + self.reach, begin))] or [(k, begin, begin, self.start)]
            enter = [[] for _ in spans]
            for (k, p, begin, _), state in zip(tasks, self._states(symbols, tasks)[1], strict=True):
                returns = p == begin > spans[k][0]
                enter[k].append(ANY if returns else state)
            enter = [list(dict.fromkeys(e)) for e in enter]
        first = np.searchsorted(back, [b for _, b, _ in spans], "left")
        past = np.searchsorted(back, [e for _, _, e in spans], "left")
        heads, runs = [], []
        for k, (low, begin, end) in enumerate(spans):
            some = back[first[k] : past[k]]
            if low == begin and len(some) and some[0] == begin:
                some = some[1:]  # the text's own beginning
            stop = int(some[0]) if len(some) else end
            heads += [(k, begin, stop, self.start if s == ANY else s) for s in enter[k]]
            runs += [(k, int(a), int(b), self.start) for a, b in zip(some, np.append(some, end)[1:], strict=True)]
        counts, states = self._states(symbols, heads + runs)
        tail, leave = np.zeros(len(spans), np.int64), {}
        for (k, *_), n, s in zip(runs, counts[len(heads) :], states[len(heads) :], strict=True):
            tail[k] += n
            leave[k] = s
        out, at = [], 0
        for k, own in enumerate(enter):
            n = len(own)
            out.append(ChunkMap(own, counts[at : at + n] + tail[k], [leave.get(k, s) for s in states[at : at + n]]))
            at += n
        return out

    def _states(self, symbols, tasks) -> tuple[np.ndarray, list[bytes]]:
        at = np.array([t[1] for t in tasks], np.int64)
        return self.machine.maps(symbols, at, np.array([t[2] for t in tasks], np.int64) - at, [t[3] for t in tasks])

    def count_long(self, symbols: np.ndarray, chunk: int) -> int:
        """Tokens of one run or text: chunk maps, composed, applied to the start state."""
        spans = [(max(0, a - WINDOW) if a else 0, a, min(a + chunk, len(symbols))) for a in range(0, len(symbols), chunk)]
        maps = self.maps(symbols, spans)
        while (found := lacking(maps, self.start)) is not None:
            k, state = found
            more = self.maps(symbols, [spans[k]], [[state]])[0]
            maps[k] = ChunkMap(maps[k].enter + more.enter, np.append(maps[k].count, more.count), maps[k].leave + more.leave)
        whole = composed(maps)
        return int(whole.count[whole.at(self.start)])

    def count_batch(self, text: pa.Array) -> np.ndarray:
        """Tokens of whole texts."""
        symbols, bounds = marked(text)
        marks = symbols == MARK
        begins = marks & np.append(True, ~marks[:-1])
        begins[bounds[:-1][np.diff(bounds) > 0]] = True
        starts = np.flatnonzero(begins)
        lengths = np.diff(starts, append=len(symbols))
        short = lengths <= CHUNK
        sums = np.zeros(len(starts), np.int64)
        sums[short] = self.machine.counts(symbols, starts[short], lengths[short])
        for i in np.flatnonzero(~short).tolist():
            sums[i] = self.count_long(symbols[starts[i] : starts[i] + lengths[i]], CHUNK)
        return np.diff(np.append(0, np.cumsum(sums))[np.searchsorted(starts, bounds)])

    def count(self, text: str) -> int:
        return int(self.count_batch(pa.array([text]))[0])


def marked(text: pa.Array, first: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Code points of texts with marks for spaces and one before each text that is not empty (and ``first``), and their bounds."""
    raw, bounds = flat(text)
    cp, at = code_points(raw)
    if at is not None:
        bounds = np.searchsorted(at, bounds)
    some = np.diff(bounds) > 0 if first is None else (np.diff(bounds) > 0) & first
    cp = np.where(cp == 32, MARK, cp).astype(np.int32)
    return np.insert(cp, bounds[:-1][some], MARK), bounds + np.append(0, np.cumsum(some))


@lru_cache(maxsize=2)
def transducer(path: str) -> CountTransducer:
    """One to a worker process. The text must reach merging as it is but for spaces and the mark before it."""
    from sentencepiece import SentencePieceProcessor

    known = SentencePieceProcessor(model_file=path)
    ordinary = [i for i in range(known.get_piece_size()) if not (known.is_byte(i) or known.is_control(i) or known.is_unknown(i) or known.is_unused(i))]
    own = CountTransducer({known.id_to_piece(i): known.get_score(i) for i in ordinary})
    probe = "  A  b" + chr(0xFB01) + chr(0x3000) + " cafe" + chr(0x301) + "\n "
    if any(own.count(t) != len(known.encode(t)) for t in (probe, "a", " a", " ", "")):
        raise ValueError("the vocabulary changes texts before it splits them")
    return own


def _cut(row: int):
    """Rows of long texts: key of the text, number, the window before and the text of each piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for n, a in enumerate(range(0, len(text), row)):
                    low = max(0, a - WINDOW)
                    yield pa.RecordBatch.from_pydict({"key": pa.array([key], pa.int64()), "n": pa.array([n], pa.int64()), "before": pa.array([a - low], pa.int32()), "text": [text[low : a + row]]})

    return run, "key long, n long, before int, text string"


def _maps(path: str):
    """The map of each row, of its own chunks' maps; states that ``enter`` names, or those found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = transducer(path)
        for b in sliced(batches):
            n, before = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 2))
            symbols, bounds = marked(b.column(3), n == 0)
            asked = b.column(4).to_pylist()
            for k in range(b.num_rows):
                low, end = int(bounds[k]), int(bounds[k + 1])
                begin = low + int(before[k])
                spans = [(begin if n[k] == 0 and a == begin else max(low, a - WINDOW), a, min(a + CHUNK, end)) for a in range(begin, end, CHUNK)]
                maps = own.maps(symbols, spans)
                states = maps[0].enter if asked[k] is None else [asked[k]]
                while True:
                    gaps = {g for s in states if (g := lacking(maps, s)) is not None}
                    if not gaps:
                        break
                    for i, state in gaps:
                        more = own.maps(symbols, [spans[i]], [[state]])[0]
                        maps[i] = ChunkMap(maps[i].enter + more.enter, np.append(maps[i].count, more.count), maps[i].leave + more.leave)
                whole = composed(maps)
                for i, state in enumerate(whole.enter):
                    yield pa.RecordBatch.from_pydict({"key": b.column(0).slice(k, 1), "n": b.column(1).slice(k, 1), "enter": pa.array([state], pa.binary()), "count": pa.array([int(whole.count[i])], pa.int64()), "leave": pa.array([whole.leave[i]], pa.binary())})

    return run, "key long, n long, enter binary, count long, leave binary"


def _totals(path: str):
    """Composes the maps of each text in order: its tokens, or the row and state that a map lacks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = transducer(path).start
        for parts in key_runs(batches):
            rows = pa.Table.from_batches(parts).to_pydict()
            maps: list[ChunkMap] = []
            for i, n in enumerate(rows["n"]):
                if n == len(maps):
                    maps.append(ChunkMap([], np.zeros(0, np.int64), []))
                m = maps[n]
                if rows["enter"][i] not in m.enter:
                    m.enter.append(rows["enter"][i])
                    m.count = np.append(m.count, rows["count"][i])
                    m.leave.append(rows["leave"][i])
            gap = lacking(maps, start)
            whole = None if gap else composed(maps)
            yield pa.RecordBatch.from_pydict({
                "key": pa.array(rows["key"][:1], pa.int64()),
                "n_tokens": pa.array([None if gap else int(whole.count[whole.at(start)])], pa.int64()),
                "n": pa.array([gap[0] if gap else None], pa.int64()),
                "enter": pa.array([gap[1] if gap else None], pa.binary()),
            })

    return run, "key long, n_tokens long, n long, enter binary"


def _long_texts(rows: DataFrame, path: str, row: int) -> DataFrame:
    """Tokens of texts of more than ``row`` code points: (key, n_tokens), from maps that tasks make of rows in parallel.

    ``rows`` is a written table of (key, text), each key once.
    """
    cut, schema = _cut(row)
    pieces = rows.mapInArrow(cut, schema)
    make, made = _maps(path)
    total, said = _totals(path)
    maps = materialize(pieces.withColumn("enter", F.lit(None).cast("binary")).repartition("key", "n").mapInArrow(make, made), "maps")
    while True:
        sums = materialize(maps.repartition("key").sortWithinPartitions("key", "n").mapInArrow(total, said), "sums")
        gaps = sums.where("n_tokens is null").select("key", "n", "enter")
        if not gaps.limit(1).count():
            return sums.select("key", "n_tokens")
        more = pieces.join(gaps, ["key", "n"]).select("key", "n", "before", "text", "enter").repartition("key", "n")
        maps = maps.unionByName(materialize(more.mapInArrow(make, made), "maps"))


def count_tokens(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", row: int = ROW) -> DataFrame:
    """Bytes and tokens of every whole text.

    One row for each row of ``docs``: the id column, ``n_bytes`` long, ``n_tokens``
    long. A null text counts as the empty one (0 and 0). Ids pass through, null or
    repeated; other columns are not read. Texts of up to ``row`` code points do not
    move; a longer one is cut into rows of as many, which shuffle and are mapped by
    tasks in parallel, and the maps of one text (some 100 bytes a row) meet in a task.
    A task holds a slice of an Arrow batch (256 rows and 1 MB, or one text) and tables
    of bounded size.
    """
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = transducer(path)
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own.count_batch(batch.column(2)), pa.int64())], names=["id", "n_bytes", "n_tokens"])

    text = text_of(text_column)
    rows = docs.select(F.col(id_column).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    size = F.char_length("text")
    short = rows.where(size <= row).mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    long = materialize(rows.where(size > row).withColumn("key", F.monotonically_increasing_id()), "long-texts")
    named = long.join(_long_texts(long.select("key", "text"), path, row), "key").select("id", "n_bytes", "n_tokens")
    return short.unionByName(named).withColumnRenamed("id", id_column)


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    out = count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))
    return out.withColumn("over_limit", F.col("n_tokens") > 4096)
