"""Encoders and counters against the libraries themselves, and token files against what went in."""

import io
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import regex
from tokenizers import Tokenizer

from offsetlake.llm import bitplanes, bpe_automaton, presplit, token_counts
from offsetlake.llm.shared import materialize, work_path

BYTES, PIECES = bpe_automaton.tokenizer_path("byte_bpe_50k.json"), bpe_automaton.tokenizer_path("piece_bpe_32k.model")


def fuzz(n=400):
    rnd = random.Random(7)
    mixed = ["a", "b", " ", "  ", "\n", "\t", "'s", "'ll", '"', "<s>", "<|endoftext|>", "!", "?", "0", "12", chr(0xE9), chr(0x4E2D), chr(0x1F389), chr(0x3000), chr(0x2581), chr(0x85), "\x00", "the", "ing", "er"]
    out = ["", " ", "   ", "a" * 3000, " a" * 50, chr(0x1F389) * 20]
    out += ["".join(rnd.choice(mixed) for _ in range(rnd.randint(1, 40))) for _ in range(n)]
    out += ["".join(rnd.choice("theanorigs") for _ in range(rnd.randint(1, 120))) for _ in range(n)]
    return out


def texts(spark):
    return [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()] + fuzz()


def test_automaton_gives_the_ids_and_text_of_the_library(spark):
    library, own = Tokenizer.from_file(BYTES), bpe_automaton.encoder(BYTES)
    for t in texts(spark):
        ids = library.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids, t[:80]
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_gadgets_on_a_small_alphabet():
    """Against merging by rank, for every word of up to seven letters; one merge is of a token with itself."""
    names = {0: b"a", 1: b"b", 2: b"aa", 3: b"ab", 4: b"aab", 5: b"bab", 6: b"aaaa"}
    merges = [(0, 0, 2), (0, 1, 3), (2, 1, 4), (1, 3, 5), (2, 2, 6)]
    automaton = bpe_automaton.BpeAutomaton({97: 0, 98: 1}, merges, names)
    ranks = {(a, b): (k, m) for k, (a, b, m) in enumerate(merges)}
    for n in range(1, 8):
        for bits in range(2**n):
            word = bytes(97 + (bits >> i & 1) for i in range(n))
            ids = [b - 97 for b in word]
            while True:
                best = min(((ranks[p][0], i) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in ranks), default=None)
                if best is None:
                    break
                i = best[1]
                ids[i : i + 2] = [ranks[ids[i], ids[i + 1]][1]]
            assert automaton.encode(word) == ids, word


def test_table_may_be_forgotten_and_words_stay_in_step():
    automaton, special = bpe_automaton.load(BYTES)
    automaton.table.most = 50
    small, library = bpe_automaton.Encoder(automaton, special), Tokenizer.from_file(BYTES)
    found = fuzz(60)
    ids, bounds = small.encode_batch(pa.array(found))
    assert automaton.table.used < 5_000
    for t, a, b in zip(found, bounds, bounds[1:], strict=False):
        assert ids[a:b].tolist() == library.encode(t, add_special_tokens=False).ids


def test_every_byte_is_one_look_up(monkeypatch):
    automaton, _ = bpe_automaton.load(BYTES)
    looked, own = [], automaton.table._look
    monkeypatch.setattr(automaton.table, "_look", lambda state, symbols: looked.append(len(state)) or own(state, symbols))
    for word in (b" tokenization", b"a" * 500, b"xqzjkvw", "\u4e2d\u6587".encode()):
        looked.clear()
        assert b"".join(automaton.names[i] for i in automaton.encode(word)) == word
        assert sum(looked) == len(word)


def test_words_of_a_batch_are_those_of_the_pattern():
    split = regex.compile(presplit.PRE_SPLIT).findall
    rnd = random.Random(1)
    parts = ["'", "'s", "'ll", "'re", "'r", "'ve", "e", "l", " ", "  ", "\n", "\t", chr(0x3000), chr(0xE9), "1", chr(0x663), "!", "_", chr(0x4E2D), chr(0x1F600), "ab", "\x85", "\xa0", "'S", chr(0x17F), "'v" + chr(0xE9)]
    found = fuzz() + ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12))) for _ in range(5000)]
    raw, bounds = presplit.flat(pa.array(found))
    want, at = [], 0
    for t in found:
        for w in split(t):
            want.append(at)
            at += len(w.encode())
    assert presplit.word_starts(raw, bounds[:-1]).tolist() == want


@pytest.mark.parametrize("chunk", [1 << 12, 5])
def test_counts_are_those_of_the_library(spark, chunk, monkeypatch):
    from sentencepiece import SentencePieceProcessor

    monkeypatch.setattr(token_counts, "CHUNK", chunk)
    library, own = SentencePieceProcessor(model_file=PIECES), token_counts.transducer(PIECES)
    found = texts(spark) if chunk > 5 else fuzz(100)
    for t, n in zip(found, own.count_batch(pa.array(found)), strict=True):
        assert n == len(library.encode(t)), t[:80]


def test_chunk_maps_compose_in_any_order(monkeypatch):
    """Arrays of (state, count, state) of three chunks, cut anywhere, those without a space too."""
    monkeypatch.setattr(token_counts, "WINDOW", 24)
    own = token_counts.transducer(PIECES)
    rnd = random.Random(5)
    for text in ("some text  with spaces and longwordswithoutany ", "".join(rnd.choice("aehinorst") for _ in range(90))):
        symbols, _ = token_counts.marked(pa.array([text]))
        n = len(symbols)
        for i in range(1, n - 1, 3):
            for j in range(i + 1, n, 4):
                a, b, c = own.maps(symbols, [(0, 0, i), (max(0, i - 24), i, j), (max(0, j - 24), j, n)])
                left, right = (token_counts.compose(token_counts.compose(a, b), c), token_counts.compose(a, token_counts.compose(b, c)))
                assert (left.enter, left.count.tolist(), left.leave) == (right.enter, right.count.tolist(), right.leave)
                if token_counts.lacking([a, b, c], own.start) is None:
                    assert left.count[left.at(own.start)] == own.count(text)


def test_a_state_that_a_map_lacks_is_added(monkeypatch):
    """With hardly a window the states found are wrong at times; counts are exact all the same."""
    monkeypatch.setattr(token_counts, "WINDOW", 1)
    monkeypatch.setattr(token_counts, "CHUNK", 7)
    own = token_counts.transducer(PIECES)
    rnd = random.Random(6)
    met = []
    monkeypatch.setattr(token_counts, "lacking", lambda maps, state, real=token_counts.lacking: met.append(found := real(maps, state)) or found)
    for _ in range(20):
        text = "".join(rnd.choice("aehinorst") for _ in range(200))
        assert own.count(text) == len(own.merged(chr(token_counts.MARK) + text))
    assert any(met)


def test_long_texts_are_many_rows(spark, monkeypatch):
    """A text of ten million letters without a space, and others, over rows that tasks map in parallel."""
    from sentencepiece import SentencePieceProcessor

    rnd = random.Random(8)
    bit = "".join(rnd.choice("aehinorst") for _ in range(9_973))
    spaced = " ".join(bit[i : i + 1 + i % 11] for i in range(0, 9_000, 9)) + "  "
    found = [bit * 1003, spaced * 30, " " * 70_001, chr(0x4E2D) * 66_000, "short", None, "x" * 65_536, "x" * 65_537]
    docs = spark.createDataFrame(list(enumerate(found)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, PIECES).collect()}
    library = SentencePieceProcessor(model_file=PIECES)
    assert got == {i: len(library.encode(t or "")) for i, t in enumerate(found)}


def test_counts_on_odd_rows(odd, nothing):
    rows = token_counts.count_tokens(odd, PIECES).collect()
    assert len(rows) == odd.count()
    assert {(r.doc_id, r.n_bytes, r.n_tokens) for r in rows if r.doc_id in (2, 3)} == {(2, 0, 0), (3, 0, 0)}
    assert token_counts.count_tokens(nothing, PIECES).count() == 0


def test_encoding_on_odd_rows(odd, nothing):
    rows = bpe_automaton.encode_documents(odd, BYTES).collect()
    assert sorted(r.decoded for r in rows) == sorted(r.text or "" for r in odd.collect())
    assert [r.ids for r in rows if r.doc_id in (2, 3)] == [[], []]
    assert bpe_automaton.encode_documents(nothing, BYTES).count() == 0


@pytest.mark.parametrize("kind", ["bit", "byte"])
def test_planes_round_trip(kind):
    rng = np.random.default_rng(3)
    for n, top in ((0, 1), (1, 1), (7, 2), (1000, 50_257), (4096, 2**32 - 1)):
        ids = rng.integers(0, top, n, dtype=np.uint32)
        planes = bitplanes.to_planes(ids, kind)
        assert (bitplanes.from_planes(planes, n, kind) == ids).all()
    assert len(bitplanes.to_planes(np.array([5], np.uint32), "bit")) == 3


class _File(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def test_any_range_of_a_file_reads_alone():
    rng = np.random.default_rng(4)
    docs = [rng.integers(0, 50_000, int(n)).astype(np.uint32) for n in rng.integers(0, 90, 40)]
    file = _File()
    writer = bitplanes.Writer(file, pa.int64(), block=64)
    for i, d in enumerate(docs):
        writer.add([i], [len(d)], d)
    writer.close()
    reader, whole = bitplanes.Reader(file), np.concatenate(docs)
    assert [(i, d.tolist()) for i, d in reader.documents()] == [(i, d.tolist()) for i, d in enumerate(docs)]
    for a, b in ((0, 1), (60, 70), (64, 128), (0, len(whole)), (5, 5)):
        assert (reader.ids(a, b) == whole[a:b]).all()
    with pytest.raises(ValueError):
        bitplanes.Reader(_File(file.getvalue()[:-1]))


def test_table_of_words_gives_the_ids_of_the_library():
    library, own = Tokenizer.from_file(BYTES), bitplanes.LibraryEncoder(BYTES, slots=64, most=500)
    found = fuzz(80) + ["a\0", "a", "a" * 24, "a" * 25, "b" * 23 + chr(0xE9)]
    for _ in range(3):
        for i in range(0, len(found), 50):
            some = found[i : i + 50]
            ids, counts = own.encode(pa.array(some), 0)
            at = 0
            for t, n in zip(some, counts.tolist(), strict=True):
                assert ids[at : at + n].tolist() == library.encode(t, add_special_tokens=False).ids + [0], t
                at += n
    assert own.encode(pa.array([], pa.string()))[0].tolist() == []


def test_files_end_by_size(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "repeat('word ', 40) as text")
    files = materialize(bitplanes.write_token_files(docs, work_path(spark, "planes"), BYTES, block=4096, part_bytes=1 << 19, file_ids=20_000), "files")
    rows = files.collect()
    assert len(rows) > 2 and sum(r.n_docs for r in rows) == 3000
    found = sorted(bitplanes.read_token_files(files).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in found] == list(range(3000))
    assert all(b.start - a.start == len(a.ids) // 4 for a, b in zip(found, found[1:], strict=False))


def test_token_files(spark, odd, nothing):
    library = Tokenizer.from_file(BYTES)
    for docs in (odd, spark.read.parquet("/root/testdata/sf0.001/documents.parquet")):
        files = materialize(bitplanes.write_token_files(docs, work_path(spark, "planes"), BYTES), "files")
        found = sorted(bitplanes.read_token_files(files).collect(), key=lambda r: r.start)
        want = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
        assert [r.doc_id for r in found] == [r.doc_id for r in want]
        at = 0
        for got, row in zip(found, want, strict=True):
            ids = library.encode(row.text or "", add_special_tokens=False).ids + [0]
            assert got.start == at and zlib.crc32(got.ids) == zlib.crc32(np.array(ids, "<u4").tobytes())
            at += len(ids)
    files = materialize(bitplanes.write_token_files(nothing, work_path(spark, "planes"), BYTES), "files")
    assert files.count() == 0 and bitplanes.read_token_files(files).count() == 0
