"""Secret scans, sketches, quality, mixing and URL lists against brute force on small tables."""

import hashlib
import random
import re
from datetime import date, timedelta

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from offsetlake.llm import mixing, presplit, quality, secrets, sketches, url_lists
from offsetlake.llm.shared import WORD

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


# secrets


def base_spans(text):
    kinds = (
        ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 2, 12),
        ("access", r"AKIA[A-Z0-9]+", 0, 0, 18),
        ("hex", r"[0-9a-f]+", 0, 0, 16),
    )
    found = [(m.start(), k, m.end()) for k, (_, p, f, g, n) in enumerate(kinds) for m in re.finditer(p, text, f) if len(m.group(g)) >= n]
    return [(kinds[k][0], s, e) for s, k, e in sorted(found)]


def secret_texts(n=3000):
    rnd = random.Random(3)
    parts = ["password", "Token", "API_KEY", "apikey", "secret", ":", "=", " ", '"', "'", "AKIA", "ABCDEFGH12345678", "deadbeef", "0123456789abcdef", chr(0xE9), "\n", "abcDEF123+/_.=-", "ghp_", "x" * 36, chr(0x17F) + "ecret", "to" + chr(0x212A) + "en", "-----BEGIN RSA PRIVATE KEY-----", "xoxb-"]
    return [""] + ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14))) for _ in range(n)]


def test_secrets_are_those_of_the_plain_patterns():
    texts = secret_texts()
    base = {r.kind for r in secrets.BASE}
    for t, got in zip(texts, secrets.Scanner(secrets.BASE + secrets.MORE).scan(texts), strict=True):
        assert [s for s in got if s[0] in base] == base_spans(t), t


def test_trigram_queries():
    query = lambda p, **k: secrets.trigram_query(secrets.Rule("r", p, **k))
    has = lambda s: ("has", s)
    assert query(r"[0-9a-f]+") == ("any",)
    assert query(r"AKIA[A-Z]+") == ("and", frozenset({has(b"aki"), has(b"kia")}))
    assert query(r"abc|xyz") == ("or", frozenset({has(b"abc"), has(b"xyz")}))
    assert query(r"(abc)?") == ("any",) and query(r"ab[cd]e+") == ("or", frozenset({has(b"abc"), has(b"abd")}))
    rules = (secrets.Rule("r", r"(foo|quux)[0-9]{2}bar?"), secrets.Rule("q", r"a(bc){2}d"))
    rnd = random.Random(1)
    texts = ["".join(rnd.choice(["foo", "quux", "1", "2", "ba", "r", "a", "bc", "d", " "]) for _ in range(9)) for _ in range(3000)]
    for t, got in zip(texts, secrets.Scanner(rules).scan(texts), strict=True):
        assert [(k, s, e) for k, s, e in got] == [(rules[i].kind, s, e) for s, i, e in sorted((m.start(), i, m.end()) for i, r in enumerate(rules) for m in re.finditer(r.pattern, t))]


def test_patterns_that_are_not_read_are_refused():
    query = lambda p: secrets.trigram_query(secrets.Rule("r", p))
    for wrong in ("(?=abc)d", "a(b", "ab)", r"\bword", "a\\"):
        with pytest.raises((ValueError, IndexError)):
            query(wrong)
    assert query(r"a\.b-c") == ("and", frozenset({("has", b"a.b"), ("has", b".b-"), ("has", b"b-c")}))
    assert query(r"(?:ab|cd)\x2Exy") == ("or", frozenset(("and", frozenset({("has", a + b"."), ("has", a[1:] + b".x"), ("has", b".xy")})) for a in (b"ab", b"cd")))
    assert query(r"^abc$") == ("has", b"abc") and query(r"ab{2}c") == ("and", frozenset({("has", b"abb"), ("has", b"bbc")})) and query(r"abc{0,3}") == ("any",) and query(r"abc.*xyz") == ("and", frozenset({("has", b"abc"), ("has", b"xyz")}))


def test_classes_of_some_letters_give_trigrams():
    """One of five letters gives five ways; a class of more than eight gives none."""
    rules = {r.kind: r for r in secrets.MORE}
    forge = secrets.trigram_query(rules["forge"])
    assert forge == ("or", frozenset(("and", frozenset({("has", b"gh" + c), ("has", b"h" + c + b"_")})) for c in (b"p", b"o", b"u", b"s", b"r")))
    assert secrets.trigram_query(secrets.Rule("r", "a[bcdefghij]k")) == ("any",)
    texts = [f"{a}gh{c}_{'x' * n}" for a in ("", " ", "gh") for c in "pousrqPOUSR" for n in (35, 36, 40)] + ["xox" + c + "-" + "1" * 20 for c in "abprsz"]
    for t, got in zip(texts, secrets.Scanner(secrets.MORE).scan(texts), strict=True):
        assert got == [(r.kind, m.start(), m.end()) for r in secrets.MORE for m in re.finditer(r.pattern, t) if len(m.group()) >= r.least], t


def test_secret_rows(spark, odd, nothing):
    assert secrets.scan_secrets(odd).count() == odd.count() and secrets.scan_secrets(nothing).count() == 0
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(secret_texts(300))], SCHEMA)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in secrets.scan_secrets(docs).collect():
        assert [tuple(s) for s in r.spans if s.kind in ("assign", "access", "hex")] == base_spans(texts[r.doc_id])


# sketches


def shingle_words(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text.lower()) if w]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def test_edited_texts_and_likeness(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in sketches.op6_threshold_sketch(spark, "/root/testdata/sf0.001").collect()}
    rows = sorted(docs.select("doc_id", "text").collect())
    errors = []
    for k, (i, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)].text
        cut = len(t) // 4
        edited = t[: len(t) - cut] + following[:cut]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b = shingle_words(t), shingle_words(edited)
        if len(a) >= 200:
            errors.append(abs(got[i].near_edited - len(a & b) / len(a | b)))
    assert np.mean(errors) < 0.06
    by_text = {}
    for i, t in rows:
        by_text.setdefault(t, set()).add(got[i].fingerprint)
    assert all(len(f) == 1 for f in by_text.values())


@pytest.mark.parametrize("rows", [1, 3, 4096])
def test_next_document_over_any_buckets(spark, odd, nothing, rows):
    """Ids with gaps, ties and nulls; the first follows the last."""
    more = spark.createDataFrame([(10**15, "far"), (-5, "below"), (4, "again"), (None, "")], "doc_id long, text string")
    for docs in (odd.select("doc_id", "text").unionByName(more), odd, more.limit(1), nothing):
        want = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in docs.collect()), key=lambda r: (r[0], r[1], r[2].encode()))
        texts = [t for _, _, t in want]
        found, _ = sketches.with_next(docs, rows=rows)
        got = sorted(((r.id is not None, r.id or 0, r.text, r.next) for r in found.where("copy = 0").collect()), key=lambda r: (r[0], r[1], r[2].encode()))
        assert [r[2] for r in got] == texts
        nexts = sorted(zip(texts, texts[1:] + texts[:1], strict=True))
        assert sorted((r[2], r[3]) for r in got) == nexts


def test_edited_fingerprints_on_odd_rows(spark, odd, nothing):
    got = sketches.edited_fingerprints(odd, rows=3).collect()
    rows = sorted(odd.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    assert sketches.edited_fingerprints(odd).columns == ["doc_id", "n_chars", "edited_sha256", "sketch", "edited_sketch", "next_sketch"] and sketches.edited_fingerprints(nothing).count() == 0
    want = []
    for r, following in zip(rows, rows[1:] + rows[:1], strict=True):
        text, cut = r.text or "", len(r.text or "") // 4
        want.append((r.doc_id, len(text), hashlib.sha256((text[: len(text) - cut] + (following.text or "")[:cut]).encode()).hexdigest()))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_chars, r.edited_sha256)) for r in got)
    one = sketches.edited_fingerprints(odd.where("doc_id = 1")).first()
    assert one.sketch == one.next_sketch  # it follows itself
    prints = sketches.fingerprints(odd).collect()
    assert len(prints) == odd.count() and all(r.sketch.n == 0 and r.sketch.kept == [] for r in prints if r.doc_id in (2, 3, 8))


def test_sketches_merge_and_contain(spark):
    a, b = " ".join(f"a{i}" for i in range(400)), " ".join(f"a{i}" for i in range(4000))
    rows = sketches.fingerprints(spark.createDataFrame([(1, a), (2, b), (3, ""), (4, None), (5, "x y"), (6, "x y")], "doc_id int, text string"))
    s = {r.doc_id: r.sketch for r in rows.collect()}
    assert s[1].n == 396 and abs(len(s[2].kept) / s[2].n - 0.25) < 0.05
    pair = rows.where("doc_id = 1").select(F.col("sketch").alias("x")).join(rows.where("doc_id = 2").select(F.col("sketch").alias("y")), F.lit(True))
    got = pair.select(sketches.containment(F.col("x"), F.col("y")).alias("c"), sketches.merged(F.col("x"), F.col("y"))["kept"].alias("m"), sketches.likeness(F.col("x"), F.col("y")).alias("j")).first()
    assert got.c == 1.0 and got.m == s[2].kept and abs(got.j - 396 / 3996) < 0.03
    both = rows.alias("p").join(rows.alias("q"), F.lit(True)).select("p.doc_id", F.col("q.doc_id").alias("other"), sketches.likeness(F.col("p.sketch"), F.col("q.sketch")).alias("j")).collect()
    near = {(r.doc_id, r.other): r.j for r in both}
    assert near[3, 4] == near[5, 6] == near[1, 1] == 1.0 and near[1, 3] == near[5, 3] == near[5, 1] == 0.0


# quality


def test_quality_on_held_out_rows(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").join(labels, "doc_id", "left_semi")
    got = quality.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    good, bad = [r for r in got if r.quality == 1], [r for r in got if r.quality == 0]
    assert len(got) > 500 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert np.mean([r.predicted == 1 for r in good]) > 0.99 and np.mean([r.predicted == 0 for r in bad]) > 0.9


def test_terms_are_subwords_and_ages_of_words():
    text = "go go stop go " + chr(0x4E2D) + " stop"
    x = quality.counts(*presplit.flat(pa.array([text, "", "ab", text])))
    assert (x[0] == x[3]).all() and not x[1].any() and x[2].sum() == 1
    assert x[0, : quality.SUBWORDS].sum() == len(text) - 2
    ages = x[0, quality.SUBWORDS :]
    assert ages[:4].tolist() == [3, 1, 2, 0]  # three new words; one right behind itself, one two and one three words ago


def test_unrelated_texts_are_far_apart():
    """In terms of words that differ, for scripts of one byte and of more."""
    rng = np.random.default_rng(3)
    for low, high in ((97, 123), (0x430, 0x450), (0x4E00, 0x5E00), (0xAC00, 0xD7A0)):
        a, b = ("".join(map(chr, rng.integers(low, high, 400))) for _ in range(2))
        x = quality.unit(quality.terms(pa.array([a, b, a]))[:, : quality.SUBWORDS])
        assert x[0] @ x[2] > 0.999 and x[0] @ x[1] < 0.6


def test_neighbours_are_those_of_all_products():
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("ab .,!X\n"), 60)) for _ in range(50)]
    model = quality._fit(quality.terms(pa.array(texts)), np.arange(50) % 2.0, 0.5, 8, 5, 8)
    others = ["".join(rng.choice(list("ab .,!X\n"), 40)) for _ in range(30)] + [""]
    got = model.scores(pa.array(others), block=7)
    for t, score in zip(others, got, strict=True):
        own = quality.unit(quality.terms(pa.array([t])) @ model.basis)[0]
        near = model.vectors @ own
        at = np.argsort(-near)[:5]
        weight = np.maximum(near[at], 0).astype(float) ** 8
        want = (weight * model.labels[at]).sum() / weight.sum() if weight.sum() else 0.5
        assert abs(score - want) < 1e-4


def test_quality_on_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(1, 1), (5, 0), (None, 1), (7, None), (99, 0)], "doc_id long, quality int")
    got = quality.classify(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert [r.held_out for r in got if r.doc_id is None] == [False, False]
    assert quality.classify(nothing, labels).count() == 0 and quality.classify(odd, labels.limit(0)).where("score = 0.5").count() == odd.count()
    assert quality.keep_good(odd, labels).columns == odd.columns


def test_sample_has_the_shares_of_the_labels(spark):
    """One label in ten is 0, and two ids in three have no document."""
    labels = spark.range(9000).selectExpr("id AS doc_id", "cast(id % 10 > 0 AS int) AS quality")
    docs = labels.where("doc_id % 3 = 0").selectExpr("doc_id", "concat('Text ', doc_id, ' of label ', quality) AS text")
    model = quality.fit(docs, labels, most_labelled=400, dimensions=4)
    assert len(model.labels) == 400 and 0.84 < model.labels.mean() < 0.96 and abs(model.share - 0.9) < 0.02
    twice = quality.fit(docs.unionByName(docs), labels, most_labelled=400, dimensions=4)
    assert len(twice.labels) == 400 and 0.82 < twice.labels.mean() < 0.98


# mixing


def test_quotas_are_the_highest_quotients():
    rnd = random.Random(2)
    for _ in range(200):
        t, n = [rnd.choice([0, 1, 2, 3, 5.5, 100, rnd.random() * 50]) for _ in range(rnd.randint(1, 8))], rnd.randint(0, 60)
        if not sum(t):
            continue
        have = [0] * len(t)
        for _ in range(n):
            have[max(range(len(t)), key=lambda i: (t[i] / (2 * have[i] + 1), -i))] += 1
        assert mixing.quotas(t, n) == have


def test_targets_share_what_is_above():
    assert mixing.targets([10, 1000, 1000], [5, 2, 1], 1500, 2.0) == pytest.approx([20, 1480 * 2 / 3, 1480 / 3])
    assert mixing.targets([10, 0], [5, 2], 15, 2.0) == [15, 0] and mixing.targets([], [], 0) == []


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_permutations(n):
    assert sorted(mixing.permuted(np.arange(n), np.full(n, n), np.full(n, 5)).tolist()) == list(range(n))


def test_shards_hold_their_quotas():
    sizes = [5000, 900, 2000]
    own, rank = mixing.plan(sizes, block=50, shards=7, seed=3), np.arange(3)
    q = own.of(rank, np.array(sizes))
    bounds = own.bounds(rank, q.seats)
    for s in range(3):
        size = np.full(sizes[s] // 100, 100)
        start = np.cumsum(size) - size
        pieces = mixing.taken(own, np.full(len(size), s), np.full(len(size), sizes[s]), start, size)
        assert (pieces[:, 2] - pieces[:, 1]).sum() == q.take[s] == round(q.want[s])
        per = np.bincount(pieces[:, 4], weights=pieces[:, 2] - pieces[:, 1], minlength=7)
        assert (np.abs(per - 50 * np.diff(bounds[s], prepend=0)) <= 100).all()


def test_mix_of_documents(spark, odd, nothing):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [r for r in docs.collect()]
    got = {r.doc_id: r for r in mixing.mix_counts(docs).collect()}
    words = {r.doc_id: re.findall(WORD, r.text or "") for r in rows}
    names = sorted({r.source for r in rows if r.source is not None})
    size = {s: sum(len(words[r.doc_id]) for r in rows if r.source == s) for s in names}
    want = dict(zip(names, mixing.targets([size[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))], 1.5 * sum(size.values())), strict=True))
    taken = dict.fromkeys(names, 0)
    for r in rows:
        g = got[r.doc_id]
        assert (g.size, g.source_size) == (len(words[r.doc_id]), size[r.source]) and abs(g.target - want[r.source]) < 1e-6 and 0 <= g.taken <= 2 * g.size
        taken[r.source] += g.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in names)
    again = {r.doc_id: r.taken for r in mixing.mix_counts(docs.repartition(7)).collect()}
    assert again == {i: g.taken for i, g in got.items()}
    mixed = mixing.mix_documents(docs).collect()
    for i, g in got.items():
        texts = [r.text for r in mixed if r.doc_id == i]
        assert sum(len(re.findall(WORD, t)) for t in texts) == g.taken
        assert all(t in rows_text for t in texts for rows_text in [next(r.text for r in rows if r.doc_id == i)])
    assert mixing.mix_counts(odd).count() == odd.count() and mixing.mix_documents(odd).columns == odd.columns
    assert sum(len(re.findall(WORD, r.text)) for r in mixing.mix_documents(odd).collect()) == sum(r.taken for r in mixing.mix_counts(odd).collect())
    assert mixing.mix_counts(nothing).count() == 0 and mixing.mix_documents(nothing).count() == 0


def test_quotas_decide_the_mix(spark):
    """Every third of a word is rounded by the quotients, so the mix has its words to the last; rounding alone gives 3 too few."""
    want = [100 + 1 / 3] * 9
    assert sum(mixing.word_quotas(want, [200] * 9)) == round(sum(want)) == 903
    assert mixing.word_quotas([2.0, 2.4, 0.0], [1, 9, 9]) == [1, 3, 0] and mixing.word_quotas([], []) == []
    for sizes in ([5000, 903, 2000], [1, 49, 50, 51, 100], [7, 0, 1000], [3, 3, 3, 3], [0, 0]):
        own, n, rank = mixing.plan(sizes, block=50, shards=4, seed=3), np.array(sizes), np.arange(len(sizes))
        q = own.of(rank, n)
        bounds = own.bounds(rank, q.seats)
        assert q.take.sum() == int(1.5 * sum(sizes) + 0.5) and (q.take <= 2 * n).all() and abs(q.want.sum() - 1.5 * sum(sizes)) < 1e-6
        for s, size in enumerate(sizes):  # a seat is a block of a pass
            p = mixing.taken(own, np.array([s]), np.array([size]), np.array([0]), np.array([size]))
            assert (p[:, 2] - p[:, 1]).sum() == q.take[s]
            assert np.bincount(p[:, 4], minlength=4).tolist() == np.diff(bounds[s], prepend=0).tolist()
        seats = np.diff(bounds.sum(0), prepend=0)
        assert seats.sum() == q.seats.sum() and seats.max() - seats.min() <= 1


def test_plans_of_many_sources_are_those_of_the_driver(spark, monkeypatch):
    """Counts of sources that are alike, and ties cut by counting ranks, give what each source by itself gives."""
    rnd = random.Random(6)
    for kinds in ([3], [1, 2, 3, 40], list(range(200))):
        sizes = [rnd.choice(kinds) for _ in range(700)]
        rows = [(f"s{i:05d}" if i < 699 else None, n, 1) for i, n in enumerate(sizes)]
        totals = spark.createDataFrame(rows, "source string, n long, rows long").repartition(5)
        numbered = mixing._numbered(totals)
        assert sorted((r.src, r.n) for r in numbered.collect()) == list(enumerate(sizes))
        want = mixing.plan(sizes, block=2, shards=5)
        monkeypatch.setattr(mixing, "FEW", 10)
        got = mixing._plan_of(numbered, mixing.WEIGHTS, 1.5, 2.0, 2, 5, 17)
        monkeypatch.undo()
        rank, n = np.arange(700), np.array(sizes)
        a, b = want.of(rank, n), got.of(rank, n)
        assert all((getattr(a, c) == getattr(b, c)).all() for c in ("want", "take", "seats")) and (want.bounds(rank, a.seats) == got.bounds(rank, b.seats)).all()
        assert a.take.sum() == int(1.5 * sum(sizes) + 0.5) and (np.abs(a.take - a.want) < 1.5).all()


def test_a_mix_of_many_sources(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(["w"] * (i % 7)), f"s{i % 90}" if i % 5 else "hot") for i in range(900)], "doc_id long, text string, source string")
    want = {r.doc_id: r[:] for r in mixing.mix_counts(docs, block=4, shards=3).collect()}
    monkeypatch.setattr(mixing, "FEW", 10)
    assert {r.doc_id: r[:] for r in mixing.mix_counts(docs, block=4, shards=3).collect()} == want


def test_mix_gives_shards(spark, odd, nothing):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = mixing.mix_counts(docs, block=32, shards=5).collect()
    quota = {r.source: r.quota for r in rows}
    assert {s: sum(r.taken for r in rows if r.source == s) for s in quota} == quota and sum(quota.values()) == int(1.5 * sum(r.size for r in rows) + 0.5)
    assert all(sum(s.words for s in r.shards) == r.taken and [s.shard for s in r.shards] == sorted({s.shard for s in r.shards}) for r in rows)
    mixed = mixing.mix_documents(docs, shard_column="shard", block=32, shards=5)
    assert mixed.columns == [*docs.columns, "shard"]
    got = {}
    for r in mixed.collect():
        got[r.doc_id, r.shard] = got.get((r.doc_id, r.shard), 0) + len(re.findall(WORD, r.text))
    assert got == {(r.doc_id, s.shard): s.words for r in rows for s in r.shards} and {s for _, s in got} == set(range(5))
    assert mixing.mix_documents(odd, shard_column="shard").columns == [*odd.columns, "shard"] and mixing.mix_documents(nothing, shard_column="shard").count() == 0
    again = {r.doc_id: r.shards for r in mixing.mix_counts(docs.repartition(7), block=32, shards=5).collect()}
    assert again == {r.doc_id: r.shards for r in rows}


# URL lists


def test_url_lists(spark):
    rnd = random.Random(4)
    hosts = ["a.example.com", "b.a.example.com", "example.com", "other.org", "xexample.com"]
    patterns = ["example.com", "a.example.com", "a.example.com/x", "other.org/x/y", "com"]
    day = date(2024, 1, 1)
    entries = [(rnd.choice(patterns), rnd.choice(["p", "q"]), rnd.choice(["add", "remove"]), day + timedelta(rnd.randint(0, 30))) for _ in range(60)] + [(None, "p", "add", day), ("example.com", "p", "add", None)]
    captures = [(i, f"{rnd.choice(['http', 'HTTPS'])}://{rnd.choice(['', 'u:p@'])}{rnd.choice(hosts).upper() if i % 2 else rnd.choice(hosts)}{rnd.choice(['', ':80'])}{rnd.choice(['', '/', '/x', '/x/y?q=/z', '/xy#x', '//x'])}", day + timedelta(rnd.randint(-3, 34)), "n", 0) for i in range(400)]
    captures += [(900, None, day, "n", 0), (901, "/relative", day, "n", 0), (902, "http://example.com/", None, "n", 0), (0, captures[0][1], captures[0][2], "n", 0)]
    got = url_lists.judge(spark.createDataFrame(captures, "page_id int, url string, fetched date, pattern string, key int"), spark.createDataFrame(entries, "pattern string, category string, action string, day date")).collect()
    assert len(got) == len(captures) - 1  # one row repeats
    by = {r.page_id: r for r in got}
    for i, url, at, _, _ in captures:
        m = re.match(url_lists.URL, url or "")
        host, path = (m[1].lower(), [p for p in m[2].split("/") if p]) if m else ("", [])
        active = []
        for p, c in {(p, c) for p, c, _, d in entries if p and d}:
            known = sorted((d, a) for p2, c2, a, d in entries if (p2, c2) == (p, c) and d and at and d <= at)
            on = bool(known) and known[-1][1] == "add"
            h, *rest = p.split("/")
            match = host and ((host == h and path[: len(rest)] == rest) if rest else host == h or host.endswith("." + h))
            if on and match:
                active.append((p, c))
        r = by[i]
        assert r.n_active == len(active) and r.blocked == bool(active), (url, at, active, r)
        assert r.categories == ",".join(sorted({c for _, c in active}))
        assert r.pattern == max((p for p, _ in active), key=lambda p: (len(p), p), default="")


def test_odd_urls(spark):
    """Long paths and hosts, brackets of IPv6, escapes and names in other scripts: taken as they stand, without a crash."""
    urls = ["http://a.com/" + "x/" * 20_000, "http://" + "a." * 500 + "com/", "http://[2001:db8::1]:80/x", "http://a.com/%78/y", "http://" + chr(0xFC) + "mlaut.de/", "http://A.COM./x", "http://u:p@a.com:8080/x?y#z", "", "http://", "http:///x"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string").withColumn("fetched", F.lit("2024-01-02").cast("date"))
    day = date(2024, 1, 1)
    entries = spark.createDataFrame([("a.com/x", "p", "add", day), ("com", "q", "add", day), (chr(0xFC) + "mlaut.de", "r", "add", day)], "pattern string, category string, action string, day date")
    got = {r.page_id: r for r in url_lists.judge(pages, entries).collect()}
    assert len(got) == len(urls) and [got[i].categories for i in range(len(urls))] == ["p,q", "q", "", "q", "r", "p,q", "p,q", "", "", ""]


def test_url_lists_without_rows(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id int, url string").withColumn("fetched", F.lit("2024-01-01").cast("date"))
    entries = spark.createDataFrame([], "pattern string, category string, action string, day date")
    assert [r.blocked for r in url_lists.judge(pages, entries).collect()] == [False]
    assert url_lists.judge(pages.limit(0), entries).count() == 0
