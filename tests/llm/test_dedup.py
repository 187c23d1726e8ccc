"""Exact and near duplicates against plain brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from offsetlake.llm import bloom_dedup, chosen_path
from offsetlake.llm.shingles import linked, shingle_set

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def components(rows, percent):
    """Ids and sets to the least id reachable, by all pairs."""
    label = {i: i for i, _ in rows}
    pairs = [(a, b) for k, (a, s) in enumerate(rows) for b, t in rows[:k] if s and t and 100 * len(s & t) >= percent * len(s | t)]
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def families(seed, n_families, size):
    """Texts in families: a base and copies in which some words change, over one common passage."""
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rnd.choice(vocabulary) for _ in range(20)]
    out = []
    for _ in range(n_families):
        base = passage + [rnd.choice(vocabulary) for _ in range(rnd.randint(3, 90))]
        for _ in range(size):
            share = rnd.choice([0, 0.005, 0.01, 0.02, 0.05])
            out.append(" ".join(rnd.choice(vocabulary) if rnd.random() < share else w for w in base))
    return out


@pytest.mark.parametrize(("limit", "percent"), [(None, 85), (None, 80), (8, 85)])
def test_near_components_are_those_of_brute_force(spark, monkeypatch, limit, percent):
    """With the limit as it is, and with one of 8, where nodes branch and what stays large is compared in blocks."""
    if limit:
        monkeypatch.setattr(chosen_path, "LIMIT", limit)
        monkeypatch.setattr(chosen_path, "DEPTH", 3)
        monkeypatch.setattr(chosen_path, "HOT", 50)
    texts = families(5, 8, 25) + ["", "   ", "one two", "ONE two", "one two three four five"]
    docs = spark.createDataFrame([(3 * i, t, "en", "s", len(t)) for i, t in enumerate(texts)], SCHEMA).repartition(5)
    want = components([(3 * i, shingles(t)) for i, t in enumerate(texts)], percent)
    got = chosen_path.near_duplicates(docs, percent).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.n_shingles for r in got} == {3 * i: len(shingles(t)) for i, t in enumerate(texts)}
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    kept = chosen_path.drop_near_copies(docs, percent)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def near_copies(seed, n, words=60):
    """A family: copies of one text in which a word or two change, and a few that change more."""
    rnd = random.Random(seed)
    base = [f"b{rnd.randint(0, 10**6)}" for _ in range(words)]
    out = []
    for i in range(n):
        text = list(base)
        for _ in range(rnd.choice([0, 1, 1, 1, 2])):
            text[rnd.randrange(words)] = f"n{rnd.randint(0, 10**6)}"
        out.append(" ".join(text + [f"t{i}"]))
    return out


@pytest.mark.parametrize("most", [None, 100])
def test_a_large_family_is_joined_by_its_pivot(spark, monkeypatch, most):
    """With the limit as it is: nodes are far larger and no branching splits them; also where a family is compared in parts."""
    if most:
        monkeypatch.setattr(chosen_path, "CLUSTER", most)
    texts = near_copies(1, 700) + near_copies(2, 300) + families(3, 3, 10)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    want = components([(i, shingles(t)) for i, t in enumerate(texts)], 85)
    assert {r.doc_id: r.component_id for r in chosen_path.near_duplicates(docs, 85).collect()} == want


@pytest.mark.parametrize("alone", [0, 1 << 20])
def test_large_nodes_that_few_blocks_cover_are_not_branched(spark, monkeypatch, alone):
    """Two families over one common passage: their large nodes are compared whole; components in rounds and in one task."""
    monkeypatch.setattr(chosen_path, "ALONE", alone)
    monkeypatch.setattr(chosen_path, "_branched", None)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [f"{passage} {t}" for t in near_copies(4, 350, 40) + near_copies(5, 300, 40)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    want = components([(i, shingles(t)) for i, t in enumerate(texts)], 85)
    assert {r.doc_id: r.component_id for r in chosen_path.near_duplicates(docs, 85).collect()} == want


def test_components_meet_in_a_task_or_in_rounds(spark, monkeypatch):
    rnd = random.Random(6)
    links = [(f"n{a:03d}", f"n{min(a + rnd.randint(1, 9), 399):03d}") for a in range(399) if rnd.random() < 0.6]
    rows = spark.createDataFrame(links, "a string, b string").repartition(3)
    low = {i: i for link in links for i in link}
    for _ in range(len(links)):
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    for alone in (1 << 20, 0):
        monkeypatch.setattr(chosen_path, "ALONE", alone)
        assert {r.id: r.component for r in chosen_path.components(rows).collect()} == low


def test_blocks_meet_where_labels_differ(spark, monkeypatch):
    monkeypatch.setattr(chosen_path, "LIMIT", 8)
    rows = [(1, i, 0 if i < 400 else i) for i in range(446)] + [(2, i, i % 3) for i in range(300)]
    met = chosen_path._blocks(spark.createDataFrame(rows, "key long, id long, label long")).collect()
    nodes = {}
    for r in met:
        nodes.setdefault(r.key, []).append((r.id, r.label))
    pairs = {frozenset((a, b)) for own in nodes.values() for a, x in own for b, y in own if x != y}
    for k in (1, 2):
        own = [(i, label) for key, i, label in rows if key == k]
        assert all(frozenset((a, b)) in pairs for a, x in own for b, y in own if x != y)
    assert max(len([1 for i, label in own if label == 0]) for own in nodes.values()) <= 48


def test_shingle_sets_are_those_of_words():
    texts = families(9, 5, 8) + ["a b c d", "a b c d e", "A B C D E", "x" * 5000, "a\tb\nc\x0bd\x0ce\rf", "é É b c d e f"]
    for a in texts:
        assert len(shingle_set(a)) == len(shingles(a))
        for b in texts[:12]:
            s, t = shingles(a), shingles(b)
            assert linked(shingle_set(a), shingle_set(b), 85) == bool(s and t and 100 * len(s & t) >= 85 * len(s | t))


def test_exact_links_count_over_postings():
    rng = np.random.default_rng(0)
    for _ in range(100):
        base = rng.choice(100, 30, replace=False)
        sets = [np.unique(np.where(rng.random(30) < rng.random() * 0.15, rng.choice(1000, 30), base)).astype(np.uint64) for _ in range(rng.integers(1, 9))]
        want = components([(i, set(s.tolist())) for i, s in enumerate(sets)], 85)
        assert chosen_path.exact_links(sets, 85).tolist() == [want[i] for i in range(len(sets))]


def test_overlaps_of_any_frequency():
    rng = np.random.default_rng(1)
    for n in (1, 2, 40, 300):
        sets = [np.unique(np.concatenate([rng.choice(20, 8), 100 + rng.choice(5000, rng.integers(1, 60))])).astype(np.uint64) for _ in range(n)]
        want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
        assert chosen_path.overlaps(sets).astype(int).tolist() == want


def test_near_on_odd_rows(odd, nothing):
    got = chosen_path.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[5].component_id == by[6].component_id == 5 and by[4].component_id == by[1].component_id == by[9].component_id == 1
    assert all(by[i].n_shingles == 0 and by[i].kept for i in (2, 3, 8))
    assert chosen_path.near_duplicates(nothing).count() == 0
    kept = chosen_path.drop_near_copies(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 2, 3, 5, 7, 7, 8]


def key(text):
    return hashlib.sha256((text or "").translate(LOWER).encode()).hexdigest()


@pytest.mark.parametrize("max_slots", [1 << 29, 1 << 16])
def test_exact_groups_are_those_of_brute_force(spark, max_slots):
    """Also with filters for ranges of hashes, and with groups whose result is broadcast."""
    assert bloom_dedup.sizes(20_000, max_slots)[0] == (1 if max_slots > 1 << 16 else 4)
    rnd = random.Random(2)
    texts = [rnd.choice(["Same", "same", "SAME", "sÄme", "säme"]) if rnd.random() < 0.3 else f"text {rnd.randint(0, 20_000)}" for _ in range(20_000)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], SCHEMA).repartition(6)
    best, size = {}, {}
    for i, t in enumerate(texts):
        best[key(t)] = max(best.get(key(t), 0), i)
        size[key(t)] = size.get(key(t), 0) + 1
    got = bloom_dedup.exact_groups(docs, max_slots=max_slots).collect()
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept, r.digest.hex()) for r in got} == {(i, best[key(t)], size[key(t)], best[key(t)] == i, key(t)) for i, t in enumerate(texts)}
    assert sorted(r.doc_id for r in bloom_dedup.drop_copies(docs, max_slots=max_slots).collect()) == sorted(best.values())


def test_rows_of_one_hash_alone_pass_straight(spark):
    docs = spark.createDataFrame([(i, f"text {i // 2 if i < 100 else i}", "en", "s", 1) for i in range(5000)], SCHEMA)
    found = bloom_dedup.hashed(docs, "doc_id", "text")
    ranges, m = bloom_dedup.sizes(5000, bloom_dedup.MAX_SLOTS)
    assert ranges == 1
    bloom = bloom_dedup.slot_filter(found, m)
    digests = [r.digest for r in found.orderBy("id").collect()]
    again = bloom_dedup.in_filter(digests, bloom, m)
    assert again[:100].all() and again[100:].mean() < 0.1


def test_a_range_has_its_share_of_the_rows(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "concat('text ', id % 3000) as text")
    found = bloom_dedup.hashed(docs, "doc_id", "text").withColumn("r", bloom_dedup.of_range(8))
    n = {r.r: r["count"] for r in found.groupBy("r").count().collect()}
    assert sorted(n) == list(range(8)) and min(n.values()) > 300
    looked = bloom_dedup._looked(found.select("id", "digest"), 4000, 1 << 12).collect()
    assert len(looked) == 4000 and sum(r.again for r in looked) < 2600 and all(r.again for r in looked if r.id < 1000 or r.id >= 3000)


def test_exact_on_odd_rows(odd, nothing):
    got = bloom_dedup.exact_groups(odd).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in got if r.doc_id is not None}
    assert by[2] == (3, 3, False) and by[3] == (3, 3, True) and by[7] == (7, 2, True) and by[1] == (9, 3, False)
    kept = bloom_dedup.drop_copies(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [3, 5, 6, 7, 8, 9]
    assert bloom_dedup.exact_groups(nothing).count() == 0 and bloom_dedup.drop_copies(nothing).count() == 0
