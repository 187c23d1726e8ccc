"""Every stage of the pipeline against brute force on what its predecessor kept."""

import re

import pyarrow as pa
from tokenizers import Tokenizer

import corpus_pipeline
from offsetlake.llm import bpe_automaton, quality
from offsetlake.llm.shared import WORD, materialize
from tests.llm.test_dedup import components, key, shingles

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = [docs.collect()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = materialize(stage(spark, docs, SF), "stage")
        if i < 4:
            assert docs.columns == columns
        kept.append(docs.collect())
    raw, good, single, near, mixed, tokens = kept

    model = quality.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    scores = model.scores(pa.array([r.text or "" for r in raw]))
    assert {r.doc_id for r in good} == {r.doc_id for r, s in zip(raw, scores, strict=True) if s >= 0.3}
    assert set(good) <= set(raw) and len(good) > 0.7 * len(raw)

    best = {}
    for r in good:
        best[key(r.text)] = max(best.get(key(r.text), -1), r.doc_id)
    assert {r.doc_id for r in single} == set(best.values()) and set(single) <= set(good)

    label = components([(r.doc_id, shingles(r.text)) for r in single], 80)
    assert {r.doc_id for r in near} == set(label.values()) and set(near) <= set(single)

    texts = {r.doc_id: r.text for r in near}
    assert all(r.text in texts[r.doc_id] and r.n_chars == len(r.text) for r in mixed)
    total = sum(len(re.findall(WORD, t)) for t in texts.values())
    assert abs(sum(len(re.findall(WORD, r.text)) for r in mixed) - 1.5 * total) <= len({r.source for r in near})

    library = Tokenizer.from_file(bpe_automaton.tokenizer_path("byte_bpe_50k.json"))
    want = sorted((r.doc_id, library.encode(r.text, add_special_tokens=False).ids) for r in mixed)
    assert sorted((r.doc_id, r.ids) for r in tokens) == want
    assert sorted((r.doc_id, r.decoded) for r in tokens) == sorted((r.doc_id, r.text) for r in mixed)
    assert corpus_pipeline.run(spark, SF).count() == len(tokens)


def test_stages_on_odd_rows(spark, odd, nothing):
    for docs in (odd, nothing):
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = materialize(stage(spark, docs, SF), "stage")
            if i < 4:
                assert out.columns == docs.columns
                docs = out
        assert (out.count() > 0) == (docs.limit(1).count() > 0)
