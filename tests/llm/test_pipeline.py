"""The pipeline: what each stage keeps, and the whole on the test tables."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
from jobsight.llm import simhash
from jobsight.session import stage

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    steps = {}
    for name, step in corpus_pipeline.STAGES:
        steps[name] = stage(step(spark, steps[next(reversed(steps))] if steps else docs, SF), "test_pipeline")
    assert all(steps[n].columns == docs.columns for n in list(steps)[:-1])
    rows = {n: Counter(map(tuple, steps[n].collect())) for n in list(steps)[:-1]}
    given = Counter(map(tuple, docs.collect()))
    assert not rows["toxicity"] - given and sum(rows["toxicity"].values()) > 0.8 * docs.count()
    texts = {}
    for r in steps["toxicity"].collect():
        texts[r["text"]] = max(texts.get(r["text"], -1), r["doc_id"])
    assert {(r["doc_id"], r["text"]) for r in steps["exact_dedup"].collect()} == {(i, t) for t, i in texts.items()}
    groups = simhash.simhash_groups(steps["exact_dedup"]).collect()
    assert {r["doc_id"] for r in steps["simhash_dedup"].collect()} == {r["component_id"] for r in groups}
    copies = Counter(r["doc_id"] for r in steps["mix_sources"].collect())
    assert set(copies) <= {r["doc_id"] for r in steps["simhash_dedup"].collect()} and max(copies.values()) <= 2
    packed = steps["best_fit_packing"].collect()
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == copies
    fill = Counter()
    for r in packed:
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 2048


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, step in corpus_pipeline.STAGES[:-1]:
        docs = stage(step(spark, docs, SF), "test_pipeline")
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 0


def test_odd_rows(spark, docs):
    """Null ids, texts and sources, repeated rows and clashing columns pass every stage."""
    rows = docs
    for _, step in corpus_pipeline.STAGES[:-1]:
        rows = stage(step(spark, rows, SF), "test_pipeline")
        assert rows.columns == docs.columns and rows.count() > 0
    assert corpus_pipeline.STAGES[-1][1](spark, rows, SF).count() >= rows.count()
