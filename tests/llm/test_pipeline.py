"""The pipeline's stages, each against plain Python on its own input."""

import re

import corpus_pipeline
from tests.llm.test_operators import plain_classes
from tintlake.llm.common import stored, table

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark):
    docs, seen = table(spark, SF, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = stored(stage(spark, docs, SF), name)
        seen[name] = (before, docs.collect(), docs.columns)
    assert list(seen) == ["quality_filter", "near_dedup", "benchmark_decontamination", "personal_data", "best_fit_packing"]
    assert all(columns == COLUMNS for name, (_, _, columns) in seen.items() if name != "best_fit_packing")
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    before, after, _ = seen["quality_filter"]
    kept = {r.doc_id for r in after}
    right = [labels[r.doc_id] == (r.doc_id in kept) for r in before if r.doc_id in labels]
    assert sum(right) / len(right) > 0.95
    before, after, _ = seen["near_dedup"]
    rows = sorted((r.doc_id, r.text) for r in before)
    assert sorted(r.doc_id for r in after) == sorted(set(plain_classes(rows)))
    before, after, _ = seen["benchmark_decontamination"]
    items = [r.text for r in table(spark, SF, "benchmark").collect()]
    assert {r.doc_id for r in after} == {r.doc_id for r in before if not any(i in r.text for i in items)}
    before, after, _ = seen["personal_data"]
    texts = {r.doc_id: r.text for r in before}
    assert {r.doc_id for r in after} == set(texts)
    for r in after:
        if re.search(r"[A-Za-z0-9]@[a-z0-9]+\.|\+1 \(\d{3}\)", texts[r.doc_id]):
            assert re.search(r"\[(EMAIL|PHONE)\]", r.text) and r.n_chars == len(r.text)
        assert not re.search(r"[A-Za-z0-9]@[a-z0-9]+\.", r.text)
    before, after, _ = seen["best_fit_packing"]
    assert {r.doc_id for r in after} == {r.doc_id for r in before}


def test_empty_and_null_documents(spark):
    rows = spark.createDataFrame([(1, None, "en", "s", 0), (2, "", "en", "s", 0), (None, None, None, None, None)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for docs in (rows, rows.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            assert name == "best_fit_packing" or out.columns == COLUMNS
            out.count()
