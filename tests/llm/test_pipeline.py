"""The stages: what they keep, change, and give on."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SMALL = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, kept, seen = docs.columns, [docs.count()], {}
    from corpuswarden.session import materialize

    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs, n = materialize(stage(spark, docs, SMALL), "test-pipeline")
        assert docs.columns == columns
        seen[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert len(seen[name]) == n
        kept.append(n)
    assert kept[0] > kept[1] > kept[2] == kept[3] == kept[4]
    # one document of each group of equal texts
    texts = [t for t in seen["near_copies"].values() if t]
    assert len(texts) == len(set(texts))
    changed = [k for k, t in seen["decontamination"].items() if t != seen["near_copies"][k]]
    assert changed and all(len(seen["decontamination"][k]) < len(seen["near_copies"][k]) for k in changed)
    assert any("[EMAIL]" in (t or "") for t in seen["personal_data"].values())
    ids = corpus_pipeline.run(spark, SMALL)
    assert {r["doc_id"] for r in ids.collect()} == set(seen["personal_data"])


def test_empty_and_null_documents(spark, clashing):
    for docs in (clashing(None, "", "x"), clashing("x").limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SMALL)
        docs.collect()
