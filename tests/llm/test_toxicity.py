"""Nearest examples against brute force, and accuracy on documents not learned from."""

import os
import random

import numpy as np
import pytest

from corpuswarden.llm import toxicity as tx


def example(rng, i, bad):
    words = [f"w{rng.randint(0, 300)}" for _ in range(rng.randint(5, 60))]
    if bad:
        words += rng.sample(["foul", "vile", "nasty", "rotten", "grubby"], 2) + [f"slimy{rng.randint(0, 9)}"]
    rng.shuffle(words)
    return i, int(bad), " ".join(words)


def model_of(rng, n=400):
    made = [example(rng, i, i % 4 == 0) for i in range(n)]
    return made, tx.build([(i, y, *tx.terms_of(t)) for i, y, t in made], 0.1)


def test_blocks_leave_the_nearest_exact():
    rng = random.Random(3)
    made, model = model_of(rng)
    dense = np.zeros((len(made), len(model.vocabulary)))
    texts = {i: t for i, _, t in made}
    for row, name in enumerate(model.names):
        at, w = model.query(*tx.terms_of(texts[name]))
        dense[row, at] = w
    assert (model.bound >= 0).all() and len(model.vocabulary) > 5
    for i in range(120):
        at, w = model.query(*tx.terms_of(example(rng, 0, i % 3 == 0)[2]))
        cosine = np.zeros(len(model.vocabulary))
        cosine[at] = w
        cosine = dense @ cosine
        best = [j for j in np.lexsort((np.arange(len(made)), -np.round(cosine, 12))) if cosine[j] > 1e-15][: tx.NEIGHBOURS]
        found, value = model.nearest(at, w)
        assert np.allclose(value, cosine[best], atol=1e-9)
        assert found.tolist() == best


def test_steps_rise_and_keep_the_mean():
    rng = np.random.default_rng(1)
    x, w = rng.integers(0, 50, 500) / 50, rng.random(500)
    y = (rng.random(500) < x).astype(float)
    low, p = tx._isotonic(x, y, w)
    assert (np.diff(p) > 0).all() and (np.diff(low) > 0).all()
    fitted = p[np.searchsorted(low, x, side="right") - 1]
    assert abs((fitted * w).sum() - (y * w).sum()) < 1e-9


def test_scores_and_edge_cases(spark, frame):
    rng = random.Random(5)
    made = [example(rng, i, i % 4 == 0) for i in range(600)]
    rows = [(i, t, 1, "x") for i, _, t in made] + [(900, None, 1, "x"), (901, "", 1, "x"), (901, "", 1, "x"), (None, "foul vile", 1, "x"), (902, "foul " * 50_000, 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int, neighbours string")
    labels = frame("doc_id long, toxic int", *[(i, y) for i, y, _ in made if i % 2], *[(i, y) for i, y, _ in made if i % 8 == 0], (None, 1), (3, None))
    got = tx.score(docs, tx.fit(docs, labels)).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    by = {r["doc_id"]: r for r in got}
    right = sum(by[i]["predicted"] == y for i, y, _ in made if i % 8 in (2, 4, 6))
    assert right >= 0.95 * sum(i % 8 in (2, 4, 6) for i in range(600))
    assert by[900]["neighbours"] == [] and by[900]["predicted"] == 0 and by[902]["predicted"] == 1
    assert by[None]["predicted"] == 1
    for some in (labels.limit(0), frame("doc_id long, toxic int", (1, 1), (2, 1))):
        flat = {r["score"] for r in tx.score(docs, tx.fit(docs, some)).collect()}
        assert flat == ({0.0} if some.count() == 0 else {1.0})
    assert tx.score(docs.limit(0), tx.ToxicityModel()).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="test tables are not there")
def test_held_out_accuracy(spark):
    from corpuswarden.llm.queries import QUERIES

    scored = QUERIES["op6_toxicity"](spark, "/root/testdata/sf0.1").where("held_out")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "toxic")
    rows = [(r["score"], r["toxic"]) for r in scored.join(labels, "doc_id").collect()]
    order = np.argsort([s for s, _ in rows], kind="stable")
    y, s = np.array([t for _, t in rows])[order], np.array([s for s, _ in rows])[order]
    # area under the curve, ties count half
    ranks = np.array([(np.searchsorted(s, v) + np.searchsorted(s, v, side="right") + 1) / 2 for v in s])
    area = (ranks[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))
    print("area", area, "right", ((s >= 0.5) == y).mean(), "recall", (s[y == 1] >= 0.5).mean(), "false", (s[y == 0] >= 0.5).mean())
    assert area > 0.85 and ((s >= 0.5) == y).mean() > 0.9
