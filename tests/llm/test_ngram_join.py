"""Tiles, bounds and components against brute force over all pairs."""

import random
import re

import numpy as np
import pytest

from corpuswarden.llm import ngram_join as nj
from corpuswarden.llm.components import components


def sets_of(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def closure(nodes, links):
    label = {n: n for n in nodes}

    def root(n):
        while label[n] != n:
            n = label[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        label[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def brute(texts, k, num, den):
    sets = [sets_of(t, k) for t in texts]
    links = [
        (i, j)
        for j, y in enumerate(sets)
        for i, x in enumerate(sets[:j])
        if x and y and den * len(x & y) >= num * len(x | y)
    ]
    return [len(s) for s in sets], closure(range(len(texts)), links)


def corpus(rng, groups, copies, edits, length):
    """Groups of near copies, each a few words away from the one before it, so that
    groups are chains whose ends may be unlike."""
    texts = []
    for _ in range(groups):
        words = [f"w{rng.randint(0, 3000)}" for _ in range(rng.randint(1, length))]
        for _ in range(rng.randint(1, copies)):
            texts.append(" ".join(words))
            for _ in range(rng.randint(0, edits)):
                words[rng.randrange(len(words))] = f"W{rng.randint(0, 3000)}"
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("num, den, k", [(85, 100, 4), (80, 100, 5), (1, 2, 2)])
def test_linked_sets_share_a_tile(num, den, k):
    rng = np.random.default_rng(7)
    bands = nj.Bands(num, den)
    tried = 0
    while tried < 400:
        n = int(rng.integers(1, 90))
        x = rng.integers(0, 2**63, n).astype(np.uint64)
        y = np.concatenate([x[int(rng.integers(0, max(1, n // 5))) :], rng.integers(0, 2**63, int(rng.integers(0, n // 5 + 1))).astype(np.uint64)])
        x, y = np.unique(x), np.unique(y)
        if bands.linked(len(np.intersect1d(x, y)), len(x), len(y)):
            tried += 1
            assert len(np.intersect1d(bands.keys(x), bands.keys(y)))
            maps = [np.frombuffer(bands.bitmap(s), np.uint8) for s in (x, y)]
            assert bands.may_link(len(x), len(y), *maps)


@pytest.mark.parametrize("seed, crowd, tile", [(1, 8, 2_048), (2, 2, 2), (3, 3, 5)])
def test_components_equal_brute_force(spark, docs, monkeypatch, seed, crowd, tile):
    monkeypatch.setattr(nj, "CROWD", crowd)
    monkeypatch.setattr(nj, "TILE_ROWS", tile)
    rng = random.Random(seed)
    texts = corpus(rng, 25, 9, 3, 60) + corpus(rng, 3, 40, 6, 120) + [None, "", " \t", "a", "A", "a b", "a b", "é x", "É x"]
    sizes, expected = brute(texts, 4, 85, 100)
    made = docs(*texts).repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in nj.ngram_join(made, 4, (85, 100)).collect()}
    assert got == {i: (sizes[i], expected[i]) for i in range(len(texts))}


@pytest.mark.parametrize("num, den, k", [(85, 100, 4), (1, 2, 2)])
def test_short_texts_that_share_passages(spark, docs, monkeypatch, num, den, k):
    """Most tiles hold unlike texts, and copies meet others first."""
    monkeypatch.setattr(nj, "CROWD", 3)
    monkeypatch.setattr(nj, "TILE_ROWS", 4)
    rng = random.Random(k)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(1, 14))) for _ in range(250)]
    texts += rng.choices(texts, k=60)
    sizes, expected = brute(texts, k, num, den)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in nj.ngram_join(docs(*texts).repartition(5), k, (num, den)).collect()}
    assert got == {i: (sizes[i], expected[i]) for i in range(len(texts))}


def test_few_pairs_leave_a_crowded_tile():
    """Rows that share a tile and differ by about what is allowed: no more pairs than rows, and all groups joined."""
    rng, bands = np.random.default_rng(5), nj.Bands(85, 100)
    base = rng.integers(0, 2**63, 100).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[:90], rng.choice(base[90:], 4, False), rng.integers(0, 2**63, int(rng.integers(0, 9))).astype(np.uint64)])) for _ in range(120)]
    rows = [(1, 0, 0, 0, i, i, len(s), bands.bitmap(s), s.tobytes()) for i, s in enumerate(sets)]
    real = [(i, j) for j, y in enumerate(sets) for i, x in enumerate(sets[:j]) if bands.linked(len(np.intersect1d(x, y)), len(x), len(y))]
    assert len(real) > len(rows)
    assert len(nj.Tile(rows, bands).candidates()) < len(rows)
    links = nj.Tile(rows, bands).links()
    assert len(links) < len(rows)
    assert closure(range(len(sets)), links) == closure(range(len(sets)), real)
    kept = {r[4] for r in nj.Tile(rows, bands).undecided()}
    assert {n for pair in real for n in pair} <= kept


def test_repeated_null_and_clashing(spark):
    long = " ".join(f"w{i}" for i in range(50))
    rows = [(4, long, 1, "x"), (4, "else", 1, "x"), (2, long + " y", 1, "x"), (9, "else", 1, "x"), (None, long, 1, "x"), (7, None, 1, "x")]
    made = spark.createDataFrame(rows, "doc_id long, text string, n_shingles int, content string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in nj.ngram_join(made).collect()), key=repr)
    assert got == sorted([(4, 2), (4, 2), (2, 2), (9, 2), (None, None), (7, 7)], key=repr)
    assert nj.ngram_join(made.limit(0)).count() == 0


def test_runs_over_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    rows = [(k, k * 10, i) for k in range(12) for i in range(k)]
    made = spark.createDataFrame(rows, "key long, tile long, id long").repartition(3)
    got = sorted(tuple(r) for r in nj._members(made).collect())
    assert got == sorted((k * 10, i, 0) for k in range(2, 12) for i in range(k))


def test_components_of_chains_and_stars(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(300)] + [(1_000, 1_000 + i) for i in range(1, 80)] + [(5_000, 5_000), (None, 3)]
    links += [(rng.randint(2_000, 2_200), rng.randint(2_000, 2_200)) for _ in range(150)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    real = [(a, b) for a, b in links if a is not None and a != b]
    assert got == closure({n for x in real for n in x}, real)
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_tiles_of_two_are_compared_once(spark):
    """Two rows alone in a tile need no second look; rows of a crowded tile, the first of a group among them, do."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    rows = [(k, k * 10, i, k == 5) for k in range(1, 8) for i in range(3 if k == 6 else 2)]
    made = spark.createDataFrame(rows, "key long, tile long, id long, more boolean").coalesce(1)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    got = sorted((tuple(r) for r in nj._members(made).collect()), key=repr)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    twos = [r for r in got if r[0] is None]
    # the first and the last key of the batch may go on in another one
    assert twos == [(None, 1, 0)] * 3
    assert [r for r in got if r[0]] == sorted([(k * 10, i, 0) for k in (1, 5, 6, 7) for i in range(3 if k == 6 else 2)], key=repr)


def test_texts_not_asked_for_stay(spark, docs):
    """Few texts are asked for, and next to no other one is made into a set or shuffled."""
    made = docs(*[f"text {i}" for i in range(4_000)])
    ids = spark.createDataFrame([(i,) for i in range(0, 4_000, 100)], "id long")
    got = {r["doc_id"] for r in nj._asked(made, ids, 40).collect()}
    assert got >= set(range(0, 4_000, 100))
    assert len(got) < 60
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = nj._sets(made, ids, 40, 4)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_equal_groups_of_tiles_are_one():
    """The same open rows leave several tiles under one number; rows without an open pair do not leave."""
    rng, bands = np.random.default_rng(9), nj.Bands(85, 100)
    base = rng.integers(0, 2**63, 100).astype(np.uint64)
    near = [np.unique(np.concatenate([base[i:], rng.integers(0, 2**63, i).astype(np.uint64)])) for i in (0, 5, 9)]
    far = [np.unique(rng.integers(0, 2**63, 100).astype(np.uint64)) for _ in range(2)]
    row = lambda tile, i, s: (tile, 0, 0, 0, i, i, len(s), bands.bitmap(s))
    first = nj.Tile([row(1, i, s) for i, s in enumerate(near + far[:1])], bands).undecided()
    second = nj.Tile([row(2, i, s) for i, s in enumerate(near)] + [row(2, 9, far[1])], bands).undecided()
    assert {r[4] for r in first} == {0, 1, 2}
    assert len({r[0] for r in first}) == 1
    assert sorted(first) == sorted(second)
