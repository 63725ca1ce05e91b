"""Span hashes, fingerprints and neighbours against brute force."""

import hashlib
import random

import pytest

from corpuswarden.llm import fingerprints as fp


def test_spans_and_common_extensions():
    rng = random.Random(1)
    for _ in range(60):
        a, b = ("".join(rng.choice("abé😀") for _ in range(rng.randint(0, 60))) for _ in "xy")
        x, y = fp.PrefixHash(fp.code_points(a)), fp.PrefixHash(fp.code_points(b))
        for _ in range(20):
            i, j = rng.randint(0, len(a)), rng.randint(0, len(b))
            n = rng.randint(0, min(len(a) - i, len(b) - j))
            assert (x.span(i, n) == y.span(j, n)) == (a[i : i + n] == b[j : j + n])
            longest = next((k for k in range(min(len(a) - i, len(b) - j)) if a[i + k] != b[j + k]), min(len(a) - i, len(b) - j))
            assert fp.common_extension(x, i, y, j) == longest


def test_segments_change_nothing(monkeypatch):
    text = "".join(random.Random(2).choice("abcdefgh ") for _ in range(5_000))
    whole = fp.fingerprint(text)
    monkeypatch.setattr(fp, "SEGMENT", 700)
    assert fp.fingerprint(text) == whole


def test_likeness_follows_shared_windows():
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcdefghijkl ") for _ in range(n))
    a, b = text(4_000), text(4_000)
    assert fp.likeness(fp.fingerprint(a), fp.fingerprint(a)) == 1.0
    assert fp.likeness(fp.fingerprint(a), fp.fingerprint(b)) < 0.05
    assert abs(fp.likeness(fp.fingerprint(a), fp.fingerprint(a[:2_000] + b[:2_000])) - 1 / 3) < 0.2
    assert fp.likeness(fp.fingerprint(a), fp.fingerprint(a + "x")) > 0.9
    assert fp.likeness(fp.fingerprint(""), fp.fingerprint("")) == 1.0 and fp.likeness(fp.fingerprint(""), fp.fingerprint(a)) == 0.0


@pytest.mark.parametrize("parts", [1, 4, 30])
@pytest.mark.parametrize("segment", [1 << 20, 150])
def test_pairs_equal_brute_force(spark, monkeypatch, parts, segment):
    monkeypatch.setattr(fp, "SEGMENT", segment)
    rng = random.Random(parts)
    texts = [None, "", "a", "ab", "😀é", "same", "same"] + ["".join(rng.choice("ab é😀") for _ in range(rng.randint(0, 300))) for _ in range(40)]
    rows = [(rng.randint(0, 10**6), t, "x", 1) for t in texts] + [(None, "n1", "x", 1), (7, "b", "x", 1), (7, "a", "x", 1), (7, None, "x", 1)]
    made = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string, part int").repartition(3)
    order = sorted(((d, t or "") for d, t, *_ in rows), key=lambda r: (-1 if r[0] is None else r[0], r[1].encode()))
    expected = []
    for i, (d, t) in enumerate(order):
        other = order[(i + 1) % len(order)][1]
        new = t[: len(t) - len(t) // 2] + other[: len(t) // 2]
        common = next((k for k in range(min(len(t), len(other))) if t[k] != other[k]), min(len(t), len(other)))
        a, e, b = fp.fingerprint(t), fp.fingerprint(new), fp.fingerprint(other)
        expected.append((d, len(t), hashlib.sha256(new.encode()).hexdigest(), a, e, fp.likeness(a, e), fp.likeness(a, b), common))
    got = [tuple(r) for r in fp.fingerprint_pairs(made, parts).collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)


def test_empty_and_single(spark, docs):
    assert fp.fingerprint_pairs(docs("x").limit(0)).count() == 0
    row = fp.fingerprint_pairs(docs("abcd")).first()
    assert row["near_edited"] < 1 and row["near_next"] == 1.0 and row["n_chars"] == 4
