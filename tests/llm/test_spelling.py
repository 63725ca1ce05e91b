"""Near words against a comparison of all pairs; counts, forms and roots by the letter."""

import os
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpuswarden.llm.queries import QUERIES
from corpuswarden.llm.spelling import keyed_words, spelling_variants

FOLDER = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a, b):
    """Whether one inserted, deleted or replaced letter parts two words."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(docs):
    counts = Counter()
    for doc, text in docs:
        for word in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = word.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{word}".encode())
            if h % 31 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= 7:
                counts[word] += 1
    words = {w: n for w, n in counts.items() if n >= 2}
    by_size = {}
    for w in words:
        by_size.setdefault(len(w), []).append(w)
    out, forms = {}, {}
    for w, n in words.items():
        near = [x for k in (-1, 0, 1) for x in by_size.get(len(w) + k, []) if one_edit(w, x)]
        top = min(near, key=lambda x: (-words[x], x), default=None)
        if top and words[top] >= 10 * n:
            forms[w] = top
        out[w] = [n, len(near)]
    rows = []
    for w, (n, near) in out.items():
        root = w
        while root in forms:
            root = forms[root]
        rows.append((w, forms.get(w), root, n, near, words.get(forms.get(w))))
    return sorted(rows)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def variants(rng, words, letters):
    """The words, and as many with one or two edits."""
    out = list(words)
    for w in words:
        for _ in range(rng.randint(0, 2)):
            at, how = rng.randrange(len(w) + 1), rng.randrange(3)
            w = w[:at] + rng.choice(letters) * (how > 0) + w[at + (how < 2) :]
            out.append(w)
    return out


@pytest.mark.parametrize("letters, most", [("ab", 2_048), ("ab", 4), ("abcé", 30), ("abcdefghijklmnop", 2_048)])
def test_equals_brute_force(spark, letters, most):
    rng = random.Random(len(letters) + most)
    words = variants(rng, ["".join(rng.choices(letters, k=rng.randint(5, 12))) for _ in range(150)], letters)
    docs = [(k if k else None, rng.choice([" ", "-", "7", "\n"]).join(rng.choices(words, [0.97**i for i in range(len(words))], k=400))) for k in range(12)]
    docs += [(50, None), (51, ""), (52, "ÀÉÎÕÜàéîõü ÀÉÎÕÜàéîõü Overall OVERALL overall İoverall"), (53, "aaaaaaa aaaaaaaa aaaaaaaaa " * 30)] * 2
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, word string, n int").repartition(4)
    assert rows_of(spelling_variants(frame, most=most)) == brute(docs)


def test_chain_of_forms_and_very_long_words(spark):
    long = "ab" * 20_000
    text = " ".join(["zzzzzzza"] * 2 + ["zzzzzzzb"] * 25 + ["zzzzzyzb"] * 300 + ["zzzzyyzb"] * 3_100 + [long, long, long + "c", long + "c"])
    docs = [(7, text)]
    got = {r[0]: r for r in rows_of(spelling_variants(spark.createDataFrame(docs, "doc_id long, text string")))}
    assert sorted(got.values()) == brute(docs)


def test_keys_are_bounded_and_hold_every_pair(spark):
    rng = random.Random(3)
    words = list({"shared" + "".join(rng.choices("abcdefgh", k=5)) + "ending" for _ in range(3_000)})
    frame = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    keyed = keyed_words(frame, most=64)
    key = ["size", "low", "high", "affix"]
    top = keyed.where("high - low > 1").groupBy(*key).count().agg(F.max("count")).first()[0]
    assert top <= 64 and (keyed.where("high - low = 1").groupBy(*key).count().agg(F.max("count")).first()[0] or 0) <= 9


def test_empty_table(spark):
    assert spelling_variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not there")
def test_query_equals_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    expected = brute(docs)
    assert rows_of(QUERIES["op12_spelling"](spark, FOLDER)) == expected and any(r[1] for r in expected)
