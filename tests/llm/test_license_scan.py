"""Alignment against brute force, and passages in texts."""

import itertools
import random

from corpuswarden.llm import license_scan as ls
from corpuswarden.llm import license_texts as lt


def test_increasing_is_longest():
    rng = random.Random(1)
    for _ in range(200):
        values = [rng.randint(0, 9) for _ in range(rng.randint(0, 9))]
        found = [values[i] for i in ls.increasing(values)]
        best = max(k for k in range(len(values) + 1) for c in itertools.combinations(values, k) if all(x < y for x, y in zip(c, c[1:])))
        assert len(found) == best and all(x < y for x, y in zip(found, found[1:]))


def test_alignment_pairs_equal_rising_words():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.randint(0, 12) for _ in range(rng.randint(0, 20))] for _ in range(2))
        pairs = ls.align(a, b)
        assert all(a[x] == b[y] for x, y in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        assert len(ls.align(a, a)) == len(a)


def brute(words, templates):
    """Every exact occurrence of a template, longest first, none overlapping."""
    out = []
    for name, t in sorted(templates, key=lambda t: -len(t[1])):
        for i in range(len(words) - len(t) + 1):
            if words[i : i + len(t)] == t and all(i >= e or i + len(t) <= s for _, s, e in out):
                out.append((name, i, i + len(t)))
    return sorted(out, key=lambda s: s[1])


def test_exact_passages_equal_brute_force(spark, docs):
    rng = random.Random(3)
    templates = [("A", [f"a{i}" for i in range(12)]), ("B", [f"b{i}" for i in range(7)]), ("C", ["solo"])]
    texts = []
    for _ in range(60):
        parts = [rng.choice(templates)[1] if rng.random() < 0.3 else [f"x{rng.randint(0, 30)}"] * rng.randint(1, 4) for _ in range(rng.randint(0, 12))]
        texts.append([w for p in parts for w in p])
    rows = ls.scan_licenses(docs(*map(" ".join, texts)), [(n, " ".join(t)) for n, t in templates]).collect()
    for r in rows:
        assert [(s["license"], s["start"], s["end"]) for s in r["spans"]] == brute(texts[r["doc_id"]], templates)


def test_edges(spark, docs, clashing):
    apache = ls.TEMPLATES[0][1]
    changed = apache.replace("the Apache", "the (new) Apache").upper()
    texts = [None, "", "word " * 5000 + apache + " end", changed, apache + ". " + apache, "licensed under the moon", "Licensed under CC BY-NC 4.0."]
    found = {r["doc_id"]: [(s["license"], s["start"]) for s in r["spans"]] for r in ls.scan_licenses(docs(*texts)).collect()}
    assert found == {0: [], 1: [], 2: [("Apache-2.0", 5000)], 3: [("Apache-2.0", 0)], 4: [("Apache-2.0", 0), ("Apache-2.0", 8)], 5: [], 6: [("CC-BY-NC-4.0", 0)]}
    assert ls.scan_licenses(docs("x").limit(0)).count() == 0
    assert ls.scan_licenses(docs(apache), [("N", None), ("E", "")]).first()["spans"] == []
    rows = ls.scan_licenses(clashing(apache, None), carry=True).collect()
    assert sorted((r["_row"]["kind"] is None, len(r["spans"])) for r in rows) == [(True, 0), (True, 1)]


def test_whole_texts_and_siblings(spark, docs):
    rng = random.Random(4)
    named = [(n, t) for n, t, _ in lt.bodies()]
    edited = [" ".join("changed" if rng.random() < 0.03 else w for w in dict(named)[n].split()) for n in ("Apache-2.0", "CC0-1.0", "BSD-3-Clause")]
    notices = {
        "Licensed under CC BY-ND 4.0": ["CC-BY-ND-4.0"],
        "Licensed under CC BY-NC-SA 3.0": ["CC-BY-NC-SA-3.0"],
        "Licensed under CC BY 9.0": [],
        "This work is licensed under the GNU Lesser General Public License, version 3": ["LGPL-3.0"],
        "This work is licensed under the GNU General Public License, version 2": ["GPL-2.0"],
        "This work is licensed under the GNU Affero General Public License, version 3": ["AGPL-3.0"],
        "This work is licensed under the GNU Other General Public License, version 3": [],
    }
    # a sibling whose text is not at hand
    other = dict(named)["GPL-3.0"].replace("GENERAL PUBLIC", "OTHER GENERAL PUBLIC").replace("GNU General", "GNU Other General")
    texts = [f"before {t} after" for _, t in named] + edited + list(notices) + [other]
    found = {r["doc_id"]: r["spans"] for r in ls.scan_licenses(docs(*texts)).collect()}
    expected = [[n] for n, _ in named] + [["Apache-2.0"], ["CC0-1.0"], ["BSD-3-Clause"], *notices.values(), []]
    assert [[s["license"] for s in found[i]] for i in range(len(texts))] == expected
    for i in range(len(named)):
        words = len(ls.word_hashes(texts[i], ls.MARKS))
        assert [(s["start"], s["end"], s["coverage"]) for s in found[i]] == [(1, words - 1, 1.0)]


def test_every_standard_template_finds_its_licence():
    own = ls.Templates(lt.standard())
    for name, text, _ in lt.standard():
        assert [s[0] for s in own.scan(ls.word_hashes(text, ls.MARKS), ls.COVERAGE, ls.DENSITY)] == [name], text[:80]
