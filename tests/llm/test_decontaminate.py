"""Window spans against brute force."""

import random
import re
import time

from corpuswarden.llm.decontaminate import Automaton, decontaminate, without_spans, words_of

ITEMS = "item_id long, text string"


def brute(text, items, window):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hit, found = set(), set()
    for key, item in items:
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), item or ""))
        n = min(window, len(own))
        for i in range(len(own) - n + 1) if n else ():
            for j in range(len(words) - n + 1):
                if words[j : j + n] == own[i : i + n]:
                    hit.update(range(j, j + n))
                    found.add(key)
    return len(words), hit, found


def test_automaton_equals_brute_force():
    rng = random.Random(5)
    for trial in range(150):
        letters = "ab" if trial % 2 else "abcde"
        window = rng.choice([2, 3, 5])
        items = [(str(k), " ".join(rng.choice(letters) for _ in range(rng.randint(0, 9)))) for k in range(rng.randint(0, 5))]
        text = " ".join(rng.choice(letters + "x") for _ in range(rng.randint(0, 60)))
        spans, found = Automaton(items, window).scan(words_of(text))
        n, hit, expected = brute(text, items, window)
        assert {p for a, b in spans for p in range(a, b)} == hit and found == expected, (items, text, window)
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_edge_cases(spark, docs, frame, clashing):
    passage = " ".join(f"w{i}" for i in range(20))
    items = frame(ITEMS, (1, passage), (1, passage), (2, "Solo Word"), (3, ""), (4, None), (None, "z1 z2"))
    texts = (None, "", "é", passage.upper() + " x", "a solo-word b", "z1 z2", "w0 " * 40, "y " * 5_000 + passage + " end")
    for made, shard in ((docs(*texts), 10**6), (clashing(*texts), 60)):
        got = {r["doc_id"]: r for r in decontaminate(made, items, shard_chars=shard).collect()}
        assert len(got) == len(texts)
        listed = [(str(k) if k else None, t) for k, t in [(1, passage), (2, "Solo Word"), (3, ""), (4, None), (None, "z1 z2")]]
        for i, text in enumerate(texts):
            n, hit, found = brute(text, listed, 13)
            assert (got[i]["n_words"], got[i]["n_hit"]) == (n, len(hit))
            assert got[i]["item_ids"] == sorted(k for k in found if k)
            assert got[i]["contaminated"] == (bool(hit) and 20 * len(hit) >= n)
    assert decontaminate(docs(*texts).limit(0), items).count() == 0
    assert not any(r["n_hit"] for r in decontaminate(docs(*texts), items.limit(0)).collect())


def test_repetitive_items_take_time_in_proportion():
    item = "ab " * 100_000
    began = time.process_time()
    automaton = Automaton([("1", item), *[(str(k), "ab ab") for k in range(2, 5_000)], ("x", "cd " * 12 + "ef")], 13)
    spans, found = automaton.scan(words_of(item + "cd " * 30 + "ab"))
    assert spans == [[0, 100_000]] and len(found) == 4_999 and time.process_time() - began < 30


def test_columns_come_through_several_passes(frame, clashing):
    passage = " ".join(f"w{i}" for i in range(20))
    made = clashing(passage, "clean", None)
    out = without_spans(made, frame(ITEMS, (1, passage), (2, " ".join(f"v{i}" for i in range(20)))), shard_chars=60)
    assert out.columns == made.columns
    assert sorted((r["doc_id"], r["text"], r["_n"], r["a.b"]) for r in out.collect()) == [(0, "", 7, 10), (1, "clean", 7, 10), (2, None, 7, 10)]


def test_passages_are_cut_out(docs, frame):
    passage = " ".join(f"w{i}" for i in range(20))
    made = docs(f"Before, {passage}! After", "clean Text", None, "y " * 1_000 + passage)
    got = {r["doc_id"]: r["text"] for r in without_spans(made, frame(ITEMS, (1, passage))).collect()}
    assert got[0] == "Before, ! After" and got[1] == "clean Text" and got[2] is None and got[3].endswith("w19")
    cut = without_spans(made, frame(ITEMS, (1, passage)), longest=15).collect()
    assert not any("w19" in (r["text"] or "") for r in cut)
