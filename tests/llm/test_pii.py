"""Base spans against plain regular expressions; estimation, classification and masking."""

import random
import re
import time

import numpy as np

from corpuswarden.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for kind, plain in PLAIN.items():
        for m in re.finditer(plain, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                "card": 16 <= len(digits) <= 19 and pii.luhn(digits),
                "phone": 8 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((kind, *m.span()))
    return out


def test_base_spans_equal_plain_expressions():
    rng = random.Random(4)
    parts = ["1", "25", "255", "256", ".", "..", "+", "-", " ", "(", ")", "@", "a", "B.c", "é", "٣", "4111 1111 1111 1111", "4111111111111111",
             "+1 (234) 555-0000", "x@y.zz", "10.0.0.1", "\n", "_", "%", "0" * 17]
    for _ in range(4_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(text) == brute(text), text
    for long in ("1" * 100_000, "a" * 100_000 + "@", "+1" + " " * 100_000, "1." * 50_000, "@" * 100_000, "a@" * 50_000):
        pii.candidates(long)


def test_long_digit_runs_and_many_names():
    for text in ("0" * 5_000 + ".1.2.3", "9" * 5_000 + ".1.2.3", "1.2.3." + "0" * 5_000 + "7"):
        zeros = re.sub(r"0{100,}", "0", text)
        assert len(pii.base_spans(text)) == len(brute(zeros[:200]) if "9" * 99 not in text else [])
    began = time.process_time()
    found = pii.candidates("Maria Rossi and " * 100_000)
    assert len(found) <= 100_000 and time.process_time() - began < 30


def test_candidates_overlap_nothing():
    rng = random.Random(8)
    parts = ["Maria Rossi", " ", "123-45-6789", "+1 (234) 555-0000", "4111 1111 1111 1111", "(234) 555-0000", "10.0.0.1", "x@y.zz", "DE89370400440532013000", "born "]
    for _ in range(500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        spans = pii.candidates(text)
        base, more = [s for s in spans if s[3]], [s for s in spans if not s[3]]
        for i, (_, s, e, _) in enumerate(more):
            assert not any(s < e2 and s2 < e for _, s2, e2, _ in base + more[:i]), text


def test_estimation_finds_the_reliable_labelers():
    rng = np.random.default_rng(1)
    truth = rng.random(5_000) < 0.4
    rates = [0.95, 0.9, 0.8, 0.7, 0.6, 0.5]
    seen: dict[str, int] = {}
    for t in truth:
        answer = "".join("+" if (rng.random() < r) == t else "-" for r in rates)
        seen[f"card|{answer}|55"] = seen.get(f"card|{answer}|55", 0) + 1
    patterns, counts = list(seen), np.array(list(seen.values()), float)
    posterior, table = pii.estimate(patterns, counts)
    right = [(table[1, k, 2] + table[0, k, 0]) / 2 for k in range(6)]
    assert np.allclose(right, rates, atol=0.06)
    assert abs((posterior * counts).sum() / counts.sum() - 0.4) < 0.05


TEXTS = (
    None,
    "",
    "Write to jo.doe@mail.example.com or call +1 (234) 555-0000.",
    "server 10.0.0.1 version 999.1.1.1, card 4111 1111 1111 1111 and 4111 1111 1111 1112",
    "Dear John Smith, your IBAN is DE89 3704 0044 0532 0130 00; ssn 123-45-6789; tel 234-555-0100",
    "nothing here",
    "x" * 3_000 + " a@b.cc",
)


def test_spans_and_masks(spark, docs, clashing):
    for made in (docs(*TEXTS), clashing(*TEXTS)):
        got = {r["doc_id"]: r for r in pii.find_pii(made, mask=True).collect()}
        for i, text in enumerate(TEXTS):
            spans = [(s["kind"], s["start"], s["end"]) for s in got[i]["spans"]]
            base = brute(text or "")
            assert [s for s in spans if s in base] == base
            assert spans == sorted(spans, key=lambda s: (pii.KINDS.index(s[0]), s[1]))
        kinds = {s["kind"] for s in got[4]["spans"]}
        assert {"name", "iban", "ssn"} <= kinds
        assert "jo.doe" not in got[2]["masked_text"] and "[EMAIL]" in got[2]["masked_text"]
    masked = {r["doc_id"]: r["text"] for r in pii.mask_pii(docs(*TEXTS)).collect()}
    assert masked[0] is None and masked[5] == TEXTS[5] and masked[6].endswith(" [EMAIL]")
    assert pii.find_pii(docs("x").limit(0)).count() == 0
