"""Audits against an exhaustive search, blocks against whole conversations, repaired rows."""

import hashlib
import itertools
import os
import random
import re
import zlib
from functools import lru_cache

import pytest

from corpuswarden.llm import conversations
from corpuswarden.llm.conversations import audit_conversations, block_paths, repair_conversations
from corpuswarden.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def cheapest(rows):
    """Cost, audit and repaired rows, by trying all edits of ``(role, text, fault)`` rows from the end.

    A state is the initials so far as far as they matter: none, s, u or a."""

    @lru_cache(maxsize=None)
    def best(i, state, inserts):
        found = []
        turn = "assistant" if state == "u" else "user"
        if i == len(rows):
            if state in ("", "a"):
                found.append((0, "", ()))
        else:
            role, text, fault = rows[i]
            cost, audit, rest = best(i + 1, state, 2)
            found.append((cost + 2, "D" + audit, rest))
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                if role and state + role[0] in ("s", "u", "su", "ua", "au"):
                    cost, audit, rest = best(i + 1, role[:1], 2)
                    found.append((cost + more, "K" + audit, ((role, text), *rest)))
                cost, audit, rest = best(i + 1, turn[0], 2)
                found.append((cost + more + 1, "R" + audit, ((turn, text), *rest)))
        if inserts:
            cost, audit, rest = best(i, turn[0], inserts - 1)
            found.append((cost + 5, "I" + audit, ((turn, ""), *rest)))
        return min(found, default=(10**9, "", ()))

    return best(0, "", 2)


def brute(data):
    """Contract rows of ``(conv_id, turn, role, text)`` rows, by the letter."""
    out = []
    space = lambda x: " " if x is None else str(x)
    for conv in {r[0] for r in data}:
        rows = []
        for _, turn, role, text in sorted((r for r in data if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, space(r[2]), hashlib.sha256(space(r[3]).encode()).hexdigest())):
            fault = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
            role, text = space(role), space(text)
            if fault == 0:
                continue
            text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
            rows += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        seen, marked = set(), []
        for _, role, text in rows:
            body = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            marked.append((role, text, fault))
        turns = {t for t, *_ in rows if t is not None}
        illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        cost, audit, kept = cheapest(tuple(marked))
        lines = "\n".join(f"{r}:{t}" for r, t in kept)
        counts = [sum(f == x for *_, f in marked) for x in ("blank", "duplicate", "truncated")]
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts, illegal, cost, audit, hashlib.sha256(lines.encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def some(rng, convs, turns, texts=("Yes.", "No!", "why", " ", "", "ok. \n", "a b.\t", None, "x?")):
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "uncle"]
    return [(c, rng.choice([t, t, t, t + 2, None]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.6 else f"text {c} {t}.") for c in convs for t in range(turns)]


def test_paths_of_blocks_equal_exhaustive_search():
    rng = random.Random(5)
    fault = {"b": "blank", "d": "duplicate", "t": "truncated", "-": ""}
    for n in (1, 2, 3, 5, 9, 20):
        for _ in range(60):
            signs = [rng.choice("ssuuuaaao") + rng.choice("bdtt------") for _ in range(n)]
            rows = tuple(({"s": "system", "u": "user", "a": "assistant", "o": "tool"}[s[0]], "x", fault[s[1]]) for s in signs)
            cost, audit, _ = cheapest(rows)
            costs, audits = block_paths("".join(signs))
            ends = [(costs[e] + c, audits[e] + a) for e, (c, a) in enumerate(conversations.ENDS)]
            assert min(ends) == (cost, audit)


def test_rows_equal_brute_force(spark):
    rng = random.Random(6)
    data = some(rng, [*range(40), None], 6) + some(rng, [100, 101], 40)
    data += [(200, 1, "user", "again.")] * 150 + [(201, None, "user", "Hi.")] * 3
    data += [(k, 0, "user", "Gone.") for k in range(300, 360)]  # some lose their only row
    rng.shuffle(data)
    frame = spark.createDataFrame([(*r, 1, "x") for r in data], "conv_id long, turn long, role string, text string, at int, audit string")
    assert rows_of(audit_conversations(frame)) == brute(data)


@pytest.mark.parametrize("size", [1, 3])
def test_any_size_of_blocks_gives_the_same(spark, size):
    rng = random.Random(7)
    data = some(rng, range(12), 9) + some(rng, [50], 60)
    frame = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").repartition(3)
    assert rows_of(audit_conversations(frame, size)) == brute(data)


def test_repaired_rows_follow_the_form(spark):
    rng = random.Random(8)
    data = some(rng, range(30), 7)
    frame = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    found = {}
    for r in sorted(repair_conversations(frame).collect(), key=lambda r: (r["conv_id"], r["position"])):
        assert r["position"] == len(found.setdefault(r["conv_id"], []))
        found[r["conv_id"]].append((r["role"], r["text"]))
    sums = {r[0]: r[-1] for r in brute(data)}
    for conv, rows in found.items():
        assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in rows))
        assert hashlib.sha256("\n".join(f"{r}:{t}" for r, t in rows).encode()).hexdigest() == sums[conv]


def test_long_conversation_takes_time_in_proportion():
    signs = [random.Random(9).choice(["u-", "a-", "ut", "ad", "s-"]) for _ in range(conversations.BLOCK)]
    costs, _ = block_paths("".join(signs))
    assert costs[0] < conversations.FAR


def test_empty_table_and_text_ids(spark):
    schema = "conv_id string, turn int, role string, text string"
    assert audit_conversations(spark.createDataFrame([], schema)).count() == 0
    data = [("a", 0, "user", "Hi."), ("a", 1, "assistant", "Ho."), ("b", 0, "assistant", "Ha.")]
    assert rows_of(audit_conversations(spark.createDataFrame(data, schema))) == brute(data)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not there")
def test_query_equals_brute_force(spark):
    data = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(QUERIES["op13_conversations"](spark, FOLDER)) == brute(data)
