"""Release decisions, with their boundaries."""

import random
from collections import deque
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from corpuswarden.operators import release as ops

NOW = datetime(2024, 3, 1, 12)


def as_of():
    return F.expr("TIMESTAMP_NTZ '2024-03-01 12:00:00'")


def test_cascade_through_chains_diamonds_and_loops(frame, rows):
    edges = frame("upstream string, downstream string", ("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("d", "a"), ("x", "y"), ("d", "d"))
    out = ops.dependency_cascade(edges, frame("n string", ("b",), ("b",)), "n")
    assert rows(out) == [("a", "added", 3), ("b", "selected", 0), ("c", "added", 1), ("d", "added", 2)]
    assert rows(ops.dependency_cascade(edges, frame("n string", ("y",)), "n")) == [("y", "selected", 0)]


def test_cascade_over_any_graph_equals_a_plain_search(frame, rows):
    rng = random.Random(4)
    for n, m, ring in ((30, 25, 0), (40, 60, 5), (12, 40, 0)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(100 + k, 100 + (k + 1) % ring) for k in range(ring)]
        chosen = rng.sample(range(n), 3)
        level, todo = dict.fromkeys(chosen, 0), deque(chosen)
        while todo:
            at = todo.popleft()
            for u, d in edges:
                if u == at and d not in level:
                    level[d] = level[at] + 1
                    todo.append(d)
        out = ops.dependency_cascade(frame("upstream int, downstream int", *edges), frame("n int", *[(c,) for c in chosen]), "n")
        assert {r[0]: r[2] for r in rows(out)} == level


def test_long_chain_takes_few_rounds(frame, rows, monkeypatch):
    rounds = []
    plain = ops.materialize
    monkeypatch.setattr(ops, "materialize", lambda df, label, *counted: rounds.append(label) or plain(df, label, *counted))
    edges = [(k, k + 1) for k in range(1_200)] + [(5_000, 700)]
    out = ops.dependency_cascade(frame("upstream int, downstream int", *edges), frame("n int", (0,)), "n")
    assert {r[0]: r[2] for r in rows(out)} == {k: k for k in range(1_201)} and len(rounds) <= 20


def test_cascade_sends_no_table_to_the_driver(frame, monkeypatch):
    plans = []
    plain = ops.materialize
    note = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(ops, "materialize", lambda df, label, *counted: note(df) or plain(df, label, *counted))
    edges = [(k // 2, k) for k in range(1, 40)] + [(k // 3, k) for k in range(3, 40)]
    out = ops.dependency_cascade(frame("upstream int, downstream int", *edges), frame("n int", (2,)), "n")
    note(out)
    assert len(plans) > 4 and any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)


def test_receipt_age_limit_is_inclusive(frame, rows):
    required = frame("k string, c string", *[(f"p@{i}", "tests") for i in range(4)], ("p@0", "review"))
    ts = [NOW - timedelta(days=7), NOW - timedelta(days=7, microseconds=1), NOW]
    receipts = frame("k string, c string, ts timestamp_ntz", *[(f"p@{i}", "tests", t) for i, t in enumerate(ts)], ("p@1", "tests", NOW - timedelta(days=9)))
    out = ops.receipt_validity(required, receipts, "k", "c", "ts", as_of(), 7)
    assert rows(out) == [
        ("p@0", "review", "MISSING", None), ("p@0", "tests", "VALID", 7), ("p@1", "tests", "EXPIRED", 7), ("p@2", "tests", "VALID", 0), ("p@3", "tests", "MISSING", None)
    ]


def test_prune_cutoff_is_strict_and_keeps_whole_entries(frame, rows):
    df = frame("k string, c string, ts timestamp_ntz", ("a", "x", NOW), ("a", "y", NOW - timedelta(days=99)), ("b", "x", NOW - timedelta(days=30)), ("c", "x", None))
    out = ops.retention_prune(df, "k", "ts", as_of() - F.make_dt_interval(days=F.lit(30)))
    assert rows(out, "k", "c") == [("a", "x"), ("a", "y")]


def test_floor_is_never_lowered(frame, rows):
    pins = frame("r string, d string, floor string", ("m", "up", "0.9.9"), ("m", "down", "0.9.25"), ("m", "same", "1.0.0"), ("m", "odd", "dev"), ("m", "gone", "1.0.0"))
    versions = frame("d string, version string", ("up", "0.10.0"), ("down", "0.9.24"), ("same", "1.0.0"), ("odd", "2.0.0"))
    assert rows(ops.pin_floor_ratchet(pins, versions, "d"), "d", "action", "new_floor") == [
        ("down", "kept", "0.9.25"), ("gone", "error", "1.0.0"), ("odd", "raised", "2.0.0"), ("same", "same", "1.0.0"), ("up", "raised", "0.10.0")
    ]


def test_pins_and_clamp(frame, rows):
    required = frame("p string, d string", ("m", "a"), ("m", "b"), ("n", "b"), ("m", "unknown"))
    versions = frame("d string, version string", ("a", "1.0.0"), ("b", "2.0.0"))
    published = frame("d string, version string", ("a", "1.0.0"), ("b", "1.9.0"))
    assert rows(ops.pin_availability(required, versions, published, "p", "d")) == [("m", "b", "2.0.0"), ("n", "b", "2.0.0")]
    local = frame("p string, version string", ("pub", "1.2.0"), ("ahead", "1.3.0"), ("new", "0.1.0"))
    index = frame("p string, version string", ("pub", "1.2.0"), ("pub", "1.10.0"), ("ahead", "1.9.0"), ("ahead", "1.10.0"))
    assert rows(ops.version_clamp(local, index, "p")) == [
        ("ahead", "1.3.0", "1.10.0", "clamped"), ("new", "0.1.0", "0.1.0", "local"), ("pub", "1.2.0", "1.2.0", "published")
    ]


def test_equal_times_are_fresh(frame, rows):
    built = frame("p string, built timestamp_ntz", ("eq", NOW), ("old", NOW), ("gen", NOW), ("none", None), ("noinput", NOW))
    later = NOW + timedelta(seconds=500)
    inputs = frame("p string, path string, mtime timestamp_ntz", ("eq", "a.py", NOW), ("old", "a.py", later), ("gen", "a_ui.py", later), ("gen", "b.py", NOW), ("none", "a.py", NOW))
    out = ops.freshness_guard(built, inputs, "p", F.col("path").endswith("_ui.py"))
    assert rows(out) == [("eq", "fresh"), ("gen", "fresh"), ("noinput", "fresh"), ("none", "error"), ("old", "stale")]


def test_run_verdicts(frame, rows):
    schema = "k string, status string, conclusion string, t int"
    runs = frame(
        schema, ("ok", "completed", "success", 1), ("wait", "completed", "failure", 1), ("wait", "in_progress", None, 2),
        ("bad", "completed", "cancelled", 1), ("bad", "completed", "failure", 2), ("bad", "completed", "success", 3), ("nocon", "completed", None, 1),
    )
    keys = frame("k string", ("ok",), ("wait",), ("bad",), ("none",), ("nocon",))
    assert rows(ops.run_verdict(keys, runs, "k", ["t"]), "k", "verdict") == [
        ("bad", "failure"), ("nocon", "success"), ("none", "norun"), ("ok", "success"), ("wait", "pending")
    ]


def test_merge_gate(frame, rows):
    requests = frame("pr int, merge_state string", (1, "CLEAN"), (2, "CLEAN"), (3, "BLOCKED"), (4, "BLOCKED"))
    checks = frame("pr int, conclusion string, state string", (2, "success", None), (3, "success", None), (3, "", "SUCCESS"), (4, None, "PENDING"), (4, "success", None))
    assert rows(ops.merge_gate(requests, checks, "pr"), "pr", "n_pending", "gate") == [(1, None, "ungated"), (2, 0, "gated"), (3, 0, "stuck"), (4, 1, "waiting")]


def test_housekeeping_needs_changes(frame, rows):
    changes = frame("r string, path string", ("h", "CHANGELOG.md"), ("h", "API_INDEX.md"), ("m", "CHANGELOG.md"), ("m", "a.py"), ("n", None))
    out = ops.housekeeping_only(frame("r string", ("h",), ("m",), ("n",), ("empty",)), changes, "r", F.col("path").isin("CHANGELOG.md", "API_INDEX.md"))
    assert rows(out) == [("empty", False), ("h", True), ("m", False), ("n", False)]


def test_release_gate(frame, rows):
    packages = frame("p string", ("none",), ("house",), ("ok",), ("bad",), ("waived",), ("unknown",))
    deltas = frame("p string, ahead long", ("none", 0), ("house", 2), ("ok", 1), ("bad", 1), ("waived", 1))
    house = frame("p string, housekeeping boolean", ("house", True), ("ok", False))
    validity = frame(
        "p string, check string, state string",
        ("house", "review", "MISSING"), ("ok", "review", "VALID"), ("ok", "tests", "MISSING"), ("bad", "review", "EXPIRED"), ("waived", "tests", "MISSING"),
    )
    out = ops.release_gate(packages, deltas, house, validity, "p", waived=("tests",))
    assert rows(out, "p", "verdict", "n_waived") == [
        ("bad", "blocked", 0), ("house", "exempt_housekeeping", 0), ("none", "exempt_no_delta", 0), ("ok", "pass", 1), ("unknown", "exempt_no_delta", 0), ("waived", "pass", 1)
    ]


def test_bump_message_is_anchored(frame, rows):
    log = frame(
        "r string, t int, m string",
        ("a", 1, "fix"), ("a", 2, "Bump version to 1.2.3"), ("b", 1, "Bump version to 1"), ("b", 2, 'Revert "Bump version to 1"'),
        ("c", 1, "update Dependencies & bump version to 2"), ("d", 1, "please bump version to 3"),
    )
    assert rows(ops.latest_is_bump(log, "r", "m", ["t"]), "r", "is_bump") == [("a", True), ("b", False), ("c", True), ("d", False)]


def test_versions_of_many_digits(frame, rows):
    from corpuswarden.functions.versions import is_lower

    df = frame("a string, b string", ("2000000000.1.0", "2000000001.0"), ("20261201123456.1", "1.0"))
    assert rows(df.select("a", is_lower(F.col("a"), F.col("b")).alias("low"))) == [("2000000000.1.0", True), ("20261201123456.1", False)]


def test_a_run_without_conclusion_is_no_failure(frame, rows):
    runs = frame("k string, status string, conclusion string, ts int", ("a", "completed", "", 2), ("b", "completed", "", 1), ("b", "completed", "failure", 0))
    out = ops.run_verdict(frame("k string", ("a",), ("b",)), runs, "k", ["ts"])
    assert rows(out, "k", "verdict") == [("a", "success"), ("b", "failure")]
