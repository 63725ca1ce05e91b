"""Two and three sided comparison: seeded differences are found, equal sides give none."""

from pyspark.sql import functions as F

from corpuswarden.operators import diff, ledger


def kv(frame, *data):
    return frame("k string, v string", *data)


def test_snapshot_diff(frame, rows):
    old = kv(frame, ("same", "1"), ("gone", "1"), ("chg", "1"), ("null", None), ("tonull", "1"))
    new = kv(frame, ("same", "1"), ("new", "1"), ("chg", "2"), ("null", None), ("tonull", None))
    assert rows(diff.snapshot_diff(old, new, ["k"], "v")) == [
        ("chg", "changed", "1", "2"), ("gone", "removed", "1", None), ("new", "added", None, "1"), ("tonull", "changed", "1", None)
    ]
    assert diff.snapshot_diff(old, old, ["k"], "v").isEmpty()


def test_drift_only_over_shared_owners(frame, rows):
    schema = "o string, m string, kind string"
    static = frame(schema, ("A", "x", "method"), ("A", "y", "method"), ("A", "z", "method"), ("OnlyS", "q", "method"))
    runtime = frame(schema, ("A", "x", "method"), ("A", "z", "property"), ("A", "new", "method"), ("OnlyR", "q", "method"))
    assert rows(diff.surface_drift(static, runtime, "o", "m", "kind"), "o", "m", "drift", "severity") == [
        ("A", "new", "added", "WARN"), ("A", "y", "missing", "FAIL"), ("A", "z", "kind_changed", "WARN")
    ]
    assert diff.surface_sides(static, runtime, "o").first().verdict == "OK"
    assert diff.surface_sides(static, runtime.limit(0), "o").first().verdict == "ERROR"


def test_twin_controls_by_priority(frame, rows):
    p = lambda *ks: frame("pair string, key string", *[("p", k) for k in ks])
    book = frame("pair string, key string, status string", ("p", "led", None), ("p", "pen", "pending"), ("p", "hid", "pending"), ("other", "unt", "na"))
    out = diff.twin_control_diff(p("both", "hid", "stat", "led", "pen", "unt"), p("both", "extra"), ["pair", "key"], p("hid", "stat2"), p("stat", "hid"), book)
    assert rows(out, "key", "class") == [
        ("hid", "hidden"), ("led", "triaged"), ("pen", "pending"), ("stat", "static_equiv"), ("unt", "untriaged")
    ]


def test_every_handler_class_is_reachable(frame, rows):
    s = lambda *ks: frame("p string, n string", *[("p", k) for k in ks])
    out = diff.handler_diff(
        s("b1", "b2_init", "b3", "b4", "b5_init", "b6", "b7", "b8", "b9", "b10", "same"), s("same", "b5"), "p", "n",
        ui=s("b1", "b3", "b4", "b5"), hidden=s("b3", "b6"), a_controls=s("b6", "b7", "b4"), b_controls=s("b6"),
        referenced=s("b8", "b7"), ledger=frame("p string, n string, status string", ("p", "b1", "pending"), ("p", "b2", "replaced")),
    )
    assert dict(rows(out, "n", "class")) == {
        "b1": "pending", "b2_init": "triaged", "b3": "hidden", "b4": "unhandled", "b5_init": "partly_built",
        "b6": "wiring", "b7": "covered", "b8": "internal", "b9": "stale", "b10": "stale",
    }


def test_own_ledger_entry_beats_the_base_entry(frame, rows):
    s = lambda *ks: frame("p string, n string", *[("p", k) for k in ks])
    book = frame("p string, n string, status string", ("p", "b1_init", "na"), ("p", "b1", "pending"))
    out = diff.handler_diff(s("b1_init"), s(), "p", "n", s(), s(), s(), s(), s(), book)
    assert rows(out, "class") == [("triaged",)]


def test_references_beyond_definitions(frame, rows):
    lines = frame("f string, line string", ("a", "def x(): y()"), ("a", "def y(): x"), ("a", "def z(): xx"), ("b", "z"))
    names = frame("f string, n string", ("a", "x"), ("a", "y"), ("a", "z"))
    assert rows(diff.reference_counts(lines, names, "f", "n")) == [("a", "x"), ("a", "y")]


def test_multiset_and_list_deltas_keep_repeats(frame, rows):
    a = frame("k int, i string", (1, "x"), (1, "x"), (1, "y"), (2, "q"), (3, "m"))
    b = frame("k int, i string", (1, "y"), (1, "z"), (1, "z"), (3, "m"), (4, "w"))
    assert rows(diff.multiset_deficit(a, b, ["i"])) == [("q", 1, 0), ("x", 2, 0)]
    assert rows(diff.item_list_delta(a, b, "k", "i")) == [(1, "x", "missing", 2), (1, "z", "extra", 2)]


def test_property_delta_rules(frame, rows):
    schema = "k string, checked boolean, minimum int, text string"
    a = frame(schema, ("c", None, 1, "a"), ("d", True, None, "b"), ("e", None, 5, "c"))
    b = frame(schema, ("c", False, None, "zzz"), ("d", None, None, "b"), ("e", None, 6, "c"))
    accepted = frame("key_property string", ("e.minimum",))
    out = diff.property_delta(a, b, "k", ["checked", "minimum", "text"], ("checked",), ("text",), accepted)
    assert rows(out) == [("c", "minimum", "1", None), ("d", "checked", "true", "false")]


def test_sides_and_extras(frame, rows):
    a, b = frame("k string", ("x",), ("y",)), frame("k string", ("y",), ("z",), ("r",))
    assert rows(diff.side_extras(a, b, "k", frame("to string", ("r",), (None,)))) == [("z",)]
    assert rows(diff.side_lists(a, b, ["k"])) == [("r", "b_only"), ("x", "a_only"), ("y", "both"), ("z", "b_only")]


def test_three_way_merge(frame, rows):
    base = kv(frame, ("s", "0"), ("l", "0"), ("r", "0"), ("c", "0"), ("p", "0"), ("dl", "0"), ("dr", "0"), ("dc", "0"), ("e", "0"))
    left = kv(frame, ("s", "0"), ("l", "1"), ("r", "0"), ("c", "1"), ("p", "1"), ("dr", "0"), ("dc", "9"), ("e", ""), ("new", "n"))
    right = kv(frame, ("s", "0"), ("l", "0"), ("r", "2"), ("c", "2"), ("p", "2"), ("dl", "0"), ("e", "0"), ("new", "n"))
    out = diff.three_way_merge(base, left, right, "k", "v", frame("k string", ("p",)))
    assert rows(out) == [
        ("c", None, "conflict", "failed"), ("dc", None, "conflict", "failed"), ("e", "", "left", "refused"), ("l", "1", "left", "ok"),
        ("new", "n", "same", "ok"), ("p", "2", "conflict_right", "ok"), ("r", "2", "right", "ok"), ("s", "0", "same", "ok"),
    ]


def test_ahead_behind_and_added_lines(frame, rows):
    a, b = frame("r string, c int", ("x", 1), ("x", 2), ("y", 1)), frame("r string, c int", ("x", 2), ("x", 3), ("x", 4), ("y", 1))
    assert rows(diff.ahead_behind(a, b, "r", "c")) == [("x", 1, 2), ("y", 0, 0)]
    schema = "d int, line_no long, line string"
    old = frame(schema, (1, 1, "a"), (1, 2, "b"))
    new = frame(schema, (1, 1, "b"), (1, 2, "a"), (1, 3, "a"), (1, 4, "c"), (2, 1, "n"))
    added = diff.added_lines(old, new, ["d"])
    assert rows(added) == [(1, 3, "a"), (1, 4, "c"), (2, 1, "n")]
    assert rows(diff.join_lines(added, ["d"], "t")) == [(1, "a\nc"), (2, "n")]


def test_staleness_ignores_cosmetics_and_an_empty_run_fails(frame, rows):
    text = "# API\n_Generated: 2024-01-01_\n[x](a.py#L10)\n"
    fresh = frame("f string, t string", ("same", text), ("moved", text), ("real", text), ("missing", text), ("other", text))
    committed = frame(
        "f string, t string",
        ("same", text), ("moved", text.replace("L10", "L13").replace("-01_", "-02_")), ("real", text.replace("API", "API2")), ("extra", "x"), ("other", "x"),
    )
    states = diff.staleness_gate(committed, fresh, "f", "t", gated=F.col("f") != "other")
    assert rows(states) == [("missing", "missing"), ("moved", "fresh"), ("real", "stale"), ("same", "fresh")]
    assert tuple(diff.scoped_gate(states).first()) == (4, 2, "FAIL")
    assert diff.scoped_gate(states.limit(0)).first().verdict == "FAIL"
    assert diff.scoped_gate(states.where("state = 'fresh'")).first().verdict == "OK"


def test_mirrors_ignore_newline_form(frame, rows):
    mirrors = frame("g string, t string, m string", ("a", "x\r\ny", "m1"), ("a", "x\rz", "m2"), ("a", None, "m3"), ("nosource", "x", "m4"))
    sources = frame("g string, t string", ("a", "x\ny"))
    assert rows(diff.mirror_drift(mirrors, sources, "g", "t", "m")) == [("a", "m1", "agree"), ("a", "m2", "drift"), ("a", "m3", "missing")]


def test_ledger_triage_and_conflicts(frame, rows):
    book = ledger.ledger_dataset(
        {
            "controls": frame("pair string, key string, status string, to string, reason string", ("p", "a", "pending", "", "later"), ("p", "b", "renamed", "bb", "moved")),
            "panels": frame("pair string, key string, reason string", ("p", "c", "by design"), ("p", "c", "twice")),
        }
    )
    assert rows(ledger.ledger_conflicts(book)) == [("panels", "p", "c", 2)]
    deltas = frame("pair string, k1 string, k2 string", ("p", "a", "x"), ("p", "zz", "b"), ("p", "c", "a"), ("p", "n", "n"), ("q", "a", "a"))
    out = ledger.ledger_triage(deltas, book, ["pair", "k1"], ["pair", "k2"])
    assert rows(out, "pair", "k1", "bucket", "detail") == [
        ("p", "a", "pending", "[pending] later"), ("p", "c", "triaged", "[na] by design"), ("p", "n", "untriaged", None),
        ("p", "zz", "triaged", "[renamed -> bb] moved"), ("q", "a", "untriaged", None),
    ]


def test_status_summary(frame, rows):
    df = frame("p string, c string", ("x", "untriaged"), ("x", "pending"), ("y", "pending"), ("z", "triaged"))
    out = ledger.status_summary(df, "p", "c", ["untriaged", "pending", "triaged"], "untriaged", "pending")
    assert rows(out, "p", "status") == [("x", "GAP"), ("y", "open"), ("z", "OK")]
    assert ledger.sweep_verdict(out).first().verdict == "FAIL"
    assert ledger.sweep_verdict(out.where("status <> 'GAP'")).first().verdict == "OK"
