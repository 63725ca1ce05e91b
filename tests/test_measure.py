"""Counts, coverage and collisions."""

from pyspark.sql import functions as F

from corpuswarden.operators import measure
from corpuswarden.operators.gate import audit_rule, gate_verdict, run_rules


def test_inventory_total_and_flags(frame, rows):
    df = frame("repo string, n_lines long, n_nonempty long, d string", ("a", 10, 8, "tests"), ("a", 5, 5, "src"), ("b", 1, 0, "src"))
    out = measure.inventory_rollup(df, "repo", {"has_tests": F.col("d") == "tests"})
    assert rows(out) == [("TOTAL", 3, 16, 13, True), ("a", 2, 15, 13, True), ("b", 1, 1, 0, False)]


def test_module_tree(frame, rows):
    paths = ["__init__.py", "a.py", "b.txt", "sub/__init__.py", "sub/c.py", "nopkg/d.py", "sub/deep/__init__.py", "sub/deep/e.py"]
    out = measure.module_tree_counts(frame("r string, p string", *[("x", p) for p in paths]), "r", "p", "__init__.py", ".py")
    assert rows(out) == [("x", 1, 1, 4)]


def test_dominant_values_break_ties_by_value(frame, rows):
    df = frame("g string, v string", *[("g", v) for v in "cabbaadefg"])
    assert [r[2] for r in rows(measure.dominant_values(df, "g", "v"))] == ["a (3)", "b (2)", "c (1)", "d (1)", "e (1)"]


def test_groups_without_content_drop_out(frame, rows):
    df = frame("g string, n int", ("known", 5), ("x", 0), ("y", 1), ("y", 2), ("z", None))
    assert rows(measure.non_repo_folders(df, "g", ["known"], {"n": F.col("n")})) == [("y", 3)]


def test_collisions(frame, rows):
    df = frame("name string, grp string", ("one", "a"), ("one", "a"), ("pair", "m"), ("pair", "b"), ("pair", "m"), ("three", "m"), ("three", "b"), ("three", "p"), ("other", "m"), ("other", "p"))
    hits = measure.cross_group_collisions(df, "name", "grp", ("m", "b"))
    out = measure.collision_occurrences(df, hits, "name")
    assert rows(out.select("name", "n_groups", "n_rows", "kind").distinct()) == [
        ("other", 2, 2, "genuine"), ("pair", 2, 3, "intended"), ("three", 3, 3, "genuine")
    ]
    assert out.where("name = 'pair'").count() == 3


def test_total_coverage_counts_a_name_once(frame, rows):
    a = frame("m string, n string", ("x", "f"), ("y", "f"), ("x", "g"), ("z", "h"))
    b = frame("m string, n string", ("x", "f"), ("w", "g"))
    assert rows(measure.name_coverage(a, b, "m", "n")) == [
        ("TOTAL", True, 3, 2, 2, 67, False), ("w", False, 0, 1, 0, None, False), ("x", False, 2, 1, 1, 50, False), ("y", False, 1, 0, 0, 0, True), ("z", False, 1, 0, 0, 0, True)
    ]


def test_domain_coverage(frame, rows):
    items = frame("d string, w string", ("edit", "b1"), ("edit", "b2"), ("uv", "c1"))
    handlers = frame("d string, w string, provider string", ("edit", "b1", "m"), ("edit", "b2_init", "m"), ("uv", "c1", "m"), ("edit", "b1", "n"), ("uv", "b1", "m"))
    flagged = measure.handled_items(items, handlers, "d", "w", ["m", "n"])
    assert rows(measure.domain_coverage(flagged, handlers, "d", ["m", "n"])) == [
        ("TOTAL", "m", 3, 3, 0, 100), ("TOTAL", "n", 3, 1, 2, 33), ("edit", "m", 2, 2, 0, 100), ("edit", "n", 2, 1, 1, 50), ("uv", "m", 1, 1, 0, 100), ("uv", "n", 1, 0, 1, None)
    ]
    assert rows(measure.domain_missing(flagged, "d", "w", "n")) == [("edit", "b2"), ("uv", "c1")]


def test_depth_ratio_of_an_empty_side_is_null(frame, rows):
    a, b = frame("k string, n long", ("x", 8), ("y", 0), ("z", 4)), frame("k string, n long", ("x", 1), ("y", 3), ("z", 5), ("w", 1))
    assert rows(measure.depth_ratio(a, b, "k", ["n"]), "k", "pct_n", "shallow") == [("x", 12, True), ("y", None, False), ("z", 125, False)]


def test_text_metrics(frame, rows):
    df = frame("i int, s string", (1, "x.add(a)\nx.add('Separator')\n"), (2, ""))
    out = measure.text_metrics(df, "s", ["i"], r"\.add\(", r"\.add\(\s*[\"']Separator", "Sep")
    assert rows(out) == [(1, 1, 3, True), (2, 0, 1, False)]


def test_marker_census(frame, rows):
    docs = frame("k string, n_markers long", ("a", 2), ("b", 0), ("c", 0), ("d", 1), ("unlisted", 9))
    status = frame("k string, status string", ("a", "current"), ("b", "stub"), ("c", "current"), ("d", "stub"))
    assert rows(measure.marker_census(docs, status, "k"), "k", "finding") == [("a", "FAIL"), ("b", "WARN"), ("c", "OK"), ("d", "OK")]


def test_first_and_last_win(frame, rows):
    df = frame("k string, o int, v string, w string", ("a", 1, "first", None), ("a", 2, None, "mid"), ("a", 3, "last", None))
    assert rows(measure.merge_by_key(df, ["k"], ["o"], ["v", "w"])) == [("a", "first", "mid")]
    assert rows(measure.merge_by_key(df, ["k"], ["o"], ["v", "w"], last=True)) == [("a", "last", "mid")]


def test_tally_wording_and_publication(frame, rows):
    r = lambda repo, *o: [(repo, x, m) for x, m in o]
    df = frame(
        "repo string, outcome string, module string",
        *r("green", ("pass", "m1"), ("skipped", "m2")), *r("mixed", ("pass", "m1"), ("failure", "m2"), ("error", "m2")),
        *r("red", ("error", "m1")), *r("skipped", ("skipped", "m1"), ("skipped", "m2")), *r("partial", ("pass", "m1"), ("standin", "m2")),
    )
    got = rows(measure.test_tally(df, "repo", "outcome", "module", ["m1", "m2"]), "repo", "passed", "failed", "message", "colour", "publish")
    assert got == [
        ("green", 1, 0, "1 passed", "brightgreen", True), ("mixed", 1, 2, "1 passed, 2 failed", "orange", True),
        ("partial", 1, 0, "1 passed", "brightgreen", False), ("red", 0, 1, "1 failed", "red", False), ("skipped", 0, 0, "0 passed", "lightgrey", False),
    ]


def test_set_relation(frame, rows):
    df = frame("g int, m string", (1, "a"), (1, "b"), (1, "a"), (2, "a"), (3, "a"), (3, "b"), (3, "c"))
    assert rows(measure.set_relation(df, ["g"], "m", ["a", "b"])) == [(1, 2, True, True), (2, 1, False, False), (3, 3, True, False)]


def rule(severity, *keys):
    def run(tables):
        base = tables["t"]
        return base.select(F.lit(severity).alias("severity"), F.col("k").alias("key"), F.lit("d").alias("detail")).where(F.col("k").isin(*keys))

    return run


def test_gate(frame, rows, spark):
    tables = {"t": frame("k int", (1,), (2,), (3,))}
    rules = {
        "late": rule("FAIL", 1), "early": rule("FAIL", 2, 3), "warns": rule("WARN", 1), "clean": rule("FAIL", 99),
        "absent": lambda t: t["nowhere"], "broken": lambda t: t["t"].select("no_such_column"),
    }
    found = run_rules(rules, tables, spark)
    out = gate_verdict(found, ["early", "late", "warns", "clean", "absent", "broken", "never_ran"])
    got = {r.check: (r.n_fail, r.n_warn, r.n_skip, r.verdict, r.alert) for r in out.collect()}
    assert got["ALL"] == (3, 1, 2, "FAIL", "early")
    assert got["warns"][3] == "WARN" and got["clean"][3] == "OK" and got["never_ran"] == (0, 0, 0, "OK", None)
    assert got["absent"][2:4] == (1, "WARN") and got["broken"][2:4] == (1, "WARN")
    quiet = {r.check: r.verdict for r in gate_verdict(audit_rule("warns", rules["warns"], tables, spark), ["warns"]).collect()}
    assert quiet["ALL"] == "WARN"
    strict = {r.check: r.verdict for r in gate_verdict(audit_rule("warns", rules["warns"], tables, spark), ["warns"], strict=("warns",)).collect()}
    assert strict["ALL"] == "FAIL"
