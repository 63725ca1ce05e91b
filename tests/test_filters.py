"""Filters, budgets and rules: each finding kind fires, and stays quiet on clean input."""

from pyspark.sql import functions as F

from corpuswarden.operators import filters as ops


def test_public_names(frame, rows):
    df = frame("n string, k string", ("a", "method"), ("_a", "method"), ("Ui_Form", "class"), ("p", "setter"), ("q", None))
    assert rows(ops.public_filter(df, "n", "k"), "n") == [("a",), ("q",)]


def test_boundary_classes(frame, rows):
    df = frame(
        "t string",
        ("https://x/y.md",), ("mailto:a@b",), ("#top",), ("",), ("../../up.md",), ("../ok.md#s",), ("/abs.md",), (" c.md ",),
    )
    got = dict(rows(df.select("t", ops.boundary_class(F.col("t"), F.lit("docs")).alias("c"))))
    assert got == {
        "https://x/y.md": "external", "mailto:a@b": "external", "#top": "anchor", "": "empty",
        "../../up.md": "escapes", "../ok.md#s": "inside", "/abs.md": "escapes", " c.md ": "inside",
    }
    links = df.withColumn("base", F.lit("docs"))
    assert rows(ops.boundary_filter(links, "t", "base"), "resolved") == [("docs/c.md",), ("ok.md",)]


def test_exempt_by_name_part_and_segment(frame, rows):
    df = frame("repo string, path string", ("r", "a/README.md"), ("r", "archive/x.md"), ("r", "archives/x.md"), ("r", "a/API_X.md"), ("r", "g.md"), ("s", "g.md"))
    out = ops.exempt_filter(
        df, "path", generated=frame("repo string, path string", ("r", "g.md")), names=("readme.md",), name_parts=("api_",), segments=("archive",)
    )
    assert rows(out, "repo", "path") == [("r", "archives/x.md"), ("s", "g.md")]


def test_allowlist_exact_and_wildcard(frame, rows):
    df = frame("p string, f string", ("a", "x"), ("a", "y"), ("b", "x"), ("c", "x"))
    allow = frame("path string, function string, reason string", ("a", "x", "why"), ("a", "x", "again"), ("b", "*", "why"))
    assert rows(ops.allowlist_filter(df, allow, "p", "f")) == [("a", "y"), ("c", "x")]


def test_globs_hit_base_name_or_whole_path(frame, rows):
    df = frame("path string", ("docs/API_REGISTRY.md",), ("docs/internal.md",), ("x/internal.md",), ("keep.md",))
    assert rows(ops.glob_match(df, "path", ["API_*.md", "docs/internal.md"])) == [("keep.md",), ("x/internal.md",)]
    assert ops.glob_match(df, "path", []).count() == 4


def test_byte_and_char_budgets(frame, rows):
    df = frame("i int, s string", (1, "é" * 60), (2, "e" * 60), (3, "e" * 101), (4, "e" * 95), (5, ""))
    out = ops.size_budget(df, F.octet_length("s"), F.lit(80), F.lit(100))
    assert rows(out, "i", "size", "status", "over") == [
        (1, 120, "FAIL", 20), (2, 60, "OK", 0), (3, 101, "FAIL", 1), (4, 95, "WARN", 15), (5, 0, "WARN", 0)
    ]
    lines = frame("d int, line string", (1, "é" * 60), (1, "e" * 61), (2, "x"))
    assert rows(ops.entry_budget(lines, ["d"], 60)) == [(1, 1, 61), (2, 0, 1)]


def test_undecidable_rule_is_broken(frame, rows):
    df = frame("i int, status string, day string", (1, "current", "2024-01-01"), (2, None, "x"), (3, "stub", "-"))
    out = ops.field_rules(
        df, ["i"], {"status": ~F.col("status").isin("current", "stub"), "day": (F.col("status") == "current") & ~F.col("day").rlike(r"^\d{4}-\d{2}-\d{2}$")}
    )
    assert rows(out) == [(2, "day"), (2, "status")]


def test_markers_and_headings(frame, rows):
    df = frame(
        "i int, s string",
        (1, "a\n<<<<<<< HEAD\nb"), (2, "see <<<<<<< HEAD"), (3, "## [unreleased]"), (4, "### [Unreleased]"), (5, "about ## [Unreleased]"), (6, "x\n##[Unreleased] - now"),
    )
    assert rows(ops.conflict_marker_scan(df, "s", ["i"])) == [(1, "<<<<<<< HEAD")]
    assert rows(ops.forbidden_heading(df, "s", ["i"])) == [(3,), (6,)]


def test_recent_changes(frame, rows):
    minutes = [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 14, 15, 20]
    data = [("r", f"f{m:02d}", m) for m in minutes] + [("r", "API_INDEX.md", 0), ("r", "old.py -> new.py", 13), ("q", "late", 15)]
    df = frame("repo string, path string, m int", *data).withColumn(
        "ts", F.timestamp_seconds(F.lit(1_700_000_000) - F.col("m") * 60)
    )
    out = ops.recent_changes(df, "repo", "path", "ts", 15, F.timestamp_seconds(F.lit(1_700_000_000)), k=8)
    got = rows(out, "repo", "rank", "path", "rest")
    assert [g[2] for g in got] == [f"f0{i}" for i in range(8)]
    assert {g[3] for g in got} == {4}  # 8, 9 and 14 minutes, and the renamed file; 15 is not within


def log(frame, *texts):
    data = [(i, n, line) for i, t in enumerate(texts) for n, line in enumerate(t.split("\n"), 1)]
    return ops.log_verdict(
        frame("job int, line_no long, line string", *data), ["job"],
        r"^\s*(copying|writing)", "error|failed", "Permission denied", r":\s*PASSED",
    )


def test_log_verdicts(frame, rows):
    out = log(
        frame,
        "copying error.py\nx: PASSED", "x: PASSED\nfailed: a\nerror: b", "error: Permission denied\nx: PASSED", "all quiet", "copying Permission denied\nfailed\nx: PASSED",
    )
    assert rows(out, "job", "verdict", "first_hit") == [
        (0, "ok", None), (1, "failed", "failed: a"), (2, "retry", "error: Permission denied"), (3, "failed", "no passing line"), (4, "failed", "failed"),
    ]


def test_property_violations_skip_unreadable_numbers(frame, rows):
    good = {"orientation": "Qt::Vertical", "sizeType": "QSizePolicy::Fixed", "height": "40"}
    df = frame(
        "i int, p map<string,string>",
        (1, good), (2, {**good, "height": "4"}), (3, {**good, "height": "tall"}), (4, {**good, "orientation": "Qt::Horizontal"}), (5, {"height": "99"}),
    )
    assert rows(ops.element_property_violations(df, "p", 16), "i", "value") == [(1, 40)]


def test_name_patterns_differ(frame, rows):
    df = frame("n string", ("tb000",), ("tb00",), ("tb000_init",), ("zz12",), ("Tb000",), ("txt5x",), ("w12",))
    got = dict(rows(df.select("n", ops.name_class(F.col("n"), ops.HANDLER_PATTERNS))))
    assert got == {"tb000": "widget", "tb00": "audit", "tb000_init": "widget", "zz12": "other", "Tb000": "other", "txt5x": "domain", "w12": "audit"}


def test_summary_chain(frame, rows):
    df = frame(
        "n string, d string, r string, m string",
        ("a", "desc", "# x", "dom"), ("a", " ", "## About", "dom"), ("a", None, "# A", "dom"), ("a", None, None, ""),
    )
    got = [r[0] for r in df.select(ops.entity_summary(F.col("n"), F.col("d"), F.col("r"), F.col("m"))).collect()]
    assert got == ["desc", "About", "Workspace repo aligned with the dom domain.", "Workspace repository."]
