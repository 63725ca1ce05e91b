"""File scans, catalogs, receipts and sinks."""

import json
from datetime import datetime

from pyspark.sql import functions as F

from corpuswarden.session import fresh_path
from corpuswarden.operators import integrity
from corpuswarden.sources import scans, sinks


def test_file_scan_prunes_whole_segments(spark, rows, tmp_path):
    for name, body in {"a.py": "x\n", "src/b.py": "y", "build/c.py": "z", "builder/d.py": "w", "e.txt": "t", "src/skip.py": "s"}.items():
        target = tmp_path / name
        target.parent.mkdir(exist_ok=True)
        target.write_text(body)
    files = scans.read_corpus(spark, str(tmp_path), "*.py").withColumn("rel", F.regexp_replace("path", f"^file:{tmp_path}/", ""))
    kept = scans.corpus_scan(files, "rel", [".py"], ["build"], ["skip.py"])
    assert rows(kept, "rel", "length") == [("a.py", 2), ("builder/d.py", 1), ("src/b.py", 1)]


def test_catalog_defaults(frame, rows):
    doc = {
        "name": "pkg",
        "modules": [
            {"relpath": "m.py", "functions": [{"name": "f", "signature": "(a)"}], "classes": [{"name": "C", "members": [{"name": "x", "kind": "property", "line": 4}]}]},
            {"functions": [{"name": "g", "deprecated": True}]},
            {"relpath": "empty.py"},
        ],
    }
    out = scans.registry_scan(frame("j string", (json.dumps(doc),), ("{}",), ("not json",)), "j")
    assert rows(out, "package", "module", "owner", "name", "kind", "signature", "line", "deprecated") == [
        ("pkg", "", "", "g", "function", "", 0, True), ("pkg", "m.py", "", "C", "class", "(class)", 0, False),
        ("pkg", "m.py", "", "f", "function", "(a)", 0, False), ("pkg", "m.py", "C", "x", "property", "", 4, False),
    ]
    assert ("m.py::C", "(class)") in rows(scans.flat_signatures(out))


def test_table_rows_count_only_in_their_section(frame, rows):
    lines = ["# T", "| a | b |", "## Ledger", "| n | r |", "|---|:-:|", "| [x](x.md) | guide |", "text", "## Other", "| y | z |"]
    df = frame("d int, line_no long, line string", *[(1, i, x) for i, x in enumerate(lines, 1)])
    out = scans.pipe_table_scan(df, ["d"], "|", section="Ledger")
    assert rows(out, "line_no", "cells") == [(4, ["n", "r"]), (6, ["[x](x.md)", "guide"])]


def test_named_elements_from_xml(spark, rows, tmp_path):
    (tmp_path / "a.ui").write_text(
        '<ui><widget class="QLabel" name="l1"><property name="text"><string>hi</string></property><property name="x"><number>3</number></property></widget>'
        '<widget class="QFrame"></widget><widget class="QSpinBox" name="s1"><property name="maximum"><number>9</number></property></widget></ui>'
    )
    out = scans.named_elements(spark, str(tmp_path), "widget", ["text", "maximum"])
    assert rows(out.select("name", "class", F.to_json("props"))) == [("l1", "QLabel", '{"text":"hi"}'), ("s1", "QSpinBox", '{"maximum":"9"}')]


def test_requirement_names_once_per_owner(frame, rows):
    df = frame("o string, r string", ("a", "My_Pkg>=1"), ("a", "my-pkg[x]"), ("a", "other"), ("b", "MY-PKG"))
    assert rows(scans.requirement_names(df, "o", "r", ["My-Pkg"])) == [("a", "my-pkg"), ("b", "my-pkg")]


def test_baseline_label(frame, rows):
    ids = frame("k string", ("both",), ("late",), ("none",))
    snaps = frame("k string, t int, v string", ("both", 1, "old"), ("both", 5, "cut"), ("both", 6, "new"), ("late", 9, "z"), ("late", 7, "y"))
    assert rows(scans.baseline_resolve(ids, snaps, "k", "t", "v", F.lit(5))) == [("both", "cut", "released"), ("late", "y", "refresh"), ("none", None, "none")]


def test_receipts_fold_and_scan_back(frame, rows):
    t = [datetime(2024, 1, d) for d in (1, 2, 3)]
    df = frame("k string, c string, ts timestamp", ("p@1", "tests", t[0]), ("p@1", "tests", t[2]), ("p@1", "review", t[1]), ("q@2", "tests", t[0]))
    folded = scans.receipt_map_fold(df, "k", "c", "ts")
    assert rows(scans.receipt_map_scan(folded, "k", "payload")) == [("p@1", "review", t[1]), ("p@1", "tests", t[2]), ("q@2", "tests", t[0])]
    odd = frame("k string, payload string", ("a", "not json"), ("b", '{"tests": "soon", "review": "2024-01-02T00:00:00"}'), ("c", "{}"))
    assert rows(scans.receipt_map_scan(odd, "k", "payload"), "k", "check") == [("b", "review")]


def test_aliased_calls(frame, rows):
    aliases = frame("f string, alias string, function string", ("a", "t", "mkdtemp"), ("a", "t", "mkdtemp"), ("b", "n", "named"))
    calls = frame("f string, alias string, line int, has_keyword boolean", ("a", "t", 1, False), ("b", "t", 2, False), ("b", "n", 3, False), ("b", "n", 4, True))
    out = scans.alias_hits(aliases, calls, "f", "alias", keyword_needed=["named"])
    assert rows(out, "f", "line") == [("a", 1), ("b", 4)]


def test_second_write_writes_nothing(spark, frame):
    path = fresh_path(spark, "artifacts")
    art = frame("name string, content string", ("a", "1"), ("b", "2"))
    digest = F.sha2("content", 256)
    assert sinks.write_if_changed(art, "name", digest, path) == 2
    assert sinks.write_if_changed(art, "name", digest, path) == 0
    changed = frame("name string, content string", ("a", "1"), ("b", "3"), ("c", "4"))
    assert sinks.write_if_changed(changed, "name", digest, path) == 2
    assert sorted((r.name, r.content) for r in spark.read.parquet(path).collect()) == [("a", "1"), ("b", "3"), ("c", "4")]


def test_group_digest_ignores_order_but_not_content(frame):
    a = frame("g string, v string", ("x", "1"), ("x", "2"), ("y", "1"))
    b = frame("g string, v string", ("x", "2"), ("y", "1"), ("x", "1"))
    c = frame("g string, v string", ("x", "2"), ("y", "1"), ("x", "3"))
    one, two, three = ({r.g: r.digest for r in sinks.group_digest(d, ["g"], F.col("v")).collect()} for d in (a, b, c))
    assert one == two and one["x"] != three["x"] and one["y"] == three["y"]


def test_sidecar_splits_a_large_group(frame, rows):
    df = frame("g string, v int", *[("hot", i) for i in range(90)], ("b", 1))
    out = sinks.json_sidecar(df, "g", F.struct("v"), F.col("v"), chunk=10)
    docs = [json.loads(r.payload) for r in out.collect()]
    hot = [d for d in docs if d["g"] == "hot"]
    assert {d["n_items"] for d in hot} == {90} and hot[0]["parts"] == 9 and len(hot) > 5
    assert sorted(i["v"] for d in hot for i in d["items"]) == list(range(90))


def test_report_and_run_log(spark, frame, rows):
    df = frame("g string, k int", ("a", 2), ("a", 1), ("b", 5))
    lines = sinks.report_lines(df, "g", ["k"], F.concat(F.lit("- "), F.col("k").cast("string")), F.concat(F.lit("## "), "g", F.lit(" "), F.col("n_rows").cast("string")))
    assert rows(lines) == [("a", 1, "## a 2"), ("a", 2, "- 1"), ("a", 3, "- 2"), ("b", 1, "## b 1"), ("b", 2, "- 5")]
    out = fresh_path(spark, "report")
    sinks.write_report(lines, "g", out)
    assert sorted(r.value for r in spark.read.text(out).where("g = 'a'").collect()) == ["## a 2", "- 1", "- 2"]
    log = fresh_path(spark, "log")
    found = frame("check string, severity string, key string, detail string", ("c", "FAIL", "k", "d"))
    for run in ("r1", "r2"):
        sinks.run_log_append(found, log, run, F.to_timestamp(F.lit("2024-01-01 00:00:00")))
    assert rows(sinks.read_run_log(spark, log), "run_id", "check") == [("r1", "c"), ("r2", "c")]


SOURCE = """import os, tempfile as tf; import json
from tempfile import (
    mkdtemp as mk,  # one
    NamedTemporaryFile,
)
x = tf.mkdtemp()
class A:
    def one(self, a=mk()):
        "tf.mkdtemp()"
        def two():
            return mk(
                suffix=")",
            )
        # mk()
        y = NamedTemporaryFile(
            mode="w",
            delete=False)
        z = NamedTemporaryFile(delete=True) + NamedTemporaryFile()
    async def three(self): return tf.mkstemp()
    w = other.tf.mkdtemp(), mkdtemp(), tf.gettempdir()
"""


def test_calls_are_resolved_by_import_and_scope(spark, frame, rows):
    texts = frame("f string, text string", ("a.py", SOURCE), ("b.py", "def f():\n\tx = mk()\n\ty = tf.mkdtemp()\n"), ("c.py", "import tempfile\ntempfile.mkdtemp()"), ("d.py", ""), (None, None))
    lines = scans.line_scan(texts, "text", ["f"], "file")
    out = scans.aliased_call_scan(lines, ["f"], "tempfile", ["mkdtemp", "mkstemp"], {"NamedTemporaryFile": ("delete", ["True", "1"])})
    assert sorted(rows(out, "f", "line_no", "label", "function", "scope"), key=lambda r: r[:2]) == [
        ("a.py", 6, "tf.mkdtemp", "mkdtemp", None),
        ("a.py", 8, "mk", "mkdtemp", "one"),
        ("a.py", 11, "mk", "mkdtemp", "two"),
        ("a.py", 15, "NamedTemporaryFile", "NamedTemporaryFile", "one"),
        ("a.py", 19, "tf.mkstemp", "mkstemp", "three"),
        ("c.py", 2, "tempfile.mkdtemp", "mkdtemp", None),
    ]


def test_line_references_out_of_text(spark, frame, rows):
    text = (
        "[a](b.py#L1) and [é b](../x/./c.py#L2-L30), [a](b.py#L1)\n[u](https://h/b.py#L9) [abs](/b.py#L9) [up](../../b.py#L9)\n"
        "[q](b.py?x#L1) [no](b.md#L1) [big](b.py#L99999999999999999999) [zero](b.py#L0007-L0003)"
    )
    docs = frame("path string, text string", ("d/n.md", text), ("n.md", "[r](d/b.py#L4)"), ("e.md", None), ("f.md", ""))
    refs = scans.line_reference_scan(scans.line_scan(docs, "text", ["path"], "file"), "path")
    assert sorted(rows(refs, "path", "line_no", "offset", "target", "start", "end")) == sorted([
        ("d/n.md", 1, 1, "d/b.py", 1, None), ("d/n.md", 1, 18, "x/c.py", 2, 30), ("d/n.md", 1, 45, "d/b.py", 1, None),
        ("d/n.md", 3, 30, "d/b.py", 10**18, None), ("d/n.md", 3, 64, "d/b.py", 7, 3), ("n.md", 1, 1, "d/b.py", 4, None),
    ])
    files = frame("path string, text string", ("d/b.py", "1\n2\n3\n4\n"), ("z.py", None))
    out = integrity.line_ref_audit(docs, files, "path", "text")
    assert sorted(rows(out, "path", "target", "issue", "bad_line", "n_lines"), key=repr) == sorted([
        ("d/n.md", "x/c.py", "not_found", None, None), ("d/n.md", "d/b.py", "out_of_range", 10**18, 4), ("d/n.md", "d/b.py", "out_of_range", 7, 4),
    ], key=repr)


def test_line_references_are_taken_apart_once(frame):
    lines = frame("doc string, line_no long, line string", ("d/n.md", 1, "[a](../b.py#L1)"))
    refs = scans.line_reference_scan(lines, "doc")
    # as the join of an audit asks for it: filters on the result must not compute paths and patterns anew
    plan = refs.where("target <> 'x'")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(split(") == 1 and plan.count("regexp_extract(") == 0 and plan.count("regexp_extract_all(") == 1
    assert [tuple(r) for r in refs.collect()] == [("d/n.md", 1, 1, "[a](../b.py#L1)", "b.py", 1, None)]
