"""Links, anchors, orphans, ledgers, rules, declarations, hubs and pairs."""

from pyspark.sql import functions as F

from corpuswarden.operators import integrity as ops
from corpuswarden.sources import scans


def test_link_forms(frame, rows):
    df = frame("i int, s string", (1, '[a](x.md) [![b](i.svg)](y.md#Top "t") [c](z.md "title") (not.md) [d](e f.md)'))
    out = scans.link_scan(df, "s", ["i"], scans.MARKDOWN_LINK)
    assert rows(out, "target_path", "fragment") == [("x.md", ""), ("y.md", "Top"), ("z.md", "")]


def test_anchor_is_case_sensitive_and_line_fragments_pass(frame, rows):
    anchors = frame("doc string, anchor string", ("a", "backlog"), ("a", "backlog-1"))
    links = frame("dest string, fragment string", ("a", "backlog"), ("a", "Backlog"), ("a", "L12"), ("a", ""), ("b", "backlog"), ("a", "backlog-1"))
    assert rows(ops.anchor_check(links, anchors, "dest", "fragment")) == [("a", "Backlog"), ("b", "backlog")]


def test_line_refs(frame, rows):
    refs = frame("target string, start int, end int", ("a", 3, None), ("a", 4, None), ("a", 2, 5), ("a", 5, 2), ("b", 1, None))
    out = ops.line_ref_range(refs, frame("target string, n_lines long", ("a", 3)), "target")
    assert rows(out, "start", "issue", "bad_line") == [(1, "not_found", None), (2, "out_of_range", 5), (4, "out_of_range", 4), (5, "out_of_range", 5)]


def test_orphans(frame, rows):
    catalog = frame("k string, gen boolean", ("a", False), ("b", False), ("self", False), ("g", True), ("readme", False))
    edges = frame("src string, dst string", ("g", "a"), ("self", "self"))
    out = ops.orphans(catalog, edges, "k", F.col("gen"), F.col("k") == "readme")
    assert rows(out, "k") == [("b",), ("self",)]


def test_linked_untracked(frame, rows):
    edges = frame("repo string, src string, dst string", *[("r", s, "Doc.md") for s in "dcba"], ("r", "a", "Kept.MD"), ("r", "x.md", "x.md"), ("nogit", "a", "y.md"))
    tracked = frame("repo string, path string", ("r", "kept.md"))
    out = ops.linked_untracked(edges, tracked, tracked.select("repo"))
    assert rows(out) == [("r", "Doc.md", ["a", "b", "c"])]


def test_ledger_sync_both_ways(frame, rows):
    p = lambda *x: frame("path string", *[(v,) for v in x])
    out = ops.ledger_sync(p("docs/a.md", "docs/gone.md"), p("docs/a.md", "docs/new.md", "docs/API_X.md"), p("docs/a.md", "docs/zz.md", None), "path", "API_")
    assert rows(out) == [("docs/gone.md", "no_file"), ("docs/new.md", "no_ledger_row"), ("docs/zz.md", "rule_without_row")]


def test_longest_prefix_rule(frame, rows):
    rules = frame("rule string, rule_order int", ("core/", 0), ("core/io/", 1), ("core/io/x.py", 2), ("core", 3), ("stale/", 4), ("core/i", 5))
    keys = frame("m string", ("core/io/x.py",), ("core/io/y.py",), ("core/z.py",), ("corex.py",), ("core",), ("core/io/y.py",))
    best = ops.longest_prefix_rule(keys, "m", rules)
    assert rows(best) == [
        ("core", "core"), ("core/io/x.py", "core/io/x.py"), ("core/io/y.py", "core/io/"), ("core/z.py", "core/"), ("corex.py", None)
    ]
    assert rows(ops.stale_rules(best, rules)) == [("core/i",), ("stale/",)]


def test_undeclared_files(frame, rows):
    files = frame(
        "package string, path string",
        ("p", "a.py"), ("p", "data/x.json"), ("p", "x.json"), ("p", "data/sub/y.json"), ("p", "a_c.txt"), ("p", "abc.txt"), ("p", "py.typed"), ("free", "junk.bin"),
    )
    declared = frame("package string, subtree string, glob string", ("p", "data", "*.json"), ("p", "", "a_c.txt"))
    out = ops.undeclared_files(files, declared, "package", "path", (".py",), ("py.typed",))
    assert rows(out) == [("p", "abc.txt"), ("p", "x.json")]
    root = frame("path string", ("LICENSE",), ("prof",), ("a.txt",), ("d/prof",))
    assert rows(ops.root_strays(root, "path", ("LICENSE",))) == [("prof",)]


def test_declared_against_named(frame, rows):
    lines = frame(
        "owner string, line string",
        ("a", "**Nav**: x · **Deps**: [A](../Alpha/DOC.md), [b](../beta/DOC.md) · **See also**: [c](../gamma/DOC.md)"),
        ("b", "**Nav**: nothing"), ("b", "**Deps**: [c](../gamma/DOC.md)"),
    )
    named = ops.named_in_segment(lines, "owner")
    assert rows(named) == [("a", "alpha"), ("a", "beta")]
    declared = frame("owner string, name string", ("a", "alpha"), ("a", "gamma"), ("b", "beta"), ("b", "beta"))
    assert rows(ops.declared_vs_named(declared, named, "owner", "name")) == [("a", "gamma"), ("b", "beta")]


def test_hub_coverage(frame, rows):
    n = lambda *x: frame("name string", *[(v,) for v in x])
    hubs = frame("hub string, name string", ("a", "viahub"), ("a", "nofile"), ("viahub", "twohops"), ("offindex", "lost"))
    out = ops.hub_coverage(n("a", "b", "viahub", "twohops", "lost", "offindex"), n("a", "b", "b", "gone"), hubs, "name")
    assert rows(out) == [
        ("b", "duplicate"), ("gone", "broken_index"), ("lost", "orphan"), ("nofile", "broken_hub"), ("offindex", "orphan"), ("twohops", "orphan")
    ]


def test_sync_blocks(frame, rows):
    one = "<!-- sync:x -->\nbody  \n<!-- /sync:x -->"
    df = frame(
        "d string, t string",
        ("a", one), ("b", one.replace("  \n", "\n\n")), ("c", "<!-- sync:y -->1<!-- /sync:y -->"), ("e", "<!-- sync:y -->2<!-- /sync:y -->"),
        ("f", "```\n<!-- sync:x -->\nother\n<!-- /sync:x -->\n```"),
    )
    out = ops.block_consistency(ops.sync_blocks(df, "t", "d"), "name", "body", "d")
    assert rows(out) == [("y", "c", 2), ("y", "e", 2)]


def test_duplicates_and_renames(frame, rows):
    df = frame("o string, k string, n int", ("a", "x", 3), ("a", "x", 1), ("a", "y", 2), ("b", "x", 1))
    assert rows(ops.duplicate_entries(df, "o", "k", "n")) == [("a", "x", 2, 1)]
    book = frame("key string, status string, to string", ("1", "renamed", "here"), ("2", "renamed", "gone"), ("3", "na", "gone"), ("4", "renamed", "two words"), ("5", "renamed", None))
    assert rows(ops.rename_target_check(book, frame("name string", ("here",)), "key", "to"), "key", "to") == [("2", "gone")]


def test_pair_resolution(frame, rows):
    schema = "base string, class string, path string"
    a = frame(schema, ("_scene", "SceneSlots", "a/_scene.py"), ("tool", "ToolSlots", "a/tool.py"), ("solo", "SoloSlots", "a/solo.py"))
    b = frame(schema, ("scene_slots", "SceneSlots", "b/scene_slots.py"), ("tool_slots", "ToolSlots", "b/tool_slots.py"))
    names = frame("name string", ("_scene",), ("scene",), ("tool",), ("Tool",), ("solo",), ("nothing",))
    assert rows(ops.pair_resolution(names, a, b, "name", ("_slots", "Slots"))) == [
        ("Tool", "a/tool.py", "b/tool_slots.py", "OK"),
        ("_scene", "a/_scene.py", "b/scene_slots.py", "OK"),
        ("nothing", None, None, "FAIL"),
        ("scene", "a/_scene.py", "b/scene_slots.py", "OK"),
        ("solo", "a/solo.py", None, "FAIL"),
        ("tool", "a/tool.py", "b/tool_slots.py", "OK"),
    ]


def test_sync_blocks_end_at_their_own_name(frame, rows):
    text = "<!-- sync:a -->x<!-- sync:b -->y<!-- /sync:b -->z<!-- /sync:a -->"
    assert rows(ops.sync_blocks(frame("d string, t string", ("d", text)), "t", "d"), "name", "body") == [("a", "x<!-- sync:b -->y<!-- /sync:b -->z")]
