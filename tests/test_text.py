"""Text, path and version expressions."""

import fnmatch
import posixpath
import re

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpuswarden.functions import markup, paths, text, versions
from corpuswarden.sources import scans


def values(frame, strings, expr):
    return [r[0] for r in frame("i int, s string", *enumerate(strings)).orderBy("i").select(expr).collect()]


@pytest.mark.parametrize(
    "mode,expected",
    [("file", [0, 1, 1, 2, 2, 2, 1, 1]), ("splitlines", [0, 1, 1, 2, 2, 2, 2, 2]), ("newline_count", [1, 1, 2, 3, 2, 1, 1, 1])],
)
def test_three_line_counts(frame, mode, expected):
    texts = ["", "a", "a\n", "a\n\n", "a\r\nb", "a\rb", "a\fb", "a\u2028b"]
    assert values(frame, texts, scans.line_count(F.col("s"), mode)) == expected


def test_splitlines_agrees_with_python(frame):
    texts = ["a\x0bb\x1cc\x85d\n", "\n", "\r\n\r", "x\u2029", "\x1d"]
    assert values(frame, texts, text.split_lines(F.col("s"), "splitlines")) == [t.splitlines() for t in texts]


def test_blank_lines_are_numbered_and_flagged(frame, rows):
    df = scans.line_scan(frame("k int, s string", (1, "a\n \t\n\nb\n"), (2, "")), "s", ["k"], "file")
    assert rows(df) == [(1, 1, "a", True), (1, 2, " \t", False), (1, 3, "", False), (1, 4, "b", True)]


def test_normalize_drops_stamps_and_line_numbers(frame):
    messy = "_Generated: today_\r\nx  \t\r\n[y](z.md#L17)\r"
    got = values(frame, [messy, None], text.normalize_text(F.col("s"), "_Generated:", True))
    assert got == ["x\n[y](z.md#L)\n", None]


def test_digest_of_null_is_null_and_parts_do_not_vanish(frame):
    assert values(frame, [None], text.content_digest(F.col("s"))) == [None]
    a, b = values(frame, ["x", None], text.short_digest(F.lit("p"), F.col("s"), F.lit("q")))
    assert a != b and len(a) == 12


def test_slug(frame):
    got = values(
        frame,
        ["Héllo, Wörld!", "`code` & more", "[Link](x.md) tail", "[![b](c.svg)](d.md)", "a_b-c 1"],
        text.heading_slug(F.col("s")),
    )
    assert got == ["héllo-wörld", "code--more", "link-tail", "bcsvg", "a_b-c-1"]


def test_first_sentence(frame):
    long = "x" * 120
    texts = ["", "  \n\tOne. Two", ". starts; here", "a; b", long, "no end"]
    got = values(frame, texts, text.first_sentence(F.col("s")))
    assert got == ["", "One.", ". starts;", "a;", "x" * 99 + "…", "no end"]


@pytest.mark.parametrize("part,whole", [(1, 8), (3, 8), (5, 8), (1, 200), (3, 200), (1, 3), (0, 5), (1, 0)])
def test_percent_rounds_half_to_even(frame, part, whole):
    want = round(100 * part / whole) if whole else None
    got = frame("a long, b long", (part, whole)).select(text.percent(F.col("a"), F.col("b"))).first()[0]
    assert got == want
    shown = frame("p long", (want,)).select(text.percent_text(F.col("p"))).first()[0]
    assert shown == (f"{want}%" if want is not None else "—")


def test_requirement_name(frame):
    got = values(frame, ["My_Pkg[x]>=1", " a.b ; python", ">=2", "Pkg==1"], text.requirement_name(F.col("s")))
    assert got == ["my-pkg", "a.b", None, "pkg"]


def test_lintable_keeps_line_numbers(frame):
    source = "a\n```py\n[x](gone.md)\n```\nb <!-- c\n[y](gone.md)\n--> [z](z.md) `[w](w.md)`\n~~~\nopen"
    got = values(frame, [source], text.lintable(F.col("s")))[0]
    assert got.count("\n") == source.count("\n")
    assert "gone" not in got and "w.md" not in got and "open" not in got
    assert got.split("\n")[6].strip() == "[z](z.md)"


GLOB = st.text(alphabet="ab./*?[!]-_1", max_size=8)


@given(GLOB, st.text(alphabet="ab./1-_", max_size=8))
def test_glob_like_fnmatch(pattern, name):
    try:
        want = re.match(fnmatch.translate(pattern), name) is not None
    except re.error:
        return
    ours = paths.glob_to_regex(pattern)
    if "--" in pattern or "[-" in pattern or "-]" in pattern or re.search(r"\[[^\]]*[-/][^\]]*\]", pattern):
        return  # ranges in odd places are left to the shells
    assert (re.match(ours, name) is not None) == want, ours


def test_fold_path_like_normpath(frame):
    tries = ["a/b/../c", "./a//b/.", "a/../b", "a/..", "x", "../a", "a/../../b", "a/b/../../c/./d"]
    want = []
    for p in tries:
        n = posixpath.normpath(p)
        want.append(None if n.startswith("..") else "" if n == "." else n)
    assert values(frame, tries, paths.fold_path(F.col("s"))) == want


def test_slugs_of_remotes(frame):
    urls = ["git@github.com:o/n.git", "https://github.com/o/n", "https://else.org/o/n", None]
    assert values(frame, urls, paths.repo_slug(F.col("s"), "github.com")) == ["o/n", "o/n", None, None]
    assert values(frame, ["My__Pkg.-x"], paths.index_name(F.col("s"))) == ["my-pkg-x"]
    assert values(frame, [r"C:\a_b/c"], paths.flat_key(F.col("s"))) == ["C--a-b-c"]


def test_versions_compare_by_number(frame):
    pairs = [("0.9.24", "0.9.25", True), ("0.10.0", "0.9.9", False), ("1.0", "1.0.0", True), ("dev", "1.0.0", False), ("1.0.0", None, False)]
    df = frame("i int, a string, b string", *[(i, a, b) for i, (a, b, _) in enumerate(pairs)]).orderBy("i")
    assert [r[0] for r in df.select(versions.is_lower(F.col("a"), F.col("b"))).collect()] == [w for *_, w in pairs]
    assert values(frame, ["1.2.9"], versions.bump_patch(F.col("s"))) == ["1.2.10"]
    source = "v = '9.9.9'\n__version__ = \"1.2.3\"\n"
    assert values(frame, [source, " __version__ = '1.2.3'"], versions.read_version(F.col("s"))) == ["1.2.3", None]


def test_markup(frame, rows):
    pages = frame(
        "i int, h string",
        (1, "<b>x</b><br>&nbsp;y"), (2, "a <b"), (3, "<placeholder>"), (4, "<p>open"), (5, "1 &lt; 2"), (6, "plain"), (7, "<img src='a'/>"),
    )
    state = dict(rows(pages.select("i", markup.markup_state(F.col("h")))))
    assert state == {1: "ok", 2: "malformed", 3: "malformed", 4: "malformed", 5: "ok", 6: "skipped", 7: "ok"}
    assert rows(markup.markup_balance(pages, "h", ["i"])) == [(3, "placeholder", 1), (4, "p", 1)]


def test_markup_state_of_whole_pages(frame, rows):
    page = """<!DOCTYPE html><html><head><meta charset="utf-8"><link rel="x" href="/a/b.css"><script>var t="</p>";if(a<b){}</script>
    <style>p>a{}</style></head><body><!-- <p> --><p>a &copy; b<br>c<br/><img src='/i>j.png' alt="/"><wbr></p></body></html>"""
    pages = frame("i long, h string", (1, page), (2, page.replace("</body></html>", "")), (3, page.replace("</p></body>", "</body>")))
    assert dict(rows(pages.select("i", markup.markup_state(F.col("h"))))) == {1: "ok", 2: "malformed", 3: "malformed"}


def test_markup_well_formed_judges_each_page_once(spark, tmp_path):
    from corpuswarden.plans import QUERIES

    page = "<html><body><div><p>a</p></body></html>"  # every block is well-formed, the page is not
    spark.createDataFrame([(1, page), (2, page.replace("<div>", ""))], "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = QUERIES["markup_well_formed"](spark, str(tmp_path)).select("page_id", "state", "left_open").collect()
    assert sorted(tuple(r) for r in got) == [(1, "malformed", ""), (2, "ok", ">")]


def test_tags_are_folded_in_order(frame):
    texts = ["<a><b></a></b>", "<a x='1' y = \"<\">", "<a x='>'><B></B><br/><i>", "<a x=1></a>", "a &amp; b &x", "<p></P>", ""]
    assert values(frame, texts, markup.open_elements(F.col("s"))) == ["", ">", ">a>i>", "", ">", "", ">"]
    assert values(frame, texts, markup.markup_state(F.col("s"))) == ["malformed", "malformed", "malformed", "malformed", "malformed", "malformed", "skipped"]
