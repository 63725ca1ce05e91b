"""Whole audits over small trees."""

import json

from corpuswarden.operators.gate import gate_verdict
from corpuswarden.operators.ledger import ledger_dataset
from corpuswarden.plans import sweeps
from corpuswarden.sources import scans

GOOD = {
    "hub/README.md": "# Hub\n[doc](../repo/docs/a.md#second-part) and [again](../repo/docs/a.md#L5)\n[b](../repo/docs/b.md)\n",
    "repo/docs/a.md": "# A\n## Second part\n[self](#a) [code](../src/) `[x](gone.md)`\n```\n[y](gone.md)\n```\n<!-- [z](gone.md) -->\n",
    "repo/docs/b.md": "# B is quite long enough\n",
    "repo/src/c.md": "# C is long enough\n[a](../docs/a.md) [c](../../hub/README.md)\n[up](../../../out.md)\n",
    "repo/INDEX.md": "generated [c](src/c.md)\n",
}


def tree(frame, **changes):
    docs = {**GOOD, **changes}
    return frame("repo string, path string, text string", *[(p.split("/")[0], p, t) for p, t in docs.items() if t is not None])


def found(rows, df):
    return [(c, k) for c, _, k, _ in rows(df)]


def test_clean_tree_gives_no_findings(frame, rows):
    tracked = frame("repo string, path string", *[(p.split("/")[0], p.upper()) for p in GOOD])
    assert rows(sweeps.docs_sweep(tree(frame), tracked, ("INDEX.md",))) == []


def test_each_seeded_defect_is_found(frame, rows):
    files = tree(
        frame,
        **{
            "repo/docs/b.md": "# B is long enough\n[gone](nowhere.md)\n",
            "repo/docs/lonely.md": "# Nobody links here at all\n[a](a.md#Second-part)\n",
            "repo/CHANGELOG.md": "# Log of changes\n## [Unreleased]\n[old](removed.md)\n",
            "hub/tiny.md": "[x](README.md)",
        },
    )
    tracked = frame("repo string, path string", ("repo", "repo/docs/a.md"), ("repo", "repo/docs/b.md"), ("repo", "repo/docs/lonely.md"))
    out = sweeps.docs_sweep(files, tracked, ("INDEX.md",))
    assert found(rows, out) == [
        ("anchors", "repo/docs/lonely.md"), ("changelog", "repo/CHANGELOG.md"), ("empty", "hub/tiny.md"), ("links", "repo/docs/b.md"),
        ("orphans", "hub/tiny.md"), ("orphans", "repo/docs/lonely.md"), ("tracked", "repo/src/c.md"),
    ]
    report = {r.check: r.verdict for r in gate_verdict(out, sweeps.DOC_CHECKS).collect()}
    assert report["ALL"] == "FAIL" and report["empty"] == "WARN"


def test_options_of_the_documents_audit(frame, rows):
    files = tree(
        frame,
        **{
            "repo/docs/b.md": "# B is long enough\n[code](../src/x/y.py) [dir](../src/x) [pic](../src/x/z.png) [old](../build/o.md)\n",
            "repo/build/o.md": "[x](nowhere.md) pruned\n",
            "repo/lib/v.md": "[x](nowhere.md) vendored\n",
            "repo/docs/gen.md": "[x](nowhere.md) generated\n",
            "repo/LICENSE-notes.md": "nobody links to a licence\n",
            "repo/.github/how.md": "nobody links to these rules\n",
            "repo/docs/own.md": "exempt by the caller's list\n",
        },
    )
    everything = frame("path string", ("repo/src/x/y.py",), ("repo/src/x/deep/q.py",))
    out = sweeps.docs_sweep(
        files, None, ("INDEX.md",), everything, ("build",), ("repo/lib",), ("repo/docs/gen.md",), (*sweeps.ORPHAN_EXEMPT, "own.md")
    )
    assert rows(out, "check", "key", "detail") == [("links", "repo/docs/b.md", "line 2 ../src/x/z.png")]


def catalog(frame, **packages):
    docs = [json.dumps({"name": p, "modules": [{"relpath": "m.py", "functions": [{"name": n, "signature": s} for n, s in fns.items()]}]}) for p, fns in packages.items()]
    return scans.registry_scan(frame("j string", *[(d,) for d in docs]), "j")


def test_catalog_sweep(frame, rows):
    old = catalog(frame, base={"f": "()", "gone": "()"}, m={"shared": "()"}, b={"shared": "()"})
    new = catalog(frame, base={"f": "(x)", "new": "()"}, m={"shared": "()"}, b={"shared": "()", "f": "()"})
    out = sweeps.catalog_sweep(new, old, ("m", "b"))
    assert found(rows, out) == [
        ("added", "b/m.py::f"), ("added", "base/m.py::new"), ("changed", "base/m.py::f"), ("collisions", "f"), ("collisions", "f"), ("removed", "base/m.py::gone")
    ]
    assert [c for c, _ in found(rows, sweeps.catalog_sweep(old, old, ("m", "b")))] == []


def test_parity_sweep(frame, rows):
    k = lambda *x: frame("pair string, key string", *x)
    book = ledger_dataset({"controls": frame("pair string, key string, status string", ("q", "y", "pending"))})
    out = sweeps.parity_sweep(k(("p", "x"), ("p", "h"), ("q", "y"), ("r", "z")), k(("r", "z"), ("s", "w")), k(("p", "h")), k(("none", "n")), book)
    assert rows(out, "pair", "n_untriaged", "n_pending", "n_hidden", "status") == [
        ("p", 1, 0, 1, "GAP"), ("q", 0, 1, 0, "open"), ("r", 0, 0, 0, "OK"), ("s", 0, 0, 0, "OK")
    ]


BOOK = """# Map
## Ledger
| doc | role | status | verified | sources |
|:--|:--|:--|:--|:--|
| [a](a.md) | guide | current | 2024-01-01 | x |
| [b](b.md) | landing | stub | — | |
| [out](../TOP.md) | meta | needs-verify | - | |
## Coverage rules
| prefix | doc | note |
| `core/` | [a](a.md) | |
| `core/io.py` | — | internal |
## Notes
| [ignored](nowhere.md) | odd | odd | odd | |
"""
LEDGERED = {
    "r/docs/DOCMAP.md": BOOK,
    "r/docs/a.md": "**Nav**: x\n<!-- sync:s -->one<!-- /sync:s -->\n```\n<!-- DOC-TODO example -->\n```\n",
    "r/docs/b.md": "landing <!-- doc-todo: write -->\n<!-- sync:s -->\none  \n<!-- /sync:s -->\n",
    "r/TOP.md": "**Nav**: y\n",
    "r/docs/API_X.md": "generated\n",
    "r/API_INDEX.md": "### `core/io.py`\n### `core/x.py`\n",
    "other/readme.md": "no ledger here\n",
}


def ledgered(frame, **changes):
    docs = {**LEDGERED, **changes}
    return frame("repo string, path string, text string", *[(p.split("/")[0], p, t) for p, t in docs.items() if t is not None])


def test_clean_ledger_gives_no_findings(frame, rows):
    assert rows(sweeps.ledger_sweep(ledgered(frame))) == []


def test_ledger_defects_are_found(frame, rows):
    book = (
        BOOK.replace("| guide | current | 2024-01-01", "| guide | current | —").replace("| landing | stub | —", "| hub | stub | soon")
        .replace("## Notes", "| `gone/` | [z](zz.md) | |\n## Notes").replace("## Coverage", "| [gone](gone.md) | guide | stub | - | |\n## Coverage")
    )
    files = ledgered(
        frame,
        **{
            "r/docs/DOCMAP.md": book,
            "r/docs/a.md": LEDGERED["r/docs/a.md"].replace("**Nav**", "Nav").replace("one", "two") + "<!-- DOC-TODO now -->\n",
            "r/docs/b.md": LEDGERED["r/docs/b.md"].replace("doc-todo", "todo"),
            "r/docs/new.md": "not in the ledger\n",
            "r/API_INDEX.md": LEDGERED["r/API_INDEX.md"] + "### `misc.py`\n",
            "noindex/docs/DOCMAP.md": "## Ledger\n",
        },
    )
    assert [r for r in rows(sweeps.ledger_sweep(files), "check", "severity", "key", "detail")] == [
        ("coverage", "FAIL", "r/misc.py", "untriaged"),
        ("coverage", "WARN", "noindex/docs/DOCMAP.md", "no index, check skipped"),
        ("coverage", "WARN", "r/gone/", "matches no module"),
        ("ledger-fields", "FAIL", "r/docs/a.md", "current_needs_date"),
        ("ledger-fields", "FAIL", "r/docs/b.md", "role"),
        ("ledger-fields", "FAIL", "r/docs/b.md", "verified"),
        ("ledger-sync", "FAIL", "r/docs/gone.md", "no_file"),
        ("ledger-sync", "FAIL", "r/docs/new.md", "no_ledger_row"),
        ("ledger-sync", "FAIL", "r/docs/zz.md", "rule_without_row"),
        ("nav", "FAIL", "r/docs/a.md", "no navigation line"),
        ("nav", "FAIL", "r/docs/b.md", "no navigation line"),
        ("sync", "FAIL", "r/docs/a.md", "r:s"),
        ("sync", "FAIL", "r/docs/b.md", "r:s"),
        ("todos", "FAIL", "r/docs/a.md", "1"),
        ("todos", "WARN", "r/docs/b.md", "0"),
    ]
