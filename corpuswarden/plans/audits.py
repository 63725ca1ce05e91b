"""Queries: whole audits over trees of texts that are made from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuswarden.operators.ledger import ledger_dataset
from corpuswarden.plans import sweeps
from corpuswarden.plans.registry import Tables, query


def note_tree(t: Tables):
    """A note per document, linked to others of its repo, a picture and a folder; a change log per repo."""
    k = F.col("doc_id")
    text = lambda *parts: F.concat(*[p.cast("string") if not isinstance(p, str) else F.lit(p) for p in parts])
    other = k + (k % 7) * 5 - 10
    fragment = F.when(k % 4 == 1, "part").otherwise(text("note-", other))
    lines = [
        text("# Note ", k),
        F.lit(""),
        F.when(k % 2 == 0, "## Part").otherwise("plain"),
        text("[a](../d", F.pmod(other, F.lit(3)), "/n", other, ".md#", fragment, ")"),
        text("[b](../img/p", k, ".png)"),
        text("[dir](../d", k % 3, ") [up](../../../x.md) `[code](gone.md)`"),
        F.lit("<!-- [c](gone.md) -->"),
    ]
    notes = t.documents.select(
        text("s", k % 5).alias("repo"),
        text("s", k % 5, "/d", k % 3, "/n", k, ".md").alias("path"),
        F.when(k % 50 == 0, "tiny").otherwise(F.concat_ws("\n", *lines)).alias("text"),
    )
    logs = notes.select("repo").distinct().select(
        "repo", F.concat("repo", F.lit("/CHANGELOG.md")).alias("path"),
        F.when(F.col("repo") == "s1", "# Changes of this repo\n## [Unreleased]\n").otherwise("# Changes of this repo\n## 2024\n").alias("text"),
    )
    pictures = t.documents.where(k % 6 != 0).select(text("s", k % 5, "/img/p", k, ".png").alias("path"))
    return notes.unionByName(logs), pictures


@query(
    "docs_audit",
    r"""WITH d AS (SELECT doc_id AS k, doc_id + doc_id % 7 * 5 - 10 AS j, 's' || doc_id % 5 AS repo, 's' || doc_id % 5 || '/d' || doc_id % 3 || '/n' || doc_id || '.md' AS path, doc_id % 50 = 0 AS tiny FROM documents),
    l AS (SELECT a.*, '../d' || ((a.j % 3 + 3) % 3) || '/n' || a.j || '.md#' || CASE WHEN a.k % 4 = 1 THEN 'part' ELSE 'note-' || a.j END AS target, b.k IS NOT NULL AS there, b.tiny AS bare FROM d a LEFT JOIN d b ON b.k = a.j WHERE NOT a.tiny),
    x AS (SELECT 'links' AS "check", 'FAIL' AS severity, path AS key, 'line 4 ' || target AS detail FROM l WHERE NOT there
      UNION ALL SELECT 'links', 'FAIL', path, 'line 5 ../img/p' || k || '.png' FROM l WHERE k % 6 = 0
      UNION ALL SELECT 'anchors', 'FAIL', path, 'line 4 ' || target FROM l WHERE there AND (bare OR (k % 4 = 1 AND j % 2 <> 0))
      UNION ALL SELECT 'orphans', 'FAIL', path, 'no inbound link' FROM d WHERE k NOT IN (SELECT j FROM l WHERE j <> k)
      UNION ALL SELECT 'empty', 'WARN', path, '4' FROM d WHERE tiny
      UNION ALL SELECT DISTINCT 'changelog', 'FAIL', repo || '/CHANGELOG.md', 'banned heading' FROM d WHERE repo = 's1')
    SELECT * FROM x""",
)
def _docs_audit(t: Tables):
    files, pictures = note_tree(t)
    return sweeps.docs_sweep(files, catalog=pictures).select("check", "severity", "key", "detail")


@query(
    "parity_audit",
    """WITH k AS (SELECT CAST(l_suppkey AS VARCHAR) AS pair, CAST(l_partkey AS VARCHAR) AS key, * FROM lineitem),
    f AS (SELECT pair, key, bool_or(l_linestatus = 'O') AS a, bool_or(l_linestatus = 'F') AS b, bool_or(l_quantity < 6) AS hidden, bool_or(l_discount > 0.09) AS static,
            min(CASE WHEN l_tax > 0.06 THEN CASE WHEN l_returnflag = 'A' THEN 'pending' ELSE 'na' END END) AS s FROM k GROUP BY 1, 2),
    c AS (SELECT pair, CASE WHEN NOT a OR b THEN NULL WHEN hidden THEN 'hidden' WHEN static THEN 'static_equiv' WHEN s = 'pending' THEN 'pending' WHEN s IS NOT NULL THEN 'triaged' ELSE 'untriaged' END AS class FROM f),
    n AS (SELECT pair, count(*) FILTER (WHERE class = 'untriaged') AS n_untriaged, count(*) FILTER (WHERE class = 'pending') AS n_pending, count(*) FILTER (WHERE class = 'triaged') AS n_triaged,
            count(*) FILTER (WHERE class = 'hidden') AS n_hidden, count(*) FILTER (WHERE class = 'static_equiv') AS n_static_equiv FROM c GROUP BY 1)
    SELECT *, CASE WHEN n_untriaged > 0 THEN 'GAP' WHEN n_pending > 0 THEN 'open' ELSE 'OK' END AS status FROM n""",
)
def _parity_audit(t: Tables):
    """Open and final items as two sides of a supplier's panel, some entered in a ledger."""
    rows = t.lineitem.select("*", F.col("l_suppkey").cast("string").alias("pair"), F.col("l_partkey").cast("string").alias("key"))
    part = lambda cond: rows.where(cond).select("pair", "key")
    listed = rows.where("l_tax > 0.06").select("pair", "key", F.when(F.col("l_returnflag") == "A", "pending").otherwise("na").alias("status"))
    book = ledger_dataset({"controls": listed})
    return sweeps.parity_sweep(part("l_linestatus = 'O'"), part("l_linestatus = 'F'"), part("l_quantity < 6"), part("l_discount > 0.09"), book)
