"""Whole audits: the operators composed as a user runs them, from tables to findings.

Each sweep is one plan of findings; ``gate_verdict`` turns it into a report.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuswarden.functions import paths
from corpuswarden.functions.rows import each
from corpuswarden.functions.text import FENCED, blank_out, lintable, unify_newlines
from corpuswarden.operators import diff, filters, integrity, ledger, measure, sequence
from corpuswarden.operators.gate import findings
from corpuswarden.sources import scans

# Names that are exempt as orphans, and the heading form.
ORPHAN_EXEMPT = ("readme.md", "changelog.md", "docmap.md")
LINKCHECK_EXEMPT = ("changelog.md",)
HEADING = r"^#{1,6}\s+(.+?)\s*$"
NEXT_TO_EMPTY = 20
DOC_CHECKS = ["links", "anchors", "orphans", "changelog", "tracked", "empty"]


def docs_sweep(
    files: DataFrame,
    tracked: DataFrame | None = None,
    generated: tuple[str, ...] = (),
    catalog: DataFrame | None = None,
    pruned: tuple[str, ...] = (),
    vendored: tuple[str, ...] = (),
    generated_paths: tuple[str, ...] = (),
    orphan_exempt: tuple[str, ...] = ORPHAN_EXEMPT,
    link_exempt: tuple[str, ...] = LINKCHECK_EXEMPT,
) -> DataFrame:
    """Findings over a tree of documents (repo, path, text).

    Broken links and anchors with their lines, orphans, untracked but linked
    documents, a banned changelog heading, next to empty documents. Generated
    documents, by name or by path, are sources of links and are not checked
    themselves. Documents in ``pruned`` folders, of whatever depth, and below the
    ``vendored`` paths (repo and folder) are not part of the tree. A link is
    broken if nothing lies where it leads: no document, none of the other files of
    ``catalog`` (path), and no folder above any of them."""
    kept = scans.corpus_scan(files, "path", prune_segments=list(pruned))
    for prefix in vendored:
        kept = kept.where(~F.startswith("path", F.lit(prefix.rstrip("/") + "/")))
    is_generated = paths.base_name(F.col("path")).isin(*generated) | F.col("path").isin(*generated_paths)
    docs = kept.select("repo", "path", "text", is_generated.alias("gen"))
    name = F.lower(paths.base_name(F.col("path")))
    exempt = (
        name.isin(*orphan_exempt) | F.contains(name, F.lit("license")) | F.contains(name, F.lit("copying"))
        | F.array_contains(F.split("path", "/"), F.lit(".github"))
    )

    body = docs.where(~F.col("gen") & ~name.isin(*link_exempt)).select("path", lintable(F.col("text")).alias("text"))
    lines = scans.line_scan(body, "text", ["path"], "file")
    links = resolved(scans.link_scan(lines, "line", ["path", "line_no"], scans.MARKDOWN_LINK))
    everything = files.select("path") if catalog is None else files.select("path").unionByName(catalog.select("path"))
    known = each(everything.distinct(), [], paths.with_folders(F.col("path")), "dest")
    broken = integrity.broken_links(links, known, "dest", "dest")

    heads = scans.line_scan(docs.select("path", blank_out(unify_newlines(F.col("text")), FENCED).alias("text")), "text", ["path"], "file")
    titled = heads.withColumn("heading", F.regexp_extract("line", HEADING, 1)).where(F.col("heading") != "")
    anchors = sequence.slug_dedupe(titled, ["path"], "line_no", "heading").select(F.col("path").alias("doc"), "anchor")
    to_docs = links.where(F.endswith("dest", F.lit(".md"))).join(docs.select(F.col("path").alias("dest")).distinct(), "dest", "left_semi")
    lost = integrity.anchor_check(to_docs, anchors, "dest", "fragment")

    raw = resolved(scans.link_scan(docs, "text", ["path"], r"\]\(([^)#\s]+\.md(?:#[^)\s]*)?)\)"))
    edges = raw.select(F.col("path").alias("src"), F.col("dest").alias("dst"))
    alone = integrity.orphans(docs, edges, "path", F.col("gen"), exempt)

    where = lambda extra: F.concat_ws(" ", F.concat(F.lit("line "), F.col("line_no").cast("string")), extra)
    parts = [
        findings(broken, "links", "FAIL", F.col("path"), where(F.col("target"))),
        findings(lost, "anchors", "FAIL", F.col("path"), where(F.col("target"))),
        findings(alone, "orphans", "FAIL", F.col("path"), F.lit("no inbound link")),
        findings(
            filters.forbidden_heading(docs.where(name == "changelog.md"), "text", ["path"]),
            "changelog", "FAIL", F.col("path"), F.lit("banned heading"),
        ),
        findings(
            docs.where(~F.col("gen") & (F.octet_length("text") < NEXT_TO_EMPTY)),
            "empty", "WARN", F.col("path"), F.octet_length("text"),
        ),
    ]
    if tracked is not None:
        checked = docs.where(~F.col("gen")).select("repo", F.col("path").alias("dst")).distinct()
        inside = edges.select("src", "dst").join(checked, "dst")
        loose = integrity.linked_untracked(inside, tracked, tracked.select("repo").distinct())
        parts.append(findings(loose, "tracked", "WARN", F.col("dst"), F.array_join("sources", ", ")))
    return reduce(DataFrame.unionByName, parts)


def resolved(links: DataFrame) -> DataFrame:
    """In-scope links with ``dest``: the folded path, or the document itself for a pure anchor."""
    base, target = paths.dir_name(F.col("path")), F.col("target")
    scope = filters.boundary_class(target, base)
    return (
        links.withColumn("_scope", scope)
        .where(F.col("_scope").isin("inside", "anchor"))
        .withColumn("dest", F.when(F.col("_scope") == "anchor", F.col("path")).otherwise(filters.resolve_target(target, base)))
        .drop("_scope")
    )


# Allowed entries of a documentation ledger, the form of its rows and of
# the coverage rows, the forms of navigation line, open marker and indexed module.
ROLES = ("landing", "guide", "reference", "meta")
STATUSES = ("current", "needs-verify", "stub")
ISO_DATE = r"^\d{4}-\d{2}-\d{2}$"
NO_DATE = ("—", "-")
LEDGER_ROW = r"^\|\s*\[([^\]]+)\]\(([^)]+)\)\s*\|\s*([^|]+?)\s*\|\s*([^|]+?)\s*\|\s*([^|]+?)\s*\|\s*([^|]*?)\s*\|\s*$"
COVERAGE_ROW = r"^\|\s*`([^`]+)`\s*\|\s*(?:\[[^\]]+\]\(([^)]+)\)|(?:—|-))\s*\|\s*([^|]*?)\s*\|\s*$"
NAV_LINE = r"^\*\*Nav\*\*:"
OPEN_MARKER = r"(?i)<!--\s*DOC-TODO"
INDEXED_MODULE = r"^### `([^`]+)`"
LEDGER_CHECKS = ["ledger-fields", "ledger-sync", "nav", "todos", "sync", "coverage"]


def ledger_tables(files: DataFrame, ledger_name: str) -> tuple[DataFrame, DataFrame]:
    """Ledger rows and coverage rules out of the tables of each repo's ledger document."""
    book = files.where(paths.base_name(F.col("path")) == ledger_name)
    lines = scans.line_scan(book, "text", ["repo", "path"], "file")
    title = F.when(F.startswith(F.col("line"), F.lit("## ")), F.lower(F.trim(F.right("line", F.char_length("line") - 3))))
    section = F.when(title.startswith("ledger"), "ledger").when(title.startswith("coverage"), "coverage").when(title.isNotNull(), "-")
    placed = sequence.section_of_line(lines, ["repo", "path"], "line_no", section)
    cell = lambda pattern, i: F.regexp_extract("line", pattern, i)
    base = paths.dir_name(F.col("path"))
    rows = placed.where((F.col("section") == "ledger") & F.col("line").rlike(LEDGER_ROW)).select(
        "repo", "line_no",
        filters.resolve_target(cell(LEDGER_ROW, 2), base).alias("doc"),
        cell(LEDGER_ROW, 3).alias("role"), cell(LEDGER_ROW, 4).alias("status"), cell(LEDGER_ROW, 5).alias("verified"),
    )
    target = F.nullif(cell(COVERAGE_ROW, 2), F.lit(""))
    rules = placed.where((F.col("section") == "coverage") & F.col("line").rlike(COVERAGE_ROW)).select(
        "repo", "line_no",
        F.concat_ws("/", "repo", F.trim(cell(COVERAGE_ROW, 1))).alias("rule"),
        F.when(target.isNotNull(), filters.resolve_target(target, base)).alias("doc"),
    )
    return rows, rules


def ledger_sweep(files: DataFrame, ledger_name: str = "DOCMAP.md", index_name: str = "API_INDEX.md") -> DataFrame:
    """Findings over the documentation ledger of each repo (repo, path, text).

    Fields of the ledger rows; rows against the documents beside the ledger;
    navigation line, open markers and shared blocks of the ledgered documents;
    modules of the index against the coverage rules. Repos without a ledger are
    left out; without an index the coverage check only warns."""
    rows, rules = ledger_tables(files, ledger_name)
    books = files.where(paths.base_name(F.col("path")) == ledger_name).select("repo", F.col("path").alias("book")).distinct()
    # by repo and folder: a repo may hold far more files than the folder of its ledger
    folders = books.select("repo", "book", paths.dir_name(F.col("book")).alias("folder"))
    beside = (
        files.where(F.endswith("path", F.lit(".md")))
        .select("repo", "path", paths.dir_name(F.col("path")).alias("folder"))
        .join(folders, ["repo", "folder"])
        .where(F.col("path") != F.col("book"))
        .select(F.col("path").alias("doc"))
    )
    dated = F.col("verified").rlike(ISO_DATE)
    broken = filters.field_rules(
        rows, ["repo", "doc", "line_no"],
        {
            "role": ~F.col("role").isin(*ROLES),
            "status": ~F.col("status").isin(*STATUSES),
            "current_needs_date": (F.col("status") == "current") & ~dated,
            "verified": ~F.col("verified").isin(*NO_DATE) & ~dated,
        },
    )
    # a ledger may list documents elsewhere: those that exist count as well
    ledgered = rows.select(F.col("doc").alias("path")).distinct()
    elsewhere = files.join(ledgered, "path", "left_semi").select(F.col("path").alias("doc"))
    sync = integrity.ledger_sync(rows, beside.unionByName(elsewhere), rules, "doc", exempt_prefix="API_")

    docs = files.join(rows.select(F.col("doc").alias("path"), "role", "status"), "path")
    heads = scans.line_scan(docs.where("role <> 'landing'"), "text", ["path"], "file")
    nav = sequence.header_in_first_n(heads, ["path"], "line_no", F.col("line").rlike(NAV_LINE))
    markers = F.regexp_count(blank_out(unify_newlines(F.col("text")), FENCED), F.lit(OPEN_MARKER))
    census = measure.marker_census(docs.select("path", markers.alias("n_markers")), docs, "path").where("finding <> 'OK'")
    blocks = integrity.sync_blocks(docs.withColumn("id", F.struct("repo", "path")), "text", "id").select(
        F.concat_ws(":", "id.repo", "name").alias("name"), F.col("id.path").alias("path"), "body"
    )
    apart = integrity.block_consistency(blocks, "name", "body", "path")

    index = files.where(paths.base_name(F.col("path")) == index_name)
    listed = scans.definition_scan(scans.line_scan(index, "text", ["repo"], "file"), ["repo"], INDEXED_MODULE)
    modules = listed.join(books, "repo", "left_semi").select(F.concat_ws("/", "repo", "name").alias("module"))
    ordered = rules.select("rule", F.col("line_no").alias("rule_order"))
    best = integrity.longest_prefix_rule(modules, "module", ordered)
    indexed = index.select("repo").distinct()
    stale = integrity.stale_rules(best, rules.join(indexed, "repo", "left_semi"))
    no_index = books.join(indexed, "repo", "left_anti")

    return reduce(
        DataFrame.unionByName,
        [
            findings(broken, "ledger-fields", "FAIL", F.col("doc"), F.col("rule")),
            findings(sync, "ledger-sync", "FAIL", F.col("doc"), F.col("issue")),
            findings(nav, "nav", "FAIL", F.col("path"), F.lit("no navigation line")),
            findings(census, "todos", F.col("finding"), F.col("path"), F.col("n_markers")),
            findings(apart, "sync", "FAIL", F.col("path"), F.col("name")),
            findings(best.where(F.col("rule").isNull()), "coverage", "FAIL", F.col("module"), F.lit("untriaged")),
            findings(stale, "coverage", "WARN", F.col("rule"), F.lit("matches no module")),
            findings(no_index, "coverage", "WARN", F.col("book"), F.lit("no index, check skipped")),
        ],
    )


CATALOG_CHECKS = ["removed", "changed", "added", "collisions"]


def catalog_sweep(fresh: DataFrame, baseline: DataFrame, pair: tuple[str, str]) -> DataFrame:
    """Findings over two catalogs of symbol rows: what changed since the baseline, and
    names that several packages define outside the intended pair."""
    key = ["package", "key"]
    flat = lambda df: df.select("package", F.concat_ws("::", "module", "qualname").alias("key"), "signature")
    changes = diff.snapshot_diff(flat(baseline), flat(fresh), key, "signature")
    symbol = F.concat_ws("/", *key)
    top = fresh.where(F.col("owner") == "").select("package", "module", "name", "line")
    hits = measure.cross_group_collisions(top, "name", "package", pair)
    shared = measure.collision_occurrences(top, hits, "name").where(F.col("kind") == "genuine")
    level = {"removed": "FAIL", "changed": "WARN", "added": "OK"}
    parts = [
        findings(
            changes.where(F.col("change") == c), c, s, symbol,
            F.concat_ws(" -> ", F.coalesce("old_value", F.lit("")), F.coalesce("new_value", F.lit(""))),
        )
        for c, s in level.items()
    ]
    place = F.concat_ws(":", "package", "module", F.col("line").cast("string"))
    return reduce(DataFrame.unionByName, [*parts, findings(shared, "collisions", "WARN", F.col("name"), place)])


def parity_sweep(
    a: DataFrame, b: DataFrame, hidden: DataFrame, static_names: DataFrame, book: DataFrame, pairs: list[str] | None = None
) -> DataFrame:
    """Per pair: how many controls of A that B lacks fall in each class, and its status.

    ``a``, ``b``, ``hidden`` and ``static_names`` have (pair, key), the ledger
    (scope, pair, key, status, ...)."""
    deltas = diff.twin_control_diff(a, b, ["pair", "key"], hidden, static_names, book)
    classes = ["untriaged", "pending", "triaged", "hidden", "static_equiv"]
    summary = ledger.status_summary(deltas, "pair", "class", classes, "untriaged", "pending")
    every = a.select("pair").unionByName(b.select("pair")).distinct()
    counts = [F.coalesce(F.col(f"n_{c}"), F.lit(0)).alias(f"n_{c}") for c in classes]
    out = every.join(summary, "pair", "left").select("pair", *counts, F.coalesce("status", F.lit("OK")).alias("status"))
    return out if pairs is None else out.where(F.col("pair").isin(*pairs))
