"""References between rows: broken, orphaned, duplicate, undeclared, uncovered."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuswarden.functions import paths
from corpuswarden.functions.ordered import top_k
from corpuswarden.functions.rows import each
from corpuswarden.sources.scans import line_count, line_reference_scan, line_scan


def broken_links(links: DataFrame, catalog: DataFrame, target: str, key: str) -> DataFrame:
    """Links whose target is not in the catalog."""
    return links.join(catalog.select(F.col(key).alias(target)).distinct(), target, "left_anti")


def anchor_check(links: DataFrame, anchors: DataFrame, dest: str, fragment: str) -> DataFrame:
    """Links whose fragment is no anchor of their target, case counting.

    Empty fragments and line fragments ``L<n>`` are not anchors."""
    asked = links.where((F.col(fragment) != "") & ~F.col(fragment).rlike(r"^L\d+"))
    known = anchors.select(F.col("doc").alias(dest), F.col("anchor").alias(fragment)).distinct()
    return asked.join(known, [dest, fragment], "left_anti")


def line_ref_range(refs: DataFrame, lengths: DataFrame, target: str) -> DataFrame:
    """References to lines ``start`` to ``end`` of a target that do not exist.

    ``lengths(target, n_lines)``. An unknown target is reported as such,
    otherwise the first of the two numbers beyond the target's length."""
    end = F.coalesce("end", "start")
    checked = refs.join(lengths.select(target, "n_lines"), target, "left")
    return checked.where(
        F.col("n_lines").isNull() | (F.greatest("start", end) > F.col("n_lines"))
    ).select(
        *refs.columns,
        F.when(F.col("n_lines").isNull(), "not_found").otherwise("out_of_range").alias("issue"),
        F.when(F.col("n_lines").isNotNull(), F.when(F.col("start") > F.col("n_lines"), F.col("start")).otherwise(end)).alias("bad_line"),
        "n_lines",
    )


def line_ref_audit(docs: DataFrame, files: DataFrame, path: str, text: str) -> DataFrame:
    """References of documents to lines of files that are not there, from the texts of both.

    Texts are split where they are read; references and line counts meet by path."""
    refs = line_reference_scan(line_scan(docs, text, [path], "file"), path)
    lengths = files.select(F.col(path).alias("target"), line_count(F.col(text), "file").alias("n_lines"))
    return line_ref_range(refs, lengths, "target")


def orphans(
    catalog: DataFrame, edges: DataFrame, key: str, generated: Column | None = None, exempt: Column | None = None
) -> DataFrame:
    """Catalog rows no other row links to. A link to oneself does not count; a
    generated row is a source but is not itself checked."""
    inbound = edges.where(~F.col("src").eqNullSafe(F.col("dst"))).select(F.col("dst").alias(key)).distinct()
    checked = catalog
    for skip in (generated, exempt):
        if skip is not None:
            checked = checked.where(~skip)
    return checked.join(inbound, key, "left_anti")


def linked_untracked(
    edges: DataFrame, tracked: DataFrame, repos_with_tracking: DataFrame | None, k: int = 3
) -> DataFrame:
    """Linked but untracked targets with their first k sources by name.

    ``edges(repo, src, dst)`` and ``tracked(repo, path)`` meet without regard to
    case; repos without tracking data are skipped."""
    found = edges.where(~F.col("src").eqNullSafe(F.col("dst"))).withColumn("_p", F.lower(F.col("dst").cast("string")))
    if repos_with_tracking is not None:
        found = found.join(repos_with_tracking.select("repo").distinct(), "repo", "left_semi")
    known = tracked.select("repo", F.lower(F.col("path").cast("string")).alias("_p")).distinct()
    pairs = found.join(known, ["repo", "_p"], "left_anti").select("repo", "dst", "src").distinct()
    first = top_k(pairs, ["repo", "dst"], [F.col("src")], k, "_r")
    return first.groupBy("repo", "dst").agg(F.array_sort(F.collect_list("src")).alias("sources"))


def ledger_sync(
    ledger: DataFrame, catalog: DataFrame, rules: DataFrame, path: str, exempt_prefix: str | None = None
) -> DataFrame:
    """Both ways between ledger and catalog, plus rules whose target has no ledger row."""
    rows, files = ledger.select(path).distinct(), catalog.select(path).distinct()
    checked = files
    if exempt_prefix:
        checked = files.where(~F.startswith(paths.base_name(F.col(path).cast("string")), F.lit(exempt_prefix)))
    label = lambda df, issue: df.select(path, F.lit(issue).alias("issue"))
    targets = rules.select(path).where(F.col(path).isNotNull()).distinct()
    return (
        label(rows.join(files, path, "left_anti"), "no_file")
        .unionByName(label(checked.join(rows, path, "left_anti"), "no_ledger_row"))
        .unionByName(label(targets.join(rows, path, "left_anti"), "rule_without_row"))
    )


def rule_candidates(key: Column) -> Column:
    """Every rule text that could match ``key``: each of its prefixes that ends in a
    slash, and the key itself. So a prefix rule becomes an equi-join."""
    parts = F.split(key, "/")
    depth = F.size(parts)
    prefixes = F.transform(
        F.sequence(F.lit(1), depth),
        lambda i: F.when(i < depth, F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/"))).otherwise(key),
    )
    return F.array_distinct(prefixes)


def longest_prefix_rule(keys: DataFrame, key: str, rules: DataFrame) -> DataFrame:
    """Longest rule of each distinct key, null = untriaged.

    ``rules(rule, rule_order)``: a rule ending in a slash matches as a prefix, any
    other only exactly; among equal rule texts the first one is kept."""
    first = rules.groupBy("rule").agg(F.min("rule_order").alias("rule_order"))
    asked = each(keys.select(key).distinct(), [key], rule_candidates(F.col(key)), "rule")
    best = asked.join(first, "rule", "left").groupBy(key).agg(
        F.max_by(
            F.when(F.col("rule_order").isNotNull(), F.col("rule")),
            F.when(F.col("rule_order").isNotNull(), F.char_length("rule")),
        ).alias("rule")
    )
    return best


def stale_rules(matched: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules that no key was mapped to."""
    return rules.select("rule").distinct().join(matched.select("rule").where(F.col("rule").isNotNull()).distinct(), "rule", "left_anti")


def undeclared_files(
    files: DataFrame,
    declared: DataFrame,
    package: str,
    rel_path: str,
    loaded_suffixes: tuple[str, ...],
    loaded_names: tuple[str, ...] = (),
) -> DataFrame:
    """Files of a package that nothing loads and no declaration ships.

    ``declared(package, subtree, glob)``: an empty subtree means anywhere, a glob
    is matched on the base name. A package that declares nothing is skipped."""
    name = paths.base_name(F.col(rel_path))
    loaded = F.coalesce(name.isin(*loaded_names), F.lit(False)) if loaded_names else F.lit(False)
    for suffix in loaded_suffixes:
        loaded = loaded | name.endswith(suffix)
    rules = declared.select(
        F.col(package).alias("_pkg"), F.col("subtree").alias("_sub"), glob_like(F.col("glob")).alias("_like")
    ).distinct()
    candidates = files.where(~loaded).join(rules.select(F.col("_pkg").alias(package)).distinct(), package, "left_semi")
    # every folder a file lies in, the package itself as the empty one: rules meet by package and folder
    parts = F.split(rel_path, "/")
    folders = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    placed = each(candidates.select(package, rel_path).distinct(), [package, rel_path], folders, "_folder")
    met = (F.col(package) == F.col("_pkg")) & (F.col("_folder") == F.col("_sub")) & F.like(paths.base_name(F.col(rel_path)), F.col("_like"))
    shipped = placed.join(rules, met, "left_semi").select(package, rel_path).distinct()
    return candidates.join(shipped, [package, rel_path], "left_anti")


def stray_files(
    files: DataFrame,
    root_files: DataFrame,
    declared: DataFrame,
    package: str,
    rel_path: str,
    loaded_suffixes: tuple[str, ...],
    loaded_names: tuple[str, ...] = (),
    sentinels: tuple[str, ...] = (),
) -> DataFrame:
    """Files of packages that nothing loads or ships, and unknown ones without extension at a
    repo's root, with the ``reason``."""
    inside = undeclared_files(files, declared, package, rel_path, loaded_suffixes, loaded_names)
    outside = root_strays(root_files, rel_path, sentinels)
    return inside.withColumn("reason", F.lit("undeclared")).unionByName(outside.withColumn("reason", F.lit("root")))


def glob_like(glob: Column) -> Column:
    """LIKE pattern of a glob that uses ``*`` and ``?`` only."""
    escaped = F.regexp_replace(glob, r"([\\%_])", r"\\$1")
    return F.replace(F.replace(escaped, F.lit("*"), F.lit("%")), F.lit("?"), F.lit("_"))


def root_strays(files: DataFrame, path: str, sentinels: tuple[str, ...]) -> DataFrame:
    """Files at a repo root (no slash) without an extension that no tool looks up by name."""
    p = F.col(path)
    return files.where(~F.contains(p, F.lit("/")) & ~F.contains(p, F.lit(".")) & ~p.isin(*sentinels))


def declared_vs_named(declared: DataFrame, named: DataFrame, owner: str, name: str) -> DataFrame:
    """Declared names a document fails to name. Extra names are fine; an owner that
    names nothing misses all it declares."""
    return declared.select(owner, name).distinct().join(named.select(owner, name).distinct(), [owner, name], "left_anti")


# The named segment runs up to the next label, and the link path names the package.
NAMED_SEGMENT = r"\*\*Deps\*\*:\s*(.*?)(?:\s·\s\*\*[A-Za-z][^*]*\*\*:.*)?$"
NAMED_LINK = r"\]\(\.\./([^/)]+)/[^/)]+\.md\)"


def named_in_segment(lines: DataFrame, owner: str) -> DataFrame:
    """Names linked from the segment of the navigation line."""
    nav = lines.where(F.startswith(F.col("line"), F.lit("**Nav**:")))
    segment = F.regexp_extract("line", NAMED_SEGMENT, 1)
    names = each(nav, [owner], F.regexp_extract_all(segment, F.lit(NAMED_LINK), F.lit(1)), "name")
    return names.withColumn("name", F.lower("name"))


def hub_coverage(topics: DataFrame, index_links: DataFrame, hub_links: DataFrame, name: str) -> DataFrame:
    """Coverage of topics through an index, directly or by one hub the index links.

    ``index_links(name)``, ``hub_links(hub, name)``. One row per finding: duplicate
    (linked twice by the index), broken_index, broken_hub, orphan."""
    counted = index_links.groupBy(name).agg(F.count(F.lit(1)).alias("_n"))
    have = topics.select(name).distinct()
    hubs = counted.select(name).join(have, name, "left_semi").withColumnRenamed(name, "hub")
    via = hub_links.join(hubs, "hub", "left_semi").select(name).distinct()
    covered = counted.select(name).unionByName(via).distinct()
    label = lambda df, issue: df.select(name, F.lit(issue).alias("issue"))
    return (
        label(counted.where(F.col("_n") > 1), "duplicate")
        .unionByName(label(counted.join(have, name, "left_anti"), "broken_index"))
        .unionByName(label(via.join(have, name, "left_anti"), "broken_hub"))
        .unionByName(label(have.join(covered, name, "left_anti"), "orphan"))
    )


def duplicate_entries(rows: DataFrame, owner: str, key: str, position: str) -> DataFrame:
    """Keys an owner lists more than once, with the count and the first position."""
    return (
        rows.groupBy(owner, key)
        .agg(F.count(F.lit(1)).alias("n"), F.min(position).alias("first_at"))
        .where(F.col("n") > 1)
    )


def block_consistency(blocks: DataFrame, name: str, body: str, doc: str) -> DataFrame:
    """Documents that share a named block whose bodies differ, with the number of versions."""
    norm = F.regexp_replace(
        F.regexp_replace(F.col(body), r"(?md)[\p{Zs}\t\x0B\f]+$", ""), r"^\n+|\n+$", ""
    )
    slim = blocks.select(name, doc, F.unhex(F.md5(norm)).alias("_d"))
    versions = (
        slim.groupBy(name, "_d").agg(F.count(F.lit(1)).alias("_c"))
        .groupBy(name).agg(F.count(F.lit(1)).alias("n_versions"))
        .where(F.col("n_versions") > 1)
    )
    return slim.join(versions, name).select(name, doc, "n_versions")


SYNC_BLOCK = r"(?s)<!--\s*sync:([\w-]+)\s*-->(.*?)<!--\s*/sync:\1\s*-->"


def sync_blocks(df: DataFrame, text: str, doc: str) -> DataFrame:
    """Named blocks of each text; blocks opened inside a fence are examples and are cut out first."""
    plain = F.regexp_replace(F.col(text), r"(?ms)^\s*(```|~~~).*?(^\s*(```|~~~)[^\n]*$|\z)", "")
    found = F.arrays_zip(
        F.regexp_extract_all(plain, F.lit(SYNC_BLOCK), F.lit(1)).alias("name"),
        F.regexp_extract_all(plain, F.lit(SYNC_BLOCK), F.lit(2)).alias("body"),
    )
    return each(df, [doc], found, "_b").select(doc, "_b.name", "_b.body")


def rename_target_check(ledger: DataFrame, names: DataFrame, key: str, target: str) -> DataFrame:
    """Ledger rows marked renamed whose plain-name target the other side does not have."""
    renamed = ledger.where((F.col("status") == "renamed") & F.col(target).rlike(r"(?U)^\w+$"))
    return renamed.select(key, target).join(names.select(F.col("name").alias(target)).distinct(), target, "left_anti")


def pair_resolution(names: DataFrame, a: DataFrame, b: DataFrame, name: str, suffixes: tuple[str, str]) -> DataFrame:
    """Resolve each name to one file per side: by file base name, suffixed base name,
    class, suffixed class; then fill an empty side through the other side's class.

    ``a`` and ``b`` have (base, class, path); where a base or class repeats, the
    smallest path counts. A row with a side still empty has state FAIL."""
    attempts = [("base", ""), ("base", suffixes[0]), ("class", ""), ("class", suffixes[1])]
    tries = F.array(
        *[F.struct(F.lit(i).alias("rank"), F.lit(c).alias("by"), F.concat(F.col(name), F.lit(x)).alias("key")) for i, (c, x) in enumerate(attempts)]
    )
    tables = {"a": a, "b": b}
    file = F.struct("path", "class").alias("file")
    lookup = reduce(
        DataFrame.unionByName,
        [t.select(F.lit(s).alias("side"), F.lit(c).alias("by"), F.col(c).alias("key"), file) for s, t in tables.items() for c in ("base", "class")],
    ).groupBy("side", "by", "key").agg(F.min("file").alias("file"))
    # all attempts on both sides in one join; the earliest that hits counts
    hits = names.select(name).distinct().select(name, F.inline(tries)).join(lookup, ["by", "key"], "left")
    best = lambda side: F.min(F.when(F.col("side") == side, F.struct("rank", "file")))["file"].alias(f"_{side}")
    out = hits.groupBy(name).agg(best("a"), best("b"))
    for side, other in (("b", "a"), ("a", "b")):
        by_class = tables[side].groupBy(F.col("class").alias("_cls")).agg(F.min(F.struct("path", "class")).alias("_fill"))
        # rows that need nothing get a key of their own, or they would all meet in one task
        need = F.coalesce(
            F.when(F.col(f"_{side}").isNull(), F.col(f"_{other}.class")), F.concat(F.lit("\u0000"), F.col(name))
        )
        out = (
            out.join(by_class, need == F.col("_cls"), "left")
            .withColumn(f"_{side}", F.coalesce(f"_{side}", "_fill"))
            .drop("_cls", "_fill")
        )
    return out.select(
        name,
        F.col("_a.path").alias("a_path"),
        F.col("_b.path").alias("b_path"),
        F.when(F.col("_a").isNull() | F.col("_b").isNull(), "FAIL").otherwise("OK").alias("state"),
    )
