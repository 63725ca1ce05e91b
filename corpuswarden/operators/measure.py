"""Counts, coverage, collisions and other measures. All of them combine map-side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuswarden.functions import paths
from corpuswarden.functions.ordered import top_k
from corpuswarden.functions.text import percent

TOTAL = "TOTAL"


def inventory_rollup(files: DataFrame, repo: str, flags: dict[str, Column] | None = None) -> DataFrame:
    """Files, lines and non-empty lines per repo with a grand total row.

    ``files`` has (repo, n_lines, n_nonempty); ``flags`` become "any file has it"."""
    aggs = [
        F.count(F.lit(1)).alias("n_files"),
        F.sum("n_lines").alias("total_lines"),
        F.sum("n_nonempty").alias("nonempty_lines"),
    ]
    aggs += [F.bool_or(c).alias(n) for n, c in (flags or {}).items()]
    rolled = files.rollup(repo).agg(F.grouping(repo).alias("_g"), *aggs)
    return rolled.withColumn(repo, F.when(F.col("_g") == 1, TOTAL).otherwise(F.col(repo))).drop("_g")


def module_tree_counts(files: DataFrame, root: str, rel_path: str, initializer: str, suffix: str = "") -> DataFrame:
    """Per root: child directories that hold an initializer, direct modules, and all
    modules at any depth; initializers are not modules."""
    parts = F.split(F.col(rel_path), "/")
    name, depth = paths.base_name(F.col(rel_path)), F.size(parts)
    is_init = name == initializer
    is_module = ~is_init & name.endswith(suffix)
    child = F.when(is_init & (depth == 2), F.get(parts, F.lit(0)))
    direct = F.when(is_module & (depth == 1), name)
    # distinct children first, so that no task holds the children of one root
    slim = files.select(root, child.alias("_c"), direct.alias("_d"), is_module.alias("_m"))
    counted = slim.groupBy(root, "_c", "_d").agg(F.count_if("_m").alias("_n"))
    return counted.groupBy(root).agg(
        F.count("_c").alias("n_subpackages"), F.count("_d").alias("n_modules"), F.sum("_n").alias("n_recursive")
    )


def dominant_values(df: DataFrame, group: str, value: str, k: int = 5) -> DataFrame:
    """The k most frequent values per group as text ``value (n)``; ties in value order."""
    counts = df.groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    return top_k(counts, [group], [F.col("n").desc(), F.col(value)], k).select(
        group, "rank", F.concat(F.col(value).cast("string"), F.lit(" ("), F.col("n").cast("string"), F.lit(")")).alias("label")
    )


def non_repo_folders(files: DataFrame, group: str, registered: list[str], measures: dict[str, Column]) -> DataFrame:
    """The same measures for groups outside the registered ones; groups without any content drop out."""
    out = files.where(~F.col(group).isin(*registered)).groupBy(group).agg(
        *[F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(n) for n, c in measures.items()]
    )
    return out.where(reduce(lambda x, y: x | y, [F.col(n) > 0 for n in measures]))


def cross_group_collisions(rows: DataFrame, name: str, group: str, pair: tuple[str, str]) -> DataFrame:
    """Names defined in more than one group, as their 16-byte digest ``name_id``.

    A name whose groups are exactly ``pair`` is intended, any other is genuine.
    Only digests are shuffled, each (name, group) once per map task, so a name
    that fills a third of all rows costs no more than any other."""
    per_group = rows.select(name_id(F.col(name)).alias("name_id"), group).groupBy("name_id", group).agg(
        F.count(F.lit(1)).alias("_n")
    )
    return (
        per_group.groupBy("name_id")
        .agg(
            F.count(F.lit(1)).alias("n_groups"),
            F.sum("_n").alias("n_rows"),
            F.count_if(F.col(group).isin(*pair)).alias("_in"),
        )
        .where(F.col("n_groups") > 1)
        .select(
            "name_id",
            "n_groups",
            "n_rows",
            F.when((F.col("n_groups") == 2) & (F.col("_in") == 2), "intended").otherwise("genuine").alias("kind"),
        )
    )


def name_id(name: Column) -> Column:
    return F.unhex(F.md5(name))


def collision_occurrences(rows: DataFrame, collisions: DataFrame, name: str) -> DataFrame:
    """Every occurrence of every colliding name."""
    return rows.withColumn("name_id", name_id(F.col(name))).join(collisions, "name_id").drop("name_id")


def name_coverage(a: DataFrame, b: DataFrame, module: str, name: str) -> DataFrame:
    """Per module, and in total over unique names: names of A and B, shared, percent of A.

    The total counts a name once, however many modules have it, so it is not the
    sum of the rows; ``is_total`` tells it from a module of that name. ``absent`` marks
    modules B has nothing of."""
    def side(df: DataFrame, label: str) -> DataFrame:
        own = F.struct(F.col(module).cast("string").alias(module), F.lit(False).alias("is_total"))
        total = F.struct(F.lit(TOTAL).alias(module), F.lit(True).alias("is_total"))
        return df.select(F.inline(F.array(own, total)), F.col(name).alias("_n"), F.lit(label).alias("_s"))

    flags = (
        side(a, "a").unionByName(side(b, "b"))
        .groupBy(module, "is_total", "_n")
        .agg(F.bool_or(F.col("_s") == "a").alias("_a"), F.bool_or(F.col("_s") == "b").alias("_b"))
    )
    counted = flags.groupBy(module, "is_total").agg(
        F.count_if("_a").alias("n_a"), F.count_if("_b").alias("n_b"), F.count_if(F.col("_a") & F.col("_b")).alias("n_shared")
    )
    return counted.withColumn("pct", percent(F.col("n_shared"), F.col("n_a"))).withColumn(
        "absent", (F.col("n_a") > 0) & (F.col("n_b") == 0)
    )


def handled_items(items: DataFrame, handlers: DataFrame, domain: str, item: str, providers: list[str]) -> DataFrame:
    """Each item with one flag per provider. A handler ``<item>_init`` handles its item too."""
    names = handlers.select(domain, F.regexp_replace(F.col(item).cast("string"), "_init$", "").alias("_i"), "provider")
    flags = names.groupBy(domain, "_i").agg(*[F.bool_or(F.col("provider") == p).alias(f"by_{p}") for p in providers])
    return (
        items.select(domain, item)
        .distinct()
        .withColumn("_i", F.col(item).cast("string"))
        .join(flags, [domain, "_i"], "left")
        .select(domain, item, *[F.coalesce(F.col(f"by_{p}"), F.lit(False)).alias(f"by_{p}") for p in providers])
    )


def domain_coverage(flagged: DataFrame, handlers: DataFrame, domain: str, providers: list[str]) -> DataFrame:
    """Per domain and provider, and in total: items, handled, missing and percent.

    A provider with no handler at all in a domain has a null percent there, yet
    the domain's items stay in the provider's total."""
    present = handlers.groupBy(F.col(domain).alias("_d")).agg(
        *[F.bool_or(F.col("provider") == p).alias(f"has_{p}") for p in providers]
    )
    rolled = flagged.rollup(domain).agg(
        F.grouping(domain).alias("_g"),
        F.count(F.lit(1)).alias("n_items"),
        *[F.count_if(f"by_{p}").alias(f"n_{p}") for p in providers],
    ).join(present, F.col(domain) == F.col("_d"), "left")
    long = F.array(
        *[
            F.struct(
                F.lit(p).alias("provider"),
                F.col(f"n_{p}").alias("n_handled"),
                (F.coalesce(F.col(f"has_{p}"), F.lit(False)) | (F.col("_g") == 1)).alias("present"),
            )
            for p in providers
        ]
    )
    return rolled.select(
        F.when(F.col("_g") == 1, TOTAL).otherwise(F.col(domain)).alias(domain), "n_items", F.inline(long)
    ).select(
        domain,
        "provider",
        "n_items",
        "n_handled",
        (F.col("n_items") - F.col("n_handled")).alias("n_missing"),
        F.when(F.col("present"), percent(F.col("n_handled"), F.col("n_items"))).alias("pct"),
    )


def domain_missing(flagged: DataFrame, domain: str, item: str, provider: str) -> DataFrame:
    """The items a provider does not handle, as rows."""
    return flagged.where(~F.col(f"by_{provider}")).select(domain, item)


def depth_ratio(a: DataFrame, b: DataFrame, key: str, measures: list[str], shallow: int = 50) -> DataFrame:
    """B as a percent of A for each measure, for keys on both sides; ``shallow``
    marks those below the limit, ``null_last`` gives the sort key of the report."""
    left = a.select(key, *[F.col(m).alias(f"a_{m}") for m in measures])
    right = b.select(key, *[F.col(m).alias(f"b_{m}") for m in measures])
    out = left.join(right, key)
    for m in measures:
        out = out.withColumn(f"pct_{m}", percent(F.col(f"b_{m}"), F.col(f"a_{m}")))
    return out.withColumn("shallow", F.coalesce(F.col(f"pct_{measures[0]}") < shallow, F.lit(False)))


def text_metrics(df: DataFrame, text: str, keep: list[str], pattern: str, excluded: str, having: str) -> DataFrame:
    """Per document: matches of a pattern less those of its excluded form, lines, and
    whether another pattern occurs."""
    t = F.col(text)
    return df.select(
        *keep,
        (F.regexp_count(t, F.lit(pattern)) - F.regexp_count(t, F.lit(excluded))).cast("long").alias("n_matches"),
        (F.regexp_count(t, F.lit("\n")) + 1).cast("long").alias("n_lines"),
        t.rlike(having).alias("has_pattern"),
    )


def marker_census(docs: DataFrame, statuses: DataFrame, key: str, count: str = "n_markers") -> DataFrame:
    """Marker counts with the rules of each document's status: current with markers
    fails, stub without any warns. Documents without a ledger row are left out."""
    return docs.select(key, count).join(statuses.select(key, "status"), key).withColumn(
        "finding",
        F.when((F.col("status") == "current") & (F.col(count) > 0), "FAIL")
        .when((F.col("status") == "stub") & (F.col(count) == 0), "WARN")
        .otherwise("OK"),
    )


def merge_by_key(
    df: DataFrame, keys: list[str], order: list[str], columns: list[str], last: bool = False
) -> DataFrame:
    """Same-key rows folded to one; per column the first (or last) non-null value in order wins."""
    pick = F.max_by if last else F.min_by
    return df.groupBy(*keys).agg(
        *[pick(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(c) for c in columns]
    )


def test_tally(results: DataFrame, repo: str, outcome: str, module: str, expected: list[str]) -> DataFrame:
    """Badge of each repo: passed = run - failures - errors - skipped, failed =
    failures + errors, wording and colour, and whether the run was complete.

    Skipped modules ran; rows of outcome ``standin`` (never imported) did not."""
    ran = F.col(outcome) != "standin"
    modules = (
        results.where(ran & F.col(module).isin(*expected)).groupBy(repo, module).agg(F.count(F.lit(1)).alias("_c"))
        .groupBy(F.col(repo).alias("_repo")).agg(F.count(F.lit(1)).alias("_n"))
    )
    tally = results.groupBy(repo).agg(
        F.count_if(ran).alias("n_run"),
        F.count_if(F.col(outcome).isin("failure", "error")).alias("failed"),
        F.count_if(F.col(outcome) == "skipped").alias("skipped"),
    ).withColumn("passed", F.col("n_run") - F.col("failed") - F.col("skipped"))
    none, no_fail, no_pass = (
        (F.col("passed") == 0) & (F.col("failed") == 0),
        F.col("failed") == 0,
        F.col("passed") == 0,
    )
    p, f = F.col("passed").cast("string"), F.col("failed").cast("string")
    return tally.join(modules, F.col(repo) == F.col("_repo"), "left").select(
        repo,
        "n_run",
        "passed",
        "failed",
        "skipped",
        F.when(none, "0 passed")
        .when(no_fail, F.concat(p, F.lit(" passed")))
        .when(no_pass, F.concat(f, F.lit(" failed")))
        .otherwise(F.concat(p, F.lit(" passed, "), f, F.lit(" failed")))
        .alias("message"),
        F.when(none, "lightgrey").when(no_fail, "brightgreen").when(no_pass, "red").otherwise("orange").alias("colour"),
        (~none & (F.coalesce("_n", F.lit(0)) == len(set(expected)))).alias("publish"),
    )


def set_relation(rows: DataFrame, group: list[str], member: str, required: list[str]) -> DataFrame:
    """Per group: does its set of members cover the required one, and is it equal to it?

    Members are made distinct before they are counted; no set is ever collected."""
    needed = len(set(required))
    distinct = rows.select(*group, member).distinct()
    return distinct.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_members"), F.count_if(F.col(member).isin(*required)).alias("_in")
    ).select(
        *group,
        "n_members",
        (F.col("_in") == needed).alias("covers"),
        ((F.col("_in") == needed) & (F.col("n_members") == needed)).alias("equal"),
    )
