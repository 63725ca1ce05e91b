"""Release decisions: receipts, pins, versions, cascades, run verdicts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuswarden.functions.text import days_between
from corpuswarden.functions.versions import is_lower, version_parts
from corpuswarden.session import materialize


#: Links followed in one round of an iterative operator.
HOPS = 3


def _merged(side: DataFrame) -> DataFrame:
    """A side of a join that grows with the graph: sorted and merged, as a broadcast of it in every round passes through the driver."""
    return side.hint("merge")


def _chains(links: DataFrame, chosen: DataFrame) -> DataFrame:
    """``node``, ``top``, ``dist`` of every node with one upstream, not chosen itself: the first node up
    its chain that is chosen or has several upstreams or none, by pointer doubling.

    Each round reads the one before only and doubles the links that a pointer spans.
    Nodes below a ring of such nodes, which nothing enters, are left out."""
    one = links.groupBy(F.col("downstream").alias("node")).agg(F.count("*").alias("n"), F.min("upstream").alias("top")).where("n = 1")
    start = one.join(_merged(chosen.select(F.col("node").alias("_n"))), F.col("node") == F.col("_n"), "left_anti")
    pointers, n = materialize(start.select("node", "top", F.lit(1).cast("long").alias("dist"), F.lit(True).alias("open")), "chains")
    span = 1
    while span <= n:
        above = pointers.select(F.col("node").alias("_node"), F.col("top").alias("_top"), F.col("dist").alias("_dist"))
        joined = pointers.join(_merged(above), F.col("top") == F.col("_node"), "left")
        moved = joined.select(
            "node", F.coalesce("_top", "top").alias("top"), (F.col("dist") + F.coalesce("_dist", F.lit(0))).alias("dist"), F.col("_top").isNotNull().alias("open")
        )
        pointers, n_open = materialize(moved, "chains", F.col("open"))
        span *= 2
        if not n_open:
            break
    return pointers.where(~F.col("open")).drop("open") if n else pointers.drop("open")


def dependency_cascade(edges: DataFrame, selection: DataFrame, name: str) -> DataFrame:
    """Selection plus all its downstream dependents, each once, marked, with its least distance.

    ``edges(upstream, downstream)``. Chains of nodes with a single upstream are
    contracted first, in as many rounds as the logarithm of their length. What
    is left, nodes where several ways meet, is relaxed from the selection on,
    ``HOPS`` links a round; a round reads the last levels, one row per node, and
    the links of the nodes that got nearer. So loops and diamonds end."""
    links, _ = materialize(
        edges.select("upstream", "downstream").where(F.col("upstream") != F.col("downstream")).distinct(), "edges"
    )
    chosen = selection.select(F.col(name).alias("node")).distinct()
    chains = _chains(links, chosen)
    fixed = chosen.unionByName(chains.select("node")).select(F.col("node").alias("_n"))
    over = chains.select(F.col("node").alias("_node"), "top", "dist")
    meets = links.join(_merged(fixed), F.col("downstream") == F.col("_n"), "left_anti").join(_merged(over), F.col("upstream") == F.col("_node"), "left")
    steps = meets.groupBy(F.coalesce("top", "upstream").alias("up"), F.col("downstream").alias("down")).agg(F.min(F.coalesce("dist", F.lit(0)) + 1).alias("step"))
    steps, n = materialize(steps, "meets")
    levels, _ = materialize(chosen.select("node", F.lit(0).cast("long").alias("level"), F.lit(True).alias("nearer")), "levels")
    while n:
        front, found = levels.where("nearer").select("node", "level"), []
        for _ in range(HOPS):
            front = steps.join(_merged(front), F.col("up") == F.col("node")).groupBy(F.col("down").alias("node")).agg(F.min(F.col("level") + F.col("step")).alias("level"))
            found.append(front)
        both = reduce(DataFrame.unionByName, [f.withColumn("old", F.lit(None).cast("long")) for f in found], levels.select("node", "level", F.col("level").alias("old")))
        best = both.groupBy("node").agg(F.min("level").alias("level"), F.min("old").alias("old"))
        marked = best.select("node", "level", (F.col("old").isNull() | (F.col("level") < F.col("old"))).alias("nearer"))
        levels, n = materialize(marked, "levels", F.col("nearer"))
    below = over.join(_merged(levels), F.col("top") == F.col("node")).select(F.col("_node").alias("node"), (F.col("level") + F.col("dist")).alias("level"))
    return levels.select("node", "level").unionByName(below).select(
        F.col("node").alias(name), F.when(F.col("level") == 0, "selected").otherwise("added").alias("mark"), "level"
    )


def receipt_validity(
    required: DataFrame, receipts: DataFrame, key: str, check: str, ts: str, as_of: Column, max_days: int
) -> DataFrame:
    """VALID, EXPIRED or MISSING per required (key, check). The age limit is inclusive."""
    latest = receipts.groupBy(key, check).agg(F.max(ts).alias("_ts"))
    age = as_of.cast("timestamp_ntz") - F.col("_ts").cast("timestamp_ntz")
    return required.select(key, check).join(latest, [key, check], "left").select(
        key,
        check,
        F.when(F.col("_ts").isNull(), "MISSING")
        .when(age <= F.make_dt_interval(days=F.lit(max_days)), "VALID")
        .otherwise("EXPIRED")
        .alias("state"),
        F.floor(days_between(as_of, F.col("_ts"))).cast("long").alias("age_days"),
    )


def retention_prune(entries: DataFrame, key: str, ts: str, cutoff: Column) -> DataFrame:
    """Entries whose key has any time after the cutoff (strictly); unreadable times are dead."""
    live = entries.groupBy(key).agg(F.max(ts).alias("_t")).where(F.col("_t") > cutoff).select(key)
    return entries.join(live, key, "left_semi")


def pin_floor_ratchet(pins: DataFrame, versions: DataFrame, dep: str) -> DataFrame:
    """Raise each declared floor to the published version, never lower it.

    A dependency without a version is an error; one of the two being unreadable
    compares as not lower, so the floor is set."""
    floor, version = F.col("floor"), F.col("version")
    return pins.join(versions.select(dep, "version"), dep, "left").select(
        *pins.columns,
        F.when(version.isNull(), "error")
        .when(floor == version, "same")
        .when(is_lower(version, floor), "kept")
        .otherwise("raised")
        .alias("action"),
        F.when(version.isNull() | is_lower(version, floor), floor).otherwise(version).alias("new_floor"),
    )


def pin_availability(required: DataFrame, versions: DataFrame, published: DataFrame, package: str, dep: str) -> DataFrame:
    """Pins whose version is not published; each blocks its package. Dependencies
    the version map does not know are skipped."""
    pins = required.select(package, dep).distinct().join(versions.select(dep, "version"), dep)
    return pins.join(published.select(dep, "version").distinct(), [dep, "version"], "left_anti").select(package, dep, "version")


def version_clamp(local: DataFrame, published: DataFrame, package: str) -> DataFrame:
    """The local version if it is published, else the latest published one, else the local one."""
    latest = published.groupBy(package).agg(F.max_by("version", version_parts(F.col("version"))).alias("_latest"))
    exact = published.select(package, F.col("version").alias("_v")).distinct()
    l = local.select(package, F.col("version").alias("local"))  # noqa: E741
    joined = l.join(
        exact.withColumnRenamed(package, "_p"), (F.col(package) == F.col("_p")) & (F.col("local") == F.col("_v")), "left"
    ).join(latest, package, "left")
    return joined.select(
        package,
        "local",
        F.when(F.col("_v").isNotNull(), F.col("local")).otherwise(F.coalesce("_latest", "local")).alias("version"),
        F.when(F.col("_v").isNotNull(), "published").when(F.col("_latest").isNotNull(), "clamped").otherwise("local").alias("origin"),
    )


def freshness_guard(artifacts: DataFrame, inputs: DataFrame, key: str, generated: Column | None = None) -> DataFrame:
    """Derived artifact against its newest input: stale only if an input is strictly
    newer. ``artifacts(key, built)``; a null or absent time is an error."""
    kept = inputs if generated is None else inputs.where(~generated)
    newest = kept.groupBy(key).agg(F.max("mtime").alias("newest"))
    return artifacts.select(key, "built").join(newest, key, "left").select(
        key,
        F.when(F.col("built").isNull(), "error")
        .when(F.col("newest") > F.col("built"), "stale")
        .otherwise("fresh")
        .alias("state"),
    )


def run_verdict(keys: DataFrame, runs: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Verdict over the runs (status, conclusion) of each key: norun, pending while any
    is unfinished, else the latest failure's conclusion, else success. A run without a
    conclusion is no failure."""
    failed = (F.col("status") == "completed") & ~F.col("conclusion").isin("success", "")
    agg = runs.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_runs"),
        F.count_if(F.col("status") != "completed").alias("n_pending"),
        F.max_by(F.when(failed, F.col("conclusion")), F.when(failed, F.struct(*order))).alias("_fail"),
    )
    return keys.select(key).join(agg, key, "left").select(
        key,
        F.coalesce("n_runs", F.lit(0)).alias("n_runs"),
        F.coalesce("n_pending", F.lit(0)).alias("n_pending"),
        F.when(F.col("n_runs").isNull(), "norun")
        .when(F.col("n_pending") > 0, "pending")
        .otherwise(F.coalesce("_fail", F.lit("success")))
        .alias("verdict"),
    )


def merge_gate(requests: DataFrame, checks: DataFrame, key: str) -> DataFrame:
    """Is each request held by real checks? ``requests(key, merge_state)``,
    ``checks(key, conclusion, state)``.

    A check is settled with a conclusion or a state other than PENDING and
    EXPECTED. No checks at all = ungated; blocked with all settled = stuck."""
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    settled = has("conclusion") | (has("state") & ~F.col("state").isin("PENDING", "EXPECTED"))
    agg = checks.groupBy(key).agg(F.count(F.lit(1)).alias("n_checks"), F.count_if(~settled).alias("n_pending"))
    return requests.join(agg, key, "left").withColumn(
        "gate",
        F.when(F.coalesce("n_checks", F.lit(0)) == 0, "ungated")
        .when((F.col("merge_state") == "BLOCKED") & (F.col("n_pending") == 0), "stuck")
        .when(F.col("merge_state") == "BLOCKED", "waiting")
        .otherwise("gated"),
    )


def housekeeping_only(keys: DataFrame, changes: DataFrame, key: str, allowed: Column) -> DataFrame:
    """True where a change set is not empty and every changed path is allowed."""
    agg = changes.groupBy(key).agg(F.bool_and(F.coalesce(allowed, F.lit(False))).alias("_all"))
    return keys.select(key).join(agg, key, "left").select(key, F.coalesce("_all", F.lit(False)).alias("housekeeping"))


def release_gate(
    packages: DataFrame,
    deltas: DataFrame,
    housekeeping: DataFrame,
    validity: DataFrame,
    key: str,
    waived: tuple[str, ...] = (),
) -> DataFrame:
    """Verdict per package: exempt without a delta or with housekeeping only, else
    blocked if a required check is missing or expired. Waived checks do not block
    but are listed by count.

    ``deltas(key, ahead)``, ``housekeeping(key, housekeeping)``,
    ``validity(key, check, state)``."""
    bad = F.col("state") != "VALID"
    is_waived = F.col("check").isin(*waived) if waived else F.lit(False)
    checks = validity.groupBy(key).agg(
        F.count_if(bad & ~is_waived).alias("n_missing"), F.count_if(is_waived).alias("n_waived")
    )
    return (
        packages.select(key)
        .join(deltas.select(key, "ahead"), key, "left")
        .join(housekeeping.select(key, "housekeeping"), key, "left")
        .join(checks, key, "left")
        .select(
            key,
            F.coalesce("n_missing", F.lit(0)).alias("n_missing"),
            F.coalesce("n_waived", F.lit(0)).alias("n_waived"),
            F.when(F.coalesce("ahead", F.lit(0)) == 0, "exempt_no_delta")
            .when(F.coalesce("housekeeping", F.lit(False)), "exempt_housekeeping")
            .when(F.coalesce("n_missing", F.lit(0)) > 0, "blocked")
            .otherwise("pass")
            .alias("verdict"),
        )
    )


BUMP_MESSAGE = r"(?i)^(update dependencies & )?bump version to "


def latest_is_bump(log: DataFrame, repo: str, message: str, order: list[str], pattern: str = BUMP_MESSAGE) -> DataFrame:
    """Is the latest message of each repo a version bump? Anchored: a mention is not one."""
    last = log.groupBy(repo).agg(F.max_by(message, F.struct(*order)).alias("last_message"))
    return last.withColumn("is_bump", F.col("last_message").rlike(pattern))
