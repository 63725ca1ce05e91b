"""Comparing two or three keyed sides.

Sides meet in one union and one aggregate on the key instead of a full outer
join: one shuffle with map-side combining, and a key repeated many times on a
side cannot blow up.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuswarden.functions.ordered import ordinal_in_group
from corpuswarden.functions.rows import each
from corpuswarden.functions.text import content_digest, normalize_text, unify_newlines


def align(sides: dict[str, DataFrame], keys: list[str], values: list[str]) -> DataFrame:
    """One row per key with ``in_<side>`` and ``<side>_<value>`` columns.

    A key given twice on one side keeps its smallest value."""
    # one value of a fixed width is combined by hash; several travel as one struct,
    # so that a repeated key never mixes the values of two rows
    packed = F.struct(*values) if len(values) != 1 else F.col(values[0])
    tagged = [
        df.select(*keys, F.lit(side).alias("_side"), (packed if values else F.lit(None).cast("int")).alias("_v"))
        for side, df in sides.items()
    ]
    aggs = []
    for side in sides:
        mine = F.col("_side") == side
        aggs.append(F.bool_or(mine).alias(f"in_{side}"))
        if values:
            aggs.append(F.min(F.when(mine, F.col("_v"))).alias(f"_{side}"))
    joined = reduce(DataFrame.unionByName, tagged).groupBy(*keys).agg(*aggs)
    value = lambda s, v: F.col(f"_{s}") if len(values) == 1 else F.col(f"_{s}.{v}")
    return joined.select(
        *keys,
        *[f"in_{s}" for s in sides],
        *[value(s, v).alias(f"{s}_{v}") for s in sides for v in values],
    )


def snapshot_diff(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys added, removed or changed, with both values; equal keys vanish."""
    both = align({"old": old, "new": new}, keys, [value])
    change = (
        F.when(~F.col("in_old"), "added")
        .when(~F.col("in_new"), "removed")
        .when(~F.col(f"old_{value}").eqNullSafe(F.col(f"new_{value}")), "changed")
    )
    return (
        both.withColumn("change", change)
        .where(F.col("change").isNotNull())
        .select(*keys, "change", F.col(f"old_{value}").alias("old_value"), F.col(f"new_{value}").alias("new_value"))
    )


def surface_drift(
    static: DataFrame, runtime: DataFrame, owner: str, member: str, kind: str
) -> DataFrame:
    """Drift of members over the owners present on both sides: missing fails, added
    and kind_changed advise. With an empty side every owner drops out; callers
    check ``surface_sides`` first, so that this never reads as "no drift"."""
    cells = align({"static": static, "runtime": runtime}, [owner, member], [kind])
    shared = (
        static.select(owner, F.lit(1).alias("_s"), F.lit(0).alias("_r"))
        .unionByName(runtime.select(owner, F.lit(0).alias("_s"), F.lit(1).alias("_r")))
        .groupBy(owner)
        .agg(F.max("_s").alias("_s"), F.max("_r").alias("_r"))
        .where((F.col("_s") == 1) & (F.col("_r") == 1))
        .select(owner)
    )
    drift = (
        F.when(~F.col("in_runtime"), "missing")
        .when(~F.col("in_static"), "added")
        .when(~F.col(f"static_{kind}").eqNullSafe(F.col(f"runtime_{kind}")), "kind_changed")
    )
    return (
        cells.withColumn("drift", drift)
        .where(F.col("drift").isNotNull())
        .join(shared, owner, "left_semi")
        .select(
            owner,
            member,
            "drift",
            F.when(F.col("drift") == "missing", "FAIL").otherwise("WARN").alias("severity"),
            F.col(f"static_{kind}").alias("static_kind"),
            F.col(f"runtime_{kind}").alias("runtime_kind"),
        )
    )


def surface_sides(static: DataFrame, runtime: DataFrame, owner: str) -> DataFrame:
    """One row: owners on each side and shared, and ERROR where a side is empty."""
    flags = align({"static": static.select(owner), "runtime": runtime.select(owner)}, [owner], [])
    return flags.agg(
        F.count_if("in_static").alias("n_static"),
        F.count_if("in_runtime").alias("n_runtime"),
        F.count_if(F.col("in_static") & F.col("in_runtime")).alias("n_shared"),
    ).withColumn(
        "verdict",
        F.when((F.col("n_static") == 0) | (F.col("n_runtime") == 0) | (F.col("n_shared") == 0), "ERROR").otherwise("OK"),
    )


def twin_control_diff(
    a: DataFrame,
    b: DataFrame,
    keys: list[str],
    hidden: DataFrame,
    static_names: DataFrame,
    ledger: DataFrame,
) -> DataFrame:
    """Keys of A that B lacks: hidden on B, a static equivalent on B, ledgered
    (pending or triaged), else untriaged - in that order of priority."""
    flags = _flag_union(
        {"a": a, "b": b, "hidden": hidden, "static": static_names}, keys, ledger
    )
    missing = flags.where(F.col("is_a") & ~F.col("is_b"))
    return missing.select(
        *keys,
        F.when(F.col("is_hidden"), "hidden")
        .when(F.col("is_static"), "static_equiv")
        .when(F.col("is_pending"), "pending")
        .when(F.col("is_listed"), "triaged")
        .otherwise("untriaged")
        .alias("class"),
    )


def _flag_union(sets: dict[str, DataFrame], keys: list[str], ledger: DataFrame | None = None) -> DataFrame:
    """One row per key with a boolean per key set it occurs in, and two for the ledger.

    Booleans only, so that the aggregate works by hash. Where a ledger holds a
    key twice, the status that sorts first counts."""
    parts = [df.select(*keys, F.lit(n).alias("_set")) for n, df in sets.items()]
    aggs = [F.bool_or(F.col("_set") == n).alias(f"is_{n}") for n in sets]
    if ledger is not None:
        status = F.coalesce("status", F.lit("na"))
        rank = F.when(status < "pending", "<").when(status == "pending", "=").otherwise(">")
        parts.append(ledger.select(*keys, F.concat(F.lit("ledger"), rank).alias("_set")))
        aggs += _ledger_flags(F.col("_set"), "ledger")
    return reduce(DataFrame.unionByName, parts).groupBy(*keys).agg(*aggs)


def _ledger_flags(mark: Column, prefix: str) -> list[Column]:
    first, pending = F.bool_or(mark == prefix + "<"), F.bool_or(mark == prefix + "=")
    return [(pending & ~first).alias("is_pending"), F.bool_or(mark.startswith(prefix)).alias("is_listed")]


def handler_diff(
    a_handlers: DataFrame,
    b_handlers: DataFrame,
    pair: str,
    name: str,
    ui: DataFrame,
    hidden: DataFrame,
    a_controls: DataFrame,
    b_controls: DataFrame,
    referenced: DataFrame,
    ledger: DataFrame,
) -> DataFrame:
    """Handlers of A missing on B, each in the first class that fits.

    A trailing ``_init`` folds to its base name for every lookup; the ledger is
    asked for the full name first. All lookup sets meet in one aggregate, so
    there are two joins whatever their number."""
    sides = _flag_union({"a": a_handlers, "b": b_handlers}, [pair, name])
    missing = sides.where(F.col("is_a") & ~F.col("is_b")).select(
        pair, name, F.regexp_replace(name, "_init$", "").alias("_base")
    )
    facts = _flag_union(
        {"ui": ui, "hidden": hidden, "actl": a_controls, "bctl": b_controls, "ref": referenced, "bslot": b_handlers},
        [pair, name],
        ledger,
    ).withColumnRenamed(name, "_base")
    by_name = _flag_union({}, [pair, name], ledger).select(pair, name, F.col("is_pending").alias("own_pending"))
    known = missing.join(by_name, [pair, name], "left").join(facts, [pair, "_base"], "left")
    flag = lambda n: F.coalesce(F.col(f"is_{n}"), F.lit(False))
    # an entry of its own comes before one of the base name
    own = F.col("own_pending")
    is_init = F.endswith(F.col(name), F.lit("_init"))
    return known.select(
        pair,
        name,
        F.when(F.coalesce(own, flag("pending")), "pending")
        .when(own.isNotNull() | flag("listed"), "triaged")
        .when(flag("ui") & flag("hidden"), "hidden")
        .when(flag("ui") & is_init & flag("bslot"), "partly_built")
        .when(flag("ui"), "unhandled")
        .when(flag("actl") & flag("bctl"), "wiring")
        .when(flag("actl"), "covered")
        .when(flag("ref"), "internal")
        .otherwise("stale")
        .alias("class"),
    )


def reference_counts(lines: DataFrame, names: DataFrame, file: str, name: str) -> DataFrame:
    """Names that occur in their file more often than they are defined there.

    Words are tokenized once per line and met in an equi-join; no name is
    searched for line by line."""
    words = each(lines, [file], F.regexp_extract_all("line", F.lit(r"\w+"), F.lit(0)), name)
    used = words.groupBy(file, name).agg(F.count(F.lit(1)).alias("_used"))
    defined = names.groupBy(file, name).agg(F.count(F.lit(1)).alias("_defs"))
    return used.join(defined, [file, name]).where(F.col("_used") > F.col("_defs")).select(file, name)


def multiset_deficit(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Names used more often on A than on B, with both counts."""
    counted = (
        a.select(*keys, F.lit(1).alias("_a"), F.lit(0).alias("_b"))
        .unionByName(b.select(*keys, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
        .groupBy(*keys)
        .agg(F.sum("_a").alias("n_a"), F.sum("_b").alias("n_b"))
    )
    return counted.where(F.col("n_b") < F.col("n_a"))


def property_delta(
    a: DataFrame,
    b: DataFrame,
    key: str,
    properties: list[str],
    false_when_missing: tuple[str, ...] = (),
    ignored: tuple[str, ...] = (),
    accepted: DataFrame | None = None,
) -> DataFrame:
    """Properties that differ on keys both sides have, as text values.

    Missing means false only for the properties named so; free-text ones are
    ignored; ``accepted(key_property)`` lists ``key.property`` deltas to skip."""
    props = [p for p in properties if p not in ignored]
    both = align({"a": a, "b": b}, [key], props).where(F.col("in_a") & F.col("in_b"))

    def value(side: str, p: str) -> Column:
        text = F.col(f"{side}_{p}").cast("string")
        return F.coalesce(text, F.lit("false")) if p in false_when_missing else text

    cells = F.array(
        *[F.struct(F.lit(p).alias("property"), value("a", p).alias("a_value"), value("b", p).alias("b_value")) for p in props]
    )
    deltas = both.select(key, F.inline(F.filter(cells, lambda c: ~c["a_value"].eqNullSafe(c["b_value"]))))
    if accepted is not None:
        deltas = (
            deltas.withColumn("_kp", F.concat_ws(".", F.col(key).cast("string"), "property"))
            .join(accepted.select(F.col("key_property").alias("_kp")).distinct(), "_kp", "left_anti")
            .drop("_kp")
        )
    return deltas


def item_list_delta(a: DataFrame, b: DataFrame, key: str, item: str) -> DataFrame:
    """Items of each key's list missing on B or extra on B; repeats count, order does
    not. A key whose list is empty on a side says nothing.

    Lists come as rows, so a very long list is as good as a short one."""
    counts = (
        a.select(key, item, F.lit(1).alias("_a"), F.lit(0).alias("_b"))
        .unionByName(b.select(key, item, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
        .groupBy(key, item)
        .agg(F.sum("_a").alias("n_a"), F.sum("_b").alias("n_b"))
    )
    both = (
        counts.groupBy(key)
        .agg(F.sum("n_a").alias("_ta"), F.sum("n_b").alias("_tb"))
        .where((F.col("_ta") > 0) & (F.col("_tb") > 0))
        .select(key)
    )
    one_sided = counts.where((F.col("n_a") == 0) | (F.col("n_b") == 0))
    return one_sided.join(both, key, "left_semi").select(
        key,
        item,
        F.when(F.col("n_b") == 0, "missing").otherwise("extra").alias("delta"),
        F.greatest("n_a", "n_b").alias("n"),
    )


def side_lists(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Every key with its side: a_only, b_only or both."""
    return align({"a": a.select(*keys), "b": b.select(*keys)}, keys, []).select(
        *keys,
        F.when(F.col("in_a") & F.col("in_b"), "both").when(F.col("in_a"), "a_only").otherwise("b_only").alias("side"),
    )


def side_extras(a: DataFrame, b: DataFrame, key: str, renames: DataFrame) -> DataFrame:
    """Keys only B has, apart from those that are the target of a rename."""
    return (
        b.select(key).distinct()
        .join(a.select(key).distinct(), key, "left_anti")
        .join(renames.select(F.col("to").alias(key)).distinct(), key, "left_anti")
    )


def name_set_ops(a: DataFrame, b: DataFrame, kind: str, name: str) -> DataFrame:
    """Names per kind with the side they are on."""
    return side_lists(a, b, [kind, name])


def three_way_merge(
    base: DataFrame,
    left: DataFrame,
    right: DataFrame,
    key: str,
    value: str,
    take_right: DataFrame,
    min_length: int = 0,
) -> DataFrame:
    """Row-wise merge: key, merged value, and how it came about.

    Both sides changed to different values is a conflict; on keys listed in
    ``take_right`` the right side wins, any other conflict is left unresolved.
    A merged value that is empty or shorter than ``min_length`` is refused. This
    merges rows, where a text merge works on line hunks."""
    m = align({"base": base, "left": left, "right": right}, [key], [value])
    policy = take_right.select(key, F.lit(True).alias("_pol")).distinct()
    m = m.join(policy, key, "left")

    def same(x: str, y: str) -> Column:
        return F.col(f"in_{x}").eqNullSafe(F.col(f"in_{y}")) & F.col(f"{x}_{value}").eqNullSafe(F.col(f"{y}_{value}"))

    rule = (
        F.when(same("left", "right"), "same")
        .when(same("left", "base"), "right")
        .when(same("right", "base"), "left")
        .when(F.col("_pol"), "conflict_right")
        .otherwise("conflict")
    )
    merged = (
        F.when(F.col("rule").isin("right", "conflict_right"), F.col(f"right_{value}"))
        .when(F.col("rule") != "conflict", F.col(f"left_{value}"))
    )
    present = F.when(F.col("rule").isin("right", "conflict_right"), F.col("in_right")).otherwise(F.col("in_left"))
    out = m.withColumn("rule", rule).withColumn("merged", merged).withColumn("present", present)
    refused = F.col("present") & (F.col("rule") != "conflict") & (
        F.char_length(F.coalesce(F.col("merged").cast("string"), F.lit(""))) < max(min_length, 1)
    )
    return out.where(F.col("present") | (F.col("rule") == "conflict")).select(
        key, "merged", "rule", F.when(refused, "refused").when(F.col("rule") == "conflict", "failed").otherwise("ok").alias("outcome")
    )


def ahead_behind(a: DataFrame, b: DataFrame, repo: str, item: str) -> DataFrame:
    """Per repo: how many items only A has (ahead) and only B has (behind)."""
    cells = align({"a": a.select(repo, item), "b": b.select(repo, item)}, [repo, item], [])
    return cells.groupBy(repo).agg(
        F.count_if(F.col("in_a") & ~F.col("in_b")).alias("ahead"),
        F.count_if(F.col("in_b") & ~F.col("in_a")).alias("behind"),
    )


def added_lines(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Lines of ``new`` beyond those of ``old`` as a bag, in their order.

    The n-th repeat of a line is new if the old text has fewer than n. A moved
    line is not new, which is where this differs from a positional diff."""
    had = old.groupBy(*keys, "line").agg(F.count(F.lit(1)).alias("_had"))
    numbered = ordinal_in_group(new.select(*keys, "line", "line_no"), [*keys, "line"], "line_no", "_n")
    return (
        numbered.join(had, [*keys, "line"], "left")
        .where(F.col("_n") > F.coalesce(F.col("_had"), F.lit(0)))
        .select(*keys, "line_no", "line")
    )


def join_lines(lines: DataFrame, keys: list[str], out: str) -> DataFrame:
    """Lines of each text joined again in order and trimmed: never more than the text was."""
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return lines.groupBy(*keys).agg(
        F.trim(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n")).alias(out)
    )


def staleness_gate(
    committed: DataFrame,
    fresh: DataFrame,
    key: str,
    text: str,
    gated: Column | None = None,
    drop_prefix: str = "_Generated:",
) -> DataFrame:
    """Artifacts whose committed text no longer matches a fresh one, cosmetics aside.

    Only fresh artifacts are judged; one without a committed text is stale. The
    texts themselves do not travel, only their digests."""
    norm = content_digest(normalize_text(F.col(text), drop_prefix, blank_line_fragments=True))
    sides = align(
        {"fresh": fresh.select(key, norm.alias("d")), "committed": committed.select(key, norm.alias("d"))}, [key], ["d"]
    ).where(F.col("in_fresh"))
    if gated is not None:
        sides = sides.where(gated)
    return sides.select(
        key,
        F.when(~F.col("in_committed"), "missing")
        .when(~F.col("fresh_d").eqNullSafe(F.col("committed_d")), "stale")
        .otherwise("fresh")
        .alias("state"),
    )


def scoped_gate(states: DataFrame) -> DataFrame:
    """One row; a run that saw no artifact fails, it does not read as fresh."""
    return states.agg(
        F.count(F.lit(1)).alias("n_checked"), F.count_if(F.col("state") != "fresh").alias("n_stale")
    ).withColumn("verdict", F.when((F.col("n_checked") == 0) | (F.col("n_stale") > 0), "FAIL").otherwise("OK"))


def mirror_drift(
    mirrors: DataFrame, sources: DataFrame, group: str, text: str, mirror: str
) -> DataFrame:
    """Mirrors compared with their group's source, newlines aside: agree, drift or
    missing (a null text). Mirrors without a source are left out. A mirror that
    has a row the source tree lacks shows up where the tree is the group."""
    digest = content_digest(unify_newlines(F.col(text)))
    src = sources.groupBy(group).agg(F.min(digest).alias("_src"))
    return mirrors.select(group, mirror, digest.alias("_d")).join(src, group).select(
        group,
        mirror,
        F.when(F.col("_d").isNull(), "missing")
        .when(F.col("_d").eqNullSafe(F.col("_src")), "agree")
        .otherwise("drift")
        .alias("state"),
    )
