"""Operators that depend on the order of rows within a text or an owner."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuswarden.functions.ordered import Order, ordinal_in_group, positions, running_last, running_sum
from corpuswarden.functions.text import heading_slug
from corpuswarden.session import Stages, materialize

#: Rounds of a walk after which known classes are asked for again at the latest.
PATIENCE = 8
FENCE = r"^\s*(```|~~~)"


def fence_mask(lines: DataFrame, keys: list[str], marker: str = FENCE) -> DataFrame:
    """Adds ``fenced``: the line is a fence marker or lies inside a fence. Markers
    toggle; a fence never closed runs to the end."""
    tagged = lines.withColumn("_f", F.col("line").rlike(marker))
    counted = running_sum(tagged, keys, "line_no", F.col("_f").cast("int"), "_n")
    return counted.withColumn("fenced", (F.col("_n") % 2 == 1) | F.col("_f")).drop("_f", "_n")


def section_of_line(lines: DataFrame, keys: list[str], seq: str, section: Column, out: str = "section") -> DataFrame:
    """Last section seen at or before each row. ``section`` is null on rows that open
    none; an unknown heading should yield a "closed" value to end the section."""
    return running_last(lines, keys, seq, section, out)


def slug_dedupe(headings: DataFrame, keys: list[str], seq: str, heading: str) -> DataFrame:
    """Anchor of each heading; the n-th repeat within a document takes the suffix -n.

    A repeat may collide with a heading whose own text ends in that suffix; it is
    left so."""
    slugged = headings.withColumn("slug", heading_slug(F.col(heading)))
    counted = ordinal_in_group(slugged, [*keys, "slug"], seq, "_n")
    return counted.withColumn(
        "anchor",
        F.when(F.col("_n") == 1, F.col("slug")).otherwise(F.concat_ws("-", "slug", (F.col("_n") - 1).cast("string"))),
    ).drop("_n")


def header_in_first_n(lines: DataFrame, keys: list[str], seq: str, header: Column, n: int = 12) -> DataFrame:
    """Documents with no header among their first n lines."""
    return (
        lines.groupBy(*keys)
        .agg(F.bool_or((F.col(seq) <= n) & header).alias("_has"))
        .where(~F.coalesce("_has", F.lit(False)))
        .select(*keys)
    )


def enclosing_scope(lines: DataFrame, keys: list[str], seq: str, definition: Column, hit: Column) -> DataFrame:
    """For each hit row the nearest definition at or before it, null at top level."""
    return running_last(lines, keys, seq, definition, "scope").where(hit)


def first_definition_wins(owners: DataFrame, bases: DataFrame, members: DataFrame) -> DataFrame:
    """Members of each owner, its own and those inherited through private bases.

    ``owners(owner)``, ``bases(owner, base, pos, private)``, ``members(owner,
    member, pos)``. Bases are walked left to right and depth first; the first
    definition of a member wins. Each (owner, class) pair is kept with the
    smallest path of base positions that leads to it, so that diamonds are
    walked once and loops end. Rounds: as many as the hierarchy is deep.

    What is known is only asked again when it has doubled: a pair walked twice in
    between adds a later path, which loses in the end. Walks must not close a ring
    meanwhile. They can't where all bases come before their owners in order of
    names; elsewhere a walk carries its classes and asks after ``PATIENCE`` rounds."""
    edges, n_up = materialize(
        bases.where(F.col("private") & (F.col("owner") != F.col("base")))
        .groupBy(F.col("owner").alias("_from"), F.col("base").alias("_to"))
        .agg(F.min("pos").alias("_pos")),
        "bases",
        F.col("_to") > F.col("_from"),
    )
    walk = {"path": F.array().cast(f"array<{edges.schema['_pos'].dataType.simpleString()}>")}
    if n_up:
        walk["seen"] = F.array("owner")
    start = owners.select("owner").distinct().select("owner", F.col("owner").alias("class"), *[c.alias(n) for n, c in walk.items()])
    reached = Stages(owners.sparkSession, "classes")
    frontier, n_new = reached.add(start)
    asked, since, waited = n_new, 0, 0
    while n_new:
        # merged, not broadcast: these sides grow with the hierarchy and would pass through the driver
        step = frontier.join(edges.hint("merge"), F.col("class") == F.col("_from"))
        longer = [F.concat("path", F.array("_pos")).alias("path")]
        if n_up:
            step = step.where(~F.array_contains("seen", F.col("_to")))
            longer.append(F.concat("seen", F.array("_to")).alias("seen"))
        step = step.groupBy("owner", F.col("_to").alias("class")).agg(F.min(F.struct(*longer)).alias("_w")).select("owner", "class", "_w.*")
        waited += 1
        if since >= asked or (n_up and waited >= PATIENCE):
            # a class met again counts only if the new path comes before every known one
            known = reached.all().select(F.col("owner").alias("_o"), F.col("class").alias("_c"), F.col("path").alias("_p"))
            earlier = (F.col("owner") == F.col("_o")) & (F.col("class") == F.col("_c")) & (F.col("_p") <= F.col("path"))
            step = step.join(known.hint("merge"), earlier, "left_anti")
            asked, since, waited = asked + since, 0, 0
        frontier, n_new = reached.add(step)
        since += n_new
    own = members.select(F.col("owner").alias("class"), "member", F.col("pos").alias("_mpos"))
    inherited = reached.all().select("owner", "class", "path").join(own.hint("merge"), "class")
    first = inherited.groupBy("owner", "member").agg(F.min(F.struct("path", "_mpos", F.col("class").alias("from_class"))).alias("_w"))
    return first.select("owner", "member", "_w.from_class", F.size("_w.path").cast("long").alias("depth"))


def canonical_order(df: DataFrame, name: str, ranking: list[str], seq: list[str]) -> DataFrame:
    """Rows in the order of a fixed list, unlisted ones after it in their own order."""
    rank = F.array_position(F.array(*[F.lit(r) for r in ranking]), F.col(name))
    listed = F.when(rank > 0, rank).otherwise(F.lit(len(ranking) + 1))
    return positions(df, [listed, *[F.col(s) for s in seq]])


def worst_first(df: DataFrame, ratio: Column, tie: list[str]) -> DataFrame:
    """Positions by ascending ratio, nulls last."""
    return positions(df, [Order(ratio, nulls_last=True), *[F.col(t) for t in tie]])


def stable_name_order(df: DataFrame, name: str, tie: list[str]) -> DataFrame:
    """Positions under both orders: by code point for artifacts, case-folded for listings."""
    by_code = positions(df, [F.col(name), *[F.col(t) for t in tie]], out="code_position")
    return positions(by_code, [F.lower(name), F.col(name), *[F.col(t) for t in tie]], out="folded_position")
