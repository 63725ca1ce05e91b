"""Order-dependent helpers that never place a whole group in one task.

A plain window over ``partitionBy(key)`` sends every row of a hot key to one
task. Here a key's sequence is cut in blocks of consecutive positions: each
block is scanned by itself, and only one summary row per block takes part in
the scan over the key. Top-k windows are left as they are, because Spark cuts
each map-side partition to k rows per group before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from corpuswarden.session import materialize

BLOCK = 16_384
#: Bits of a row id that count the rows of a partition.
LOW_BITS = 33


def _blocked(df: DataFrame, keys: list[str], seq: str, value: Column, block: int) -> DataFrame:
    """Rows with their key as one struct, their block and the value to scan.

    A struct key is never null itself and equal where its fields are, null ones
    too. So grouping, window and join all use the same plain key, and the rows
    are shuffled and sorted once."""
    return df.select(
        "*",
        F.struct(*keys).alias("_key"),
        F.floor(F.col(seq) / F.lit(block)).cast("long").alias("_blk"),
        value.alias("_v"),
    )


def _carry(summary: DataFrame, scan: Column) -> DataFrame:
    """What the earlier blocks of a key hand on to each block."""
    return summary.select(F.col("_key").alias("_k"), F.col("_blk").alias("_b"), scan.alias("_carry"))


def _attach(rows: DataFrame, carry: DataFrame) -> DataFrame:
    return rows.join(carry, (F.col("_key") == F.col("_k")) & (F.col("_blk") == F.col("_b")), "left")


def _before() -> WindowSpec:
    return Window.partitionBy("_key").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)


def _within(seq: str) -> WindowSpec:
    return Window.partitionBy("_key", "_blk").orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)


def running_last(
    df: DataFrame, keys: list[str], seq: str, value: Column, out: str, block: int = BLOCK
) -> DataFrame:
    """Last non-null ``value`` at or before each row. ``(keys, seq)`` must be unique."""
    rows = _blocked(df, keys, seq, value, block)
    # max_by skips null orderings: the tail is null where the block has no value
    tails = rows.groupBy("_key", "_blk").agg(
        F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col(seq))).alias("_tail")
    )
    carry = _carry(tails, F.last("_tail", ignorenulls=True).over(_before()))
    scanned = rows.withColumn("_in", F.last("_v", ignorenulls=True).over(_within(seq)))
    return _attach(scanned, carry).select(*df.columns, F.coalesce("_in", "_carry").alias(out))


def running_sum(
    df: DataFrame, keys: list[str], seq: str, value: Column, out: str, block: int = BLOCK
) -> DataFrame:
    """Sum of ``value`` over all rows of the key up to and including each row."""
    rows = _blocked(df, keys, seq, value.cast("long"), block)
    sums = rows.groupBy("_key", "_blk").agg(F.sum("_v").alias("_s"))
    carry = _carry(sums, F.sum("_s").over(_before()))
    scanned = rows.withColumn("_in", F.sum("_v").over(_within(seq)))
    return _attach(scanned, carry).select(
        *df.columns, (F.col("_in") + F.coalesce("_carry", F.lit(0))).alias(out)
    )


def ordinal_in_group(
    df: DataFrame, keys: list[str], seq: str, out: str, block: int = BLOCK
) -> DataFrame:
    """1-based position of each row among the rows of its key, in ``seq`` order."""
    return running_sum(df, keys, seq, F.lit(1), out, block)


def positions(
    df: DataFrame, order: list[Column], group: list[str] | None = None, out: str = "position"
) -> DataFrame:
    """1-based rank of each row in a total order, per group or over the whole table.

    The rows are range-partitioned by group and order, once, sorted and written to the
    shared folder with a row id that holds the partition's number in its high
    bits and the place within it in its low ones. Rows of earlier partitions
    come from one count per partition and group. Over the whole table that is
    one row per partition, which is sent to all tasks, so nothing is shuffled
    again. ``order`` must be total, or ties split freely between neighbours.
    """
    spark = df.sparkSession
    group = group or []
    names = [f"_o{i}" for i in range(len(order))]
    tagged = df.select("*", *[c.alias(n) for c, n in zip(_plain(order), names)])
    sort = [*[F.col(g) for g in group], *[_directed(c, n) for c, n in zip(order, names)]]
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = tagged.repartitionByRange(parts, *sort).sortWithinPartitions(*sort).drop(*names)
    fixed, _ = materialize(ranged.withColumn("_at", F.monotonically_increasing_id()), "positions")
    part, place = F.shiftright("_at", LOW_BITS), F.col("_at").bitwiseAND(F.lit(2**LOW_BITS - 1))
    counts = fixed.groupBy(*group, part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"), F.min(place).alias("_first"))
    before = Window.orderBy("_p") if not group else Window.partitionBy(*group).orderBy("_p")
    earlier = F.coalesce(F.sum("_n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(*[F.col(g).alias(f"_g_{g}") for g in group], "_p", (earlier - F.col("_first") + 1).alias("_off"))
    cond = part == F.col("_p")
    for g in group:
        cond = cond & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    joined = fixed.join(offsets if group else F.broadcast(offsets), cond)
    return joined.withColumn(out, (place + F.col("_off")).cast("long")).drop("_at", "_p", "_off", *[f"_g_{g}" for g in group])


class Order:
    """Sort key with a direction that ``positions`` can take apart again."""

    def __init__(self, column: Column, descending: bool = False, nulls_last: bool = False):
        self.column, self.descending, self.nulls_last = column, descending, nulls_last


def _plain(order: list) -> list[Column]:
    return [o.column if isinstance(o, Order) else o for o in order]


def _directed(key, name: str) -> Column:
    col = F.col(name)
    if not isinstance(key, Order):
        return col.asc()
    if key.descending:
        return col.desc_nulls_last() if key.nulls_last else col.desc()
    return col.asc_nulls_last() if key.nulls_last else col.asc()


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int, out: str = "rank") -> DataFrame:
    """First k rows of each group. Nothing but the row number is in the window, so
    that Spark limits each group to k rows before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= k)
