"""Exploding costly arrays once.

For a plain explode the optimizer adds the filter ``size(array) > 0`` below it,
which computes the array a second time. The outer form has no such filter; the
one null row it gives for an empty array is dropped afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def each(df: DataFrame, keep: list, array: Column, value: str) -> DataFrame:
    """One row per element, which must not be null itself."""
    return df.select(*keep, F.explode_outer(array).alias(value)).where(F.col(value).isNotNull())


def each_numbered(df: DataFrame, keep: list, array: Column, number: str, value: str) -> DataFrame:
    """One row per element with its 1-based number."""
    out = df.select(*keep, F.posexplode_outer(array).alias("_p", value)).where(F.col("_p").isNotNull())
    names = [k if isinstance(k, str) else out.columns[i] for i, k in enumerate(keep)]
    return out.select(*names, (F.col("_p") + 1).cast("long").alias(number), value)


def each_struct(df: DataFrame, keep: list, array: Column, never_null: str) -> DataFrame:
    """One row per struct of the array, its fields as columns."""
    return df.select(*keep, F.inline_outer(array)).where(F.col(never_null).isNotNull())
