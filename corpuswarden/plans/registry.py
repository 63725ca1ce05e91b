"""Registry of the named queries and access to the tables they read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpuswarden.session import apply_runtime

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
TEXT_TABLES = ("documents", "pages", "conversations")


class Tables:
    """The tables of one folder as DataFrames, by attribute."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        apply_runtime(spark)

    def __getattr__(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return spread(df) if name in TEXT_TABLES else df


def spread(df: DataFrame) -> DataFrame:
    """Give a text table that makes fewer scan tasks than there are cores to all cores.

    Its texts are costly to take apart and a small file is one task. A table
    with work for every core is returned as it is, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name`` with its SQL counterpart."""

    def register(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql:
            ORACLE[name] = sql
        return fn

    return register


# SQL: lines of the documents, as in line_scan with mode "file"
LINES_SQL = r"""
pieces AS (SELECT doc_id, source, lang, string_split_regex(text, '\r\n|\r|\n') AS p FROM documents),
kept AS (SELECT doc_id, source, lang, CASE WHEN p[len(p)] = '' THEN p[1:len(p) - 1] ELSE p END AS p FROM pieces),
lines AS (SELECT doc_id, source, lang, unnest(range(1, len(p) + 1)) AS line_no, unnest(p) AS line FROM kept)
"""
# SQL: host and path of each page
PATHS_SQL = r"""
paths AS (SELECT page_id, url, html, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host,
                 regexp_extract(url, '^[a-z]+://[^/?#]+/?([^?#]*)', 1) AS path FROM pages)
"""
