"""Sinks: write on change, sidecars, report lines and the run log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuswarden.functions.ordered import positions
from corpuswarden.functions.text import short_digest
from corpuswarden.session import materialize


def group_digest(rows: DataFrame, group: list[str], entry: Column, out: str = "digest") -> DataFrame:
    """Digest of each group's set of entries, independent of their order.

    A tree of hashes: entries meet in buckets by the first six digits of their own
    MD5, buckets by the first three, those in the group; each level hashes the
    sorted hashes below it. The upper levels hold 4,096 hashes at most and the
    16.7 million lowest buckets share a group evenly, so no task holds a whole
    group. Entries should be unique (carry the row key)."""
    level = rows.select(*group, F.md5(entry).alias("_h"), F.substring(F.md5(entry), 1, 6).alias("_b"))
    for digits in (3, 0):
        folded = F.md5(F.array_join(F.array_sort(F.collect_list("_h")), "\n"))
        level = level.groupBy(*group, "_b").agg(folded.alias("_d")).select(
            *group, F.concat_ws(":", "_b", "_d").alias("_h"), F.substring("_b", 1, digits).alias("_b")
        )
    return level.groupBy(*group).agg(short_digest(F.array_join(F.array_sort(F.collect_list("_h")), "\n")).alias(out))


def changed_artifacts(fresh: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """Each fresh artifact with what writing it would do: created, updated or unchanged."""
    old = manifest.select(key, F.col("digest").alias("_old"), F.lit(True).alias("_had"))
    return fresh.join(old, key, "left").select(
        *fresh.columns,
        F.when(F.col("_had").isNull(), "created")
        .when(~F.col("digest").eqNullSafe(F.col("_old")), "updated")
        .otherwise("unchanged")
        .alias("action"),
    )


def write_if_changed(artifacts: DataFrame, key: str, digest: Column, path: str) -> int:
    """Write the artifacts whose content differs from what lies under ``path``.

    One folder per artifact key, its digest kept beside it; returns how many were
    written, so a second run with the same content returns 0."""
    spark = artifacts.sparkSession
    fresh = artifacts.withColumn("digest", digest)
    try:
        manifest = spark.read.parquet(path).select(key, "digest").withColumn(key, F.col(key).cast(fresh.schema[key].dataType))
    except Exception as missing:  # first run: no folder yet
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        manifest = fresh.select(key, "digest").limit(0)
    changed = changed_artifacts(fresh, manifest, key).where(F.col("action") != "unchanged").drop("action")
    # the plan reads the folder it is about to replace parts of: fix its rows first
    changed, n = materialize(changed, "changed")
    if n:
        (
            changed.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(key)
            .parquet(path)
        )
    return n


def json_sidecar(
    rows: DataFrame, group: str, item: Column, item_key: Column, chunk: int = 10_000
) -> DataFrame:
    """Nested JSON records: each has the group, its full count and up to about
    ``chunk`` items. A large group spreads over several records (part, parts)."""
    counts = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n_items"))
    parts = F.greatest(F.ceil(F.col("n_items") / F.lit(chunk)), F.lit(1)).cast("long")
    placed = rows.select(group, item.alias("item"), F.xxhash64(item_key).alias("_h")).join(counts, group)
    return (
        placed.withColumn("parts", parts)
        .groupBy(group, "n_items", "parts", F.expr("pmod(_h, parts)").alias("part"))
        .agg(F.collect_list("item").alias("items"))
        .select(group, "part", F.to_json(F.struct(group, "n_items", "part", "parts", "items")).alias("payload"))
    )


def report_lines(
    rows: DataFrame, artifact: str, order: list[str], line: Column, heading: Column
) -> DataFrame:
    """Report as rows (artifact, seq, line): one heading per artifact, then its lines.

    ``heading`` may use ``n_rows``. Artifacts without rows do not appear."""
    counts = rows.groupBy(artifact).agg(F.count(F.lit(1)).alias("n_rows"))
    heads = counts.select(artifact, F.lit(1).cast("long").alias("seq"), heading.alias("line"))
    body = positions(rows.select(artifact, *order, line.alias("line")), [F.col(o) for o in order], [artifact], "_pos")
    return heads.unionByName(body.select(artifact, (F.col("_pos") + 1).alias("seq"), "line"))


def write_report(lines: DataFrame, artifact: str, path: str) -> None:
    """Text files per artifact with the lines in order; a long report is split in
    several range-partitioned files whose names sort in order."""
    (
        lines.repartitionByRange(artifact, "seq")
        .sortWithinPartitions(artifact, "seq")
        .select(artifact, F.col("line").alias("value"))
        .write.mode("overwrite")
        .partitionBy(artifact)
        .text(path)
    )


def run_log_append(findings: DataFrame, path: str, run_id: str, run_ts: Column) -> None:
    """Append one run's findings to the log, partitioned by day.

    Appending the same run twice is not detected, as in any append-only log."""
    (
        findings.withColumn("run_id", F.lit(run_id))
        .withColumn("run_ts", run_ts)
        .withColumn("run_date", F.to_date("run_ts"))
        .write.mode("append")
        .partitionBy("run_date")
        .parquet(path)
    )


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
