"""Triage ledgers as data, and classification of deltas through them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEDGER_COLUMNS = ["scope", "pair", "key", "status", "to", "reason"]


def ledger_dataset(parts: dict[str, DataFrame]) -> DataFrame:
    """One long table (scope, pair, key, status, to, reason) out of one frame per
    scope; columns a scope lacks are null, a missing status is ``na``."""
    shaped = []
    for scope, df in parts.items():
        have = {
            c: (F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string")).alias(c)
            for c in LEDGER_COLUMNS[1:]
        }
        have["status"] = F.coalesce(have["status"], F.lit("na")).alias("status")
        shaped.append(df.select(F.lit(scope).alias("scope"), *[have[c] for c in LEDGER_COLUMNS[1:]]))
    return reduce(DataFrame.unionByName, shaped)


def ledger_conflicts(ledger: DataFrame) -> DataFrame:
    """Keys entered more than once in the same scope and pair."""
    return ledger.groupBy("scope", "pair", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def ledger_triage(deltas: DataFrame, ledger: DataFrame, first_key: list[str], second_key: list[str]) -> DataFrame:
    """Bucket of each delta: pending, triaged or untriaged.

    Two lookups by different delta columns against the ledger's (pair, key), the
    first hit counts; the detail carries status, target and reason."""
    out = deltas
    hits = []
    for i, (pair, key) in enumerate((first_key, second_key)):
        entry = ledger.groupBy(F.col("pair").alias(f"_p{i}"), F.col("key").alias(f"_k{i}")).agg(
            F.min(F.struct(F.coalesce("status", F.lit("na")).alias("status"), "to", "reason")).alias(f"_e{i}")
        )
        out = out.join(
            entry, (F.col(pair).cast("string") == F.col(f"_p{i}")) & (F.col(key).cast("string") == F.col(f"_k{i}")), "left"
        ).drop(f"_p{i}", f"_k{i}")
        hits.append(f"_e{i}")
    e = F.coalesce(*hits)
    arrow = F.when(e["to"] != "", F.concat(F.lit(" -> "), e["to"])).otherwise("")
    detail = F.concat(F.lit("["), e["status"], arrow, F.lit("] "), F.coalesce(e["reason"], F.lit("")))
    return out.withColumn(
        "bucket",
        F.when(e.isNull(), "untriaged").when(e["status"] == "pending", "pending").otherwise("triaged"),
    ).withColumn("detail", detail).drop(*hits)


def status_summary(rows: DataFrame, pair: str, klass: str, classes: list[str], gap: str, open_: str) -> DataFrame:
    """Counts per pair and class as columns, and the pair's status: GAP, open or OK."""
    aggs = [F.count_if(F.col(klass) == c).alias(f"n_{c}") for c in classes]
    return rows.groupBy(pair).agg(*aggs).withColumn(
        "status",
        F.when(F.col(f"n_{gap}") > 0, "GAP").when(F.col(f"n_{open_}") > 0, "open").otherwise("OK"),
    )


def sweep_verdict(summary: DataFrame) -> DataFrame:
    """One row; the sweep fails on any pair with a gap."""
    return summary.agg(
        F.count(F.lit(1)).alias("n_pairs"), F.count_if(F.col("status") == "GAP").alias("n_gaps")
    ).withColumn("verdict", F.when(F.col("n_gaps") > 0, "FAIL").otherwise("OK"))
