"""Findings, user-supplied rules and the verdict over all of them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FINDINGS = "check string, severity string, key string, detail string"
ALL = "ALL"

Rule = Callable[[dict[str, DataFrame]], DataFrame]


def findings(df: DataFrame, check: str, severity: Column | str, key: Column, detail: Column) -> DataFrame:
    """Rows as findings: check, severity (OK, WARN, FAIL or SKIP), key, detail."""
    level = F.lit(severity) if isinstance(severity, str) else severity
    return df.select(
        F.lit(check).alias("check"), level.alias("severity"), key.cast("string").alias("key"), detail.cast("string").alias("detail")
    )


def audit_rule(name: str, rule: Rule, tables: dict[str, DataFrame], spark: SparkSession) -> DataFrame:
    """Findings of one rule: a function from named tables to findings columns.

    A rule whose input is absent or whose plan cannot be built is reported as
    SKIP, it does not end the audit."""
    try:
        out = rule(tables)
        return out.select(F.lit(name).alias("check"), "severity", F.col("key").cast("string"), F.col("detail").cast("string"))
    except (KeyError, AnalysisException) as problem:
        note = f"{type(problem).__name__}: {problem}".split("\n")[0]
        return spark.range(1).select(
            F.lit(name).alias("check"), F.lit("SKIP").alias("severity"), F.lit(None).cast("string").alias("key"), F.lit(note).alias("detail")
        )


def run_rules(rules: dict[str, Rule], tables: dict[str, DataFrame], spark: SparkSession) -> DataFrame:
    """All findings of all rules in one plan."""
    return reduce(DataFrame.unionByName, [audit_rule(n, r, tables, spark) for n, r in rules.items()])


def gate_verdict(all_findings: DataFrame, checks: list[str], strict: tuple[str, ...] = ()) -> DataFrame:
    """One row per check and one over all: counts by severity and the verdict.

    FAIL fails, WARN never does, unless its check is listed in ``strict``. A SKIP
    shows as a warning. A check without findings is clean, one that is not in the
    input at all is listed with zero counts. ``alert`` on the total row is the
    first failing check in the order of ``checks``."""
    spark = all_findings.sparkSession
    severity = F.when((F.col("severity") == "WARN") & F.col("check").isin(*strict), "FAIL").otherwise(F.col("severity"))
    expected = spark.range(1).select(F.explode(F.array(*[F.lit(c) for c in checks])).alias("check"))
    counted = all_findings.groupBy("check", severity.alias("severity")).agg(F.count(F.lit(1)).alias("_n"))
    merged = counted.unionByName(
        expected.select("check", F.lit(None).cast("string").alias("severity"), F.lit(0).cast("long").alias("_n"))
    )
    sums = [
        F.coalesce(F.sum(F.when(F.col("severity") == s, F.col("_n"))), F.lit(0)).alias(f"n_{s.lower()}")
        for s in ("OK", "WARN", "FAIL", "SKIP")
    ]
    rank = F.array_position(F.array(*[F.lit(c) for c in checks]), F.col("check"))
    failing = F.when(F.col("severity") == "FAIL", rank)
    rolled = merged.rollup("check").agg(F.grouping("check").alias("_g"), *sums, F.min(failing).alias("_first"))
    return rolled.select(
        F.when(F.col("_g") == 1, ALL).otherwise(F.col("check")).alias("check"),
        "n_ok",
        "n_warn",
        "n_fail",
        "n_skip",
        F.when(F.col("n_fail") > 0, "FAIL")
        .when((F.col("n_warn") > 0) | (F.col("n_skip") > 0), "WARN")
        .otherwise("OK")
        .alias("verdict"),
        F.when(F.col("_g") == 1, F.get(F.array(*[F.lit(c) for c in checks]), (F.col("_first") - 1).cast("int"))).alias("alert"),
    )
