"""Streaming checks, and how to run one over what is there now.

Each check but the audit is a streaming DataFrame to DataFrame function, free of sinks.
Two keep state of their own per key, with timers in event time, in a few lines of
Python; what reaches them is reduced in every task before.
``run_once`` drains the source with the availableNow trigger into parquet under
the shared folder: state, offsets and results all survive lost executors, and
nothing passes through the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from datetime import timedelta
from functools import partial, reduce

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from corpuswarden.session import apply_runtime, fresh_path


def file_stream(spark: SparkSession, folder: str, glob: str, schema: StructType) -> DataFrame:
    """Stream of the parquet files in a folder, new files as they arrive.

    What the pattern matches may itself be a folder, a table written in parts: then its files count."""
    # in braces any name is a pattern: Spark takes a plain path for a folder
    return spark.readStream.schema(schema).parquet(f"{folder}/{{{glob}}}")


def run_once(stream: DataFrame, mode: str, path: str | None = None) -> DataFrame:
    """Drain the stream and return its result as a batch table.

    append: the file sink, which writes each result once. update: one folder per
    batch, so that a batch that is replayed replaces itself; the rows carry
    ``batch_id`` and the caller folds them (the last one per key holds)."""
    spark = stream.sparkSession
    apply_runtime(spark)
    path = path or fresh_path(spark, "stream")
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", path + "/state")
    schema = StructType(list(stream.schema.fields))
    if mode == "append":
        writer = writer.format("parquet").option("path", path + "/out")
    else:
        schema = schema.add("batch_id", "long")

        def store(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(f"{path}/out/batch_id={batch_id}")

        writer = writer.foreachBatch(store)
    writer.start().awaitTermination()
    return _table_of(spark, path, schema)


def _table_of(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """What a drained stream wrote below ``path``; empty if its source had nothing."""
    try:
        return spark.read.schema(schema).parquet(path + "/out")
    except AnalysisException as missing:  # no batch ran
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])


def audit_once(
    docs: DataFrame, rules: dict[str, Callable[[DataFrame], DataFrame]], key: str, path: str | None = None
) -> DataFrame:
    """Findings of several batch rules on new files only: ``check``, ``key``, ``status``, ``batch_id``.

    Each rule maps documents to rows with ``key`` and ``status``. All rules of a batch
    are written at once to the folder of that batch, so a batch that is replayed
    after a failure replaces its own findings and adds none."""
    spark = docs.sparkSession
    apply_runtime(spark)
    path = path or fresh_path(spark, "audit")

    def store(batch: DataFrame, batch_id: int) -> None:
        found = [rule(batch).select(F.lit(check).alias("check"), key, "status") for check, rule in rules.items()]
        reduce(DataFrame.unionByName, found).write.mode("overwrite").parquet(f"{path}/out/batch_id={batch_id}")

    docs.writeStream.foreachBatch(store).trigger(availableNow=True).option("checkpointLocation", path + "/state").start().awaitTermination()
    schema = StructType([StructField("check", StringType()), docs.schema[key], StructField("status", StringType()), StructField("batch_id", LongType())])
    return _table_of(spark, path, schema)


def upserted(updates: DataFrame, keys: list[str]) -> DataFrame:
    """The last row of each key over all batches of an update stream.

    A replayed batch replaces its own folder, so the fold gives the same whenever it is run."""
    rest = [c for c in updates.columns if c not in (*keys, "batch_id")]
    last = updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("_row"))
    return last.select(*keys, "_row.*")


def receipt_state(events: DataFrame, key: str, check: str, ts: str, watermark: str, keep: timedelta) -> DataFrame:
    """Latest time per (key, check), let go by a timer once the watermark is ``keep`` past it:
    an update stream of ``latest`` and ``expired``.

    The state of a key holds its checks that are not let go yet. Each task sends the
    latest time of a pair only, so a hot pair is a few rows per batch."""
    fields = [events.schema[key], events.schema[check]]
    newest = events.select(key, check, ts).mapInArrow(partial(_newest, keys=[key, check], ts=ts), StructType([*fields, events.schema[ts]]))
    out = StructType([*fields, StructField("latest", LongType()), StructField("expired", BooleanType())])
    state = StructType([StructField("checks", ArrayType(fields[1].dataType)), StructField("latest", ArrayType(LongType()))])
    grouped = newest.withWatermark(ts, watermark).groupBy(key)
    update = partial(_receipts, check=check, ts=ts, keep_us=keep // timedelta(microseconds=1), names=out.names)
    rows = grouped.applyInPandasWithState(update, out, state, "update", GroupStateTimeout.EventTimeTimeout)
    return rows.withColumn("latest", F.timestamp_micros("latest"))


def _newest(batches: Iterator[pa.RecordBatch], keys: list[str], ts: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            best = pa.Table.from_batches([batch]).group_by(keys).aggregate([(ts, "max")]).rename_columns([*keys, ts])
            yield from best.combine_chunks().to_batches()


def _micros(times: pd.Series) -> list[int]:
    """Instants as whole microseconds; the times of a batch are without zone, in UTC."""
    return times.to_numpy().astype("datetime64[us]").astype("int64").tolist()


def _frame(key: tuple, rows: list[tuple], names: list[str]) -> pd.DataFrame:
    """Rows of one key. Times stay whole numbers: to make and convert them key by key costs more than all else."""
    columns = [[k] * len(rows) for k in key] + [list(c) for c in zip(*rows)]
    return pd.DataFrame(dict(zip(names, columns)))


def _receipts(
    key: tuple, frames: Iterator[pd.DataFrame], state: GroupState, check: str, ts: str, keep_us: int, names: list[str]
) -> Iterator[pd.DataFrame]:
    held = dict(zip(*state.get)) if state.exists else {}
    newer: dict = {}
    if not state.hasTimedOut:
        for f in frames:
            for name, at in zip(f[check].tolist(), _micros(f[ts])):
                known = newer.get(name, held.get(name))
                if known is None or at > known:
                    newer[name] = at
    mark = state.getCurrentWatermarkMs()
    ends = lambda at: (at + keep_us) // 1000
    now = held | newer
    left = {name: at for name, at in now.items() if ends(at) >= mark}
    if left:
        state.update((list(left), list(left.values())))
        state.setTimeoutTimestamp(max(min(map(ends, left.values())), mark + 1))
    elif state.exists:
        state.remove()
    rows = [(name, at, name not in left) for name, at in now.items() if name in newer or name not in left]
    if rows:
        yield _frame(key, rows, names)


def receipt_verdict(required: DataFrame, receipts: DataFrame, key: str, check: str, as_of: Column, valid: str) -> DataFrame:
    """valid, expired or missing for each required pair, from the folded rows of ``receipt_state``.

    A receipt is valid up to ``valid`` of age, expired until the state lets it go, then
    missing, as one that never was."""
    held = receipts.where(~F.col("expired")).select(key, check, "latest")
    age = F.when(F.col("latest") + F.expr(f"INTERVAL {valid}") >= as_of, "valid").otherwise("expired")
    verdict = F.when(F.col("latest").isNull(), "missing").otherwise(age)
    return required.select(key, check).distinct().join(held, [key, check], "left").select(key, check, verdict.alias("state"), "latest")


def visibility_join(published: DataFrame, visible: DataFrame, key: str, pub_id: str, ts: str, within: timedelta, watermark: str) -> DataFrame:
    """visible or not_visible for each published row of a stream, by a second stream.

    It became visible if some visible event came after it within the wait. First and
    last event of each key in slices as long as the wait are all that can matter:
    either the last one of its own slice lies after it, or the first one of the
    next slice still lies within the wait. So a published row meets two slices
    at most, however many events its key has. An outer interval join with watermarks
    on both sides holds it until its slices are closed, then says not visible and
    lets it go; of two slices that fit the first counts."""
    seconds = within // timedelta(seconds=1)
    wait, both = (F.expr(f"INTERVAL {n * seconds} SECONDS") for n in (1, 2))
    slices = (
        visible.withWatermark(ts, watermark)
        .groupBy(key, F.window(ts, f"{seconds} seconds").alias("w"))
        .agg(F.min(F.unix_micros(ts)).alias("_first"), F.max(F.unix_micros(ts)).alias("_last"))
        .select(F.col(key).alias("_key"), F.window_time("w").alias("_end"), "_first", "_last")
    )
    asked = published.withWatermark(ts, watermark).select(key, pub_id, ts)
    near = (F.col(key) == F.col("_key")) & (F.col("_end") >= F.col(ts)) & (F.col("_end") < F.col(ts) + both)
    # plain numbers: a bound on times here would let rows go before their slices are closed
    hit = (F.col("_last") > F.unix_micros(ts)) & (F.col("_first") <= F.unix_micros(F.col(ts) + wait))
    verdict = F.when(F.col("_key").isNotNull(), "visible").otherwise("not_visible")
    joined = asked.join(slices, near & hit, "left_outer").select(key, pub_id, ts, verdict.alias("verdict"))
    return joined.dropDuplicatesWithinWatermark([key, pub_id]).select(key, pub_id, "verdict")


def windowed_run_verdict(runs: DataFrame, key: str, ts: str, wait: str, watermark: str) -> DataFrame:
    """Counts of finished, failed and unfinished runs per key and waiting window."""
    return (
        runs.withWatermark(ts, watermark)
        .groupBy(key, F.window(ts, wait).alias("w"))
        .agg(
            F.count(F.lit(1)).alias("n_runs"),
            F.count_if(F.col("status") != "completed").alias("n_pending"),
            F.count_if((F.col("status") == "completed") & (F.col("conclusion") != "success")).alias("n_failed"),
        )
        .select(
            key,
            F.col("w.start").alias("window_start"),
            F.col("w.end").alias("window_end"),
            "n_runs",
            "n_pending",
            "n_failed",
            F.when(F.col("n_pending") > 0, "timeout").when(F.col("n_failed") > 0, "failure").otherwise("success").alias("verdict"),
        )
    )


#: Groups of keys that share one state, so that Python is called per group of keys.
BUCKETS = 1_024


def edit_sessions(edits: DataFrame, key: str, ts: str, gap: timedelta, watermark: str, buckets: int = BUCKETS) -> DataFrame:
    """Bursts of edits of each key, split where the gap is reached: an update stream of
    ``session_start``, ``session_end`` (last edit and gap), ``n_edits`` and ``open``.

    A burst is given out while it is open, again whenever it grows, and once more by a
    timer when the watermark has passed its end. ``upserted`` by key and start
    folds the rows; a burst that a late edit joined to an earlier one is taken
    back by a row without edits. Each task sends bursts, not edits. A state holds the
    open bursts of all keys of one of ``buckets`` groups, a number that must stay the
    same for one checkpoint; keys, of any type that a text is cast back to, travel as texts."""
    kind, us = edits.schema[key], gap // timedelta(microseconds=1)
    spans = StructType([StructField(key, StringType()), edits.schema[ts], StructField("first_us", LongType()), StructField("n", LongType())])
    bursts = edits.select(F.col(key).cast("string").alias(key), ts).mapInArrow(partial(_bursts, ts=ts, gap=us), spans)
    out = StructType([StructField(key, StringType()), *[StructField(n, LongType()) for n in ("session_start", "session_end", "n_edits")], StructField("open", BooleanType())])
    state = StructType([StructField("key", ArrayType(StringType())), *[StructField(n, ArrayType(LongType())) for n in ("first", "last", "n")]])
    grouped = bursts.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets))).withWatermark(ts, watermark).groupBy("_bucket")
    update = partial(_sessions, name=key, ts=ts, gap=us, names=out.names)
    rows = grouped.applyInPandasWithState(update, out, state, "update", GroupStateTimeout.EventTimeTimeout)
    return rows.select(F.col(key).cast(kind.dataType).alias(key), *[F.timestamp_micros(n).alias(n) for n in ("session_start", "session_end")], "n_edits", "open")


def _merged(spans: Iterable[tuple[int, int, int]], gap: int) -> list[tuple[int, int, int]]:
    """Spans of first, last and number, those joined that are less than the gap apart."""
    out: list[tuple[int, int, int]] = []
    for first, last, n in sorted(spans):
        if out and first - out[-1][1] < gap:
            out[-1] = (out[-1][0], max(last, out[-1][1]), out[-1][2] + n)
        else:
            out.append((first, last, n))
    return out


def _bursts(batches: Iterator[pa.RecordBatch], ts: str, gap: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        times: dict = {}
        for k, at in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.int64()).to_pylist()):
            if at is not None:
                times.setdefault(k, []).append((at, at, 1))
        # the time of a burst is that of its last edit, so that the watermark is that of the edits
        rows = [(k, last, first, n) for k, spans in times.items() for first, last, n in _merged(spans, gap)]
        if rows:
            kinds = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.int64()]
            columns = [pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)]
            columns[1] = columns[1].cast(batch.schema.field(1).type)
            yield pa.RecordBatch.from_arrays(columns, [batch.schema.names[0], ts, "first_us", "n"])


def _sessions(
    bucket: tuple, frames: Iterator[pd.DataFrame], state: GroupState, name: str, ts: str, gap: int, names: list[str]
) -> Iterator[pd.DataFrame]:
    held: dict = {}
    for k, *span in zip(*state.get) if state.exists else ():
        held.setdefault(k, []).append(tuple(span))
    fresh: dict = {}
    if not state.hasTimedOut:
        for f in frames:
            for k, *span in zip(f[name].tolist(), f["first_us"].tolist(), _micros(f[ts]), f["n"].tolist()):
                fresh.setdefault(k, []).append(tuple(span))
    mark = state.getCurrentWatermarkMs()
    ends = lambda s: (s[1] + gap) // 1000
    rows, left = [], []
    for k in held | fresh:
        known = held.get(k, [])
        now = _merged([*known, *fresh[k]], gap) if k in fresh else known
        rows += [(k, first, 0, 0, False) for first in {h[0] for h in known} - {s[0] for s in now}]
        rows += [(k, s[0], s[1] + gap, s[2], ends(s) >= mark) for s in now if ends(s) < mark or s not in known]
        left += [(k, *s) for s in now if ends(s) >= mark]
    if left:
        state.update(tuple(map(list, zip(*left))))
        state.setTimeoutTimestamp(max(min(ends(s[1:]) for s in left), mark + 1))
    elif state.exists:
        state.remove()
    if rows:
        yield pd.DataFrame(dict(zip(names, map(list, zip(*rows)))))


def blocking_sessions(updates: DataFrame, key: str) -> DataFrame:
    """All bursts, folded; ``blocking`` while one is open."""
    folded = upserted(updates, [key, "session_start"]).where("n_edits > 0")
    return folded.select(key, "session_start", "session_end", "n_edits", F.col("open").alias("blocking"))


def findings_trend(log: DataFrame, check: str, ts: str, watermark: str, weeks: int = 4) -> DataFrame:
    """Findings per check over sliding runs of weeks, and their mean per week: weekly
    counts, and a second aggregate over these in the same stream."""
    week, run = "7 days", f"{7 * weeks} days"
    weekly = (
        log.withWatermark(ts, watermark)
        .groupBy(check, F.window(ts, week).alias("w"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(check, F.window_time("w").alias("_at"), "n")
    )
    return (
        weekly.groupBy(check, F.window("_at", run, week).alias("w"))
        .agg(F.sum("n").alias("n_findings"), F.count(F.lit(1)).alias("n_weeks"), F.max("n").alias("most"))
        .select(check, F.col("w.start").alias("window_start"), "n_findings", "n_weeks", "most", (F.col("n_findings") / weeks).alias("weekly_mean"))
    )


def weekly_findings(log: DataFrame, check: str, ts: str, watermark: str) -> DataFrame:
    """Findings per check and week."""
    return (
        log.withWatermark(ts, watermark)
        .groupBy(check, F.window(ts, "7 days").alias("w"))
        .agg(F.count(F.lit(1)).alias("n_findings"))
        .select(check, F.col("w.start").alias("window_start"), "n_findings")
    )
