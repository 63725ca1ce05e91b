"""Queries: the streaming checks, drained over what lies in the table's folder.

Append mode gives only what the watermark has closed; the SQL cuts the rest in
the same way, from the latest event time.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from corpuswarden.operators import filters
from corpuswarden.plans.registry import Tables, query
from corpuswarden.streaming import timed

STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def event_stream(t: Tables):
    """Events as a stream, with instants in place of timestamps without zone."""
    stream = timed.file_stream(t.spark, t.folder, "events.parquet", t.events.schema)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def stamped(df, *columns: str):
    for c in columns:
        df = df.withColumn(c, F.date_format(c, STAMP))
    return df


@query(
    "stream_corpus_audit",
    r"""SELECT 'budget' AS "check", doc_id, CASE WHEN strlen(text) > 4000 THEN 'FAIL' ELSE 'WARN' END AS status FROM documents WHERE strlen(text) > 2000 OR strlen(text) < 20
      UNION ALL SELECT 'stub', doc_id, 'WARN' FROM documents WHERE strlen(trim(text, E' \t\n\r')) < 20
      UNION ALL SELECT 'heading', doc_id, 'FAIL' FROM documents WHERE regexp_matches(text, '(?i)(^|\n)(copyright|all rights reserved|license)[^\n]*')""",
)
def _stream_corpus_audit(t: Tables):
    docs = timed.file_stream(t.spark, t.folder, "documents.parquet", t.documents.schema)

    def budget(df):
        sized = filters.size_budget(df, F.octet_length("text"), F.lit(2000), F.lit(4000))
        return sized.where("status <> 'OK'")

    def stub(df):
        return df.where(F.octet_length(F.trim("text", F.lit(" \t\n\r"))) < 20).withColumn("status", F.lit("WARN"))

    def heading(df):
        return df.where(F.col("text").rlike(r"(?i)(^|\n)(copyright|all rights reserved|license)[^\n]*")).withColumn("status", F.lit("FAIL"))

    return timed.audit_once(docs, {"budget": budget, "stub": stub, "heading": heading}, "doc_id").drop("batch_id")


@query(
    "stream_receipt_state",
    """WITH e AS (SELECT user_id, event_type || '/' || CAST(floor(value) AS BIGINT) AS "check", ts FROM events),
    m AS (SELECT max(ts) AS now, epoch_ms(max(ts)) - 3600000 AS mark FROM events),
    l AS (SELECT user_id, "check", max(ts) AS latest FROM e GROUP BY 1, 2)
    SELECT user_id, "check", CASE WHEN epoch_ms(latest) + 30 * CAST(86400000 AS BIGINT) < mark THEN 'missing' WHEN latest + INTERVAL 7 DAY >= now THEN 'valid' ELSE 'expired' END AS state,
      CASE WHEN epoch_ms(latest) + 30 * CAST(86400000 AS BIGINT) >= mark THEN strftime(latest, '%Y-%m-%d %H:%M:%S.%f') END AS latest FROM l, m
    UNION ALL SELECT DISTINCT user_id, 'review', 'missing', NULL FROM events""",
)
def _stream_receipt_state(t: Tables):
    check = F.concat_ws("/", "event_type", F.floor("value").cast("string")).alias("check")
    updates = timed.run_once(
        timed.receipt_state(event_stream(t).select("user_id", check, "ts"), "user_id", "check", "ts", "1 hour", timedelta(days=30)), "update"
    )
    required = t.events.select("user_id", check).unionByName(t.events.select("user_id", F.lit("review").alias("check")))
    as_of = t.events.select(F.max(F.col("ts").cast("timestamp"))).scalar()
    return stamped(timed.receipt_verdict(required, timed.upserted(updates, ["user_id", "check"]), "user_id", "check", as_of, "7 DAY"), "latest")


@query(
    "stream_visibility_join",
    """WITH p AS (SELECT user_id, event_id AS pub_id, ts FROM events WHERE event_type = 'signup'), v AS (SELECT user_id, ts FROM events WHERE event_type = 'purchase'),
    w AS (SELECT least((SELECT max(ts) FROM p), (SELECT max(ts) FROM v)) - INTERVAL 1 HOUR AS mark),
    s AS (SELECT user_id, time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS d, ts FROM v),
    hit AS (SELECT DISTINCT pub_id FROM p JOIN s ON p.user_id = s.user_id AND s.ts > p.ts AND s.ts <= p.ts + INTERVAL 1 DAY, w WHERE d + INTERVAL 1 DAY <= mark)
    SELECT user_id, pub_id, CASE WHEN pub_id IN (SELECT pub_id FROM hit) THEN 'visible' ELSE 'not_visible' END AS verdict
    FROM p, w WHERE pub_id IN (SELECT pub_id FROM hit) OR ts + INTERVAL 2 DAY <= mark""",
)
def _stream_visibility_join(t: Tables):
    published = event_stream(t).where("event_type = 'signup'").select("user_id", F.col("event_id").alias("pub_id"), "ts")
    visible = event_stream(t).where("event_type = 'purchase'").select("user_id", "ts")
    return timed.run_once(timed.visibility_join(published, visible, "user_id", "pub_id", "ts", timedelta(days=1), "1 hour"), "append")


@query(
    "stream_run_verdict",
    """WITH e AS (SELECT user_id, time_bucket(INTERVAL 40 MINUTE, ts, TIMESTAMP '1970-01-01') AS s, CASE WHEN event_type = 'click' THEN 'in_progress' ELSE 'completed' END AS st, CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END AS c FROM events),
    g AS (SELECT user_id, s, count(*) AS n_runs, count(*) FILTER (WHERE st <> 'completed') AS n_pending, count(*) FILTER (WHERE st = 'completed' AND c <> 'success') AS n_failed FROM e GROUP BY 1, 2)
    SELECT user_id, strftime(s, '%Y-%m-%d %H:%M:%S.%f') AS window_start, n_runs, n_pending, n_failed, CASE WHEN n_pending > 0 THEN 'timeout' WHEN n_failed > 0 THEN 'failure' ELSE 'success' END AS verdict
    FROM g WHERE s + INTERVAL 40 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""",
)
def _stream_run_verdict(t: Tables):
    kind = F.col("event_type")
    runs = event_stream(t).select(
        "user_id", "ts",
        F.when(kind == "click", "in_progress").otherwise("completed").alias("status"),
        F.when(kind == "error", "failure").otherwise("success").alias("conclusion"),
    )
    out = timed.run_once(timed.windowed_run_verdict(runs, "user_id", "ts", "40 minutes", "1 hour"), "append")
    return stamped(out.drop("window_end"), "window_start")


@query(
    "stream_edit_sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 8 HOUR THEN 0 ELSE 1 END AS b FROM events),
    i AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM g), s AS (SELECT user_id, n, min(ts) AS a, max(ts) + INTERVAL 8 HOUR AS z, count(*) AS n_edits FROM i GROUP BY 1, 2)
    SELECT user_id, strftime(a, '%Y-%m-%d %H:%M:%S.%f') AS session_start, strftime(z, '%Y-%m-%d %H:%M:%S.%f') AS session_end, n_edits,
      epoch_ms(z) >= (SELECT epoch_ms(max(ts)) - 3600000 FROM events) AS blocking FROM s""",
)
def _stream_edit_sessions(t: Tables):
    updates = timed.run_once(timed.edit_sessions(event_stream(t), "user_id", "ts", timedelta(hours=8), "1 hour"), "update")
    return stamped(timed.blocking_sessions(updates, "user_id"), "session_start", "session_end")


@query(
    "stream_findings_trend",
    """WITH f AS (SELECT event_type || '/' || user_id AS c, ts FROM events WHERE event_type IN ('error', 'click')), m AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM f),
    k AS (SELECT c, time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS s, count(*) AS n FROM f GROUP BY 1, 2),
    r AS (SELECT c, s - INTERVAL 7 DAY * j AS s, n FROM k, m, (SELECT unnest([0, 1, 2, 3]) AS j) WHERE s + INTERVAL 7 DAY <= mark)
    SELECT c AS "check", 7 AS days, strftime(s, '%Y-%m-%d %H:%M:%S.%f') AS window_start, n AS n_findings, CAST(n AS DOUBLE) AS weekly_mean FROM k, m WHERE s + INTERVAL 7 DAY <= mark
    UNION ALL SELECT c, 28, strftime(s, '%Y-%m-%d %H:%M:%S.%f'), CAST(sum(n) AS BIGINT), sum(n) / 4.0 FROM r, m WHERE s + INTERVAL 28 DAY <= mark GROUP BY 1, 2, 3""",
)
def _stream_findings_trend(t: Tables):
    def found():
        check = F.concat_ws("/", "event_type", F.col("user_id").cast("string")).alias("check")
        return event_stream(t).where("event_type IN ('error', 'click')").select(check, "ts")

    weekly = timed.run_once(timed.weekly_findings(found(), "check", "ts", "1 hour"), "append")
    trend = timed.run_once(timed.findings_trend(found(), "check", "ts", "1 hour"), "append")
    both = weekly.select("check", F.lit(7).alias("days"), "window_start", "n_findings", F.col("n_findings").cast("double").alias("weekly_mean")).unionByName(
        trend.select("check", F.lit(28).alias("days"), "window_start", "n_findings", "weekly_mean")
    )
    return stamped(both, "window_start")
