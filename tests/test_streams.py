"""Streams against the batch answer, and over files that arrive later."""

import os
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from corpuswarden.session import fresh_path
from corpuswarden.streaming import timed

T0 = datetime(2024, 1, 1)
SCHEMA = "k string, id long, ts timestamp, status string, conclusion string"


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def feed(spark, frame, folder, *data):
    frame(SCHEMA, *data).coalesce(1).write.mode("append").parquet(folder)
    return timed.file_stream(spark, folder, "*.parquet", frame(SCHEMA, *data).schema)


def test_new_files_are_audited_by_all_rules_once(spark, frame, rows):
    folder, out = fresh_path(spark, "in"), fresh_path(spark, "audit")
    rules = {
        "bad": lambda df: df.where("conclusion = 'bad'").withColumn("status", F.lit("FAIL")),
        "open": lambda df: df.where("status <> 'completed'").withColumn("status", F.lit("WARN")),
    }
    stream = feed(spark, frame, folder, ("a", 1, at(0), "completed", "bad"), ("a", 2, at(0), "queued", "bad"))
    first = [("bad", 1, "FAIL", 0), ("bad", 2, "FAIL", 0), ("open", 2, "WARN", 0)]
    assert rows(timed.audit_once(stream, rules, "id", out)) == first
    stream = feed(spark, frame, folder, ("a", 3, at(1), "completed", "bad"))
    both = sorted([*first, ("bad", 3, "FAIL", 1)], key=repr)
    assert rows(timed.audit_once(stream, rules, "id", out)) == both
    # a driver lost before it noted the end of the last batch runs that batch again
    commits = out.removeprefix("file://") + "/state/commits/"
    for name in ("1", ".1.crc"):
        os.remove(commits + name)
    assert rows(timed.audit_once(stream, rules, "id", out)) == both


def test_a_table_in_parts_is_streamed_as_one_file_is(spark, frame, rows):
    folder = fresh_path(spark, "in")
    data = [("a", i, at(i), "completed", "ok") for i in range(6)]
    frame(SCHEMA, *data).repartition(3).write.parquet(folder + "/parts.parquet")
    frame(SCHEMA, ("b", 9, at(9), "completed", "ok")).coalesce(1).write.parquet(folder + "/other.parquet")
    stream = timed.file_stream(spark, folder, "parts.parquet", frame(SCHEMA, *data).schema)
    assert rows(timed.run_once(stream, "append"), "id") == [(i,) for i in range(6)]
    (file,) = [f for f in spark.read.parquet(folder + "/other.parquet").inputFiles()]
    stream = timed.file_stream(spark, *file.rsplit("/", 1), frame(SCHEMA, *data).schema)
    assert rows(timed.run_once(stream, "append"), "id") == [(9,)]


def test_receipts_expire_by_timer(spark, frame, rows):
    folder, path = fresh_path(spark, "in"), fresh_path(spark, "state")
    day = 24 * 60

    def folded(*data):
        stream = feed(spark, frame, folder, *data)
        updates = timed.run_once(timed.receipt_state(stream, "k", "status", "ts", "1 hour", timedelta(days=30)), "update", path)
        return timed.upserted(updates, ["k", "status"])

    state = folded(("a", 1, at(0), "review", None), ("a", 2, at(9), "review", None), ("a", 3, at(4), "tests", None))
    assert rows(state) == [("a", "review", at(9), False), ("a", "tests", at(4), False)]
    state = folded(("a", 4, at(20 * day), "tests", None), ("b", 5, at(31 * day), "review", None))
    assert sorted(rows(state)) == [("a", "review", at(9), True), ("a", "tests", at(20 * day), False), ("b", "review", at(31 * day), False)]
    required = frame("k string, status string", ("a", "review"), ("a", "tests"), ("b", "review"), ("c", "review"))
    verdict = timed.receipt_verdict(required, state, "k", "status", F.lit(at(32 * day)), "7 DAY")
    assert rows(verdict, "k", "status", "state") == [("a", "review", "missing"), ("a", "tests", "expired"), ("b", "review", "valid"), ("c", "review", "missing")]


def test_not_visible_only_after_the_wait(spark, frame, rows):
    folders = fresh_path(spark, "in"), fresh_path(spark, "in")
    pubs = [("a", 1, 0), ("a", 2, 5), ("b", 3, 9), ("b", 4, 0), ("c", 5, 198), ("d", 6, 12), ("e", 7, 3), ("z", 8, 300), ("f", 9, 185)]
    seen = [("a", 5), ("b", 19), ("b", 9), ("d", 11), ("d", 35), ("e", 3), ("e", 13), ("z", 200), ("f", 188), ("f", 189)]
    published = feed(spark, frame, folders[0], *[(k, i, at(m), "pub", None) for k, i, m in pubs]).select("k", "id", "ts")
    visible = feed(spark, frame, folders[1], *[(k, 100 + i, at(m), "vis", None) for i, (k, m) in enumerate(seen)]).select("k", "ts")
    out = timed.run_once(timed.visibility_join(published, visible, "k", "id", "ts", timedelta(minutes=10), "1 minute"), "append")
    mark = min(300, 200) - 1

    def want(k, m):
        if any(k == v and m < t <= m + 10 and t // 10 * 10 + 10 <= mark for v, t in seen):
            return "visible"
        return "not_visible" if m + 20 <= mark else None

    expected = {i: want(k, m) for k, i, m in pubs if want(k, m)}
    assert dict(rows(out, "id", "verdict")) == expected and set(expected.values()) == {"visible", "not_visible"} and 5 not in expected


def test_open_bursts_block_and_late_edits_join_them(spark, frame, rows):
    folder, path = fresh_path(spark, "in"), fresh_path(spark, "state")

    def folded(*minutes):
        stream = feed(spark, frame, folder, *[(k, i, at(m), "edit", None) for i, (k, m) in enumerate(minutes)])
        updates = timed.run_once(timed.edit_sessions(stream, "k", "ts", timedelta(minutes=15), "60 minutes"), "update", path)
        return sorted(rows(timed.blocking_sessions(updates, "k")))

    assert folded(("a", 0), ("a", 10), ("a", 30), ("b", 5)) == [("a", at(0), at(25), 2, True), ("a", at(30), at(45), 1, True), ("b", at(5), at(20), 1, True)]
    # 20 joins the two bursts of a; the second row of its later half is taken back
    assert folded(("a", 20), ("b", 31)) == [("a", at(0), at(45), 4, True), ("b", at(5), at(20), 1, True), ("b", at(31), at(46), 1, True)]
    closed = folded(("c", 100))
    assert closed == [("a", at(0), at(45), 4, True), ("b", at(5), at(20), 1, False), ("b", at(31), at(46), 1, True), ("c", at(100), at(115), 1, True)]


def test_bursts_of_many_keys_share_states(spark, frame, rows):
    class State:
        exists = hasTimedOut = False

        def getCurrentWatermarkMs(self):
            return 0

        def update(self, value):
            self.value = value

        def setTimeoutTimestamp(self, at):
            self.at = at

    frames = [timed.pd.Series(x) for x in (["a", "b", None, "a"], [0, 5, 9, 70], [1, 5, 9, 70], [2, 1, 1, 1])]
    state, chunk = State(), dict(zip(("k", "first_us", "ts", "n"), frames))
    chunk["ts"] = timed.pd.to_datetime(chunk["ts"], unit="us")
    (out,) = timed._sessions((1,), iter([chunk]), state, "k", "ts", 50, ["k", "s", "e", "n", "open"])
    assert out.values.tolist() == [["a", 0, 51, 2, True], ["a", 70, 120, 1, True], ["b", 5, 55, 1, True], [None, 9, 59, 1, True]]
    assert state.value == (["a", "a", "b", None], [0, 70, 5, 9], [1, 70, 5, 9], [2, 1, 1, 1])
    # as many keys as it takes, null among them, over few states
    data = [(None if k == 7 else f"k{k}", i, at(k % 5 + 40 * i), "edit", None) for k in range(40) for i in range(3)]
    stream = feed(spark, frame, fresh_path(spark, "in"), *data)
    updates = timed.run_once(timed.edit_sessions(stream, "k", "ts", timedelta(minutes=15), "1 minute", buckets=3), "update")
    got = timed.blocking_sessions(updates, "k")
    expected = [(k, t, t + timedelta(minutes=15), 1, t + timedelta(minutes=15) >= at(83)) for k, _, t, *_ in data]
    assert sorted(rows(got), key=repr) == sorted(expected, key=repr)


def test_mean_over_weeks(spark, frame, rows):
    day = 24 * 60
    data = [("a", i, at(d * day), "x", None) for i, d in enumerate([3, 4, 10, 25, 26, 27, 60])]
    out = timed.run_once(timed.findings_trend(feed(spark, frame, fresh_path(spark, "in"), *data), "k", "ts", "1 hour"), "append")
    # weeks begin on Thursdays: 4 January 2024 is day 3
    got = {(w - T0).days: (n, weeks, most, mean) for w, n, weeks, most, mean in rows(out, "window_start", "n_findings", "n_weeks", "most", "weekly_mean")}
    assert got[3] == (6, 3, 3, 1.5) and got[-18] == (2, 1, 2, 0.5) and got[10] == (4, 2, 3, 1.0)


def test_windows_close(spark, frame, rows):
    data = [
        ("a", 1, at(0), "completed", "success"), ("a", 2, at(10), "completed", "failure"), ("b", 3, at(1), "in_progress", None),
        ("b", 4, at(50), "completed", "success"), ("z", 9, at(500), "completed", "success"),
    ]
    stream = feed(spark, frame, fresh_path(spark, "in"), *data)
    out = timed.run_once(timed.windowed_run_verdict(stream, "k", "ts", "40 minutes", "0 seconds"), "append")
    assert rows(out, "k", "n_runs", "verdict") == [("a", 2, "failure"), ("b", 1, "success"), ("b", 1, "timeout")]
