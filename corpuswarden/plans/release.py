"""Queries: release decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuswarden.operators import diff
from corpuswarden.operators import release as ops
from corpuswarden.plans.registry import Tables, query

TREE_EDGES_SQL = """
e AS (SELECT p_partkey // 2 AS up, p_partkey AS down FROM part WHERE p_partkey > 0 UNION SELECT p_partkey // 3, p_partkey FROM part WHERE p_partkey > 0 AND p_type = 'LARGE')
"""


@query(
    "dependency_cascade",
    f"""WITH RECURSIVE {TREE_EDGES_SQL}, r(p_partkey, level) AS (SELECT p_partkey, 0 FROM part WHERE p_size = 50 AND p_type IN ('PROMO', 'LARGE')
      UNION SELECT down, level + 1 FROM r JOIN e ON up = r.p_partkey), m AS (SELECT p_partkey, CAST(min(level) AS BIGINT) AS level FROM r GROUP BY 1)
    SELECT p_partkey, CASE WHEN level = 0 THEN 'selected' ELSE 'added' END AS mark, level FROM m""",
)
def _dependency_cascade(t: Tables):
    key = F.col("p_partkey")
    rest = t.part.where(key > 0)
    edges = rest.select(F.floor(key / 2).alias("upstream"), key.alias("downstream")).unionByName(
        rest.where("p_type = 'LARGE'").select(F.floor(key / 3).alias("upstream"), key.alias("downstream"))
    )
    return ops.dependency_cascade(edges, t.part.where("p_size = 50 AND p_type IN ('PROMO', 'LARGE')"), "p_partkey")


@query(
    "receipt_validity",
    """WITH q AS (SELECT DISTINCT user_id, unnest(['signup', 'view', 'review']) AS event_type FROM events),
    l AS (SELECT user_id, event_type, max(ts) AS ts FROM events GROUP BY 1, 2), n AS (SELECT max(ts) AS now FROM events)
    SELECT q.user_id, q.event_type, CASE WHEN ts IS NULL THEN 'MISSING' WHEN now - ts <= INTERVAL 7 DAY THEN 'VALID' ELSE 'EXPIRED' END AS state,
      CAST(floor(epoch_us(now) / 86400000000.0 - epoch_us(ts) / 86400000000.0) AS BIGINT) AS age_days FROM q LEFT JOIN l USING (user_id, event_type), n""",
)
def _receipt_validity(t: Tables):
    required = t.events.select("user_id").distinct().select(
        "user_id", F.explode(F.array(F.lit("signup"), F.lit("view"), F.lit("review"))).alias("event_type")
    )
    latest = t.events.select(F.max("ts")).scalar()
    return ops.receipt_validity(required, t.events, "user_id", "event_type", "ts", latest, 7)


@query(
    "pin_floor_ratchet",
    """WITH v AS (SELECT p_name, max_by(p_size || '.' || (p_partkey // 100) || '.0', (p_size, p_partkey)) AS version FROM part WHERE p_type = 'PROMO' AND p_name <> 'red rod' GROUP BY 1),
    p AS (SELECT p_partkey, p_name, CASE WHEN p_type = 'LARGE' THEN 'dev' ELSE p_size || '.' || (p_partkey // 100) || '.0' END AS floor FROM part),
    c AS (SELECT p.*, version, list_transform(string_split(version, '.'), lambda x: CAST(x AS INTEGER)) AS a, CASE WHEN floor <> 'dev' THEN list_transform(string_split(floor, '.'), lambda x: TRY_CAST(x AS INTEGER)) END AS b
          FROM p LEFT JOIN v USING (p_name))
    SELECT p_partkey, p_name, floor, CASE WHEN version IS NULL THEN 'error' WHEN version = floor THEN 'same' WHEN coalesce(a < b, false) THEN 'kept' ELSE 'raised' END AS action,
      CASE WHEN version IS NULL OR coalesce(a < b, false) THEN floor ELSE version END AS new_floor FROM c""",
)
def _pin_floor_ratchet(t: Tables):
    version = F.concat_ws(".", F.col("p_size").cast("string"), F.floor(F.col("p_partkey") / 100).cast("string"), F.lit("0"))
    pins = t.part.select("p_partkey", "p_name", F.when(F.col("p_type") == "LARGE", "dev").otherwise(version).alias("floor"))
    versions = t.part.where("p_type = 'PROMO' AND p_name <> 'red rod'").groupBy("p_name").agg(
        F.max_by(version, F.struct("p_size", "p_partkey")).alias("version")
    )
    return ops.pin_floor_ratchet(pins, versions, "p_name")


@query(
    "pin_availability",
    """WITH v AS (SELECT p_name, max(p_size) || '.0' AS version FROM part WHERE p_type <> 'PROMO' AND p_name <> 'hot rod' GROUP BY 1),
    pub AS (SELECT DISTINCT p_name, p_size || '.0' AS version FROM part WHERE p_type IN ('SMALL', 'LARGE', 'MEDIUM')), r AS (SELECT DISTINCT p_brand, p_name FROM part)
    SELECT p_brand, p_name, version FROM r JOIN v USING (p_name) WHERE (p_name, version) NOT IN (SELECT (p_name, version) FROM pub)""",
)
def _pin_availability(t: Tables):
    text = lambda c: F.concat(c.cast("string"), F.lit(".0"))
    versions = t.part.where("p_type <> 'PROMO' AND p_name <> 'hot rod'").groupBy("p_name").agg(text(F.max("p_size")).alias("version"))
    published = t.part.where("p_type IN ('SMALL', 'LARGE', 'MEDIUM')").select("p_name", text(F.col("p_size")).alias("version"))
    return ops.pin_availability(t.part, versions, published, "p_brand", "p_name")


@query(
    "version_clamp",
    """WITH p AS (SELECT c_custkey // 10 AS pkg, c_nationkey || '.' || (c_custkey // 7 - (c_custkey // 70) * 10) || '.0' AS version, c_mktsegment AS seg, c_custkey FROM customer),
    pub AS (SELECT DISTINCT pkg, version FROM p WHERE seg IN ('BUILDING', 'MACHINERY')),
    loc AS (SELECT pkg, max_by(version, c_custkey) AS local FROM p GROUP BY 1),
    lat AS (SELECT pkg, max_by(version, list_transform(string_split(version, '.'), lambda x: CAST(x AS INTEGER))) AS latest FROM pub GROUP BY 1)
    SELECT CAST(loc.pkg AS BIGINT) AS pkg, local, CASE WHEN pub.version IS NOT NULL THEN local ELSE coalesce(latest, local) END AS version,
      CASE WHEN pub.version IS NOT NULL THEN 'published' WHEN latest IS NOT NULL THEN 'clamped' ELSE 'local' END AS origin
    FROM loc LEFT JOIN pub ON loc.pkg = pub.pkg AND local = pub.version LEFT JOIN lat ON loc.pkg = lat.pkg""",
)
def _version_clamp(t: Tables):
    key = F.col("c_custkey")
    minor = F.floor(key / 7) - F.floor(key / 70) * 10
    rows = t.customer.select(
        F.floor(key / 10).alias("pkg"), F.concat_ws(".", F.col("c_nationkey").cast("string"), minor.cast("string"), F.lit("0")).alias("version"), "c_mktsegment", "c_custkey"
    )
    local = rows.groupBy("pkg").agg(F.max_by("version", "c_custkey").alias("version"))
    return ops.version_clamp(local, rows.where("c_mktsegment IN ('BUILDING', 'MACHINERY')"), "pkg")


BUILT = {"BUILDING": "1999-06-01", "FURNITURE": "2001-05-01", "HOUSEHOLD": "2001-07-20", "MACHINERY": "2000-01-01"}


@query(
    "freshness_guard",
    """WITH a AS (SELECT c_custkey, CAST(CASE c_mktsegment WHEN 'BUILDING' THEN '1999-06-01' WHEN 'FURNITURE' THEN '2001-05-01' WHEN 'HOUSEHOLD' THEN '2001-07-20' WHEN 'MACHINERY' THEN '2000-01-01' END AS TIMESTAMP) AS built FROM customer),
    n AS (SELECT o_custkey, max(o_orderdate) AS newest FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1)
    SELECT c_custkey, CASE WHEN built IS NULL THEN 'error' WHEN newest > built THEN 'stale' ELSE 'fresh' END AS state FROM a LEFT JOIN n ON c_custkey = o_custkey""",
)
def _freshness_guard(t: Tables):
    built = None
    for segment, day in BUILT.items():
        cond, at = F.col("c_mktsegment") == segment, F.expr(f"TIMESTAMP_NTZ '{day}'")
        built = F.when(cond, at) if built is None else built.when(cond, at)
    inputs = t.orders.select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderdate").alias("mtime"), "o_orderstatus")
    return ops.freshness_guard(t.customer.select("c_custkey", built.alias("built")), inputs, "c_custkey", F.col("o_orderstatus") == "P")


RUNS_SQL = """
ev AS (SELECT user_id || '@' || strftime(ts, '%Y-%m-%d') AS key, user_id || '@' || strftime(ts + INTERVAL 1 DAY, '%Y-%m-%d') AS next_key, ts, event_id, value, CASE WHEN event_type = 'click' THEN 'in_progress' ELSE 'completed' END AS status,
       CASE WHEN event_type = 'error' THEN (CASE WHEN value > 10 THEN 'failure' ELSE 'cancelled' END) WHEN event_type <> 'click' THEN 'success' END AS conclusion FROM events)
"""


def runs(t: Tables):
    """Each event as a run of its user's day, and the key of the day after."""
    kind = F.col("event_type")
    conclusion = F.when(kind == "error", F.when(F.col("value") > 10, "failure").otherwise("cancelled")).when(kind != "click", "success")
    day = lambda ts: F.concat_ws("@", F.col("user_id").cast("string"), F.date_format(ts, "yyyy-MM-dd"))
    return t.events.select(
        day(F.col("ts")).alias("key"), day(F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("next_key"), "ts", "event_id", "value",
        F.when(kind == "click", "in_progress").otherwise("completed").alias("status"), conclusion.alias("conclusion"),
    )


@query(
    "run_verdict",
    f"""WITH {RUNS_SQL}, k AS (SELECT key FROM ev UNION SELECT next_key FROM ev), a AS (SELECT key, count(*) AS n_runs, count(*) FILTER (WHERE status <> 'completed') AS n_pending,
        max_by(conclusion, (ts, event_id)) FILTER (WHERE status = 'completed' AND conclusion <> 'success') AS f FROM ev GROUP BY 1)
    SELECT key, coalesce(n_runs, 0) AS n_runs, coalesce(n_pending, 0) AS n_pending, CASE WHEN n_runs IS NULL THEN 'norun' WHEN n_pending > 0 THEN 'pending' ELSE coalesce(f, 'success') END AS verdict FROM k LEFT JOIN a USING (key)""",
)
def _run_verdict(t: Tables):
    all_runs = runs(t)
    required = all_runs.select(F.explode(F.array("key", "next_key")).alias("key")).distinct()
    return ops.run_verdict(required, all_runs, "key", ["ts", "event_id"])


@query(
    "merge_gate",
    f"""WITH {RUNS_SQL}, q AS (SELECT key, CASE WHEN min(value) < 3 THEN 'BLOCKED' ELSE 'CLEAN' END AS merge_state FROM (SELECT key, value FROM ev UNION ALL SELECT next_key, value FROM ev) GROUP BY 1),
    c AS (SELECT key, count(*) AS n_checks, count(*) FILTER (WHERE NOT (coalesce(conclusion, '') <> '' OR value >= 8)) AS n_pending FROM ev GROUP BY 1)
    SELECT key, merge_state, n_checks, n_pending, CASE WHEN n_checks IS NULL THEN 'ungated' WHEN merge_state = 'BLOCKED' AND n_pending = 0 THEN 'stuck' WHEN merge_state = 'BLOCKED' THEN 'waiting' ELSE 'gated' END AS gate
    FROM q LEFT JOIN c USING (key)""",
)
def _merge_gate(t: Tables):
    all_runs = runs(t)
    opened = all_runs.select(F.explode(F.array("key", "next_key")).alias("key"), "value")
    requests = opened.groupBy("key").agg(F.when(F.min("value") < 3, "BLOCKED").otherwise("CLEAN").alias("merge_state"))
    state = F.when(F.col("value") < 6, "EXPECTED").when(F.col("value") < 8, "PENDING").otherwise("DONE")
    checks = all_runs.select("key", "conclusion", state.alias("state"))
    return ops.merge_gate(requests, checks, "key")


@query(
    "housekeeping_only",
    """SELECT o_orderkey, coalesce(bool_and(l_returnflag IN ('A', 'N')), false) AS housekeeping FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""",
)
def _housekeeping_only(t: Tables):
    changes = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag")
    return ops.housekeeping_only(t.orders, changes, "o_orderkey", F.col("l_returnflag").isin("A", "N"))


@query(
    "release_gate",
    """WITH d AS (SELECT o_custkey, count(*) AS ahead, bool_and(o_orderstatus = 'O') AS hk FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01' GROUP BY 1),
    r AS (SELECT o_custkey, max(o_orderdate) FILTER (WHERE o_orderpriority = '1-URGENT') AS review, max(o_orderdate) FILTER (WHERE o_orderpriority = '2-HIGH') AS tests,
          max(o_orderdate) FILTER (WHERE o_orderpriority = '3-MEDIUM') AS docs FROM orders GROUP BY 1),
    m AS (SELECT c_custkey, coalesce(ahead, 0) AS ahead, coalesce(hk, false) AS hk, (CASE WHEN coalesce(TIMESTAMP '2001-08-01' - review <= INTERVAL 365 DAY, false) THEN 0 ELSE 1 END)
          + (CASE WHEN coalesce(TIMESTAMP '2001-08-01' - tests <= INTERVAL 365 DAY, false) THEN 0 ELSE 1 END) AS n_missing,
          CASE WHEN coalesce(TIMESTAMP '2001-08-01' - docs <= INTERVAL 365 DAY, false) THEN 0 ELSE 1 END AS docs_missing FROM customer LEFT JOIN d ON c_custkey = d.o_custkey LEFT JOIN r ON c_custkey = r.o_custkey)
    SELECT c_custkey, CAST(n_missing AS BIGINT) AS n_missing, CAST(1 AS BIGINT) AS n_waived, CASE WHEN ahead = 0 THEN 'exempt_no_delta' WHEN hk THEN 'exempt_housekeeping' WHEN n_missing > 0 THEN 'blocked' ELSE 'pass' END AS verdict FROM m""",
)
def _release_gate(t: Tables):
    orders = t.orders.withColumnRenamed("o_custkey", "c_custkey")
    deltas = diff.ahead_behind(orders, orders.where("o_orderdate < TIMESTAMP_NTZ '2001-01-01'"), "c_custkey", "o_orderkey")
    house = ops.housekeeping_only(
        t.customer, orders.where("o_orderdate >= TIMESTAMP_NTZ '2001-01-01'"), "c_custkey", F.col("o_orderstatus") == "O"
    )
    checks = {"review": "1-URGENT", "tests": "2-HIGH", "docs": "3-MEDIUM"}
    check = F.create_map(*[F.lit(x) for k, v in checks.items() for x in (v, k)])[F.col("o_orderpriority")]
    receipts = orders.select("c_custkey", check.alias("check"), F.col("o_orderdate").alias("ts")).where("check IS NOT NULL")
    required = t.customer.select("c_custkey", F.explode(F.array(*[F.lit(c) for c in checks])).alias("check"))
    validity = ops.receipt_validity(required, receipts, "c_custkey", "check", "ts", F.expr("TIMESTAMP_NTZ '2001-08-01'"), 365)
    return ops.release_gate(t.customer, deltas, house, validity, "c_custkey", waived=("docs",))


@query(
    "retention_prune",
    """SELECT o_custkey, o_orderkey, o_orderstatus FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING max(o_orderdate) > TIMESTAMP '2001-03-01')""",
)
def _retention_prune(t: Tables):
    entries = t.orders.select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    return ops.retention_prune(entries, "o_custkey", "o_orderdate", F.expr("TIMESTAMP_NTZ '2001-03-01'")).drop("o_orderdate")


@query(
    "latest_is_bump",
    """WITH m AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'click' THEN 'Bump version to ' || event_id WHEN 'view' THEN 'update dependencies & bump version to ' || event_id
        WHEN 'error' THEN 'Revert "Bump version to ' || event_id || '"' ELSE event_type END AS msg FROM events), l AS (SELECT user_id, max_by(msg, (ts, event_id)) AS last_message FROM m GROUP BY 1)
    SELECT *, regexp_matches(last_message, '(?i)^(update dependencies & )?bump version to ') AS is_bump FROM l""",
)
def _latest_is_bump(t: Tables):
    n, kind = F.col("event_id").cast("string"), F.col("event_type")
    message = (
        F.when(kind == "click", F.concat(F.lit("Bump version to "), n))
        .when(kind == "view", F.concat(F.lit("update dependencies & bump version to "), n))
        .when(kind == "error", F.concat(F.lit('Revert "Bump version to '), n, F.lit('"')))
        .otherwise(kind)
    )
    return ops.latest_is_bump(t.events.withColumn("message", message), "user_id", "message", ["ts", "event_id"])
