"""Queries: comparisons of two or three sides, and triage through ledgers."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuswarden.functions.text import content_digest
from corpuswarden.operators import diff, ledger
from corpuswarden.plans.registry import LINES_SQL, Tables, query
from corpuswarden.plans.scans import document_lines


def later_parts(t: Tables):
    """A second snapshot of the parts: one size withdrawn, one brand dearer, one type doubled under new keys."""
    p = t.part.where(F.col("p_size") != 13)
    price = F.when(F.col("p_brand") == "Brand#3", F.col("p_retailprice") + 1).otherwise(F.col("p_retailprice"))
    size = F.when(F.col("p_brand") == "Brand#4", F.col("p_size") + 1).otherwise(F.col("p_size"))
    kept = p.withColumn("p_retailprice", price).withColumn("p_size", size)
    return kept.unionByName(p.where(F.col("p_type") == "SMALL").withColumn("p_partkey", -1 - F.col("p_partkey")))


LATER_SQL = """
later AS (SELECT p_partkey, p_name, p_brand, p_type, CASE WHEN p_brand = 'Brand#4' THEN p_size + 1 ELSE p_size END AS p_size,
            CASE WHEN p_brand = 'Brand#3' THEN p_retailprice + 1 ELSE p_retailprice END AS p_retailprice FROM part WHERE p_size <> 13
          UNION ALL SELECT -1 - p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part WHERE p_size <> 13 AND p_type = 'SMALL')
"""


@query(
    "snapshot_diff",
    f"""WITH {LATER_SQL}
    SELECT coalesce(o.p_partkey, n.p_partkey) AS p_partkey, CASE WHEN o.p_partkey IS NULL THEN 'added' WHEN n.p_partkey IS NULL THEN 'removed' ELSE 'changed' END AS change,
      o.p_retailprice AS old_value, n.p_retailprice AS new_value FROM part o FULL JOIN later n ON o.p_partkey = n.p_partkey
    WHERE o.p_retailprice IS DISTINCT FROM n.p_retailprice""",
)
def _snapshot_diff(t: Tables):
    return diff.snapshot_diff(t.part, later_parts(t), ["p_partkey"], "p_retailprice")


@query(
    "surface_drift",
    """WITH s AS (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS k FROM lineitem GROUP BY 1, 2),
    r AS (SELECT l_orderkey, l_linenumber + CASE WHEN l_tax > 0.07 THEN 10 ELSE 0 END AS l_linenumber, min(CASE WHEN l_quantity > 45 THEN 'X' ELSE l_returnflag END) AS k FROM lineitem GROUP BY 1, 2)
    SELECT coalesce(s.l_orderkey, r.l_orderkey) AS l_orderkey, coalesce(s.l_linenumber, r.l_linenumber) AS l_linenumber,
      CASE WHEN r.l_orderkey IS NULL THEN 'missing' WHEN s.l_orderkey IS NULL THEN 'added' ELSE 'kind_changed' END AS drift,
      CASE WHEN r.l_orderkey IS NULL THEN 'FAIL' ELSE 'WARN' END AS severity, s.k AS static_kind, r.k AS runtime_kind
    FROM s FULL JOIN r ON s.l_orderkey = r.l_orderkey AND s.l_linenumber = r.l_linenumber
    WHERE s.k IS DISTINCT FROM r.k AND coalesce(s.l_orderkey, r.l_orderkey) IN (SELECT l_orderkey FROM s)
      AND coalesce(s.l_orderkey, r.l_orderkey) IN (SELECT l_orderkey FROM r)""",
)
def _surface_drift(t: Tables):
    kind = F.when(F.col("l_quantity") > 45, "X").otherwise(F.col("l_returnflag"))
    static = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("kind"))
    moved = F.col("l_linenumber") + F.when(F.col("l_tax") > 0.07, 10).otherwise(0)
    runtime = t.lineitem.select("l_orderkey", moved.alias("l_linenumber"), kind.alias("kind"))
    return diff.surface_drift(static, runtime, "l_orderkey", "l_linenumber", "kind")


@query(
    "twin_control_diff",
    """WITH a AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_linestatus = 'O'),
    b AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_linestatus = 'F'),
    h AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_quantity < 6),
    st AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_discount > 0.09),
    lg AS (SELECT l_suppkey, l_partkey, min(CASE WHEN l_returnflag = 'A' THEN 'pending' ELSE 'na' END) AS s FROM lineitem WHERE l_tax > 0.06 GROUP BY 1, 2)
    SELECT a.l_suppkey, a.l_partkey, CASE WHEN h.l_suppkey IS NOT NULL THEN 'hidden' WHEN st.l_suppkey IS NOT NULL THEN 'static_equiv'
       WHEN lg.s = 'pending' THEN 'pending' WHEN lg.s IS NOT NULL THEN 'triaged' ELSE 'untriaged' END AS class
    FROM a LEFT JOIN b USING (l_suppkey, l_partkey) LEFT JOIN h USING (l_suppkey, l_partkey) LEFT JOIN st USING (l_suppkey, l_partkey)
    LEFT JOIN lg USING (l_suppkey, l_partkey) WHERE b.l_suppkey IS NULL""",
)
def _twin_control_diff(t: Tables):
    rows, keys = t.lineitem, ["l_suppkey", "l_partkey"]
    part = lambda cond: rows.where(cond).select(*keys)
    listed = rows.where("l_tax > 0.06").select(*keys, F.when(F.col("l_returnflag") == "A", "pending").otherwise("na").alias("status"))
    # 'na' sorts before 'pending', as min() picks in the ledger
    return diff.twin_control_diff(
        part("l_linestatus = 'O'"), part("l_linestatus = 'F'"), keys, part("l_quantity < 6"), part("l_discount > 0.09"), listed
    )


HANDLER_SQL = """
ev AS (SELECT user_id, event_type || (CAST(json_extract(props, '$.k') AS INTEGER) // 10) AS name, value, ts FROM events),
a AS (SELECT DISTINCT user_id, name FROM ev WHERE ts < TIMESTAMP '2024-01-16'
      UNION SELECT DISTINCT user_id, name || '_init' FROM ev WHERE ts < TIMESTAMP '2024-01-16' AND value > 10),
b AS (SELECT DISTINCT user_id, name FROM ev WHERE ts >= TIMESTAMP '2024-01-16'),
lg AS (SELECT user_id, name, min(CASE WHEN value > 32 THEN 'pending' ELSE 'renamed' END) AS s FROM ev WHERE value BETWEEN 28 AND 40 GROUP BY 1, 2),
ui AS (SELECT DISTINCT user_id, name FROM ev WHERE value BETWEEN 4 AND 12),
hid AS (SELECT DISTINCT user_id, name FROM ev WHERE value < 5),
ac AS (SELECT DISTINCT user_id, name FROM ev WHERE value > 15 AND ts < TIMESTAMP '2024-01-16'),
bc AS (SELECT DISTINCT user_id, name FROM ev WHERE ts >= TIMESTAMP '2024-01-10'),
rf AS (SELECT user_id, name FROM ev GROUP BY 1, 2 HAVING count(*) > 1)
"""


@query(
    "handler_diff",
    f"""WITH {HANDLER_SQL}, m AS (SELECT a.user_id, a.name, regexp_replace(a.name, '_init$', '') AS base FROM a ANTI JOIN b USING (user_id, name))
    SELECT m.user_id, m.name, CASE WHEN coalesce(l1.s, l2.s) = 'pending' THEN 'pending' WHEN coalesce(l1.s, l2.s) IS NOT NULL THEN 'triaged'
      WHEN ui.name IS NOT NULL AND hid.name IS NOT NULL THEN 'hidden' WHEN ui.name IS NOT NULL AND ends_with(m.name, '_init') AND b.name IS NOT NULL THEN 'partly_built'
      WHEN ui.name IS NOT NULL THEN 'unhandled' WHEN ac.name IS NOT NULL AND bc.name IS NOT NULL THEN 'wiring' WHEN ac.name IS NOT NULL THEN 'covered'
      WHEN rf.name IS NOT NULL THEN 'internal' ELSE 'stale' END AS class
    FROM m LEFT JOIN lg l1 ON m.user_id = l1.user_id AND m.name = l1.name LEFT JOIN lg l2 ON m.user_id = l2.user_id AND m.base = l2.name
    LEFT JOIN ui ON m.user_id = ui.user_id AND m.base = ui.name LEFT JOIN hid ON m.user_id = hid.user_id AND m.base = hid.name
    LEFT JOIN ac ON m.user_id = ac.user_id AND m.base = ac.name LEFT JOIN bc ON m.user_id = bc.user_id AND m.base = bc.name
    LEFT JOIN rf ON m.user_id = rf.user_id AND m.base = rf.name LEFT JOIN b ON m.user_id = b.user_id AND m.base = b.name""",
)
def _handler_diff(t: Tables):
    tens = F.floor(F.get_json_object("props", "$.k").cast("int") / 10).cast("string")
    ev = t.events.select("user_id", F.concat("event_type", tens).alias("name"), "value", "ts")
    names = lambda cond: ev.where(cond).select("user_id", "name")
    early, late = "ts < TIMESTAMP_NTZ '2024-01-16'", "ts >= TIMESTAMP_NTZ '2024-01-16'"
    inits = ev.where(f"{early} AND value > 10").select("user_id", F.concat("name", F.lit("_init")).alias("name"))
    listed = ev.where("value BETWEEN 28 AND 40").select("user_id", "name", F.when(F.col("value") > 32, "pending").otherwise("renamed").alias("status"))
    referenced = ev.groupBy("user_id", "name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("user_id", "name")
    return diff.handler_diff(
        names(early).unionByName(inits), names(late), "user_id", "name",
        ui=names("value BETWEEN 4 AND 12"), hidden=names("value < 5"),
        a_controls=names(f"value > 15 AND {early}"), b_controls=names("ts >= TIMESTAMP_NTZ '2024-01-10'"),
        referenced=referenced, ledger=listed,
    )


@query(
    "multiset_deficit",
    """WITH e AS (SELECT user_id, event_type, count(*) FILTER (WHERE value > 12) AS n_a, count(*) FILTER (WHERE value <= 12) AS n_b FROM events GROUP BY 1, 2)
    SELECT user_id, event_type, n_a, n_b FROM e WHERE n_b < n_a""",
)
def _multiset_deficit(t: Tables):
    return diff.multiset_deficit(t.events.where("value > 12"), t.events.where("value <= 12"), ["user_id", "event_type"])


@query(
    "property_delta",
    f"""WITH {LATER_SQL}, pair AS (SELECT p.p_partkey, p.p_size AS s1, n.p_size AS s2, CASE WHEN p.p_type = 'PROMO' THEN true END AS c1,
         CASE WHEN n.p_type = 'PROMO' AND n.p_size < 30 THEN true WHEN n.p_type = 'LARGE' THEN false END AS c2,
         p.p_brand AS b1, CASE WHEN n.p_name = 'hot rod' THEN NULL ELSE n.p_brand END AS b2, p.p_retailprice AS r1, n.p_retailprice AS r2 FROM part p JOIN later n USING (p_partkey)),
    cells AS (SELECT p_partkey, 'p_size' AS property, CAST(s1 AS VARCHAR) AS a_value, CAST(s2 AS VARCHAR) AS b_value FROM pair
      UNION ALL SELECT p_partkey, 'checked', CAST(coalesce(c1, false) AS VARCHAR), CAST(coalesce(c2, false) AS VARCHAR) FROM pair
      UNION ALL SELECT p_partkey, 'p_brand', b1, b2 FROM pair
      UNION ALL SELECT p_partkey, 'cents', CAST(CAST(round(r1 * 100) AS BIGINT) AS VARCHAR), CAST(CAST(round(r2 * 100) AS BIGINT) AS VARCHAR) FROM pair)
    SELECT * FROM cells WHERE a_value IS DISTINCT FROM b_value
      AND NOT EXISTS (SELECT 1 FROM part x WHERE x.p_partkey = cells.p_partkey AND x.p_size > 40 AND cells.property = 'cents')""",
)
def _property_delta(t: Tables):
    cents = F.round(F.col("p_retailprice") * 100).cast("long").alias("cents")
    promo, large = F.col("p_type") == "PROMO", F.col("p_type") == "LARGE"
    a = t.part.select("p_partkey", "p_size", "p_name", F.when(promo, True).alias("checked"), "p_brand", cents)
    b = later_parts(t).select(
        "p_partkey", "p_size", F.upper("p_name").alias("p_name"),
        F.when(promo & (F.col("p_size") < 30), True).when(large, False).alias("checked"),
        F.when(F.col("p_name") != "hot rod", F.col("p_brand")).alias("p_brand"), cents,
    )
    accepted = t.part.where("p_size > 40").select(F.concat(F.col("p_partkey").cast("string"), F.lit(".cents")).alias("key_property"))
    return diff.property_delta(
        a, b, "p_partkey", ["p_size", "p_name", "checked", "p_brand", "cents"], ("checked",), ("p_name",), accepted
    )


@query(
    "item_list_delta",
    """WITH c AS (SELECT l_orderkey, l_linenumber, count(*) FILTER (WHERE l_linestatus = 'O') AS a, count(*) FILTER (WHERE l_linestatus = 'F') AS b FROM lineitem GROUP BY 1, 2),
    k AS (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linestatus) = 2)
    SELECT l_orderkey, l_linenumber, CASE WHEN b = 0 THEN 'missing' ELSE 'extra' END AS delta, greatest(a, b) AS n FROM c SEMI JOIN k USING (l_orderkey) WHERE a = 0 OR b = 0""",
)
def _item_list_delta(t: Tables):
    return diff.item_list_delta(
        t.lineitem.where("l_linestatus = 'O'"), t.lineitem.where("l_linestatus = 'F'"), "l_orderkey", "l_linenumber"
    )


SIDE_SQL = """
sold AS (SELECT l_returnflag, l_partkey, s_nationkey < 12 AS is_a FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)
"""


def sold_parts(t: Tables):
    """Parts sold by suppliers of two groups of nations."""
    s = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    return t.lineitem.join(s, "l_suppkey").select("l_returnflag", "l_partkey", (F.col("s_nationkey") < 12).alias("is_a"))


@query(
    "side_extras",
    f"""WITH {SIDE_SQL} SELECT l_returnflag || ':' || l_partkey AS key FROM sold GROUP BY 1 HAVING NOT bool_or(is_a)
    EXCEPT SELECT 'R:' || p_partkey FROM part WHERE p_type = 'PROMO'""",
)
def _side_extras(t: Tables):
    s = sold_parts(t).withColumn("key", F.concat_ws(":", "l_returnflag", F.col("l_partkey").cast("string")))
    renames = t.part.where("p_type = 'PROMO'").select(F.concat(F.lit("R:"), F.col("p_partkey").cast("string")).alias("to"))
    return diff.side_extras(s.where("is_a"), s.where("NOT is_a"), "key", renames)


@query(
    "name_set_ops",
    f"""WITH {SIDE_SQL} SELECT l_returnflag, l_partkey, CASE WHEN bool_and(is_a) THEN 'a_only' WHEN bool_or(is_a) THEN 'both' ELSE 'b_only' END AS side FROM sold GROUP BY 1, 2""",
)
def _name_set_ops(t: Tables):
    s = sold_parts(t)
    return diff.name_set_ops(s.where("is_a"), s.where("NOT is_a"), "l_returnflag", "l_partkey")


@query(
    "three_way_merge",
    """WITH m AS (SELECT p_partkey, p_type, p_name AS b, CASE WHEN p_size < 15 THEN 'left ' || p_name WHEN p_size = 16 THEN NULL WHEN p_size = 17 THEN '' ELSE p_name END AS l, p_size <> 18 AS in_l,
        CASE WHEN p_brand IN ('Brand#1', 'Brand#2') THEN 'right ' || p_name WHEN p_size = 12 THEN 'left ' || p_name ELSE p_name END AS r, p_brand <> 'Brand#5' AS in_r FROM part),
    j AS (SELECT p_partkey, p_type, b, CASE WHEN in_l THEN l END AS l, in_l, CASE WHEN in_r THEN r END AS r, in_r FROM m),
    d AS (SELECT *, CASE WHEN in_l = in_r AND l IS NOT DISTINCT FROM r THEN 'same' WHEN in_l AND l IS NOT DISTINCT FROM b THEN 'right' WHEN in_r AND r IS NOT DISTINCT FROM b THEN 'left'
       WHEN p_type = 'PROMO' THEN 'conflict_right' ELSE 'conflict' END AS rule FROM j),
    o AS (SELECT *, CASE WHEN rule IN ('right', 'conflict_right') THEN r WHEN rule <> 'conflict' THEN l END AS merged, CASE WHEN rule IN ('right', 'conflict_right') THEN in_r ELSE in_l END AS present FROM d)
    SELECT p_partkey, merged, rule, CASE WHEN present AND rule <> 'conflict' AND length(coalesce(merged, '')) < 6 THEN 'refused' WHEN rule = 'conflict' THEN 'failed' ELSE 'ok' END AS outcome
    FROM o WHERE present OR rule = 'conflict'""",
)
def _three_way_merge(t: Tables):
    size, name, brand = F.col("p_size"), F.col("p_name"), F.col("p_brand")
    left = t.part.where("p_size <> 18").withColumn(
        "p_name", F.when(size < 15, F.concat(F.lit("left "), name)).when(size == 16, None).when(size == 17, "").otherwise(name)
    )
    right = t.part.where("p_brand <> 'Brand#5'").withColumn(
        "p_name",
        F.when(brand.isin("Brand#1", "Brand#2"), F.concat(F.lit("right "), name)).when(size == 12, F.concat(F.lit("left "), name)).otherwise(name),
    )
    policy = t.part.where("p_type = 'PROMO'").select("p_partkey")
    return diff.three_way_merge(t.part, left, right, "p_partkey", "p_name", policy, min_length=6)


@query(
    "ahead_behind",
    """SELECT o_custkey, count(*) FILTER (WHERE a AND NOT b) AS ahead, count(*) FILTER (WHERE b AND NOT a) AS behind FROM
      (SELECT o_custkey, o_orderdate < TIMESTAMP '1999-01-01' AS a, o_orderdate >= TIMESTAMP '1997-01-01' AS b FROM orders) GROUP BY 1""",
)
def _ahead_behind(t: Tables):
    a, b = t.orders.where("o_orderdate < TIMESTAMP_NTZ '1999-01-01'"), t.orders.where("o_orderdate >= TIMESTAMP_NTZ '1997-01-01'")
    return diff.ahead_behind(a, b, "o_custkey", "o_orderkey")


@query(
    "added_lines",
    f"""WITH {LINES_SQL}, old AS (SELECT doc_id, line, count(*) AS had FROM lines WHERE NOT regexp_matches(line, '[aeiou]\\.$') AND line_no <> 3 GROUP BY 1, 2),
    n AS (SELECT doc_id, line_no, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY line_no) AS k FROM lines)
    SELECT doc_id, count(*) AS n_added, sha256(trim(string_agg(line, chr(10) ORDER BY line_no))) AS digest FROM n LEFT JOIN old USING (doc_id, line) WHERE k > coalesce(had, 0) GROUP BY 1""",
)
def _added_lines(t: Tables):
    new = document_lines(t)
    old = new.where(~F.col("line").rlike(r"[aeiou]\.$") & (F.col("line_no") != 3))
    added = diff.added_lines(old, new, ["doc_id"])
    counts = added.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_added"))
    text = diff.join_lines(added, ["doc_id"], "text")
    return counts.join(text, "doc_id").select("doc_id", "n_added", content_digest(F.col("text")).alias("digest"))


@query(
    "staleness_gate",
    """SELECT doc_id, CASE WHEN lang = 'de' THEN 'missing' WHEN lang = 'fr' AND length(text) > 0 THEN 'stale' ELSE 'fresh' END AS state FROM documents WHERE source <> 'src0'""",
)
def _staleness_gate(t: Tables):
    # spanish texts differ in cosmetics only, french ones in content, german ones are missing
    fresh = t.documents
    text, lang = F.col("text"), F.col("lang")
    cosmetic = F.concat(F.lit("_Generated: yesterday_\n"), F.replace(text, F.lit("\n"), F.lit("  \r\n")))
    committed = fresh.where(lang != "de").withColumn(
        "text", F.when(lang == "fr", F.concat(text, F.lit("\nmore"))).when(lang == "es", cosmetic).otherwise(text)
    )
    gated = t.documents.where("source <> 'src0'").select("doc_id")
    return diff.staleness_gate(committed, fresh, "doc_id", "text").join(gated, "doc_id", "left_semi")


@query(
    "mirror_drift",
    r"""WITH d AS (SELECT doc_id, text, regexp_extract(text, '^([^\n]*)', 1) AS head FROM documents),
    s AS (SELECT head, min_by(text, doc_id) AS t FROM d GROUP BY 1 HAVING count(*) > 1)
    SELECT md5(head) AS head, doc_id, CASE WHEN d.text = s.t THEN 'agree' ELSE 'drift' END AS state FROM d JOIN s USING (head)""",
)
def _mirror_drift(t: Tables):
    docs = t.documents.select("doc_id", F.md5(F.regexp_extract("text", r"^([^\n]*)", 1)).alias("head"), "text")
    source = docs.groupBy("head").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n")).where("n > 1").select("head", "doc_id")
    return diff.mirror_drift(docs, docs.join(source, ["head", "doc_id"], "left_semi"), "head", "text", "doc_id")


@query(
    "ledger_triage",
    """WITH lg AS (SELECT CAST(o_custkey AS VARCHAR) AS pair, o_orderpriority AS key, min((CASE WHEN o_orderstatus = 'P' THEN 'pending' ELSE 'renamed' END,
          CASE WHEN o_orderstatus = 'F' THEN 'closed' ELSE '' END, 'seen')) AS e FROM orders WHERE o_totalprice > 450000 GROUP BY 1, 2),
    g AS (SELECT c_mktsegment AS pair, CAST(c_custkey AS VARCHAR) AS key FROM customer WHERE c_acctbal < 0)
    SELECT o_orderkey, CASE WHEN lg.e IS NULL AND g.pair IS NULL THEN 'untriaged' WHEN lg.e IS NOT NULL AND lg.e[1] = 'pending' THEN 'pending' ELSE 'triaged' END AS bucket,
      CASE WHEN lg.e IS NOT NULL THEN '[' || lg.e[1] || CASE WHEN lg.e[2] <> '' THEN ' -> ' || lg.e[2] ELSE '' END || '] seen' WHEN g.pair IS NOT NULL THEN '[na] overdrawn' END AS detail
    FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN lg ON CAST(o_custkey AS VARCHAR) = lg.pair AND o_orderpriority = lg.key
    LEFT JOIN g ON c_mktsegment = g.pair AND CAST(o_custkey AS VARCHAR) = g.key""",
)
def _ledger_triage(t: Tables):
    deltas = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", "o_custkey", "o_orderpriority", "c_mktsegment"
    )
    big = t.orders.where("o_totalprice > 450000").select(
        F.col("o_custkey").alias("pair"), F.col("o_orderpriority").alias("key"),
        F.when(F.col("o_orderstatus") == "P", "pending").otherwise("renamed").alias("status"),
        F.when(F.col("o_orderstatus") == "F", "closed").otherwise("").alias("to"), F.lit("seen").alias("reason"),
    )
    overdrawn = t.customer.where("c_acctbal < 0").select(
        F.col("c_mktsegment").alias("pair"), F.col("c_custkey").alias("key"), F.lit("overdrawn").alias("reason")
    )
    book = ledger.ledger_dataset({"orders": big, "customers": overdrawn})
    out = ledger.ledger_triage(deltas, book, ["o_custkey", "o_orderpriority"], ["c_mktsegment", "o_custkey"])
    return out.select("o_orderkey", "bucket", "detail")


@query(
    "ledger_dataset",
    """WITH l AS (SELECT 'controls' AS scope, lang AS pair, CAST(doc_id AS VARCHAR) AS key, CASE WHEN quality = 0 THEN 'pending' ELSE 'na' END AS status FROM labels JOIN documents USING (doc_id)
      UNION ALL SELECT 'handlers', lang, source, 'na' FROM documents WHERE n_chars > 3000)
    SELECT scope, pair, key, count(*) AS n FROM l GROUP BY 1, 2, 3 HAVING count(*) > 1""",
)
def _ledger_dataset(t: Tables):
    status = F.when(F.col("quality") == 0, "pending").alias("status")
    controls = t.labels.join(t.documents, "doc_id").select(F.col("lang").alias("pair"), F.col("doc_id").alias("key"), status)
    handlers = t.documents.where("n_chars > 3000").select(F.col("lang").alias("pair"), F.col("source").alias("key"))
    return ledger.ledger_conflicts(ledger.ledger_dataset({"controls": controls, "handlers": handlers}))


@query(
    "status_summary",
    """WITH c AS (SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_untriaged, count(*) FILTER (WHERE o_orderstatus = 'P') AS n_pending,
        count(*) FILTER (WHERE o_orderstatus = 'O') AS n_triaged FROM orders GROUP BY 1)
    SELECT *, CASE WHEN n_untriaged > 0 THEN 'GAP' WHEN n_pending > 0 THEN 'open' ELSE 'OK' END AS status FROM c""",
)
def _status_summary(t: Tables):
    status = F.col("o_orderstatus")
    rows = t.orders.select(
        "o_custkey", F.when(status == "F", "untriaged").when(status == "P", "pending").otherwise("triaged").alias("class")
    )
    return ledger.status_summary(rows, "o_custkey", "class", ["untriaged", "pending", "triaged"], "untriaged", "pending")
