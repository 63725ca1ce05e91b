"""Queries: aggregations, collisions, coverage, verdicts over findings, set relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuswarden.functions.ordered import top_k
from corpuswarden.functions.text import percent, percent_text, split_lines
from corpuswarden.operators import gate, integrity, measure
from corpuswarden.operators.sequence import fence_mask
from corpuswarden.plans.registry import LINES_SQL, PATHS_SQL, Tables, query
from corpuswarden.plans.scans import document_lines, page_paths

PAIR = ("src0", "src14")


@query(
    "inventory_rollup",
    f"""WITH {LINES_SQL}, f AS (SELECT doc_id, source, count(line) AS n, count(*) FILTER (WHERE trim(line) <> '') AS ne FROM lines GROUP BY 1, 2)
    SELECT CASE WHEN grouping(d.source) = 1 THEN 'TOTAL' ELSE d.source END AS source, count(*) AS n_files, CAST(sum(coalesce(n, 0)) AS BIGINT) AS total_lines,
      CAST(sum(coalesce(ne, 0)) AS BIGINT) AS nonempty_lines, bool_or(lang = 'es') AS has_es, bool_or(n_chars > 5000) AS has_long
    FROM documents d LEFT JOIN f USING (doc_id) GROUP BY ROLLUP (d.source)""",
)
def _inventory_rollup(t: Tables):
    lines = split_lines(F.col("text"), "file")
    files = t.documents.select(
        "source", "lang", "n_chars", F.size(lines).cast("long").alias("n_lines"),
        F.size(F.filter(lines, lambda x: F.trim(x) != "")).cast("long").alias("n_nonempty"),
    )
    return measure.inventory_rollup(files, "source", {"has_es": F.col("lang") == "es", "has_long": F.col("n_chars") > 5000})


@query(
    "module_tree_counts",
    f"""WITH {PATHS_SQL}, f AS (SELECT host, path || CASE WHEN path LIKE '%/' THEN 'init' WHEN path LIKE '%.html' THEN '' ELSE '.html' END AS rel FROM paths),
    g AS (SELECT host, CASE WHEN rel LIKE 'en/%' THEN rel[4:] ELSE rel END AS rel FROM f),
    p AS (SELECT host, string_split(rel, '/') AS s FROM g)
    SELECT host, count(DISTINCT CASE WHEN s[-1] = 'init' AND len(s) = 2 THEN s[1] END) AS n_subpackages,
      count(DISTINCT CASE WHEN s[-1] LIKE '%.html' AND len(s) = 1 THEN s[1] END) AS n_modules, count(*) FILTER (WHERE s[-1] LIKE '%.html') AS n_recursive FROM p GROUP BY 1""",
)
def _module_tree_counts(t: Tables):
    path = F.col("path")
    rel = F.concat(path, F.when(path.endswith("/"), "init").when(path.endswith(".html"), "").otherwise(".html"))
    files = page_paths(t).select("host", F.regexp_replace(rel, "^en/", "").alias("rel"))
    return measure.module_tree_counts(files, "host", "rel", "init", ".html")


@query(
    "dominant_values",
    """WITH c AS (SELECT p_brand, p_name, count(*) AS n FROM part GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_name) AS rank FROM c)
    SELECT p_brand, CAST(rank AS INTEGER) AS rank, p_name || ' (' || n || ')' AS label FROM r WHERE rank <= 5""",
)
def _dominant_values(t: Tables):
    return measure.dominant_values(t.part, "p_brand", "p_name")


@query(
    "non_repo_folders",
    """SELECT source, count(*) FILTER (WHERE lang = 'es') AS n_es, CAST(sum(CASE WHEN n_chars > 8000 THEN n_chars ELSE 0 END) AS BIGINT) AS long_chars FROM documents
    WHERE source NOT IN ('src0', 'src1', 'src2') GROUP BY 1 HAVING count(*) FILTER (WHERE lang = 'es') > 0 OR sum(CASE WHEN n_chars > 8000 THEN n_chars ELSE 0 END) > 0""",
)
def _non_repo_folders(t: Tables):
    return measure.non_repo_folders(
        t.documents, "source", ["src0", "src1", "src2"],
        {"n_es": F.col("lang") == "es", "long_chars": F.when(F.col("n_chars") > 8000, F.col("n_chars")).otherwise(0)},
    )


COLLIDE_SQL = f"""
{LINES_SQL},
clean AS (SELECT doc_id, source, line_no, rtrim(line) AS line FROM lines),
hits AS (SELECT line, count(DISTINCT source) AS n_groups, count(*) AS n_rows,
         CASE WHEN count(DISTINCT source) = 2 AND bool_and(source IN ('src0', 'src14')) THEN 'intended' ELSE 'genuine' END AS kind FROM clean GROUP BY 1 HAVING count(DISTINCT source) > 1)
"""


@query(
    "cross_group_collisions",
    f"WITH {COLLIDE_SQL} SELECT line, source, doc_id, line_no, n_groups, n_rows, kind FROM clean JOIN hits USING (line)",
)
def _cross_group_collisions(t: Tables):
    lines = document_lines(t, "source").select("source", "doc_id", "line_no", F.rtrim("line").alias("line"))
    hits = measure.cross_group_collisions(lines, "line", "source", PAIR)
    return measure.collision_occurrences(lines, hits, "line")


@query(
    "name_coverage",
    """WITH s AS (SELECT l_returnflag AS m, l_partkey, s_nationkey < 12 AS a FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE NOT (l_returnflag = 'N' AND s_nationkey >= 12)),
    x AS (SELECT m, false AS is_total, l_partkey, a FROM s UNION ALL SELECT 'TOTAL', true, l_partkey, a FROM s), f AS (SELECT m, is_total, l_partkey, bool_or(a) AS a, bool_or(NOT a) AS b FROM x GROUP BY 1, 2, 3),
    c AS (SELECT m AS l_returnflag, is_total, count(*) FILTER (WHERE a) AS n_a, count(*) FILTER (WHERE b) AS n_b, count(*) FILTER (WHERE a AND b) AS n_shared FROM f GROUP BY 1, 2)
    SELECT *, CAST(round_even(100.0::DOUBLE * n_shared / nullif(n_a, 0), 0) AS BIGINT) AS pct, n_a > 0 AND n_b = 0 AS absent FROM c""",
)
def _name_coverage(t: Tables):
    s = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    sold = t.lineitem.select("l_returnflag", "l_partkey", "l_suppkey").join(s, "l_suppkey")
    return measure.name_coverage(
        sold.where("s_nationkey < 12"), sold.where("s_nationkey >= 12 AND l_returnflag <> 'N'"), "l_returnflag", "l_partkey"
    )


@query(
    "domain_coverage",
    """WITH h AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
    f AS (SELECT lang, doc_id, coalesce(good, false) AS good, coalesce(toxic, false) AND lang <> 'es' AS toxic FROM documents LEFT JOIN h USING (doc_id)),
    r AS (SELECT CASE WHEN grouping(lang) = 1 THEN 'TOTAL' ELSE lang END AS lang, count(*) AS n_items, count(*) FILTER (WHERE good) AS g, count(*) FILTER (WHERE toxic) AS x FROM f GROUP BY ROLLUP (lang)),
    l AS (SELECT lang, 'good' AS provider, n_items, g AS n_handled FROM r UNION ALL SELECT lang, 'toxic', n_items, x FROM r)
    SELECT *, n_items - n_handled AS n_missing, CASE WHEN lang = 'TOTAL' OR n_handled > 0 THEN CAST(round_even(100.0::DOUBLE * n_handled / n_items, 0) AS BIGINT) END AS pct FROM l""",
)
def _domain_coverage(t: Tables):
    items = t.documents.select("lang", F.col("doc_id").cast("string").alias("doc_id"))
    marked = t.labels.join(t.documents.select("doc_id", "lang"), "doc_id")
    init = F.concat(F.col("doc_id").cast("string"), F.lit("_init")).alias("doc_id")
    # the second provider has nothing for spanish, and names its handlers by the longer form
    handlers = (
        marked.where("quality = 1").select("lang", F.col("doc_id").cast("string").alias("doc_id"), F.lit("good").alias("provider"))
        .unionByName(marked.where("toxic = 1 AND lang <> 'es'").select("lang", init, F.lit("toxic").alias("provider")))
    )
    providers = ["good", "toxic"]
    flagged = measure.handled_items(items, handlers, "lang", "doc_id", providers)
    return measure.domain_coverage(flagged, handlers, "lang", providers)


@query(
    "domain_missing",
    """SELECT lang, CAST(doc_id AS VARCHAR) AS doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)""",
)
def _domain_missing(t: Tables):
    items = t.documents.select("lang", F.col("doc_id").cast("string").alias("doc_id"))
    good = t.labels.where("quality = 1").join(t.documents.select("doc_id", "lang"), "doc_id")
    handlers = good.select("lang", F.col("doc_id").cast("string").alias("doc_id"), F.lit("good").alias("provider"))
    return measure.domain_missing(measure.handled_items(items, handlers, "lang", "doc_id", ["good"]), "lang", "doc_id", "good")


def cents(column: str):
    return F.round(F.col(column) * 100).cast("long")


@query(
    "depth_ratio",
    """WITH c AS (SELECT o_custkey, CAST(sum(CASE WHEN year(o_orderdate) = 1996 THEN CAST(round(o_totalprice * 100) AS BIGINT) ELSE 0 END) AS BIGINT) AS a_cents,
       count(*) FILTER (WHERE year(o_orderdate) = 1996) AS a_n, CAST(sum(CASE WHEN year(o_orderdate) = 1997 THEN CAST(round(o_totalprice * 100) AS BIGINT) ELSE 0 END) AS BIGINT) AS b_cents,
       count(*) FILTER (WHERE year(o_orderdate) = 1997) AS b_n FROM orders GROUP BY 1)
    SELECT *, CAST(round_even(100.0::DOUBLE * b_cents / nullif(a_cents, 0), 0) AS BIGINT) AS pct_cents, CAST(round_even(100.0::DOUBLE * b_n / nullif(a_n, 0), 0) AS BIGINT) AS pct_n,
      coalesce(CAST(round_even(100.0::DOUBLE * b_cents / nullif(a_cents, 0), 0) AS BIGINT) < 50, false) AS shallow FROM c""",
)
def _depth_ratio(t: Tables):
    def year(y: int):
        mine = F.year("o_orderdate") == y
        return t.orders.groupBy("o_custkey").agg(
            F.sum(F.when(mine, cents("o_totalprice")).otherwise(0)).alias("cents"), F.count_if(mine).alias("n")
        )

    return measure.depth_ratio(year(1996), year(1997), "o_custkey", ["cents", "n"])


@query(
    "text_metrics",
    """SELECT doc_id, CAST(len(regexp_extract_all(text, 'the')) - len(regexp_extract_all(text, 'thes')) AS BIGINT) AS n_matches,
       CAST(len(regexp_extract_all(text, chr(10))) + 1 AS BIGINT) AS n_lines, regexp_matches(text, 'License|@') AS has_pattern FROM documents""",
)
def _text_metrics(t: Tables):
    return measure.text_metrics(t.documents, "text", ["doc_id"], "the", "thes", "License|@")


@query(
    "marker_census",
    f"""WITH {LINES_SQL}, f AS (SELECT *, regexp_matches(line, '^[T-Z]') AS m, sum(CASE WHEN regexp_matches(line, '^[T-Z]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS k FROM lines),
    c AS (SELECT doc_id, CAST(sum(CASE WHEN NOT (m OR k % 2 = 1) THEN len(regexp_extract_all(line, 'the')) ELSE 0 END) AS BIGINT) AS n_markers FROM f GROUP BY 1)
    SELECT doc_id, n_markers, CASE WHEN quality = 1 THEN 'current' ELSE 'stub' END AS status,
      CASE WHEN quality = 1 AND n_markers > 0 THEN 'FAIL' WHEN quality = 0 AND n_markers = 0 THEN 'WARN' ELSE 'OK' END AS finding FROM c JOIN labels USING (doc_id)""",
)
def _marker_census(t: Tables):
    lines = fence_mask(document_lines(t), ["doc_id"], "^[T-Z]")
    n = F.when(~F.col("fenced"), F.regexp_count("line", F.lit("the"))).otherwise(0)
    docs = lines.groupBy("doc_id").agg(F.sum(n).cast("long").alias("n_markers"))
    statuses = t.labels.select("doc_id", F.when(F.col("quality") == 1, "current").otherwise("stub").alias("status"))
    return measure.marker_census(docs, statuses, "doc_id")


@query(
    "merge_by_key",
    """SELECT user_id, event_type, min_by(value, (ts, event_id)) AS first_value, min_by(props, (ts, event_id)) AS first_props, max_by(value, (ts, event_id)) AS last_value,
       max_by(CASE WHEN value > 20 THEN event_id END, (ts, event_id)) FILTER (WHERE value > 20) AS last_big FROM events GROUP BY 1, 2""",
)
def _merge_by_key(t: Tables):
    keys, order = ["user_id", "event_type"], ["ts", "event_id"]
    rows = t.events.withColumn("big", F.when(F.col("value") > 20, F.col("event_id")))
    first = measure.merge_by_key(rows, keys, order, ["value", "props"])
    last = measure.merge_by_key(rows, keys, order, ["value", "big"], last=True)
    return first.select(*keys, F.col("value").alias("first_value"), F.col("props").alias("first_props")).join(
        last.select(*keys, F.col("value").alias("last_value"), F.col("big").alias("last_big")), keys
    )


GATE_CHECKS = ["links", "duplicates", "budget", "owners"]
GATE_SQL = """
f AS (SELECT 'links' AS c, 'FAIL' AS s FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)
  UNION ALL SELECT 'duplicates', 'WARN' FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_partkey HAVING count(*) > 1)
  UNION ALL SELECT 'budget', CASE WHEN strlen(text) > 4000 THEN 'FAIL' WHEN strlen(text) > 2000 OR strlen(text) < 20 THEN 'WARN' ELSE 'OK' END FROM documents
  UNION ALL SELECT 'owners', 'SKIP')
"""


def gate_rules():
    """Three checks and one whose table is never there."""
    def links(tables):
        known = tables["part"].where("p_size > 10")
        bad = integrity.broken_links(tables["lineitem"].select("l_orderkey", F.col("l_partkey").alias("dst")), known, "dst", "p_partkey")
        return bad.select(F.lit("FAIL").alias("severity"), F.col("l_orderkey").alias("key"), F.col("dst").alias("detail"))

    def duplicates(tables):
        dups = integrity.duplicate_entries(tables["lineitem"], "l_orderkey", "l_partkey", "l_linenumber")
        return dups.select(F.lit("WARN").alias("severity"), F.col("l_orderkey").alias("key"), F.col("n").alias("detail"))

    def budget(tables):
        size = F.octet_length("text")
        level = F.when(size > 4000, "FAIL").when((size > 2000) | (size < 20), "WARN").otherwise("OK")
        return tables["documents"].select(level.alias("severity"), F.col("doc_id").alias("key"), size.alias("detail"))

    def owners(tables):
        return tables["owners"].select(F.lit("FAIL").alias("severity"), F.col("id").alias("key"), F.col("id").alias("detail"))

    return {"links": links, "duplicates": duplicates, "budget": budget, "owners": owners}


@query(
    "gate_verdict",
    f"""WITH {GATE_SQL}, r AS (SELECT CASE WHEN grouping(c) = 1 THEN 'ALL' ELSE c END AS "check", grouping(c) AS g, count(*) FILTER (WHERE s = 'OK') AS n_ok,
       count(*) FILTER (WHERE s = 'WARN') AS n_warn, count(*) FILTER (WHERE s = 'FAIL') AS n_fail, count(*) FILTER (WHERE s = 'SKIP') AS n_skip FROM f GROUP BY ROLLUP (c))
    SELECT "check", n_ok, n_warn, n_fail, n_skip, CASE WHEN n_fail > 0 THEN 'FAIL' WHEN n_warn > 0 OR n_skip > 0 THEN 'WARN' ELSE 'OK' END AS verdict,
      CASE WHEN g = 1 THEN (SELECT CASE WHEN bool_or(c = 'links') THEN 'links' WHEN bool_or(c = 'budget') THEN 'budget' END FROM f WHERE s = 'FAIL') END AS alert FROM r""",
)
def _gate_verdict(t: Tables):
    tables = {n: getattr(t, n) for n in ("lineitem", "part", "documents")}
    return gate.gate_verdict(gate.run_rules(gate_rules(), tables, t.spark), GATE_CHECKS)


@query(
    "audit_rule",
    """SELECT 'late' AS "check", 'FAIL' AS severity, CAST(o_orderkey AS VARCHAR) AS key, o_orderstatus AS detail FROM orders WHERE o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1995-06-01'
    UNION ALL SELECT 'large', 'WARN', CAST(o_orderkey AS VARCHAR), o_orderpriority FROM orders WHERE o_totalprice > 495000""",
)
def _audit_rule(t: Tables):
    def late(tables):
        old = tables["orders"].where("o_orderstatus = 'O' AND o_orderdate < TIMESTAMP_NTZ '1995-06-01'")
        return old.select(F.lit("FAIL").alias("severity"), F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("detail"))

    def large(tables):
        big = tables["orders"].where("o_totalprice > 495000")
        return big.select(F.lit("WARN").alias("severity"), F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("detail"))

    return gate.run_rules({"late": late, "large": large}, {"orders": t.orders}, t.spark)


TYPES = ["signup", "error", "click", "view", "purchase"]


@query(
    "test_tally",
    """WITH e AS (SELECT user_id || '@' || strftime(ts, '%Y-%m-%d') AS repo, event_type AS m, CASE event_type WHEN 'error' THEN (CASE WHEN value > 20 THEN 'error' ELSE 'failure' END)
         WHEN 'view' THEN 'skipped' WHEN 'signup' THEN (CASE WHEN value > 25 THEN 'standin' ELSE 'pass' END) ELSE 'pass' END AS o FROM events),
    c AS (SELECT repo, count(*) FILTER (WHERE o <> 'standin') AS n_run, count(*) FILTER (WHERE o IN ('failure', 'error')) AS failed, count(*) FILTER (WHERE o = 'skipped') AS skipped,
         count(DISTINCT m) FILTER (WHERE o <> 'standin') AS mods FROM e GROUP BY 1),
    d AS (SELECT *, n_run - failed - skipped AS passed FROM c)
    SELECT repo, n_run, passed, failed, skipped, CASE WHEN passed = 0 AND failed = 0 THEN '0 passed' WHEN failed = 0 THEN passed || ' passed' WHEN passed = 0 THEN failed || ' failed'
        ELSE passed || ' passed, ' || failed || ' failed' END AS message,
      CASE WHEN passed = 0 AND failed = 0 THEN 'lightgrey' WHEN failed = 0 THEN 'brightgreen' WHEN passed = 0 THEN 'red' ELSE 'orange' END AS colour,
      NOT (passed = 0 AND failed = 0) AND mods = 5 AS publish FROM d""",
)
def _test_tally(t: Tables):
    kind, value = F.col("event_type"), F.col("value")
    outcome = (
        F.when(kind == "error", F.when(value > 20, "error").otherwise("failure"))
        .when(kind == "view", "skipped")
        .when((kind == "signup") & (value > 25), "standin")
        .otherwise("pass")
    )
    rows = t.events.select(
        F.concat_ws("@", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("repo"), outcome.alias("outcome"), kind.alias("module")
    )
    return measure.test_tally(rows, "repo", "outcome", "module", TYPES)


@query(
    "set_relation",
    """WITH s AS (SELECT user_id, CAST(ts AS DATE) AS day, count(DISTINCT event_type) AS n_members, count(DISTINCT event_type) FILTER (WHERE event_type IN ('signup', 'error', 'click')) AS i FROM events GROUP BY 1, 2)
    SELECT user_id, strftime(day, '%Y-%m-%d') AS day, n_members, i = 3 AS covers, i = 3 AND n_members = 3 AS equal FROM s""",
)
def _set_relation(t: Tables):
    days = t.events.select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type")
    return measure.set_relation(days, ["user_id", "day"], "event_type", ["signup", "error", "click"])


@query(
    "percent_half_even",
    """WITH s AS (SELECT source, count(*) AS n, count(l.doc_id) AS labelled, count(*) FILTER (WHERE l.toxic = 1) AS toxic FROM documents LEFT JOIN labels l USING (doc_id) GROUP BY 1),
    p AS (SELECT source, CAST(round_even(100.0::DOUBLE * labelled / nullif(n, 0), 0) AS BIGINT) AS pct, CAST(round_even(100.0::DOUBLE * labelled / nullif(toxic, 0), 0) AS BIGINT) AS per_toxic FROM s)
    SELECT source, pct, coalesce(per_toxic || '%', '—') AS per_toxic FROM p""",
)
def _percent_half_even(t: Tables):
    joined = t.documents.select("doc_id", "source").join(t.labels.withColumn("has", F.lit(1)), "doc_id", "left")
    counts = joined.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.count("has").alias("labelled"), F.count_if(F.col("toxic") == 1).alias("toxic")
    )
    return counts.select(
        "source", percent(F.col("labelled"), F.col("n")).alias("pct"), percent_text(percent(F.col("labelled"), F.col("toxic"))).alias("per_toxic")
    )


@query(
    "top_k_per_group",
    """WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
    SELECT o_custkey, o_orderkey, CAST(rank AS INTEGER) AS rank, greatest(n - 3, 0) AS rest FROM r WHERE rank <= 3""",
)
def _top_k_per_group(t: Tables):
    totals = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    first = top_k(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 3)
    return first.join(totals, "o_custkey").select("o_custkey", "o_orderkey", "rank", F.greatest(F.col("n") - 3, F.lit(0)).alias("rest"))
