"""Queries: filters, budgets, rules and classifications."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuswarden.functions import paths
from corpuswarden.functions.rows import each
from corpuswarden.operators import filters as ops
from corpuswarden.plans.registry import LINES_SQL, PATHS_SQL, Tables, query
from corpuswarden.plans.scans import document_lines, page_paths
from corpuswarden.sources import scans


@query(
    "public_filter",
    """SELECT p_partkey, p_name FROM part WHERE NOT starts_with(p_name, 'red') AND NOT starts_with(p_name, 'old ')
       AND p_type NOT IN ('PROMO', 'ECONOMY')""",
)
def _public_filter(t: Tables):
    return ops.public_filter(t.part, "p_name", "p_type", "red", ("old ",), ("PROMO", "ECONOMY")).select("p_partkey", "p_name")


@query(
    "boundary_filter",
    rf"""WITH {PATHS_SQL},
    raw AS (SELECT page_id, regexp_replace(path, '/?[^/]*$', '') AS base, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS h FROM paths
            UNION ALL SELECT page_id, regexp_replace(path, '/?[^/]*$', ''), url FROM paths
            UNION ALL SELECT page_id, regexp_replace(path, '/?[^/]*$', ''), regexp_extract(url, '([#?].*)$', 1) FROM paths),
    targets AS (SELECT page_id, base, CASE WHEN h LIKE '/%e' THEN '../' || h[2:] WHEN h LIKE '/%n%' THEN '../../../' || h[2:]
                       ELSE h END AS target FROM raw),
    split AS (SELECT *, trim(split_part(target, '#', 1)) AS p, CASE WHEN base = '' THEN 0 ELSE len(string_split(base, '/')) - (CASE WHEN ends_with(base, '/') THEN 1 ELSE 0 END) END AS depth,
                     CASE WHEN starts_with(target, '../../../') THEN 3 WHEN starts_with(target, '../') THEN 1 ELSE 0 END AS ups FROM targets)
    SELECT page_id, target, CASE WHEN target LIKE 'http://%' OR target LIKE 'https://%' THEN 'external' WHEN target LIKE '#%' THEN 'anchor'
      WHEN p = '' THEN 'empty' WHEN p LIKE '/%' OR ups > depth THEN 'escapes' ELSE 'inside' END AS scope FROM split""",
)
def _boundary_filter(t: Tables):
    base = page_paths(t, "html").select("page_id", "url", "html", paths.dir_name(F.col("path")).alias("base"))
    links = (
        each(base, ["page_id", "base"], F.regexp_extract_all("html", F.lit(scans.HREF), F.lit(1)), "h")
        .unionByName(base.select("page_id", "base", F.col("url").alias("h")))
        .unionByName(base.select("page_id", "base", F.regexp_extract("url", r"([#?].*)$", 1).alias("h")))
    )
    # the pages have site-absolute links only: some are made relative, one or three levels up
    tail = F.expr("substring(h, 2)")
    target = (
        F.when(F.like("h", F.lit("/%e")), F.concat(F.lit("../"), tail))
        .when(F.like("h", F.lit("/%n%")), F.concat(F.lit("../../../"), tail))
        .otherwise(F.col("h"))
    )
    links = links.withColumn("target", target)
    return links.select("page_id", "target", ops.boundary_class(F.col("target"), F.col("base")).alias("scope"))


@query(
    "exempt_filter",
    f"""WITH {PATHS_SQL}, files AS (SELECT page_id, host || '/' || path AS path FROM paths)
    SELECT page_id, path FROM files WHERE lower(string_split(path, '/')[-1]) NOT IN ('10.html', '')
      AND NOT contains(lower(string_split(path, '/')[-1]), '77') AND NOT list_contains(string_split(path, '/'), 'fr')""",
)
def _exempt_filter(t: Tables):
    files = page_paths(t).select("page_id", F.concat_ws("/", "host", "path").alias("path"))
    return ops.exempt_filter(files, "path", names=("10.html", ""), name_parts=("77",), segments=("fr",))


@query(
    "allowlist_filter",
    """WITH allow AS (SELECT o_orderkey AS p, '*' AS f FROM orders WHERE o_orderstatus = 'P'
                   UNION ALL SELECT o_orderkey, '1' FROM orders WHERE o_orderstatus = 'F')
    SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem l WHERE NOT EXISTS (
      SELECT 1 FROM allow a WHERE a.p = l.l_orderkey AND (a.f = '*' OR a.f = CAST(l.l_linenumber AS VARCHAR)))""",
)
def _allowlist_filter(t: Tables):
    status = F.col("o_orderstatus")
    allow = t.orders.where(status.isin("P", "F")).select(
        F.col("o_orderkey").alias("path"), F.when(status == "P", "*").otherwise("1").alias("function")
    )
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_linenumber").cast("string").alias("fn"))
    return ops.allowlist_filter(rows, allow, "l_orderkey", "fn").drop("fn")


@query(
    "glob_match",
    f"""WITH {PATHS_SQL}, files AS (SELECT page_id, host || '/' || path AS path FROM paths)
    SELECT page_id, path FROM files WHERE NOT (path GLOB 'blog.*' OR string_split(path, '/')[-1] GLOB '[1-3]*.html'
      OR path GLOB '*/de/???' OR string_split(path, '/')[-1] = '' OR path GLOB '*.example.[!cn]*/en/*')""",
)
def _glob_match(t: Tables):
    files = page_paths(t).select("page_id", F.concat_ws("/", "host", "path").alias("path"))
    return ops.glob_match(files, "path", ["blog.*", "[1-3]*.html", "*/de/???", "", "*.example.[!cn]*/en/*"])


@query(
    "size_budget",
    """WITH s AS (SELECT doc_id, lang, strlen(text) AS size, CASE WHEN lang = 'en' THEN 2000 ELSE 1000 END AS a,
                 CASE WHEN lang = 'en' THEN 4000 ELSE 3000 END AS h FROM documents)
    SELECT doc_id, lang, CAST(size AS BIGINT) AS size,
      CASE WHEN size > h THEN 'FAIL' WHEN size > a THEN 'WARN' WHEN size > h * 0.9 THEN 'WARN' WHEN size < 20 THEN 'WARN' ELSE 'OK' END AS status,
      CAST(CASE WHEN size > h THEN size - h WHEN size > a THEN size - a ELSE 0 END AS BIGINT) AS over FROM s""",
)
def _size_budget(t: Tables):
    english = F.col("lang") == "en"
    docs = ops.size_budget(
        t.documents, F.octet_length("text"), F.when(english, 2000).otherwise(1000), F.when(english, 4000).otherwise(3000)
    )
    return docs.select("doc_id", "lang", "size", "status", "over")


@query(
    "entry_budget",
    f"""WITH {LINES_SQL} SELECT doc_id, count(*) FILTER (WHERE length(line) > 400) AS n_over, max(length(line)) AS longest
    FROM lines GROUP BY 1""",
)
def _entry_budget(t: Tables):
    return ops.entry_budget(document_lines(t), ["doc_id"], 400)


@query(
    "field_rules",
    """SELECT o_orderkey, rule FROM (
      SELECT o_orderkey, unnest([CASE WHEN o_orderstatus NOT IN ('O', 'F') THEN 'status' END,
        CASE WHEN o_orderpriority NOT SIMILAR TO '[1-4]-[A-Z ]+' THEN 'priority' END,
        CASE WHEN o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '2000-01-01' THEN 'closed_late' END]) AS rule FROM orders) WHERE rule IS NOT NULL""",
)
def _field_rules(t: Tables):
    rules = {
        "status": ~F.col("o_orderstatus").isin("O", "F"),
        "priority": ~F.col("o_orderpriority").rlike(r"^[1-4]-[A-Z ]+$"),
        "closed_late": (F.col("o_orderstatus") == "F") & (F.col("o_orderdate") >= F.expr("TIMESTAMP_NTZ '2000-01-01'")),
    }
    return ops.field_rules(t.orders, ["o_orderkey"], rules)


@query(
    "conflict_marker_scan",
    r"""SELECT doc_id, lang, regexp_extract(text, '(?m)^(Released under[^\n]*)', 1) AS first_line FROM documents
    WHERE regexp_matches(text, '(?m)^Released under')""",
)
def _conflict_marker_scan(t: Tables):
    return ops.conflict_marker_scan(t.documents, "text", ["doc_id", "lang"], "Released under")


@query("forbidden_heading", "SELECT doc_id, source FROM documents WHERE regexp_matches(text, '(?mi)^licensed')")
def _forbidden_heading(t: Tables):
    return ops.forbidden_heading(t.documents, "text", ["doc_id", "source"], "licensed")


@query(
    "recent_changes",
    """WITH recent AS (SELECT * FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 1440 MINUTE AND event_type <> 'error'),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM recent)
    SELECT event_type, event_id, r AS rank, greatest(n - 8, 0) AS rest FROM ranked WHERE r <= 8""",
)
def _recent_changes(t: Tables):
    # the path of a change is its event type, renamed ones carry an arrow
    events = t.events.withColumn(
        "path", F.when(F.col("value") > 10, F.concat(F.lit("old -> "), "event_type")).otherwise(F.col("event_type"))
    )
    latest = t.events.select(F.max("ts")).scalar()
    changed = ops.recent_changes(
        events.withColumn("path", F.concat("path", F.lit("/"), F.lpad(F.col("event_id").cast("string"), 12, "0"))),
        "event_type", "path", "ts", 1440, latest, generated="^error/",
    )
    return changed.select("event_type", "event_id", F.col("rank").cast("long").alias("rank"), "rest")


@query(
    "log_verdict",
    f"""WITH {LINES_SQL}, marked AS (SELECT *, NOT regexp_matches(line, '^[A-D]') AS k FROM lines),
    job AS (SELECT doc_id, coalesce(bool_or(k AND regexp_matches(line, 'worthless|stupid|idiot|the of ')), false) AS e,
      coalesce(bool_or(k AND regexp_matches(line, ' en | die ')), false) AS s, count(*) FILTER (WHERE regexp_matches(line, 'the|la')) AS n,
      min_by(line, line_no) FILTER (WHERE k AND regexp_matches(line, 'worthless|stupid|idiot|the of ')) AS f FROM marked GROUP BY 1)
    SELECT doc_id, CASE WHEN e AND s THEN 'retry' WHEN e OR n < 1 THEN 'failed' ELSE 'ok' END AS verdict, n AS n_passed,
      CASE WHEN e THEN f WHEN n < 1 THEN 'no passing line' END AS first_hit FROM job""",
)
def _log_verdict(t: Tables):
    return ops.log_verdict(
        document_lines(t), ["doc_id"], "^[A-D]", "worthless|stupid|idiot|the of ", " en | die ", "the|la"
    )


@query(
    "element_property_violations",
    """SELECT p_partkey, p_size AS value FROM part WHERE p_type LIKE '%M' AND p_name LIKE '%g' AND p_name <> 'old ring' AND p_size > 20""",
)
def _element_property_violations(t: Tables):
    # the size of an old ring is unreadable and has to be skipped
    size = F.when(F.col("p_name") == "old ring", F.lit("n/a")).otherwise(F.col("p_size").cast("string"))
    props = F.create_map(F.lit("kind"), F.col("p_type"), F.lit("name"), F.col("p_name"), F.lit("size"), size)
    rows = t.part.select("p_partkey", props.alias("props"))
    return ops.element_property_violations(rows, "props", 20, ("kind", "M"), ("name", "g"), "size").drop("props")


@query(
    "name_class",
    r"""WITH n AS (SELECT p_partkey, lower(replace(replace(p_type, 'STANDARD', 'tb'), 'PROMO', 'txt')) || CASE WHEN p_size < 10 THEN '' ELSE lpad(CAST(p_size AS VARCHAR), CASE WHEN p_size < 30 THEN 3 ELSE 2 END, '0') END
             || CASE WHEN p_brand = 'Brand#7' THEN '_init' ELSE '' END AS name FROM part)
    SELECT p_partkey, name, regexp_replace(name, '_init$', '') AS stem, CASE WHEN regexp_matches(name, '^[a-z]+\d{3}(_init)?$') THEN 'widget'
      WHEN regexp_matches(name, '^(tb|b|chk|cmb|list|s|d|i|w)\d+$') THEN 'audit' WHEN regexp_matches(name, '^(tb|b|chk|cmb|s|list|txt)\d') THEN 'domain' ELSE 'other' END AS class FROM n""",
)
def _name_class(t: Tables):
    size = F.col("p_size")
    digits = F.when(size < 10, "").when(size < 30, F.lpad(size.cast("string"), 3, "0")).otherwise(size.cast("string"))
    suffix = F.when(F.col("p_brand") == "Brand#7", "_init").otherwise("")
    name = F.concat(F.lower(F.replace(F.replace("p_type", F.lit("STANDARD"), F.lit("tb")), F.lit("PROMO"), F.lit("txt"))), digits, suffix)
    return t.part.select("p_partkey", name.alias("name")).select(
        "p_partkey", "name", ops.name_stem(F.col("name")).alias("stem"), ops.name_class(F.col("name"), ops.HANDLER_PATTERNS).alias("class")
    )


@query(
    "entity_class",
    """SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'Repository' WHEN n_regionkey = 0 THEN 'Python package' WHEN c_mktsegment = 'BUILDING' THEN 'Operations / scripts'
        ELSE 'Application / mixed codebase' END AS kind,
      CASE WHEN c_mktsegment = 'MACHINERY' THEN 'machines' WHEN c_nationkey BETWEEN 5 AND 9 THEN 'about ' || c_name
        WHEN c_nationkey < 20 THEN 'Workspace repo aligned with the ' || n_name || ' domain.' ELSE 'Workspace repository.' END AS summary
    FROM customer JOIN nation ON c_nationkey = n_nationkey""",
)
def _entity_class(t: Tables):
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    kind = ops.first_match(
        [
            (F.col("c_acctbal") < 0, "Repository"),
            (F.col("n_regionkey") == 0, "Python package"),
            (F.col("c_mktsegment") == "BUILDING", "Operations / scripts"),
        ],
        "Application / mixed codebase",
    )
    nation = F.col("c_nationkey")
    summary = ops.entity_summary(
        F.col("c_name"),
        F.when(F.col("c_mktsegment") == "MACHINERY", " machines ").otherwise(""),
        # nations 0 to 4 only repeat the name in their first line
        F.when(nation < 5, F.concat(F.lit("# "), F.upper("c_name"))).when(nation < 10, F.concat(F.lit("## about "), "c_name")),
        F.when(nation < 20, F.col("n_name")),
    )
    return rows.select("c_custkey", kind.alias("kind"), summary.alias("summary"))
