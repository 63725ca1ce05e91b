"""Queries: links, anchors, orphans, ledgers against catalogs, rules, declarations."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuswarden.functions import paths
from corpuswarden.functions.rows import each
from corpuswarden.operators import integrity as ops
from corpuswarden.operators.sequence import slug_dedupe
from corpuswarden.plans.registry import LINES_SQL, PATHS_SQL, Tables, query
from corpuswarden.plans.scans import document_lines, page_paths
from corpuswarden.sources import scans


@query(
    "broken_links",
    """SELECT l_orderkey AS src, l_linenumber AS line_no, l_partkey AS dst FROM lineitem
    WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10 AND p_type <> 'PROMO')""",
)
def _broken_links(t: Tables):
    links = t.lineitem.select(F.col("l_orderkey").alias("src"), F.col("l_linenumber").alias("line_no"), F.col("l_partkey").alias("dst"))
    return ops.broken_links(links, t.part.where("p_size > 10 AND p_type <> 'PROMO'"), "dst", "p_partkey")


HEAD_SQL = rf"""
{LINES_SQL},
heads AS (SELECT doc_id, line_no, regexp_replace(lower(trim(regexp_extract(line, '^([^ ]*)', 1))), '[^\p{{L}}\p{{N}}_\- ]', '', 'g') AS slug FROM lines)
"""


def headings(t: Tables):
    """The first word of each line, taken as a heading."""
    return document_lines(t).withColumn("heading", F.regexp_extract("line", "^([^ ]*)", 1))


@query(
    "anchor_check",
    f"""WITH {HEAD_SQL}, n AS (SELECT *, max(line_no) OVER (PARTITION BY doc_id) AS last FROM heads),
    a AS (SELECT doc_id, slug || CASE WHEN r > 1 THEN '-' || (r - 1) ELSE '' END AS anchor FROM
          (SELECT *, row_number() OVER (PARTITION BY doc_id, slug ORDER BY line_no) AS r FROM n WHERE line_no < last))
    SELECT doc_id, line_no, slug AS fragment FROM n WHERE line_no = last AND slug <> '' AND NOT regexp_matches(slug, '^L[0-9]+')
      AND (doc_id, slug) NOT IN (SELECT (doc_id, anchor) FROM a)""",
)
def _anchor_check(t: Tables):
    heads = headings(t)
    last = heads.groupBy("doc_id").agg(F.max("line_no").alias("last"))
    with_last = heads.join(last, "doc_id")
    anchors = slug_dedupe(with_last.where("line_no < last"), ["doc_id"], "line_no", "heading")
    links = slug_dedupe(with_last.where("line_no = last"), ["doc_id"], "line_no", "heading").select(
        "doc_id", "line_no", F.col("slug").alias("fragment")
    )
    return ops.anchor_check(links, anchors.select(F.col("doc_id").alias("doc"), "anchor"), "doc_id", "fragment")


@query(
    "line_ref_bounds",
    """WITH n AS (SELECT l_orderkey AS k, count(*) AS n_lines FROM lineitem WHERE l_quantity > 10 GROUP BY 1)
    SELECT l_orderkey AS target, l_linenumber AS start, CASE WHEN l_linestatus = 'O' THEN l_linenumber + 2 END AS "end",
      CASE WHEN n_lines IS NULL THEN 'not_found' ELSE 'out_of_range' END AS issue,
      CASE WHEN n_lines IS NULL THEN NULL WHEN l_linenumber > n_lines THEN l_linenumber ELSE l_linenumber + CASE WHEN l_linestatus = 'O' THEN 2 ELSE 0 END END AS bad_line, n_lines
    FROM lineitem LEFT JOIN n ON l_orderkey = k WHERE n_lines IS NULL OR l_linenumber + CASE WHEN l_linestatus = 'O' THEN 2 ELSE 0 END > n_lines""",
)
def _line_ref_bounds(t: Tables):
    refs = t.lineitem.select(
        F.col("l_orderkey").alias("target"), F.col("l_linenumber").alias("start"),
        F.when(F.col("l_linestatus") == "O", F.col("l_linenumber") + 2).alias("end"),
    )
    lengths = t.lineitem.where("l_quantity > 10").groupBy(F.col("l_orderkey").alias("target")).agg(F.count(F.lit(1)).alias("n_lines"))
    return ops.line_ref_range(refs, lengths, "target")


@query(
    "line_ref_range",
    r"""WITH n AS (SELECT 'lib/m' || doc_id % 7 || '/d' || doc_id || '.py' AS target, CASE WHEN text = '' THEN 0 ELSE len(p) - CASE WHEN p[len(p)] = '' THEN 1 ELSE 0 END END AS n_lines
            FROM (SELECT doc_id, text, string_split_regex(text, '
|
|
') AS p FROM documents)),
    r AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS line_no, l_linenumber AS k, l_partkey AS part, CAST(l_quantity AS BIGINT) AS q FROM lineitem),
    x AS (SELECT *, CASE WHEN k % 4 = 1 THEN './../m' WHEN k % 4 = 2 THEN 'sub/.././../m' WHEN k % 4 = 3 THEN '../../../m' ELSE '../m' END || part % 7 || '/d' || part || '.py' AS raw,
            'lib/m' || part % 7 || '/d' || part || '.py' AS target, CASE WHEN k % 2 = 0 THEN q + k END AS z FROM r),
    f AS (SELECT *, '[part](' || raw || '#L' || q || CASE WHEN z IS NULL THEN '' ELSE '-L' || z END || ')' AS reference FROM x)
    SELECT 'lib/notes/o' || l_orderkey || '.md' AS doc, CAST(line_no AS BIGINT) AS line_no, length('Item ' || k || ' of [x](https://a.b/c.py#L1): ') + 1 AS "offset", reference, target, q AS start, z AS "end",
      CASE WHEN n_lines IS NULL THEN 'not_found' ELSE 'out_of_range' END AS issue, CASE WHEN n_lines IS NULL THEN NULL WHEN q > n_lines THEN q ELSE coalesce(z, q) END AS bad_line, CAST(n_lines AS BIGINT) AS n_lines
    FROM f LEFT JOIN n USING (target) WHERE k % 4 <> 3 AND (n_lines IS NULL OR greatest(q, coalesce(z, q)) > n_lines)""",
)
def _line_ref_range(t: Tables):
    """A note per order, a line per item that refers to lines of a document."""
    k, part, q = F.col("l_linenumber"), F.col("l_partkey"), F.col("l_quantity").cast("long")
    up = F.when(k % 4 == 1, "./../m").when(k % 4 == 2, "sub/.././../m").when(k % 4 == 3, "../../../m").otherwise("../m")
    line = F.concat(
        F.lit("Item "), k.cast("string"), F.lit(" of [x](https://a.b/c.py#L1): [part]("), up, (part % 7).cast("string"), F.lit("/d"), part.cast("string"),
        F.lit(".py#L"), q.cast("string"), F.when(k % 2 == 0, F.concat(F.lit("-L"), (q + k).cast("string"))).otherwise(""), F.lit(") end"),
    )
    notes = t.lineitem.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", line.alias("line")))).alias("l"))
    notes = notes.select(F.concat(F.lit("lib/notes/o"), F.col("l_orderkey").cast("string"), F.lit(".md")).alias("doc"), F.array_join(F.col("l.line"), "\n").alias("text"))
    key = F.col("doc_id")
    files = t.documents.select(F.concat(F.lit("lib/m"), (key % 7).cast("string"), F.lit("/d"), key.cast("string"), F.lit(".py")).alias("doc"), "text")
    return ops.line_ref_audit(notes, files, "doc", "text")


@query(
    "orphans",
    """SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING' AND c_acctbal > 0 AND c_custkey NOT IN
      (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderdate >= TIMESTAMP '2000-01-01' AND o_orderkey <> o_custkey)""",
)
def _orphans(t: Tables):
    urgent = t.orders.where("o_orderpriority = '1-URGENT' AND o_orderdate >= TIMESTAMP_NTZ '2000-01-01'")
    edges = urgent.select(F.col("o_orderkey").alias("src"), F.col("o_custkey").alias("dst"))
    catalog = t.customer.select("c_custkey", "c_mktsegment", "c_acctbal")
    return ops.orphans(
        catalog, edges, "c_custkey", generated=F.col("c_mktsegment") == "BUILDING", exempt=F.col("c_acctbal") <= 0
    ).select("c_custkey")


@query(
    "linked_untracked",
    """WITH e AS (SELECT DISTINCT l_returnflag AS repo, l_partkey AS dst, l_orderkey AS src FROM lineitem WHERE l_orderkey <> l_partkey AND l_returnflag <> 'N'
        AND (l_returnflag, l_partkey) NOT IN (SELECT ('A', p_partkey) FROM part WHERE p_size > 5 UNION ALL SELECT ('R', p_partkey) FROM part WHERE p_type <> 'LARGE')),
    r AS (SELECT *, row_number() OVER (PARTITION BY repo, dst ORDER BY src) AS k FROM e)
    SELECT repo, dst, string_agg(src, ', ' ORDER BY src) AS sources FROM r WHERE k <= 3 GROUP BY 1, 2""",
)
def _linked_untracked(t: Tables):
    edges = t.lineitem.select(F.col("l_returnflag").alias("repo"), F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"))
    tracked = (
        t.part.where("p_size > 5").select(F.lit("A").alias("repo"), F.col("p_partkey").alias("path"))
        .unionByName(t.part.where("p_type <> 'LARGE'").select(F.lit("R").alias("repo"), F.col("p_partkey").alias("path")))
    )
    found = ops.linked_untracked(edges, tracked, tracked.select("repo").distinct())
    return found.select("repo", "dst", F.array_join(F.transform("sources", lambda x: x.cast("string")), ", ").alias("sources"))


@query(
    "ledger_sync",
    """WITH lg AS (SELECT DISTINCT CASE WHEN toxic = 1 THEN doc_id + 1000000000 ELSE doc_id END AS doc_id FROM labels),
    f AS (SELECT doc_id FROM documents), r AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1)
    SELECT doc_id, 'no_file' AS issue FROM lg WHERE doc_id NOT IN (SELECT doc_id FROM f)
    UNION ALL SELECT doc_id, 'no_ledger_row' FROM f WHERE doc_id NOT IN (SELECT doc_id FROM lg) AND NOT starts_with(CAST(doc_id AS VARCHAR), '7')
    UNION ALL SELECT doc_id, 'rule_without_row' FROM r WHERE doc_id NOT IN (SELECT doc_id FROM lg)""",
)
def _ledger_sync(t: Tables):
    toxic = F.col("toxic") == 1
    book = t.labels.select(F.when(toxic, F.col("doc_id") + 1_000_000_000).otherwise(F.col("doc_id")).alias("doc_id"))
    return ops.ledger_sync(book, t.documents, t.labels.where(toxic), "doc_id", exempt_prefix="7")


RULES = [
    "SMALL/", "SMALL/Brand#1/", "SMALL/Brand#1/red ring", "PROMO/", "PROMO/Brand#2/", "LARGE/Brand#3/", "LARGE/",
    "MEDIUM/Brand#4/hot rod", "MEDIUM/Brand#4", "ECONOMY/", "PROMO/", "NOWHERE/", "STANDARD/Brand#7/",
]
RULES_SQL = ", ".join(f"('{r}', {i})" for i, r in enumerate(RULES))


@query(
    "longest_prefix_rule",
    f"""WITH rules(rule, o) AS (VALUES {RULES_SQL}), k AS (SELECT DISTINCT p_type || '/' || p_brand || '/' || p_name AS key FROM part),
    m AS (SELECT key, rule, row_number() OVER (PARTITION BY key ORDER BY length(rule) DESC, o) AS r FROM k LEFT JOIN rules
          ON (ends_with(rule, '/') AND starts_with(key, rule)) OR key = rule), best AS (SELECT key, rule FROM m WHERE r = 1)
    SELECT key, rule FROM best UNION ALL SELECT NULL, rule FROM (SELECT DISTINCT rule FROM rules) WHERE rule NOT IN (SELECT rule FROM best WHERE rule IS NOT NULL)""",
)
def _longest_prefix_rule(t: Tables):
    rules = t.spark.range(1).select(F.posexplode(F.array(*[F.lit(r) for r in RULES])).alias("rule_order", "rule"))
    keys = t.part.select(F.concat_ws("/", "p_type", "p_brand", "p_name").alias("key"))
    best = ops.longest_prefix_rule(keys, "key", rules)
    stale = ops.stale_rules(best, rules)
    return best.unionByName(stale.select(F.lit(None).cast("string").alias("key"), "rule"))


@query(
    "undeclared_files",
    rf"""WITH {PATHS_SQL}, d AS (SELECT DISTINCT host, regexp_extract(path, '^([a-z]+)/', 1) AS sub, CASE WHEN path LIKE '%.html' THEN '*.html' ELSE '?7*' END AS g FROM paths
          WHERE host LIKE '%.example.com' AND NOT path LIKE '%/'),
    f AS (SELECT page_id, host, path, string_split(path, '/')[-1] AS name FROM paths)
    SELECT page_id, host, path, 'undeclared' AS reason FROM f WHERE host IN (SELECT host FROM d) AND NOT ends_with(name, '1') AND name <> '' AND NOT EXISTS
      (SELECT 1 FROM d WHERE d.host = f.host AND (sub = '' OR starts_with(f.path, sub || '/')) AND f.name GLOB g)
    UNION ALL SELECT page_id, host, name, 'root' FROM f WHERE NOT contains(name, '.') AND name NOT IN ('7', '10', '231', '925')""",
)
def _undeclared_files(t: Tables):
    files = page_paths(t).select("page_id", "host", "path")
    declared = files.where(F.col("host").endswith(".example.com") & ~F.col("path").endswith("/")).select(
        "host",
        F.regexp_extract("path", "^([a-z]+)/", 1).alias("subtree"),
        F.when(F.col("path").endswith(".html"), "*.html").otherwise("?7*").alias("glob"),
    )
    root = files.select("page_id", "host", paths.base_name(F.col("path")).alias("path"))
    return ops.stray_files(files, root, declared, "host", "path", ("1",), ("",), sentinels=("7", "10", "231", "925"))


@query(
    "rename_target_check",
    r"""WITH l AS (SELECT o_orderkey AS key, CASE WHEN o_orderstatus = 'P' THEN 'renamed' ELSE 'na' END AS status,
        CASE WHEN o_orderpriority = '5-LOW' THEN 'see ' || o_custkey ELSE 'c' || o_custkey END AS target FROM orders)
    SELECT key, target FROM l WHERE status = 'renamed' AND regexp_matches(target, '^\w+$') AND target NOT IN (SELECT 'c' || c_custkey FROM customer WHERE c_acctbal > 1000)""",
)
def _rename_target_check(t: Tables):
    customer = F.col("o_custkey").cast("string")
    book = t.orders.select(
        F.col("o_orderkey").alias("key"),
        F.when(F.col("o_orderstatus") == "P", "renamed").otherwise("na").alias("status"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.concat(F.lit("see "), customer)).otherwise(F.concat(F.lit("c"), customer)).alias("target"),
    )
    names = t.customer.where("c_acctbal > 1000").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("name"))
    return ops.rename_target_check(book, names, "key", "target")


@query(
    "pair_resolution",
    """WITH a AS (SELECT replace(s_name, 'Supplier', 'Customer') AS base, 'K' || s_suppkey AS cls, 'a/' || s_suppkey AS path FROM supplier
      UNION ALL SELECT 'p' || c_custkey, c_name, 'a/c' || c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'),
    b AS (SELECT CASE WHEN c_acctbal > 5000 THEN c_name || '_slots' WHEN c_nationkey < 5 THEN 'q' || c_custkey ELSE 'x' || c_custkey END AS base,
           CASE WHEN c_nationkey < 5 THEN c_name || 'Slots' ELSE 'K' || c_custkey END AS cls, 'b/' || c_custkey AS path FROM customer WHERE c_acctbal > 0),
    r AS (SELECT c_name AS name, coalesce((SELECT min((path, cls)) FROM a WHERE base = c_name), (SELECT min((path, cls)) FROM a WHERE base = c_name || '_slots'),
           (SELECT min((path, cls)) FROM a WHERE cls = c_name), (SELECT min((path, cls)) FROM a WHERE cls = c_name || 'Slots')) AS x,
        coalesce((SELECT min((path, cls)) FROM b WHERE base = c_name), (SELECT min((path, cls)) FROM b WHERE base = c_name || '_slots'),
           (SELECT min((path, cls)) FROM b WHERE cls = c_name), (SELECT min((path, cls)) FROM b WHERE cls = c_name || 'Slots')) AS y FROM customer),
    f AS (SELECT name, x, coalesce(y, (SELECT min((path, cls)) FROM b WHERE cls = x[2])) AS y FROM r),
    g AS (SELECT name, coalesce(x, (SELECT min((path, cls)) FROM a WHERE cls = y[2])) AS x, y FROM f)
    SELECT name, x[1] AS a_path, y[1] AS b_path, CASE WHEN x IS NULL OR y IS NULL THEN 'FAIL' ELSE 'OK' END AS state FROM g""",
)
def _pair_resolution(t: Tables):
    key = lambda letter, col: F.concat(F.lit(letter), F.col(col).cast("string"))
    a = t.supplier.select(
        F.replace("s_name", F.lit("Supplier"), F.lit("Customer")).alias("base"), key("K", "s_suppkey").alias("class"), key("a/", "s_suppkey").alias("path")
    ).unionByName(
        t.customer.where("c_mktsegment = 'BUILDING'").select(key("p", "c_custkey").alias("base"), F.col("c_name").alias("class"), key("a/c", "c_custkey").alias("path"))
    )
    near = F.col("c_nationkey") < 5
    b = t.customer.where("c_acctbal > 0").select(
        F.when(F.col("c_acctbal") > 5000, F.concat("c_name", F.lit("_slots"))).when(near, key("q", "c_custkey")).otherwise(key("x", "c_custkey")).alias("base"),
        F.when(near, F.concat("c_name", F.lit("Slots"))).otherwise(key("K", "c_custkey")).alias("class"),
        key("b/", "c_custkey").alias("path"),
    )
    return ops.pair_resolution(t.customer.select(F.col("c_name").alias("name")), a, b, "name", ("_slots", "Slots"))


@query(
    "declared_vs_named",
    """WITH d AS (SELECT DISTINCT o_custkey, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderdate < TIMESTAMP '1998-01-01'),
    n AS (SELECT DISTINCT o_custkey, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderdate >= TIMESTAMP '1996-06-01' AND o_orderstatus = 'O')
    SELECT * FROM d EXCEPT SELECT * FROM n""",
)
def _declared_vs_named(t: Tables):
    bought = t.lineitem.select("l_orderkey", "l_partkey").join(
        t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate", "o_orderstatus"), "l_orderkey"
    )
    declared = bought.where("o_orderdate < TIMESTAMP_NTZ '1998-01-01'")
    named = bought.where("o_orderdate >= TIMESTAMP_NTZ '1996-06-01' AND o_orderstatus = 'O'")
    return ops.declared_vs_named(declared, named, "o_custkey", "l_partkey")


@query(
    "hub_coverage",
    rf"""WITH {PATHS_SQL}, h AS (SELECT page_id, host, regexp_extract_all(html, 'href="/([^"]*)"', 1) AS ws FROM paths),
    l AS (SELECT page_id, host, ws, regexp_replace(unnest(ws), '[^\p{{L}}]', '', 'g') AS w FROM h),
    topics AS (SELECT DISTINCT w AS name FROM l WHERE length(w) > 2 AND w <> 'the'),
    idx AS (SELECT w AS name FROM l WHERE host LIKE '%.net'),
    hub AS (SELECT DISTINCT regexp_replace(ws[1], '[^\p{{L}}]', '', 'g') AS hub, w AS name FROM l WHERE host LIKE '%.org'),
    via AS (SELECT DISTINCT name FROM hub WHERE hub IN (SELECT name FROM idx) AND hub IN (SELECT name FROM topics))
    SELECT name, 'duplicate' AS issue FROM idx GROUP BY 1 HAVING count(*) > 1
    UNION ALL SELECT DISTINCT name, 'broken_index' FROM idx WHERE name NOT IN (SELECT name FROM topics)
    UNION ALL SELECT name, 'broken_hub' FROM via WHERE name NOT IN (SELECT name FROM topics)
    UNION ALL SELECT name, 'orphan' FROM topics WHERE name NOT IN (SELECT name FROM idx) AND name NOT IN (SELECT name FROM via)""",
)
def _hub_coverage(t: Tables):
    pages = page_paths(t, "html")
    words = scans.link_scan(pages, "html", ["page_id", "host"], r'href="/([^"]*)"').select(
        "page_id", "host", F.regexp_replace("target", r"[^\p{L}]", "").alias("name")
    )
    topics = words.where((F.char_length("name") > 2) & (F.col("name") != "the"))
    # on the third kind of host the first link of a page is the hub of the others
    first = F.regexp_replace(F.regexp_extract("html", r'href="/([^"]*)"', 1), r"[^\p{L}]", "")
    targets = F.regexp_extract_all("html", F.lit(r'href="/([^"]*)"'), F.lit(1))
    rest = each(pages.where(F.col("host").endswith(".org")), [first.alias("hub")], targets, "name")
    hub = rest.withColumn("name", F.regexp_replace("name", r"[^\p{L}]", ""))
    return ops.hub_coverage(topics, words.where(F.col("host").endswith(".net")), hub, "name")


@query(
    "duplicate_entries",
    f"""WITH {LINES_SQL} SELECT CAST(l_orderkey AS VARCHAR) AS owner, CAST(l_partkey AS VARCHAR) AS key, count(*) AS n, CAST(min(l_linenumber) AS BIGINT) AS first_at FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1
    UNION ALL SELECT 'doc' || doc_id, line, count(*), min(line_no) FROM lines GROUP BY 1, 2 HAVING count(*) > 1""",
)
def _duplicate_entries(t: Tables):
    items = t.lineitem.select(
        F.col("l_orderkey").cast("string").alias("owner"), F.col("l_partkey").cast("string").alias("key"), F.col("l_linenumber").cast("long").alias("at")
    )
    lines = document_lines(t).select(
        F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("owner"), F.col("line").alias("key"), F.col("line_no").alias("at")
    )
    return ops.duplicate_entries(items.unionByName(lines), "owner", "key", "at")


@query(
    "block_consistency",
    r"""WITH d AS (SELECT doc_id, regexp_extract(text, '^([^\n]*)', 1) AS head, text FROM documents),
    b AS (SELECT md5(head) AS name, doc_id, regexp_replace(text[length(head) + 1:], '^\n+|\n+$', '', 'g') AS body FROM d),
    v AS (SELECT name, count(DISTINCT body) AS n_versions FROM b GROUP BY 1 HAVING count(DISTINCT body) > 1)
    SELECT name, doc_id, n_versions FROM b JOIN v USING (name)""",
)
def _block_consistency(t: Tables):
    head = F.regexp_extract("text", r"^([^\n]*)", 1)
    blocks = t.documents.select(
        "doc_id", F.md5(head).alias("name"), F.substring(F.col("text"), F.char_length(head) + 1, F.char_length("text")).alias("body")
    )
    return ops.block_consistency(blocks, "name", "body", "doc_id")
