"""Queries: scans, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuswarden.functions import paths
from corpuswarden.functions.text import content_digest, split_lines
from corpuswarden.plans.registry import LINES_SQL, PATHS_SQL, Tables, query
from corpuswarden.session import fresh_path, materialize
from corpuswarden.sources import scans, sinks


def document_lines(t: Tables, *keep: str):
    return scans.line_scan(t.documents, "text", ["doc_id", *keep], "file")


def page_paths(t: Tables, *keep: str):
    url = F.col("url")
    return t.pages.select("page_id", "url", *keep, paths.url_host(url).alias("host"), paths.url_path(url).alias("path"))


@query(
    "corpus_scan",
    f"""WITH {PATHS_SQL}
    SELECT page_id, host || '/' || path AS path FROM paths
    WHERE NOT list_contains(string_split(host || '/' || path, '/')[1:-2], 'de')
      AND (path LIKE '%.html' OR path LIKE '%/') AND string_split(path, '/')[-1] <> '100.html'""",
)
def _corpus_scan(t: Tables):
    files = page_paths(t).select("page_id", F.concat_ws("/", "host", "path").alias("path"))
    return scans.corpus_scan(files, "path", [".html", "/"], ["de"], ["100.html"])


@query(
    "line_scan",
    f"WITH {LINES_SQL} SELECT doc_id, line_no, line, trim(line) <> '' AS nonempty FROM lines",
)
def _line_scan(t: Tables):
    return document_lines(t)


@query(
    "registry_scan",
    f"""WITH {LINES_SQL}, words AS (SELECT doc_id, source, 'l' || line_no AS module, line_no,
        regexp_extract(line, '^([^ ]*)', 1) AS w1, regexp_extract(line, '([^ ]*)$', 1) AS wz,
        regexp_extract(line, '^[^ ]* ([^ ]*)', 1) AS w2 FROM lines)
    SELECT source AS package, module, '' AS owner, w1 AS name, w1 AS qualname, 'function' AS kind,
           '' AS signature, '' AS summary, 0 AS line, false AS deprecated FROM words
    UNION ALL SELECT source, module, '', wz, wz, 'class', '(class)', '', CAST(line_no AS INTEGER), false FROM words
    UNION ALL SELECT source, module, wz, w2, w2, 'method', '()', '', 0, false FROM words""",
)
def _registry_scan(t: Tables):
    modules = F.transform(
        _numbered_lines("text"),
        lambda x: F.struct(
            F.concat(F.lit("l"), x["no"].cast("string")).alias("relpath"),
            F.array(F.struct(F.regexp_extract(x["line"], "^([^ ]*)", 1).alias("name"))).alias("functions"),
            F.array(
                F.struct(
                    F.regexp_extract(x["line"], "([^ ]*)$", 1).alias("name"),
                    x["no"].alias("line"),
                    F.array(
                        F.struct(
                            F.regexp_extract(x["line"], "^[^ ]* ([^ ]*)", 1).alias("name"), F.lit("()").alias("signature")
                        )
                    ).alias("members"),
                )
            ).alias("classes"),
        ),
    )
    payload = t.documents.select(F.to_json(F.struct(F.col("source").alias("name"), modules.alias("modules"))).alias("payload"))
    return scans.registry_scan(payload, "payload")


def _numbered_lines(text: str):
    return F.transform(split_lines(F.col(text), "file"), lambda x, i: F.struct((i + 1).alias("no"), x.alias("line")))


@query(
    "pipe_table_scan",
    f"""WITH {LINES_SQL}, cells AS (SELECT doc_id, line_no, string_split(line, ' | ') AS c FROM lines WHERE contains(line, ' | '))
    SELECT doc_id, line_no, len(c) AS n_cells, trim(c[1]) AS first_cell, trim(c[-1]) AS last_cell FROM cells""",
)
def _pipe_table_scan(t: Tables):
    rows = scans.pipe_table_scan(document_lines(t), ["doc_id"], " | ")
    return rows.select(
        "doc_id",
        "line_no",
        F.size("cells").cast("long").alias("n_cells"),
        F.element_at("cells", 1).alias("first_cell"),
        F.element_at("cells", -1).alias("last_cell"),
    )


@query(
    "element_scan",
    """WITH tags AS (SELECT page_id, regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1) AS l FROM pages)
    SELECT page_id, unnest(range(1, len(l) + 1)) AS seq, lower(unnest(l)) AS tag FROM tags""",
)
def _element_scan(t: Tables):
    return scans.element_scan(t.pages, "html", ["page_id"])


@query(
    "link_scan",
    """WITH hrefs AS (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS l FROM pages),
    targets AS (SELECT page_id, unnest(range(1, len(l) + 1)) AS seq, unnest(l) AS target FROM hrefs
                UNION ALL SELECT page_id, 0, url FROM pages)
    SELECT page_id, seq, target, split_part(target, '#', 1) AS target_path,
           CASE WHEN contains(target, '#') THEN substr(target, strpos(target, '#') + 1) ELSE '' END AS fragment FROM targets""",
)
def _link_scan(t: Tables):
    hrefs = scans.link_scan(t.pages, "html", ["page_id"], scans.HREF)
    own = scans.link_scan(t.pages, "url", ["page_id"], r"^(.+)$").withColumn("seq", F.lit(0).cast("long"))
    return hrefs.unionByName(own)


@query(
    "requirement_names",
    r"""SELECT DISTINCT p_brand, replace(lower(regexp_extract(p_name, '^\s*([A-Za-z0-9_.\-]+)', 1)), '_', '-') AS name
    FROM part WHERE lower(regexp_extract(p_name, '^\s*([A-Za-z0-9_.\-]+)', 1)) IN ('small', 'red', 'cold')""",
)
def _requirement_names(t: Tables):
    return scans.requirement_names(t.part, "p_brand", "p_name", ["small", "red", "cold"])


@query(
    "baseline_resolve",
    """WITH rel AS (SELECT o_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS k FROM orders
            WHERE o_orderdate <= TIMESTAMP '1997-01-01' GROUP BY 1),
    ref AS (SELECT o_custkey, min_by(o_orderkey, (o_orderdate, o_orderkey)) AS k FROM orders
            WHERE o_orderdate > TIMESTAMP '1997-01-01' GROUP BY 1)
    SELECT c.c_custkey AS o_custkey, coalesce(rel.k, ref.k) AS baseline,
           CASE WHEN rel.k IS NOT NULL THEN 'released' WHEN ref.k IS NOT NULL THEN 'refresh' ELSE 'none' END AS label
    FROM customer c LEFT JOIN rel ON c.c_custkey = rel.o_custkey LEFT JOIN ref ON c.c_custkey = ref.o_custkey""",
)
def _baseline_resolve(t: Tables):
    customers = t.customer.select(F.col("c_custkey").alias("o_custkey"))
    cut = F.expr("TIMESTAMP_NTZ '1997-01-01'")
    return scans.baseline_resolve(customers, t.orders, "o_custkey", "o_orderdate", "o_orderkey", cut)


@query(
    "receipt_map_scan",
    """SELECT user_id, event_type AS "check", strftime(max(ts), '%Y-%m-%dT%H:%M:%S.%f') AS ts FROM events GROUP BY 1, 2""",
)
def _receipt_map_scan(t: Tables):
    folded = scans.receipt_map_fold(t.events, "user_id", "event_type", "ts")
    rows = scans.receipt_map_scan(folded, "user_id", "payload")
    return rows.withColumn("ts", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


# the same tree digest in SQL
TREE_SQL = """
entries AS (SELECT source, md5(concat_ws('|', doc_id, sha256(text))) AS h FROM documents),
low AS (SELECT source, h[1:6] AS b, h[1:6] || ':' || md5(string_agg(h, chr(10) ORDER BY h)) AS d FROM entries GROUP BY 1, 2),
high AS (SELECT source, b[1:3] || ':' || md5(string_agg(d, chr(10) ORDER BY d)) AS d FROM low GROUP BY source, b[1:3]),
trees AS (SELECT source, md5(string_agg(d, chr(10) ORDER BY d))[1:12] AS digest FROM high GROUP BY 1)
"""


def source_trees(t: Tables):
    entry = F.concat_ws("|", F.col("doc_id").cast("string"), content_digest(F.col("text")))
    return sinks.group_digest(t.documents, ["source"], entry)


@query(
    "write_if_changed",
    f"""WITH {TREE_SQL}, k AS (SELECT *, CASE WHEN source = 'src3' THEN 'created' WHEN source IN ('src5', 'src7') THEN 'updated' ELSE 'unchanged' END AS action FROM trees)
    SELECT source, digest, action, count(*) FILTER (WHERE source <> 'src3') OVER () AS n_first, count(*) FILTER (WHERE action <> 'unchanged') OVER () AS n_second, CAST(0 AS BIGINT) AS n_third,
      action <> 'unchanged' AS rewritten, false AS rewritten_again FROM k""",
)
def _write_if_changed(t: Tables):
    trees = source_trees(t)
    manifest = trees.where(F.col("source") != "src3").withColumn(
        "digest", F.when(F.col("source").isin("src5", "src7"), "old").otherwise(F.col("digest"))
    )
    # three runs below one path: the first state, the new one, and that again
    path, digest = fresh_path(t.spark, "artifacts"), F.col("digest")
    seen, counts = [], []
    for artifacts in (manifest, trees, trees):
        counts.append(sinks.write_if_changed(artifacts, "source", digest, path))
        at = t.spark.read.parquet(path).select("source", F.col("_metadata.file_path").alias("file"))
        seen.append(materialize(at.groupBy("source").agg(F.array_sort(F.collect_set("file")).alias(f"files{len(seen)}")), "artifact-files")[0])
    out = sinks.changed_artifacts(trees, manifest, "source").select("source", "digest", "action")
    for files in seen:
        out = out.join(files, "source", "left")
    same = lambda a, b: F.col(f"files{a}").eqNullSafe(F.col(f"files{b}"))
    numbers = [F.lit(n).cast("long").alias(c) for c, n in zip(("n_first", "n_second", "n_third"), counts)]
    return out.select("source", "digest", "action", *numbers, (~same(0, 1)).alias("rewritten"), (~same(1, 2)).alias("rewritten_again"))


@query(
    "json_sidecar",
    """SELECT c_nationkey, count(*) OVER (PARTITION BY c_nationkey) AS n_items, c_custkey, c_name FROM customer""",
)
def _json_sidecar(t: Tables):
    nested = sinks.json_sidecar(
        t.customer, "c_nationkey", F.struct("c_custkey", "c_name"), F.col("c_custkey"), chunk=1_000
    )
    schema = "c_nationkey int, n_items long, items array<struct<c_custkey long, c_name string>>"
    back = nested.select(F.from_json("payload", schema).alias("j"))
    return back.select("j.c_nationkey", "j.n_items", F.inline("j.items"))


@query(
    "report_lines",
    """WITH body AS (SELECT c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) + 1 AS seq,
                  '- ' || c_name || ' (' || c_mktsegment || ')' AS line FROM customer)
    SELECT * FROM body UNION ALL
    SELECT c_nationkey, 1, '## nation ' || c_nationkey || ' (' || count(*) || ')' FROM customer GROUP BY 1""",
)
def _report_lines(t: Tables):
    line = F.concat(F.lit("- "), "c_name", F.lit(" ("), "c_mktsegment", F.lit(")"))
    heading = F.concat(F.lit("## nation "), F.col("c_nationkey").cast("string"), F.lit(" ("), F.col("n_rows").cast("string"), F.lit(")"))
    return sinks.report_lines(t.customer, "c_nationkey", ["c_custkey"], line, heading)


@query(
    "run_log_append",
    """WITH runs AS (SELECT unnest(['run1', 'run2']) AS run_id),
    f AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'FAIL' WHEN 'P' THEN 'WARN' ELSE 'OK' END AS severity FROM orders)
    SELECT run_id, severity, count(*) AS n FROM runs, f GROUP BY 1, 2""",
)
def _run_log_append(t: Tables):
    status = F.col("o_orderstatus")
    found = t.orders.select(
        F.col("o_orderpriority").alias("check"),
        F.when(status == "F", "FAIL").when(status == "P", "WARN").otherwise("OK").alias("severity"),
        F.col("o_orderkey").cast("string").alias("key"),
        F.col("o_orderstatus").alias("detail"),
    )
    path = fresh_path(t.spark, "runlog")
    for run, day in (("run1", "2024-01-01 06:00:00"), ("run2", "2024-01-08 06:00:00")):
        sinks.run_log_append(found, path, run, F.to_timestamp(F.lit(day)))
    return sinks.read_run_log(t.spark, path).groupBy("run_id", "severity").agg(F.count(F.lit(1)).alias("n"))
