"""Queries: operators on the order of lines, turns and classes, and total orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuswarden.functions.text import first_sentence
from corpuswarden.operators import sequence as ops
from corpuswarden.plans.joins_links import HEAD_SQL, headings
from corpuswarden.plans.registry import LINES_SQL, Tables, query
from corpuswarden.plans.scans import document_lines


@query(
    "fence_mask",
    f"""WITH {LINES_SQL}, m AS (SELECT doc_id, line_no, regexp_matches(line, '^[T-Z]') AS f FROM lines)
    SELECT doc_id, line_no, f OR sum(CASE WHEN f THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) % 2 = 1 AS fenced FROM m""",
)
def _fence_mask(t: Tables):
    return ops.fence_mask(document_lines(t), ["doc_id"], "^[T-Z]").select("doc_id", "line_no", "fenced")


@query(
    "section_of_line",
    """SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN turn WHEN role = 'system' THEN -1 END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS section FROM conversations""",
)
def _section_of_line(t: Tables):
    opens = F.when(F.col("role") == "user", F.col("turn")).when(F.col("role") == "system", F.lit(-1).cast("long"))
    return ops.section_of_line(t.conversations, ["conv_id"], "turn", opens).select("conv_id", "turn", "role", "section")


@query(
    "slug_dedupe",
    f"""WITH {HEAD_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, slug ORDER BY line_no) AS n FROM heads)
    SELECT doc_id, line_no, slug, CASE WHEN n > 1 THEN slug || '-' || (n - 1) ELSE slug END AS anchor FROM r""",
)
def _slug_dedupe(t: Tables):
    return ops.slug_dedupe(headings(t), ["doc_id"], "line_no", "heading").select("doc_id", "line_no", "slug", "anchor")


@query(
    "first_definition_wins",
    """WITH RECURSIVE e AS (SELECT p_partkey AS o, p_partkey // 2 AS b, 0 AS pos FROM part UNION ALL SELECT p_partkey, p_partkey // 3, 1 FROM part WHERE p_partkey // 3 <> p_partkey // 2),
    pe AS (SELECT o, b, pos FROM e JOIN part ON p_partkey = b WHERE p_size > 15),
    w(owner, class, path, seen) AS (SELECT p_partkey, p_partkey, CAST([] AS BIGINT[]), [p_partkey] FROM part
      UNION ALL SELECT owner, b, list_append(path, pos), list_append(seen, b) FROM w JOIN pe ON class = o WHERE NOT list_contains(seen, b)),
    m AS (SELECT p_partkey AS class, p_brand AS member, 0 AS pos FROM part UNION ALL SELECT p_partkey, p_name, 1 FROM part),
    r AS (SELECT owner, member, class AS from_class, CAST(len(path) AS BIGINT) AS depth, row_number() OVER (PARTITION BY owner, member ORDER BY path, pos) AS n FROM w JOIN m USING (class))
    SELECT owner, member, from_class, depth FROM r WHERE n = 1""",
)
def _first_definition_wins(t: Tables):
    key = F.col("p_partkey")
    half, third = F.floor(key / 2), F.floor(key / 3)
    bases = t.part.select(key.alias("owner"), half.alias("base"), F.lit(0).alias("pos")).unionByName(
        t.part.where(half != third).select(key.alias("owner"), third.alias("base"), F.lit(1).alias("pos"))
    )
    private = t.part.select(key.alias("base"), (F.col("p_size") > 15).alias("private"))
    members = t.part.select(key.alias("owner"), F.col("p_brand").alias("member"), F.lit(0).alias("pos")).unionByName(
        t.part.select(key.alias("owner"), F.col("p_name").alias("member"), F.lit(1).alias("pos"))
    )
    return ops.first_definition_wins(t.part.select(key.alias("owner")), bases.join(private, "base"), members)


@query(
    "first_sentence",
    r"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(replace(text, ', ', '; '), chr(10)), lambda x: trim(x)), lambda x: x <> '')[1] AS line FROM documents),
    c AS (SELECT doc_id, CASE WHEN strpos(line, '. ') > 1 THEN line[1:strpos(line, '. ')] WHEN strpos(line, '; ') > 1 THEN line[1:strpos(line, '; ')] ELSE coalesce(line, '') END AS s FROM l)
    SELECT doc_id, CASE WHEN length(s) > 100 THEN rtrim(s[1:99]) || '…' ELSE s END AS summary FROM c""",
)
def _first_sentence(t: Tables):
    return t.documents.select("doc_id", first_sentence(F.replace("text", F.lit(", "), F.lit("; "))).alias("summary"))


@query(
    "header_in_first_n",
    "SELECT conv_id FROM conversations GROUP BY 1 HAVING NOT bool_or(role = 'system' AND turn <= 2)",
)
def _header_in_first_n(t: Tables):
    return ops.header_in_first_n(t.conversations, ["conv_id"], "turn", F.col("role") == "system", n=2)


@query(
    "enclosing_scope",
    """WITH s AS (SELECT conv_id, turn, role, text, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS scope FROM conversations)
    SELECT conv_id, turn, scope FROM s WHERE role <> 'user' AND contains(text, 'an')""",
)
def _enclosing_scope(t: Tables):
    user = F.when(F.col("role") == "user", F.col("turn"))
    hit = (F.col("role") != "user") & F.contains("text", F.lit("an"))
    return ops.enclosing_scope(t.conversations, ["conv_id"], "turn", user, hit).select("conv_id", "turn", "scope")


@query(
    "canonical_order",
    """SELECT c_custkey, c_mktsegment, row_number() OVER (ORDER BY CASE c_mktsegment WHEN 'MACHINERY' THEN 1 WHEN 'BUILDING' THEN 2 ELSE 3 END, c_custkey) AS position FROM customer""",
)
def _canonical_order(t: Tables):
    return ops.canonical_order(t.customer.select("c_custkey", "c_mktsegment"), "c_mktsegment", ["MACHINERY", "BUILDING"], ["c_custkey"])


@query(
    "worst_first",
    """WITH o AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1)
    SELECT s_suppkey, n, row_number() OVER (ORDER BY CASE WHEN s_acctbal > 0 THEN CAST(n AS DOUBLE) END ASC NULLS LAST, s_suppkey) AS position FROM supplier LEFT JOIN o ON s_suppkey = l_suppkey""",
)
def _worst_first(t: Tables):
    n = t.lineitem.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count(F.lit(1)).alias("n"))
    rows = t.supplier.select("s_suppkey", "s_acctbal").join(n, "s_suppkey", "left")
    ratio = F.when(F.col("s_acctbal") > 0, F.col("n").cast("double"))
    return ops.worst_first(rows, ratio, ["s_suppkey"]).drop("s_acctbal")


@query(
    "stable_name_order",
    """WITH n AS (SELECT p_partkey, CASE WHEN p_type = 'SMALL' THEN upper(p_name) ELSE p_name END AS name FROM part)
    SELECT p_partkey, name, row_number() OVER (ORDER BY name, p_partkey) AS code_position, row_number() OVER (ORDER BY lower(name), name, p_partkey) AS folded_position FROM n""",
)
def _stable_name_order(t: Tables):
    name = F.when(F.col("p_type") == "SMALL", F.upper("p_name")).otherwise(F.col("p_name"))
    return ops.stable_name_order(t.part.select("p_partkey", name.alias("name")), "name", ["p_partkey"])
