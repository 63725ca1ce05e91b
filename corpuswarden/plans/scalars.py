"""Queries: scalar expressions and text scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuswarden.functions import markup, paths, text, versions
from corpuswarden.functions.rows import each_numbered
from corpuswarden.plans.registry import LINES_SQL, Tables, query
from corpuswarden.plans.scans import TREE_SQL, document_lines, source_trees
from corpuswarden.sources import scans


@query(
    "normalize_text",
    r"""WITH d AS (SELECT doc_id, replace(text, '. ', '.  ' || chr(13) || chr(10)) || ' see #L12 and #L7b' AS t FROM documents),
    n AS (SELECT doc_id, array_to_string(list_filter(string_split(regexp_replace(replace(t, chr(13) || chr(10), chr(10)), '(?m)[\p{Zs}\t\v\f]+$', '', 'g'), chr(10)), lambda x: NOT starts_with(x, 'The')), chr(10)) AS t FROM d)
    SELECT doc_id, length(regexp_replace(t, '#L\d+', '#L', 'g')) AS n, sha256(regexp_replace(t, '#L\d+', '#L', 'g')) AS digest FROM n""",
)
def _normalize_text(t: Tables):
    messy = F.concat(F.replace("text", F.lit(". "), F.lit(".  \r\n")), F.lit(" see #L12 and #L7b"))
    norm = text.normalize_text(messy, "The", blank_line_fragments=True)
    return t.documents.select("doc_id", norm.alias("t")).select(
        "doc_id", F.char_length("t").cast("long").alias("n"), text.content_digest(F.col("t")).alias("digest")
    )


@query(
    "content_digest",
    f"""WITH {TREE_SQL} SELECT CAST(doc_id AS VARCHAR) AS key, sha256(text) AS digest, md5(concat_ws(chr(10), doc_id, lang, CASE WHEN n_chars > 100 THEN source ELSE '' END))[1:12] AS short FROM documents
    UNION ALL SELECT source, digest, NULL FROM trees""",
)
def _content_digest(t: Tables):
    docs = t.documents.select(
        F.col("doc_id").cast("string").alias("key"),
        text.content_digest(F.col("text")).alias("digest"),
        text.short_digest(F.col("doc_id"), F.col("lang"), F.when(F.col("n_chars") > 100, F.col("source"))).alias("short"),
    )
    trees = source_trees(t).select(F.col("source").alias("key"), "digest", F.lit(None).cast("string").alias("short"))
    return docs.unionByName(trees)


@query(
    "strip_markup",
    r"""SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<script.*?</script>', '', 'g'), '(?is)<style.*?</style>', '', 'g')) AS digest,
      length(regexp_replace(replace(html, '%', '`'), '`[^`\n]*`', '', 'g')) AS n_without_code, regexp_replace(lower(url), '[^\p{L}\p{N}_-]', '', 'g') AS anchor FROM pages""",
)
def _strip_markup(t: Tables):
    code = text.strip_inline_code(F.replace("html", F.lit("%"), F.lit("`")))
    return t.pages.select(
        "page_id",
        F.md5(markup.strip_invisible(F.col("html"))).alias("digest"),
        F.char_length(code).cast("long").alias("n_without_code"),
        text.anchor_for(F.col("url")).alias("anchor"),
    )


@query(
    "markup_balance",
    r"""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<script.*?</script>', '', 'g'), '(?is)<style.*?</style>', '', 'g') AS h FROM pages),
    t AS (SELECT page_id, lower(unnest(regexp_extract_all(h, '<([a-zA-Z][a-zA-Z0-9]*)(?:\s[^>]*[^/>]|\s*)>', 1))) AS tag, 1 AS n FROM p
          UNION ALL SELECT page_id, lower(unnest(regexp_extract_all(h, '</([a-zA-Z][a-zA-Z0-9]*)\s*>', 1))), -1 FROM p)
    SELECT page_id, tag, CAST(sum(n) AS BIGINT) AS surplus FROM t WHERE tag NOT IN ('area','base','br','col','embed','hr','img','input','link','meta','source','track','wbr') GROUP BY 1, 2 HAVING sum(n) <> 0""",
)
def _markup_balance(t: Tables):
    return markup.markup_balance(t.pages, "html", ["page_id"])


@query(
    "markup_well_formed",
    r"""WITH h AS (SELECT page_id, html, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<script.*?</script>', '', 'g'), '(?is)<style.*?</style>', '', 'g'), '(?i)<!doctype[^>]*>', '', 'g') AS p FROM pages),
    t AS (SELECT page_id, html, regexp_replace(regexp_replace(p, '</?[A-Za-z_][A-Za-z0-9_:.-]*(?:\s+[A-Za-z_:][A-Za-z0-9_:.-]*\s*=\s*(?:"[^"<]*"|''[^''<]*''))*\s*/?>', '', 'g'), '&[a-zA-Z#0-9]+;', '', 'g') AS rest,
        list_transform(regexp_extract_all(p, '</?[A-Za-z_][A-Za-z0-9_:.-]*(?:\s+[A-Za-z_:][A-Za-z0-9_:.-]*\s*=\s*(?:"[^"<]*"|''[^''<]*''))*\s*/?>'),
          lambda x: CASE WHEN starts_with(x, '</') THEN '-' WHEN ends_with(x, '/>') OR list_contains(['area','base','br','col','embed','hr','img','input','link','meta','source','track','wbr'], lower(regexp_extract(x, '^<([A-Za-z0-9_:.-]+)', 1))) THEN '.' ELSE '+' END
            || regexp_extract(x, '^</?([A-Za-z0-9_:.-]+)', 1)) AS tags FROM h),
    f AS (SELECT *, list_reduce(tags, lambda acc, x: CASE WHEN acc = '' OR x[1] = '.' THEN acc WHEN x[1] = '+' THEN acc || x[2:] || '>'
        WHEN ends_with(acc, '>' || x[2:] || '>') THEN acc[1:length(acc) - length(x)] ELSE '' END, '>') AS open FROM t)
    SELECT page_id, CASE WHEN NOT contains(html, '<') AND NOT contains(html, '&') THEN 'skipped' WHEN regexp_matches(rest, '[<&]') OR open <> '>' THEN 'malformed' ELSE 'ok' END AS state, open AS left_open, CAST(length(rest) AS BIGINT) AS n_rest FROM f""",
)
def _markup_well_formed(t: Tables):
    return t.pages.select(
        "page_id",
        markup.markup_state(F.col("html")).alias("state"),
        markup.open_elements(F.col("html")).alias("left_open"),
        F.char_length(markup.text_between(F.col("html"))).cast("long").alias("n_rest"),
    )


@query(
    "version_parts",
    r"""WITH v AS (SELECT p_partkey, 'x = 1' || chr(10) || '__version__ = "' || p_size || '.' || (p_partkey // 50) || CASE WHEN p_brand = 'Brand#9' THEN '' ELSE '.' || length(p_name) END || '"' AS t FROM part),
    r AS (SELECT p_partkey, nullif(regexp_extract(t, '(?m)^__version__\s*=\s*[''"](\d+[.]\d+[.]\d+)[''"]', 1), '') AS version FROM v),
    i AS (SELECT *, list_transform(string_split(version, '.'), lambda x: CAST(x AS INTEGER)) AS a FROM r)
    SELECT p_partkey, version, CASE WHEN version IS NOT NULL THEN a[1] || '.' || a[2] || '.' || (a[3] + 1) END AS bumped, coalesce(a < [25, 3, 0], false) AS older, coalesce(version < '25.3.0', false) AS older_as_text FROM i""",
)
def _version_parts(t: Tables):
    last = F.when(F.col("p_brand") != "Brand#9", F.concat(F.lit("."), F.char_length("p_name").cast("string"))).otherwise("")
    source = F.concat(
        F.lit('x = 1\n__version__ = "'), F.col("p_size").cast("string"), F.lit("."), F.floor(F.col("p_partkey") / 50).cast("string"), last, F.lit('"')
    )
    v = F.col("version")
    return t.part.select("p_partkey", versions.read_version(source).alias("version")).select(
        "p_partkey",
        "version",
        F.when(v.isNotNull(), versions.bump_patch(v)).alias("bumped"),
        versions.is_lower(v, F.lit("25.3.0")).alias("older"),
        F.coalesce(v < "25.3.0", F.lit(False)).alias("older_as_text"),
    )


@query(
    "url_slug",
    r"""WITH u AS (SELECT page_id, url, regexp_replace(url, '\.html$', '.git') AS g FROM pages)
    SELECT page_id, nullif(regexp_extract(g, '\.example\.com[:/]([^/]+/[^/]+?)(?:\.git)?$', 1), '') AS slug, regexp_replace(lower(url), '[-_.]+', '-', 'g') AS index_name FROM u""",
)
def _url_slug(t: Tables):
    url = F.regexp_replace("url", r"\.html$", ".git")
    return t.pages.select(
        "page_id", paths.repo_slug(url, ".example.com").alias("slug"), paths.index_name(F.col("url")).alias("index_name")
    )


@query("path_fold", r"""SELECT page_id, regexp_replace(url, '[:\\/_]', '-', 'g') AS key FROM pages""")
def _path_fold(t: Tables):
    return t.pages.select("page_id", paths.flat_key(F.col("url")).alias("key"))


@query(
    "date_age",
    r"""WITH d AS (SELECT o_orderkey, CASE o_orderpriority WHEN '5-LOW' THEN strftime(o_orderdate, '%d/%m/%Y') WHEN '4-NOT SPECIFIED' THEN '1998-13-01' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day, o_orderdate FROM orders)
    SELECT o_orderkey, day, regexp_matches(day, '^\d{4}-\d{2}-\d{2}$') AS shape_ok, CASE WHEN regexp_matches(day, '^\d{4}-\d{2}-\d{2}$') THEN TRY_CAST(day AS DATE) END IS NOT NULL AS readable,
      CAST(date_diff('day', o_orderdate, TIMESTAMP '2000-01-01') AS DOUBLE) AS age_days, date_diff('day', o_orderdate, TIMESTAMP '2000-01-01') <= 30 AS within FROM d""",
)
def _date_age(t: Tables):
    shape = r"^\d{4}-\d{2}-\d{2}$"
    day = (
        F.when(F.col("o_orderpriority") == "5-LOW", F.date_format("o_orderdate", "dd/MM/yyyy"))
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "1998-13-01")
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    )
    age = text.days_between(F.expr("TIMESTAMP_NTZ '2000-01-01'"), F.col("o_orderdate"))
    return t.orders.select("o_orderkey", day.alias("day"), age.alias("age_days")).select(
        "o_orderkey",
        "day",
        F.col("day").rlike(shape).alias("shape_ok"),
        (F.col("day").rlike(shape) & F.try_to_date("day", "yyyy-MM-dd").isNotNull()).alias("readable"),
        "age_days",
        (F.col("age_days") <= 30).alias("within"),
    )


@query(
    "definition_scan",
    f"WITH {LINES_SQL} SELECT doc_id, line_no, regexp_extract(line, '^([A-Z][a-z]+) ', 1) AS name FROM lines WHERE regexp_matches(line, '^([A-Z][a-z]+) ')",
)
def _definition_scan(t: Tables):
    return scans.definition_scan(document_lines(t), ["doc_id"], "^([A-Z][a-z]+) ")


@query(
    "aliased_call_join",
    r"""WITH w AS (SELECT conv_id, turn, role, string_split_regex(text, '[ \n]+') AS ws FROM conversations),
    a AS (SELECT DISTINCT conv_id, regexp_replace(lower(ws[1]), '[.,]', '', 'g') AS alias, 'f' || length(regexp_replace(ws[1], '[.,]', '', 'g')) AS fn FROM w WHERE role = 'user'),
    x AS (SELECT conv_id, turn, unnest(range(1, len(ws) + 1)) AS pos, unnest(ws) AS word FROM w WHERE role <> 'user'),
    c AS (SELECT conv_id, turn, pos, regexp_replace(lower(word), '[.,]', '', 'g') AS alias, ends_with(word, ',') AS kw FROM x)
    SELECT conv_id, turn, pos, alias, fn AS function FROM c JOIN a USING (conv_id, alias) WHERE fn NOT IN ('f2', 'f3') OR kw""",
)
def _aliased_call_join(t: Tables):
    words = t.conversations.select("conv_id", "turn", "role", F.split("text", "[ \n]+").alias("ws"))
    bare = lambda c: F.regexp_replace(c, "[.,]", "")
    first = F.get("ws", F.lit(0))
    aliases = words.where("role = 'user'").select(
        "conv_id", bare(F.lower(first)).alias("alias"), F.concat(F.lit("f"), F.char_length(bare(first)).cast("string")).alias("function")
    )
    calls = each_numbered(words.where("role <> 'user'"), ["conv_id", "turn"], F.col("ws"), "pos", "word").select(
        "conv_id", "turn", "pos", bare(F.lower("word")).alias("alias"), F.endswith("word", F.lit(",")).alias("has_keyword")
    )
    hits = scans.alias_hits(aliases, calls, "conv_id", "alias", keyword_needed=["f2", "f3"])
    return hits.select("conv_id", "turn", "pos", "alias", "function")


def source_texts(t: Tables):
    """One source text per conversation: a statement per turn, some over several lines."""
    size, pad = F.char_length("text"), F.repeat(F.lit("    "), F.pmod(F.col("turn"), F.lit(3)).cast("int"))
    turn = F.col("turn").cast("string")
    system = F.when(size % 3 == 0, "import os, tempfile as tf").when(size % 3 == 1, "from tempfile import (mkdtemp as mk,\n    NamedTemporaryFile)").otherwise("import tempfile")
    user = F.concat(pad, F.lit("def f"), turn, F.lit("(a, b=(1, 2)):"))
    said = (
        F.when(size % 6 == 0, "p = tf.mkdtemp()")
        .when(size % 6 == 1, "q = NamedTemporaryFile(delete=False)")
        .when(size % 6 == 2, "q = NamedTemporaryFile(\n  mode='(',\ndelete=True)")
        .when(size % 6 == 3, "r = mk()  # tf.mkdtemp()")
        .when(size % 6 == 4, "s = 'tf.mkdtemp()'; t = tempfile.mkstemp()")
        .otherwise("q = tempfile.NamedTemporaryFile(\n  mode='w',\n  delete = flag)")
    )
    line = F.when(F.col("turn") == 0, system).when(F.col("role") == "user", user).otherwise(F.concat(pad, F.lit("    "), said))
    texts = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("l"))
    return texts.select("conv_id", F.array_join(F.col("l.line"), "\n").alias("text"))


@query(
    "aliased_call_scan",
    """WITH s AS (SELECT conv_id, turn, role, length(text) AS n, CASE WHEN turn = 0 THEN 0 WHEN role = 'user' THEN 4 * (turn % 3) ELSE 4 * (turn % 3) + 4 END AS ind,
        CASE WHEN turn = 0 THEN CASE WHEN length(text) % 3 = 1 THEN 2 ELSE 1 END WHEN role <> 'user' AND length(text) % 6 IN (2, 5) THEN 3 ELSE 1 END AS size FROM conversations),
    p AS (SELECT *, CAST(1 + coalesce(sum(size) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS line_no FROM s),
    i AS (SELECT conv_id, bool_or(n % 3 = 0) AS tf, bool_or(n % 3 = 1) AS fn, bool_or(n % 3 = 2) AS tm FROM p WHERE turn = 0 GROUP BY 1),
    c AS (SELECT conv_id, turn, line_no, ind, CASE n % 6 WHEN 0 THEN 'tf.mkdtemp' WHEN 1 THEN 'NamedTemporaryFile' WHEN 3 THEN 'mk' WHEN 4 THEN 'tempfile.mkstemp' WHEN 5 THEN 'tempfile.NamedTemporaryFile' END AS label,
            CASE n % 6 WHEN 0 THEN 'mkdtemp' WHEN 1 THEN 'NamedTemporaryFile' WHEN 3 THEN 'mkdtemp' WHEN 4 THEN 'mkstemp' WHEN 5 THEN 'NamedTemporaryFile' END AS function
          FROM p JOIN i USING (conv_id) WHERE turn > 0 AND role <> 'user' AND CASE n % 6 WHEN 0 THEN tf WHEN 1 THEN fn WHEN 2 THEN false WHEN 3 THEN fn ELSE tm END),
    d AS (SELECT c.conv_id, c.line_no, max(u.turn) AS t FROM c JOIN p u ON u.conv_id = c.conv_id AND u.turn > 0 AND u.role = 'user' AND u.turn < c.turn AND u.ind < c.ind
          AND NOT EXISTS (SELECT 1 FROM p x WHERE x.conv_id = u.conv_id AND x.turn > u.turn AND x.turn < c.turn AND x.ind <= u.ind) GROUP BY 1, 2)
    SELECT conv_id, line_no, label, function, 'f' || t AS scope FROM c LEFT JOIN d USING (conv_id, line_no)""",
)
def _aliased_call_scan(t: Tables):
    lines = scans.line_scan(source_texts(t), "text", ["conv_id"], "file")
    return scans.aliased_call_scan(lines, ["conv_id"], "tempfile", ["mkstemp", "mkdtemp"], {"NamedTemporaryFile": ("delete", ["True", "1"])})
