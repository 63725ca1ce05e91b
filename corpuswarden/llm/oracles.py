"""SQL of the queries whose contract can be stated as such."""

from __future__ import annotations

# The CRC-32 of the UTF-8 bytes of ``s``: its table from the rule, and a fold over the bytes.
CRC_TABLE_SQL = r"""
crc_bits AS (SELECT i, list_reduce(list_prepend(CAST(i AS UINTEGER), [CAST(b AS UINTEGER) FOR b IN range(8)]),
               lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS UINTEGER)) ELSE c >> 1 END) AS v FROM range(256) t(i)),
crc_table AS (SELECT list(v ORDER BY i) AS tab FROM crc_bits)"""


def crc_sql(s: str) -> str:
    byte = f"CAST(CAST('0x' || substr(hex(encode({s})), 2 * i + 1, 2) AS INTEGER) AS UINTEGER)"
    taken = f"list_transform(range(octet_length(encode({s}))), lambda i: {byte})"
    folded = f"list_reduce({taken}, lambda c, x: xor(tab[CAST(xor(c, x) & 255 AS BIGINT) + 1], c >> 8), CAST(4294967295 AS UINTEGER))"
    return f"CAST(xor({folded}, CAST(4294967295 AS UINTEGER)) AS BIGINT)"


LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
RUNS = r"unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+'))"

SPELLING_SQL = rf"""
WITH RECURSIVE {CRC_TABLE_SQL},
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, {LOWER.format(RUNS)} AS run FROM documents),
told AS (SELECT doc, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY 1, 2),
summed AS (SELECT run, n, {crc_sql("(doc || ':' || run)")} AS h FROM told, crc_table),
kept AS (SELECT CASE WHEN h % 31 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM summed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM kept WHERE length(word) >= 7 GROUP BY 1 HAVING sum(n) >= 2),
cut AS (SELECT word, i, word[1:i - 1] || word[i + 1:] AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (SELECT DISTINCT cut.word AS a, words.word AS b FROM cut JOIN words ON rest = words.word
          UNION SELECT DISTINCT words.word, cut.word FROM cut JOIN words ON rest = words.word
          UNION SELECT a.word, b.word FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word),
near AS (SELECT a AS word, b, w.n, row_number() OVER (PARTITION BY a ORDER BY w.n DESC, b) AS r, count(*) OVER (PARTITION BY a) AS n_near FROM pairs JOIN words w ON w.word = b),
formed AS (SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN near.n >= 10 * words.n THEN b END AS form, CASE WHEN near.n >= 10 * words.n THEN near.n END AS form_n
           FROM words LEFT JOIN near ON near.word = words.word AND r = 1),
steps AS (SELECT word, word AS root, 0 AS depth FROM formed UNION ALL SELECT steps.word, form, depth + 1 FROM steps JOIN formed ON formed.word = steps.root WHERE form IS NOT NULL),
roots AS (SELECT word, max_by(root, depth) AS root FROM steps GROUP BY 1)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN roots USING (word)
"""

CONVERSATIONS_SQL = rf"""
WITH RECURSIVE {CRC_TABLE_SQL},
raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
hashed AS (SELECT raw.*, {crc_sql("key")} % 20 AS f FROM raw, crc_table),
damaged AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, copy
            FROM hashed JOIN (SELECT unnest([0, 1]) AS copy) ON copy = 0 OR f = 3 WHERE f <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS pos, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS body FROM damaged),
marked AS (SELECT conv_id, turn, role, text, pos, left(role, 1) AS ini, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS before,
             CASE WHEN body = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'd' WHEN right(body, 1) IN ('.', '!', '?') THEN '-' ELSE 't' END AS fault FROM placed),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate,
             count(*) FILTER (WHERE fault = 't') AS truncated, count(*) FILTER (WHERE before || ini NOT IN ('su', 'ua', 'au')) AS illegal, max(pos) AS last FROM marked GROUP BY 1),
-- from the end: the best of each state (none, s, u, a so far) before a row
best(conv_id, pos, s) AS (
  SELECT conv_id, last + 1, [{{'c': 0, 'a': '', 'o': ''}}, {{'c': 10, 'a': 'II', 'o': chr(10) || 'user:' || chr(10) || 'assistant:'}}, {{'c': 5, 'a': 'I', 'o': chr(10) || 'assistant:'}}, {{'c': 0, 'a': '', 'o': ''}}] FROM counts
  UNION ALL
  SELECT conv_id, pos, list_transform([1, 2, 3, 4], lambda q: list_min([v[q],
      {{'c': v[CASE WHEN q = 3 THEN 4 ELSE 3 END].c + 5, 'a': 'I' || v[CASE WHEN q = 3 THEN 4 ELSE 3 END].a, 'o': chr(10) || CASE WHEN q = 3 THEN 'assistant:' ELSE 'user:' END || v[CASE WHEN q = 3 THEN 4 ELSE 3 END].o}},
      {{'c': v[CASE WHEN q = 3 THEN 3 ELSE 4 END].c + 10, 'a': 'II' || v[CASE WHEN q = 3 THEN 3 ELSE 4 END].a,
        'o': chr(10) || CASE WHEN q = 3 THEN 'assistant:' || chr(10) || 'user:' ELSE 'user:' || chr(10) || 'assistant:' END || v[CASE WHEN q = 3 THEN 3 ELSE 4 END].o}}]))
  FROM (SELECT b.conv_id, m.pos, list_transform([1, 2, 3, 4], lambda q: list_min([{{'c': s[q].c + 2, 'a': 'D' || s[q].a, 'o': s[q].o}},
      CASE WHEN fault IN ('b', 'd') THEN NULL ELSE {{'c': s[CASE WHEN q = 3 THEN 4 ELSE 3 END].c + 1 + CASE WHEN fault = 't' THEN 5 ELSE 0 END, 'a': 'R' || s[CASE WHEN q = 3 THEN 4 ELSE 3 END].a,
        'o': chr(10) || CASE WHEN q = 3 THEN 'assistant:' ELSE 'user:' END || text || s[CASE WHEN q = 3 THEN 4 ELSE 3 END].o}} END,
      CASE WHEN fault IN ('b', 'd') OR NOT CASE ini WHEN 's' THEN q = 1 WHEN 'u' THEN q <> 3 WHEN 'a' THEN q = 3 ELSE false END THEN NULL
        ELSE {{'c': s[CASE ini WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END].c + CASE WHEN fault = 't' THEN 5 ELSE 0 END, 'a': 'K' || s[CASE ini WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END].a,
        'o': chr(10) || role || ':' || text || s[CASE ini WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END].o}} END])) AS v
    FROM best b JOIN marked m ON m.conv_id IS NOT DISTINCT FROM b.conv_id AND m.pos = b.pos - 1)),
done AS (SELECT conv_id, s[1].c AS c, s[1].a AS a, s[1].o AS o FROM best WHERE pos = 1),
every AS (SELECT DISTINCT conv_id FROM conversations)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(c, 0) AS BIGINT) AS cost, coalesce(a, '') AS audit, sha256(coalesce(o[2:], '')) AS repaired_sha256
FROM every e LEFT JOIN counts k ON k.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM e.conv_id
"""

NGRAM_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1:i + least(4, len(w))], ' ') AS s FROM (SELECT doc_id, w, unnest(range(len(w) - least(4, len(w)) + 1)) AS i FROM d WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT a, b FROM both_ways UNION SELECT reached.a, both_ways.b FROM reached JOIN both_ways ON reached.b = both_ways.a),
least_of AS (SELECT a, min(b) AS m FROM reached GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id
FROM d LEFT JOIN sizes ON sizes.doc_id = d.doc_id LEFT JOIN least_of ON a = d.doc_id
"""
