"""One query per operator over its whole tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from corpuswarden.llm.conversations import audit_conversations
from corpuswarden.llm.decontaminate import decontaminate
from corpuswarden.llm.fingerprints import fingerprint_pairs
from corpuswarden.llm.license_scan import scan_licenses
from corpuswarden.llm.ngram_join import ngram_join
from corpuswarden.llm.oracles import CONVERSATIONS_SQL, NGRAM_SQL, SPELLING_SQL
from corpuswarden.llm.packing import pack
from corpuswarden.llm.pii import BASE, find_pii
from corpuswarden.llm.registry import ORACLE, QUERIES, Tables, query
from corpuswarden.llm.secrets import find_secrets
from corpuswarden.llm.sentence_pieces import decode, encode
from corpuswarden.llm.spelling import spelling_variants
from corpuswarden.llm.substrings import repeated_passages
from corpuswarden.llm.token_files import checksums, write_tokens
from corpuswarden.llm.toxicity import fit as fit_toxicity
from corpuswarden.llm.toxicity import held_out, score
from corpuswarden.session import fresh_path

__all__ = ["ORACLE", "QUERIES"]

DECONTAMINATE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bi AS (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(0, len(w) - least(13, len(w)) + 1)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i + 1:i + n], ' ') AS win FROM bi),
sizes AS (SELECT DISTINCT n FROM bw),
di AS (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n),
hits AS (SELECT doc_id, item_id, i, bw.n FROM di JOIN bw ON bw.n = di.n AND bw.win = array_to_string(w[i + 1:i + di.n], ' ')),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
          FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)
"""


def _spans_text(spans):
    """``kind:start:end`` of all spans, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


@query("op1_secrets")
def op1(t: Tables):
    base = F.filter("spans", lambda s: s["kind"] != "random")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return find_secrets(t.documents).select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")],
        F.sha2(_spans_text(base), 256).alias("base_sha256"),
        _spans_text("spans").alias("spans"),
        count("random").alias("n_random"),
    )


@query("op2_sentence_pieces")
def op2(t: Tables):
    path = public_tokenizers.path("piece_bpe_32k.model")
    back = decode(encode(t.documents, path), path)
    return back.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_pieces"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


@query("op3_fingerprints")
def op3(t: Tables):
    return fingerprint_pairs(t.documents)


@query("op4_substrings")
def op4(t: Tables):
    text = F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"], s["partner"]))
    return repeated_passages(t.documents).select(
        "doc_id", "n_words", "n_repeated", "class_id", "copies", F.size("spans").cast("long").alias("n_spans"), F.concat_ws(",", text).alias("spans")
    )


@query("op5_ngram_join", NGRAM_SQL)
def op5(t: Tables):
    return ngram_join(t.documents, words=4, threshold=(85, 100))


@query("op6_toxicity")
def op6(t: Tables):
    model = fit_toxicity(t.documents, t.labels.where(~held_out()))
    nearest = F.transform(F.slice("neighbours", 1, 3), lambda n: F.concat_ws(":", n["doc_id"], n["label"], F.round(n["cosine"], 4)))
    return score(t.documents, model).select(
        "doc_id", held_out().alias("held_out"), "score", "predicted", F.concat_ws(",", nearest).alias("evidence")
    )


@query("op7_pii")
def op7(t: Tables):
    count = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long")
    return find_pii(t.documents).select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in BASE],
        F.sha2(_spans_text(F.filter("spans", lambda s: s["base"])), 256).alias("base_sha256"),
        _spans_text("spans").alias("spans"),
    )


@query("op8_decontaminate", DECONTAMINATE_SQL)
def op8(t: Tables):
    found = decontaminate(t.documents, t.benchmark)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"),
        "contaminated",
    )


@query("op9_license_scan")
def op9(t: Tables):
    text = F.transform("spans", lambda s: F.concat_ws(":", s["license"], s["start"], s["end"], F.round(s["coverage"], 4)))
    return scan_licenses(t.documents).select(
        "doc_id",
        "n_words",
        F.size("spans").cast("long").alias("n_spans"),
        F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]).alias("n_covered"),
        F.concat_ws(",", text).alias("spans"),
    )


@query("op10_token_files")
def op10(t: Tables):
    path = fresh_path(t.spark, "token-files")
    return checksums(write_tokens(t.documents, path, public_tokenizers.path("word_bpe_49k.json"), end_id=2, by_word=True))


@query("op11_packing")
def op11(t: Tables):
    packed = pack(t.documents, public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1, by_word=True)
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


@query("op12_spelling", SPELLING_SQL)
def op12(t: Tables):
    return spelling_variants(t.documents)


@query("op13_conversations", CONVERSATIONS_SQL)
def op13(t: Tables):
    return audit_conversations(t.conversations)
