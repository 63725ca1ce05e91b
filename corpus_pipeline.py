"""From raw documents to piece ids: five stages, each written as a table before the next reads it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuswarden.llm.common import prepare
from corpuswarden.llm.decontaminate import without_spans
from corpuswarden.llm.ngram_join import ngram_join
from corpuswarden.llm.pii import mask_pii
from corpuswarden.llm.sentence_pieces import encode
from corpuswarden.llm.toxicity import fit, held_out, score
from corpuswarden.session import materialize

#: Word shingles and least likeness of near copies.
WORDS, THRESHOLD = 5, (80, 100)
PIECES = "piece_bpe_32k.model"
#: No stage but the first can be stated in SQL without its trained model; tests hold the stages against brute force.
ORACLE_SQL = None


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars``, where there is one, told anew from the text."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are likelier harmless than toxic, learned from the labels outside the held-out fifth."""
    model = fit(docs, _table(spark, sf_dir, "labels").where(~held_out()))
    return score(docs, model, carry=True).where("predicted = 0").select("_row.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of smallest id; documents without id stay."""
    prepare(spark)
    lead = ngram_join(docs, WORDS, THRESHOLD).where("doc_id = component_id").select("doc_id").distinct()
    first = docs.join(lead, "doc_id", "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
    return first.unionByName(docs.where("doc_id IS NULL"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with passages of test items cut out of contaminated ones."""
    return _counted(without_spans(docs, _table(spark, sf_dir, "benchmark")))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked by its kind."""
    prepare(spark)
    return _counted(mask_pii(docs))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``n_pieces`` and ``ids`` of every document."""
    prepare(spark)
    return encode(docs, public_tokenizers.path(PIECES)).select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids")


STAGES = [
    ("toxicity", toxicity),
    ("near_copies", near_copies),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("pieces", pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each one keeps is written to the shared folder."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
