"""Toxicity by the nearest labelled examples.

A bounded sample of labelled documents becomes an inverted index of TF-IDF
weights. Its documents are dealt in blocks, and for every term the greatest
weight in each block is known. Summed over a query's terms these bound the
cosine of every document in the block, so blocks that can't hold one of the
nearest are skipped and the nearest are still exact. The neighbours vote with
their cosine; an isotonic fit over the examples themselves, each asked without
itself, turns votes into probabilities.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, FloatType, IntegerType, LongType, StringType, StructField, StructType

from corpuswarden.llm.common import MARKS, map_texts, prepare, word_hashes
from corpuswarden.session import materialize

#: Labelled documents of each class that are learned from, at most.
EXAMPLES = 2_000
#: Terms kept, at most: those whose occurrence depends most on the class.
TERMS = 4_000
#: Least chi-squared value of a kept term (one in a thousand by chance).
LEAST_CHI = 10.83
NEIGHBOURS, BLOCK = 15, 64
#: Blocks visited in the first pass; the second takes all that it leaves open.
FIRST = 8
#: Sizes of word beginnings that are terms too, for words that vary in their ends.
PREFIXES = (4, 5, 6)


def terms_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct terms of a text as sorted numbers, and how often each occurs."""
    return np.unique(word_hashes(text, MARKS, PREFIXES), return_counts=True)


@dataclass
class ToxicityModel:
    """The index over the examples, and the steps of the calibration."""

    vocabulary: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))  # sorted term numbers
    idf: np.ndarray = field(default_factory=lambda: np.empty(0))
    start: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))  # of each term's postings
    document: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    weight: np.ndarray = field(default_factory=lambda: np.empty(0))
    bound: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))  # greatest weight by term and block
    blocks: np.ndarray = field(default_factory=lambda: np.zeros((0, 1), np.int64))  # where blocks begin in postings
    label: np.ndarray = field(default_factory=lambda: np.empty(0))
    vote: np.ndarray = field(default_factory=lambda: np.empty(0))  # what a document's vote counts
    names: list = field(default_factory=list)
    steps: tuple = (np.array([-1.0]), np.array([0.0]))  # votes from which a probability holds

    def query(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of a text's terms in the vocabulary, and their weights, of length 1."""
        at = np.searchsorted(self.vocabulary, terms)
        here = at < len(self.vocabulary)
        here[here] = self.vocabulary[at[here]] == terms[here]
        at = at[here]
        weight = (1 + np.log(counts[here])) * self.idf[at]
        return at, weight / (np.sqrt((weight * weight).sum()) or 1.0)

    def nearest(self, at: np.ndarray, weight: np.ndarray, k: int = NEIGHBOURS, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of greatest cosine, exactly, and the cosines; only those above 0.

        Blocks are visited from the greatest bound down: FIRST of them, then
        all others whose bound reaches the k-th best cosine so far. Equal cosines go by place in the index."""
        found, value = np.empty(0, np.int64), np.empty(0)
        if not len(at) or not len(self.label):
            return found, value
        limit = weight @ self.bound[at]
        order = np.argsort(-limit, kind="stable")
        ranked, edges = -limit[order], self.blocks[at]
        least, i = 0.0, 0
        for step in (FIRST, len(order)):
            # bounds above 0 that reach the k-th best
            end = min(np.searchsorted(ranked, 0.0, side="left"), np.searchsorted(ranked, 1e-9 - least, side="right"), i + step)
            if end <= i:
                break
            visit, i = order[i:end], end
            low = edges[:, visit]
            size = (edges[:, visit + 1] - low).ravel()
            ends = np.cumsum(size)
            place = np.repeat(low.ravel() - ends + size, size) + np.arange(ends[-1])
            part = np.repeat(weight, size.reshape(low.shape).sum(axis=1)) * self.weight[place]
            cosine = np.bincount(self.document[place], weights=part, minlength=len(self.label))
            if without >= 0:
                cosine[without] = 0.0
            near = np.flatnonzero(cosine >= least - 1e-9) if least else np.flatnonzero(cosine)
            found, value = np.concatenate([found, near]), np.concatenate([value, cosine[near]])
            if len(value) > k:
                enough = value >= np.partition(value, len(value) - k)[len(value) - k] - 1e-9
                found, value = found[enough], value[enough]
            best = np.lexsort((found, -np.round(value, 12)))[:k]
            found, value = found[best], value[best]
            least = value[-1] if len(value) == k else 0.0
        return found, value

    def votes(self, found: np.ndarray, value: np.ndarray) -> float:
        """Share of the neighbours' votes for label 1, weighted by their cosine; -1 without neighbours.

        Half a vote is added on the side of label 0, so that few and far
        neighbours say little."""
        if not len(found):
            return -1.0
        weight = value * self.vote[found]
        return float((weight * self.label[found]).sum() / (weight.sum() + 0.5))

    def probability(self, vote: float) -> float:
        low, p = self.steps
        return float(p[max(0, np.searchsorted(low, vote, side="right") - 1)])


def _isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising steps of the weighted mean of y over x, by pooling neighbours that fall."""
    pools: list[list[float]] = []
    for v in np.unique(x):
        here = x == v
        pools.append([float(v), float((y[here] * w[here]).sum()), float(w[here].sum())])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            _, a, b = pools.pop()
            pools[-1][1] += a
            pools[-1][2] += b
    return np.array([p[0] for p in pools]), np.array([p[1] / p[2] for p in pools])


def _dependence(seen: np.ndarray | Column, bad: np.ndarray | Column, n: float, ones: float) -> np.ndarray | Column:
    """Chi-squared of terms that ``seen`` of ``n`` examples hold, ``bad`` of them among the ``ones`` of label 1."""
    apart = bad * n - seen * ones
    return apart * apart * n / (seen * (n - seen) * (ones * (n - ones)))


def choose_terms(examples: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the terms of greatest dependence, ties by number, and how many examples hold each."""
    label = np.array([e[1] for e in examples], float)
    rows = np.repeat(np.arange(len(examples)), [len(e[2]) for e in examples])
    every, inverse = np.unique(np.concatenate([e[2] for e in examples]).view(np.int64), return_inverse=True)
    seen = np.bincount(inverse, minlength=len(every)).astype(float)
    bad = np.bincount(inverse, weights=label[rows], minlength=len(every))
    some = (seen > 1) & (seen < len(label))
    every, seen = every[some], seen[some]
    chi = _dependence(seen, bad[some], float(len(label)), label.sum())
    chosen = np.lexsort((every, -chi))[:TERMS]
    chosen = chosen[chi[chosen] >= LEAST_CHI]
    return every[chosen].view(np.uint64), seen[chosen]


def build(examples: list[tuple], share: float, terms: tuple[np.ndarray, np.ndarray] | None = None) -> ToxicityModel:
    """Model from examples (name, label, terms, counts) where ``share`` of all labels are 1.

    ``terms`` are those to be kept, as of ``choose_terms``, if they are known already."""
    model = ToxicityModel()
    label = np.array([e[1] for e in examples], float)
    if not len(examples) or label.min() == label.max():
        model.steps = (np.array([-1.0]), np.array([float(label[0]) if len(examples) else 0.0]))
        return model
    n, ones = len(label), label.sum()
    chosen, seen = choose_terms(examples) if terms is None else terms
    by_number = np.argsort(chosen)
    model.vocabulary, model.idf = chosen[by_number], np.log((n + 1) / (seen[by_number] + 1)) + 1
    queries = [model.query(e[2], e[3]) for e in examples]
    # like documents stand together, so that blocks differ in what they hold
    strongest = [int(at[np.argmax(w)]) if len(at) else -1 for at, w in queries]
    order = np.lexsort((np.arange(n), label, strongest))
    examples, queries = [examples[i] for i in order], [queries[i] for i in order]
    model.label, model.names = label[order], [e[0] for e in examples]
    # the sample holds the classes in other shares than all labels do
    ratio = np.array([(1 - share) / (n - ones), share / ones]) * n
    model.vote = np.ones(n)
    document = np.repeat(np.arange(n), [len(at) for at, _ in queries])
    term, weight = (np.concatenate(x) for x in zip(*queries))
    by_term = np.lexsort((document, term))
    model.document, model.weight, term = document[by_term], weight[by_term], term[by_term]
    count = len(chosen)
    blocks = -(-n // BLOCK)
    place = term * blocks + model.document // BLOCK
    model.bound = np.zeros(count * blocks)
    np.maximum.at(model.bound, place, model.weight)
    model.bound = model.bound.reshape(count, blocks)
    edges = np.searchsorted(place, np.arange(count * blocks + 1))
    model.blocks = np.stack([edges[i * blocks : (i + 1) * blocks + 1] for i in range(count)]) if count else np.zeros((0, blocks + 1), np.int64)
    votes = np.array([model.votes(*model.nearest(*q, without=i)) for i, q in enumerate(queries)])
    model.steps = _isotonic(votes, model.label, ratio[model.label.astype(int)])
    return model


def fit(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> ToxicityModel:
    """Learn from the labelled documents: those of each class with the smallest hashes of
    their ids, ``examples`` at most.

    ``labels`` has ``doc_id`` and ``toxic``; an id with several labels counts as 1
    if one of them is 1, and null labels and ids are left out. Without labels every score is
    0, with one class only every score is that class."""
    prepare(docs.sparkSession)
    label = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where("toxic IS NOT NULL")
    known = label.select(F.col("doc_id").alias("_id"), F.when(F.col("toxic") > 0, 1).otherwise(0).alias("_label"))
    found = {r["_label"]: r["count"] for r in known.groupBy("_label").count().collect()}
    share = found.get(1, 0) / max(1, sum(found.values()))
    sample = None
    for value in (0, 1):
        part = known.where(F.col("_label") == value).orderBy(F.xxhash64("_id"), "_id").limit(examples)
        sample = part if sample is None else sample.union(part)
    # twice `examples` ids at most
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_id"))

    def make() -> Callable[[list[str]], list]:
        def work(texts: list[str]) -> list:
            terms = [terms_of(t) for t in texts]
            return [[t.tobytes() for t, _ in terms], [c.tobytes() for _, c in terms]]

        return work

    fields = [StructField("terms", BinaryType()), StructField("counts", BinaryType())]
    made = map_texts(chosen, make, fields, carry=True).select("doc_id", F.col("_row._label").alias("label"), "terms", "counts")
    table, n = materialize(made, "toxicity")
    terms = _frequent_terms(table, n)
    rows = sorted(_restricted(table, terms[0]).collect(), key=lambda r: (r["doc_id"], r["terms"]))
    return build([(r["doc_id"], r["label"], np.frombuffer(r["terms"], np.uint64), np.frombuffer(r["counts"], np.int64)) for r in rows], share, terms)


def _frequent_terms(table: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``choose_terms``, over a table of examples; TERMS rows at most reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for label, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = np.frombuffer(raw, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.full(len(own), label, np.int32))], ["term", "label"])

    ones = table.agg(F.sum("label")).first()[0] or 0
    if ones in (0, n):
        return np.empty(0, np.uint64), np.empty(0)
    counted = table.select("label", "terms").mapInArrow(run, "term long, label int").groupBy("term").agg(
        F.count("*").cast("double").alias("seen"), F.sum("label").cast("double").alias("bad")
    )
    some = counted.where((F.col("seen") > 1) & (F.col("seen") < n))
    some = some.withColumn("chi", _dependence(F.col("seen"), F.col("bad"), float(n), float(ones)))
    rows = some.where(F.col("chi") >= LEAST_CHI).orderBy(F.desc("chi"), "term").limit(TERMS).select("term", "seen").collect()
    return np.array([r["term"] for r in rows], np.int64).view(np.uint64), np.array([r["seen"] for r in rows])


def _restricted(table: DataFrame, terms: np.ndarray) -> DataFrame:
    """The examples with no terms but the given ones."""
    terms = np.sort(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, counts = [], []
            for raw, count in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                own = np.frombuffer(raw, np.uint64)
                here = np.isin(own, terms, assume_unique=True)
                kept.append(own[here].tobytes())
                counts.append(np.frombuffer(count, np.int64)[here].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(kept, pa.binary()), pa.array(counts, pa.binary())], batch.schema.names)

    return table.mapInArrow(run, table.schema)


def score(docs: DataFrame, model: ToxicityModel, carry: bool = False) -> DataFrame:
    """``doc_id``, ``score`` (probability of label 1), ``predicted`` (1 from 0.5 on), and as evidence
    the nearest examples: ``neighbours`` with ``doc_id``, ``label`` and ``cosine``, nearest first.

    Only texts are looked at. A null or empty text, like one without any known
    term, has no neighbours and the score of such examples. Repeated rows get
    a row each; other columns are ignored or follow as ``_row``; an empty table
    gives no rows. What is broadcast is bounded by the examples and TERMS.
    """
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    near = StructType([StructField("doc_id", StringType()), StructField("label", IntegerType()), StructField("cosine", FloatType())])
    fields = [StructField("score", DoubleType()), StructField("predicted", IntegerType()), StructField("neighbours", ArrayType(near))]

    def make() -> Callable[[list[str]], list]:
        own = shared.value

        def work(texts: list[str]) -> list:
            scores, evidence = [], []
            for text in texts:
                found, value = own.nearest(*own.query(*terms_of(text)))
                scores.append(own.probability(own.votes(found, value)))
                evidence.append([{"doc_id": str(own.names[i]), "label": int(own.label[i]), "cosine": float(v)} for i, v in zip(found, value)])
            return [scores, [int(s >= 0.5) for s in scores], evidence]

        return work

    return map_texts(docs, make, fields, carry)


def held_out(key: str = "doc_id"):
    """Documents that are never learned from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(False))
