"""Benchmark decontamination by a generalised suffix automaton of the test items."""

from __future__ import annotations

import hashlib
import math
import re
import uuid
from collections.abc import Callable, Iterable
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from corpuswarden.llm.common import ROW, map_texts, prepare
from corpuswarden.session import materialize

WINDOW = 13
#: Characters of test items in one automaton; more items are dealt over several passes.
SHARD_CHARS = 1_000_000

_BUILT: dict[str, Automaton] = {}
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_UPPER = {c: c + 32 for c in range(65, 91)}
# one byte table lower-cases A-Z and turns every separator to a blank
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


class Automaton:
    """Suffix automaton of several word sequences, with the items behind each window.

    An item of ``window`` words or more has all its runs of ``window`` words as
    windows; a shorter one is a single window, and an item without words none.
    """

    def __init__(self, items: Iterable[tuple[str | None, str | None]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.items: dict[int, set] = {}  # state -> items that have its run of window words
        self.short: dict[int, dict[int, set]] = {}  # state -> words -> short items that end there
        sequences = []
        for key, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text or "")]
            if ids:
                sequences.append((key, ids))
                self._insert(ids)
        self.shortest = min((min(window, len(ids)) for _, ids in sequences), default=0)
        for key, ids in sequences:
            v = 0
            for i, c in enumerate(ids):
                v = self.next[v][c]
                if i + 1 >= window:
                    v = self._of_length(v, window)
                    self.items.setdefault(v, set()).add(key)
            if len(ids) < window:
                self.short.setdefault(v, {}).setdefault(len(ids), set()).add(key)
        # of each state the nearest of its suffixes, itself first, that a short item ends in; shortest states first
        self.nearest = [0] * len(self.link)
        for v in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            self.nearest[v] = v if v in self.short else self.nearest[self.link[v]]

    def _insert(self, ids: list[int]) -> None:
        last = 0
        for c in ids:
            if c in self.next[last]:
                last = self._split(last, c, self.next[last][c])
                continue
            new = self._state({}, self.length[last] + 1, 0)
            p, last = last, new
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = self.link[p]
            if p >= 0:
                self.link[new] = self._split(p, c, self.next[p][c])

    def _split(self, p: int, c: int, q: int) -> int:
        """The state that holds exactly p's longest run followed by c."""
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(dict(self.next[q]), self.length[p] + 1, self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _state(self, edges: dict, length: int, link: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        return len(self.link) - 1

    def _of_length(self, v: int, n: int) -> int:
        """The suffix of v's runs that has n words. Streams go on from there, so that the
        steps up are no more than the words."""
        while self.length[self.link[v]] >= n:
            v = self.link[v]
        return v

    def scan(self, words: list[bytes]) -> tuple[list[list[int]], set]:
        """Word spans covered by windows, merged, and the items whose windows occur."""
        spans: list[list[int]] = []
        found: set = set()
        if not self.shortest or len(words) < self.shortest:
            return spans, found
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int32, len(words))
        # a window lies in one stretch of words that the items know
        edge = np.flatnonzero(np.diff(ids >= 0, prepend=False, append=False))
        for start, end in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if end - start >= self.shortest:
                self._stream(ids[start:end].tolist(), start, spans, found)
        return spans, found

    def _stream(self, ids: list[int], offset: int, spans: list[list[int]], found: set) -> None:
        v = n = 0  # state, and length of the longest match that ends here
        for i, c in enumerate(ids, offset + 1):
            while v and c not in self.next[v]:
                v = self.link[v]
                n = self.length[v]
            v = self.next[v].get(c, 0)
            n = n + 1 if v else 0
            covered = 0
            if n >= self.window:
                covered = n = self.window
                v = self._of_length(v, n)
                found |= self.items[v]
            short = self.nearest[v]
            while short:
                for size, keys in self.short[short].items():
                    if size <= n:
                        covered = max(covered, size)
                        found |= keys
                short = self.nearest[self.link[short]]
            if covered:
                start = i - covered
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append([start, i])


def cut(text: str, spans: list[list[int]]) -> str:
    """The text without the given word spans; the separators around them stay."""
    at = [m.span() for m in _WORD.finditer(text.translate(_UPPER))]
    out, last = [], 0
    for start, end in spans:
        out.append(text[last : at[start][0]])
        last = at[end - 1][1]
    return "".join(out) + text[last:]


SPANS = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())]))


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    share: tuple[int, int] = (1, 20),
    carry: bool = False,
    shard_chars: int = SHARD_CHARS,
) -> DataFrame:
    """Where test items occur in documents, and the texts without those passages.

    ``items`` has ``item_id`` and ``text``. Returns one row per row of ``docs``:
    ``doc_id``, ``n_words``, ``spans`` (word positions covered by windows, end
    exclusive), ``item_ids`` (sorted as strings), ``n_hit`` (words in spans) and
    ``contaminated`` (they make up ``share`` of all words or more).
    ``without_spans`` cuts the passages out of the texts.

    The items' characters are counted first. Each pass over the documents
    broadcasts one automaton of at most ``shard_chars`` characters and one more
    item; with more items there are several passes, which hand on their spans
    by a table in the shared folder.

    Null texts have no words; a document without words is never contaminated.
    Items with null ids count as covered words but are not listed. Repeated
    documents get a row each, repeated items change nothing. Without items
    nothing is covered. With ``carry`` the input row follows as ``_row``.
    """
    spark = docs.sparkSession
    prepare(spark)
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(1, math.ceil(total / shard_chars))
    chosen = items.select(F.col("item_id").cast("string").alias("item_id"), "text")
    fields = [
        StructField("n_words", LongType()),
        StructField("spans", SPANS),
        StructField("item_ids", ArrayType(StringType())),
    ]
    if shards == 1:
        found = _pass(docs, chosen, window, fields, carry)
    else:
        # number the rows, so that what the passes found meets again row by row
        row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(ROW)
        rows = docs.select("doc_id", "text", *([row] if carry else []), F.monotonically_increasing_id().alias("_n"))
        numbered, _ = materialize(rows, "decontaminate")
        keys = numbered.select(F.col("_n").alias("doc_id"), "text")
        parts = []
        for shard in range(shards):
            mine = chosen.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == shard)
            parts.append(_pass(keys, mine, window, fields, False))
        both = parts[0]
        for part in parts[1:]:
            both = both.unionByName(part)
        merged = both.groupBy("doc_id").agg(
            F.max("n_words").alias("n_words"),
            F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"),
        ).withColumn("spans", _merged("spans"))
        found = numbered.drop("text").join(merged.withColumnRenamed("doc_id", "_m"), F.col("_n") == F.col("_m")).drop("_n", "_m")
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.withColumn("n_hit", hit).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share[1] >= F.col("n_words") * share[0])
    )


def without_spans(docs: DataFrame, items: DataFrame, longest: int | None = None, **options) -> DataFrame:
    """The rows of ``docs`` with passages of test items cut out of their texts.

    Cut are all spans of contaminated documents, and of the others the spans of
    more than ``longest`` words (None: none). Options as for ``decontaminate``."""
    found = decontaminate(docs, items, carry=True, **options)

    @F.pandas_udf("string")
    def clean(text: pd.Series, spans: pd.Series) -> pd.Series:
        pairs = zip(text, spans)
        return pd.Series([cut(t, [(s["start"], s["end"]) for s in a]) if len(a) else t for t, a in pairs])

    chosen = F.when(F.col("contaminated"), F.col("spans")).otherwise(
        F.filter("spans", lambda s: s["end"] - s["start"] > F.lit(2**31 - 1 if longest is None else longest))
    )
    text = F.when(F.size(chosen) > 0, clean(f"{ROW}.text", chosen)).otherwise(F.col(f"{ROW}.text"))
    return found.select(*[(text if c == "text" else F.col(f"{ROW}.`{c}`")).alias(c) for c in docs.columns])


def _merged(name: str):
    """Sorted spans with overlapping and touching ones joined."""
    start = F.expr(f"slice({name}, 1, 0)")
    return F.aggregate(
        name,
        start,
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= s["start"]),
            F.concat(
                F.slice(acc, 1, F.size(acc) - 1),
                F.array(
                    F.struct(
                        F.element_at(acc, -1)["start"].alias("start"),
                        F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end"),
                    )
                ),
            ),
        ).otherwise(F.concat(acc, F.array(s))),
    )


def _pass(docs: DataFrame, items: DataFrame, window: int, fields: list, carry: bool) -> DataFrame:
    rows = [(r["item_id"], r["text"]) for r in items.collect()]  # bounded by the caller
    shared = docs.sparkSession.sparkContext.broadcast(rows)
    name = uuid.uuid4().hex

    def make() -> Callable[[list[str]], list]:
        if name not in _BUILT:  # once per Python worker
            _BUILT.clear()
            _BUILT[name] = Automaton(shared.value, window)
        automaton = _BUILT[name]

        def work(texts: list[str]) -> list:
            counts, spans, ids = [], [], []
            for text in texts:
                words = words_of(text)
                covered, found = automaton.scan(words)
                counts.append(len(words))
                spans.append([{"start": a, "end": b} for a, b in covered])
                ids.append(sorted(k for k in found if k is not None))
            return [counts, spans, ids]

        return work

    return map_texts(docs, make, fields, carry)
