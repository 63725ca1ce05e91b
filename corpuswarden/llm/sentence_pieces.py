"""SentencePiece encoding as a scan over max-plus transfer matrices, and decoding.

A text is cut into pieces of a vocabulary so that the sum of their scores is the
greatest. Of equal sums the one with the longest last piece is taken, then the one
with the longest piece before it, and so on. Scores are whole numbers, so that sums
do not depend on their order.

A long text is cut into chunks at fixed distances, wherever that is. A boundary's
state is how many characters the piece across it takes of the next chunk. Each chunk
yields a matrix: for every state at its begin and at its end the best sum between
them, and for every end the order in which equal begins are preferred. The matrices
are multiplied (sums for products, maxima for sums) along the text; from the last
one back every boundary's state is chosen, and each chunk finds its pieces
between its two states on its own.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from corpuswarden.llm.common import ROW, map_texts, prepare
from corpuswarden.session import materialize

#: Characters of a chunk; texts of more are encoded by chunks.
CHUNK = 1 << 16
#: Segments a Python worker remembers, and the longest of them.
CACHE, CACHE_CHARS = 600_000, 40
#: Scores are natural logarithms times this.
SCALE = 1 << 20
NONE = -(1 << 60)
_LOADED: dict[tuple, "Pieces"] = {}


class Pieces:
    """A vocabulary with whole-number scores, and the best cut of a text.

    ``scores`` says where scores come from: "model" takes those of the file, "rank"
    takes the logarithm of a Zipf law over the order of the pieces, for files whose
    scores are merge ranks and no logarithms."""

    def __init__(self, path: str, scores: str = "rank"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.byte = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        special = lambda i: model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)
        ids = [i for i in range(size) if not special(i)]
        total = math.log(sum(1 / (r + 2.7) for r in range(len(ids))))
        value = lambda r, i: model.get_score(i) if scores == "model" else -math.log(r + 2.7) - total
        names = [model.id_to_piece(i).replace("▁", " ") for i in ids]
        own = {name: (i, round(SCALE * value(r, i))) for r, (name, i) in enumerate(zip(names, ids))}
        self.unknown = min(s for _, s in own.values()) - 10 * SCALE
        self.longest = max(map(len, own))
        # every beginning of a piece is a key, so that a search ends early
        self.pieces = {name[:k]: () for name in own for k in range(1, len(name))} | own
        self.bytes = [b""] * size
        for name, (i, _) in own.items():
            self.bytes[i] = name.encode()
        for b, i in enumerate(self.byte):
            self.bytes[i] = bytes([b])
        self.segment = re.compile(_segments(own))
        self.cache: dict[str, tuple[int, tuple[int, ...]]] = {}

    def forward(self, s: str, begin: int, n: int) -> tuple[list, list]:
        """Best sums from ``begin`` to every place, over pieces that begin before ``n``; the
        begin of the last piece, and its id (-1: unknown character)."""
        best, back = [NONE] * (len(s) + 1), [None] * (len(s) + 1)
        best[begin] = 0
        find, size, unknown = self.pieces.get, len(s), self.unknown
        for p in range(begin, n):
            here = best[p]
            if here == NONE:
                continue
            for end in range(p + 1, size + 1):
                entry = find(s[p:end])
                if entry:
                    total = here + entry[1]
                    if total > best[end]:
                        best[end], back[end] = total, (p, entry[0])
                elif entry is None:
                    break
            if here + unknown > best[p + 1] and not find(s[p]):
                best[p + 1], back[p + 1] = here + unknown, (p, -1)
        return best, back

    def trace(self, s: str, back: list, begin: int, end: int) -> tuple[list[int], list[int]]:
        """Ids of the pieces between two places, and their begins from the last to the first."""
        ids, begins = [], []
        while end > begin:
            p, i = back[end]
            ids.append([i] if i >= 0 else [self.byte[b] for b in s[p:end].encode()])
            begins.append(p)
            end = p
        return [i for part in reversed(ids) for i in part], begins

    def whole(self, s: str) -> tuple[int, tuple[int, ...]]:
        """Sum and ids of one segment, remembered if short."""
        found = self.cache.get(s)
        if found is None:
            entry = self.pieces.get(s)
            if entry and len(s) == 1:
                found = entry[1], entry[:1]
            else:
                best, back = self.forward(s, 0, len(s))
                found = best[len(s)], tuple(self.trace(s, back, 0, len(s))[0])
            if len(s) <= CACHE_CHARS:
                if len(self.cache) >= CACHE:
                    self.cache.clear()
                self.cache[s] = found
        return found

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        whole, cache = self.whole, self.cache
        for m in self.segment.finditer(" " + text):
            s = m[0]
            found = cache.get(s) or whole(s)
            out += found[1]
        return out

    def decode(self, ids) -> str:
        table = self.bytes
        return b"".join([table[i] for i in ids]).decode("utf-8", "replace")[1:]

    def _cuts(self, s: str, n: int) -> list[int]:
        return [m.start() for m in self.segment.finditer(s) if m.start() < n]

    def transfer(self, s: str, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Matrix and preferences of a chunk of ``n`` characters, given with what may follow it."""
        states = self.longest
        sums = np.full((states, states), NONE, np.int64)
        order = np.zeros((states, states), np.uint8)
        cuts = self._cuts(s, n)
        if len(cuts) > 1:
            head, last = cuts[1], cuts[-1]
            middle = sum(self.whole(s[a:b])[0] for a, b in zip(cuts[1:], cuts[2:]))
            best, _ = self.forward(s[last:], 0, n - last)
            tail = np.array([best[n - last + x] if n + x <= len(s) else NONE for x in range(states)], np.int64)
            begins = {}
            for e in range(min(states, head + 1)):
                best, back = self.forward(s[:head], e, head)
                if best[head] == NONE:
                    continue
                begins[e] = self.trace(s, back, e, head)[1]
                sums[e] = np.where(tail > NONE, best[head] + middle + tail, NONE)
            for k, e in enumerate(sorted(begins, key=begins.get)):
                order[e] = k
            return sums, order
        paths = [self.forward(s, e, n) for e in range(min(states, n + 1))]
        for x in range(min(states, len(s) - n + 1)):
            found = [e for e, (best, _) in enumerate(paths) if best[n + x] > NONE]
            for e in found:
                sums[e, x] = paths[e][0][n + x]
            for k, e in enumerate(sorted(found, key=lambda e: self.trace(s, paths[e][1], e, n + x)[1])):
                order[e, x] = k
        return sums, order

    def between(self, s: str, n: int, entry: int, leave: int) -> list[int]:
        """Ids of a chunk between two states."""
        cuts = [c for c in self._cuts(s, n) if c > 0]
        if not cuts:
            return self.trace(s, self.forward(s, entry, n)[1], entry, n + leave)[0]
        head, last = cuts[0], cuts[-1]
        out = self.trace(s, self.forward(s[:head], entry, head)[1], entry, head)[0]
        for a, b in zip(cuts, cuts[1:]):
            out += self.whole(s[a:b])[1]
        rest = s[last:]
        return out + self.trace(rest, self.forward(rest, 0, n - last)[1], 0, n - last + leave)[0]


def _segments(names) -> str:
    """Pattern of segments, whose begins no piece crosses.

    Characters that stand side by side in some piece are of one group; blanks go with
    what follows. A segment is blanks and characters of one group, or an unknown character."""
    if any(" " in name.lstrip(" ") for name in names):
        return "(?s).+"
    group: dict[str, str] = {}

    def root(c: str) -> str:
        while group.setdefault(c, c) != c:
            c = group[c]
        return c

    for name in names:
        chars = name.lstrip(" ")
        for c in chars:
            group[root(c)] = root(chars[0])
    members: dict[str, list[str]] = {}
    for c in sorted(group):
        members.setdefault(root(c), []).append(re.escape(c))
    alone = "".join(m[0] for m in members.values() if len(m) == 1)
    classes = [f" *[{''.join(m)}]+" for m in sorted(members.values(), key=len, reverse=True) if len(m) > 1]
    # a group of one character may still repeat within a piece
    classes += [f" *([{alone}])\\1*"] if alone else []
    return "|".join([*classes, " +", f"[^{''.join(map(re.escape, sorted(group)))} ]"])


def combine(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Transfer over two neighbouring stretches from those of each; the operation is associative."""
    (x, px), (y, py) = a, b
    size = len(x)
    sums, order = np.full_like(x, NONE), np.zeros_like(px)
    for end in range(size):
        keys = {}
        for begin in range(size):
            total = np.where((x[begin] > NONE) & (y[:, end] > NONE), x[begin] + y[:, end], NONE)
            top = total.max()
            if top > NONE:
                via = min(np.flatnonzero(total == top), key=lambda m: py[m, end])
                sums[begin, end] = top
                keys[begin] = (py[via, end], px[begin, via])
        for k, begin in enumerate(sorted(keys, key=keys.get)):
            order[begin, end] = k
    return sums, order


def boundary_states(transfers: list[tuple[np.ndarray, np.ndarray]]) -> list[int]:
    """State at every boundary of a text, its begin and end (both 0) included."""
    vectors = [np.full(len(transfers[0][0]), NONE, np.int64)]
    vectors[0][0] = 0
    for sums, _ in transfers:
        reach = np.where((vectors[-1][:, None] > NONE) & (sums > NONE), vectors[-1][:, None] + sums, NONE)
        vectors.append(reach.max(axis=0))
    states = [0]
    for vector, (sums, order) in zip(reversed(vectors[:-1]), reversed(transfers)):
        end = states[-1]
        total = np.where((vector > NONE) & (sums[:, end] > NONE), vector + sums[:, end], NONE)
        best = np.flatnonzero(total == total.max())
        states.append(int(best[np.argmin(order[best, end])]))
    return states[::-1]


def chunks_of(text: str, chunk: int, longest: int) -> Iterator[tuple[int, int, str]]:
    """Number, size, and characters of each chunk with those that a piece may take of the next."""
    s = " " + text
    for k, at in enumerate(range(0, len(s), chunk)):
        yield k, min(chunk, len(s) - at), s[at : at + chunk + longest - 1]


def _load(path: str, scores: str) -> Pieces:
    if (path, scores) not in _LOADED:  # once per Python worker
        _LOADED.clear()
        _LOADED[path, scores] = Pieces(path, scores)
    return _LOADED[path, scores]


def _by_chunks(long: DataFrame, path: str, scores: str, chunk: int) -> DataFrame:
    """``_n`` and ``ids`` of long texts."""
    cut = StructType([StructField("_n", LongType()), StructField("k", IntegerType()), StructField("size", IntegerType()), StructField("s", StringType())])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longest = _load(path, scores).longest
        for batch in batches:
            for n, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for k, size, s in chunks_of(text, chunk, longest):
                    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([k], pa.int32()), pa.array([size], pa.int32()), pa.array([s])], cut.names)

    pieces, _ = materialize(long.select("_n", "text").mapInArrow(split, cut).repartition("_n", "k"), "pieces")

    @F.pandas_udf("struct<sums: binary, ranks: binary>")
    def matrix(s: pd.Series, size: pd.Series) -> pd.DataFrame:
        own = _load(path, scores)
        made = [own.transfer(t, int(n)) for t, n in zip(s, size)]
        return pd.DataFrame({"sums": [a.tobytes() for a, _ in made], "ranks": [b.tobytes() for _, b in made]})

    def states(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("k")
        side = math.isqrt(len(group["ranks"].iloc[0]))
        shape = lambda raw, kind: np.frombuffer(raw, kind).reshape(side, side)
        found = boundary_states([(shape(a, np.int64), shape(b, np.uint8)) for a, b in zip(group["sums"], group["ranks"])])
        return pd.DataFrame({"_m": group["_n"], "j": group["k"], "entry": found[:-1], "leave": found[1:]})

    # one row of some 2 KB for each chunk of a text: bounded by the text itself
    transfers = pieces.select("_n", "k", matrix("s", "size").alias("t")).select("_n", "k", "t.sums", "t.ranks")
    chosen = transfers.groupBy("_n").applyInPandas(states, "_m long, j int, entry int, leave int")

    @F.pandas_udf("array<int>")
    def trace(s: pd.Series, size: pd.Series, entry: pd.Series, leave: pd.Series) -> pd.Series:
        own = _load(path, scores)
        return pd.Series([own.between(t, int(n), int(e), int(x)) for t, n, e, x in zip(s, size, entry, leave)])

    joined = pieces.join(chosen, (F.col("_n") == F.col("_m")) & (F.col("k") == F.col("j")))
    parts = joined.select("_n", "k", trace("s", "size", "entry", "leave").alias("ids"))
    ordered = F.array_sort(F.collect_list(F.struct("k", "ids")))
    return parts.groupBy("_n").agg(F.flatten(F.transform(ordered, lambda p: p["ids"])).alias("ids"))


def encode(docs: DataFrame, path: str, scores: str = "rank", chunk: int = CHUNK, carry: bool = False) -> DataFrame:
    """``doc_id`` and ``ids``, the piece ids of every text.

    A blank is put before the text; nothing else is normalised. Characters without
    a piece, the sign U+2581 among them, become the pieces of their UTF-8 bytes, so
    decoding gives the text back exactly. Null and empty texts have no ids. Texts
    longer than ``chunk`` are encoded by chunks in tasks of their own, with the same
    result. Repeated rows get a row each; other columns are ignored, or follow as
    struct ``_row`` with ``carry``; an empty table gives no rows."""
    prepare(docs.sparkSession)

    def make() -> Callable[[list[str]], list]:
        own = _load(path, scores)
        return lambda texts: [[own.encode(t) for t in texts]]

    is_long = F.coalesce(F.length("text") >= chunk, F.lit(False))
    short = map_texts(docs.where(~is_long), make, [StructField("ids", ArrayType(IntegerType()))], carry)
    kept = ["doc_id", "text"] + ([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(ROW)] if carry else [])
    long, count = materialize(docs.where(is_long).select(*kept).withColumn("_n", F.monotonically_increasing_id()), "pieces")
    if not count:
        return short
    found = _by_chunks(long, path, scores, chunk).withColumnRenamed("_n", "_m")
    return short.unionByName(long.join(found, F.col("_n") == F.col("_m")).select(*short.columns))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds ``text``, what the ids stand for. No ids and null give an empty text; bytes that are
    no UTF-8 become U+FFFD."""
    prepare(encoded.sparkSession)

    @F.pandas_udf("string")
    def back(ids: pd.Series) -> pd.Series:
        own = _load(path, "rank")
        return pd.Series([own.decode(i) if i is not None else "" for i in ids])

    return encoded.withColumn("text", back("ids"))
