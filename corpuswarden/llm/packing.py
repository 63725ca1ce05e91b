"""Packing of token sequences by length patterns and non-negative least squares.

Texts are encoded where they are read and cut into pieces of at most
``capacity`` ids. All that the plan needs is the histogram of piece lengths,
which has at most ``capacity`` entries whatever the size of the corpus:

1. Lengths are grouped in classes of equal width, each named by how many widths
   hold it. A pattern is a multiset of a few classes that fill a sequence exactly.
2. Non-negative least squares fit the patterns' repeat counts to the histogram;
   the active-set method gives no more patterns than there are classes. Counts
   are rounded down.
3. Every repetition of a pattern takes all its pieces but the shortest. The rest,
   closing pieces and what the rounding left, is packed by best fit, longest
   first, over whole runs of equal lengths at once.

The plan is a list of runs: so many pieces of one length, counted from a rank,
go to consecutive sequences at one offset. Pieces get their rank within their
length from counts per task, so no length, however common, meets in one task.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from corpuswarden.llm.common import prepare, texts_of
from corpuswarden.llm.token_files import encoder, id_type
from corpuswarden.session import materialize

#: Ways to choose patterns: length classes, most pieces, share of the histogram to fit.
#: All are planned over the histogram; the one with fewest sequences counts.
FITS = ((64, 3, 1.0), (64, 3, 0.9), (64, 3, 0.7), (64, 4, 1.0), (128, 3, 1.0))
NAMES = ("piece", "start", "length", "ids", "task", "nth")


def patterns(classes: int, depth: int) -> list[tuple[int, ...]]:
    """All falling sequences of at most ``depth`` whole numbers that sum to ``classes``."""
    out: list[tuple[int, ...]] = []

    def extend(rest: int, most: int, left: int, so_far: tuple[int, ...]) -> None:
        if not rest:
            out.append(so_far)
        elif left:
            for c in range(min(rest, most), -(-rest // left) - 1, -1):
                extend(rest - c, c, left - 1, (*so_far, c))

    extend(classes, classes, depth, ())
    return out


def non_negative_fit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The x >= 0 of least ``|a x - b|``, by the active-set method.

    Columns enter by the steepest gradient; a step that would make one negative
    stops there and takes it out."""
    x, inside = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    least = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(10 * a.shape[0]):
        gradient = np.where(inside, -np.inf, a.T @ (b - a @ x))
        enter = int(gradient.argmax())
        if gradient[enter] <= least:
            break
        inside[enter] = True
        while inside.any():
            now = np.flatnonzero(inside)
            best = np.linalg.lstsq(a[:, now], b, rcond=None)[0]
            if best.min() > 0:
                x[:] = 0
                x[now] = best
                break
            old = x[now]
            reach = np.where(best <= 0, old / np.maximum(old - best, 1e-300), np.inf)
            x[now] = np.maximum(old + reach.min() * (best - old), 0)
            gone = now[reach <= reach.min()]
            x[gone], inside[gone] = 0, False
        if not inside[enter]:
            break  # no step left that the arithmetic can tell from zero
    return x


@dataclass
class Plan:
    """Where the pieces of each length go.

    Of ``runs``, each a row of length, first rank, pieces, first sequence, offset
    and pieces per sequence: a piece ``i`` places after the first rank lies in
    sequence ``first + i // per`` at ``offset + i % per * length``."""

    capacity: int
    sequences: int = 0
    runs: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces, by their length and rank within it."""
        table = np.array(sorted(self.runs), np.int64).reshape(-1, 6)
        most = np.int64(2**62 // (self.capacity + 1))
        at = np.searchsorted(table[:, 0] * most + table[:, 1], length * most + rank, "right") - 1
        size, first, _, sequence, offset, per = table[at].T
        i = rank - first
        return sequence + i // per, offset + i % per * size


class _Packer:
    """Takes pieces from the histogram and notes runs. Spaces hold open groups of
    consecutive sequences by the room they have left."""

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.plan = Plan(capacity)
        self.left, self.taken = dict(histogram), dict.fromkeys(histogram, 0)
        self.groups: dict[int, list[tuple[int, int]]] = {}
        self.rooms: list[int] = []

    def put(self, length: int, sequences: int, first: int, room: int, per: int = 1) -> int:
        """``per`` pieces of a length into each of some sequences; gives the room left."""
        n = sequences * per
        self.plan.runs.append((length, self.taken[length], n, first, self.plan.capacity - room, per))
        self.taken[length] += n
        self.left[length] -= n
        return room - per * length

    def open(self, room: int, first: int, sequences: int) -> None:
        if room > 0 and sequences:
            if room not in self.groups:
                bisect.insort(self.rooms, room)
            self.groups.setdefault(room, []).append((first, sequences))

    def new(self, sequences: int) -> int:
        self.plan.sequences += sequences
        return self.plan.sequences - sequences

    def repeat(self, pattern: tuple[int, ...], times: int, classes: dict[int, list[int]]) -> None:
        """So many sequences begun with all pieces of a pattern but the shortest."""
        head = pattern[:-1] or pattern
        for c in set(head):
            times = min(times, sum(self.left[x] for x in classes.get(c, ())) // head.count(c))
        groups = [(self.new(times), times, self.plan.capacity)] if times > 0 else []
        for c in head:
            after, lengths = [], iter([x for x in classes.get(c, ()) if self.left[x]])
            length = 0
            for first, n, room in groups:
                while n:
                    while not length or not self.left[length]:
                        length = next(lengths)
                    k = min(n, self.left[length])
                    after.append((first, k, self.put(length, k, first, room)))
                    first, n = first + k, n - k
            groups = after
        for first, n, room in groups:
            self.open(room, first, n)

    def best_fit(self) -> None:
        """Everything left: longest first, each into the least room that holds it."""
        for length in sorted(self.left, reverse=True):
            while c := self.left[length]:
                at = bisect.bisect_left(self.rooms, length)
                if at == len(self.rooms):
                    per = min(self.plan.capacity // length, c)
                    n = c // per
                    first = self.new(n)
                    self.open(self.put(length, n, first, self.plan.capacity, per), first, n)
                    continue
                room = self.rooms[at]
                first, n = self.groups[room].pop()
                if not self.groups[room]:
                    del self.groups[room], self.rooms[at]
                per = min(room // length, c)
                k = min(n, c // per)
                self.open(room, first + k, n - k)
                self.open(self.put(length, k, first, room, per), first, k)


def plan(histogram: dict[int, int], capacity: int, fits: tuple = FITS) -> Plan:
    """Runs for all pieces of a histogram of lengths, by the fit that needs fewest sequences.

    No length may be less than 1 or more than ``capacity``."""
    made = []
    for size, depth, share in fits:
        size = min(size, capacity)
        classes: dict[int, list[int]] = {}
        for length in sorted(histogram, reverse=True):
            classes.setdefault(-(-length * size // capacity), []).append(length)
        known = patterns(size, depth)
        a, b = np.zeros((size + 1, len(known))), np.zeros(size + 1)
        for j, pattern in enumerate(known):
            np.add.at(a[:, j], list(pattern), 1)
        for c, lengths in classes.items():
            b[c] = share * sum(histogram[x] for x in lengths)
        times = np.floor(non_negative_fit(a, b) + 1e-6).astype(int)
        packer = _Packer(histogram, capacity)
        for j in sorted(np.flatnonzero(times), key=lambda j: (-times[j], known[j])):
            packer.repeat(known[j], int(times[j]), classes)
        packer.best_fit()
        made.append(packer.plan)
    return min(made, key=lambda p: (p.sequences, len(p.runs)))


def cut(docs: DataFrame, tokenizer: str, capacity: int, end_id: int | None, by_word: bool) -> DataFrame:
    """Pieces of all texts: ``doc_id``, ``piece``, ``start``, ``length``, ``ids`` (four bytes
    each, little endian), the ``task`` that made it and its number ``nth`` among the
    task's pieces of that length."""
    from tokenizers import Tokenizer

    prepare(docs.sparkSession)
    source = docs.select("doc_id", "text")
    kind = id_type(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id)
    make, width = encoder(tokenizer, end_id, by_word), np.dtype(kind).itemsize
    long = [StructField(n, BinaryType() if n == "ids" else LongType()) for n in NAMES]
    out = StructType([source.schema["doc_id"], *long])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, seen, task = make(), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            raw, counts = work(texts_of(batch))
            counts = np.array(counts, np.int64)
            pieces = -(-counts // capacity)
            row = np.repeat(np.arange(len(raw)), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * capacity
            length = np.minimum(counts[row] - start, capacity)
            # the how-manieth of its length each piece is, in this batch and then in the task
            order = np.argsort(length, kind="stable")
            ranks = np.arange(len(row)) - np.searchsorted(length[order], length[order])
            nth = np.empty(len(row), np.int64)
            nth[order] = seen[length[order]] + ranks
            seen += np.bincount(length, minlength=capacity + 1)
            ids = [
                np.frombuffer(raw[r][s * width : (s + n) * width], kind).astype("<u4").tobytes()
                for r, s, n in zip(row.tolist(), start.tolist(), length.tolist())
            ]
            columns = [pa.array(x, pa.int64()) for x in (piece, start, length)]
            columns += [pa.array(ids, pa.binary()), pa.array(np.full(len(row), task), pa.int64()), pa.array(nth, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), *columns], out.names)

    return source.mapInArrow(run, out)


def pack(
    docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int | None = 1, by_word: bool = False, fits: tuple = FITS
) -> DataFrame:
    """Every text's pieces with their place: ``doc_id``, ``piece`` (from 0), ``start`` (ids
    of the document before it), ``length``, ``ids``, ``sequence_id`` (from 0) and ``offset``.

    ``tokenizer`` is the path of a file for the tokenizers library, readable by
    every executor; ``by_word`` as in ``token_files.encoder``. Only texts of more than
    ``capacity`` ids, the end id included, are cut.

    Null texts are empty; they, like empty ones, have the end id alone, or no
    piece where there is none. Rows that repeat, and null ids, are packed like
    any others. Other columns are ignored. An empty table gives no pieces.
    """
    made, _ = materialize(cut(docs, tokenizer, capacity, end_id, by_word), "packing")
    counts, _ = materialize(made.groupBy("length", "task").agg(F.count("*").alias("n")), "packing-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    found = plan(histogram, capacity, fits)
    # one row per task and length
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(
        F.col("length").alias("_length"), F.col("task").alias("_task"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base")
    )
    ranked = made.join(bases, (F.col("length") == F.col("_length")) & (F.col("task") == F.col("_task")))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids", (F.col("_base") + F.col("nth")).alias("rank"))
    out = StructType(ranked.schema.fields[:5] + [StructField(n, LongType()) for n in ("sequence_id", "offset")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                place = found.place(batch.column(3).to_numpy(), batch.column(5).to_numpy())
                yield pa.RecordBatch.from_arrays([*batch.columns[:5], *[pa.array(x, pa.int64()) for x in place]], out.names)

    return ranked.mapInArrow(run, out)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id``, its ``ids`` (four bytes each) and the ``ends`` of its pieces.

    A sequence has at most ``capacity`` pieces and ids, so its group is bounded."""
    pieces = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    grouped = packed.groupBy("sequence_id").agg(pieces.alias("p"))
    ids = F.aggregate("p", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    return grouped.select("sequence_id", ids.alias("ids"), F.transform("p", lambda p: p["offset"] + p["length"]).alias("ends"))
