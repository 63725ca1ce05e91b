"""Document fingerprints from prefix polynomial hashes.

The prefix array of a text holds, for every position i, the sum of its first i
code points times powers of a base, modulo a prime. The difference of two
entries, brought to power 0, identifies a span by its content alone, wherever it
stands. Whole-text identities, the hashes of all windows and tests of equality
between any two spans all come from these arrays, and the longest common
extension of two positions is found by binary search over its length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from corpuswarden.llm.common import ordered_parts, part_of, prepare, shuffle_parts

#: Two primes below 2**31; products of residues fit in 64 bits.
PRIMES = (2_147_483_647, 2_147_483_629)
BASES = (1_000_003, 900_001_891)
WINDOW, SKETCH = 24, 64
#: Code points whose prefix sums are held at once for the sketch of a longer text.
SEGMENT = 1 << 20

_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of a base and of its inverse, by doubling."""
    if which not in _TABLES or len(_TABLES[which][0]) <= n:
        prime, size = PRIMES[which], 1 << max(14, int(n).bit_length())
        both = []
        for base in (BASES[which], pow(BASES[which], -1, PRIMES[which])):
            out = np.ones(1, np.uint64)
            while len(out) < size:
                out = np.concatenate([out, out * np.uint64(pow(base, len(out), prime)) % np.uint64(prime)])
            both.append(out)
        _TABLES[which] = tuple(both)
    up, down = _TABLES[which]
    return up[: n + 1], down[: n + 1]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class PrefixHash:
    """Prefix arrays of one text, modulo both primes."""

    def __init__(self, points: np.ndarray):
        self.n = len(points)
        values = points.astype(np.uint64) + np.uint64(1)
        self.sums = []
        for which, prime in enumerate(PRIMES):
            up, _ = _powers(which, self.n)
            total = np.zeros(self.n + 1, np.uint64)
            # each term is below 2**31, so 2**33 of them can be added before the remainder
            np.cumsum(values * up[:-1] % np.uint64(prime), out=total[1:])
            self.sums.append(total % np.uint64(prime))

    def spans(self, start: np.ndarray, length: np.ndarray | int, which: int) -> np.ndarray:
        """Content of spans modulo one prime."""
        prime, (_, down) = np.uint64(PRIMES[which]), _powers(which, self.n)
        total = self.sums[which]
        return (total[start + length] + prime - total[start]) % prime * down[start] % prime

    def span(self, start: int, length: int) -> int:
        """Content of one span as a number below 2**62."""
        value = 0
        for which, prime in enumerate(PRIMES):
            total, down = self.sums[which], _powers(which, self.n)[1]
            part = (int(total[start + length]) - int(total[start])) % prime * int(down[start]) % prime
            value = value << 31 | part
        return value

    def windows(self, width: int) -> np.ndarray:
        """Contents of all windows; one of the whole text if that is shorter, none if empty."""
        if not self.n:
            return np.empty(0, np.uint64)
        width = min(width, self.n)
        start = np.arange(self.n - width + 1)
        return self.spans(start, width, 0) << np.uint64(31) | self.spans(start, width, 1)


def common_extension(a: PrefixHash, i: int, b: PrefixHash, j: int) -> int:
    """How many code points from ``i`` in a and from ``j`` in b are the same, by binary search."""
    low, high = 0, min(a.n - i, b.n - j)
    while low < high:
        middle = (low + high + 1) // 2
        if a.span(i, middle) == b.span(j, middle):
            low = middle
        else:
            high = middle - 1
    return low


def _scatter(x: np.ndarray) -> np.ndarray:
    """32 bits of a window's content in an order that has nothing to do with the text."""
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    return (x * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)


def smallest(values: np.ndarray, k: int = SKETCH) -> np.ndarray:
    """The k smallest distinct values, sorted."""
    if len(values) > 8 * k:
        # repeats could push distinct values out: take more until enough are there
        take = 2 * k
        while take < len(values):
            found = np.unique(np.partition(values, take)[:take])
            if len(found) >= k:
                return found[:k]
            take *= 4
    return np.unique(values)[:k]


def window_sketch(points: np.ndarray) -> np.ndarray:
    """Sketch of all windows of a text, a segment of it at a time."""
    best = np.empty(0, np.uint64)
    for at in range(0, max(1, len(points) - WINDOW + 1), SEGMENT):
        part = PrefixHash(points[at : at + SEGMENT + WINDOW - 1])
        best = smallest(np.concatenate([best, smallest(_scatter(part.windows(WINDOW)))]))
    return best


def identity(points: np.ndarray) -> int:
    """Content of a whole text; segments are joined by the power of their start."""
    value = [0, 0]
    for at in range(0, len(points), SEGMENT):
        part = PrefixHash(points[at : at + SEGMENT])
        for which, prime in enumerate(PRIMES):
            shift = pow(BASES[which], at, prime)
            value[which] = (value[which] + int(part.sums[which][-1]) * shift) % prime
    return value[0] << 31 | value[1]


def fingerprint_of(n: int, whole: int, sketch: np.ndarray) -> str:
    """Text form: length, identity, then the sketch, eight hexadecimal digits a value."""
    return f"{n:x}-{whole:016x}-" + sketch.astype(">u4").tobytes().hex()


def fingerprint(text: str) -> str:
    points = code_points(text)
    return fingerprint_of(len(points), identity(points), window_sketch(points))


def likeness(a: str, b: str) -> float:
    """Share of common windows that two fingerprints tell, from 0 to 1.

    Equal length and identity give 1. An empty text is like no other text."""
    if a.rsplit("-", 1)[0] == b.rsplit("-", 1)[0]:
        return 1.0
    x, y = (np.frombuffer(bytes.fromhex(f.rsplit("-", 1)[1]), ">u4") for f in (a, b))
    if not len(x) or not len(y):
        return 0.0
    # the k smallest of both together are a fair sample of all windows of either text
    union = np.union1d(x, y)[:SKETCH]
    return float(np.isin(union, np.intersect1d(x, y)).mean())


class _Text:
    """A text with its fingerprint parts, made once although two rows need it."""

    def __init__(self, text: str):
        self.points = code_points(text)
        self.text, self.n = text, len(self.points)
        if self.n <= SEGMENT:
            self.hashes = PrefixHash(self.points)
            self.windows = _scatter(self.hashes.windows(WINDOW))
            self.sketch, whole = smallest(self.windows), self.hashes.span(0, self.n)
        else:
            self.hashes = self.windows = None
            self.sketch, whole = window_sketch(self.points), identity(self.points)
        self.fingerprint = fingerprint_of(self.n, whole, self.sketch)


def edited(a: str, b: str) -> str:
    """``a`` with its last half (rounded down) replaced by as many first code points of ``b``."""
    half = len(a) // 2
    return a[: len(a) - half] + b[:half]


def _edited_fingerprint(a: _Text, b: _Text) -> str:
    """Fingerprint of the edited text. Windows within one of the two parts are the
    parts' own, whose contents are known; only those across the seam are new."""
    half = a.n // 2
    head, tail = a.n - half, min(half, b.n)
    n = head + tail
    if a.windows is None or b.windows is None or head < WINDOW or tail < WINDOW:
        points = np.concatenate([a.points[:head], b.points[:tail]])
        return fingerprint_of(n, identity(points), window_sketch(points))
    seam = PrefixHash(np.concatenate([a.points[head - WINDOW + 1 : head], b.points[: WINDOW - 1]]))
    values = np.concatenate(
        [a.windows[: head - WINDOW + 1], _scatter(seam.windows(WINDOW)), b.windows[: tail - WINDOW + 1]]
    )
    whole = 0
    for which, prime in enumerate(PRIMES):
        shift = int(_powers(which, head)[0][head])
        whole = whole << 31 | (int(a.hashes.sums[which][head]) + int(b.hashes.sums[which][tail]) * shift) % prime
    return fingerprint_of(n, whole, smallest(values))


FIELDS = [
    StructField("n_chars", LongType()),
    StructField("edited_sha256", StringType()),
    StructField("fingerprint", StringType()),
    StructField("edited_fingerprint", StringType()),
    StructField("near_edited", DoubleType()),
    StructField("near_next", DoubleType()),
    StructField("common_prefix", LongType()),
]


def _row(a: _Text, b: _Text) -> tuple:
    new, seam = edited(a.text, b.text), _edited_fingerprint(a, b)
    if a.hashes is not None and b.hashes is not None:
        common = common_extension(a.hashes, 0, b.hashes, 0)
    else:
        n = min(a.n, b.n)
        differ = np.flatnonzero(a.points[:n] != b.points[:n])
        common = int(differ[0]) if len(differ) else n
    sha = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
    near = likeness(a.fingerprint, seam), likeness(a.fingerprint, b.fingerprint)
    return a.n, sha, a.fingerprint, seam, *near, common


def fingerprint_pairs(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Each document's fingerprint beside that of its edited text and of the next document.

    The next document is the one that follows in ascending ``doc_id``; the last
    one is followed by the first. Returns ``doc_id`` and ``n_chars``,
    ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited``,
    ``near_next`` and ``common_prefix`` (code points that the text and the next
    one begin with in common).

    Texts are shuffled once, into ranges of ``doc_id``. The first row of each
    range is sent to the range before it as well, so that neighbours meet in
    one task that holds two texts at a time.

    A null text is empty: its fingerprint has no windows, is equal to that of
    other empty texts and like no other. Null ids come first; rows with the same
    id follow one another in the order of their texts. A single row follows
    itself. Other columns are ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    source = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    splits = ordered_parts(source.select("doc_id"), "doc_id", parts or shuffle_parts(spark))
    ranges = len(splits) + 1
    key = source.schema["doc_id"]
    # the first id of every range that has rows, one row per range
    heads = source.select(part_of("doc_id", splits).alias("p"), "doc_id").groupBy("p").agg(
        F.min("doc_id").alias("low"), F.count_if(F.col("doc_id").isNull()).alias("nulls")
    )
    first = {r["p"]: None if r["nulls"] else r["low"] for r in heads.collect()}
    filled = sorted(first)
    before = [(first[p], filled[i - 1]) for i, p in enumerate(filled)]
    # one row per range, so this side is small enough for every task
    sends = spark.createDataFrame(before, StructType([StructField("_low", key.dataType), StructField("_tail", IntegerType())]))
    placed = source.withColumn("_part", part_of("doc_id", splits)).join(
        F.broadcast(sends), F.col("doc_id").eqNullSafe(F.col("_low")), "left"
    )
    both = placed.select(
        "doc_id",
        "text",
        F.explode(
            F.filter(
                F.array(
                    F.struct(F.col("_part").alias("part"), F.lit(False).alias("tail")),
                    F.struct(F.col("_tail").alias("part"), F.lit(True).alias("tail")),
                ),
                lambda x: x["part"].isNotNull(),
            )
        ).alias("to"),
    ).select("doc_id", "text", "to.part", "to.tail")
    out = StructType([key, *FIELDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            rows = []
            for doc, text, tail in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist()):
                this = _Text(text)
                if last is not None and not last[2]:
                    rows.append((last[0], *_row(last[1], this)))
                last = doc, this, tail
            columns = list(zip(*rows)) if rows else [[] for _ in out.fields]
            arrays = [pa.array(c, t) for c, t in zip(columns, _types(batch, 0))]
            yield pa.RecordBatch.from_arrays(arrays, out.names)

    ranged = both.repartitionById(ranges, F.col("part")).sortWithinPartitions("part", "tail", "doc_id", "text")
    return ranged.mapInArrow(run, out)


def _types(batch: pa.RecordBatch, key: int) -> list[pa.DataType]:
    return [batch.column(key).type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
