"""Shared helpers: per-row work over Arrow batches, ordered partitions, hashes of words.

What all operators of this package have in common:

* They read ``doc_id`` and ``text`` and nothing else of a row; further columns,
  whatever their names, are ignored or carried unchanged in a struct.
* A null text counts as empty. A null ``doc_id`` is a value like any other
  unless an operator says otherwise.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from corpuswarden.session import apply_runtime

ROW = "_row"
#: Rows of an Arrow batch, some MB of ordinary text, and its bytes where texts are long.
BATCH_ROWS, BATCH_BYTES = 1_000, 16 << 20


def prepare(spark: SparkSession) -> None:
    """Settings the operators count on; all can be set at run time."""
    apply_runtime(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """Texts of a batch, null as empty."""
    column = batch.column(batch.schema.get_field_index(name))
    return [t or "" for t in column.to_pylist()]


def map_texts(
    docs: DataFrame,
    make: Callable[[], Callable[[list[str]], list]],
    fields: list[StructField],
    carry: bool = False,
) -> DataFrame:
    """One row out for each row in: ``doc_id`` and the new fields.

    ``make`` is called once per task and returns a function from the texts of a
    batch to one list or array per field. With ``carry`` the whole input row
    follows as struct ``_row``, so that names can't clash.
    """
    prepare(docs.sparkSession)
    columns = [F.col("doc_id"), F.col("text")]
    if carry:
        columns.append(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(ROW))
    source = docs.select(*columns)
    kept = [source.schema["doc_id"]] + ([source.schema[ROW]] if carry else [])
    out = StructType(kept + fields)
    names, types = [f.name for f in out.fields], [_arrow(f) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            made = work(texts_of(batch))
            arrays = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            arrays += [pa.array(a, t) if not isinstance(a, pa.Array) else a for a, t in zip(made, types)]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return source.mapInArrow(run, out)


def _arrow(field: StructField) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(field.dataType)


def ordered_parts(keys: DataFrame, key: str, parts: int) -> list:
    """At most ``parts - 1`` split points that cut the values of ``key`` in even ranges.

    Only the key column is read, and only the split points reach the driver."""
    if parts < 2:
        return []
    shares = [i / parts for i in range(1, parts)]
    found = keys.agg(F.percentile_approx(key, F.array(*map(F.lit, shares)), 10_000).alias("s")).first()["s"]
    return sorted(set(found or []))


def part_of(key: str, splits: list):
    """Number of the range that a key lies in: how many split points are at or below it.

    Null keys lie in range 0. The points are searched in two steps, a coarse one
    and one within a block, so that many ranges cost little."""
    if not splits:
        return F.lit(0)
    step = math.isqrt(len(splits) - 1) + 1
    points, coarse = (F.array(*[F.lit(s) for s in x]) for x in (splits, splits[::step]))
    below = lambda x: F.size(F.filter(x, lambda s: s <= F.col(key)))
    start = F.greatest(below(coarse) - 1, F.lit(0)) * step
    return F.coalesce(start + below(F.slice(points, start + 1, F.lit(step))), F.lit(0)).cast("int")


def shuffle_parts(spark: SparkSession) -> int:
    """Number of partitions of a shuffle, as the session has it."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


# --- words as 64-bit numbers ------------------------------------------------------

_ODD = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit numbers (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


_POWERS: dict[str, np.ndarray] = {}
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * _ODD)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Gaps of words of ASCII letters, digits and all characters beyond ASCII.
MARKS = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64, and of its inverse."""
    if len(_POWERS.get("up", ())) < n:
        size = 1 << max(16, (n - 1).bit_length())
        base = int(_ODD) | 1
        for name, b in (("up", base), ("down", pow(base, -1, 1 << 64))):
            out = np.ones(size, np.uint64)
            out[1:] = np.uint64(b)
            _POWERS[name] = np.multiply.accumulate(out)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def word_hashes(text: str, gap: np.ndarray = _SPACE, prefixes: tuple[int, ...] = ()) -> np.ndarray:
    """A 64-bit number for each word of a text, A-Z lower-cased.

    Words are what stands between the UTF-8 bytes marked in ``gap``, which are
    ``\\x20\\x09-\\x0D`` unless given. Equal words have equal numbers. A prefix sum of
    byte values times powers of the base gives every word's number by one
    difference. For each size in ``prefixes`` the numbers of the first so many
    bytes of all longer words follow."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if not len(raw):
        return np.empty(0, np.uint64)
    inside = ~gap[raw]
    edge = np.diff(inside.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[_LOWER[raw]] * up[:-1], out=total[1:])
    out = [mix64((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))]
    for size in prefixes:
        at = start[end - start > size]
        out.append(mix64((total[at + size] - total[at]) * down[at] + np.uint64(size << 32)))
    return np.concatenate(out) if prefixes else out[0]


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Numbers of all k-word shingles in order; fewer words than k make one shingle of all."""
    if not len(words):
        return words
    k = min(k, len(words))
    n = len(words) - k + 1
    out = np.full(n, np.uint64(k), np.uint64)
    for i in range(k):
        out = mix64(out * _ODD + words[i : i + n])
    return out
