"""Spelling variants: words that one inserted, deleted or replaced letter parts.

Words that are one edit apart agree on both sides of it, so they share the first
half or the second half of their letters. Each word is listed under both, once
with its own length and once as the shorter of a pair; an edit can lie only in
the part that is left free, and of two halves that fit the one counts that
leaves the pair's first difference free. So each pair meets exactly once. A key
that more than ``MOST`` words share is split the same way again, until at most one
letter is free: no group grows with the corpus, and no pair is lost.

Words of one or more keys make a block with a bit-sliced index: for each position
and letter one bit per word of the block. For all words of the block at once,
and 64 candidates per machine word, three sets go along the positions: those
without a difference so far, and those with one behind them, either in step or
shifted by one letter.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from corpuswarden.llm.common import prepare, texts_of
from corpuswarden.session import materialize

#: Least letters of a word, and least occurrences.
LETTERS, TIMES = 7, 2
#: A word's form occurs so many times as often.
RATIO = 10
#: Words under a key before it is split, and words of a block.
MOST, BLOCK = 2_048, 1_024
#: Letters of a block, its words counted as long as the longest.
CELLS = 1_000_000
#: Distinct words a task counts before it hands them on.
COUNTED = 400_000
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def word_counts(docs: DataFrame, letters: int = LETTERS, times: int = TIMES) -> DataFrame:
    """``word`` and ``n``: runs of letters in all texts, some of them with one letter taken
    out as their check sum says, of at least so many letters and occurrences."""
    prepare(docs.sparkSession)
    source = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text")
    run_of = f"[A-Za-zÀ-ÿ]{{{letters},}}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, counts = re.compile(run_of).findall, Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()
            return made

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), texts_of(batch)):
                begun = zlib.crc32(f"{doc}:".encode())
                for word, n in Counter(find(text)).items():
                    word = word.lower() if word.isascii() else word.translate(_LOWER)
                    h = zlib.crc32(word.encode(), begun)
                    if h % 31 == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < letters:
                            continue
                    counts[word] += n
                if len(counts) > COUNTED:
                    yield out()
        if counts:
            yield out()

    counted = source.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= times)


def _halves(size: str, low: str, high: str):
    """The two parts of the free letters from ``low`` to ``high``: an edit that leaves the first ones
    alike lies behind them, any other before. ``size`` is the greater length of a pair."""
    middle = F.expr(f"{low} + cast(ceil(({high} - {low} - 1) / 2) as int)")
    later = F.struct(F.expr(size).alias("size"), middle.alias("low"), F.expr(high).alias("high"))
    sooner = F.struct(F.expr(size).alias("size"), F.expr(low).alias("low"), middle.alias("high"))
    return F.array(later, sooner)


def _keyed(words: DataFrame, zones) -> DataFrame:
    """Rows of words and zones, with the letters outside the zone as ``affix``."""
    rows = words.select("word", "n", F.explode(zones).alias("z")).select("word", "n", "z.*")
    rows = rows.where("low < high")
    tail = F.col("size") - F.col("high")
    affix = F.concat(F.substring("word", F.lit(1), F.col("low")), F.lit("\n"), F.substring(F.col("word"), F.length("word") - tail + 1, tail))
    return rows.withColumn("affix", affix)


def keyed_words(words: DataFrame, most: int = MOST) -> DataFrame:
    """``word``, ``n``, ``size``, ``low``, ``high``, ``affix``: every word under all its keys, of which
    none has more than ``most`` words unless one letter only is free."""
    key = ["size", "low", "high", "affix"]
    sized = words.select("word", "n", F.explode(F.array(F.length("word"), F.length("word") + 1)).alias("size"))
    rows = _keyed(sized, _halves("size", "0", "size"))
    done = None
    while True:
        counts = rows.groupBy(*key).count().where((F.col("count") > most) & (F.col("high") - F.col("low") > 1)).select(*[F.col(k).alias(f"_{k}") for k in key])
        hot, n = materialize(counts, "spelling-keys")
        if not n:
            return rows if done is None else done.unionByName(rows)
        met = [F.col(k) == F.col(f"_{k}") for k in key]
        cold = rows.join(hot, met, "left_anti")
        done = cold if done is None else done.unionByName(cold)
        rows, _ = materialize(_keyed(rows.join(hot, met, "left_semi"), _halves("size", "low", "high")), "spelling-split")


def _bits(index: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each bit set in a matrix of machine words."""
    row, word = np.nonzero(index)
    found = np.unpackbits(index[row, word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    at, bit = np.nonzero(found)
    return row[at], word[at] * 64 + bit


def near_pairs(words: list[str], size: np.ndarray, low: np.ndarray, high: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of words and of their near words within the block.

    ``group`` numbers equal keys; rows of one group follow one another."""
    count = len(words)
    length = np.array([len(w) for w in words])
    longest, width = int(length.max()), -(-count // 64)
    letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    known, code = np.unique(letters, return_inverse=True)
    none = len(known)
    row = np.repeat(np.arange(count), length)
    place = np.arange(len(letters)) - np.repeat(np.cumsum(length) - length, length)
    codes = np.full((count, longest + 2), none)
    codes[row, place] = code
    # the index: a bit per word for each position and letter that occur, and a line without bits
    used, line = np.unique(place * (none + 1) + code, return_inverse=True)
    index = np.zeros((len(used) + 1, width), np.uint64)
    bit = np.uint64(1) << (np.arange(count, dtype=np.uint64) & np.uint64(63))
    np.bitwise_or.at(index, (line, row >> 6), bit[row])
    lines = np.full((longest + 2) * (none + 1), len(used), np.int32)
    lines[used] = np.arange(len(used))
    lines = lines.reshape(longest + 2, none + 1)
    sizes, same = np.zeros((longest + 2, width), np.uint64), np.zeros((int(group.max()) + 1, width), np.uint64)
    for table, at in ((sizes, length), (same, group)):
        np.bitwise_or.at(table, (at, np.arange(count) >> 6), bit)

    left, right = [], []
    kinds = np.stack([size, low, high, length])
    for s, a, b, m in np.unique(kinds, axis=1).T.tolist():
        mine = np.flatnonzero((kinds == [[s], [a], [b], [m]]).all(axis=0))
        own = codes[mine]
        alike = same[group[mine]]  # no difference so far
        if m == s:  # the longer, or of equal length: a letter replaced, or one too many here
            replaced = np.zeros_like(alike)
            extra = np.zeros_like(alike)
            for p in range(a, b):
                here = index[lines[p, own[:, p]]]
                parted = alike & ~here
                extra = (extra & index[lines[p - 1, own[:, p]]]) | parted if p else parted
                replaced = (replaced & here) | parted
                alike = alike & here
            found = (replaced & sizes[s]) | (extra & sizes[s - 1])
        else:  # the shorter: a letter is missing here
            missing = np.zeros_like(alike)
            for p in range(a, b - 1):
                here, after = index[lines[p, own[:, p]]], index[lines[p + 1, own[:, p]]]
                missing = (missing | (alike & ~here)) & after
                alike = alike & here
            # or it is missing just before the shared end, which must differ from it
            found = (missing | (alike & ~index[lines[b - 1, own[:, b - 1]]])) & sizes[s]
        i, j = _bits(found, width)
        left.append(mine[i])
        right.append(j)
    return np.concatenate(left), np.concatenate(right)


def _near(keyed: DataFrame) -> DataFrame:
    """For each word and key with near words: ``word``, ``n_near``, and of the near word of largest
    ``n`` its ``n`` and the word itself. Rows come in the order of their keys."""
    out = "word string, n_near long, near_n long, near string"

    def solve(rows: list[tuple]) -> pa.RecordBatch | None:
        words, n, size, low, high, affix = zip(*rows)
        keys = list(zip(size, low, high, affix))
        group = np.cumsum([False] + [a != b for a, b in zip(keys, keys[1:])])
        i, j = near_pairs(list(words), *[np.array(x) for x in (size, low, high)], group)
        if not len(i):
            return None
        n = np.array(n, np.int64)
        rank = np.empty(len(words), np.int64)
        rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
        order = np.lexsort((rank[j], -n[j], i))
        i, j = i[order], j[order]
        first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
        columns = [pa.array([words[k] for k in i[first]], pa.string()), pa.array(np.diff(np.r_[first, len(i)]), pa.int64())]
        columns += [pa.array(n[j[first]], pa.int64()), pa.array([words[k] for k in j[first]], pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["word", "n_near", "near_n", "near"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                # sizes grow, so the last word is as long as any before
                if held and row[2:] != held[-1][2:] and (len(held) >= BLOCK or len(held) * row[2] > CELLS):
                    if (made := solve(held)) is not None:
                        yield made
                    held = []
                held.append(row)
        if held and (made := solve(held)) is not None:
            yield made

    key = ["size", "low", "high", "affix"]
    source = keyed.select("word", "n", *key).repartition(*key).sortWithinPartitions(*key)
    return source.mapInArrow(run, out)


def spelling_variants(docs: DataFrame, letters: int = LETTERS, times: int = TIMES, ratio: int = RATIO, most: int = MOST) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n`` of every word of at least so many letters
    and occurrences in all texts.

    A word's form is its near word of largest ``n`` (of equal ones the smallest) if
    that is at least ``ratio`` times its own, else null; the root is what its forms
    lead to, the word itself if it has none. As ``n`` grows tenfold with each
    form, there are fewer steps than the largest ``n`` has digits.

    Null and empty texts have no words, a null ``doc_id`` counts as an empty one
    in the check sums, rows that repeat count again, other columns are ignored.
    An empty table gives no words.
    """
    words, _ = materialize(word_counts(docs, letters, times), "spelling-words")
    near = _near(keyed_words(words, most))
    both = words.select("word", "n").unionByName(near, allowMissingColumns=True)
    # of the nearest of each key the one of largest n, then the smallest
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("w"))))
    summed = both.groupBy("word").agg(F.max("n").alias("n"), F.coalesce(F.sum("n_near"), F.lit(0)).alias("n_near"), best.alias("b"))
    formed = F.col("b.m") <= -ratio * F.col("n")
    table, _ = materialize(
        summed.select("word", "n", "n_near", F.when(formed, F.col("b.w")).alias("form"), F.when(formed, -F.col("b.m")).alias("form_n")), "spelling-forms"
    )
    links = table.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    forms = table.where("form IS NOT NULL").select(F.col("word").alias("_word"), F.col("form").alias("_form"))
    while True:
        links, moved = _step(links, forms)
        if not moved:
            break
    rooted = table.join(links.withColumnRenamed("word", "_w"), F.col("word") == F.col("_w"), "left")
    return rooted.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _step(links: DataFrame, forms: DataFrame) -> tuple[DataFrame, int]:
    """Roots moved on by one form, and whether any was."""
    moved = links.join(forms, F.col("root") == F.col("_word"), "left").select("word", F.coalesce("_form", "root").alias("root"), F.col("_form").isNotNull().alias("on"))
    made, _ = materialize(moved, "spelling-roots")
    return made.select("word", "root"), 0 if made.where("on").isEmpty() else 1
