"""Raw token-id files with keyed access through a minimal perfect hash.

A folder written by ``write_tokens`` holds

``shard-NNNNN.bin``
    the ids of a range of documents one after the other, little endian, two or
    four bytes each, and nothing else;
``documents/``
    Parquet, a row per document: ``doc_id``, ``occurrence``, ``shard``,
    ``offset`` (ids before it in its shard), ``start`` (ids before it in all
    shards), ``n_tokens``;
``bucket-NNNNN.idx``
    a minimal perfect hash over the keys of one hash bucket; each slot holds a
    fingerprint of its key and the place of its ids.
"""

from __future__ import annotations

import io
import os
import struct
import unicodedata
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from corpuswarden.llm.common import map_texts, mix64, ordered_parts, part_of, prepare, shuffle_parts

#: Keys in one index bucket, so that a bucket is built and held in some 20 MB.
BUCKET_KEYS = 250_000
#: Words a Python worker remembers the ids of from task to task, and the longest of them.
CACHE_WORDS, CACHE_CHARS = 1_200_000, 40
_LOADED: dict[str, tuple] = {}
MARKS = frozenset(".,;:!?")
SEPARATOR = "\x01"


def open_path(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a url or plain path; executors write through it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def put(path: str, data) -> None:
    """Write a whole file; it appears under its name only when complete, so that a
    repeated or lost task does no harm."""
    store, name = open_path(path)
    store.create_dir(os.path.dirname(name), recursive=True)
    with store.open_output_stream(draft := f"{name}.{uuid.uuid4().hex}") as out:
        out.write(data)
    store.move(draft, name)


def get(path: str) -> bytes:
    store, name = open_path(path)
    with store.open_input_file(name) as f:
        return f.read()


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit numbers, by levels of bit arrays.

    On each level a key sets the bit its hash names; keys that meet there go on
    to the next level. A key's slot is the number of bits set before its own."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.sizes = [len(x) * 64 for x in levels]
        words = np.concatenate(levels) if levels else np.empty(0, np.uint64)
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
        self.first = np.cumsum([0, *map(len, levels)])

    @classmethod
    def build(cls, keys: np.ndarray, load: float = 0.6) -> PerfectHash:
        levels, rest = [], keys.astype(np.uint64)
        while len(rest):
            size = int(len(rest) / load) // 64 * 64 + 64
            at = cls._place(rest, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(np.packbits(alone.reshape(-1, 64), axis=1, bitorder="little").view("<u8").ravel())
            rest = rest[~alone[at]]
        return cls(levels)

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix64(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)) % np.uint64(size)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; -1 for some of the keys that are not in the set."""
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            at = self._place(keys[open_], level, size)
            word, bit = self.first[level] + (at >> 6), (at & 63).astype(np.uint64)
            here = (self.words[word] >> bit) & np.uint64(1) == 1
            below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
            out[open_[here]] = (self.before[word] + np.bitwise_count(below))[here]
            open_ = open_[~here]
        return out


SLOT = np.dtype([("check", "<u4"), ("shard", "<u4"), ("offset", "<u8"), ("n", "<u4")])


def pack_index(keys: np.ndarray, shard, offset, n) -> bytes:
    """Bytes of an index over 64-bit keys. Of equal keys the first counts."""
    keys, first = np.unique(keys.astype(np.uint64), return_index=True)
    table = PerfectHash.build(keys)
    slots = np.zeros(len(keys), SLOT)
    at = table.slots(keys)
    slots["check"][at] = mix64(keys) >> np.uint64(32)
    for name, values in (("shard", shard), ("offset", offset), ("n", n)):
        slots[name][at] = np.asarray(values)[first]
    out = io.BytesIO()
    np.savez(out, slots=slots, **{f"level{i}": x for i, x in enumerate(table.levels)})
    return out.getvalue()


def find(index: bytes, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the keys, and which of them are there: the slot's fingerprint must agree."""
    with np.load(io.BytesIO(index)) as f:
        slots, levels = f["slots"], [f[f"level{i}"] for i in range(len(f.files) - 1)]
    at = PerfectHash(levels).slots(keys)
    if not len(slots):
        return np.zeros(len(keys), SLOT), np.zeros(len(keys), bool)
    row = slots[at]
    return row, (at >= 0) & (row["check"] == (mix64(keys) >> np.uint64(32)).astype(np.uint32))


def _load(path: str) -> tuple:
    """Tokenizer of a file, and for each type of ids the words remembered with theirs."""
    if path not in _LOADED:  # once per Python worker
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _LOADED.clear()
        _LOADED[path] = Tokenizer.from_file(path), {}
    return _LOADED[path]


def encoder(path: str, end_id: int | None, by_word: bool) -> Callable[[], Callable[[list[str]], list]]:
    """Ids of texts as bytes of two or four per id, and their number.

    ``by_word``: the tokenizer lower-cases, drops blanks and line feeds, and never
    joins what stands on both sides of them, nor a letter and a mark after it. So
    a word has the same ids everywhere, and each is encoded once."""

    def make():
        tokenizer, remembered = _load(path)
        kind = id_type(tokenizer.get_vocab_size(), end_id)
        known = remembered.setdefault(kind, {})
        width, letter = np.dtype(kind).itemsize, "H" if kind == "<u2" else "I"
        end = b"" if end_id is None else np.array([end_id], kind).tobytes()

        def ids(texts: list[str]) -> list[bytes]:
            encoded = tokenizer.encode_batch_fast(texts, add_special_tokens=False)
            return [struct.pack(f"<{len(e.ids)}{letter}", *e.ids) for e in encoded]

        def ids_of_words(words: list[str]) -> list[bytes]:
            """As ``ids``, all words as one text between marks that none of them holds."""
            text = f" {SEPARATOR} ".join(words)
            mark = tokenizer.encode(SEPARATOR, add_special_tokens=False).ids
            if len(mark) != 1 or text.count(SEPARATOR) != len(words) - 1:
                return ids(words)
            found = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, kind)
            ends = (np.append(np.flatnonzero(found == mark[0]), len(found)) * width).tolist()
            raw, start, out = found.tobytes(), 0, []
            for end in ends:
                out.append(raw[start:end])
                start = end + width
            return out

        def work(texts: list[str]) -> list:
            if not by_word:
                out = [x + end for x in ids(texts)]
            else:
                split = [t.replace("\n", " ").split(" ") for t in texts]
                if len(known) > CACHE_WORDS:
                    known.clear()
                new = {w: core(w) for w in set().union(*split).difference(known)}
                fresh = list({part for pair in new.values() for part in pair}.difference(known))
                known.update(zip(fresh, ids_of_words(fresh), strict=True))
                known.update((w, known[word] + known[mark]) for w, (word, mark) in new.items())
                out = [b"".join(map(known.__getitem__, words)) + end for words in split]
                for w in {w for w in (*new, *fresh) if len(w) > CACHE_CHARS}:
                    del known[w]
            return [out, [len(x) // width for x in out]]

        return work

    return make


def core(word: str) -> tuple[str, str]:
    """A word without the mark at its end, in lower case if it is plain, and the mark."""
    mark = ""
    if word[-1:] in MARKS and _ends_in_letter(word[:-1]):
        word, mark = word[:-1], word[-1]
    return word.lower() if word.isascii() and word.isalpha() else word, mark


def _ends_in_letter(word: str) -> bool:
    """Whether the last character is a letter, also once composed and in lower case.

    Some letters turn into a letter and a combining mark then, which joins a mark after it."""
    last = word[-1:]
    if last.isascii():
        return last.isalpha()
    return last.isalpha() and unicodedata.normalize("NFC", unicodedata.normalize("NFC", last).lower())[-1].isalpha()


def id_type(vocabulary: int, end_id: int | None) -> str:
    return "<u2" if max(vocabulary - 1, end_id or 0) < 65536 else "<u4"


def key_hash(key: str = "doc_id", occurrence: str | Column = "occurrence") -> Column:
    return F.xxhash64(F.col(key), F.col(occurrence) if isinstance(occurrence, str) else occurrence)


class TokenFiles:
    """A folder of token files: what it holds, and access by key."""

    def __init__(self, spark: SparkSession, path: str, kind: str, shards: int, buckets: int):
        self.spark, self.path, self.kind, self.shards, self.buckets = spark, path, kind, shards, buckets

    def documents(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/documents")

    def places(self, keys: DataFrame) -> DataFrame:
        """``shard``, ``offset`` and ``n_tokens`` of each key, by the index; null where it has none.

        ``keys`` has ``doc_id`` and, if documents repeat, ``occurrence`` (from 0)."""
        path, buckets = self.path, self.buckets
        if "occurrence" not in keys.columns:
            keys = keys.withColumn("occurrence", F.lit(0))
        wanted = keys.select("doc_id", F.col("occurrence").cast("int"), key_hash(occurrence=F.col("occurrence").cast("int")).alias("_key"))
        wanted = wanted.withColumn("_bucket", F.pmod("_key", F.lit(buckets)).cast("int"))
        out = StructType(wanted.schema.fields[:2] + [StructField(n, LongType()) for n in ("shard", "offset", "n_tokens")])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            loaded: dict[int, bytes] = {}
            for batch in batches:
                keys = batch.column(2).to_numpy().view(np.uint64)
                bucket = batch.column(3).to_numpy()
                row, there = np.zeros(len(keys), SLOT), np.zeros(len(keys), bool)
                for b in np.unique(bucket).tolist():
                    if b not in loaded:
                        loaded.clear()
                        loaded[b] = get(f"{path}/bucket-{b:05d}.idx")
                    mine = bucket == b
                    row[mine], there[mine] = find(loaded[b], keys[mine])
                places = [pa.array(row[n].astype(np.int64), mask=~there) for n in ("shard", "offset", "n")]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *places], out.names)

        # keys of a bucket follow one another, so that each index file is opened once
        return wanted.repartitionById(buckets, F.col("_bucket")).sortWithinPartitions("_bucket").mapInArrow(run, out)

    def read(self, keys: DataFrame) -> DataFrame:
        """``places`` and ``ids`` (bytes, four per id, little endian), null where the key is unknown."""
        path, kind = self.path, self.kind
        found = self.places(keys)
        out = StructType(found.schema.fields + [StructField("ids", BinaryType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            width, now, handle = np.dtype(kind).itemsize, None, None
            for batch in batches:
                ids = []
                for shard, offset, n in zip(*[batch.column(i).to_pylist() for i in (2, 3, 4)]):
                    if shard is None:
                        ids.append(None)
                        continue
                    if shard != now:
                        store, name = open_path(f"{path}/shard-{shard:05d}.bin")
                        now, handle = shard, store.open_input_file(name)
                    raw = handle.read_at(n * width, offset * width)
                    ids.append(np.frombuffer(raw, kind).astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.binary())], out.names)

        by_shard = found.repartitionById(self.shards, F.coalesce(F.col("shard"), F.lit(0)).cast("int"))
        return by_shard.sortWithinPartitions("shard", "offset").mapInArrow(run, out)


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 2, by_word: bool = False, parts: int | None = None
) -> TokenFiles:
    """Encode all texts and write their ids below ``path`` in ascending ``doc_id`` order.

    ``tokenizer`` is the path of a file for the tokenizers library, readable by
    every executor. Each document ends with ``end_id`` unless it is None. Texts
    are encoded where they are read; only their ids are shuffled, once, into
    ``parts`` ranges of ``doc_id`` (default: the session's shuffle partitions).

    Null texts are empty and have the end id only. Null ids come first. Rows
    that share a ``doc_id`` are all written and told apart by ``occurrence``,
    0 for the first in the order of their ids. Other columns are ignored. An
    empty table gives a folder without shards.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    prepare(spark)
    parts = parts or shuffle_parts(spark)
    kind = id_type(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id)
    splits = ordered_parts(docs.select("doc_id"), "doc_id", parts)
    shards = len(splits) + 1
    encoded = map_texts(
        docs, encoder(tokenizer, end_id, by_word), [StructField("ids", BinaryType()), StructField("n_tokens", LongType())]
    )
    key = encoded.schema["doc_id"]
    out = StructType(
        [key] + [StructField(n, LongType()) for n in ("occurrence", "shard", "offset", "n_tokens")]
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, shard, offset, last, seen = [], None, 0, object(), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            shard = batch.column(3)[0].as_py()
            keys, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            counts = batch.column(2).to_numpy()
            occurrence = []
            for k in keys:
                last, seen = k, (seen + 1 if k == last else 0)
                occurrence.append(seen)
            pieces.append(b"".join(ids))
            offsets = offset + np.cumsum(counts) - counts
            offset += int(counts.sum())
            columns = [pa.array(x, pa.int64()) for x in (occurrence, np.full(len(keys), shard), offsets, counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], out.names)
        if shard is not None:
            put(f"{path}/shard-{shard:05d}.bin", b"".join(pieces))

    ranged = encoded.withColumn("_part", part_of("doc_id", splits)).repartitionById(shards, F.col("_part"))
    written = ranged.sortWithinPartitions("doc_id", "ids").mapInArrow(write, out)
    written.write.parquet(f"{path}/written")
    table = spark.read.schema(out).parquet(f"{path}/written")
    sums = table.groupBy("shard").agg(F.sum("n_tokens").alias("_n"), F.count("*").alias("_rows"))
    totals = {r["shard"]: r for r in sums.collect()}  # one row per shard
    base, rows, bases = 0, 0, []
    for s in sorted(totals):
        bases.append((s, base))
        base, rows = base + totals[s]["_n"], rows + totals[s]["_rows"]
    starts = spark.createDataFrame(bases, "_shard long, _base long")
    buckets = max(1, -(-rows // BUCKET_KEYS))
    full = table.join(starts, F.col("shard") == F.col("_shard")).withColumn("start", F.col("offset") + F.col("_base"))
    full.select("doc_id", F.col("occurrence").cast("int"), "shard", "offset", "start", "n_tokens").write.parquet(
        f"{path}/documents"
    )
    files = TokenFiles(spark, path, kind, shards, buckets)
    if rows:
        _write_index(files)
    else:
        put(f"{path}/bucket-00000.idx", pack_index(np.empty(0, np.uint64), [], [], []))
    return files


def _write_index(files: TokenFiles) -> None:
    path, buckets = files.path, files.buckets
    keyed = files.documents().select(key_hash().alias("_key"), "shard", "offset", "n_tokens")
    keyed = keyed.withColumn("_bucket", F.pmod("_key", F.lit(buckets)).cast("int"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = [b for b in batches if b.num_rows]
        if not full:
            return
        held = pa.Table.from_batches(full)
        bucket, values = held["_bucket"].to_numpy(), [held[n].to_numpy() for n in ("_key", "shard", "offset", "n_tokens")]
        done = np.unique(bucket)
        for b in done.tolist():
            mine = bucket == b
            put(f"{path}/bucket-{b:05d}.idx", pack_index(*[v[mine] for v in values]))
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.int32())], ["bucket"])

    spread = keyed.repartitionById(buckets, F.col("_bucket"))
    spread.mapInArrow(build, "bucket int").write.format("noop").mode("overwrite").save()


def checksums(files: TokenFiles) -> DataFrame:
    """Per document, read back through the index and the shards: ``doc_id``, ``start``,
    ``n_tokens`` and ``ids_crc32`` (unsigned, over the ids as four bytes each)."""
    read = files.read(files.documents().select("doc_id", "occurrence"))
    bases = files.documents().groupBy("shard").agg(F.min("start").alias("_base"))
    return read.join(bases.withColumnRenamed("shard", "_shard"), F.col("shard") == F.col("_shard")).select(
        "doc_id",
        (F.col("_base") + F.col("offset")).alias("start"),
        "n_tokens",
        F.crc32("ids").alias("ids_crc32"),
    )
