"""Exact n-gram Jaccard join of whole documents.

Documents meet in tiles. Sizes fall in bands, so that two documents can only
link within a band or across neighbouring ones. For a band, the greatest number
of shingles in which two linked documents may differ is known; a set is cut by
hash into more parts than that, so two linked documents have at least one
non-empty part in common. A tile is a band, a part number and that part's
content. Since a part holds several shingles, passages that many documents share
do not crowd a tile; copies and near copies do, and there each document is
compared with the first one of its tile. What then stays apart in a tile is
compared across its components by bitmaps. Rows whose pairs stay open leave it in groups, and
equal groups of several tiles are one. In a group first one likely pair is decided for each
component that may be taken in, then what is still open, by the sets themselves.
Fewer pairs leave a tile or group than it has rows.

Each set also has a bitmap: one bit per hash class, set if the class holds an odd
number of shingles. Every differing shingle flips one bit, so the bits in which
two bitmaps differ bound the difference from below and the overlap from above.
Pairs that pass it are decided by intersecting the sorted sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, LongType, StructField, StructType

from corpuswarden.llm.common import map_texts, mix64, prepare, shingle_hashes, shuffle_parts, texts_of, word_hashes
from corpuswarden.llm.components import components
from corpuswarden.session import materialize

#: Documents of an Arrow batch that share a key before they get a tile of their own.
CROWD = 8
#: Rows of a tile that are compared at once; larger tiles are cut in blocks of about this size.
TILE_ROWS = 2_048
#: Shingles of the rows that are compared at once, so that their sets take some 32 MB.
TILE_SHINGLES = 1 << 22
#: Bits for each id that is asked for, and most bits of all: 8 MB.
ASKED_BITS, ASKED_MOST = 32, 1 << 26


class Bands:
    """Bands of set sizes for a threshold ``num / den``, and how sets are cut in them."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.low = [1]

    def _grow(self, n: int) -> None:
        while self.low[-1] <= n:
            self.low.append(self.low[-1] * self.den // self.num + 1)

    def of(self, n: int) -> int:
        """Band of a size: a partner is in the same band or the next one."""
        self._grow(n)
        return int(np.searchsorted(self.low, n, side="right")) - 1

    def differ(self, band: int) -> int:
        """Most shingles in which linked sets differ, the smaller one in this band."""
        while len(self.low) < band + 2:
            self.low.append(self.low[-1] * self.den // self.num + 1)
        small = self.low[band + 1] - 1
        large = small * self.den // self.num
        return (small + large) * (self.den - self.num) // (self.den + self.num)

    def parts(self, band: int) -> tuple[int, int]:
        """Parts that sets are cut into, and how many empty ones leave a common non-empty part."""
        most = self.differ(band)
        spare = 1 + most // 50 if most else 0
        return most + 1 + spare, spare

    def width(self, band: int) -> int:
        """Bits of a bitmap: four times what may differ, as a power of two."""
        return max(64, 1 << (4 * self.differ(band) - 1).bit_length())

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        """Tiles of a set, given as sorted distinct hashes."""
        if not len(hashes):
            return np.empty(0, np.uint64)
        own = self.of(len(hashes))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(hashes), dtype=np.uint64)])
        top, out = hashes >> np.uint64(32), []
        for band in {own, max(0, own - 1)}:
            parts, spare = self.parts(band)
            cuts = np.searchsorted((top * np.uint64(parts)) >> np.uint64(32), np.arange(parts + 1))
            number = mix64(np.arange(parts, dtype=np.uint64) + np.uint64(band + 1) * np.uint64(1 << 32))
            sizes = np.diff(cuts)
            content = total[cuts[1:]] - total[cuts[:-1]] + sizes.astype(np.uint64)
            keys = mix64(content ^ number)
            full = sizes > 0
            # with more empty parts than spare ones the common part may be an empty one
            out.append(keys if parts - full.sum() > spare else keys[full])
        return np.concatenate(out)

    def bitmap(self, hashes: np.ndarray) -> bytes:
        if not len(hashes):
            return b""
        width = self.width(self.of(len(hashes)))
        odd = np.bincount((hashes & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
        return np.packbits(odd.astype(bool), bitorder="little").tobytes()

    def linked(self, common: int, a: int, b: int) -> bool:
        return a > 0 and b > 0 and self.den * common >= self.num * (a + b - common)

    def may_link(self, a: int, b: int, x: np.ndarray, y: np.ndarray) -> bool:
        """What sizes and bitmaps leave open. The wider bitmap is folded to the other's width."""
        if self.den * min(a, b) < self.num * max(a, b):
            return False
        while len(x) > len(y):
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        while len(y) > len(x):
            y = y[: len(y) // 2] ^ y[len(y) // 2 :]
        differ = int(np.bitwise_count(x ^ y).sum())
        return self.linked((a + b - differ) // 2, a, b)


def shingle_set(text: str, words: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    return np.unique(shingle_hashes(word_hashes(text), words))


def _content(hashes: np.ndarray) -> bytes:
    """Sixteen bytes that identify a set."""
    a, b = mix64(hashes), mix64(hashes ^ np.uint64(0x5851F42D4C957F2D))
    return np.array([a.sum(dtype=np.uint64), b.sum(dtype=np.uint64)], "<u8").tobytes()


def _profiles(docs: DataFrame, words: int, bands: Bands) -> DataFrame:
    def make() -> Callable[[list[str]], list]:
        def work(texts: list[str]) -> list:
            sets = [shingle_set(t, words) for t in texts]
            return [[len(s) for s in sets], [_content(s) for s in sets], [bands.bitmap(s) for s in sets]]

        return work

    fields = [StructField("n_shingles", LongType()), StructField("content", BinaryType()), StructField("bitmap", BinaryType())]
    return map_texts(docs, make, fields)


def _tiles(docs: DataFrame, words: int, bands: Bands) -> DataFrame:
    """Rows ``key``, ``tile``, ``id``, ``more``: a document in a tile; ``key`` splits crowded tiles.

    Where many documents of a batch share a tile they form a group with a key of
    its own, which only its first document leaves; copies within a batch
    are in one group instead of in all their tiles. ``more`` marks the rows of such
    groups, whose tiles have rows under other keys."""
    source = docs.where("doc_id IS NOT NULL").select("doc_id", "text")
    out = StructType([StructField("key", LongType()), StructField("tile", LongType()), StructField("id", source.schema["doc_id"].dataType), StructField("more", BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tiles, rows, first = [], [], {}
            for i, text in enumerate(texts_of(batch)):
                hashes = shingle_set(text, words)
                if not len(hashes):
                    continue
                content = _content(hashes)
                same = first.setdefault(content, i)
                if same != i:  # a copy: a group of both, under the content's own number
                    number = mix64(np.frombuffer(content, np.uint64)[:1] + np.uint64(1))
                    tiles.append(np.repeat(number, 2))
                    rows.append(np.array([same, i]))
                    continue
                own = bands.keys(hashes)
                tiles.append(own)
                rows.append(np.full(len(own), i))
            tile = np.concatenate(tiles) if tiles else np.empty(0, np.uint64)
            row = np.concatenate(rows).astype(np.int64) if rows else np.empty(0, np.int64)
            _, at, inverse, count = np.unique(tile, return_index=True, return_inverse=True, return_counts=True)
            crowded = count[inverse] >= CROWD
            key = tile.copy()
            if len(tile):
                key[crowded] = mix64(tile[crowded] + mix64(tile[:1] + np.uint64(len(tile))))
            lead = at[count >= CROWD]
            key, tile, row = (np.concatenate([a, b]) for a, b in ((key, tile[lead]), (tile, tile[lead]), (row, row[lead])))
            more = np.concatenate([crowded, np.ones(len(lead), bool)])
            ids = batch.column(0).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(tile.view(np.int64)), ids, pa.array(more)], out.names)

    return source.mapInArrow(run, out)


def _members(tiles: DataFrame) -> DataFrame:
    """Rows ``tile``, ``id``, ``first`` of all keys with two rows or more, one run of equal keys after the other.

    Where ``more`` is given, a tile that is known to have two rows only comes as its second one alone, without ``tile``:
    the two are compared, and nothing else is left to compare there."""
    kind, marked = tiles.schema["id"].dataType, "more" in tiles.columns
    out = StructType([StructField("tile", LongType()), StructField("id", kind), StructField("first", kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key_now, first_now, waiting = None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, tile, ids = batch.column(0).to_numpy(), batch.column(1), batch.column(2)
            begins = np.concatenate([[key[0] != key_now], key[1:] != key[:-1]])
            goes_on = not begins[0]
            run_of = np.cumsum(begins) - (0 if goes_on else 1)  # 0 is the run of the batch before, if it goes on
            leads = ids.take(pa.array(np.flatnonzero(begins)))
            if goes_on:
                leads = pa.concat_arrays([first_now, leads])
            size = np.bincount(run_of)
            wanted = size[run_of] > 1
            if goes_on:
                wanted[run_of == 0] = True
            if marked:
                # runs at an end of the batch may have more rows in another one
                two = (size == 2) & (np.bincount(run_of, batch.column(3).to_numpy(zero_copy_only=False)) == 0)
                two[[run_of[0], run_of[-1]]] = False
                wanted &= ~(two[run_of] & begins)
                tile = pa.array(tile.to_numpy(), mask=two[run_of])
            at = pa.array(np.flatnonzero(wanted))
            if goes_on and waiting is not None:
                # the run's first document, alone until now
                yield pa.RecordBatch.from_arrays([waiting, first_now, first_now], out.names)
            yield pa.RecordBatch.from_arrays([tile.take(at), ids.take(at), leads.take(pa.array(run_of[wanted]))], out.names)
            key_now, first_now = key[-1], leads.slice(len(leads) - 1)
            waiting = None if wanted[-1] else tile.slice(len(tile) - 1)

    ranged = tiles.repartition(shuffle_parts(tiles.sparkSession), "key").sortWithinPartitions("key", "id")
    return ranged.mapInArrow(run, out)


def _open_pairs(pairs: DataFrame, profiles: DataFrame, bands: Bands) -> DataFrame:
    """Pairs that sizes and bitmaps leave open, with ``equal`` where the sets are the same."""
    out = StructType([pairs.schema["a"], pairs.schema["b"], StructField("equal", BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, equal = [], []
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("na", "nb", "ca", "cb", "xa", "xb")]
            for i, (na, nb, ca, cb, xa, xb) in enumerate(zip(*columns)):
                if na and nb and (na == nb and ca == cb or bands.may_link(na, nb, np.frombuffer(xa, np.uint8), np.frombuffer(xb, np.uint8))):
                    kept.append(i)
                    equal.append(na == nb and ca == cb)
            at = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(equal, pa.bool_())], out.names)

    side = lambda s: profiles.select(
        F.col("doc_id").alias(f"_{s}"), F.col("n_shingles").alias(f"n{s}"), F.col("content").alias(f"c{s}"), F.col("bitmap").alias(f"x{s}")
    )
    joined = pairs.join(side("a"), F.col("a") == F.col("_a")).join(side("b"), F.col("b") == F.col("_b"))
    return joined.select("a", "b", "na", "nb", "ca", "cb", "xa", "xb").mapInArrow(run, out)


def _asked(docs: DataFrame, ids: DataFrame, most: int) -> DataFrame:
    """The rows of ``docs`` whose id is in ``ids`` (column ``id``, ``most`` rows at most), and some others.

    A bitmap of hashed ids of bounded size is compared with every row where it lies, so that no text is shuffled to tell."""
    bits = min(ASKED_MOST, max(1 << 15, 1 << (ASKED_BITS * most - 1).bit_length()))
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    bucket = lambda c: F.shiftright(bit(c), 15)
    place = lambda c: bit(c).bitwiseAND(F.lit((1 << 15) - 1))
    dealt = ids.select(bucket("id").alias("_bucket"), place("id").alias("_place")).distinct().repartition("_bucket")
    maps = dealt.groupBy("_bucket").agg(F.bitmap_construct_agg("_place").alias("_map"))
    at = place("doc_id").cast("int")
    byte = F.conv(F.hex(F.substring(F.col("_map"), F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    has = byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), at.bitwiseAND(F.lit(7)) + 1)) > 0
    return docs.join(F.broadcast(maps), (bucket("doc_id") == F.col("_bucket")) & has, "left_semi")


def _sets(docs: DataFrame, ids: DataFrame, most: int, words: int) -> DataFrame:
    """``doc_id`` and ``hashes``, the sorted set, of the rows with these ids, and of some others."""

    def make() -> Callable[[list[str]], list]:
        return lambda texts: [[shingle_set(t, words).tobytes() for t in texts]]

    return map_texts(_asked(docs, ids, most).select("doc_id", "text"), make, [StructField("hashes", BinaryType())])


def _exact(pairs: DataFrame, most: int, docs: DataFrame, words: int, bands: Bands) -> DataFrame:
    """The pairs (``most`` at most) whose sets, made again from their texts, do link."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id")))
    sets = _sets(docs, ids, 2 * most, words)
    out = StructType([pairs.schema["a"], pairs.schema["b"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for i, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if bands.linked(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)):
                    kept.append(i)
            at = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], out.names)

    side = lambda s: sets.select(F.col("doc_id").alias(f"_{s}"), F.col("hashes").alias(f"h{s}"))
    joined = pairs.join(side("a"), F.col("a") == F.col("_a")).join(side("b"), F.col("b") == F.col("_b"))
    return joined.select("a", "b", "ha", "hb").mapInArrow(run, out)


def _verified(pairs: DataFrame, profiles: DataFrame, docs: DataFrame, words: int, bands: Bands) -> DataFrame:
    left, n = materialize(_open_pairs(pairs, profiles, bands), "ngram-join", counted=~F.col("equal"))
    exact = _exact(left.where("NOT equal").select("a", "b"), n, docs, words, bands)
    return left.where("equal").select("a", "b").union(exact)


def _copies(profiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``doc_id`` and ``lead``, the smallest id with an equal set, of all documents with shingles, and
    those ``lead`` with the ``size`` of their set."""
    same = profiles.where("n_shingles > 0").groupBy("n_shingles", "content").agg(F.min("doc_id").alias("lead"))
    same, _ = materialize(same, "ngram-join")
    every = profiles.join(same.withColumnsRenamed({"n_shingles": "_n", "content": "_c"}), (F.col("n_shingles") == F.col("_n")) & (F.col("content") == F.col("_c")))
    every, _ = materialize(every.select("doc_id", "lead"), "ngram-join")
    return every, same.groupBy("lead").agg(F.max("n_shingles").alias("size"))


def _between_leads(pairs: DataFrame, copies: DataFrame) -> DataFrame:
    """The pairs with each document replaced by one it is linked with as a copy, so that pairs of
    groups of copies are decided once."""
    # a repeated id has several sets, and the pair may be of any of them
    once = copies.groupBy("doc_id").agg(F.min("lead").alias("lead"), F.count("*").alias("times")).where("times = 1 AND lead != doc_id")
    for end in ("a", "b"):
        side = once.select(F.col("doc_id").alias(f"_{end}"), F.col("lead").alias(f"_lead_{end}"))
        pairs = pairs.join(side, F.col(end) == F.col(f"_{end}"), "left")
    return _ordered(pairs.select(F.coalesce("_lead_a", "a").alias("a"), F.coalesce("_lead_b", "b").alias("b"))).where("a != b")


def _torn(members: DataFrame, leads: DataFrame, found: DataFrame, profiles: DataFrame) -> DataFrame:
    """Rows of tiles that hold several components, with their sizes and bitmaps, cut in blocks.

    Only the ``leads`` of equal sets are looked at, and of tiles with the same rows one only.
    Rows of one tile meet in blocks of bounded rows and bytes, each two blocks under a key of
    their own (``tile``, ``low``, ``high``)."""
    nodes = leads.join(found, F.col("lead") == F.col("node"), "left").select("lead", "size", F.coalesce("component", "lead").alias("c"))
    mem = members.select("tile", "id").join(nodes, F.col("id") == F.col("lead")).select("tile", "id", "c", F.col("size").alias("_size"))
    # sums of halves of hashes tell which rows a tile has; repeated ones count as often as they stand there
    one, two = F.xxhash64("id"), F.xxhash64("id", F.lit(1))
    halves = [h for x in (one, two) for h in (F.shiftrightunsigned(x, 32), x.bitwiseAND(F.lit((1 << 32) - 1)))]
    sums = [F.sum(h).alias(f"s{i}") for i, h in enumerate(halves)]
    torn = mem.groupBy("tile").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("n"), F.sum("_size").alias("total"), *sums)
    blocks = F.ceil(F.greatest(F.col("n") / TILE_ROWS, F.col("total") / TILE_SHINGLES)).cast("int")
    # of two documents in a tile one is the first, and they have been compared
    torn = torn.where((F.col("lo") != F.col("hi")) & (F.col("n") > 2)).select("tile", blocks.alias("blocks"), F.xxhash64("n", "s0", "s1").alias("x"), F.xxhash64("s2", "s3", "n").alias("y"))
    torn = torn.groupBy("x", "y", "blocks").agg(F.min("tile").alias("_tile")).select("_tile", "blocks")
    rows = mem.join(torn, F.col("tile") == F.col("_tile"))
    rows = rows.join(profiles.select("doc_id", "n_shingles", "bitmap"), F.col("id") == F.col("doc_id"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select("tile", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "id", "c", "n_shingles", "bitmap")


class Tile:
    """Rows of a tile that are compared at once: those of one block, or of two blocks with each other."""

    def __init__(self, rows: list[tuple], bands: Bands):
        self.rows, self.bands = sorted(rows, key=lambda r: r[6]), bands
        self.size = np.array([r[6] for r in self.rows])
        width = min(len(r[7]) for r in rows)
        self.maps = np.array([_folded(r[7], width) for r in self.rows])
        self.block = np.array([r[3] for r in self.rows])
        self.two = rows[0][1] != rows[0][2]
        self.label = np.unique([r[5] for r in self.rows], return_inverse=True)[1]

    def open(self, i: int) -> np.ndarray:
        """Larger rows of other components that sizes and bitmaps leave open, the likeliest first."""
        end = int(np.searchsorted(self.size, self.size[i] * self.bands.den // self.bands.num, side="right"))
        j = np.arange(i + 1, end)
        j = j[(self.label[j] != self.label[i]) & ((self.block[j] != self.block[i]) if self.two else True)]
        if not len(j):
            return j
        differ = np.bitwise_count(self.maps[j] ^ self.maps[i]).sum(axis=1, dtype=np.int64)
        total = self.size[i] + self.size[j]
        common = (total - differ) // 2
        some = self.bands.den * common >= self.bands.num * (total - common)
        return j[some][np.argsort(differ[some] / total[some], kind="stable")]

    def merge(self, i: int, j: int) -> None:
        self.label[self.label == self.label[j]] = self.label[i]

    def candidates(self) -> list[tuple]:
        """One open pair for each component that a component may take in: fewer than there are rows."""
        pairs = []
        for i in range(len(self.rows)):
            near = self.open(i)
            while len(near):
                pairs.append((self.rows[i][4], self.rows[near[0]][4]))
                self.merge(i, near[0])
                near = near[self.label[near] != self.label[i]]
        return pairs

    def undecided(self) -> list[tuple]:
        """Rows with an open pair, in groups between which no pair is open.

        A group's number, in place of the tile's, tells its rows: many tiles leave the same group."""
        group = np.arange(len(self.rows))
        for i in range(len(self.rows)):
            near = self.open(i)
            if len(near):
                group[np.isin(group, group[near])] = group[i]
        out = []
        order = np.argsort(group, kind="stable")
        for places in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
            if len(places) > 1:
                rows = [self.rows[i] for i in places]
                low, high = rows[0][1:3] if self.two else (0, 0)
                rows = [(low, high, r[3] if self.two else 0, *r[4:]) for r in rows]
                digest = hashlib.md5(repr(sorted((repr(r[3]), r[:3], r[5], r[6]) for r in rows)).encode()).digest()
                out += [(int.from_bytes(digest[:8], "little", signed=True), *r) for r in rows]
        return out

    def links(self) -> list[tuple]:
        """Pairs that do link, by their sorted sets, as many as join all components that are linked here."""
        pairs, sets = [], {}
        hashes = lambda i: sets.setdefault(i, np.frombuffer(self.rows[i][8], np.uint64))
        for i in range(len(self.rows)):
            near = self.open(i)
            while len(near):
                j, near = near[0], near[1:]
                common = len(np.intersect1d(hashes(i), hashes(j), assume_unique=True))
                if self.bands.linked(common, int(self.size[i]), int(self.size[j])):
                    pairs.append((self.rows[i][4], self.rows[j][4]))
                    self.merge(i, j)
                    near = near[self.label[near] != self.label[i]]
        return pairs


def _by_tile(rows: DataFrame, bands: Bands, step: Callable[[Tile], list[tuple]], out: StructType) -> DataFrame:
    """What ``step`` makes of the rows of each tile and pair of blocks."""
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(f.dataType) for f in out.fields]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        result = step(Tile(rows, bands)) if rows else []
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in result], t) for k, t in enumerate(kinds)], out.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if held and held[0][:3] != row[:3]:
                    yield made(held)
                    held = []
                held.append(row)
        yield made(held)

    dealt = rows.repartition(shuffle_parts(rows.sparkSession), "tile", "low", "high").sortWithinPartitions("tile", "low", "high")
    return dealt.mapInArrow(run, out)


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _likely(rows: DataFrame, bands: Bands) -> DataFrame:
    """Pairs that would join the components of a group if they link, as far as sizes and bitmaps tell."""
    kind = rows.schema["id"].dataType
    return _ordered(_by_tile(rows, bands, Tile.candidates, StructType([StructField("a", kind), StructField("b", kind)])))


def _undecided(torn: DataFrame, bands: Bands) -> tuple[DataFrame, int]:
    """The rows of ``torn`` that sizes and bitmaps leave open, in groups that each stand there once, and how many they are."""
    return materialize(_by_tile(torn, bands, Tile.undecided, torn.schema).distinct(), "ngram-join")


def _decided(rows: DataFrame, n: int, docs: DataFrame, words: int, bands: Bands) -> DataFrame:
    """Links among the ``n`` rows that are still open, decided by the sets themselves within their groups."""
    kind = rows.schema["id"].dataType
    sets = _sets(docs, rows, n, words)
    rows = rows.join(sets, F.col("id") == F.col("doc_id")).where(F.length("hashes") == 8 * F.col("n_shingles")).drop("doc_id")
    return _ordered(_by_tile(rows, bands, Tile.links, StructType([StructField("a", kind), StructField("b", kind)])))


def _folded(raw: bytes, width: int) -> np.ndarray:
    x = np.frombuffer(raw, np.uint8)
    while len(x) > width:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x.view("<u8")


def ngram_join(docs: DataFrame, words: int = 5, threshold: tuple[int, int] = (80, 100)) -> DataFrame:
    """Groups of documents linked by the Jaccard likeness of their word shingles, exactly.

    Two documents link if the intersection of their sets of ``words``-word shingles
    is at least ``threshold`` of the union. Returns one row per row of ``docs``:
    ``doc_id``, ``n_shingles`` and ``component_id``, the smallest ``doc_id`` that is
    reachable by links, itself included.

    Texts are lower-cased (A-Z) and cut at blanks. A text of fewer words is one
    shingle; null and empty texts and texts without words have none and link with
    nothing. Rows that share a ``doc_id`` are one document with the links of all
    of them. Rows with a null id link with nothing and have a null component.
    Other columns are ignored; an empty table gives no rows.
    """
    prepare(docs.sparkSession)
    docs, bands = docs.select("doc_id", "text"), Bands(*threshold)
    profiles, _ = materialize(_profiles(docs, words, bands), "ngram-join")
    members, _ = materialize(_members(_tiles(docs, words, bands)), "ngram-join")
    pairs = members.where(F.col("id") != F.col("first")).select(F.least("id", "first").alias("a"), F.greatest("id", "first").alias("b")).distinct()
    copies, leads = _copies(profiles)
    leads, _ = materialize(leads, "ngram-join")
    pairs, _ = materialize(_between_leads(pairs, copies), "ngram-join")
    equal = copies.where(F.col("doc_id") != F.col("lead")).select(F.col("lead").alias("a"), F.col("doc_id").alias("b"))
    links, _ = materialize(_verified(pairs, profiles, docs, words, bands).union(equal), "ngram-join")
    found, _ = materialize(components(links, "a", "b"), "ngram-join")
    left, n = _undecided(_torn(members.where("tile IS NOT NULL"), leads, found, profiles), bands)
    if n:
        likely, _ = materialize(_likely(left, bands), "ngram-join")
        more, _ = materialize(_verified(likely, profiles, docs, words, bands), "ngram-join")
        links = links.union(more)
        found, _ = materialize(components(links, "a", "b"), "ngram-join")
        joined = left.drop("c").join(found, F.col("id") == F.col("node"), "left").withColumn("c", F.coalesce("component", "id"))
        left, n = _undecided(joined.select(*left.columns), bands)
        if n:
            last, _ = materialize(_decided(left, n, docs, words, bands), "ngram-join")
            found, _ = materialize(components(links.union(last), "a", "b"), "ngram-join")
    return profiles.join(found, F.col("doc_id") == F.col("node"), "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")
    )
