"""Repair of conversations by a shortest path through a lattice of edits.

A conversation's rows and the roles so far (nothing, ended by system, user or
assistant) span a lattice: an arc keeps, deletes or re-roles a row, or inserts
one. Distances are found with the auction algorithm: nodes have prices, never
above the price behind any arc plus its cost; a path grows from its start along
the arc that pays, shrinks where none does and raises the price there. Where it
has ended, every arc of every cheapest path is tight, so the tight arcs give the
least of the cheapest audits by following the least letter that leads home.

A conversation may be of any length. Its rows are sorted and cut in blocks of
``BLOCK``; each block gives the cost and the audit from each of four states to each
of four, and only these sums meet per conversation. As a block ends with a row,
no audit of a block begins another one, so blocks are compared one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from corpuswarden.llm.common import prepare, shuffle_parts
from corpuswarden.session import materialize

#: Rows of a block: an auction's rounds grow faster than its rows.
BLOCK = 64
SPACE = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)
#: Costs of the edits and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
FAR = 1 << 60
#: What follows a role, and the role an edit gives.
GROWS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
TURN_OF = (USER, USER, ASSISTANT, USER)
ROLE = ("", "", "user", "assistant")
#: Cost and audit from each state to the end, where no row follows.
ENDS = ((0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, ""))
LEGAL = frozenset(("su", "ua", "au"))


def damage(rows: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``text``, ``copies`` of rows after damage by the check
    sum of ``conv_id:turn``; nulls in these, in role and in text are one space."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn"))) % 20
    marked = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), name("role").alias("role"), name("text").alias("text"), fault.alias("_f"))
    text = F.when(F.col("_f") == 1, "").when(F.col("_f") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return marked.where("_f <> 0").select(
        "conv_id",
        "turn",
        F.when(F.col("_f") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"),
        F.when(F.col("_f") == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def _faults(rows: DataFrame) -> DataFrame:
    """Equal rows as one with their number, its own fault and that of its further copies.

    ``sign`` is the role's initial (``o`` if no other) and ``b``, ``d``, ``t`` or ``-``."""
    key = ["conv_id", "turn", "role", "text"]
    rows = rows.groupBy(*key).agg(F.sum("copies").alias("copies")).withColumn("digest", F.sha2("text", 256))
    same = [F.struct("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("digest").alias("_d")]
    # nulls are the first turns
    first = F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("_first")
    again = rows.groupBy(*same).agg(F.count("*").alias("_n"), first).where("_n > 1").drop("_n")
    met = (F.struct("conv_id") == F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("digest") == F.col("_d"))
    joined = rows.join(again, met, "left")
    later = F.col("_first").isNotNull() & (F.struct(F.col("turn").isNotNull().alias("col1"), "turn") != F.col("_first"))
    body = F.rtrim("text", F.lit(SPACE))
    initial = F.substring("role", 1, 1)
    own = F.when(body == "", "b").when(later, "d").when(F.substring(body, -1, 1).isin(".", "!", "?"), "-").otherwise("t")
    return joined.select(*key, "copies", "digest", F.concat(F.when(initial.isin("s", "u", "a"), initial).otherwise("o"), own).alias("sign"))


@lru_cache(maxsize=100_000)
def block_paths(signs: str) -> tuple[tuple[int, ...], tuple[str, ...]]:
    """Least cost, and least audit of that cost, from each state before the rows of a
    block to each state after them, by auction. Two characters of ``signs`` per row."""
    rows = [(signs[i], signs[i + 1]) for i in range(0, len(signs), 2)]
    n = len(rows)
    arcs: list[tuple[tuple[int, str, int], ...]] = []
    for k, (initial, fault) in enumerate(rows):
        for state in range(4):
            out = [(DELETE, "D", 4 * (k + 1) + state), (INSERT, "I", 4 * k + TURN_OF[state])]
            if fault not in "bd":
                stays = TRUNCATED * (fault == "t")
                if (state, initial) in GROWS:
                    out.append((stays, "K", 4 * (k + 1) + GROWS[state, initial]))
                out.append((stays + REROLE, "R", 4 * (k + 1) + TURN_OF[state]))
            arcs.append(tuple(out))
    # a row costs so much whatever comes of it: prices that start there are true bounds
    floor = [0] * (n + 1)
    for k in range(n - 1, -1, -1):
        floor[k] = floor[k + 1] + (0 if rows[k][1] == "-" else DELETE)
    costs, audits = [], []
    for end in range(4):
        goal = 4 * n + end
        # none but the first states lead to these two: elsewhere prices would rise for ever
        near = arcs if end > SYSTEM else [tuple(a for a in out if a[2] % 4 <= end) for out in arcs]
        prices = [floor[k // 4] for k in range(4 * n)] + [0 if s == end else FAR for s in range(4)]
        for start in range(4):
            costs.append(_auction(near, prices, start, goal) if end > SYSTEM or start <= end else FAR)
            audits.append(_least_audit(near, prices, start, goal) if costs[-1] < FAR else "")
    # from (end, start) to (start, end)
    order = [4 * end + start for start in range(4) for end in range(4)]
    return tuple(costs[i] for i in order), tuple(audits[i] for i in order)


def _auction(arcs: list, prices: list[int], start: int, goal: int) -> int:
    """Distance from start to goal; raises ``prices`` until a path of tight arcs is found."""
    path = [start]
    while (node := path[-1]) != goal:
        best, to = FAR, -1
        for cost, _, behind in arcs[node] if node < len(arcs) else ():
            if cost + prices[behind] < best:
                best, to = cost + prices[behind], behind
        if prices[node] < best or best >= FAR:
            prices[node] = best
            if len(path) > 1:
                path.pop()
            elif best >= FAR:
                return FAR
        else:
            path.append(to)
    return prices[start]


def _least_audit(arcs: list, prices: list[int], start: int, goal: int) -> str:
    """Letters of the least path of tight arcs; only one arc of a node has a letter."""
    tight = lambda node: [(letter, to) for cost, letter, to in arcs[node] if prices[node] == cost + prices[to]]
    leads, todo = {goal: True}, [start]
    while todo:
        node = todo[-1]
        if node in leads:
            todo.pop()
        elif node >= len(arcs):
            leads[node] = False
        elif new := [to for _, to in tight(node) if to not in leads]:
            todo += new
        else:
            leads[node] = any(leads[to] for _, to in tight(node))
    audit, node = [], start
    while node != goal:
        letter, node = min((letter, to) for letter, to in tight(node) if leads[to])
        audit.append(letter)
    return "".join(audit)


class Block:
    """Sums of consecutive rows of one conversation. ``at`` and ``copy`` tell its first row."""

    FIELDS = [
        *[StructField(n, LongType()) for n in ("at", "copy", "blank", "duplicate", "truncated", "illegal")],
        *[StructField(n, StringType()) for n in ("first", "last")],
        *[StructField(n, LongType()) for n in ("low", "high", "turns")],
        StructField("costs", ArrayType(LongType())),
        StructField("audits", ArrayType(StringType())),
    ]

    def __init__(self, conv, at: int, copy: int):
        self.conv, self.at, self.copy, self.signs, self.illegal = conv, at, copy, [], 0
        self.low, self.high, self.turns = None, None, 0

    def add(self, sign: str, turn: int | None) -> None:
        if self.signs and self.signs[-1][0] + sign[0] not in LEGAL:
            self.illegal += 1
        self.signs.append(sign)
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low, self.high = turn if self.low is None else self.low, turn

    def row(self) -> tuple:
        signs = "".join(self.signs)
        faults = [signs[1::2].count(f) for f in "bdt"]
        costs, audits = block_paths(signs)
        return (self.conv, self.at, self.copy, *faults, self.illegal, signs[0], signs[-2], self.low, self.high, self.turns, costs, audits)


def _batch(rows: list[tuple], schema: StructType) -> pa.RecordBatch:
    kinds = [to_arrow_type(f.dataType) for f in schema.fields]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], schema.names)


def _blocks(ordered: DataFrame, size: int) -> DataFrame:
    """Block sums of rows that are in order within each file of ``ordered``."""
    source = ordered.select("conv_id", "at", "turn", "copies", "sign")
    out = StructType([source.schema["conv_id"], *Block.FIELDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, before, done = None, None, []
        for batch in batches:
            for conv, at, turn, copies, sign in zip(*[c.to_pylist() for c in batch.columns]):
                follows = block and conv == block.conv and at == before + 1
                before, further = at, sign[0] + ("b" if sign[1] == "b" else "d")
                for copy in range(copies):
                    # numbers follow one another within a file only
                    if block and (len(block.signs) == size or not (copy or follows)):
                        done.append(block.row())
                        block = None
                    block = block or Block(conv, at, copy)
                    block.add(further if copy else sign, turn)
                    if len(done) >= 1_000:
                        yield _batch(done, out)
                        done = []
        if block:
            done.append(block.row())
        if done:
            yield _batch(done, out)

    return source.mapInArrow(run, out)


def fold(blocks: list[dict]) -> tuple[int, int, int, int, int, int, str]:
    """Figures, cost and audit of a conversation from the sums of its blocks, in order."""
    total = [sum(b[f] for b in blocks) for f in ("blank", "duplicate", "truncated", "illegal")]
    total[3] += sum(a["last"] + b["first"] not in LEGAL for a, b in zip(blocks, blocks[1:]))
    turned = [b for b in blocks if b["turns"]]
    gaps = 0
    if turned:
        shared = sum(a["high"] == b["low"] for a, b in zip(turned, turned[1:]))
        gaps = turned[-1]["high"] - turned[0]["low"] + 1 - (sum(b["turns"] for b in turned) - shared)
    costs, names = [c for c, _ in ENDS], [a for _, a in ENDS]
    ranks = [sorted(set(names)).index(a) for a in names]
    chosen = []
    for b in reversed(blocks):
        best = []
        for start in range(4):
            ways = ((b["costs"][4 * start + end] + costs[end], b["audits"][4 * start + end], ranks[end], end) for end in range(4))
            best.append(min(ways))
        costs = [min(w[0], FAR) for w in best]
        order = sorted({w[1:3] for w in best})
        ranks = [order.index(w[1:3]) for w in best]
        chosen.append(best)
    state, audit = START, []
    for best in reversed(chosen):
        audit.append(best[state][1])
        state = best[state][3]
    return (gaps, *total, costs[START], "".join(audit) + ENDS[state][1])


FIGURES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _audits(blocks: DataFrame, every: DataFrame) -> DataFrame:
    """``conv_id``, its figures and its audit, for every conversation of ``every``."""
    names = [f.name for f in Block.FIELDS]
    sums = blocks.select("conv_id", F.struct(*names).alias("b"))
    sums = sums.unionByName(every.select("conv_id").distinct(), allowMissingColumns=True)
    grouped = sums.groupBy(F.struct("conv_id").alias("k")).agg(F.array_sort(F.collect_list("b")).alias("b")).select("k.conv_id", "b")
    out = StructType([grouped.schema["conv_id"], *[StructField(n, LongType()) for n in FIGURES], StructField("audit", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _batch([(conv, *fold(b)) for conv, b in zip(*[c.to_pylist() for c in batch.columns])], out)

    return grouped.mapInArrow(run, out)


class Repair:
    """Follows an audit over the rows of a conversation; gives the rows that come of it."""

    def __init__(self, audit: str):
        self.letters, self.state = iter(audit), START

    def _turn(self) -> str:
        self.state = TURN_OF[self.state]
        return ROLE[self.state]

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        while (letter := next(self.letters)) == "I":
            yield self._turn(), ""
        if letter == "K":
            self.state = GROWS[self.state, role[:1]]
            yield role, text
        elif letter == "R":
            yield self._turn(), text

    def rest(self) -> Iterator[tuple[str, str]]:
        for _ in self.letters:
            yield self._turn(), ""


def _parts(rows: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """Damaged rows as a table in order, numbered, and the audits of their conversations."""
    prepare(rows.sparkSession)
    sort = ["conv_id", "turn", "role", "digest"]
    ranged = _faults(damage(rows)).repartitionByRange(shuffle_parts(rows.sparkSession), *sort).sortWithinPartitions(*sort)
    ordered, _ = materialize(ranged.withColumn("at", F.monotonically_increasing_id()), "conversations")
    audits, _ = materialize(_audits(_blocks(ordered, block), rows), "conversation-audits")
    return ordered, audits


def _beside(ordered: DataFrame, audits: DataFrame, rows: list[str]) -> DataFrame:
    """Each conversation's audit before its rows, in one partition; read as a stream."""
    head = audits.select("conv_id", F.lit(-1).cast("long").alias("at"), F.struct(*FIGURES, "audit").alias("head"))
    both = head.unionByName(ordered.select("conv_id", "at", *rows), allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "at")


def audit_conversations(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Damage, faults and cheapest repair of each conversation: ``conv_id``, ``gaps``, ``blank``,
    ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit``, ``repaired_sha256``.

    Every ``conv_id`` of ``rows`` (``conv_id``, ``turn``, ``role``, ``text``) has one row, null too;
    without rows after damage it has zeros, an empty audit and the sum of no text.
    Rows follow by turn, null first; of one turn by role, then the digest of their
    text, equal rows side by side. Nulls in role and text are one space. Texts
    may be of any length, an empty table gives no row, other columns are ignored.

    A digest over a whole conversation is one sequence of steps: its rows pass
    through one task, a batch at a time.
    """
    ordered, audits = _parts(rows, block)
    source = _beside(ordered, audits, ["role", "text", "copies"])
    out = StructType([audits.schema["conv_id"], *audits.schema.fields[1:], StructField("repaired_sha256", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, head, repair, digest, empty, done = None, None, None, None, True, []

        def put(lines: Iterator[tuple[str, str]]) -> None:
            nonlocal empty
            for role, text in lines:
                digest.update(f"{'' if empty else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
                empty = False

        def end() -> None:
            if head is not None:
                put(repair.rest())
                done.append((conv, *head.values(), digest.hexdigest()))

        for batch in batches:
            for conv_id, at, top, role, text, copies in zip(*[c.to_pylist() for c in batch.columns]):
                if at < 0:
                    end()
                    conv, head, repair, digest, empty = conv_id, top, Repair(top["audit"]), hashlib.sha256(), True
                else:
                    for _ in range(copies):
                        put(repair.row(role, text))
            if done:
                yield _batch(done, out)
                done = []
        end()
        if done:
            yield _batch(done, out)

    return source.mapInArrow(run, out)


def repair_conversations(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """The repaired rows: ``conv_id``, ``position`` (from 0), ``turn`` (null where inserted), ``role``, ``text``."""
    ordered, audits = _parts(rows, block)
    source = _beside(ordered, audits, ["turn", "role", "text", "copies"])
    out = StructType([audits.schema["conv_id"], *[StructField(n, LongType()) for n in ("position", "turn")], *[StructField(n, StringType()) for n in ("role", "text")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, repair, position, done = None, None, 0, []

        def put(lines: Iterator[tuple[str, str]], turn: int | None, own: bool) -> None:
            nonlocal position
            made = list(lines)
            for i, (role, text) in enumerate(made):
                done.append((conv, position, turn if own and i == len(made) - 1 else None, role, text))
                position += 1

        for batch in batches:
            for conv_id, at, top, turn, role, text, copies in zip(*[c.to_pylist() for c in batch.columns]):
                if at < 0:
                    if repair:
                        put(repair.rest(), None, False)
                    conv, repair, position = conv_id, Repair(top["audit"]), 0
                else:
                    for _ in range(copies):
                        put(repair.row(role, text), turn, True)
            if done:
                yield _batch(done, out)
                done = []
        if repair:
            put(repair.rest(), None, False)
        if done:
            yield _batch(done, out)

    return source.mapInArrow(run, out)
