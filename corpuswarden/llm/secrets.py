"""Secret scans: three fixed forms, and tokens that pass for random.

Every long token is put to a battery of randomness tests over the alphabet of
the encoding it seems to be in: chi-squared uniformity over its symbols and over
their classes, the number of runs above and below the middle of the alphabet, and serial
correlation of neighbours. Their p-values are combined by Fisher's method.

A token is reported if ordinary words rarely look as random. What is ordinary
comes from the corpus itself: the scores of all tokens of letters only, by
length, since a short word passes for random more easily than a long one. In
each band of lengths the Benjamini-Hochberg rule keeps the expected share of
words among the reported tokens below a limit.

All of it is Spark SQL expressions; the driver sees one histogram of fixed size.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuswarden.llm.common import prepare
from corpuswarden.session import materialize

# The base forms.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: The same, where the first letter is looked at before the words are tried.
ASSIGN_FAST = "(?=[psatPSAT])" + ASSIGN
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}"

# Encodings by the tokens they can produce, and their alphabets in order of value.
_DIGITS, _LOW, _UP = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = (
    ("hex", "^[0-9a-f]+$", _DIGITS + "abcdef"),
    ("hex_upper", "^[0-9A-F]+$", _DIGITS + "ABCDEF"),
    ("base32", "^[A-Z2-7]+$", _UP + "234567"),
    ("base36", "^[0-9a-z]+$", _DIGITS + _LOW),
    ("base36_upper", "^[0-9A-Z]+$", _DIGITS + _UP),
    ("base62", "^[0-9A-Za-z]+$", _DIGITS + _UP + _LOW),
    ("base64_url", "^[0-9A-Za-z_-]+$", _UP + _LOW + _DIGITS + "-_"),
    ("base64", "^.*$", _UP + _LOW + _DIGITS + "+/-_"),
)
WORD = "^[A-Z]?[a-z]+$|^[A-Z]+$"
CLASSES = ("0-9", "a-z", "A-Z", r"+/_\-")
TESTS = ("p_uniform", "p_classes", "p_runs", "p_serial")
#: A match with its place.
HIT = "struct<start:int,end:int,hit:string>"
#: Least lengths of the bands.
BANDS = (16, 20, 28, 40, 64)
#: Width and number of the histogram's steps of -log10 of the combined p-value.
STEP, STEPS = 0.02, 1_000


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is told once for the row, however often and in whatever lambda the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _starts(text: Column, pattern: str) -> Column:
    """Matches of a pattern as structs ``start``, ``end``, ``hit``: leftmost, not overlapping.

    ``split`` gives the stretches between the matches; running sums of both
    lengths are the places. They are summed in blocks of about the square root
    of their number, so that many matches in a text cost little more. The text is
    searched once, and cut once where there is a match."""
    empty = f"array<{HIT}>"

    def pairs(hits: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), 1, F.size(hits))
        return F.zip_with(hits, gaps, lambda h, g: F.struct(F.length(g).alias("gap"), F.length(h).alias("size"), h.alias("hit")))

    def within(block: Column, base: Column) -> Column:
        return F.aggregate(
            block,
            F.struct(base.alias("at"), F.array().cast(empty).alias("out")),
            lambda a, p: F.struct(
                (a["at"] + p["gap"] + p["size"]).alias("at"),
                F.array_append(
                    a["out"],
                    F.struct(
                        (a["at"] + p["gap"]).alias("start"), (a["at"] + p["gap"] + p["size"]).alias("end"), p["hit"].alias("hit")
                    ),
                ).alias("out"),
            ),
        )["out"]

    def blocks(all_pairs: Column) -> Column:
        side = F.ceil(F.sqrt(F.size(all_pairs))).cast("int")
        return F.transform(F.sequence(F.lit(0), side - 1), lambda b: F.slice(all_pairs, b * side + 1, side))

    def joined(all_blocks: Column) -> Column:
        size = lambda block: F.aggregate(block, F.lit(0), lambda a, p: a + p["gap"] + p["size"])
        ends = F.aggregate(
            F.transform(all_blocks, size), F.array(F.lit(0)), lambda a, n: F.array_append(a, F.element_at(a, -1) + n)
        )
        return F.flatten(F.zip_with(all_blocks, F.slice(ends, 1, F.size(all_blocks)), within))

    def found(hits: Column) -> Column:
        return F.when(F.size(hits) > 0, _once(pairs(hits), lambda p: _once(blocks(p), joined))).otherwise(F.array().cast(empty))

    return _once(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), found)


def _base(text: Column, tokens: Column) -> Column:
    """Base spans as structs ``start``, ``kind`` (place in KINDS), ``end``, in this order.

    Forms of letters and digits only, 16 or more, lie within the matches of TOKEN in
    the same text, which are as long as they can be; they are searched there."""
    empty = F.array().cast("array<struct<start:int,kind:int,end:int>>")

    def span(kind: int, base: Column | int = 0) -> Callable[[Column], Column]:
        return lambda m: F.struct((base + m["start"]).alias("start"), F.lit(kind).alias("kind"), (base + m["end"]).alias("end"))

    def inside(kind: int, pattern: str, some: Callable[[Column], Column]) -> Column:
        long = F.filter(tokens, lambda t: some(t["hit"]))
        return F.flatten(F.transform(long, lambda t: F.transform(_starts(t["hit"], pattern), span(kind, t["start"]))))

    assign = F.filter(_starts(text, ASSIGN_FAST), lambda m: F.length(F.regexp_extract(m["hit"], ASSIGN, 2)) >= 6)
    parts = [
        F.transform(assign, span(KINDS.index("assign"))),
        # a token without the four letters needs no search
        inside(KINDS.index("access"), ACCESS, lambda hit: F.contains(hit, F.lit("AKIA"))),
        inside(KINDS.index("hex"), HEX, lambda hit: hit.rlike(HEX)),
    ]
    return F.array_sort(F.concat(empty, *parts))


def _two_sided(z: Column) -> Column:
    """Probability of a standard normal value as far from 0 (a rational approximation)."""
    x = F.least(F.abs(z), F.lit(12.0)) / math.sqrt(2)
    t = 1 / (1 + 0.5 * x)
    # Coefficients of the approximation, highest power first.
    total = F.lit(0.17087277)
    for c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
        total = total * t + c
    return t * F.exp(-x * x + total)


def _chi_tail(x: Column, freedom: Column) -> Column:
    """Probability of a chi-squared value of ``x`` or more (cube-root approximation)."""
    part = 2 / (9 * freedom)
    z = (F.cbrt(F.greatest(x, F.lit(0.0)) / freedom) - (1 - part)) / F.sqrt(part)
    return F.when(z > 0, _two_sided(z) / 2).otherwise(1 - _two_sided(z) / 2)


def battery(tokens: DataFrame) -> DataFrame:
    """Adds to rows with a ``token`` its ``encoding``, the p-values of ``TESTS``, and ``score``: -log10 of their combination, low where the token looks random."""
    core, n = F.rtrim(F.col("token"), F.lit("=")), F.col("_n")
    chain, alphabet = None, None
    for name, form, symbols in ENCODINGS:
        chain = F.when(F.col("_core").rlike(form), F.lit(name)) if chain is None else chain.when(F.col("_core").rlike(form), F.lit(name))
        alphabet = (
            F.when(F.col("encoding") == name, F.lit(symbols))
            if alphabet is None
            else alphabet.when(F.col("encoding") == name, F.lit(symbols))
        )
    rows = tokens.withColumn("_core", core).withColumn("encoding", chain).withColumn("_alphabet", alphabet)
    rows = rows.withColumn("_n", F.length("_core").cast("double")).withColumn("_a", F.length("_alphabet").cast("double"))
    rows = rows.withColumn(
        "_v", F.transform(F.split("_core", ""), lambda c: (F.instr(F.col("_alphabet"), c) - 1).cast("double"))
    )
    square = lambda seen: seen.cast("double") * seen.cast("double")
    squares = F.aggregate(
        F.array_distinct("_v"), F.lit(0.0), lambda a, s: a + square(F.size(F.filter("_v", lambda v: v == s)))
    )
    rows = rows.withColumn("p_uniform", _chi_tail(squares * F.col("_a") / n - n, F.col("_a") - 1))
    # the kinds of symbols that the alphabet has, each with its share of it
    x, kinds = -n, F.lit(-1.0)
    for symbols in CLASSES:
        size = F.length(F.regexp_replace("_alphabet", f"[^{symbols}]", "")).cast("double")
        seen = F.length(F.regexp_replace("_core", f"[^{symbols}]", "")).cast("double")
        x = x + F.when(size > 0, seen * seen * F.col("_a") / (n * size)).otherwise(0.0)
        kinds = kinds + F.when(size > 0, 1.0).otherwise(0.0)
    rows = rows.withColumn("_x", x).withColumn("_kinds", kinds)
    rows = rows.withColumn("p_classes", _chi_tail(F.col("_x"), F.col("_kinds")))
    half = F.col("_a") / 2
    rows = rows.withColumn("_sides", F.array_join(F.transform("_v", lambda v: F.when(v < half, F.lit("a")).otherwise(F.lit("b"))), ""))
    rows = rows.withColumn("_below", F.length(F.regexp_replace("_sides", "b", "")).cast("double"))
    rows = rows.withColumn("_runs", F.regexp_count("_sides", F.lit("a+|b+")))
    both = 2 * F.col("_below") * (n - F.col("_below"))
    spread = both * (both - n) / (n * n * (n - 1))
    rows = rows.withColumn(
        "p_runs",
        F.when(both == 0, F.pow(F.lit(2.0), 1 - n)).when(spread <= 0, F.lit(1.0)).otherwise(
            _two_sided((F.col("_runs") - 1 - both / n) / F.sqrt(spread))
        ),
    )
    middle, variance = (F.col("_a") - 1) / 2, (F.col("_a") * F.col("_a") - 1) / 12
    last = F.size("_v") - 1
    products = F.zip_with(
        F.slice("_v", F.lit(1), last), F.slice("_v", F.lit(2), last), lambda a, b: (a - middle) * (b - middle)
    )
    rows = rows.withColumn("_s", F.aggregate(products, F.lit(0.0), lambda a, p: a + p))
    rows = rows.withColumn("p_serial", _two_sided(F.col("_s") / (variance * F.sqrt(n - 1))))
    logs = F.lit(0.0)
    for p in TESTS:
        logs = logs - F.log(F.greatest(p, F.lit(1e-30)))
    rows = rows.withColumn("_f", logs)
    f = F.col("_f")
    # four p-values: a chi-squared value with eight degrees of freedom, tail in closed form
    score = (f - F.log(1 + f + f * f / 2 + f * f * f / 6)) / math.log(10)
    return rows.withColumn("score", score).drop(*[c for c in rows.columns if c.startswith("_") and c not in tokens.columns])


def _band(length: Column) -> Column:
    out = F.lit(0)
    for i, least in enumerate(BANDS):
        out = F.when(length >= least, F.lit(i)).otherwise(out)
    return out


def thresholds(histogram: list[tuple[int, bool, int, int]], share: float) -> list[float]:
    """Per band the highest score that is reported, -1 for none.

    ``histogram`` has rows (band, is a word, step, count). A token's p-value is the
    share of words with a score as low, among the words of its band and of shorter
    ones, which look more random and so err on the safe side."""
    out = []
    for band in range(len(BANDS)):
        words, tokens = [0] * (STEPS + 1), [0] * (STEPS + 1)
        for at, word, step, n in histogram:
            words[step] += n if word and at <= band else 0
            tokens[step] += n if at == band else 0
        best, w, r = -1.0, 0, 0
        total, m = sum(words), sum(tokens)
        for step in range(STEPS):
            w, r = w + words[step], r + tokens[step]
            if r and (w + 1) / (total + 1) <= share * r / m:
                best = (step + 1) * STEP
        out.append(best)
    return out


def find_secrets(docs: DataFrame, share: float = 0.05) -> DataFrame:
    """Secrets in every text: ``doc_id`` and ``spans`` by start, then kind.

    A span has ``kind``, ``start`` and ``end`` (code points, end exclusive). Kinds
    are ``assign``, ``access`` and ``hex``, the base forms, and ``random``: tokens
    of 16 symbols or more that meet no base span and of which words are expected
    to make up at most ``share``.

    Texts are read once; base spans and candidate tokens go to a table in the
    shared folder. Null and empty texts have no spans, repeated rows get a row
    each, null ids are kept, other columns are ignored, an empty table gives no
    rows. A corpus without words has nothing to compare with and reports no
    random tokens.
    """
    prepare(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    both = _once(_starts(text, TOKEN), lambda found: F.struct(_base(text, found).alias("_base"), found.alias("_tokens")))
    scanned = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", both.alias("_found")).select("_row", "doc_id", "_found._base", "_found._tokens")
    table, _ = materialize(scanned, "secrets")
    tokens = table.select("_row", "_base", F.explode("_tokens").alias("t")).select(
        "_row", "t.start", "t.end", F.col("t.hit").alias("token"), F.exists("_base", lambda b: (b["start"] < F.col("t.end")) & (F.col("t.start") < b["end"])).alias("_known")
    )
    scored, _ = materialize(
        battery(tokens).select("_row", "start", "end", "_known", "score", _band(F.length("token")).alias("band"), F.rtrim("token", F.lit("=")).rlike(WORD).alias("word")),
        "secrets",
    )
    step = F.least(F.greatest(F.floor(F.col("score") / STEP), F.lit(0)), F.lit(STEPS)).cast("int")
    counted = scored.groupBy("band", "word", step.alias("step")).count()
    # at most bands times steps rows
    limits = thresholds([tuple(r) for r in counted.collect()], share)
    limit = F.element_at(F.array(*map(F.lit, limits)), F.col("band") + 1)
    random = (
        scored.where(~F.col("_known") & (F.col("score") < limit))
        .groupBy("_row")
        .agg(F.collect_list(F.struct("start", F.lit(KINDS.index("random")).alias("kind"), "end")).alias("_random"))
        .withColumnRenamed("_row", "_of")
    )
    every = F.array_sort(F.concat("_base", F.coalesce("_random", F.slice("_base", 1, 0))))
    name = lambda s: F.struct(F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    return table.join(random, F.col("_row") == F.col("_of"), "left").select("doc_id", F.transform(every, name).alias("spans"))
