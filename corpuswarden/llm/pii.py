"""Personal data by weak supervision.

Several labelers vote on each candidate span: its form, a checksum, gazetteers,
the words before it, its surroundings. Expectation-maximisation over the votes
of all candidates estimates how reliable each labeler is and how likely each
pattern of votes is personal data. A logistic classifier over votes and span
features is trained on these soft labels and decides on every span. Spans of
the four base kinds are kept whatever it decides.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType,
)

from corpuswarden.llm.common import ROW, map_texts, prepare

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "name", "iban", "ssn")
LABELERS = ("form", "checksum", "gazetteer", "context", "counter", "edges")

# Patterns of the base kinds and of the further kinds.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_ZONE = re.compile(r"[0-9+][0-9 .()+\-]*")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NATIONAL = re.compile(r"(?<![0-9+])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_NAME = re.compile(r"(?<![^\W_])([A-Z][a-z]+)(?= (?:[A-Z]\. )?([A-Z][a-z]+)(?![^\W_]))")
# Gazetteers.
GIVEN_NAMES = frozenset(
    "Ahmed Alexander Alice Andrew Anna Anthony Barbara Carlos Catherine Charles Daniel David Dorothy Edward Elena "
    "Elizabeth Emily Emma Fatima Francisco Frank George Hans Helen Henry James Jennifer Jessica John Jose Joseph Juan "
    "Karen Klaus Laura Linda Lisa Lucas Margaret Maria Marie Mark Mary Matthew Michael Mohammed Nancy Olivia Patricia "
    "Paul Peter Pierre Richard Robert Sarah Sofia Sophie Susan Thomas William Wolfgang Yuki".split()
)
TOP_DOMAINS = frozenset("com org net edu gov io de fr es uk eu it nl pl ru jp cn br in info biz".split())
# Words that go before personal data, and words before numbers of another kind.
CUES = {
    "email": ("email", "e-mail", "mail", "contact", "correo"),
    "ip": ("ip", "address", "host", "server", "from"),
    "card": ("card", "visa", "credit", "karte", "tarjeta", "carte"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "whatsapp"),
    "name": ("name", "mr", "mrs", "ms", "dr", "dear", "by", "contact"),
    "iban": ("iban", "account", "bank", "konto"),
    "ssn": ("ssn", "social", "security"),
}
COUNTER_CUES = frozenset("version v isbn doi order invoice section figure table release id sha commit hash token password".split())
_WORDS = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base kinds by kind, then start: leftmost, not overlapping per kind,
    matches that fail their test dropped.

    Each kind is searched only where its characters stand together, in one pass
    without backtracking over long runs."""
    found: dict[str, list] = {k: [] for k in BASE}
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at) if start < at else None
        if match:
            found["email"].append(("email", start, match.end()))
            done = match.end()
        at = text.find("@", max(at + 1, done))
    for zone in _ZONE.finditer(text):
        low, high = zone.span()
        if high - low < 7:
            continue
        for dotted in _DOTTED.finditer(text, low, high):
            parts = dotted.group().split(".")
            place = dotted.start()
            for i in range(0, len(parts) - 3, 4):
                # a first part belongs to no other match, so groups of four follow one another
                size = sum(map(len, parts[i : i + 4])) + 3
                if all(len(p) <= 3 and int(p or "0") <= 255 for p in (p.lstrip("0") for p in parts[i : i + 4])):
                    found["ip"].append(("ip", place, place + size))
                place += size + 1
        for match in _CARD.finditer(text, low, high):
            digits = match.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found["card"].append(("card", *match.span()))
        for match in _PHONE.finditer(text, low, high):
            if 8 <= sum(c.isdigit() for c in match.group()) <= 15:
                found["phone"].append(("phone", *match.span()))
    return [s for kind in BASE for s in found[kind]]


def candidates(text: str) -> list[tuple[str, int, int, bool]]:
    """Base spans and further candidates, which do not overlap those; by kind, then start."""
    base = base_spans(text)
    out = [(*s, True) for s in base]
    taken: list[tuple[int, int]] = []  # disjoint, in order
    for s, e in sorted((s, e) for _, s, e in base):
        if taken and s < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(e, taken[-1][1]))
        else:
            taken.append((s, e))

    def offer(kind: str, start: int, end: int) -> None:
        at = bisect.bisect_left(taken, (start, end))
        if (at and start < taken[at - 1][1]) or (at < len(taken) and taken[at][0] < end):
            return
        out.append((kind, start, end, False))
        taken.insert(at, (start, end))

    for zone in _ZONE.finditer(text):
        low, high = zone.span()
        if high - low < 10:
            continue
        for match in _SSN.finditer(text, low, high):
            offer("ssn", *match.span())
        for match in _CARD.finditer(text, low, high):
            if 16 <= sum(c.isdigit() for c in match.group()) <= 19:
                offer("card", *match.span())
    for match in _NATIONAL.finditer(text):
        offer("phone", *match.span())
    for match in _IBAN.finditer(text):
        offer("iban", *match.span())
    for match in _NAME.finditer(text):
        if match[1] in GIVEN_NAMES:
            offer("name", match.start(1), match.end(2))
    return sorted(out, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def votes(text: str, kind: str, start: int, end: int, base: bool) -> tuple[int, ...]:
    """One vote per labeler: 1 personal data, -1 not, 0 no opinion."""
    span = text[start:end]
    before = [w.lower() for w in _WORDS.findall(text[max(0, start - 40) : start])[-3:]]
    digits = "".join(c for c in span if c.isdigit())
    form = 1 if base or kind == "iban" else 0
    check = 0
    if kind == "card":
        check = 1 if luhn(digits) else -1
    elif kind == "iban":
        packed = span.replace(" ", "")
        number = "".join(str(int(c, 36)) for c in packed[4:] + packed[:4])
        check = 1 if int(number) % 97 == 1 else -1
    elif kind == "ssn":
        check = -1 if digits[:3] in ("000", "666") or digits[0] == "9" or "00" == digits[3:5] or digits[5:] == "0000" else 1
    elif kind == "ip":
        check = 1 if all(p == "0" or p[0] != "0" for p in span.split(".")) else -1
    gazetteer = 0
    if kind == "email":
        gazetteer = 1 if span.rsplit(".", 1)[1].lower() in TOP_DOMAINS else -1
    elif kind == "name":
        gazetteer = 1
    elif kind == "card":
        gazetteer = 1 if digits[0] in "3456" else -1
    elif kind == "phone":
        gazetteer = 1 if span[0] == "+" and span[1] != "0" else 0
    context = 1 if any(w in CUES[kind] for w in before) else 0
    counter = -1 if any(w in COUNTER_CUES for w in before) and not context else 0
    left, right = text[start - 1 : start], text[end : end + 1]
    edges = -1 if (left.isalnum() or right.isalnum() or left in ("=", "#", "$", "/")) else 1
    return form, check, gazetteer, context, counter, edges


def pattern(text: str, kind: str, start: int, end: int, base: bool) -> str:
    """Kind, votes and span features as a short text: all the classifier sees of a span."""
    mark = {1: "+", 0: "0", -1: "-"}
    size, digits = end - start, sum(c.isdigit() for c in text[start:end])
    tenth = min(9, 10 * digits // size)
    return f"{kind}|{''.join(mark[v] for v in votes(text, kind, start, end, base))}|{min(9, size.bit_length())}{tenth}"


def _matrix(patterns: list[str]) -> np.ndarray:
    return np.array([[{"+": 1, "0": 0, "-": -1}[c] for c in p.split("|")[1]] for p in patterns], int).reshape(-1, len(LABELERS))


def estimate(patterns: list[str], counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation for two classes over labelers with three answers.

    Returns each pattern's probability of class 1 and the labelers' answer
    tables ``[class, labeler, answer]``. Starts from the majority of votes."""
    answers = _matrix(patterns)
    posterior = 1 / (1 + np.exp(-1.0 * answers.sum(axis=1)))
    table = np.full((2, len(LABELERS), 3), 1 / 3)
    for _ in range(rounds):
        for c, weight in enumerate((counts * (1 - posterior), counts * posterior)):
            for k in range(len(LABELERS)):
                seen = np.bincount(answers[:, k] + 1, weights=weight, minlength=3)
                # one vote of each answer before any is seen, a few more on the side the answer means
                prior = np.array([1.0, 1.0, 4.0] if c else [4.0, 1.0, 1.0])
                table[c, k] = (seen + prior) / (seen + prior).sum()
        share = (counts * posterior).sum() + 1
        odds = np.log(share / (counts.sum() - share + 2))
        for k in range(len(LABELERS)):
            odds = odds + np.log(table[1, k, answers[:, k] + 1]) - np.log(table[0, k, answers[:, k] + 1])
        posterior = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return posterior, table


def _features(patterns: list[str]) -> np.ndarray:
    """One-hot kinds, votes as answers, length and digit share."""
    rows = []
    for p in patterns:
        kind, _, shape = p.split("|")
        rows.append([1.0, *(float(kind == k) for k in KINDS), int(shape[0]) / 9, int(shape[1]) / 9])
    answers = _matrix(patterns)
    return np.hstack([np.array(rows).reshape(-1, len(KINDS) + 3), answers == 1, answers == -1]).astype(float)


@dataclass
class PiiModel:
    """Probability of personal data for a pattern, and the labelers' estimated answers."""

    weights: np.ndarray
    reliabilities: np.ndarray
    known: dict[str, float]

    def probability(self, pattern: str) -> float:
        if pattern not in self.known:
            self.known[pattern] = float(1 / (1 + np.exp(-_features([pattern])[0] @ self.weights)))
        return self.known[pattern]


def train(patterns: list[str], counts: np.ndarray, steps: int = 25) -> PiiModel:
    """Logistic classifier on the soft labels, by Newton steps with a small ridge."""
    x = _features(patterns)
    weights = np.zeros(x.shape[1])
    soft, table = estimate(patterns, counts)
    scale = counts / max(1.0, counts.sum())
    for _ in range(steps if len(patterns) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        gradient = x.T @ (scale * (p - soft)) + 1e-4 * weights
        curve = (x * (scale * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(x.shape[1])
        weights = weights - np.linalg.solve(curve, gradient)
    return PiiModel(weights, table, {})


def fit(docs: DataFrame) -> PiiModel:
    """Train on the candidates of all texts.

    Tasks count patterns; what reaches the driver is one row per distinct
    pattern, of which there are at most kinds times answers times shapes,
    however many texts there are. Without candidates the model accepts none."""
    def make() -> Callable[[list[str]], list]:
        def work(texts: list[str]) -> list:
            return [[list(Counter(pattern(t, *c) for c in candidates(t)).items()) for t in texts]]

        return work

    counted = ArrayType(StructType([StructField("pattern", StringType()), StructField("n", LongType())]))
    rows = map_texts(docs, make, [StructField("found", counted)])
    total = rows.select(F.inline("found")).groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect()
    return train([r["pattern"] for r in total], np.array([r["n"] for r in total], float))


SPANS = ArrayType(
    StructType(
        [
            StructField("kind", StringType()),
            StructField("start", IntegerType()),
            StructField("end", IntegerType()),
            StructField("base", BooleanType()),
            StructField("probability", DoubleType()),
        ]
    )
)


def find_pii(docs: DataFrame, model: PiiModel | None = None, least: float = 0.5, carry: bool = False, mask: bool = False) -> DataFrame:
    """Spans of personal data in every text: ``doc_id`` and ``spans``, by kind, then start.

    A span has ``kind``, ``start`` and ``end`` (code points, end exclusive),
    ``base`` and the classifier's ``probability``; others than base spans need at
    least ``least`` of it. Without a ``model`` one is trained on the same
    documents first. With ``mask``, ``masked_text`` has ``[KIND]`` in place of
    each span. With ``carry`` the input row follows as ``_row``.

    Null and empty texts have no spans (and a null text stays null when masked).
    Repeated rows get a row each, other columns are ignored, an empty table
    gives no rows.
    """
    prepare(docs.sparkSession)
    model = model or fit(docs)
    weights = model.weights, model.reliabilities  # a bounded number of values
    fields = [StructField("spans", SPANS)] + ([StructField("masked_text", StringType())] if mask else [])

    def make() -> Callable[[list[str]], list]:
        own = PiiModel(*weights, {})

        def spans_of(text: str) -> list[dict]:
            out = []
            for kind, start, end, base in candidates(text):
                p = own.probability(pattern(text, kind, start, end, base))
                if base or p >= least:
                    out.append({"kind": kind, "start": start, "end": end, "base": base, "probability": p})
            return out

        def work(texts: list[str]) -> list:
            spans = [spans_of(t) for t in texts]
            return [spans, [masked(t, s) for t, s in zip(texts, spans)]] if mask else [spans]

        return work

    return map_texts(docs, make, fields, carry)


def masked(text: str, spans: list[dict]) -> str:
    """The text with ``[KIND]`` for each span; overlapping spans are masked as one, named by the first."""
    out, last = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if s["start"] >= last:
            out += [text[last : s["start"]], f"[{s['kind'].upper()}]"]
        last = max(last, s["end"])
    return "".join(out) + text[last:]


def mask_pii(docs: DataFrame, model: PiiModel | None = None) -> DataFrame:
    """The rows of ``docs`` with personal data masked in their texts; null texts stay null."""
    found = find_pii(docs, model, carry=True, mask=True)
    text = F.when(F.size("spans") > 0, F.col("masked_text")).otherwise(F.col(f"{ROW}.text"))
    return found.select(*[(text if c == "text" else F.col(f"{ROW}.`{c}`")).alias(c) for c in docs.columns])
