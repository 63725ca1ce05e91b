"""Licence texts in documents by patience alignment.

Pairs of neighbouring words that occur in a template mark where it may stand. There,
words that occur once in the passage and once in the template are anchors; the
longest increasing run of them is kept, and the gaps between are aligned
in the same way. Gaps without such words are aligned by their longest common blocks.
Standard licences are looked for where a phrase stands that tells them from their
siblings, and are aligned on both sides of it.
"""

from __future__ import annotations

import bisect
import functools
from collections.abc import Callable, Sequence
from difflib import SequenceMatcher

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from corpuswarden.llm.common import MARKS, map_texts, mix64, word_hashes
from corpuswarden.llm.license_texts import SENTENCES, standard

#: Least share of a template's words that a passage has, and least share of a passage's
#: words that are the template's.
COVERAGE, DENSITY = 0.8, 0.7

#: Notices that name their licence; the query scans for all of ``license_texts.standard``.
TEMPLATES = SENTENCES
SPANS = ArrayType(
    StructType(
        [
            StructField("license", StringType()),
            StructField("start", IntegerType()),
            StructField("end", IntegerType()),
            StructField("coverage", DoubleType()),
        ]
    )
)


def increasing(values: Sequence[int]) -> list[int]:
    """Places of a longest strictly increasing subsequence, by piles as in the card game."""
    tops, at, before = [], [], []
    for i, v in enumerate(values):
        k = bisect.bisect_left(tops, v)
        before.append(at[k - 1] if k else -1)
        tops[k : k + 1] = [v]
        at[k : k + 1] = [i]
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def align(a: Sequence[int], b: Sequence[int]) -> list[tuple[int, int]]:
    """Places of equal words in both sequences, rising in each."""
    out: list[tuple[int, int]] = []
    open_gaps = [(0, len(a), 0, len(b))]
    while open_gaps:
        a0, a1, b0, b1 = open_gaps.pop()
        if a0 >= a1 or b0 >= b1:
            continue
        once_a, once_b = _once(a, a0, a1), _once(b, b0, b1)
        common = sorted((once_a[w], once_b[w]) for w in once_a.keys() & once_b.keys())
        anchors = [common[i] for i in increasing([q for _, q in common])]
        if not anchors:
            for block in SequenceMatcher(None, a[a0:a1], b[b0:b1], autojunk=False).get_matching_blocks():
                out += [(a0 + block.a + i, b0 + block.b + i) for i in range(block.size)]
            continue
        out += anchors
        edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        open_gaps += [(p + 1, x, q + 1, y) for (p, q), (x, y) in zip(edges, edges[1:])]
    return sorted(out)


def _once(words: Sequence[int], start: int, end: int) -> dict[int, int]:
    seen: dict[int, int] = {}
    for i in range(start, end):
        seen[words[i]] = -1 if words[i] in seen else i
    return {w: i for w, i in seen.items() if i >= 0}


def densest(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The run of pairs with the greatest sum of 1 for each less half of the words left out on either side."""
    best, run, begin, found = 0.0, 0.0, 0, (0, 0)
    for i, (x, y) in enumerate(pairs):
        left_out = x - pairs[i - 1][0] + y - pairs[i - 1][1] - 2 if i else 0
        if i == 0 or run - left_out / 2 <= 0:
            run, begin = 0.0, i
        else:
            run -= left_out / 2
        run += 1
        if run > best:
            best, found = run, (begin, i + 1)
    return pairs[found[0] : found[1]]


def _pair_hashes(words: np.ndarray) -> np.ndarray:
    return mix64(words[:-1]) + words[1:] if len(words) > 1 else np.empty(0, np.uint64)


class Templates:
    """Templates as word numbers, with the places of their word pairs, or of their keys if they have any."""

    def __init__(self, templates: Sequence[tuple]):
        self.names = [t[0] for t in templates]
        self.words = [word_hashes(t[1] or "", MARKS) for t in templates]
        self.lists = [w.tolist() for w in self.words]
        self.known_words = [np.unique(w) for w in self.words]
        # pair, or word of a template of one word: (template, place, words of the key or 0)
        self.seeds: dict[int, list[tuple[int, int, int]]] = {}
        self.single = False
        for k, words in enumerate(self.words):
            pairs = (_pair_hashes(words) if len(words) > 1 else words).tolist()
            keys = [word_hashes(key, MARKS).tolist() for key in (templates[k][2] if len(templates[k]) > 2 else ())]
            self.single |= len(words) == 1 or any(len(key) == 1 for key in keys)
            for key in keys:
                at = [i for i in range(len(words) - len(key) + 1) if self.lists[k][i : i + len(key)] == key]
                if not key or not at:
                    raise ValueError(f"a key of {self.names[k]} is not in its text")
                for i in at:
                    self.seeds.setdefault(pairs[i] if len(key) > 1 else key[0], []).append((k, i, len(key)))
            if not keys:
                for i, pair in enumerate(pairs):
                    self.seeds.setdefault(pair, []).append((k, i, 0))
        self.known = np.array(sorted(self.seeds), np.uint64)

    def scan(self, words: np.ndarray, coverage: float, density: float) -> list[tuple[str, int, int, float]]:
        """Passages (licence, start, end, coverage) by words, none overlapping; the best first choice wins."""
        starts: dict[int, list[int]] = {}
        keyed: dict[int, list[tuple[int, int, int]]] = {}
        for hashes in (_pair_hashes(words), *([words] if self.single else [])):
            for p in np.flatnonzero(np.isin(hashes, self.known)).tolist():
                for k, i, size in self.seeds[int(hashes[p])]:
                    if not size:
                        starts.setdefault(k, []).append(p - i)
                    elif words[p : p + size].tolist() == self.lists[k][i : i + size]:
                        keyed.setdefault(k, []).append((p, i, size))
        found = []

        def add(k: int, low: int, pairs: list[tuple[int, int]]) -> None:
            template = self.lists[k]
            if pairs and len(pairs) >= coverage * len(template) and len(pairs) >= density * (pairs[-1][0] - pairs[0][0] + 1):
                found.append((-len(pairs), -len(pairs) / len(template), low + pairs[0][0], low + pairs[-1][0] + 1, self.names[k]))

        for k, guesses in starts.items():
            template = self.lists[k]
            slack, margin = len(template) // 4, len(template) // 2
            guesses.sort()
            group = [guesses[0]]
            for g in [*guesses[1:], None]:
                if g is not None and g - group[0] <= slack:
                    group.append(g)
                    continue
                low, high = max(0, group[0] - margin), min(len(words), group[-1] + len(template) + margin)
                add(k, low, densest(align(words[low:high].tolist(), template)))
                group = [g]
        for k, hits in keyed.items():
            template, margin, done = self.lists[k], len(self.lists[k]) // 2, set()
            for p, i, size in sorted(hits):
                low, high = max(0, p - i - margin), min(len(words), p - i + len(template) + margin)
                # no passage where fewer of the template's words stand than it needs
                if (p, i) in done or np.count_nonzero(np.isin(words[low:high], self.known_words[k])) < coverage * len(template):
                    continue
                pairs = densest([(x - low, y) for x, y in self._around(words, k, p, i, size, low, high)])
                done.update((low + x, y) for x, y in pairs)
                if {(p - low + j, i + j) for j in range(size)} <= set(pairs):
                    add(k, low, pairs)
        chosen: list[tuple[str, int, int, float]] = []
        for _, share, start, end, name in sorted(set(found)):
            at = bisect.bisect(chosen, start, key=lambda c: c[1])
            if (at and chosen[at - 1][2] > start) or (at < len(chosen) and chosen[at][1] < end):
                continue
            chosen.insert(at, (name, start, end, -share))
        return chosen

    def _around(self, words: np.ndarray, k: int, p: int, i: int, size: int, low: int, high: int) -> list[tuple[int, int]]:
        """Alignment of the words from ``low`` to ``high`` in which the key at ``p`` stands at ``i`` of the template."""
        template = self.lists[k]
        left = align(words[low:p].tolist(), template[:i])
        right = align(words[p + size : high].tolist(), template[i + size :])
        return [*((low + x, y) for x, y in left), *((p + j, i + j) for j in range(size)), *((p + size + x, i + size + y) for x, y in right)]


@functools.lru_cache(maxsize=2)
def _kept(templates: tuple) -> Templates:
    """A Python worker keeps its templates from task to task."""
    return Templates(templates)


def scan_licenses(
    docs: DataFrame,
    templates: Sequence[tuple] | None = None,
    coverage: float = COVERAGE,
    density: float = DENSITY,
    carry: bool = False,
) -> DataFrame:
    """``doc_id``, ``n_words`` and ``spans``: the licence passages of every whole text, in order.

    A span has ``license``, ``start`` and ``end`` (words, end exclusive) and
    ``coverage``, the share of the template's words found in order. Words are runs
    of letters and digits (and of all characters beyond ASCII), A-Z lower-cased. Of
    overlapping passages the one with more words found stays, then the one of greater
    coverage, then the earlier, then the one first by name. ``templates`` (all of
    ``license_texts.standard`` unless given) are broadcast with the code: a few hundred
    KB, not a table that grows. Of a template with keys, phrases as its third item, one
    must stand in the passage unbroken.

    Null and empty texts have no words and no spans, like a null or empty template.
    Repeated rows get a row each; other columns are ignored, or follow as struct
    ``_row`` with ``carry``; an empty table gives no rows."""
    templates = tuple(map(tuple, standard() if templates is None else templates))

    def make() -> Callable[[list[str]], list]:
        own = _kept(templates)

        def work(texts: list[str]) -> list:
            words = [word_hashes(t, MARKS) for t in texts]
            names = ("license", "start", "end", "coverage")
            return [[len(w) for w in words], [[dict(zip(names, s)) for s in own.scan(w, coverage, density)] for w in words]]

        return work

    return map_texts(docs, make, [StructField("n_words", LongType()), StructField("spans", SPANS)], carry)
