"""Base spans against plain regular expressions, the battery against its formulas, thresholds."""

import math
import random
import re
import string

import pytest
from pyspark.sql import functions as F

from corpuswarden.llm import secrets
from corpuswarden.llm.secrets import BANDS, STEP, battery, find_secrets, thresholds

PLAIN = {
    "assign": r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}


def brute(text):
    out = []
    for k, (kind, plain) in enumerate(PLAIN.items()):
        for m in re.finditer(plain, text):
            size = len(m[2]) if kind == "assign" else len(m[0])
            if size >= {"assign": 6, "access": 20, "hex": 24}[kind]:
                out.append((m.start(), k, m.end()))
    return [(list(PLAIN)[k], s, e) for s, k, e in sorted(out)]


def test_base_spans_equal_plain_expressions(spark, docs):
    rng = random.Random(6)
    parts = ["password", "PASSWD", "Secret", "token", "api_key", "APIKEY", "ſecret", "toKen", "=", ":", " ", '"', "'", "abcdef", "x1", "é", "😀",
             "AKIA", "AKIAABCDEFGH", "A" * 16, "0123456789abcdef", "deadbeef", "0" * 24, "\n", "-", "."]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(3_000)]
    texts += [None, "", ("0" * 24 + " ") * 3_000, "a" * 200_000, "password=" * 20_000]
    got = {r["doc_id"]: [tuple(s)[:3] for s in r["spans"] if s["kind"] != "random"] for r in find_secrets(docs(*texts)).collect()}
    for i, text in enumerate(texts):
        assert got[i] == brute(text or ""), text


@pytest.mark.parametrize("pattern", [secrets.ASSIGN_FAST, secrets.ACCESS, secrets.HEX, secrets.TOKEN])
def test_a_text_is_searched_once_for_a_pattern(docs, pattern):
    plan = docs("x").select(secrets._starts(F.col("text"), pattern).alias("found"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == plan.count("split(") == 1


def test_forms_inside_long_tokens_equal_plain_expressions(docs):
    rng = random.Random(8)
    parts = ["0123456789abcdef" * 2, "deadbeef" * 3, "AKIA" + "A" * 16, "AKIA", "0" * 23, "g", "Z", "_", "-", "/", "+", "=", " ", ".", "é", "😀", "token=", "Secret: '"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(1_000)]
    texts += [("0" * 24 + "-") * 2_000, ("AKIA" + "A" * 16 + "=") * 2_000]
    got = {r["doc_id"]: [tuple(s)[:3] for s in r["spans"] if s["kind"] != "random"] for r in find_secrets(docs(*texts)).collect()}
    for i, text in enumerate(texts):
        assert got[i] == brute(text), text


def chi_tail(x, freedom):
    part = 2 / (9 * freedom)
    return math.erfc(((x / freedom) ** (1 / 3) - 1 + part) / math.sqrt(2 * part)) / 2


def test_battery_follows_its_formulas(spark):
    rng = random.Random(2)
    tokens = ["".join(rng.choice("0123456789abcdef") for _ in range(n)) for n in (16, 24, 30, 50, 90)] + ["a" * 20, "thewordsinthistoken", "aB3_" * 6 + "=="]
    got = {r["token"]: r for r in battery(spark.createDataFrame([(t,) for t in tokens], "token string")).collect()}
    for token in tokens:
        core = token.rstrip("=")
        alphabet = next(a for _, form, a in secrets.ENCODINGS if re.search(form, core))
        v, n, a = [alphabet.index(c) for c in core], len(core), len(alphabet)
        x = sum((v.count(j) - n / a) ** 2 / (n / a) for j in range(a))
        uniform = chi_tail(x, a - 1)
        classes = [set(string.digits), set(string.ascii_lowercase), set(string.ascii_uppercase), set("+/-_")]
        sizes = [len(c & set(alphabet)) for c in classes]
        x = sum((sum(e in c for e in core) - n * s / a) ** 2 / (n * s / a) for c, s in zip(classes, sizes) if s)
        by_class = chi_tail(x, sum(s > 0 for s in sizes) - 1)
        below = sum(c < a / 2 for c in v)
        runs = 1 + sum((v[i] < a / 2) != (v[i + 1] < a / 2) for i in range(n - 1))
        both = 2 * below * (n - below)
        z = (runs - 1 - both / n) / math.sqrt(both * (both - n) / (n * n * (n - 1))) if both * (both - n) > 0 else 0
        p_runs = math.erfc(abs(z) / math.sqrt(2)) if both else 2.0 ** (1 - n)
        z = sum((v[i] - (a - 1) / 2) * (v[i + 1] - (a - 1) / 2) for i in range(n - 1)) / ((a * a - 1) / 12 * math.sqrt(n - 1))
        serial = math.erfc(abs(z) / math.sqrt(2))
        row = got[token]
        for name, p in (("p_uniform", uniform), ("p_classes", by_class), ("p_runs", p_runs), ("p_serial", serial)):
            assert math.isclose(row[name], p, rel_tol=1e-4, abs_tol=1e-9), (token, name, row[name], p)
        f = -sum(math.log(max(p, 1e-30)) for p in (uniform, by_class, p_runs, serial))
        assert math.isclose(row["score"], (f - math.log(1 + f + f * f / 2 + f**3 / 6)) / math.log(10), rel_tol=1e-4, abs_tol=1e-6)


def test_thresholds_keep_the_share():
    # 999 words far from random, 50 tokens that look random, in the first band
    low = thresholds([(0, True, 300, 999), (0, False, 10, 50)], 0.05)
    assert low[0] > 10 * STEP and low[0] <= 300 * STEP + 1e-9 and low[1:] == [-1.0] * (len(BANDS) - 1)
    assert thresholds([(0, False, 10, 50)], 0.05) == [-1.0] * len(BANDS)
    # longer tokens borrow the words of shorter bands
    assert thresholds([(0, True, 300, 999), (2, False, 10, 50)], 0.05)[2] > 0


def test_random_tokens_are_told_from_words(spark, clashing):
    rng = random.Random(9)
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(8, 14)))
    chars = string.ascii_letters + string.digits
    texts, planted = [], []
    for i in range(300):
        words = [word() for _ in range(20)]
        if i % 10 == 0:
            planted.append((i, "".join(rng.choice(chars) for _ in range(rng.choice([24, 32, 44])))))
            words[7] = planted[-1][1]
        texts.append(" ".join(words))
    got = {r["doc_id"]: r["spans"] for r in find_secrets(clashing(*texts)).collect()}
    hits = [(i, texts[i][s["start"] : s["end"]]) for i, spans in got.items() for s in spans if s["kind"] == "random"]
    # a token of 24 symbols may stay below what so few words can tell; longer ones may not
    long = {p for p in planted if len(p[1]) >= 32}
    assert len(set(hits) & long) >= 0.8 * len(long)
    assert len(set(hits) - set(planted)) <= 0.2 * len(hits)


def test_empty_table(docs):
    assert find_secrets(docs("x").limit(0)).count() == 0


def test_query_runs_without_python_workers(spark, tmp_path):
    from corpuswarden.llm.queries import QUERIES

    spark.createDataFrame([(1, "token = abcdef0123")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    plan = QUERIES["op1_secrets"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    for node in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"):
        assert node not in plan
