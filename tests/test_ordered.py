"""Block-wise scans and distributed positions against plain loops."""

import random

from pyspark.sql import functions as F

from corpuswarden.functions.ordered import Order, ordinal_in_group, positions, running_last, running_sum, top_k
from corpuswarden.operators import sequence


def hot_rows(n=400):
    """One key holds two thirds of the rows; some positions are skipped, one key is null."""
    rng = random.Random(3)
    rows, at = [], {}
    for _ in range(n):
        key = "hot" if rng.random() < 0.66 else rng.choice(["a", "b", None])
        at[key] = at.get(key, 0) + rng.choice([1, 1, 2, 9])
        rows.append((key, at[key], rng.choice([None, None, None, rng.randrange(50)])))
    return rows


def test_running_last_and_sum_over_many_blocks(frame):
    data = hot_rows()
    df = frame("k string, n long, v int", *data)
    want_last, want_sum = {}, {}
    last, total = {}, {}
    for k, n, v in sorted(data, key=lambda r: (str(r[0]), r[1])):
        last[k] = v if v is not None else last.get(k)
        total[k] = total.get(k, 0) + (v or 0)
        want_last[k, n], want_sum[k, n] = last[k], total[k]
    out = running_last(df, ["k"], "n", F.col("v"), "got", block=7)
    assert {(r.k, r.n): r.got for r in out.collect()} == want_last
    out = running_sum(df, ["k"], "n", F.coalesce("v", F.lit(0)), "got", block=7)
    assert {(r.k, r.n): r.got for r in out.collect()} == want_sum


def test_ordinal_in_group(frame):
    data = hot_rows(200)
    out = ordinal_in_group(frame("k string, n long, v int", *data), ["k"], "n", "got", block=5)
    seen, want = {}, {}
    for k, n, _ in sorted(data, key=lambda r: (str(r[0]), r[1])):
        seen[k] = seen.get(k, 0) + 1
        want[k, n] = seen[k]
    assert {(r.k, r.n): r.got for r in out.collect()} == want


def test_positions_over_all_and_per_group(frame):
    data = [(i, g, v) for i, (g, _, v) in enumerate(hot_rows(300))]
    df = frame("i int, g string, v int", *data)
    out = positions(df, [Order(F.col("v"), nulls_last=True), F.col("i")])
    ranked = sorted(data, key=lambda r: (r[2] is None, r[2] or 0, r[0]))
    assert {r.i: r.position for r in out.collect()} == {r[0]: n for n, r in enumerate(ranked, 1)}
    out = positions(df, [Order(F.col("v"), descending=True, nulls_last=True), F.col("i")], ["g"], "p")
    want = {}
    for g in {r[1] for r in data}:
        mine = sorted((r for r in data if r[1] == g), key=lambda r: (r[2] is None, -(r[2] or 0), r[0]))
        want.update({r[0]: n for n, r in enumerate(mine, 1)})
    assert {r.i: r.p for r in out.collect()} == want


def test_top_k_limits_groups_before_the_shuffle(frame, spark):
    df = frame("g string, v int", *[("hot", i) for i in range(50)], ("b", 1))
    out = top_k(df, ["g"], [F.col("v").desc()], 3)
    assert sorted((r.g, r.v) for r in out.collect()) == [("b", 1), ("hot", 47), ("hot", 48), ("hot", 49)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_fence_toggles_and_an_open_one_runs_to_the_end(frame, rows):
    lines = frame(
        "d int, line_no long, line string",
        (1, 1, "a"), (1, 2, "```"), (1, 3, "b"), (1, 4, "~~~"), (1, 5, "c"), (1, 6, "  ```py"), (1, 7, "d"), (2, 1, "e"),
    )
    got = rows(sequence.fence_mask(lines, ["d"]), "d", "line_no", "fenced")
    assert [f for *_, f in got] == [False, True, True, True, False, True, True, False]


def test_section_is_closed_by_an_unknown_heading(frame, rows):
    lines = frame(
        "d int, line_no long, line string",
        (1, 1, "x"), (1, 2, "## Ledger"), (1, 3, "y"), (1, 4, "## Other"), (1, 5, "z"),
    )
    section = F.when(F.col("line") == "## Ledger", "ledger").when(F.col("line").startswith("## "), "-")
    got = rows(sequence.section_of_line(lines, ["d"], "line_no", section), "line_no", "section")
    assert got == [(1, None), (2, "ledger"), (3, "ledger"), (4, "-"), (5, "-")]


def test_repeated_headings_are_numbered(frame, rows):
    heads = frame("d int, line_no long, h string", (1, 1, "Same"), (1, 5, "same"), (1, 9, "Same!"), (1, 10, "same-1"), (2, 1, "Same"))
    got = rows(sequence.slug_dedupe(heads, ["d"], "line_no", "h"), "d", "line_no", "anchor")
    assert got == [(1, 1, "same"), (1, 10, "same-1"), (1, 5, "same-1"), (1, 9, "same-2"), (2, 1, "same")]


def test_header_must_be_among_the_first_lines(frame, rows):
    lines = frame("d int, line_no long, line string", (1, 12, "**Nav**: x"), (2, 13, "**Nav**: x"), (3, 1, "see **Nav**: x"))
    got = sequence.header_in_first_n(lines, ["d"], "line_no", F.col("line").rlike(r"^\*\*Nav\*\*:"))
    assert rows(got) == [(2,), (3,)]


def test_nearest_definition_encloses(frame, rows):
    lines = frame("f string, n long, d string, hit boolean", ("a", 1, None, True), ("a", 2, "f", False), ("a", 3, None, True), ("a", 4, "g", True), ("b", 1, None, True))
    got = sequence.enclosing_scope(lines, ["f"], "n", F.col("d"), F.col("hit"))
    assert rows(got, "f", "n", "scope") == [("a", 1, None), ("a", 3, "f"), ("a", 4, "g"), ("b", 1, None)]


def test_ranks_over_a_table_shuffle_its_rows_once(spark, frame, rows):
    df = spark.range(0, 5_000, 1, 7).select(F.col("id"), ((F.col("id") * 7919) % 5_003).alias("k"), F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g"))
    ranked = positions(df, [F.col("k")])
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "rangepartitioning" not in plan
    got = ranked.orderBy("k").select("position").collect()
    assert [r[0] for r in got] == list(range(1, 5_001))
    grouped = positions(df, [Order(F.col("k"), descending=True)], ["g"])
    expected = {}
    for i, k, g in sorted(rows(df), key=lambda r: -r[1]):
        expected.setdefault(g, []).append(i)
    assert {(r.g, r.position): r.id for r in grouped.collect()} == {(g, n): i for g, ids in expected.items() for n, i in enumerate(ids, 1)}


def inheritance(frame, bases, members):
    owners = sorted({o for o, *_ in bases} | {o for o, *_ in members})
    return sequence.first_definition_wins(
        frame("owner string", *[(o,) for o in owners]),
        frame("owner string, base string, pos int, private boolean", *bases),
        frame("owner string, member string, pos int", *members),
    )


def test_own_members_come_first_then_bases_left_to_right_depth_first(frame, rows):
    bases = [("C", "_L", 0, True), ("C", "_R", 1, True), ("_L", "_T", 0, True), ("C", "Pub", 2, False)]
    members = [("C", "m", 0), ("_L", "m", 0), ("_T", "x", 0), ("_R", "x", 0), ("_R", "y", 1), ("Pub", "z", 0)]
    got = [r for r in rows(inheritance(frame, bases, members)) if r[0] == "C"]
    assert got == [("C", "m", "C", 0), ("C", "x", "_T", 2), ("C", "y", "_R", 1)]


def test_loops_and_diamonds_end_without_repeats(frame, rows):
    bases = [
        ("A", "A", 0, True), ("P", "Q", 0, True), ("Q", "P", 0, True),
        ("D", "_B", 0, True), ("D", "_C", 1, True), ("_B", "_Top", 0, True), ("_C", "_Top", 0, True),
    ]
    members = [("A", "a", 0), ("P", "p", 0), ("Q", "q", 0), ("_Top", "t", 0), ("_C", "t", 0)]
    got = rows(inheritance(frame, bases, members))
    assert ("A", "a", "A", 0) in got and ("P", "q", "Q", 1) in got and ("Q", "p", "P", 1) in got
    assert [r for r in got if r[0] == "D"] == [("D", "t", "_Top", 2)]


def test_inheritance_equals_a_depth_first_walk(frame, rows):
    rng = random.Random(6)
    names = [f"c{k}" for k in range(14)]
    bases = [(o, b, i, rng.random() < 0.9) for o in names for i, b in enumerate(rng.sample(names, rng.choice([0, 1, 1, 2, 3])))]
    members = [(o, m, i) for o in names for i, m in enumerate(rng.sample("pqrstu", rng.choice([0, 1, 2])))]

    def walk(at, path, seen, found):
        seen.add(at)
        for o, m, _ in members:
            if o == at:
                found.setdefault(m, (at, len(path)))
        for o, b, i, private in sorted(bases, key=lambda x: x[2]):
            if o == at and private and b not in seen:
                walk(b, [*path, i], seen, found)
        return found

    expected = sorted((o, m, *w) for o in names for m, w in walk(o, [], set(), {}).items())
    assert sorted(rows(inheritance(frame, bases, members), "owner", "member", "from_class", "depth")) == expected


def test_known_classes_are_asked_for_when_they_have_doubled(frame, rows, monkeypatch):
    asked = []
    plain = sequence.Stages.all
    monkeypatch.setattr(sequence.Stages, "all", lambda self: asked.append(1) or plain(self))
    # a ladder of diamonds 16 classes deep, bases before owners: 16 rounds asked for all of them
    bases = [(f"c{k:02}", f"c{k - step:02}", i, True) for k in range(17) for i, step in enumerate((1, 2)) if k >= step]
    got = rows(inheritance(frame, bases, [(f"c{k:02}", "m" if k % 3 else f"m{k}", 0) for k in range(17)]))
    assert len(asked) <= 6
    depth = {(o, m): d for o, m, _, d in got}
    assert depth["c16", "m0"] == 16 and depth["c16", "m"] == 0 and depth["c15", "m"] == 1 and len(got) == len(depth)


def test_orders_are_what_they_say(frame, rows):
    df = frame("n string, s int", ("b", 1), ("A", 2), ("a", 3), ("C", 4))
    got = sequence.canonical_order(df, "n", ["C", "a"], ["s"])
    assert [r.n for r in got.orderBy("position").collect()] == ["C", "a", "b", "A"]
    got = sequence.stable_name_order(df, "n", ["s"])
    assert [r.n for r in got.orderBy("code_position").collect()] == ["A", "C", "a", "b"]
    assert [r.n for r in got.orderBy("folded_position").collect()] == ["A", "a", "b", "C"]
    ratios = frame("k int, r double", (1, None), (2, 5000.0), (3, 10.0))
    assert [r.k for r in sequence.worst_first(ratios, F.col("r"), ["k"]).orderBy("position").collect()] == [3, 2, 1]
