"""Operators on ordered and two-sided evidence against plain code."""

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tallyframe.operators import sequences as sq
from tallyframe.plans import sequence_queries

SF = "/root/testdata/sf0.001"


def plain_peel(at, gap, most):
    """(n, outliers, lo, hi) by taking the ends off a list, one group at a time."""
    left, all_ = sorted(at), len(at)
    while len(left) > 1:
        widest = max(b - a for a, b in zip(left, left[1:], strict=False))
        i = max(k for k in range(1, len(left)) if left[k] - left[k - 1] == widest)
        small, big = (left[:i], left[i:]) if i <= len(left) - i else (left[i:], left[:i])
        if widest < gap or len(small) > most:
            break
        left = big
    return all_, all_ - len(left), left[0], left[-1]


def test_clusters(spark):
    rnd = random.Random(11)
    units = {u: [rnd.choice((0, 0, 0, 1, 2, 5)) * 100 + rnd.randint(0, 12) for _ in range(rnd.randint(1, 14))] for u in range(120)}
    units |= {200: [7], 201: [5, 5, 5], 202: [0, 50], 203: [0, 50, 100], 204: [0, 1, 2, 3, 60, 61, 62, 63]}
    rows = [(u, a) for u, at in units.items() for a in at] + [(3, None), (300, None)]
    df = spark.createDataFrame(rows, "u long, a long")
    got = {r.u: (r.n, r.outliers, r.lo, r.hi) for r in sq.clusters(df, "u", "a", 50, 3).collect()}
    assert got == {u: plain_peel(at, 50, 3) for u, at in units.items()}
    assert any(v[1] > 3 for v in got.values()), "more than one group is peeled somewhere"
    assert sq.clusters(df.where("false"), "u", "a").count() == 0


def plain_verdict(ours, theirs):
    no = {c: n for c, n, _, _ in sq.CODES}
    twin = {c: t for c, _, t, _ in sq.CODES if t}
    group = {c: g for c, _, _, g in sq.CODES}
    a, b = ours - theirs, theirs - ours
    if not a and not b:
        return None
    delta, balanced, flips = sum(a.values()) + sum(b.values()), sum(a.values()) == sum(b.values()), 0
    for c in list(a):
        k = min(a[c], b[no[c]])
        a[c], b[no[c]], flips = a[c] - k, b[no[c]] - k, flips + k
    a, b = +a, +b
    ga, gb = {group[c] for c in a}, {group[c] for c in b}
    crossed = ("EQ" in ga and "ORD" in gb) or ("ORD" in ga and "EQ" in gb)
    signed = any(b.get(twin.get(c)) == n for c, n in a.items())
    return "SIGNED" if signed else "OPERATOR" if crossed else "POLARITY", flips, delta, balanced


def test_branch_codes(spark):
    rnd = random.Random(12)
    names = [c for c, *_ in sq.CODES]
    few = [rnd.sample(names, rnd.randint(1, 5)) for _ in range(250)]
    rows = [(u, rnd.choice(few[u]), rnd.random() < 0.5) for u in range(250) for _ in range(rnd.randint(1, 8))] + [(900, None, True), (901, "call", False)]
    sides = defaultdict(lambda: (Counter(), Counter()))
    for u, c, ours in rows:
        if c in names:
            sides[u][0 if ours else 1][c] += 1
    want = {u: v for u, s in sides.items() if (v := plain_verdict(*s))}
    got = sq.branch_codes(spark.createDataFrame(rows, "u long, c string, ours boolean"), "u", "c", F.col("ours")).collect()
    assert {r.u: (r.kind, r.flips, r.delta, r.balanced) for r in got} == want
    assert {v[0] for v in want.values()} == {"SIGNED", "OPERATOR", "POLARITY"}


def test_aligned(spark):
    df = spark.createDataFrame([(1, ["a", "b"], ["a", "b"]), (2, ["a", "b", "c"], ["a", "x", "y", "c"]), (3, [], ["a"]), (4, None, ["a", "b"]), (5, ["a"], None), (6, ["a", "b"], ["b", "a"])], "id long, l array<string>, r array<string>")
    got = {r.id: (r.residual, r.chunks) for r in sq.aligned(df, ["id"], "l", "r").collect()}
    assert got == {1: (0, 0), 2: (2, 1), 3: (1, 1), 4: (2, 1), 5: (1, 1), 6: (2, 2)}
    kinds = {r.id: r.k for r in df.select("id", sq.residual_class(F.col("l"), F.col("r"), lambda x: F.lit("r")).alias("k")).collect()}
    assert [kinds[i] for i in (1, 2, 3, 6)] == ["none", "length", "length", "schedule"]
    assert sq.aligned(df.where("false"), ["id"], "l", "r").count() == 0


def test_residual_query(spark):
    rows = sorted((r.conv_id, r.turn, (r.text or "").split(" ")) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect())
    want = {}
    for (conv, turn, a), (other, _, b) in zip(rows, rows[1:], strict=False):
        if conv == other:
            want[conv, turn] = sq.residual([w for w in a if w], [w for w in b if w])
    got = sequence_queries.difflib_residual(spark, SF).collect()
    assert len(got) == len(want) and {(r.conv_id, r.turn): (r.residual, r.chunks) for r in got} == want


def test_loops_and_caches(spark):
    code = [(1, 10, None, "mov"), (1, 12, None, "call"), (1, 14, 10, "jl"), (1, 16, 11, "jl"), (1, 18, 20, "jmp"), (1, 20, 20, "jmp"), (1, 22, 14, "jne"), (2, 10, None, "mov")]
    got = sq.loops(spark.createDataFrame(code, "u long, a long, t long, op string"), "u", "a", "t", F.col("op") == "call").collect()
    assert sorted(tuple(r) for r in got) == [(1, 1, 3, 2, 1), (1, 3, 7, 4, 0)]
    cache = spark.createDataFrame([(1, "x", "old"), (2, "y", "old"), (9, "z", "old")], "k long, h string, v string")
    now = spark.createDataFrame([(1, "x"), (2, "Y"), (3, "z"), (4, None)], "k long, h string")
    got = {r.k: (r.v, r.reused) for r in sq.refreshed(cache, now, ["k"], "h", "v", F.lit("new")).collect()}
    assert got == {1: ("old", True), 2: ("new", False), 3: ("new", False), 4: ("new", False)}
