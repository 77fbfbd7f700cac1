"""Alignment against brute force, and classes of residuals against plain code."""

import random

import numpy as np

from tallyframe.operators import alignment as al


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for k, y in enumerate(b):
            new.append(row[k] + 1 if x == y else max(row[k + 1], new[-1]))
        row = new
    return row[-1]


def brute_count(a, b):
    """How many places are matched: the longest chain of anchors, and the same in each gap."""
    both = [(a.index(t), b.index(t)) for t in a if a.count(t) == 1 and b.count(t) == 1]
    if not both:
        return brute_lcs(a, b)
    chain = [both[k] for k in al.rising([y for _, y in both])]
    assert len(chain) == brute_lcs([y for _, y in both], sorted(y for _, y in both))
    ends = [(-1, -1), *chain, (len(a), len(b))]
    return len(chain) + sum(brute_count(a[p + 1 : q], b[r + 1 : s]) for (p, r), (q, s) in zip(ends, ends[1:]))


def random_pair(rnd, n, kinds):
    a = [rnd.randrange(kinds) for _ in range(n)]
    b = list(a)
    for _ in range(rnd.randrange(1 + n // 4)):
        k = rnd.randrange(len(b) + 1)
        b[k : k + rnd.randrange(3)] = [rnd.randrange(kinds) for _ in range(rnd.randrange(3))]
    if rnd.random() < 0.4 and n > 4:
        i, j = sorted(rnd.sample(range(len(b) + 1), 2)) if len(b) > 1 else (0, 0)
        b = b[j:] + b[i:j] + b[:i]
    return a, b


def check(a, b, found):
    assert all(a[i] == b[j] for i, j in found) and all(p < q and r < s for (p, r), (q, s) in zip(found, found[1:]))


def test_matches_against_brute_force():
    rnd = random.Random(1)
    for _ in range(400):
        a, b = random_pair(rnd, rnd.randrange(30), rnd.choice([1, 2, 5, 40]))
        found = al.common(np.array(a), np.array(b))
        check(a, b, found)
        assert len(found) == brute_lcs(a, b)
        found = al.match(np.array(a), np.array(b))
        check(a, b, found)
        assert len(found) == brute_count(a, b)


def test_long_pairs_are_aligned_as_short_ones(spark):
    rnd = random.Random(2)
    pairs = {k: random_pair(rnd, rnd.choice([0, 1, 5, 30, 120]), rnd.choice([1, 3, 20, 200])) for k in range(40)}
    pairs[90], pairs[91], pairs[92] = ([], []), ([1, 2], []), (list(range(300)), [x for x in range(300) if x % 7][::-1])
    df = spark.createDataFrame([(k, a, b) for k, (a, b) in pairs.items()] + [(99, None, [1])], "k long, a array<long>, b array<long>")
    tokens = al.spread(df, ["k"], "a", "b")
    got = {}
    for short in (0, 10**6):
        rows = al.matches(tokens, ["k"], short).collect()
        got[short] = sorted((r.k, r.i, r.j) for r in rows)
    assert got[0] == got[10**6]
    for k, (a, b) in pairs.items():
        check(a, b, [(i, j) for key, i, j in got[0] if key == k])
        assert sum(key == k for key, _, _ in got[0]) == brute_count(a, b)


def test_chunks_and_residuals(spark):
    df = spark.createDataFrame([(1, "a b c d e".split(), "a x c e f g".split()), (2, ["q"], ["q"]), (3, [], ["z"]), (4, None, None)], "k long, a array<string>, b array<string>")
    sizes = df.selectExpr("k", "coalesce(size(a), 0) n", "coalesce(size(b), 0) m").selectExpr("k", "greatest(n, 0) n", "greatest(m, 0) m")
    found = al.chunks(al.matches(al.spread(df, ["k"], "a", "b"), ["k"]), sizes, ["k"])
    assert sorted(map(tuple, found.collect())) == [(1, 1, 2, 1, 2), (1, 3, 4, 3, 3), (1, 5, 5, 4, 6), (3, 0, 0, 0, 1)]
    assert sorted(map(tuple, al.residuals(found, sizes, ["k"]).collect())) == [(1, 4, 3), (2, 0, 0), (3, 1, 1), (4, 0, 0)]


CASES = {
    "none": (["push eax", "ret"], ["push eax", "ret"]),
    "schedule": (["inc eax", "dec ebx", "ret"], ["dec ebx", "inc eax", "ret"]),
    "regname": (["mov eax,[esi+0x4]", "ret"], ["mov ecx,[edi+0x4]", "ret"]),
    "arm-copy": (["ret"], ["mov eax,ebx", "ret"]),
    "extra-copy": (["mov eax,ebx", "ret"], ["ret"]),
    "dup-store": (["mov DWORD PTR [esi+0x4],eax", "inc eax", "mov DWORD PTR [esi+0x4],eax", "ret"], ["mov DWORD PTR [esi+0x4],eax", "inc eax", "ret"]),
    "extra-store": (["mov [esi+0x8],eax", "ret"], ["ret"]),
    "missing-store": (["ret"], ["mov [esi+0x8],eax", "ret"]),
    "immediate": (["push 0x10", "ret"], ["push 0x20", "ret"]),
    "displacement": (["mov eax,[esi+0x4]", "ret"], ["mov eax,[esi+0x8]", "ret"]),
    "subobject": (["lea ecx,[esi+0x20]", "mov eax,[ecx]", "mov ebx,[ecx+0x4]"], ["lea ecx,[esi+0x20]", "mov eax,[esi+0x20]", "mov ebx,[esi+0x24]"]),
    "referent": (["call X|f", "ret"], ["call X|g", "ret"]),
    "selection": (["add eax,ebx", "ret"], ["sub eax,ebx", "ret"]),
    "operand": (["call X|f", "inc eax", "call X|f", "call X|g"], ["call X|f", "inc eax", "call X|g", "call X|g"]),
}


def test_residual_classes(spark):
    df = spark.createDataFrame([(k, a, b) for k, (a, b) in CASES.items()], "k string, a array<string>, b array<string>")
    tokens = al.spread(df, ["k"], "a", "b")
    sizes = df.selectExpr("k", "size(a) n", "size(b) m")
    got = al.residual_classes(tokens, al.matches(tokens, ["k"]), sizes, ["k"]).collect()
    assert {r.k: r["class"] for r in got} == {k: k for k in CASES}
    assert {r.k: r.deficit for r in got if r.deficit} == {"arm-copy": 1, "extra-copy": -1, "dup-store": -1, "extra-store": -1, "missing-store": 1}


def test_turns_and_orders(spark):
    from tallyframe.plans import catalog

    sf = "/root/testdata/sf0.001"
    rows = catalog.QUERIES["alignment_residual"](spark, sf).collect()
    want = catalog.QUERIES["difflib_residual"](spark, sf).collect()
    assert sorted((r.conv_id, r.turn) for r in rows) == sorted((r.conv_id, r.turn) for r in want)
    assert all(abs(r.n - r.m) <= r.residual <= r.n + r.m for r in rows)
    kinds = {r["class"] for r in catalog.QUERIES["instruction_residuals"](spark, sf).collect()}
    assert len(kinds) > 5 and kinds <= set(CASES)


def test_short_pairs_go_to_python_in_batches(spark, capsys):
    """Not a call and a table for each pair; what shares no token needs none."""
    df = spark.createDataFrame([(k, [f"a{k}", "x", "y"], ["x", f"b{k}", "y"]) for k in range(50)] + [(60, ["p"], ["q"]), (61, ["p"], [])], "k long, a array<string>, b array<string>")
    found = al.matches(al.spread(df, ["k"], "a", "b"), ["k"])
    assert sorted(map(tuple, found.collect())) == sorted(x for k in range(50) for x in ((k, 1, 0), (k, 2, 2)))
    capsys.readouterr()
    found.explain()
    plan = capsys.readouterr().out
    assert "MapInArrow" in plan and "FlatMapGroupsInArrow" not in plan


def test_few_are_counted_as_many(monkeypatch):
    rnd = random.Random(7)
    for _ in range(200):
        a, b = random_pair(rnd, rnd.randrange(50), rnd.choice([1, 2, 4, 30]))
        got = {}
        for few in (0, 10**6):
            monkeypatch.setattr(al, "FEW", few)
            got[few] = al.match(a, b), al.common(a, b)
        assert got[0] == got[10**6]
