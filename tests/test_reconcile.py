"""Reconciliation of symbols and slots against plain code."""

import collections
import random

from tallyframe.operators import reconcile


def plain_classes(symbols, refs):
    cls = {i: (c,) for i, c in symbols.items()}
    while True:
        names = {k: n for n, k in enumerate(sorted(set(cls.values()), key=repr))}
        new = {i: (names[cls[i]], tuple(sorted(collections.Counter((s, names[cls[t]] if t in cls else ("outside", t)) for a, s, t in refs if a == i).items(), key=repr))) for i in cls}
        if len(set(new.values())) == len(names):
            return {i: min(j for j in cls if cls[j] == cls[i]) for i in cls}
        cls = new


def test_refinement_against_plain_code(spark):
    rnd = random.Random(4)
    for n, few in ((1, 1), (30, 2), (60, 1), (80, 3)):
        symbols = {i: f"c{rnd.randrange(few)}" for i in range(n)}
        refs = [(rnd.randrange(n), rnd.choice("xy"), rnd.randrange(n + 3)) for _ in range(n)] + [(i, "n", i + 1) for i in range(n - 20, n - 1) if i > 0]
        df = spark.createDataFrame(list(symbols.items()), "id long, content string")
        got, rounds = reconcile.refine(df, spark.createDataFrame(refs, "id long, slot string, to long"), ["content"])
        assert {r.id: r["class"] for r in got.collect()} == plain_classes(symbols, refs)
        assert rounds <= n


def test_circles_of_equals_are_one_class(spark):
    symbols = spark.createDataFrame([(i, "same", f"n{i % 2}", i // 2) for i in range(6)], "id long, content string, name string, addr long")
    ring = spark.createDataFrame([(i, "next", (i + 1) % 6) for i in range(6)], "id long, slot string, to long")
    got, rounds = reconcile.refine(symbols, ring, ["content"])
    assert {r["class"] for r in got.collect()} == {0} and rounds == 0
    assert [tuple(r) for r in reconcile.conflicts(got).collect()] == [("ALIAS", "0", 1, 6)]
    # One reference less tells all of them apart, by how far they are from it.
    got, rounds = reconcile.refine(symbols, ring.where("id < 5"), ["content"])
    assert len({r["class"] for r in got.collect()}) == 6 and rounds == 5
    kinds = collections.Counter(r.kind for r in reconcile.conflicts(got).collect())
    assert kinds == {"NAME": 2, "ADDRESS": 3}


def test_audit(spark):
    ours = [("u", "f", 4, True), ("u", "f", 4, False), ("u", "_g", 0, True), ("u", "h", 0, True), ("u", "?no", 0, True), ("u", "?lib", 0, True), ("u", "unknown", 0, True), ("u", "multi", 0, True), ("v", "multi", 0, True), ("w", "thunk", 0, True)]
    names = [("f", 16), ("g", 32), ("_h", 48), ("multi", 64), ("multi", 80), ("thunk", 100)]
    actual = [("u", 16), ("u", 20), ("u", 32), ("u", 80), ("u", 99), ("u", 99), ("w", 104)]
    df = spark.createDataFrame
    got = reconcile.audit(df(ours, "unit string, name string, addend long, relative boolean"), df(actual, "unit string, addr long"), df(names, "name string, addr long"), df([("?lib",)], "name string"), df([(100, 101), (101, 104), (7, 7)], "node long, next long"))
    want = [("u", "WRONG", "h", 48, 1), ("u", "MISSING", None, 99, 2), ("u", "FAKE", "?no", None, 1), ("v", "WRONG", "multi", 64, 1)]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_bound_slots_against_plain_code(spark):
    rnd = random.Random(9)
    for n in (1, 12, 70):
        bases = [(i, i - 1) for i in range(1, n) if rnd.random() < 0.95] + [(rnd.randrange(n), rnd.randrange(n)) for _ in range(n // 6)] + [(0, None)]
        own = [(rnd.randrange(n), rnd.randrange(4), f"s{rnd.randrange(9)}") for _ in range(n // 3 + 1)]
        want = {}
        for c in range(n):
            depth, todo = {c: 0}, collections.deque([c])
            while todo:
                x = todo.popleft()
                for a, b in bases:
                    if a == x and b is not None and b not in depth:
                        depth[b] = depth[x] + 1
                        todo.append(b)
            for s in range(4):
                found = [(depth[x], x, sym) for x, slot, sym in own if slot == s and x in depth]
                if found:
                    d, owner, sym = min(found)
                    want[c, s] = (owner, sym, d)
        got = reconcile.bound_slots(spark.createDataFrame(bases, "class long, base long"), spark.createDataFrame(own, "class long, slot int, symbol string"))
        assert {(r["class"], r.slot): (r.owner, r.symbol, r.depth) for r in got.collect()} == want


def test_a_root_of_many_classes_is_dealt_out(spark):
    """An ancestor that all classes share is not the work of one task, with the same slots as without dealing out."""
    bases = [(i, i // 40) for i in range(1, 1500)] + [(i, 0) for i in range(3, 1500, 3)]
    own = [(i, i % 5, f"s{i % 7}") for i in range(0, 60, 2)] + [(1499, 9, "late")]
    b, o = spark.createDataFrame(bases, "class long, base long"), spark.createDataFrame(own, "class long, slot int, symbol string")
    want, got = (sorted(map(tuple, reconcile.bound_slots(b, o, hot).collect())) for hot in (10**9, 20))
    assert got == want and len(want) > 2000
    many = spark.createDataFrame([(1, k) for k in range(1000)] + [(2, 7)], "a long, x long")
    few = spark.createDataFrame([(1, "p"), (1, "q"), (3, "r")], "a long, y string")
    joined = reconcile.dealt(many, few, ["a"], 3 * reconcile.PART, 50)
    assert sorted(map(tuple, joined.select("x", "y").collect())) == sorted((k, y) for k in range(1000) for y in "pq")
    sizes = joined.rdd.glom().map(len).collect()
    assert max(sizes) < 2000


def test_slot_findings(spark):
    bound = spark.createDataFrame([("A", 0, "x"), ("A", 1, "y"), ("B", 0, "z")], "class string, slot int, symbol string")
    tables = spark.createDataFrame([("A", 0, "x"), ("A", 2, "q"), ("A", 0, None)], "class string, slot int, symbol string")
    assert {tuple(r) for r in reconcile.slot_findings(bound, tables).collect()} == {("A", 1, "MISSING"), ("A", 2, "UNBOUND")}
    assert {tuple(r) for r in reconcile.slot_findings(bound, spark.createDataFrame([("B", 0, "w")], "class string, slot int, symbol string")).collect()} == {("B", 0, "FOREIGN")}
