"""Closures against plain search, and what is written on the way to them."""

import random

from tallyframe.operators import graph


def test_closure_writes_a_pair_once(spark, monkeypatch):
    rows = []

    def counted(df, cut=graph.cut):
        out = cut(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(graph, "cut", counted)
    rnd = random.Random(2)
    edges = [(k, k + 1) for k in range(12)] + [(100 + k, 100 + (k + 1) % 5) for k in range(5)] + [(200 + rnd.randint(0, 6), 200 + rnd.randint(0, 6)) for _ in range(9)]
    want = {}
    for start in {a for a, _ in edges}:
        level, depth = {start}, 0
        while level:
            level, depth = {b for a, b in edges if a in level and (start, b) not in want}, depth + 1
            want |= {(start, b): depth for b in level}
    got = {(r.src, r.dst): r.depth for r in graph.closure(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == want
    rows.clear()
    assert graph.closure(spark.createDataFrame(edges[:12], "src long, dst long")).count() == sum(rows) == 78
