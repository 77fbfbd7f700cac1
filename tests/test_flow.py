"""Control flow and data flow against plain code on random graphs."""

import random

from pyspark.sql import functions as F

from tallyframe.operators import flow
from tallyframe.operators.graph import terminals

CODE = "unit int, at long, targets array<long>, falls boolean, defines string, uses array<string>"


def plain(rows):
    """Blocks, edges, loop heads and definitions of one unit's instructions, one step at a time."""
    rows = sorted(rows)
    places = [r[0] for r in rows]
    aimed = {t for r in rows for t in (r[1] or [])}
    leads = [i == 0 or a[0] in aimed or bool(rows[i - 1][1]) or not rows[i - 1][2] for i, a in enumerate(rows)]
    block, at = {}, 0
    for r, lead in zip(rows, leads):
        at += lead
        block[r[0]] = at
    edges = set()
    for i, r in enumerate(rows):
        if i + 1 == len(rows) or leads[i + 1]:
            edges |= {(block[r[0]], block[t], "jump") for t in (r[1] or []) if t in block}
            if r[2] and i + 1 < len(rows):
                edges.add((block[r[0]], block[r[0]] + 1, "fall"))
    succ = {}
    for a, b, _ in edges:
        succ.setdefault(a, set()).add(b)

    def reach(without):
        seen, todo = set(), [1] if without != 1 else []
        while todo:
            b = todo.pop()
            if b not in seen and b != without:
                seen.add(b)
                todo += succ.get(b, ())
        return seen

    live = reach(0)
    loops = {(b, a, a in live and a not in reach(b)) for a, b, _ in edges if b <= a}
    found = set()
    for r in rows:
        for reg in set(r[4] or []) - {None}:
            seen, got, todo = set(), set(), [places.index(r[0]) - 1 if not leads[places.index(r[0])] else ("in", block[r[0]])]
            while todo:
                x = todo.pop()
                if x in seen:
                    continue
                seen.add(x)
                if isinstance(x, tuple):
                    todo += [max(i for i, p in enumerate(places) if block[p] == a) for a, b, _ in edges if b == x[1]]
                elif rows[x][3] == reg:
                    got.add(rows[x][0])
                else:
                    todo.append(("in", block[places[x]]) if leads[x] else x - 1)
            found |= {(r[0], reg, g) for g in got or {None}}
    return block, edges, loops, found


def random_unit(rnd, n):
    places = sorted(rnd.sample(range(1, 3 * n + 1), n))
    target = lambda: rnd.choice(places) if rnd.random() < 0.9 else rnd.randint(0, 4 * n)
    return [(p, rnd.choice([None, [], [], [], [target()], [target(), target(), target()]]), rnd.random() < 0.85, rnd.choice([None, "a", "b", "c"]), rnd.choice([None, [], ["a"], ["b", "c", "b", None]])) for p in places]


def test_flow_against_plain_code(spark):
    rnd = random.Random(11)
    units = {u: random_unit(rnd, rnd.choice([1, 2, 5, 12, 25])) for u in range(25)}
    units[90] = [(i, [1] if i == 60 else None, True, "a" if i == 7 else None, ["a"]) for i in range(1, 61)]  # one long loop
    units[91] = [(i, [i + 5] if i % 3 == 0 else None, True, None, ["a"]) for i in range(0, 60)]
    blocked = flow.blocks(spark.createDataFrame([(u, *r) for u, rows in units.items() for r in rows], CODE))
    links = flow.edges(blocked)
    nodes = blocked.select("unit", "block").distinct()
    want = {u: plain(rows) for u, rows in units.items()}
    assert {(r.unit, r.at): r.block for r in blocked.collect()} == {(u, p): b for u, w in want.items() for p, b in w[0].items()}
    assert sorted((r.unit, r.src, r.dst, r.kind) for r in links.collect()) == sorted((u, *e) for u, w in want.items() for e in w[1])
    got = sorted((r.unit, r.head, r.latch, r.natural) for r in flow.loop_heads(nodes, links).collect())
    assert got == sorted((u, *x) for u, w in want.items() for x in w[2]) and {x[3] for x in got} == {True, False}
    got = sorted(((r.unit, r.at, r.reg, r.def_at) for r in flow.reaching(blocked, links).collect()), key=repr)
    assert got == sorted(((u, *x) for u, w in want.items() for x in w[3]), key=repr)
    counts = {(r.unit, r.block): (r.preds, r.succs, r.sources) for r in flow.in_edges(nodes, links).collect()}
    for u, (block, edges, _, _) in want.items():
        for b in set(block.values()):
            into = [e for e in edges if e[1] == b]
            assert counts[u, b] == (len(into), sum(e[0] == b for e in edges), len({e[0] for e in into}))


def test_no_code(spark):
    blocked = flow.blocks(spark.createDataFrame([], CODE))
    links, nodes = flow.edges(blocked), blocked.select("unit", "block").distinct()
    assert blocked.collect() == links.collect() == flow.loop_heads(nodes, links).collect() == flow.reaching(blocked, links).collect() == []


def test_only_asked_blocks_are_walked_around(spark):
    links = spark.createDataFrame([(1, a, a + 1) for a in range(1, 30)] + [(1, a, a - 4) for a in range(6, 30, 5)], "unit int, src long, dst long")
    nodes = links.select("unit", "src").union(links.select("unit", "dst")).distinct().toDF("unit", "block")
    _, free = flow.avoided(nodes, links, spark.createDataFrame([(1, 9, 7)], "unit int, block long, by long"))
    assert {r.without for r in free.collect()} == {0, 7}


def test_estimates_do_not_grow_with_rounds(spark):
    """What rounds find has the size of its files for the planner, not a product of sizes over all rounds."""
    digits = lambda df: len(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    links = spark.createDataFrame([(1, a, a + 1) for a in range(1, 40)] + [(1, a, a - 2) for a in range(4, 40, 3)], "unit int, src long, dst long")
    nodes = links.select("unit", "src").union(links.select("unit", "dst")).distinct().toDF("unit", "block")
    chain, free = flow.avoided(nodes, links, links.select("unit", F.col("src").alias("block"), F.col("dst").alias("by")).where("by < block"))
    assert digits(chain) < 40 and digits(free) < 40
    assert digits(terminals(spark.range(1, 300).select(F.col("id").alias("node"), (F.col("id") + 1).alias("next")))) < 40
