"""Gaps attributed against plain code; what definitions say is summed up before accesses meet it."""

import random
from itertools import takewhile

from tallyframe.operators import reconcile

KINDS = "library string, name string, offset long, addend long, symbol string, size int, storage string, member string"


def test_attribution_against_plain_code(spark):
    rnd = random.Random(3)
    gaps = [(k * 100, k * 100 + 40, k % 4, "PAD" if k % 5 == 4 else "ZERO-GAP") for k in range(12)]
    accesses = [(fn := rnd.randint(0, 6) * 10, fn + rnd.randint(0, 3), rnd.randint(0, 1200)) for _ in range(300)]
    claims = [(10, "a", "f"), (10, "a", "f"), (20, "a", "f"), (20, "b", "g"), (30, "b", "g"), (40, None, "g"), (50, "a", "h"), (50, "a", "f")]
    defs = [(rnd.choice("ab"), rnd.choice("fgh"), rnd.randint(0, 3), rnd.choice([None, 0, 4]), rnd.choice(["s", "t", None]), 4, "bss", "m") for _ in range(25)]
    make = lambda rows, kind: spark.createDataFrame(rows, kind)
    got = reconcile.attribute(make(gaps, "lo long, hi long, touched int, verdict string"), make(accesses, "fn long, site long, target long"), make(claims, "fn long, library string, name string"), make(defs, KINDS), 64)
    want = set()
    for fn, site, target in accesses:
        for lo, hi, touched, verdict in gaps:
            if site and lo <= target < hi and touched and verdict != "PAD":
                hits = {(target - d[3], *d[4:7], d[0], d[7]) for f, lib, name in claims for d in defs if f == fn and (lib, name, site - fn) == d[:3] and d[3] is not None}
                kind = "UNKNOWN" if not hits else "FOUND" if len(hits) == 1 else "AMBIGUOUS"
                want.add((lo, fn, site, target, kind, len(hits), *(min(hits, key=repr) if kind == "FOUND" else [None] * 6)))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr) and {x[4] for x in want} == {"FOUND", "AMBIGUOUS", "UNKNOWN"}
    above = takewhile(lambda x: "Join" not in x, got._jdf.queryExecution().optimizedPlan().toString().splitlines())
    assert not any("Aggregate" in x for x in above)
