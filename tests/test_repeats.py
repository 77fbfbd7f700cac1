"""Maximal repeated runs against a comparison of all pairs of places."""

import random
import time

from tallyframe.operators import repeats


def plain_runs(s, least):
    found = {}
    for i in range(len(s)):
        for j in range(i + 1, len(s)):
            if i and s[i - 1] == s[j - 1]:
                continue
            n = 0
            while j + n < len(s) and s[i + n] == s[j + n]:
                n += 1
            if n >= least:
                found.setdefault(tuple(s[i : i + n]), set()).update((i, j))
    first = lambda t: min(k for k in range(len(s)) if tuple(s[k : k + len(t)]) == t)
    return {(len(t), len(at), first(t), t[-1], "suffix" if t[-1] == "a" else "prefix") for t, at in found.items()}


def test_runs_against_all_pairs(spark):
    from pyspark.sql import functions as F

    rnd = random.Random(3)
    units = {u: [rnd.choice("abcdefg"[: rnd.choice([1, 2, 2, 3, 7])]) for _ in range(rnd.choice([0, 1, 4, 9, 40]))] for u in range(60)}
    units[70], units[71] = list("abcd" * 12), list("a" * 33)
    base = [rnd.choice("abcde") for _ in range(15)]
    units[72] = base + ["x"] + base + ["y"] + base[3:] + ["x"] + base[:9]
    rows = [(u, k, t) for u, s in units.items() for k, t in enumerate(s)]
    for least in (1, 4):
        got = repeats.maximal_runs(spark.createDataFrame(rows, "unit int, pos int, token string"), least, F.col("token") == "a").collect()
        assert sorted(tuple(r) for r in got) == sorted((u, *x) for u, s in units.items() for x in plain_runs(s, least))


def test_long_repetitive_units_take_no_longer():
    n = 100_000
    began = time.time()
    # Suffixes of n equal tokens, the shortest first.
    found = list(repeats.intervals(list(range(n - 1, -1, -1)), list(range(n)), [0] * (n - 1) + [-1], 4))
    assert len(found) == n - 4 and time.time() - began < 20


def test_no_tokens(spark):
    assert repeats.maximal_runs(spark.createDataFrame([], "unit int, pos int, token string")).collect() == []
