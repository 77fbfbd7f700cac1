"""Whitening, hard negatives and licence scans against plain computations, and their edge cases."""

import itertools
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import hard_negatives, license_scan, queries, vectors, whitening

SF = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")
VECTORS = "vec_id long, embedding array<float>, label int, n string, v int"


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Embeddings and documents with nulls, odd lengths and values, repeated rows and columns of clashing names."""
    at = str(tmp_path_factory.mktemp("odd"))
    rows = [(i, [float(i % 3), 1.0 - i % 2, 0.25 * i], i % 2, "n", 1) for i in (0, 1, 2, 3, 4, 100, 200, 300)]
    rows += [(5, None, 1, "n", 1), (6, [], 1, "n", 1), (8, [1.0, NAN, 0.0], 1, "n", 1), (9, [INF, 0.0, 0.0], 1, "n", 1), (10, [1.0, None, 2.0], 0, "n", 1), (11, [1.0], 0, "n", 1)]
    rows += [(12, [0.0, 0.0, 0.0], None, "n", 1), (None, [1.0, 1.0, 1.0], 1, "n", 1), (3, [0.0, 0.0, 0.75], 1, "n", 1)]
    spark.createDataFrame(rows, VECTORS).write.parquet(f"{at}/embeddings.parquet")
    docs = [(1, None), (2, ""), (3, "..."), (4, "under the MIT   License, mit-license"), (4, "under the MIT   License, mit-license"), (None, "CC BY"), (5, "w " * 200_000 + "apache license")]
    spark.createDataFrame(docs, "doc_id long, text string").withColumn("words", F.lit("clash")).withColumn("row", F.lit(1)).withColumn("labels", F.lit(2)).write.parquet(f"{at}/documents.parquet")
    return at


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("empty"))
    spark.createDataFrame([], VECTORS).write.parquet(f"{at}/embeddings.parquet")
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{at}/documents.parquet")
    return at


@pytest.mark.parametrize("name", ["op11_whitening", "op12_hard_negatives", "op13_license_scan"])
def test_empty_tables(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).collect() == []


@pytest.mark.parametrize("name", ["op12_hard_negatives", "op13_license_scan"])
@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_sql(spark, name, sf):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    told = con.execute(queries.ORACLES[name])
    names = [x[0] for x in told.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(repr, told.fetchall())) == sorted(repr(tuple(r)) for r in df.select(*names).collect())


def brute_whitening(rows, components=8):
    """(id, component) to deviation and the size of the whitened value, and shares, by whole numbers and another solver."""
    ids, x = [r[0] for r in rows], [[int(np.floor(1024 * float(c))) + 100_000 for c in r[1]] for r in rows]
    n, k = len(x), len(x[0])
    s = [sum(c) for c in zip(*x)]
    y = np.array([[n * c - t for c, t in zip(r, s)] for r in x], object)
    v = np.array([[float(sum(y[:, i] * y[:, j])) / n**3 for j in range(k)] for i in range(k)])
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    parts = min(components, k)
    z = (y / n).astype(float) @ u[:, :parts] / np.sqrt(e[:parts])
    return [(d, j + 1, n, int(sum(y[i] ** 2)), abs(z[i, j]), e[j] / e.sum()) for i, d in enumerate(ids) for j in range(parts)]


def same_whitening(got, want):
    got = sorted((r.vec_id is None, r.vec_id or 0, r.component, r.n, r.deviation, abs(r.whitened), r.explained) for r in got)
    want = sorted((d is None, d or 0, *rest) for d, *rest in want)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-7, atol=1e-7)


def test_whitening_against_another_solver(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = whitening.op11_whitening(spark, SF).collect()
    same_whitening(got, brute_whitening(rows))
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-10


def test_whitening_of_odd_rows(spark, odd):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{odd}/embeddings.parquet").collect()]
    rows = [r for r in rows if r[1] is not None and len(r[1]) == 3 and all(c is not None and np.isfinite(c) for c in r[1])]
    assert len(rows) == 11  # twice that of 3, and that without an id
    same_whitening(whitening.op11_whitening(spark, odd).collect(), brute_whitening(rows))


def test_whitening_of_large_and_of_equal_entries(spark):
    big = [(i, [9e14 * (i % 5), -1e14 * i, 1e13 * (i * i % 7)]) for i in range(12)]
    got = whitening.whiten(spark.createDataFrame(big, "vec_id long, embedding array<double>")).collect()
    want = brute_whitening(big)
    for r, w in zip(sorted(got, key=lambda r: (r.vec_id, r.component)), want):
        assert (r.vec_id, r.component, r.n, None if w[3] >= 10**38 else int(r.deviation)) == (*w[:3], None if w[3] >= 10**38 else w[3])
        assert abs(r.whitened) == pytest.approx(w[4], abs=1e-6)
    flat = whitening.whiten(spark.createDataFrame([(1, [2.0, 5.0]), (2, [3.0, 5.0]), (3, [4.0, 5.0])], "vec_id long, embedding array<double>")).collect()
    assert {(r.vec_id, r.component, round(r.whitened, 9) + 0.0, r.explained) for r in flat} == {(i + 2, c, round(i * 1.5**0.5, 9) * (c == 1) + 0.0, float(c == 1)) for i in (-1, 0, 1) for c in (1, 2)}
    # Entries beyond a long are held, not an error.
    held = whitening.whiten(spark.createDataFrame([(1, [1e300]), (2, [-1e300]), (3, [0.0])], "vec_id long, embedding array<double>")).collect()
    assert [round(abs(r.whitened), 6) for r in sorted(held, key=lambda r: r.vec_id)] == [round(1.5**0.5, 6)] * 2 + [0.0]


def test_jacobi():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 3, 8, 17):
        b = rng.normal(size=(n, n))
        a = b @ b.T
        e, u = whitening.jacobi(a)
        assert np.allclose(u @ np.diag(e) @ u.T, a) and np.allclose(u.T @ u, np.eye(n)) and (np.diff(e) <= 0).all()
    # Small eigenvalues of a graded matrix are right to many digits, which is more than another solver gives.
    d = np.diag([1.0, 1e-5, 1e-10])
    a = d @ np.array([[2.0, 0.5, 0.25], [0.5, 2.0, 0.5], [0.25, 0.5, 2.0]]) @ d
    from fractions import Fraction

    exact = [[Fraction(float(x)) for x in row] for row in a]
    det = sum(s * exact[0][p] * exact[1][q] * exact[2][r] for s, (p, q, r) in zip((1, -1, -1, 1, 1, -1), itertools.permutations(range(3))))
    assert float(np.prod(whitening.jacobi(a)[0])) == pytest.approx(float(det), rel=1e-12)


def test_digits():
    for x in (0, 1, -1, 2**30, -(2**30), 3**70, -(5**60), 2**200 - 1):
        assert sum(d << whitening.DIGIT * p for p, d in whitening.digits(x)) == x


def brute_mined(rows, anchors, positives=5, negatives=5):
    seen = {}
    for i, label, v in rows:
        x = [int(np.floor(256 * float(c))) for c in v]
        seen[i] = min(seen.get(i, (label, x)), (label, x))
    out = set()
    for a in filter(anchors, seen):
        scored = sorted((-sum(p * q for p, q in zip(seen[a][1], x)), i, label == seen[a][0]) for i, (label, x) in seen.items() if i != a)
        for s, p, _ in [r for r in scored if r[2]][:positives]:
            fits = [r for r in scored if not r[2] and -80 * s <= -100 * r[0] <= -100 * s][:negatives]
            out |= {(a, p, k, i, -s, -n) for k, (n, i, _) in enumerate(fits, 1)}
    return out


def of_rows(spark, rows, anchors, **how):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = hard_negatives.mine(df, F.col("vec_id") % anchors == 0, **how).collect()
    assert len(got) == len(set(got))
    return {tuple(r) for r in got}


def test_hard_negatives_over_many_parts_and_rounds(spark, monkeypatch):
    """Clustered rows with many ties, one label with a third of them and labels of a few rows, in small parts."""
    for name, value in (("PART", 40), ("LEAF", 4), ("FIRST", 1), ("GROWTH", 2), ("CHUNK", 64), ("TOGETHER", 3)):
        monkeypatch.setattr(hard_negatives, name, value)
    rng = random.Random(3)
    centres = [[rng.uniform(-1, 1) for _ in range(4)] for _ in range(5)]
    rows = []
    for i in range(260):
        c = rng.choice(centres)
        label = 0 if i % 3 == 0 else rng.choice([1, 2, 3, 10 + i])
        rows.append((i, label, [round(x + rng.gauss(0, 0.05), 1) for x in c]))
    assert of_rows(spark, rows, 10) == brute_mined(rows, lambda i: i % 10 == 0) != set()
    assert of_rows(spark, rows, 65, positives=2, negatives=3) == brute_mined(rows, lambda i: i % 65 == 0, 2, 3)


def test_hard_negatives_of_odd_rows(spark, odd):
    rows = [(r.vec_id, r.label, r.embedding) for r in spark.read.parquet(f"{odd}/embeddings.parquet").collect()]
    rows = [r for r in rows if None not in r[:2] and r[2] is not None and len(r[2]) == 3 and all(c is not None and np.isfinite(c) for c in r[2])]
    rows = [(i, (label + 1) % 10 if i % 7 == 0 else label, v) for i, label, v in rows]
    assert {tuple(r) for r in hard_negatives.op12_hard_negatives(spark, odd).collect()} == brute_mined(rows, lambda i: i % 100 == 0)
    alone = [(0, 1, [1.0]), (1, 2, [1.0])]
    assert of_rows(spark, alone, 10) == set()
    held = [(0, 1, [1e30]), (1, 1, [1e30]), (2, 2, [1e30])]
    assert of_rows(spark, held, 10) == {(0, 1, 1, 2, 2**52, 2**52)}


def test_trees_prune_nothing_that_counts():
    rng = np.random.default_rng(2)
    for same in (True, False):
        rows = rng.integers(-300, 300, (500, 6)).astype(np.int32)
        ids, labels = np.arange(500), rng.integers(0, 3, 500)
        tree = hard_negatives.Tree(ids, labels, rows, 8)
        again = hard_negatives.Tree.load(tree.dump(), 6)
        low, high = np.tile([[-20_000, 0]], (40, 1)), np.tile([[90_000, 60_000]], (40, 1))
        best = hard_negatives.search(again, ids[:40], labels[:40], rows[:40], low, high, np.full((40, 2), hard_negatives.NONE), same, 4)
        got = {(s, v, i) for s, v, i in zip(best.slot.tolist(), best.score.tolist(), best.id.tolist())}
        want = set()
        scores = rows[:40].astype(np.int64) @ rows.T.astype(np.int64)
        for a, w in itertools.product(range(40), range(2)):
            fits = [(-scores[a, i], i) for i in range(500) if i != a and (labels[i] == labels[a]) == same and low[a, w] <= scores[a, i] <= high[a, w]]
            want |= {(a * 2 + w, int(-v), i) for v, i in sorted(fits)[:4]}
        assert got == want


def brute_licences(text, templates, share):
    w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    places = [(i, label) for p, label in license_scan.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    found, held = {x[1] for x in places}, 0.0
    for label, t in templates:
        told = license_scan.plain_words(t)
        c, want = 1 << (len(told) - 1).bit_length(), set(told)
        for k in range(0, max(1, len(w)), c):
            here = len(want & set(w[k : k + 2 * c])) / len(want)
            if here >= share - 1e-12:
                found.add(label)
                held = max(held, here)
    at = [i for i, _ in places]
    return (len(w), len(at), min(at, default=None), max(at, default=None), sorted({x[1] for x in places}), sorted(found), 1.0 if at else held)


def test_licences_against_all_blocks(spark):
    rng = random.Random(4)
    templates = [("a", "one two three four five six"), ("b", "One two, three seven eight nine ten eleven twelve"), ("c", "four"), ("b", "x1 ÿé one"), ("none", "...")]
    words = "one two three four five six seven eight nine ten eleven twelve x1 ÿé cc by other words".split()
    docs = [(i, " ".join(rng.choices(words if i % 3 else words[:12], k=rng.randrange(60)))) for i in range(150)]
    docs += [(500, None), (501, "Kelvin MIT LICENSE İ"), (502, "One" + "-" * 5000 + "TWO three\0seven eight nine ten eleven twelve")]
    for share in (0.5, 0.75, 1.0):
        got = license_scan.scan(spark.createDataFrame(docs, "doc_id long, text string"), templates, share=share).collect()
        assert {r.doc_id: tuple(r)[1:] for r in got} == {d: brute_licences(t, templates[:4], share) for d, t in docs}


def test_notices(spark):
    docs = [(1, "x " * 300 + license_scan.TEMPLATES[2][1].upper() + " y" * 50), (2, "# Licensed under the\n# Apache License,\n# Version 2.0 (the"), (3, "licensed under the license version 2 0 of apaches"), (4, "no licence")]
    got = {r.doc_id: (r.labels, r.score) for r in license_scan.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: (["bsd"], 1.0), 2: (["apache", "apache-2.0"], 1.0), 3: ([], 0.0), 4: ([], 0.0)}
    only = license_scan.scan(spark.createDataFrame(docs, "doc_id long, text string"), []).collect()
    assert {r.doc_id: (r.base_labels, r.labels, r.score) for r in only if r.doc_id == 2} == {2: (["apache"], ["apache"], 1.0)}


def test_licences_of_odd_rows(spark, odd):
    got = sorted(map(tuple, license_scan.op13_license_scan(spark, odd).collect()), key=repr)
    mit = (4, 6, 2, 2, 4, "mit", "mit", 1.0)
    want = [(1, 0, 0, None, None, "", "", 0.0), (2, 0, 0, None, None, "", "", 0.0), (3, 0, 0, None, None, "", "", 0.0), mit, mit, (None, 2, 1, 0, 0, "cc-by", "cc-by", 1.0), (5, 200_002, 1, 200_000, 200_000, "apache", "apache", 1.0)]
    assert got == sorted(want, key=repr)


def test_native_plans_have_no_python(spark):
    plan = license_scan.op13_license_scan(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_usual_length():
    assert vectors.usual_length([(3, 5), (4, 5), (9, 1)]) == 4 and vectors.usual_length([]) == 0
