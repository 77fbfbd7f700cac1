"""Whitening of embeddings: a distributed centred scatter, and cyclic Jacobi rotations on the driver.

Entries become whole numbers, floor(SCALE * c) + SHIFT, so that all sums are exact and do not depend on how rows lie in
tasks. One pass sums the entries; the next sums products of entries less the rounded mean, by pairs of dimensions; what
the rounding leaves of the mean is taken out of the sums in whole numbers. Each task gives one row for a pair of
dimensions and 30 bits; they are summed by pair, so that a driver gets k * (k + 1) / 2 sums however many tasks there are.
The driver diagonalises the covariance by rotations in rounds of disjoint pairs until every entry off the diagonal is
negligible beside the two on it that it belongs to, which keeps small eigenvalues accurate. Vectors of MOST entries at
most are taken, as the driver holds their matrix; the whitening matrix, of k * components numbers, goes to every task.

Edge cases: rows whose vector is null, empty, or has an entry that is null or not finite are left out, and so are rows
whose length is not the commonest one (the longer of two as common). An entry too large for a 64-bit integer is held at
2**62. A component along which all rows agree has whitened values of 0 and no part in identity_error. Vectors of fewer
entries than components have as many components as entries. Rows with one or no vec_id, and equal rows, each count and
are returned. A deviation above 38 digits is null, and so is one above a long in the query. Further columns are ignored;
an empty table gives an empty table.
"""

from __future__ import annotations

import decimal
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import common, vectors

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Entries of a vector: the driver's matrix takes 32 MB then.
MOST = 2048
HELD = 2**62
#: Sums are sent in digits to this base, so that adding them up never passes a long.
DIGIT = 30


def digits(value: int) -> Iterator[tuple[int, int]]:
    """(place, digit) of a whole number to the base 2**DIGIT; all digits have its sign."""
    sign, value, place = (-1 if value < 0 else 1), abs(value), 0
    while value:
        if low := value & ((1 << DIGIT) - 1):
            yield place, sign * low
        value >>= DIGIT
        place += 1


def entries(b: pa.RecordBatch, k: int) -> np.ndarray:
    x = vectors.whole(SCALE * vectors.matrix(b.column("v"), k), -HELD, HELD)
    return np.where(np.abs(x) < HELD, x + SHIFT, x)


def exact(x: np.ndarray, most: int) -> np.ndarray:
    """x as integers in which results of at most `most` are exact."""
    return x if most < 2**62 else x.astype(object)


def added(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of digits by key and place."""
    return rows.groupBy(*keys, "place").agg(F.sum("digit").alias("digit"))


def value_of(rows, key) -> dict:
    out: dict = {}
    for r in rows:
        out[key(r)] = out.get(key(r), 0) + (r["digit"] << DIGIT * r["place"])
    return out


def summed(k: int):
    """Batches to digits of the sums of each dimension (dim -1: rows)."""

    def run(batches):
        total, n = np.zeros(k, object), 0
        for b in vectors.pieces(batches):
            x = entries(b, k)
            n += len(x)
            total += exact(x, len(x) * int(np.abs(x).max(initial=0))).sum(axis=0)
        rows = [(i, p, d) for i, v in [(-1, n), *enumerate(total.tolist())] for p, d in digits(int(v))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["dim", "place", "digit"])

    return run


def scattered(k: int, centre: list[int]):
    """Batches to digits of the sums of products of two dimensions, both less the centre."""
    m = np.array(centre, object)

    def run(batches):
        total = np.zeros((k, k), object)
        near = np.array([c if abs(c) < HELD else 0 for c in centre], np.int64)
        for b in vectors.pieces(batches):
            x = entries(b, k)
            wide = max(map(abs, centre), default=0) >= HELD or int(np.abs(x).max(initial=0)) >= HELD // 2
            y = x.astype(object) - m if wide else x - near
            most = int(abs(y).max(initial=0))
            if len(y) * most * most < 2**53:
                y = y.astype(np.float64)  # products and sums are whole and exact
                total += (y.T @ y).astype(np.int64).astype(object)
            else:
                y = exact(y, len(y) * most * most)
                total += y.T.dot(y).astype(object)
        rows = [(i, j, p, d) for i in range(k) for j in range(i, k) for p, d in digits(int(total[i, j]))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["i", "j", "place", "digit"])

    return run


def jacobi(a: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix without negative eigenvalues.

    A sweep has a rotation for each pair of dimensions, dealt in rounds of disjoint pairs, which are turned at once. The
    first entry of a vector that is the largest by size is positive.
    """
    n = len(a)
    a, v = a.astype(np.float64).copy(), np.eye(n)
    ring = list(range(n + n % 2))
    rounds = []
    for _ in range(len(ring) - 1):
        half = len(ring) // 2
        rounds.append(np.array([(min(p, q), max(p, q)) for p, q in zip(ring[:half], ring[:half - 1 : -1]) if max(p, q) < n], int).reshape(-1, 2))
        ring = [ring[0], ring[-1], *ring[1:-1]]
    tiny = np.finfo(float).tiny
    for _ in range(sweeps):
        turned = 0
        for pairs in rounds:
            p, q = pairs[:, 0], pairs[:, 1]
            app, aqq, apq = a[p, p], a[q, q], a[p, q]
            on = np.abs(apq) > np.maximum(2**-53 * np.sqrt(np.abs(app * aqq)), tiny)
            if not on.any():
                continue
            turned += int(on.sum())
            p, q, app, aqq, apq = p[on], q[on], app[on], aqq[on], apq[on]
            with np.errstate(over="ignore"):
                theta = (aqq - app) / (2 * apq)
                t = np.where(theta >= 0, 1.0, -1.0) / (np.abs(theta) + np.hypot(theta, 1.0))
            c = 1 / np.hypot(t, 1.0)
            s = t * c
            for x in (a, v):
                left, right = x[:, p].copy(), x[:, q].copy()
                x[:, p], x[:, q] = c * left - s * right, s * left + c * right
            left, right = a[p].copy(), a[q].copy()
            a[p], a[q] = c[:, None] * left - s[:, None] * right, s[:, None] * left + c[:, None] * right
            a[p, p], a[q, q] = app - t * apq, aqq + t * apq
            a[p, q] = a[q, p] = 0.0
        if not turned:
            break
    e = np.maximum(np.diag(a), 0.0)
    order = np.argsort(-e, kind="stable")
    v = v[:, order]
    lead = v[np.abs(v).argmax(axis=0), np.arange(n)] if n else np.zeros(0)
    return e[order], v * np.where(lead < 0, -1.0, 1.0)


class Whitener:
    """What rows are whitened by: the mean in whole numbers and the rest of it, directions scaled to variance 1, shares."""

    def __init__(self, n: int, sums: list[int], scatter: dict[tuple[int, int], int], components: int = COMPONENTS):
        k = len(sums)
        self.n, self.sums = n, sums
        self.centre = [round_half(s, n) for s in sums]
        rest = [s - n * m for s, m in zip(sums, self.centre)]
        self.rest = np.array([r / n for r in rest])
        # n * n * V in whole numbers: the one rounding is that of the division.
        v = np.zeros((k, k))
        for i in range(k):
            for j in range(i, k):
                v[i, j] = v[j, i] = (n * scatter.get((i, j), 0) - rest[i] * rest[j]) / (n * n)
        self.covariance = v
        e, u = jacobi(v)
        # What rounding leaves along a direction in which rows agree, by the sizes of the entries it is made of.
        e = np.where(e > 2**-50 * k * (u * u).T @ np.diag(v), e, 0.0)
        total = e.sum()
        self.values, self.vectors = e[:components], u[:, :components]
        self.shares = [float(x / total) if total else 0.0 for x in self.values]
        self.scaled = self.vectors * np.where(self.values > 0, 1 / np.sqrt(np.where(self.values > 0, self.values, 1.0)), 0.0)

    def apply(self, x: np.ndarray) -> np.ndarray:
        far = max(map(abs, self.centre)) >= HELD // 2 or int(np.abs(x).max(initial=0)) >= HELD // 2
        y = x.astype(object) - np.array(self.centre, object) if far else x - np.array(self.centre, np.int64)
        return (y.astype(np.float64) - self.rest) @ self.scaled

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n * x - S) squared, exactly."""
        most = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0)
        if most < 2**62:
            d = self.n * x - np.array(self.sums, np.int64)
        else:
            d = self.n * x.astype(object) - np.array(self.sums, object)
        far = int(abs(d).max(initial=0))
        d = exact(d, far * far * max(1, d.shape[1]))
        return (d * d).sum(axis=1).tolist()


def round_half(s: int, n: int) -> int:
    return (2 * s + n) // (2 * n)


def fit(rows: DataFrame, k: int, components: int = COMPONENTS) -> Whitener:
    """rows: vec_id, v, an array of k entries."""
    if k > MOST:
        raise ValueError(f"vectors of {k} entries; {MOST} at most")
    told = value_of(added(rows.select("v").mapInArrow(summed(k), "dim long, place long, digit long"), ["dim"]).collect(), lambda r: r["dim"])
    n, sums = told[-1], [told.get(i, 0) for i in range(k)]
    pairs = added(rows.select("v").mapInArrow(scattered(k, [round_half(s, n) for s in sums]), "i long, j long, place long, digit long"), ["i", "j"])
    return Whitener(n, sums, value_of(pairs.toLocalIterator(), lambda r: (r["i"], r["j"])), components)


def identity_error(rows: DataFrame, w: Whitener) -> float:
    """The largest entry by size of the covariance of whitened rows less the identity, over components that vary."""
    k, parts = len(w.sums), int((w.values > 0).sum())

    def run(batches):
        total, products, n = np.zeros(parts), np.zeros((parts, parts)), 0
        for b in vectors.pieces(batches):
            z = w.apply(entries(b, k))[:, :parts]
            total, products, n = total + z.sum(axis=0), products + z.T @ z, n + len(z)
        if n:
            cells = [(-1, j, float(t)) for j, t in enumerate(total)] + [(i, j, float(products[i, j])) for i in range(parts) for j in range(parts)]
            if cells:
                yield pa.RecordBatch.from_arrays([pa.array([c[0] for c in cells], pa.int64()), pa.array([c[1] for c in cells], pa.int64()), pa.array([c[2] for c in cells])], names=["i", "j", "x"])

    if not parts:
        return 0.0
    sums = {(r["i"], r["j"]): r["x"] / w.n for r in rows.select("v").mapInArrow(run, "i long, j long, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).collect()}
    # Whitened values are centred before they are made; what is left of their mean is below 1e-10.
    return max(abs(sums[i, j] - sums[-1, i] * sums[-1, j] - (i == j)) for i, j in itertools.product(range(parts), repeat=2))


SCHEMA = "vec_id {id}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Per row of embeddings (vec_id, embedding) and component: n, deviation, whitened, explained, identity_error."""
    id_type = embeddings.schema["vec_id"].dataType
    schema = SCHEMA.format(id=id_type.simpleString())
    rows = vectors.usable(embeddings.select("vec_id", F.col("embedding").alias("v")), "v")
    k = vectors.usual_length([tuple(r) for r in rows.groupBy(F.size("v")).count().collect()])
    if not k:
        return rows.sparkSession.createDataFrame([], schema)
    rows = rows.where(F.size("v") == k)
    w = fit(rows, k, components)
    error, parts = identity_error(rows, w), len(w.values)

    def run(batches):
        limit = 10**38
        for b in vectors.pieces(batches):
            x = entries(b, k)
            z, n = w.apply(x), len(x)
            wide = np.repeat(np.arange(n), parts)
            far = [decimal.Decimal(d) if d < limit else None for d in w.deviations(x)]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("vec_id").take(pa.array(wide)), pa.array(np.tile(np.arange(1, parts + 1, dtype=np.int32), n)), pa.array(np.full(n * parts, w.n, np.int64)),
                    pa.array(far, pa.decimal128(38, 0)).take(pa.array(wide)), pa.array(z.ravel()), pa.array(np.tile(w.shares, n)), pa.array(np.full(n * parts, error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, schema)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(common.table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").try_cast("long"))
