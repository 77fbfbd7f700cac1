"""Interval algebra over an integer address space, all half-open [lo, hi).

Every operator takes the columns that name an independent address space (`by`), so that its windows are partitioned.
Where one takes a `width`, spaces are swept in cells of that many places (see sweep), so that one space is the work of many
tasks; without it a space is one task's. Results are the same.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.operators import sweep


def _order(by: Sequence[str], *keys):
    return Window.partitionBy(*by).orderBy(*keys)


def extents(rows: DataFrame, by: Sequence[str], start: str, end: Column | str, ties: Sequence[str] = (), width: int | None = None) -> DataFrame:
    """rows with size: the next start less the own start, for the last row of a space its end less the start."""
    end = F.col(end) if isinstance(end, str) else end
    if width:
        out = sweep.next_place(sweep.celled(rows, by, start, width), start, [start, *ties], "_next")
        return sweep.done(out.withColumn("size", F.coalesce("_next", end) - F.col(start)), "_next")
    following = F.lead(start).over(_order(by, start, *ties))
    return rows.withColumn("size", F.coalesce(following, end) - F.col(start))


def with_exact(rows: DataFrame, exact: DataFrame, key: Sequence[str]) -> DataFrame:
    """rows (…, size) overridden by exact (key, exact_size); oversized: the exact size exceeds the room there is."""
    joined = rows.withColumnRenamed("size", "room").join(exact, list(key), "left")
    return joined.withColumn("size", F.coalesce("exact_size", "room")).withColumn("oversized", F.coalesce(F.col("exact_size") > F.col("room"), F.lit(False)))


def asof(points: DataFrame, anchors: DataFrame, by: Sequence[str], at: str, carry: Sequence[str], forward: bool = False, ties: Sequence[str] = (), width: int | None = None) -> DataFrame:
    """points with the carried columns of the last anchor at or before each point (the first at or after it: forward).

    Both sides go through one window as a union; neither is joined to the other, so a hot space costs a sort only.
    """
    names = [f"anchor_{c}" for c in carry]
    p = points.withColumn("_anchor", F.lit(False))
    a = anchors.select(*by, at, *[F.col(c).alias(n) for c, n in zip(carry, names)]).withColumn("_anchor", F.lit(True))
    both = p.unionByName(a, allowMissingColumns=True)
    # An anchor counts for a point at its own place: before it in either direction of the scan.
    keys = [F.col(at).desc() if forward else F.col(at).asc(), F.col("_anchor").desc(), *[F.col(t).desc() if forward else F.col(t).asc() for t in ties]]
    packed = F.when(F.col("_anchor"), F.struct(*[F.col(n) for n in names]))
    if width:
        found = sweep.done(sweep.last_known(sweep.celled(both, by, at, width), packed, keys, F.struct(at, *ties), "_found", forward))
    else:
        found = both.withColumn("_found", F.last(packed, ignorenulls=True).over(_order(by, *keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    found = found.where(~F.col("_anchor"))
    return found.select(*points.columns, *[F.col(f"_found.{n}").alias(n) for n in names])


def coalesce(rows: DataFrame, by: Sequence[str], lo: str, hi: str, tolerance: int = 0, measures: Sequence[Column] = (), width: int | None = None) -> DataFrame:
    """Runs (by, run, lo, hi, parts, measures): intervals join while lo - highest end so far <= tolerance; 0 joins touching ones."""
    opens = F.when(F.col("_reach").isNull() | (F.col(lo) - F.col("_reach") > tolerance), 1).otherwise(0)
    if width:
        reached = sweep.highest_before(sweep.celled(rows, by, lo, width), hi, [lo, hi], "_reach")
        numbered = sweep.done(sweep.running_sum(reached, opens, [lo, hi], "run"), "_reach")
        return numbered.groupBy(*by, "run").agg(F.min(lo).alias("lo"), F.max(hi).alias("hi"), F.count("*").alias("parts"), *measures)
    w = _order(by, lo, hi)
    reach = F.max(hi).over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = rows.withColumn("_reach", reach).withColumn("_new", opens).drop("_reach")
    numbered = opened.withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*by, "run").agg(F.min(lo).alias("lo"), F.max(hi).alias("hi"), F.count("*").alias("parts"), *measures)


def gaps(runs: DataFrame, by: Sequence[str], width: int | None = None) -> DataFrame:
    """Holes (by, gap_lo, gap_hi, length) strictly between coalesced runs (by, lo, hi)."""
    if width:
        led = sweep.done(sweep.next_place(sweep.celled(runs, by, "lo", width), "lo", ["lo"], "gap_hi"))
    else:
        led = runs.withColumn("gap_hi", F.lead("lo").over(_order(by, "lo")))
    return led.where("gap_hi > hi").select(*by, F.col("hi").alias("gap_lo"), "gap_hi", (F.col("gap_hi") - F.col("hi")).alias("length"))


def overlaps(left: DataFrame, right: DataFrame, by: Sequence[str], least: int = 1, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Pairs that overlap, left columns as l_*, right ones as r_*, with the clipped ends lo and hi.

    An interval has the level of the power of two that its length does not exceed (nor `least`), and lies in two bins of that width at
    most. A pair meets at the higher of its levels, in the bin of its larger start, so it comes once; a row goes to its
    own level and to the higher ones that the other side has: a few rows for an interval of any length.
    """
    side = lambda df, mark: df.select(*by, *[F.col(c).alias(f"{mark}_{c}") for c in df.columns if c not in by]).where(F.col(f"{mark}_{lo}") < F.col(f"{mark}_{hi}")).withColumn(f"{mark}_level", F.ceil(F.log2(F.greatest(F.col(f"{mark}_{hi}") - F.col(f"{mark}_{lo}"), F.lit(least)))).cast("int"))
    one, two = side(left, "l"), side(right, "r")
    # One row of 64 numbers at most.
    levels = lambda df, mark: F.broadcast(df.agg(F.collect_set(f"{mark}_level").alias("_others")))

    def binned(df: DataFrame, mark: str, others: DataFrame) -> DataFrame:
        at = df.crossJoin(others).withColumn("_level", F.explode(F.array_distinct(F.concat(F.array(f"{mark}_level"), F.filter("_others", lambda x: x > F.col(f"{mark}_level")))))).drop("_others")
        width = F.pow(F.lit(2.0), F.col("_level")).cast("long")
        return at.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(f"{mark}_{lo}") / width).cast("long"), F.floor((F.col(f"{mark}_{hi}") - 1) / width).cast("long"))))

    l_lo, l_hi, r_lo, r_hi = (F.col(f"{m}_{e}") for m in "lr" for e in (lo, hi))
    pairs = binned(one, "l", levels(two, "r")).join(binned(two, "r", levels(one, "l")), [*by, "_level", "_bin"])
    pairs = pairs.where((l_lo < r_hi) & (r_lo < l_hi) & (F.col("_level") == F.greatest("l_level", "r_level")) & (F.col("_bin") == F.floor(F.greatest(l_lo, r_lo) / F.pow(F.lit(2.0), F.col("_level")).cast("long")).cast("long")))
    return pairs.drop("_bin", "_level", "l_level", "r_level").withColumn("lo", F.greatest(l_lo, r_lo)).withColumn("hi", F.least(l_hi, r_hi))


def innermost(points: DataFrame, bands: DataFrame, by: Sequence[str], at: str, owner: str) -> DataFrame:
    """points with the owner of the band (lo, hi) of latest start, then of highest owner, that holds the point; null if none does."""
    places = points.select(*by, F.col(at).alias("lo"), (F.col(at) + 1).alias("hi")).dropDuplicates()
    held = overlaps(places, bands.select(*by, "lo", "hi", owner), by)
    best = held.groupBy(*by, F.col("l_lo").alias(at)).agg(F.max(F.struct("r_lo", f"r_{owner}")).alias("_best"))
    return points.join(best, [*by, at], "left").withColumn(owner, F.col(f"_best.r_{owner}")).drop("_best")


def fragments(rows: DataFrame, order: Sequence[str], unit: str, size: str, at: str, by: Sequence[str] = ()) -> DataFrame:
    """Per unit: rows, bytes, frags (maximal runs of the unit in order), span, avg_cluster, frag_ratio."""
    w = _order(by, *order)
    changed = rows.withColumn("_frag", F.when(F.lag(unit).over(w).eqNullSafe(F.col(unit)), 0).otherwise(1))
    out = changed.groupBy(*by, unit).agg(F.count("*").alias("n"), F.sum(size).alias("bytes"), F.sum("_frag").alias("frags"), (F.max(at) - F.min(at)).alias("span"))
    return out.withColumn("avg_cluster", F.round(F.col("n") / F.col("frags"), 6)).withColumn("frag_ratio", F.round(F.col("frags") / F.col("n"), 6))


def order_violations(rows: DataFrame, by: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Rows whose value is below their predecessor's in the given order, with that one as previous."""
    previous = F.lag(value).over(_order(by, *order))
    return rows.withColumn("previous", previous).where(F.col("previous") > F.col(value))


def neighbours(rows: DataFrame, by: Sequence[str], order: Sequence[str], target: Column, k: int) -> DataFrame:
    """Rows at most k places from a target row of the same space."""
    w = _order(by, *order)
    hit = F.max(target.cast("int")).over(w.rowsBetween(-k, k))
    return rows.withColumn("_near", hit).where("_near = 1").drop("_near")


def collapse(rows: DataFrame, by: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Rows that do not repeat the value of the row before."""
    return rows.withColumn("_same", F.lag(value).over(_order(by, *order)).eqNullSafe(F.col(value))).where("not _same").drop("_same")


def stride_runs(rows: DataFrame, by: Sequence[str], at: str, stride: int, width: int | None = None) -> DataFrame:
    """Maximal runs (by, lo, hi, n) of positions, each there once, that follow each other at the stride."""
    if width:
        keyed = sweep.done(sweep.running_sum(sweep.celled(rows, by, at, width), F.lit(1), [at], "_place").withColumn("_island", F.col(at) - stride * F.col("_place")), "_place")
    else:
        keyed = rows.withColumn("_island", F.col(at) - stride * F.row_number().over(_order(by, at)))
    return keyed.groupBy(*by, "_island").agg(F.min(at).alias("lo"), F.max(at).alias("hi"), F.count("*").alias("n")).drop("_island")
