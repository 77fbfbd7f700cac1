"""Snapshots against a ratcheted ledger: events, merge, carried regressions and weighted sums.

A snapshot has (unit, fn, pct, fp, addr); the ledger (unit, fn, best, cur, hist, tries, fp, addr, state).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Two scores differ if they differ by more than this; scores are kept to four places.
EPS, PLACES = 0.01, 4
KEY = ["unit", "fn"]


def below(pct: Column, best: Column) -> Column:
    return F.round(pct, PLACES) < best - EPS


def moves(snapshot: DataFrame, ledger: DataFrame) -> DataFrame:
    """(unit, fn, old_unit, old_fn): a key the ledger lacks and one the snapshot lacks, at one address that neither side has twice."""
    once = lambda df: df.where("addr is not null").groupBy("addr").agg(F.count("*").alias("n"), F.min(F.struct(*KEY)).alias("k")).where("n = 1")
    new = once(snapshot).select("addr", "k.*").join(ledger.select(*KEY), KEY, "left_anti")
    old = once(ledger).select("addr", "k.*").join(snapshot.select(*KEY), KEY, "left_anti").select("addr", F.col("unit").alias("old_unit"), F.col("fn").alias("old_fn"))
    return new.join(old, "addr").select(*KEY, "old_unit", "old_fn")


def classify(snapshot: DataFrame, ledger: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Events (unit, fn, event); a moved row may have two.

    sources (unit, fn, fp): fingerprints of what is there now, scored or not. A row that vanished is REMOVED if its address
    is scored elsewhere or its source was edited; one whose source is gone was not edited.
    """
    moved = moves(snapshot, ledger)
    old = ledger.select(F.col("unit").alias("old_unit"), F.col("fn").alias("old_fn"), "best", F.col("fp").alias("old_fp"))
    cur = snapshot.join(moved, KEY, "left")
    came = F.col("old_unit").isNotNull()
    cur = cur.withColumn("event_move", F.when(came & (F.col("old_unit") == F.col("unit")), "RENAMED").when(came, "MOVED"))
    cur = cur.withColumn("old_unit", F.coalesce("old_unit", "unit")).withColumn("old_fn", F.coalesce("old_fn", "fn")).join(old, ["old_unit", "old_fn"], "left")
    state = F.when(F.col("best").isNull(), "NEW").when(below(F.col("pct"), F.col("best")), "REGRESS").when(F.col("fp") != F.col("old_fp"), "TOUCHED").when(F.col("pct") > F.col("best") + EPS, "IMPROVE")
    present = cur.select(*KEY, F.explode(F.array_compact(F.array("event_move", state))).alias("event"))
    gone = ledger.join(snapshot.select(*KEY), KEY, "left_anti").join(moved.select(F.col("old_unit").alias("unit"), F.col("old_fn").alias("fn")), KEY, "left_anti")
    seen = snapshot.where("addr is not null").select("addr", F.lit(True).alias("elsewhere")).dropDuplicates()
    gone = gone.join(seen, "addr", "left")
    edited = F.lit(False)
    if sources is not None:
        gone, edited = gone.join(sources.select(*KEY, F.col("fp").alias("now")), KEY, "left"), F.col("now") != F.col("fp")
    lost = gone.select(*KEY, F.when(F.col("elsewhere") | F.coalesce(edited, F.lit(False)), "REMOVED").when(F.col("state") == "absent", "KNOWN-ABSENT").otherwise("LOST").alias("event"))
    return present.unionByName(lost)


def merge(snapshot: DataFrame, ledger: DataFrame) -> DataFrame:
    """The ledger after the snapshot: raised, reset where edited or rebound, and rows out of sight kept as absent.

    A key that the ledger lacks carries on the row that the ledger has at its address, if it has one only.
    """
    held = [F.col(c).alias(f"l_{c}") for c in ("best", "hist", "tries", "fp", "addr")]
    named = snapshot.join(ledger.select(*KEY, *held), KEY, "left")
    once = ledger.where("addr is not null").groupBy("addr").agg(F.count("*").alias("n"), F.min(F.struct("best", "hist", "tries", "fp")).alias("m")).where("n = 1").select("addr", "m")
    j = named.join(once, "addr", "left")
    lacks = F.col("l_best").isNull()
    moved = lacks & F.col("m").isNotNull()
    for c in ("hist", "tries", "fp"):
        j = j.withColumn(f"l_{c}", F.when(moved, F.col(f"m.{c}")).otherwise(F.col(f"l_{c}")))
    j = j.withColumn("l_addr", F.when(moved, F.col("addr")).otherwise(F.col("l_addr"))).withColumn("l_best", F.when(moved, F.col("m.best")).otherwise(F.col("l_best")))
    new = F.col("l_best").isNull()
    rebound = F.col("addr") != F.col("l_addr")
    edited = F.col("fp") != F.col("l_fp")
    best = F.when(new | rebound | edited, F.col("pct")).otherwise(F.greatest("l_best", "pct"))
    tries = F.when(new | rebound, F.lit(1)).when(edited, F.col("l_tries") + 1).otherwise(F.col("l_tries"))
    present = j.select(*KEY, best.alias("best"), F.col("pct").alias("cur"), F.greatest("pct", F.coalesce("l_hist", "pct")).alias("hist"), tries.cast("long").alias("tries"), "fp", "addr", F.lit("").alias("state"))
    claimed = snapshot.where("addr is not null").select("addr").dropDuplicates()
    absent = ledger.join(snapshot.select(*KEY), KEY, "left_anti").where("addr is not null").join(claimed, "addr", "left_anti")
    return present.unionByName(absent.select(*KEY, "best", "cur", "hist", F.col("tries").cast("long").alias("tries"), "fp", "addr", F.lit("absent").alias("state")))


def carried(snapshot: DataFrame, ledger: DataFrame) -> DataFrame:
    """Rows below their best (unit, fn, pct, best, kind): carried if the ledger's own last score was below it too, else fresh."""
    j = snapshot.select(*KEY, "pct").join(ledger.select(*KEY, "best", "cur"), KEY).where(below(F.col("pct"), F.col("best")))
    return j.select(*KEY, "pct", "best", F.when(below(F.col("cur"), F.col("best")), "carried").otherwise("fresh").alias("kind"))


def weighted(rows: DataFrame, by: list[str], pct: str, size: str) -> DataFrame:
    """Weighted mean of pct by size, with sums; 0 where the weights are."""
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum(size).alias("bytes"), F.sum(F.col(pct) * F.col(size)).alias("_s"), F.sum(F.when(F.col(pct) >= 99.995, F.col(size)).otherwise(0)).alias("exact_bytes"))
    return out.withColumn("fuzzy", F.round(F.coalesce(F.try_divide("_s", "bytes"), F.lit(0.0)), 4)).drop("_s")
