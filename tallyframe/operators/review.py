"""Reports on snapshots and ledgers: churn, exemptions, records, panels, censuses, queues; and changes by content."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.operators.ledger import EPS, KEY, below, carried, classify

#: A score from here on counts as exact.
EXACT = 99.995


def churn(snapshot: DataFrame, ledger: DataFrame, sizes: DataFrame, by: str = "unit") -> DataFrame:
    """(by, n, churn): points lost against the best, over EPS each, weighted by size; sizes (unit, fn, size). All groups have a row."""
    j = snapshot.select(*KEY, "pct").join(ledger.select(*KEY, "best"), KEY, "left").join(sizes, KEY, "left")
    lost = F.col("best") - F.col("pct")
    counts = F.coalesce(lost > EPS, F.lit(False))
    return j.groupBy(by).agg(F.count_if(counts).alias("n"), F.round(F.coalesce(F.sum(F.when(counts, lost * F.coalesce("size", F.lit(0)))), F.lit(0.0)), 4).alias("churn"))


def unit_counts(ledger: DataFrame) -> DataFrame:
    """(unit, n, matched): rows of each unit, and those that are exact now."""
    return ledger.groupBy("unit").agg(F.count("*").alias("n"), F.count_if(F.col("cur") >= EXACT).alias("matched"))


def exempted(snapshot: DataFrame, ledger: DataFrame) -> DataFrame:
    """Fresh regressions (unit, fn, pct, best, neighbour): neighbour if the unit has a NEW row (a moved or renamed one is none) and
    the row's own fingerprint stands."""
    fresh = carried(snapshot, ledger).where("kind = 'fresh'").drop("kind")
    grown = classify(snapshot, ledger).where("event = 'NEW'").select("unit", F.lit(True).alias("grown")).distinct()
    same = snapshot.select(*KEY, "fp").join(ledger.select(*KEY, F.col("fp").alias("old_fp")), KEY).select(*KEY, F.col("fp").eqNullSafe(F.col("old_fp")).alias("same"))
    return fresh.join(same, KEY).join(grown, "unit", "left").select(*KEY, "pct", "best", (F.coalesce("grown", F.lit(False)) & F.col("same")).alias("neighbour"))


def by_address(ledger: DataFrame) -> DataFrame:
    """Rows of the ledger whose address no other row has."""
    alone = ledger.where("addr is not null").groupBy("addr").agg(F.count("*").alias("n")).where("n = 1").select("addr")
    return ledger.join(alone, "addr")


def strictly_below(snapshot: DataFrame, ledger: DataFrame) -> DataFrame:
    """(unit, strict, jitter): rows under 100 that are below the best at their address at all, and those of them within EPS of it."""
    j = snapshot.where("pct < 100").select("unit", "addr", "pct").join(by_address(ledger).select("addr", "best"), "addr").where("pct < best")
    return j.groupBy("unit").agg(F.count("*").alias("strict"), F.count_if(F.col("best") - F.col("pct") <= EPS).alias("jitter"))


def record(ledger: DataFrame, trials: DataFrame) -> DataFrame:
    """trials (unit, fn, fp, score) against the ledger, the best trial of each row: (unit, fn, best, verdict).

    A record is RAISED only on a row that is there, for the fingerprint it has now, and above its best.
    """
    top = trials.groupBy(*KEY, F.col("fp").alias("trial_fp")).agg(F.max("score").alias("score"))
    j = top.join(ledger.select(*KEY, "best", "fp"), KEY, "left")
    verdict = F.when(F.col("best").isNull(), "NO-ROW").when(~F.col("fp").eqNullSafe(F.col("trial_fp")), "STALE").when(F.col("score") > F.col("best"), "RAISED").otherwise("HELD")
    return j.select(*KEY, "trial_fp", F.when(verdict == "RAISED", F.col("score")).otherwise(F.col("best")).alias("best"), verdict.alias("verdict"))


def changed(before: DataFrame, after: DataFrame, by: str, content: Sequence[str]) -> DataFrame:
    """(by, verdict): groups whose rows' content is NEW, GONE or CHANGED, compared by two sums of row hashes and the count.

    The order of rows does not matter, so nothing is gathered or sorted.
    """
    row = F.xxhash64(*content)
    digest = lambda df, name: df.groupBy(by).agg(F.struct(F.count("*"), F.sum(row.cast("decimal(38,0)")), F.sum(F.xxhash64(F.lit(1), *content).cast("decimal(38,0)"))).alias(name))
    j = digest(before, "b").join(digest(after, "a"), by, "full_outer")
    verdict = F.when(F.col("b").isNull(), "NEW").when(F.col("a").isNull(), "GONE").when(F.col("a") != F.col("b"), "CHANGED")
    return j.select(by, verdict.alias("verdict")).where("verdict is not null")


def still_valid(reviews: DataFrame, current: DataFrame, key: Sequence[str], content: str) -> DataFrame:
    """reviews with valid: the content hash they were made for is the current one; a row that is gone has none."""
    now = current.select(*key, F.col(content).alias("_now"))
    return reviews.join(now, list(key), "left").withColumn("valid", F.coalesce(F.col(content) == F.col("_now"), F.lit(False))).drop("_now")


def promoted(rows: DataFrame, own: Column, fresh: DataFrame) -> DataFrame:
    """rows without those that are one's own (also not where that is unknown), and the fresh ones in their place."""
    return rows.where(~F.coalesce(own, F.lit(False))).unionByName(fresh)


def panel(hits: DataFrame, candidate: str, row: str, level: str) -> DataFrame:
    """(candidate, high, ambiguous, exclusive): rows hit at either level, and rows that no other candidate hits."""
    alone = hits.groupBy(row).agg(F.count_distinct(candidate).alias("n")).where("n = 1").select(row, F.lit(1).alias("_alone"))
    one = hits.groupBy(candidate, row).agg(F.max(F.when(F.col(level) == "HIGH", 1).otherwise(0)).alias("_high"))
    j = one.join(alone, row, "left")
    return j.groupBy(candidate).agg(F.sum("_high").alias("high"), F.sum(1 - F.col("_high")).alias("ambiguous"), F.coalesce(F.sum("_alone"), F.lit(0)).cast("long").alias("exclusive"))


def precision(found: DataFrame, truth: DataFrame, key: str, by: str) -> DataFrame:
    """(by, n, right, precision): findings of a class, and those whose key is in the truth."""
    known = truth.select(key).distinct().withColumn("_there", F.lit(1))
    out = found.join(known, key, "left").groupBy(by).agg(F.count("*").alias("n"), F.count("_there").alias("right"))
    return out.withColumn("precision", F.round(F.col("right") / F.col("n"), 6))


def rate(rows: DataFrame, control: Column, finding: Column, by: Sequence[str] = ()) -> DataFrame:
    """(by, control, findings, rate) over the control rows; a group without any has rate 0."""
    out = rows.groupBy(*by).agg(F.count_if(control).alias("control"), F.count_if(control & finding).alias("findings"))
    return out.withColumn("rate", F.round(F.coalesce(F.try_divide(F.col("findings"), F.col("control")), F.lit(0.0)), 6))


def state_census(trials: DataFrame, by: str, state: Sequence[str], baseline: Column) -> DataFrame:
    """(by, states, trials, as_baseline): distinct outcomes of a group's trials, its baseline's being one of them."""
    outcome = F.struct(*state)
    base = F.min(F.when(baseline, outcome))
    first = trials.groupBy(by).agg(base.alias("_base"), F.count_distinct(outcome).alias("states"), F.count_if(~baseline).alias("trials"))
    same = trials.where(~baseline).select(by, outcome.alias("_state")).join(first.select(by, "_base"), by).where("_state = _base").groupBy(by).agg(F.count("*").alias("as_baseline"))
    return first.drop("_base").join(same, by, "left").fillna(0, ["as_baseline"])


def longest_runs(rows: DataFrame, by: Sequence[str], order: str, category: str, size: str) -> DataFrame:
    """(category, n, bytes, longest): the longest run is of rows that follow each other in order within a space."""
    w = Window.partitionBy(*by).orderBy(order)
    opens = F.when(F.lag(category).over(w).eqNullSafe(F.col(category)), 0).otherwise(1)
    runs = rows.withColumn("_new", opens).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    per = runs.groupBy(*by, category, "_run").agg(F.count("*").alias("k"), F.sum(size).alias("b"))
    return per.groupBy(category).agg(F.sum("k").alias("n"), F.sum("b").alias("bytes"), F.max("k").alias("longest"))


def queue(rows: DataFrame, wave: str, score: str, address: str, ident: str) -> DataFrame:
    """rows with place, from 1 in each wave: unknown scores and addresses come last, then by the ident."""
    w = Window.partitionBy(wave).orderBy(F.asc_nulls_last(score), F.asc_nulls_last(address), ident)
    return rows.withColumn("place", F.row_number().over(w).cast("long"))


def every(rows: DataFrame, by: str, order: str, stride: int) -> DataFrame:
    """Each stride-th row of a group in order, the first one included: a sample by design."""
    w = Window.partitionBy(by).orderBy(order)
    return rows.withColumn("_n", F.row_number().over(w)).where((F.col("_n") - 1) % stride == 0).drop("_n")


def first_with_rest(rows: DataFrame, by: str, order: str, most: int) -> DataFrame:
    """(by, shown, more): the first `most` values of a group in order, and how many more there are."""
    w = Window.partitionBy(by).orderBy(order)
    top = rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", F.col(order).alias("v")))), lambda s: s["v"]).alias("shown"))
    return rows.groupBy(by).agg(F.count("*").alias("all")).join(top, by).select(by, "shown", (F.col("all") - F.size("shown")).alias("more"))


def covered(candidates: DataFrame, rows: DataFrame, scope: Sequence[str], symbol: str) -> DataFrame:
    """candidates with covered: a row of the same scope has their symbol or `*`; two equi joins instead of one with OR."""
    exact = rows.select(*scope, symbol).distinct().withColumn("_one", F.lit(True))
    whole = rows.where(F.col(symbol) == "*").select(*scope).distinct().withColumn("_all", F.lit(True))
    j = candidates.join(exact, [*scope, symbol], "left").join(whole, list(scope), "left")
    return j.withColumn("covered", F.coalesce("_one", "_all", F.lit(False))).drop("_one", "_all")


def neighbours_that_share(rows: DataFrame, by: Sequence[str], order: str, values: str) -> DataFrame:
    """(by, order, following, shared): rows and the next one in order whose value sets meet."""
    w = Window.partitionBy(*by).orderBy(order)
    j = rows.withColumn("following", F.lead(order).over(w)).withColumn("_next", F.lead(values).over(w)).where(F.arrays_overlap(values, "_next"))
    return j.select(*by, order, "following", F.array_sort(F.array_intersect(values, "_next")).alias("shared"))


def in_ranges(points: DataFrame, ranges: DataFrame, by: Sequence[str], at: str) -> DataFrame:
    """ranges (by, lo, hi, id) with points: how many stand in [lo, hi); also those without any."""
    from tallyframe.operators.intervals import overlaps

    p = points.groupBy(*by, F.col(at).alias("lo")).agg(F.count("*").alias("k")).withColumn("hi", F.col("lo") + 1)
    n = overlaps(ranges.select(*by, "lo", "hi", "id"), p, by).groupBy(F.col("l_id").alias("id")).agg(F.sum("r_k").alias("points"))
    return ranges.join(n, "id", "left").fillna(0, ["points"])


def section(rows: DataFrame, by: Sequence[str], order: Sequence[str], heading: Column, name: str) -> DataFrame:
    """rows with the value of the last heading at or before them; null before the first."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(heading, ignorenulls=True).over(w))


def spellings(names: DataFrame, key: str, name: str) -> DataFrame:
    """(spelling, keys): every key that a name may mean by its whole spelling, or by the member after its last `::`."""
    member = F.element_at(F.split(F.col(name), "::"), -1)
    s = names.select(key, F.explode(F.array_distinct(F.array(F.col(name), member))).alias("spelling"))
    return s.groupBy("spelling").agg(F.array_sort(F.collect_set(key)).alias("keys"))
