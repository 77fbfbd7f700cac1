"""Sweeps along an ordered space by many tasks: cells of a fixed width are swept apart, then what each hands on is added.

A space (`by`) is cut into cells by place, so that no task has more rows than a cell. Each cell is summed up in a row; a
window over these rows, a cell each, says what the cells before (or after) hand on to every cell; each row then has the
result within its cell and what is handed on. Rows without a place take no part.

Rows are dealt out by space and cell once: the windows, the sums and the join of what is handed on need the same layout.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPACE, CELL = "_space", "_cell"


def celled(rows: DataFrame, by: Sequence[str], at: str, width: int) -> DataFrame:
    """rows with their space, null values being values too, and cell."""
    space = F.struct(*by) if by else F.struct(F.lit(1))
    return rows.where(F.col(at).isNotNull()).withColumn(SPACE, space).withColumn(CELL, F.floor(F.col(at) / F.lit(width)).cast("long"))


def inside(*order) -> Window:
    return Window.partitionBy(SPACE, CELL).orderBy(*order)


def handed_on(rows: DataFrame, summary: Column, fold, backward: bool = False) -> DataFrame:
    """celled rows with _on: fold over the summaries of all cells before theirs (after it: backward), nearest last."""
    order = F.col(CELL).desc() if backward else F.col(CELL).asc()
    across = Window.partitionBy(SPACE).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    cells = rows.groupBy(SPACE, CELL).agg(summary.alias("_sum")).select(SPACE, CELL, fold("_sum").over(across).alias("_on"))
    return rows.join(cells, [SPACE, CELL])


def done(rows: DataFrame, *more: str) -> DataFrame:
    return rows.drop(SPACE, CELL, "_on", *more)


def last_known(rows: DataFrame, value: Column, order: Sequence[Column], rank: Column, name: str, backward: bool = False) -> DataFrame:
    """celled rows with the last value that is not null up to each, in the given order; rank puts values into the same order."""
    best = (F.min_by if backward else F.max_by)("_value", F.when(F.col("_value").isNotNull(), rank))
    out = handed_on(rows.withColumn("_value", value), best, lambda c: F.last(c, ignorenulls=True), backward)
    own = F.last("_value", ignorenulls=True).over(inside(*order).rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn(name, F.coalesce(own, F.col("_on"))).drop("_on", "_value")


def highest_before(rows: DataFrame, value: str, order: Sequence[str], name: str) -> DataFrame:
    """celled rows with the highest value of all rows before each."""
    own = F.max(value).over(inside(*order).rowsBetween(Window.unboundedPreceding, -1))
    return handed_on(rows, F.max(value), F.max).withColumn(name, F.greatest(own, F.col("_on"))).drop("_on")


def running_sum(rows: DataFrame, value: Column, order: Sequence[str], name: str) -> DataFrame:
    """celled rows with the sum of the values up to each and those equal to it in order, which so all have the same."""
    rows = rows.withColumn("_value", value)
    own = F.sum("_value").over(inside(*order).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return handed_on(rows, F.sum("_value"), F.sum).withColumn(name, own + F.coalesce("_on", F.lit(0))).drop("_on", "_value")


def next_place(rows: DataFrame, at: str, order: Sequence[str], name: str) -> DataFrame:
    """celled rows with the place of the row after each, null for the last of a space."""
    out = handed_on(rows, F.min(at), lambda c: F.last(c), backward=True)
    return out.withColumn(name, F.coalesce(F.lead(at).over(inside(*order)), F.col("_on"))).drop("_on")
