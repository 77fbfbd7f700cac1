"""What is swept in cells is what is swept at once, and one space is the work of many tasks."""

import random

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import intervals as iv


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(8)
    places = lambda n: [(rnd.choice(["a", "b", None]), rnd.choice([rnd.randint(-40, 400), rnd.randint(0, 10), 10**15 + rnd.randint(0, 9)]), i) for i in range(n)]
    r = spark.createDataFrame([(s, lo, lo + rnd.choice([0, 1, 3, 9, 150]), i) for s, lo, i in places(400)], "s string, lo long, hi long, id int")
    return r, spark.createDataFrame(places(60), "s string, lo long, id int")


@pytest.mark.parametrize("width", [1, 7, 64, 10**6])
def test_cells_change_nothing(rows, width):
    r, a = rows
    same = lambda f: sorted(map(repr, f(None).collect())) == sorted(map(repr, f(width).collect()))
    assert same(lambda w: iv.extents(r, ["s"], "lo", F.lit(10**16), ["id"], width=w).select("s", "lo", "hi", "id", "size"))
    for forward in (False, True):
        assert same(lambda w: iv.asof(r, a, ["s"], "lo", ["id"], forward, ["anchor_id"], width=w))
    for tolerance in (0, 8):
        assert same(lambda w: iv.coalesce(r, ["s"], "lo", "hi", tolerance, [F.sum("id").alias("ids")], width=w))
    assert same(lambda w: iv.stride_runs(r.select("s", "lo").distinct(), ["s"], "lo", 1, width=w))
    assert same(lambda w: iv.gaps(iv.coalesce(r, ["s"], "lo", "hi", width=w), ["s"], w))
    assert same(lambda w: iv.coalesce(r.drop("s"), [], "lo", "hi", width=w))


def test_rows_without_a_place_take_no_part(spark):
    df = spark.createDataFrame([(None, None, 1), (None, 3, 5), (None, 9, 9)], "s string, lo long, hi long")
    assert [tuple(r) for r in iv.coalesce(df, ["s"], "lo", "hi", width=2).orderBy("lo").collect()] == [(None, 1, 3, 5, 1), (None, 2, 9, 9, 1)]


def test_no_window_takes_a_whole_space_of_rows(spark, rows):
    """Windows over rows are partitioned by cell; the one by space alone has a row a cell."""
    plan = iv.coalesce(rows[0], ["s"], "lo", "hi", width=64)._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.splitlines() if "Window [" in x]
    by_space = [x for x in windows if "_cell" not in x.rsplit("], [", 2)[1]]
    assert len(by_space) == 3 and len(windows) == 6 and all("_sum" in x for x in by_space)
