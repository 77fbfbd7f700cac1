"""Connected components of a link table, by rounds of joins.

Each round replaces links by links to smaller ends (large star, then small star); the longest path shrinks as its
logarithm. No node's links are ever gathered in one place: a round takes minima by node and joins them back. Only a
table of counted, bounded size is done by one task, to the same result.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm import common

MOST_ROUNDS = 60
#: Links that one task holds, some tens of MB.
AT_ONCE = 1 << 18


def _star(both: DataFrame) -> DataFrame:
    """both (u, v): v is a neighbour of u. Each u with its smallest neighbour, itself included."""
    return both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _in_one_task(edges: DataFrame) -> DataFrame:
    """Components of at most AT_ONCE edges (u, v) by union and find."""

    def run(batches):
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while (y := up.setdefault(x, x)) != x:
                up[x] = up[y]
                x = y
            return x

        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x, y = top(x), top(y)
                up[max(x, y)] = min(x, y)
        nodes = list(up)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([top(x) for x in nodes], pa.int64())], ["node", "component"])

    return edges.coalesce(1).mapInArrow(run, "node long, component long")


def components(links: DataFrame) -> DataFrame:
    """links (a, b) of longs; returns (node, component), component the smallest node reachable, for nodes with links."""
    edges = common.stash(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    if edges.count() <= AT_ONCE:
        return _in_one_task(edges)
    before = None
    for _ in range(MOST_ROUNDS):
        # Large star: each neighbour above u is linked to u's smallest instead.
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = common.stash(_star(both))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = common.stash(large)
        # Small star: u and its neighbours below it are linked to the smallest of them.
        low = common.stash(_star(large))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionAll(low.where("u <> m").select("u", F.col("m").alias("v"))).distinct()
        edges = common.stash(small)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components: no fixed point")
    return edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.col("m").alias("component")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
