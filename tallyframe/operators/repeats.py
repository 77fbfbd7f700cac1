"""Maximal repeated runs of token sequences, by suffix ranks that double and common prefixes of neighbours."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.operators.graph import cut


def ranks(tokens: DataFrame) -> list[DataFrame]:
    """(unit, pos, rank) for windows of 1, 2, 4, ... tokens (unit, pos from 0 without holes, token): equal windows have one rank.

    Each level joins a rank with that of the window behind it; what ends with its unit comes first. The last level tells
    all suffixes of a unit apart and ranks them in order; levels are as the logarithm of the longest repeated run.
    """
    place = lambda *by: F.dense_rank().over(Window.partitionBy("unit").orderBy(*by))
    levels = [cut(tokens.select("unit", F.col("pos").cast("long").alias("pos"), place("token").cast("long").alias("rank")))]
    n, size = levels[0].count(), 1
    while levels[-1].select("unit", "rank").distinct().count() < n:
        now = levels[-1]
        behind = now.select("unit", (F.col("pos") - size).alias("pos"), F.col("rank").alias("_next"))
        j = now.join(behind, ["unit", "pos"], "left").withColumn("_next", F.coalesce("_next", F.lit(0)))
        levels.append(cut(j.select("unit", "pos", place("rank", "_next").cast("long").alias("rank"))))
        size *= 2
    return levels


def neighbours(levels: list[DataFrame]) -> DataFrame:
    """(unit, pos, rank, lcp): suffixes in order, with the length of the prefix that each shares with the one before it."""
    w = Window.partitionBy("unit").orderBy("rank")
    pairs = levels[-1].withColumn("_other", F.lag("pos").over(w)).withColumn("lcp", F.lit(0).cast("long"))
    for k in range(len(levels) - 1, -1, -1):
        one = levels[k].select("unit", F.col("pos").alias("_p"), F.col("rank").alias("_one"))
        two = levels[k].select("unit", F.col("pos").alias("_q"), F.col("rank").alias("_two"))
        pairs = pairs.withColumn("_p", F.col("pos") + F.col("lcp")).withColumn("_q", F.col("_other") + F.col("lcp"))
        pairs = pairs.join(one, ["unit", "_p"], "left").join(two, ["unit", "_q"], "left")
        same = F.coalesce(F.col("_one") == F.col("_two"), F.lit(False))
        pairs = cut(pairs.withColumn("lcp", F.col("lcp") + F.when(same, 1 << k).otherwise(0)).drop("_p", "_q", "_one", "_two"))
    return pairs.drop("_other")


def intervals(pos: Sequence[int], lcp: Sequence[int], left: Sequence[int], least: int) -> Iterator[tuple[int, int, int]]:
    """(length, copies, first occurrence) of the maximal runs of one unit; its suffixes are in order, left is what precedes each.

    A run is a node of the suffix tree. An occurrence is a copy of it if another one differs both in what follows (lies
    below another child) and in what precedes; all are, but those below a child outside of which everything is preceded
    by the same token as they are. Counts by what precedes are merged into the largest child's, so that all takes n log n.
    """
    stack: list[tuple[int, list]] = []

    def close(children: list) -> tuple[int, dict[int, int], int, int]:
        """Its copies, counts by what precedes, occurrences, first one."""
        children.sort(key=lambda c: len(c[0]), reverse=True)
        total = sum(c[1] for c in children)
        counts, rest = children[0][0], {}
        own = dict(counts) if len(counts) == 1 else None  # the largest child's, if it is of one kind
        for c, _, _ in children[1:]:
            for k, v in c.items():
                rest[k] = rest.get(k, 0) + v
        none = 0
        if len(rest) == 1:  # all outside the largest child
            none += counts.get(next(iter(rest)), 0)
        if own:  # all outside another child: the largest one's kind, and no other among the rest of them
            kind = next(iter(own))
            others = sum(v for k, v in rest.items() if k != kind)
            for c, _, _ in children[1:]:
                if others == sum(v for k, v in c.items() if k != kind):
                    none += c.get(kind, 0)
        for k, v in rest.items():
            counts[k] = counts.get(k, 0) + v
        return total - none, counts, total, min(c[2] for c in children)

    for k in range(len(pos)):
        last = ({left[k]: 1}, 1, pos[k])
        depth = lcp[k + 1] if k + 1 < len(pos) else 0
        depth = depth if depth >= least else 0
        while stack and stack[-1][0] > depth:
            length, children = stack.pop()
            children.append(last)
            copies, counts, total, first = close(children)
            if copies:
                yield length, copies, first
            last = (counts, total, first)
        if depth and (not stack or stack[-1][0] < depth):
            stack.append((depth, [last]))
        elif depth:
            stack[-1][1].append(last)


def maximal_runs(tokens: DataFrame, least: int = 4, terminal: Column | None = None) -> DataFrame:
    """(unit, length, copies, at, last, kind): runs of `least` tokens or more that a unit has twice, and could not have longer.

    tokens: unit, pos (from 0 without holes), token. copies counts the places where the run stands and, against another of
    them, can be extended neither way; at is where it stands first, last its last token. kind is suffix where `terminal`
    (of token) holds for that one, as the copies then leave alike, else prefix. Places may overlap.

    Ranks and prefixes are joins; the tree of a unit is walked in one task, over its suffixes that share `least` tokens
    with a neighbour.
    """
    levels = ranks(tokens)
    before = levels[0].select("unit", (F.col("pos") + 1).alias("pos"), F.col("rank").alias("_left"))
    w = Window.partitionBy("unit").orderBy("rank")
    told = neighbours(levels).join(before, ["unit", "pos"], "left").withColumn("_left", F.coalesce("_left", F.lit(-1)))
    shared = told.withColumn("_after", F.coalesce(F.lead("lcp").over(w), F.lit(0))).where(F.greatest("lcp", "_after") >= least)
    unit_type = tokens.schema["unit"].dataType.simpleString()

    def run(key, table):
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("rank", "pos", "lcp", "_left"))))
        found = list(intervals([r[1] for r in rows], [r[2] for r in rows], [r[3] for r in rows], least))
        columns = list(zip(*found)) or [(), (), ()]
        return pa.Table.from_arrays([pa.array([key[0].as_py()] * len(found), key[0].type), *[pa.array(c, pa.int64()) for c in columns]], names=["unit", "length", "copies", "at"])

    runs = shared.groupBy("unit").applyInArrow(run, f"unit {unit_type}, length long, copies long, at long")
    ends = tokens.select("unit", F.col("pos").cast("long").alias("_end"), F.col("token").alias("last"), (F.lit(False) if terminal is None else terminal).alias("_terminal"))
    j = runs.withColumn("_end", F.col("at") + F.col("length") - 1).join(ends, ["unit", "_end"])
    return j.select("unit", "length", "copies", "at", "last", F.when(F.col("_terminal"), "suffix").otherwise("prefix").alias("kind"))
