"""Graph operators on edge tables (src, dst): multiplicities, forwarders, reachability, ancestors, closures.

Iterations run to a fixed point, in steps that double where the result allows it, or as deep as the caller asks; each round's result is
written to the checkpoint folder, so plans stay short and a lost executor costs one round.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce
from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """The checkpoint folder, in the shared one the session names; a temporary one only where it names none and is a local one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tallyframe-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint in the shared folder."""
    folder(df.sparkSession)
    return df.checkpoint(eager=True)


def kept(df: DataFrame) -> DataFrame:
    """What a round of an iteration found, written as a table in the shared folder, which goes when the driver's JVM ends.

    A checkpoint keeps its plan's estimate of its size, which every join multiplies: round by round it becomes a number of
    so many digits that it fills the driver. A table has the size of its files, written plainly, as large as its rows.
    """
    spark = df.sparkSession
    at = f"{folder(spark)}/tallyframe-{uuid.uuid4().hex}"
    df.write.option("compression", "uncompressed").option("parquet.enable.dictionary", "false").parquet(at)
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(at)


def callers(edges: DataFrame) -> DataFrame:
    """(dst, src, n): who refers to a node, how often."""
    return edges.groupBy("dst", "src").agg(F.count("*").alias("n"))


def chase(edges: DataFrame, forwards: DataFrame, hops: int = 4) -> DataFrame:
    """edges with target and hops: each dst followed through forwards (node, next) at most `hops` times."""
    out = edges.withColumn("target", F.col("dst")).withColumn("hops", F.lit(0))
    for _ in range(hops):
        step = forwards.select(F.col("node").alias("target"), F.col("next").alias("_next"))
        out = out.join(step, "target", "left").withColumn("hops", F.col("hops") + F.when(F.col("_next").isNotNull(), 1).otherwise(0)).withColumn("target", F.coalesce("_next", "target")).drop("_next")
    return out


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes (node, depth) that roots (node) lead to, roots included at depth 0."""
    links = edges.select("src", "dst").distinct()
    known = frontier = cut(roots.select("node").distinct().withColumn("depth", F.lit(0)))
    for depth in count(1):
        step = frontier.join(links, frontier["node"] == links["src"]).select(F.col("dst").alias("node")).distinct()
        frontier = cut(step.join(known, "node", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            return known
        known = known.unionByName(frontier)


def ancestors(edges: DataFrame, starts: DataFrame, depth: int = 4) -> DataFrame:
    """(start, ancestor, depth): nodes that lead to each start (node) in at most `depth` steps, at their least depth."""
    links = edges.select("src", "dst").distinct()
    known = frontier = starts.select(F.col("node").alias("start"), F.col("node").alias("ancestor")).distinct().withColumn("depth", F.lit(0))
    for level in range(1, depth + 1):
        step = frontier.join(links, frontier["ancestor"] == links["dst"]).select("start", F.col("src").alias("ancestor")).distinct()
        frontier = cut(step.join(known, ["start", "ancestor"], "left_anti").withColumn("depth", F.lit(level)))
        known = known.unionByName(frontier)
    return known.where("depth > 0")


def roots_of(parents: DataFrame) -> DataFrame:
    """(node, root, depth) of parents (node, parent; parent null at a root), by following parents to the top.

    Steps double each round. What leads into a circle has no root and is left out; a parent that is no node is a root.
    """
    led = terminals(parents.where("parent is not null").select("node", F.col("parent").alias("next")))
    tops = parents.where("parent is null").select("node", F.col("node").alias("root"), F.lit(0).alias("depth"))
    return led.select("node", F.col("target").alias("root"), F.col("hops").cast("int").alias("depth")).unionByName(tops)


def callees(edges: DataFrame, indirect: str) -> DataFrame:
    """(src, callees, sites, indirect): nodes a source refers to, how often, and at how many indirect sites, which name none."""
    return edges.groupBy("src").agg(F.count_distinct(F.when(~F.col(indirect), F.col("dst"))).alias("callees"), F.count_if(~F.col(indirect)).alias("sites"), F.count_if(F.col(indirect)).alias("indirect"))


def terminals(forwards: DataFrame) -> DataFrame:
    """(node, target, hops) of forwards (node, next), one next a node: where each forwarder leads in the end.

    Steps are doubled each round, so rounds are as the logarithm of the longest chain. What still moves when a step is
    longer than there are forwarders goes in a circle and leads nowhere.
    """
    now = kept(forwards.select("node", F.col("next").alias("target"), F.lit(1).cast("long").alias("hops")))
    count, step = now.count(), 1
    while step <= count:
        on = now.select(F.col("node").alias("target"), F.col("target").alias("_next"), F.col("hops").alias("_more"))
        moved = kept(now.join(on, "target", "left"))
        now = moved.select("node", F.coalesce("_next", "target").alias("target"), (F.col("hops") + F.coalesce("_more", F.lit(0))).alias("hops"))
        if moved.where("_next is not null").isEmpty():
            return now
        step *= 2
    return now.join(now.select(F.col("node").alias("target")), "target", "left_anti")


def effective_incoming(edges: DataFrame, forwards: DataFrame) -> DataFrame:
    """(dst, src, n, hops): who refers to a node in the end, directly or through forwarders, which are no referrers
    themselves; hops is the least number of forwarders between."""
    real = edges.join(forwards.select(F.col("node").alias("src")), "src", "left_anti")
    ends = terminals(forwards).select(F.col("node").alias("dst"), "target", "hops")
    lost = forwards.select(F.col("node").alias("dst"), F.lit(True).alias("_forwards"))
    j = real.join(lost, "dst", "left").join(ends, "dst", "left").where("_forwards is null or target is not null")
    return j.select(F.coalesce("target", "dst").alias("dst"), "src", F.coalesce("hops", F.lit(0)).alias("hops")).groupBy("dst", "src").agg(F.count("*").alias("n"), F.min("hops").alias("hops"))


def closure(edges: DataFrame) -> DataFrame:
    """(src, dst, depth): everything a node includes, at its least depth; circles add nothing new.

    Rounds go one step further from what the last one found, so a pair is made once for each way that its last step may
    go, not for each node between, and they are as many as the depth, which is not capped. What is found is compared with
    all that is known in rounds whose number is a power of two only, and what is known is written anew then: in between a
    pair may come again, deeper, and the least depth is taken at the end.
    """
    links = edges.select("src", "dst").distinct()
    found = [cut(links.withColumn("depth", F.lit(1)))]
    least = lambda rows: rows.groupBy("src", "dst").agg(F.min("depth").alias("depth"))
    frontier = found[0]
    for depth in count(2):
        on = links.select(F.col("src").alias("dst"), F.col("dst").alias("_to"))
        step = frontier.join(on, "dst").select("src", F.col("_to").alias("dst")).distinct()
        known = reduce(DataFrame.unionByName, found)
        if depth & (depth - 1) == 0:
            step = step.join(known, ["src", "dst"], "left_anti")
        frontier = cut(step.withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            return least(known)
        found.append(frontier)
        if depth & (depth - 1) == 0 and depth > 16:
            found = [cut(least(reduce(DataFrame.unionByName, found)))]
