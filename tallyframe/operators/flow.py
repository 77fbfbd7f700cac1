"""Control flow and data flow of instruction tables: basic blocks, their edges, dominance, loops, reaching definitions.

code has one row an instruction: unit, at (its place in the unit), targets (array of places it may branch to, null or empty
for none) and falls (whether the next instruction may follow it). Windows are partitioned by unit and sort its
instructions; nothing gathers a unit, and fixed points are reached by joins of what a round has found, written to the shared
folder each time. Rounds follow the graph of blocks at which paths meet: blocks with one predecessor are skipped over by
pointers that double, so a long straight unit takes no more rounds than a short one.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.operators.graph import kept, terminals


def blocks(code: DataFrame) -> DataFrame:
    """code with block, from 1: a block begins at a unit's first instruction, at a target, and after one that branches or does not fall."""
    w = Window.partitionBy("unit").orderBy("at")
    aimed = code.select("unit", F.explode("targets").alias("at")).distinct().withColumn("_aimed", F.lit(True))
    ends = (F.size(F.coalesce("targets", F.array().cast(code.schema["targets"].dataType))) > 0) | ~F.col("falls")
    leads = F.coalesce(F.lag(ends).over(w), F.lit(True)) | F.col("_aimed").isNotNull()
    marked = code.join(aimed, ["unit", "at"], "left").withColumn("_leads", leads.cast("long"))
    return marked.withColumn("block", F.sum("_leads").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_aimed", "_leads")


def edges(blocked: DataFrame) -> DataFrame:
    """(unit, src, dst, kind): edges between blocks, `jump` to a target in the unit and `fall` to the next block, each once.

    A target that is no instruction of its unit makes no edge.
    """
    last = F.max(F.struct("at", "targets", "falls"))
    ends = blocked.groupBy("unit", "block").agg(last.alias("e")).select("unit", F.col("block").alias("src"), "e.targets", "e.falls")
    heads = blocked.select("unit", F.col("at").alias("target"), F.col("block").alias("dst"))
    jumps = ends.select("unit", "src", F.explode("targets").alias("target")).join(heads, ["unit", "target"]).select("unit", "src", "dst", F.lit("jump").alias("kind")).distinct()
    some = blocked.select("unit", F.col("block").alias("dst")).distinct()
    falls = ends.where("falls").select("unit", "src", (F.col("src") + 1).alias("dst")).join(some, ["unit", "dst"]).select("unit", "src", "dst", F.lit("fall").alias("kind"))
    return jumps.unionByName(falls)


def chains(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """nodes (unit, block) with head and hops: the first block of the chain of lone predecessors that leads to each.

    Chains begin at the entry, block 1, and at blocks with several predecessors. Blocks that no chain leads to are left out.
    """
    name = lambda b: F.struct("unit", F.col(b).alias("block"))
    one = links.groupBy("unit", "dst").agg(F.count("*").alias("n"), F.min("src").alias("src")).where("n = 1 and dst > 1")
    led = terminals(one.select(name("dst").alias("node"), name("src").alias("next"))).select("node.*", F.col("target.block").alias("head"), "hops")
    own = nodes.join(one.select("unit", F.col("dst").alias("block")), ["unit", "block"], "left_anti")
    return led.unionByName(own.select("unit", "block", F.col("block").alias("head"), F.lit(0).cast("long").alias("hops")))


#: Rounds after which what they found is written as one table, so that plans and tasks of a round stay few.
TOGETHER = 8


def avoided(nodes: DataFrame, links: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """chains(), and (unit, head, without): heads of chains that a path from the entry reaches without passing a block.

    without is 0 for heads that are reached at all, else a block of asked (unit, by). A least fixed point: what a round finds anew is joined to the edges
    that lead to where paths meet. Pairs are as many as heads times blocks of a unit at most.
    """
    chain = kept(chains(nodes, links))
    src = chain.select("unit", F.col("block").alias("src"), "head", "hops")
    meets = chain.where("hops = 0").select("unit", F.col("block").alias("dst"))
    steps = kept(links.select("unit", "src", "dst").distinct().join(src, ["unit", "src"]).join(meets, ["unit", "dst"]).select("unit", "head", "hops", "dst"))
    places = chain.select("unit", F.col("block").alias("without"), F.col("head").alias("w_head"), F.col("hops").alias("w_hops"))
    places = places.join(asked.select("unit", F.col("by").alias("without")).distinct(), ["unit", "without"], "left_semi")
    none = nodes.select("unit").distinct().select("unit", F.lit(0).cast("long").alias("without"), F.lit(0).cast("long").alias("w_head"), F.lit(0).cast("long").alias("w_hops"))
    every = places.unionByName(none)
    known = frontier = kept(every.where("without <> 1").withColumn("head", F.lit(1).cast("long")))
    for turn in count(1):
        if frontier.isEmpty():
            break
        passed = frontier.join(steps, ["unit", "head"]).where("dst <> without and not (w_head = head and w_hops <= hops)")
        new = passed.select("unit", F.col("dst").alias("head"), "without", "w_head", "w_hops").distinct()
        frontier = kept(new.join(known.select("unit", "head", "without"), ["unit", "head", "without"], "left_anti"))
        known = known.unionByName(frontier)
        known = known if turn % TOGETHER else kept(known.coalesce(known.sparkSession.sparkContext.defaultParallelism))
    return chain, known.select("unit", "head", "without")


def dominated(nodes: DataFrame, links: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (unit, block, by) with dominates: every path from the entry to the block passes `by`; null for a block without a path."""
    chain, free = avoided(nodes, links, asked)
    by = chain.select("unit", F.col("block").alias("by"), F.col("head").alias("_by_head"), F.col("hops").alias("_by_hops"))
    j = asked.join(chain, ["unit", "block"], "left").join(by, ["unit", "by"], "left")
    reached = free.where("without = 0").select("unit", "head", F.lit(True).alias("_reached"))
    without = free.where("without > 0").select("unit", "head", F.col("without").alias("by"), F.lit(True).alias("_free"))
    j = j.join(reached, ["unit", "head"], "left").join(without, ["unit", "head", "by"], "left")
    on_way = F.coalesce((F.col("_by_head") == F.col("head")) & (F.col("_by_hops") <= F.col("hops")), F.lit(False))
    return j.select(*asked.columns, F.when(F.col("_reached"), on_way | F.col("_free").isNull()).alias("dominates"))


def loop_heads(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(unit, head, latch, natural): edges from a block to one that is not after it; natural if that one dominates it."""
    back = links.where("dst <= src").select("unit", F.col("src").alias("block"), F.col("dst").alias("by")).distinct()
    told = dominated(nodes, links, back)
    return told.select("unit", F.col("by").alias("head"), F.col("block").alias("latch"), F.coalesce("dominates", F.lit(False)).alias("natural"))


def in_edges(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(unit, block, preds, succs, sources): how many edges lead to and from a block, and how many blocks lead to it."""
    into = links.groupBy("unit", F.col("dst").alias("block")).agg(F.count("*").alias("preds"), F.count_distinct("src").alias("sources"))
    out = links.groupBy("unit", F.col("src").alias("block")).agg(F.count("*").alias("succs"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return nodes.join(into, ["unit", "block"], "left").join(out, ["unit", "block"], "left").select("unit", "block", zero("preds"), zero("succs"), zero("sources"))


def reaching(blocked: DataFrame, links: DataFrame, name: str = "defines", uses: str = "uses") -> DataFrame:
    """(unit, at, reg, def_at): every use of a register with each definition that reaches it; def_at is null if none does.

    blocked: code with block, the register an instruction defines (or null) and an array of those it uses, which it reads
    before it defines. Within a block the last definition before a use is the only one, by a segmented scan. What a block
    defines last leaves it; a register that it does not define passes through it with all definitions that come in.
    """
    w = Window.partitionBy("unit", "block", "reg").orderBy("at", "_defines").rowsBetween(Window.unboundedPreceding, -1)
    used = blocked.select("unit", "block", "at", F.explode(F.array_distinct(uses)).alias("reg"), F.lit(0).alias("_defines")).where("reg is not null")
    defined = blocked.where(F.col(name).isNotNull()).select("unit", "block", "at", F.col(name).alias("reg"), F.lit(1).alias("_defines"))
    scanned = used.unionByName(defined).withColumn("def_at", F.max(F.when(F.col("_defines") == 1, F.col("at"))).over(w))
    asked = kept(scanned.where("_defines = 0").drop("_defines"))
    leaves = kept(defined.groupBy("unit", "block", "reg").agg(F.max("at").alias("def_at")))
    # Only registers that some use looks for beyond its block travel.
    wanted = asked.where("def_at is null").select("unit", "reg").distinct()
    way = links.select("unit", F.col("src").alias("block"), F.col("dst").alias("_to")).distinct()
    ahead = lambda found: found.join(way, ["unit", "block"]).select("unit", F.col("_to").alias("block"), "reg", "def_at").distinct()
    known = frontier = kept(ahead(leaves.join(wanted, ["unit", "reg"])))
    stops = leaves.select("unit", "block", "reg")
    for turn in count(1):
        if frontier.isEmpty():
            break
        passed = frontier.join(stops, ["unit", "block", "reg"], "left_anti")
        frontier = kept(ahead(passed).join(known, ["unit", "block", "reg", "def_at"], "left_anti"))
        known = known.unionByName(frontier)
        known = known if turn % TOGETHER else kept(known.coalesce(known.sparkSession.sparkContext.defaultParallelism))
    inside = asked.where("def_at is not null").select("unit", "at", "reg", "def_at")
    outside = asked.where("def_at is null").drop("def_at").join(known, ["unit", "block", "reg"], "left").select("unit", "at", "reg", "def_at")
    return inside.unionByName(outside)
