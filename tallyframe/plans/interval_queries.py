"""Queries of the interval operators and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.operators import intervals as iv
from tallyframe.sources.tables import day, table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


#: Widths of cells, by which one space is swept in many tasks.
DAYS, SECONDS, PLACES = 512, 1 << 20, 1 << 16

ORD = "SELECT o_custkey, o_orderkey, date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS start, o_totalprice FROM orders"


def starts(spark, d):
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", day("o_orderdate").alias("start"), "o_totalprice")


def region_end(rows):
    return rows.agg((F.max("start") + 1).alias("region_end"))


@query(f"""WITH o AS ({ORD}) SELECT o_custkey, o_orderkey, start,
  coalesce(lead(start) OVER (PARTITION BY o_custkey ORDER BY start, o_orderkey), (SELECT max(start) + 1 FROM o)) - start AS size FROM o""")
def extent_lead(spark, d):
    o = starts(spark, d)
    return iv.extents(o.crossJoin(F.broadcast(region_end(o))), ["o_custkey"], "start", "region_end", ["o_orderkey"], width=DAYS).select("o_custkey", "o_orderkey", "start", "size")


@query(f"""WITH o AS ({ORD}), e AS (SELECT o_custkey, o_orderkey, start,
  coalesce(lead(start) OVER (PARTITION BY o_custkey ORDER BY start, o_orderkey), (SELECT max(start) + 1 FROM o)) - start AS room FROM o),
x AS (SELECT l_orderkey AS o_orderkey, max(l_linenumber) * 20 AS exact_size FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey)
SELECT o_custkey, o_orderkey, room, CAST(coalesce(exact_size, room) AS BIGINT) AS size, coalesce(exact_size > room, false) AS oversized FROM e LEFT JOIN x USING (o_orderkey)""")
def extent_exact_override(spark, d):
    o = starts(spark, d)
    e = iv.extents(o.crossJoin(F.broadcast(region_end(o))), ["o_custkey"], "start", "region_end", ["o_orderkey"]).select("o_custkey", "o_orderkey", "size")
    exact = table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg((F.max("l_linenumber").cast("long") * 20).alias("exact_size"))
    return iv.with_exact(e, exact, ["o_orderkey"]).select("o_custkey", "o_orderkey", "room", "size", "oversized")


EV = "SELECT event_id, user_id, event_type, value, epoch(ts)::BIGINT AS pos FROM events"


def events(spark, d):
    # Whole seconds as SQL rounds them: to the nearest, halves to the even one.
    pos = F.rint(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).cast("long")
    return table(spark, d, "events").select("event_id", "user_id", "event_type", "value", pos.alias("pos"))


@query(f"""WITH e AS ({EV}), b AS (SELECT user_id, pos AS lo, event_id AS owner, pos + 3600 * (1 + event_id % 5) AS hi FROM e WHERE event_type = 'signup'),
r AS (SELECT e.event_id, arg_max(b.owner, (b.lo, b.owner)) AS owner FROM e JOIN b ON e.user_id = b.user_id AND b.lo <= e.pos AND e.pos < b.hi WHERE event_type <> 'signup' GROUP BY e.event_id)
SELECT event_id, user_id, owner FROM e LEFT JOIN r USING (event_id) WHERE event_type <> 'signup'""")
def point_in_interval(spark, d):
    e = events(spark, d)
    bands = e.where("event_type = 'signup'").select("user_id", F.col("pos").alias("lo"), (F.col("pos") + 3600 * (1 + F.col("event_id") % 5)).alias("hi"), F.col("event_id").alias("owner"))
    return iv.innermost(e.where("event_type <> 'signup'").select("event_id", "user_id", "pos"), bands, ["user_id"], "pos", "owner").select("event_id", "user_id", "owner")


ASOF = """WITH e AS ({ev}) SELECT event_id, user_id, (SELECT {pick}(a.event_id, a.pos) FROM e a WHERE a.user_id = e.user_id AND a.event_type = 'purchase' AND a.pos {cmp} e.pos) AS anchor FROM e WHERE event_type <> 'purchase'"""


def _asof(spark, d, forward):
    e = events(spark, d)
    # Of anchors in one second the first event; SQL leaves it open.
    a = e.where("event_type = 'purchase'").groupBy("user_id", "pos").agg(F.min("event_id").alias("event_id"))
    return iv.asof(e.where("event_type <> 'purchase'").select("event_id", "user_id", "pos"), a, ["user_id"], "pos", ["event_id"], forward, width=SECONDS).select("event_id", "user_id", F.col("anchor_event_id").alias("anchor"))


@query(ASOF.format(ev=EV, pick="arg_max", cmp="<="))
def asof_prev_event(spark, d):
    return _asof(spark, d, False)


@query(ASOF.format(ev=EV, pick="arg_min", cmp=">="))
def asof_next_event(spark, d):
    return _asof(spark, d, True)


RUNS = """WITH i AS (SELECT user_id, event_type, event_id AS lo, event_id + 1 + event_id % {k} AS hi FROM events),
m AS (SELECT *, max(hi) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i),
n AS (SELECT *, CAST(sum(CASE WHEN reach IS NULL OR lo - reach > {tolerance} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM m),
runs AS (SELECT user_id, run, min(lo) AS lo, max(hi) AS hi, count(*) AS parts, count(*) FILTER (event_type = 'view') AS reads, count(*) FILTER (event_type = 'click') AS writes, max(hi - lo) AS max_width FROM n GROUP BY user_id, run)
"""


def spans(spark, d, k):
    return table(spark, d, "events").select("user_id", "event_type", F.col("event_id").alias("lo"), (F.col("event_id") + 1 + F.col("event_id") % k).alias("hi"))


@query(RUNS.format(k=400, tolerance=0) + "SELECT user_id, run, lo, hi, parts FROM runs")
def coalesce_touching(spark, d):
    return iv.coalesce(spans(spark, d, 400), ["user_id"], "lo", "hi", width=PLACES)


@query(RUNS.format(k=200, tolerance=8) + "SELECT user_id, run, lo, hi, parts FROM runs")
def coalesce_gap8(spark, d):
    return iv.coalesce(spans(spark, d, 200), ["user_id"], "lo", "hi", tolerance=8, width=PLACES)


@query(RUNS.format(k=400, tolerance=0) + "SELECT user_id, lo, hi, parts AS sites, reads, writes, max_width FROM runs")
def touched_ranges(spark, d):
    kinds = [F.count_if(F.col("event_type") == "view").alias("reads"), F.count_if(F.col("event_type") == "click").alias("writes"), F.max(F.col("hi") - F.col("lo")).alias("max_width")]
    return iv.coalesce(spans(spark, d, 400), ["user_id"], "lo", "hi", measures=kinds, width=PLACES).select("user_id", "lo", "hi", F.col("parts").alias("sites"), "reads", "writes", "max_width")


@query(RUNS.format(k=300, tolerance=0) + """, g AS (SELECT user_id, hi AS gap_lo, lead(lo) OVER (PARTITION BY user_id ORDER BY lo) AS gap_hi FROM runs)
SELECT user_id, gap_lo, gap_hi, gap_hi - gap_lo AS length, CASE WHEN gap_hi - gap_lo < 8 THEN 'PAD' WHEN gap_lo % 2 = 0 AND gap_hi - gap_lo >= 100 THEN 'POINTER' WHEN gap_lo % 3 = 0 THEN 'NONZERO' ELSE 'ZERO-GAP' END AS verdict FROM g WHERE gap_hi > gap_lo""")
def coverage_gaps_verdict(spark, d):
    g = iv.gaps(iv.coalesce(spans(spark, d, 300), ["user_id"], "lo", "hi"), ["user_id"])
    verdict = F.when(F.col("length") < 8, "PAD").when((F.col("gap_lo") % 2 == 0) & (F.col("length") >= 100), "POINTER").when(F.col("gap_lo") % 3 == 0, "NONZERO").otherwise("ZERO-GAP")
    return g.withColumn("verdict", verdict)


TWO = """WITH a AS (SELECT user_id, event_id AS lo, event_id + 50 + event_id % 90 AS hi, event_id AS id FROM events WHERE event_type = 'click'),
b AS (SELECT user_id, event_id AS lo, event_id + 10 + event_id % 70 AS hi, event_id AS id FROM events WHERE event_type = 'view') """


def two(spark, d):
    e = table(spark, d, "events")
    side = lambda kind, x, y: e.where(F.col("event_type") == kind).select("user_id", F.col("event_id").alias("lo"), (F.col("event_id") + x + F.col("event_id") % y).alias("hi"), F.col("event_id").alias("id"))
    return side("click", 50, 90), side("view", 10, 70)


@query(TWO + """SELECT a.user_id, a.id, CAST(sum(least(a.hi, b.hi) - greatest(a.lo, b.lo)) AS BIGINT) AS bytes, count(*) AS sites FROM a JOIN b ON a.user_id = b.user_id AND a.lo < b.hi AND b.lo < a.hi GROUP BY a.user_id, a.id""")
def interval_overlap_bytes(spark, d):
    a, b = two(spark, d)
    return iv.overlaps(a, b, ["user_id"]).groupBy("user_id", F.col("l_id").alias("id")).agg(F.sum(F.col("hi") - F.col("lo")).alias("bytes"), F.count("*").alias("sites"))


@query(TWO + """, x AS (SELECT DISTINCT user_id, lo, hi FROM a) SELECT p.user_id, p.lo AS a_lo, p.hi AS a_hi, q.lo AS b_lo, q.hi AS b_hi FROM x p JOIN x q ON p.user_id = q.user_id AND (p.lo, p.hi) < (q.lo, q.hi) AND q.lo < p.hi""")
def overlap_pairs(spark, d):
    x = two(spark, d)[0].select("user_id", "lo", "hi").dropDuplicates()
    pairs = iv.overlaps(x, x, ["user_id"]).where("l_lo < r_lo or l_lo = r_lo and l_hi < r_hi")
    return pairs.select("user_id", F.col("l_lo").alias("a_lo"), F.col("l_hi").alias("a_hi"), F.col("r_lo").alias("b_lo"), F.col("r_hi").alias("b_hi"))


@query(TWO + "SELECT user_id, id, lo, hi FROM b WHERE EXISTS (SELECT 1 FROM a WHERE a.user_id = b.user_id AND a.lo <= b.lo AND b.hi <= a.hi)")
def contained_semi(spark, d):
    a, b = two(spark, d)
    inside = iv.overlaps(b, a, ["user_id"]).where("r_lo <= l_lo and l_hi <= r_hi")
    return inside.select("user_id", F.col("l_id").alias("id"), F.col("l_lo").alias("lo"), F.col("l_hi").alias("hi")).dropDuplicates()


@query("""WITH l AS (SELECT o_custkey AS space, o_orderkey AS pos, o_orderpriority AS unit, CAST(1 + o_orderkey % 7 AS BIGINT) AS size FROM orders),
c AS (SELECT *, CASE WHEN lag(unit) OVER (PARTITION BY space ORDER BY pos) IS NOT DISTINCT FROM unit THEN 0 ELSE 1 END AS frag FROM l)
SELECT space, unit, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes, CAST(sum(frag) AS BIGINT) AS frags, max(pos) - min(pos) AS span, round(count(*) / sum(frag)::DOUBLE, 6) AS avg_cluster, round(sum(frag) / count(*)::DOUBLE, 6) AS frag_ratio FROM c GROUP BY space, unit""")
def fragmentation(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("space"), F.col("o_orderkey").alias("pos"), F.col("o_orderpriority").alias("unit"), (1 + F.col("o_orderkey") % 7).alias("size"))
    return iv.fragments(rows, ["pos"], "unit", "size", "pos", ["space"])


LINE_ORDER = "l_linenumber, l_partkey, l_suppkey, l_shipdate"


@query(f"""WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS ship, l_shipdate FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, ship, previous FROM (SELECT *, lag(ship) OVER (PARTITION BY l_orderkey ORDER BY {LINE_ORDER}) AS previous FROM l) WHERE previous > ship""")
def order_violations(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", day("l_shipdate").alias("ship"))
    return iv.order_violations(rows, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"], "ship").drop("l_shipdate")


@query("""WITH o AS (SELECT o_custkey, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)
SELECT DISTINCT o.o_custkey, o.o_orderkey, o.o_orderstatus FROM o JOIN o t ON o.o_custkey = t.o_custkey AND t.o_orderstatus = 'P' AND abs(o.n - t.n) <= 3""")
def neighbor_window(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return iv.neighbours(rows, ["o_custkey"], ["o_orderkey"], F.col("o_orderstatus") == "P", 3)


@query("""SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS DISTINCT FROM event_type""")
def dup_collapse(spark, d):
    return iv.collapse(table(spark, d, "events").select("event_id", "user_id", "event_type", "ts"), ["user_id"], ["ts", "event_id"], "event_type").drop("ts")


@query("""WITH k AS (SELECT event_type, event_id AS pos, event_id % 2 AS lane FROM events), i AS (SELECT *, pos - 2 * row_number() OVER (PARTITION BY event_type, lane ORDER BY pos) AS island FROM k)
SELECT event_type, lane, min(pos) AS lo, max(pos) AS hi, count(*) AS n FROM i GROUP BY event_type, lane, island""")
def stride_runs(spark, d):
    rows = table(spark, d, "events").select("event_type", F.col("event_id").alias("pos"), (F.col("event_id") % 2).alias("lane"))
    return iv.stride_runs(rows, ["event_type", "lane"], "pos", 2, width=PLACES)


@query("""WITH e AS (SELECT event_id, user_id, event_type, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS opens, ts FROM events),
r AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM e),
p AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) - 1 AS place FROM r)
SELECT user_id, CAST(run AS BIGINT) AS run, CAST(place // 127 AS BIGINT) AS piece, any_value(event_type) AS value, count(*) AS n FROM p GROUP BY user_id, run, place // 127""")
def rle_runs(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "ts")
    r = e.withColumn("run", F.sum(F.when(F.lag("event_type").over(w).eqNullSafe(F.col("event_type")), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    p = r.withColumn("piece", F.floor((F.row_number().over(Window.partitionBy("user_id", "run").orderBy("ts", "event_id")) - 1) / 127).cast("long"))
    return p.groupBy("user_id", "run", "piece").agg(F.first("event_type").alias("value"), F.count("*").alias("n"))
