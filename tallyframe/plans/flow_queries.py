"""Queries of control flow and data flow, with events of a user as the instructions of a unit, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.operators import flow
from tallyframe.operators.graph import cut
from tallyframe.sources.tables import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: Events in order of time: a click branches, an error goes elsewhere, a signup ends the unit or, if odd, is a switch.
CODE = """WITH RECURSIVE e AS (SELECT user_id AS unit, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS "at", count(*) OVER (PARTITION BY user_id) AS n, event_type AS op, event_id AS x FROM events),
code AS (SELECT unit, "at", CASE WHEN op = 'click' AND x % 3 = 0 THEN [("at" * 7 + x) % n + 1] WHEN op = 'error' AND x % 5 = 0 THEN [x % (n + 3) + 1] WHEN op = 'signup' AND x % 8 = 1 THEN [x % n + 1, (x // 2) % n + 1, x % n + 1] ELSE [] END AS targets,
  NOT (op = 'error' AND x % 5 = 0 OR op = 'signup' AND x % 8 < 2) AS falls, CASE WHEN op IN ('view', 'purchase') THEN 'r' || (x % 5) END AS defines, ['r' || (x % 3), 'r' || (x % 5)] AS uses FROM e),
aimed AS (SELECT DISTINCT unit, unnest(targets) AS "at" FROM code),
lead_ AS (SELECT code.*, CASE WHEN aimed."at" IS NOT NULL OR coalesce(lag(len(targets) > 0 OR NOT falls) OVER (PARTITION BY code.unit ORDER BY code."at"), true) THEN 1 ELSE 0 END AS leads FROM code LEFT JOIN aimed ON aimed.unit = code.unit AND aimed."at" = code."at"),
blocked AS (SELECT *, CAST(sum(leads) OVER (PARTITION BY unit ORDER BY "at" ROWS UNBOUNDED PRECEDING) AS BIGINT) AS block FROM lead_),
nodes AS (SELECT DISTINCT unit, block FROM blocked), ends AS (SELECT unit, block AS src, arg_max(targets, "at") AS targets, arg_max(falls, "at") AS falls FROM blocked GROUP BY unit, block),
edges AS (SELECT DISTINCT t.unit, src, b.block AS dst, 'jump' AS kind FROM (SELECT unit, src, unnest(targets) AS target FROM ends) t JOIN blocked b ON b.unit = t.unit AND b."at" = t.target
  UNION ALL SELECT n.unit, src, n.block, 'fall' FROM ends JOIN nodes n ON n.unit = ends.unit AND n.block = src + 1 WHERE falls)
"""


def code(spark, d) -> DataFrame:
    w = Window.partitionBy("user_id")
    e = table(spark, d, "events").withColumn("at", F.row_number().over(w.orderBy("ts", "event_id")).cast("long")).withColumn("n", F.count("*").over(w))
    x, n, op, at = F.col("event_id"), F.col("n"), F.col("event_type"), F.col("at")
    reg = lambda k: F.concat(F.lit("r"), (x % k).cast("string"))
    targets = F.when((op == "click") & (x % 3 == 0), F.array((at * 7 + x) % n + 1)).when((op == "error") & (x % 5 == 0), F.array(x % (n + 3) + 1))
    targets = targets.when((op == "signup") & (x % 8 == 1), F.array(x % n + 1, F.floor(x / 2) % n + 1, x % n + 1)).otherwise(F.array().cast("array<long>"))
    stops = (op == "error") & (x % 5 == 0) | (op == "signup") & (x % 8 < 2)
    return e.select(F.col("user_id").alias("unit"), "at", targets.alias("targets"), (~stops).alias("falls"), F.when(op.isin("view", "purchase"), reg(5)).alias("defines"), F.array(reg(3), reg(5)).alias("uses"))


def graph(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    blocked = cut(flow.blocks(code(spark, d)))
    return blocked, blocked.select("unit", "block").distinct(), cut(flow.edges(blocked))


@query(CODE + """SELECT n.unit, n.block, coalesce(preds, 0) AS preds, coalesce(succs, 0) AS succs, coalesce(sources, 0) AS sources FROM nodes n LEFT JOIN (SELECT unit, dst AS block, count(*) AS preds, count(DISTINCT src) AS sources FROM edges GROUP BY ALL) USING (unit, block) LEFT JOIN (SELECT unit, src AS block, count(*) AS succs FROM edges GROUP BY ALL) USING (unit, block)""")
def basic_blocks(spark, d):
    _, nodes, links = graph(spark, d)
    return flow.in_edges(nodes, links)


@query(CODE + """, free(unit, block, without) AS (SELECT a.unit, CAST(1 AS BIGINT), b.block FROM nodes a JOIN (SELECT * FROM nodes UNION ALL SELECT DISTINCT unit, 0 FROM nodes) b ON a.unit = b.unit WHERE a.block = 1 AND b.block <> 1
  UNION SELECT f.unit, e.dst, f.without FROM free f JOIN edges e ON e.unit = f.unit AND e.src = f.block WHERE e.dst <> f.without)
SELECT DISTINCT unit, dst AS head, src AS latch, (unit, src, 0) IN (SELECT (unit, block, without) FROM free) AND (unit, src, dst) NOT IN (SELECT (unit, block, without) FROM free) AS natural FROM edges WHERE dst <= src""")
def loop_heads(spark, d):
    _, nodes, links = graph(spark, d)
    return flow.loop_heads(nodes, links)


@query(CODE + """, defs AS (SELECT unit, block, "at", defines AS reg FROM blocked WHERE defines IS NOT NULL), uses AS (SELECT DISTINCT unit, block, "at", unnest(uses) AS reg FROM blocked),
near AS (SELECT u.*, (SELECT max(d."at") FROM defs d WHERE d.unit = u.unit AND d.block = u.block AND d.reg = u.reg AND d."at" < u."at") AS def_at FROM uses u),
leaves AS (SELECT unit, block, reg, max("at") AS def_at FROM defs GROUP BY ALL),
come(unit, block, reg, def_at) AS (SELECT e.unit, e.dst, reg, def_at FROM leaves l JOIN edges e ON e.unit = l.unit AND e.src = l.block
  UNION SELECT e.unit, e.dst, c.reg, c.def_at FROM come c JOIN edges e ON e.unit = c.unit AND e.src = c.block WHERE (c.unit, c.block, c.reg) NOT IN (SELECT (unit, block, reg) FROM leaves))
SELECT n.unit, n."at", n.reg, coalesce(n.def_at, c.def_at) AS def_at FROM near n LEFT JOIN come c ON n.def_at IS NULL AND c.unit = n.unit AND c.block = n.block AND c.reg = n.reg""")
def reaching_definitions(spark, d):
    blocked, _, links = graph(spark, d)
    return flow.reaching(blocked, links)
