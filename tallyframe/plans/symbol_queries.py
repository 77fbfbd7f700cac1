"""Queries of symbols, references and hierarchies, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.operators import intervals as iv
from tallyframe.operators import reconcile as rc
from tallyframe.plans.interval_queries import PLACES
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


#: Parts refer to those of half and a third of their number; 30 rounds in SQL are more than the depth.
SYMBOLS = """WITH RECURSIVE s AS (SELECT p_partkey AS id, replace(p_brand, '#', '') || p_size % 4 AS name, p_partkey // 3 * 16 AS addr, p_name || p_size % 2 AS content FROM part),
r AS (SELECT id, 'half' AS slot, id // 2 AS to_id FROM s WHERE id > 3 UNION ALL SELECT id, 'third', id // 3 FROM s WHERE id % 5 = 0),
c(k, id, class) AS (SELECT 0, id, md5(content) FROM s UNION ALL
  SELECT any_value(k) + 1, c.id, md5(any_value(c.class) || coalesce(string_agg(r.slot || '=' || t.class, ',' ORDER BY r.slot, t.class), '')) FROM c LEFT JOIN r ON r.id = c.id LEFT JOIN (SELECT id, class FROM c) t ON t.id = r.to_id WHERE k < 30 GROUP BY c.id),
m AS (SELECT *, min(id) OVER (PARTITION BY class) AS first FROM c WHERE k = 30), x AS (SELECT s.*, m.first AS class FROM s JOIN m USING (id))
"""


def symbols(spark, d):
    p, part = F.col("p_partkey"), table(spark, d, "part")
    s = part.select(p.alias("id"), F.concat(F.replace("p_brand", F.lit("#"), F.lit("")), (F.col("p_size") % 4).cast("string")).alias("name"), (F.floor(p / 3) * 16).alias("addr"), F.concat("p_name", (F.col("p_size") % 2).cast("string")).alias("content"))
    to = lambda rows, slot, k: rows.select("id", F.lit(slot).alias("slot"), F.floor(F.col("id") / k).cast("long").alias("to"))
    return rc.refine(s, to(s.where("id > 3"), "half", 2).unionByName(to(s.where("id % 5 = 0"), "third", 3)), ["content"])[0]


@query(SYMBOLS + "SELECT id, name, addr, content, class FROM x")
def symbol_classes(spark, d):
    return symbols(spark, d)


@query(SYMBOLS + """SELECT 'NAME' AS kind, name AS key, count(DISTINCT class) AS classes, count(*) AS ids FROM x GROUP BY name HAVING count(DISTINCT class) > 1
UNION ALL SELECT 'ADDRESS', CAST(addr AS VARCHAR), count(DISTINCT class), count(*) FROM x GROUP BY addr HAVING count(DISTINCT class) > 1
UNION ALL SELECT 'ALIAS', CAST(class AS VARCHAR), 1, count(*) FROM x GROUP BY class HAVING count(DISTINCT name) > 1""")
def symbol_conflicts(spark, d):
    return rc.conflicts(symbols(spark, d))


@query("""WITH ours AS (SELECT l_orderkey AS unit, CASE WHEN l_suppkey % 7 = 0 THEN '?gone' || l_suppkey % 3 WHEN l_suppkey % 5 = 0 THEN 's' || l_suppkey WHEN l_suppkey % 11 = 0 THEN '__s' || l_suppkey ELSE '_s' || l_suppkey END AS name, CASE WHEN l_linenumber % 3 = 0 THEN 4 ELSE 0 END AS addend, l_linenumber % 2 = 0 AS relative FROM lineitem),
names AS (SELECT '_s' || s_suppkey AS name, s_suppkey * 16 AS addr FROM supplier UNION ALL SELECT '_s' || s_suppkey, s_suppkey * 16 + 8 FROM supplier WHERE s_suppkey % 4 = 1),
fwd AS (SELECT s_suppkey * 16 AS node, s_suppkey * 16 + 1600000 AS next FROM supplier WHERE s_suppkey % 6 = 0),
there AS (SELECT unit, coalesce(next, a) AS addr, count(*) AS there FROM (SELECT l_orderkey AS unit, l_suppkey * 16 + CASE WHEN l_linenumber % 6 = 3 THEN 4 WHEN l_suppkey % 8 = 1 THEN 8 ELSE 0 END AS a FROM lineitem WHERE l_quantity > 3) LEFT JOIN fwd ON node = a GROUP BY ALL),
o AS (SELECT unit, name, addend, relative, count(*) AS n FROM ours GROUP BY ALL),
spell AS (SELECT o.name, n.addr, k FROM (SELECT DISTINCT name FROM o) o, (VALUES (0), (1), (2)) f(k) JOIN names n ON n.name = CASE k WHEN 0 THEN o.name WHEN 1 THEN CASE WHEN o.name LIKE '\\_%' ESCAPE '\\' THEN substr(o.name, 2) END ELSE '_' || o.name END),
place AS (SELECT name, addr FROM spell QUALIFY k = min(k) OVER (PARTITION BY name)),
aim AS (SELECT unit, name, addend, relative, n, coalesce(next, a) AS addr FROM (SELECT o.*, addr + CASE WHEN relative THEN 0 ELSE addend END AS a FROM o JOIN place USING (name)) LEFT JOIN fwd ON node = a),
pick AS (SELECT unit, name, n, aim.addr FROM aim LEFT JOIN there USING (unit, addr) QUALIFY row_number() OVER (PARTITION BY unit, name, addend, relative ORDER BY there IS NULL, aim.addr) = 1),
e AS (SELECT unit, addr, CAST(sum(n) AS BIGINT) AS ours, min(name) AS name FROM pick GROUP BY ALL),
b AS (SELECT unit, addr, name, coalesce(ours, 0) - coalesce(there, 0) AS d FROM e FULL JOIN there USING (unit, addr))
SELECT unit, CASE WHEN d > 0 THEN 'WRONG' ELSE 'MISSING' END AS verdict, CASE WHEN d > 0 THEN name END AS name, addr, abs(d) AS n FROM b WHERE d <> 0
UNION ALL SELECT unit, 'FAKE', name, NULL, CAST(sum(n) AS BIGINT) FROM o WHERE name LIKE '?%' AND name <> '?gone1' GROUP BY unit, name""")
def reference_audit(spark, d):
    s, line = F.col("l_suppkey"), table(spark, d, "lineitem")
    said = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    name = F.when(s % 7 == 0, said("?gone", s % 3)).when(s % 5 == 0, said("s", s)).when(s % 11 == 0, said("__s", s)).otherwise(said("_s", s))
    ours = line.select(F.col("l_orderkey").alias("unit"), name.alias("name"), F.when(F.col("l_linenumber") % 3 == 0, 4).otherwise(0).alias("addend"), (F.col("l_linenumber") % 2 == 0).alias("relative"))
    k, supplier = F.col("s_suppkey"), table(spark, d, "supplier")
    names = supplier.select(said("_s", k).alias("name"), (k * 16).alias("addr")).unionByName(supplier.where(k % 4 == 1).select(said("_s", k).alias("name"), (k * 16 + 8).alias("addr")))
    forwards = supplier.where(k % 6 == 0).select((k * 16).alias("node"), (k * 16 + 1600000).alias("next"))
    actual = line.where("l_quantity > 3").select(F.col("l_orderkey").alias("unit"), (s * 16 + F.when(F.col("l_linenumber") % 6 == 3, 4).when(s % 8 == 1, 8).otherwise(0)).alias("addr"))
    return rc.audit(ours, actual, names, supplier.where(k == 1).select(F.lit("?gone1").alias("name")), forwards)


#: Every part is a class below those of half its number and, for some, of its number less one: deep, with several bases.
CLASSES = """WITH RECURSIVE b AS (SELECT p_partkey AS class, CASE WHEN p_partkey % 10 < 7 THEN p_partkey - 1 ELSE p_partkey // 2 END AS base FROM part WHERE p_partkey > 1 UNION SELECT p_partkey, p_partkey // 3 FROM part WHERE p_partkey % 9 = 0 AND p_partkey > 3),
own AS (SELECT p_partkey AS class, p_size % 7 AS slot, min(p_name) AS symbol FROM part WHERE p_partkey % 4 = 1 GROUP BY ALL),
up(class, ancestor, depth) AS (SELECT p_partkey, p_partkey, CAST(0 AS BIGINT) FROM part UNION SELECT u.class, b.base, u.depth + 1 FROM up u JOIN b ON b.class = u.ancestor),
near AS (SELECT class, ancestor, min(depth) AS depth FROM up GROUP BY ALL),
bound AS (SELECT n.class, o.slot, n.ancestor AS owner, o.symbol, n.depth FROM near n JOIN own o ON o.class = n.ancestor QUALIFY row_number() OVER (PARTITION BY n.class, o.slot ORDER BY n.depth, n.ancestor, o.symbol) = 1)
"""


def bound(spark, d):
    p, part = F.col("p_partkey"), table(spark, d, "part")
    one = part.where("p_partkey > 1").select(p.alias("class"), F.when(p % 10 < 7, p - 1).otherwise(F.floor(p / 2)).alias("base"))
    more = part.where("p_partkey % 9 = 0 and p_partkey > 3").select(p.alias("class"), F.floor(p / 3).alias("base"))
    own = part.where("p_partkey % 4 = 1").groupBy(p.alias("class"), (F.col("p_size") % 7).alias("slot")).agg(F.min("p_name").alias("symbol"))
    return rc.bound_slots(one.unionByName(more), own)


@query(CLASSES + "SELECT class, slot, owner, symbol, depth FROM bound")
def slot_owners(spark, d):
    return bound(spark, d)


@query(CLASSES + """, t AS (SELECT p_partkey AS class, s AS slot, CASE WHEN (p_partkey + s) % 5 = 0 THEN 'other' ELSE b.symbol END AS there FROM part, unnest(range(0, 8)) u(s) LEFT JOIN bound b ON b.class = p_partkey AND b.slot = s WHERE p_partkey % 3 = 0 AND (p_partkey + s) % 7 <> 0)
SELECT coalesce(t.class, b.class) AS class, CAST(coalesce(t.slot, b.slot) AS INTEGER) AS slot, CASE WHEN b.class IS NULL THEN 'UNBOUND' WHEN t.class IS NULL THEN 'MISSING' ELSE 'FOREIGN' END AS finding FROM t FULL JOIN (SELECT * FROM bound WHERE class IN (SELECT class FROM t)) b ON b.class = t.class AND b.slot = t.slot WHERE b.class IS NULL OR t.class IS NULL OR t.there <> b.symbol""")
def slot_findings(spark, d):
    b = bound(spark, d)
    places = table(spark, d, "part").where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("class"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("slot")).where("(class + slot) % 7 <> 0")
    there = places.join(b.select("class", "slot", "symbol"), ["class", "slot"], "left")
    return rc.slot_findings(b, there.withColumn("symbol", F.when((F.col("class") + F.col("slot")) % 5 == 0, "other").otherwise(F.col("symbol"))))


@query("""WITH i AS (SELECT o_orderkey * 10 AS lo, o_orderkey * 10 + 3 + o_custkey % 9 AS hi FROM orders), m AS (SELECT *, max(hi) OVER (ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i),
n AS (SELECT *, sum(CASE WHEN reach IS NULL OR lo > reach THEN 1 ELSE 0 END) OVER (ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS run FROM m), runs AS (SELECT min(lo) AS lo, max(hi) AS hi FROM n GROUP BY run),
gaps AS (SELECT hi AS lo, lead(lo) OVER (ORDER BY lo) AS hi FROM runs), acc AS (SELECT DISTINCT l_suppkey * 100 AS fn, l_suppkey * 100 + l_linenumber AS site, l_orderkey * 10 + l_partkey % 10 AS target FROM lineitem),
held AS (SELECT g.lo AS gap_lo, acc.* FROM gaps g JOIN acc ON acc.target >= g.lo AND acc.target < g.hi WHERE g.hi - g.lo >= 2),
claims AS (SELECT s_suppkey * 100 AS fn, 'lib' || s_nationkey % 3 AS library, 'f' || s_suppkey % 17 AS name FROM supplier WHERE s_suppkey % 6 > 0),
defs AS (SELECT DISTINCT 'lib' || p_size % 3 AS library, 'f' || p_partkey % 17 AS name, p_partkey % 11 AS "offset", p_partkey % 5 AS addend, p_brand AS symbol, p_size AS size, CASE WHEN p_size % 2 = 0 THEN 'bss' ELSE 'data' END AS storage, 'm' || p_size AS member FROM part),
f AS (SELECT h.*, d.addend, h.target - d.addend AS base, d.symbol, d.size, d.storage, d.library, d.member FROM held h LEFT JOIN claims c USING (fn) LEFT JOIN defs d ON d.library = c.library AND d.name = c.name AND d."offset" = h.site - h.fn),
k AS (SELECT gap_lo, fn, site, target, count(*) FILTER (addend IS NOT NULL) AS hits, min(base) AS base, min(symbol) AS symbol, min(size) AS size, min(storage) AS storage, min(library) AS library, min(member) AS member FROM (SELECT DISTINCT * FROM f) GROUP BY ALL)
SELECT gap_lo, fn, site, target, CASE WHEN hits = 1 THEN 'FOUND' WHEN hits > 1 THEN 'AMBIGUOUS' ELSE 'UNKNOWN' END AS verdict, hits, CASE WHEN hits = 1 THEN base END AS base, CASE WHEN hits = 1 THEN symbol END AS symbol, CASE WHEN hits = 1 THEN size END AS size, CASE WHEN hits = 1 THEN storage END AS storage, CASE WHEN hits = 1 THEN library END AS library, CASE WHEN hits = 1 THEN member END AS member FROM k""")
def gap_attribution(spark, d):
    """The holes between orders in one space, and the lines that reach into them."""
    t = lambda name: table(spark, d, name)
    said = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    at = F.col("o_orderkey") * 10
    runs = iv.coalesce(t("orders").select(at.alias("lo"), (at + 3 + F.col("o_custkey") % 9).alias("hi")), [], "lo", "hi", width=PLACES)
    holes = iv.gaps(runs, [], PLACES).select(F.col("gap_lo").alias("lo"), F.col("gap_hi").alias("hi"), F.lit(1).alias("touched"), F.when(F.col("length") < 2, "PAD").otherwise("ZERO-GAP").alias("verdict"))
    fn = F.col("l_suppkey") * 100
    accesses = t("lineitem").select(fn.alias("fn"), (fn + F.col("l_linenumber")).alias("site"), (F.col("l_orderkey") * 10 + F.col("l_partkey") % 10).alias("target")).distinct()
    claims = t("supplier").where("s_suppkey % 6 > 0").select((F.col("s_suppkey") * 100).alias("fn"), said("lib", F.col("s_nationkey") % 3).alias("library"), said("f", F.col("s_suppkey") % 17).alias("name"))
    p, size = F.col("p_partkey"), F.col("p_size")
    definitions = t("part").select(said("lib", size % 3).alias("library"), said("f", p % 17).alias("name"), (p % 11).alias("offset"), (p % 5).alias("addend"), F.col("p_brand").alias("symbol"), size.alias("size"), F.when(size % 2 == 0, "bss").otherwise("data").alias("storage"), said("m", size).alias("member"))
    return rc.attribute(holes, accesses, claims, definitions, PLACES)
