"""Queries of reports on ledgers, of censuses and queues, of reference graphs and of scalars, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions import names as nm
from tallyframe.functions import scalars as sc
from tallyframe.operators import gates as gt
from tallyframe.operators import graph as gr
from tallyframe.operators import intervals as iv
from tallyframe.operators import ledger as lg
from tallyframe.operators import resolve as rs
from tallyframe.operators import review as rv
from tallyframe.plans.claim_queries import CLAIMS, MOVED, PRECEDENCE, SIZED, SNAPS, claims, snaps
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


# Ledgers


@query(SNAPS + """SELECT s.unit, count(*) FILTER (l.best - s.pct > 0.01) AS n, round(coalesce(sum((l.best - s.pct) * coalesce(l.addr % 97 + 1, 0)) FILTER (l.best - s.pct > 0.01), 0.0)::DOUBLE, 4) AS churn FROM snapshot s LEFT JOIN ledger l USING (unit, fn) GROUP BY s.unit""")
def churn_weight(spark, d):
    s, l = snaps(spark, d)  # noqa: E741
    return rv.churn(s, l, l.where("addr is not null").select("unit", "fn", (F.col("addr") % 97 + 1).alias("size")))


@query(SNAPS + "SELECT unit, count(*) AS n, count(*) FILTER (cur >= 99.995) AS matched FROM ledger GROUP BY unit")
def unit_counts(spark, d):
    return rv.unit_counts(snaps(spark, d)[1])


@query(MOVED + """, grown AS (SELECT DISTINCT unit FROM snapshot WHERE (unit, fn) NOT IN (SELECT (unit, fn) FROM ledger) AND (unit, fn) NOT IN (SELECT (unit, fn) FROM moved))
SELECT s.unit, s.fn, s.pct, l.best, s.unit IN (SELECT unit FROM grown) AND s.fp = l.fp AS neighbour FROM snapshot s JOIN ledger l USING (unit, fn) WHERE round(s.pct, 4) < l.best - 0.01 AND NOT round(l.cur, 4) < l.best - 0.01""")
def neighbor_exempt(spark, d):
    return rv.exempted(*snaps(spark, d))


@query(SNAPS + """, o AS (SELECT addr, min(best) AS best FROM ledger WHERE addr IS NOT NULL GROUP BY addr HAVING count(*) = 1)
SELECT unit, count(*) AS strict, count(*) FILTER (best - pct <= 0.01) AS jitter FROM snapshot JOIN o USING (addr) WHERE pct < 100 AND pct < best GROUP BY unit""")
def strict_below(spark, d):
    return rv.strictly_below(*snaps(spark, d))


@query(SNAPS + """, t AS (SELECT unit, fn, fp AS trial_fp, max(pct) AS score FROM snapshot GROUP BY ALL)
SELECT t.unit, t.fn, t.trial_fp, CASE WHEN l.fp = t.trial_fp AND t.score > l.best THEN t.score ELSE l.best END AS best, CASE WHEN l.best IS NULL THEN 'NO-ROW' WHEN l.fp <> t.trial_fp THEN 'STALE' WHEN t.score > l.best THEN 'RAISED' ELSE 'HELD' END AS verdict FROM t LEFT JOIN ledger l USING (unit, fn)""")
def max_record(spark, d):
    s, l = snaps(spark, d)  # noqa: E741
    return rv.record(l, s.select("unit", "fn", "fp", F.col("pct").alias("score")))


@query(SNAPS + """, b AS (SELECT unit, string_agg(fn || fp, ',' ORDER BY fn, fp) AS x FROM ledger GROUP BY unit), a AS (SELECT unit, string_agg(fn || fp, ',' ORDER BY fn, fp) AS y FROM snapshot WHERE unit <> 'u2' GROUP BY unit)
SELECT coalesce(a.unit, b.unit) AS unit, CASE WHEN x IS NULL THEN 'NEW' WHEN y IS NULL THEN 'GONE' ELSE 'CHANGED' END AS verdict FROM a FULL JOIN b ON a.unit = b.unit WHERE x IS DISTINCT FROM y""")
def changed_units(spark, d):
    s, l = snaps(spark, d)  # noqa: E741
    return rv.changed(l, s.where("unit <> 'u2'"), "unit", ["fn", "fp"])


@query(SNAPS + "SELECT l.unit, l.fn, l.fp, coalesce(l.fp = s.fp, false) AS valid FROM ledger l LEFT JOIN snapshot s USING (unit, fn)")
def review_validity(spark, d):
    s, l = snaps(spark, d)  # noqa: E741
    return rv.still_valid(l.select("unit", "fn", "fp"), s, ["unit", "fn"], "fp")


@query(SNAPS + "SELECT unit, fn, best, addr FROM ledger WHERE state <> 'absent' UNION ALL SELECT unit, fn, pct, addr FROM snapshot WHERE pct >= 50")
def promotion(spark, d):
    s, l = snaps(spark, d)  # noqa: E741
    return rv.promoted(l.select("unit", "fn", "best", "addr", "state"), F.col("state") == "absent", s.where("pct >= 50").select("unit", "fn", F.col("pct").alias("best"), "addr", F.lit("").alias("state"))).drop("state")


@query(SNAPS + "SELECT unit, fn, concat_ws(chr(9), unit, fn, printf('%.4f', best), printf('%.4f', cur), CAST(tries AS VARCHAR), fp, coalesce('0x' || printf('%x', addr), ''), printf('%.4f', hist), state) AS line FROM ledger")
def ledger_render(spark, d):
    l = snaps(spark, d)[1]  # noqa: E741
    line = F.concat_ws("\t", "unit", "fn", F.format_string("%.4f", "best"), F.format_string("%.4f", "cur"), F.col("tries").cast("string"), "fp", F.coalesce(F.concat(F.lit("0x"), F.lower(F.hex("addr"))), F.lit("")), F.format_string("%.4f", "hist"), "state")
    return l.select("unit", "fn", line.alias("line"))


@query(SNAPS + """SELECT unit, round(sum(cur * (coalesce(addr, 0) % 97 + 1)) / sum(coalesce(addr, 0) % 97 + 1)::DOUBLE, 4) AS fuzzy FROM ledger GROUP BY unit ORDER BY fuzzy, unit LIMIT 3""")
def worst_units(spark, d):
    l = snaps(spark, d)[1].withColumn("size", F.coalesce("addr", F.lit(0)) % 97 + 1)  # noqa: E741
    return lg.weighted(l, ["unit"], "cur", "size").orderBy("fuzzy", "unit").limit(3).select("unit", "fuzzy")  # a report of the worst three


# Sets, censuses, panels


@query("""WITH r AS (SELECT DISTINCT l_partkey AS key FROM lineitem), k AS (SELECT DISTINCT o_orderkey AS key FROM orders WHERE o_orderstatus = 'F')
SELECT key FROM r WHERE key NOT IN (SELECT p_partkey FROM part WHERE p_size > 10) AND key NOT IN (SELECT key FROM k)""")
def undefined_closure(spark, d):
    used = table(spark, d, "lineitem").select(F.col("l_partkey").alias("key")).distinct()
    defined = table(spark, d, "part").where("p_size > 10").select(F.col("p_partkey").alias("key"))
    known = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("key"))
    return used.join(defined, "key", "left_anti").join(known, "key", "left_anti")


@query("""WITH a AS (SELECT DISTINCT c_nationkey AS unit, c_mktsegment AS name FROM customer WHERE c_acctbal > 5000), b AS (SELECT DISTINCT c_nationkey AS unit, c_mktsegment AS name FROM customer WHERE c_acctbal < -500)
SELECT coalesce(a.unit, b.unit) AS unit, coalesce(a.name, b.name) AS name, CASE WHEN b.name IS NULL THEN 'left' ELSE 'right' END AS side FROM a FULL JOIN b ON a.unit = b.unit AND a.name = b.name WHERE a.name IS NULL OR b.name IS NULL""")
def unpaired_symbols(spark, d):
    side = lambda cond, mark: table(spark, d, "customer").where(cond).select(F.col("c_nationkey").alias("unit"), F.col("c_mktsegment").alias("name")).distinct().withColumn(mark, F.lit(True))
    j = side("c_acctbal > 5000", "a").join(side("c_acctbal < -500", "b"), ["unit", "name"], "full_outer").where("a is null or b is null")
    return j.select("unit", "name", F.when(F.col("b").isNull(), "left").otherwise("right").alias("side"))


@query("""WITH f AS (SELECT l_suppkey AS key, l_shipmode AS kind FROM (SELECT l_suppkey, l_returnflag || l_linestatus AS l_shipmode, l_discount FROM lineitem) WHERE l_discount >= 0.09), t AS (SELECT s_suppkey AS key FROM supplier WHERE s_acctbal > 2000)
SELECT kind, count(*) AS n, count(*) FILTER (key IN (SELECT key FROM t)) AS "right", round(count(*) FILTER (key IN (SELECT key FROM t)) / count(*)::DOUBLE, 6) AS "precision" FROM f GROUP BY kind""")
def precision_by_class(spark, d):
    found = table(spark, d, "lineitem").where("l_discount >= 0.09").select(F.col("l_suppkey").alias("key"), F.concat("l_returnflag", "l_linestatus").alias("kind"))
    return rv.precision(found, table(spark, d, "supplier").where("s_acctbal > 2000").select(F.col("s_suppkey").alias("key")), "key", "kind")


@query("""SELECT event_type, count(*) FILTER (user_id % 7 = 0) AS control, count(*) FILTER (user_id % 7 = 0 AND value > 60) AS findings, round(coalesce(count(*) FILTER (user_id % 7 = 0 AND value > 60) / nullif(count(*) FILTER (user_id % 7 = 0), 0)::DOUBLE, 0), 6) AS rate FROM events GROUP BY event_type""")
def calibration_rate(spark, d):
    return rv.rate(table(spark, d, "events"), F.col("user_id") % 7 == 0, F.col("value") > 60, ["event_type"])


@query("""WITH t AS (SELECT o_custkey AS grp, o_orderstatus || o_orderpriority AS state, o_orderkey % 2 = 0 AS base FROM orders), b AS (SELECT grp, min(state) AS state FROM t WHERE base GROUP BY grp)
SELECT t.grp, count(DISTINCT t.state) AS states, count(*) FILTER (NOT base) AS trials, count(*) FILTER (NOT base AND t.state = b.state) AS as_baseline FROM t LEFT JOIN b USING (grp) GROUP BY t.grp""")
def state_census(spark, d):
    t = table(spark, d, "orders").select(F.col("o_custkey").alias("grp"), F.concat("o_orderstatus", "o_orderpriority").alias("state"), (F.col("o_orderkey") % 2 == 0).alias("base"))
    return rv.state_census(t, "grp", ["state"], F.col("base"))


@query("""WITH h AS (SELECT l_suppkey % 40 AS candidate, l_partkey AS row, CASE WHEN l_quantity > 30 THEN 'HIGH' ELSE 'AMBIG' END AS level FROM lineitem), x AS (SELECT candidate, row, max(CASE WHEN level = 'HIGH' THEN 1 ELSE 0 END) AS high FROM h GROUP BY ALL),
a AS (SELECT row FROM x GROUP BY row HAVING count(*) = 1) SELECT candidate, CAST(sum(high) AS BIGINT) AS high, CAST(sum(1 - high) AS BIGINT) AS ambiguous, count(*) FILTER (row IN (SELECT row FROM a)) AS exclusive FROM x GROUP BY candidate""")
def candidate_panel(spark, d):
    h = table(spark, d, "lineitem").select((F.col("l_suppkey") % 40).alias("candidate"), F.col("l_partkey").alias("row"), F.when(F.col("l_quantity") > 30, "HIGH").otherwise("AMBIG").alias("level"))
    return rv.panel(h, "candidate", "row", "level")


@query("""WITH o AS (SELECT o_custkey, o_orderkey, o_orderstatus AS category, CAST(o_orderkey % 97 AS BIGINT) AS size FROM orders),
f AS (SELECT *, CASE WHEN lag(category) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) IS NOT DISTINCT FROM category THEN 0 ELSE 1 END AS opens FROM o), r AS (SELECT *, sum(opens) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS run FROM f),
p AS (SELECT o_custkey, category, run, count(*) AS k, sum(size) AS b FROM r GROUP BY ALL) SELECT category, CAST(sum(k) AS BIGINT) AS n, CAST(sum(b) AS BIGINT) AS bytes, max(k) AS longest FROM p GROUP BY category""")
def partition_summary(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_orderstatus").alias("category"), (F.col("o_orderkey") % 97).alias("size"))
    return rv.longest_runs(o, ["o_custkey"], "o_orderkey", "category", "size")


@query("""SELECT l_suppkey AS unit, min(l_partkey) AS lo, max(l_partkey) AS hi, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS bytes FROM lineitem GROUP BY l_suppkey ORDER BY bytes DESC, unit LIMIT 20""")
def unit_spans_top(spark, d):
    g = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("unit")).agg(F.min("l_partkey").alias("lo"), F.max("l_partkey").alias("hi"), F.count("*").alias("n"), F.sum("l_linenumber").alias("bytes"))
    return g.orderBy(F.desc("bytes"), "unit").limit(20)  # a report of the largest twenty


@query("""SELECT o_orderkey, o_orderpriority AS wave, row_number() OVER (PARTITION BY o_orderpriority ORDER BY CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END ASC NULLS LAST, CASE WHEN o_custkey % 3 > 0 THEN o_custkey END ASC NULLS LAST, o_orderkey) AS place FROM orders""")
def queue_order(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("wave"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("score"), F.when(F.col("o_custkey") % 3 > 0, F.col("o_custkey")).alias("address"))
    return rv.queue(o, "wave", "score", "address", "o_orderkey").select("o_orderkey", "wave", "place")


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) WHERE (n - 1) % 5 = 0")
def stride_sample(spark, d):
    return rv.every(table(spark, d, "events").select("user_id", "event_id"), "user_id", "event_id", 5)


@query("""WITH r AS (SELECT l_suppkey, l_orderkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey) AS n FROM (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem))
SELECT l_suppkey, string_agg(l_orderkey, ',' ORDER BY n) FILTER (n <= 5) AS shown, CAST(greatest(count(*) - 5, 0) AS BIGINT) AS more FROM r GROUP BY l_suppkey""")
def first_with_remainder(spark, d):
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey").distinct()
    return rv.first_with_rest(rows, "l_suppkey", "l_orderkey", 5).select("l_suppkey", F.array_join("shown", ",").alias("shown"), "more")


# Claims


@query("WITH " + CLAIMS + "SELECT key, channel, name, unit FROM claims WHERE NOT (channel = 'lib' AND upper(CASE WHEN key % 5 = 0 THEN 'Low' ELSE 'High' END) = 'LOW')")
def active_claims(spark, d):
    rows = claims(spark, d)[1].withColumn("confidence", F.when(F.col("key") % 5 == 0, "Low").otherwise("High"))
    return rs.active(rows, "lib").select("key", "channel", "name", "unit")


@query("WITH " + CLAIMS + """SELECT 'UNKNOWN-CHANNEL' AS kind, key, channel, name FROM claims WHERE channel = 'other'
UNION ALL SELECT 'ORPHAN', key, channel, name FROM claims WHERE channel <> 'other' AND key NOT IN (SELECT key FROM census)
UNION ALL SELECT 'OVERSIZED', c.key, channel, name FROM claims c JOIN census k USING (key) WHERE channel IN ('src', 'lib') AND c.size > k.size
UNION ALL SELECT 'TWO-KEYS', min(key), channel, name FROM claims WHERE channel = 'lib' GROUP BY channel, name HAVING count(DISTINCT key) > 1""")
def claim_violations(spark, d):
    census, c = claims(spark, d)
    return rs.violations(census, c, PRECEDENCE, SIZED, unique=("lib",))


@query("""WITH b AS (SELECT p_partkey * 20 AS lo, p_partkey * 20 + p_size % 20 AS hi, p_brand AS unit FROM part WHERE p_size % 20 > 0) SELECT o_orderkey, coalesce(unit, '') AS owner FROM orders LEFT JOIN b ON o_orderkey >= lo AND o_orderkey < hi""")
def band_owner(spark, d):
    p = table(spark, d, "part").where("p_size % 20 > 0")
    bands = p.select(F.lit(0).alias("s"), (F.col("p_partkey") * 20).alias("lo"), (F.col("p_partkey") * 20 + F.col("p_size") % 20).alias("hi"), F.col("p_brand").alias("owner"))
    points = table(spark, d, "orders").select(F.lit(0).alias("s"), "o_orderkey")
    return iv.innermost(points, bands, ["s"], "o_orderkey", "owner").select("o_orderkey", F.coalesce("owner", F.lit("")).alias("owner"))


@query("""WITH r AS (SELECT l_suppkey AS path, CASE WHEN l_partkey % 97 = 0 THEN '*' ELSE l_linestatus || (l_partkey % 50) END AS symbol FROM lineitem WHERE l_quantity > 49), c AS (SELECT o_orderkey, o_custkey % 100 AS path, o_orderstatus || (o_orderkey % 50) AS symbol FROM orders)
SELECT o_orderkey, EXISTS (SELECT 1 FROM r WHERE r.path = c.path AND (r.symbol = '*' OR r.symbol = c.symbol)) AS covered FROM c""")
def ledger_coverage(spark, d):
    l, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    rows = l.where("l_quantity > 49").select(F.col("l_suppkey").alias("path"), F.when(F.col("l_partkey") % 97 == 0, "*").otherwise(F.concat("l_linestatus", (F.col("l_partkey") % 50).cast("string"))).alias("symbol"))
    c = o.select("o_orderkey", (F.col("o_custkey") % 100).alias("path"), F.concat("o_orderstatus", (F.col("o_orderkey") % 50).cast("string")).alias("symbol"))
    return rv.covered(c, rows, ["path"], "symbol").select("o_orderkey", "covered")


@query("SELECT DISTINCT p_brand || p_size AS name FROM part WHERE p_partkey % 9 = 0 AND p_brand || p_size IN (SELECT p_brand || p_size FROM part WHERE p_partkey % 9 <> 0)")
def weak_strong(spark, d):
    p = table(spark, d, "part").select(F.concat("p_brand", F.col("p_size").cast("string")).alias("name"), (F.col("p_partkey") % 9 == 0).alias("weak"))
    return p.where("weak").select("name").distinct().join(p.where("not weak"), "name", "left_semi")


@query("""SELECT spelling, string_agg(DISTINCT p_partkey, ',' ORDER BY p_partkey) AS keys FROM (SELECT p_partkey, p_brand || '::' || p_container AS spelling FROM (SELECT p_partkey, p_brand, p_type AS p_container FROM part) UNION ALL SELECT p_partkey, p_type FROM part) GROUP BY spelling""")
def name_candidates(spark, d):
    names = table(spark, d, "part").select("p_partkey", F.concat("p_brand", F.lit("::"), "p_type").alias("name"))
    return rv.spellings(names, "p_partkey", "name").select("spelling", F.array_join("keys", ",").alias("keys"))


@query("""WITH s AS (SELECT event_id, user_id, value FROM events WHERE event_type = 'click'), f AS (SELECT user_id, event_id AS lo, event_id + 1 + event_id % 300 AS hi, event_id AS owner FROM events WHERE event_type = 'signup'),
o AS (SELECT s.event_id, CAST(floor(s.value) AS BIGINT) AS literal, arg_max(f.owner, (f.lo, f.owner)) AS owner FROM s JOIN f ON s.user_id = f.user_id AND f.lo <= s.event_id AND s.event_id < f.hi GROUP BY ALL)
SELECT literal, string_agg(DISTINCT owner, ',' ORDER BY owner) AS functions, count(*) AS sites FROM o GROUP BY literal""")
def literal_functions(spark, d):
    e = table(spark, d, "events")
    sites = e.where("event_type = 'click'").select("event_id", "user_id", F.floor("value").alias("literal"))
    spans = e.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("lo"), (F.col("event_id") + 1 + F.col("event_id") % 300).alias("hi"), F.col("event_id").alias("owner"))
    owned = iv.innermost(sites, spans, ["user_id"], "event_id", "owner").where("owner is not null")
    return owned.groupBy("literal").agg(F.array_join(F.array_sort(F.collect_set("owner")), ",").alias("functions"), F.count("*").alias("sites"))


@query("""WITH r AS (SELECT user_id, event_id AS id, event_id - 200 AS lo, event_id + event_id % 700 AS hi FROM events WHERE event_type = 'purchase'), p AS (SELECT user_id, event_id AS at FROM events WHERE event_type = 'view')
SELECT id, (SELECT count(*) FROM p WHERE p.user_id = r.user_id AND p.at >= r.lo AND p.at < r.hi) AS points FROM r""")
def refs_in_range(spark, d):
    e = table(spark, d, "events")
    ranges = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("id"), (F.col("event_id") - 200).alias("lo"), (F.col("event_id") + F.col("event_id") % 700).alias("hi"))
    return rv.in_ranges(e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("at")), ranges, ["user_id"], "at").select("id", "points")


@query("""WITH o AS (SELECT o_custkey, o_orderkey, list_sort(list(DISTINCT l_suppkey % 30)) AS vals FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL), n AS (SELECT *, lead(o_orderkey) OVER w AS following, lead(vals) OVER w AS nxt FROM o WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
SELECT o_custkey, o_orderkey, following, array_to_string(list_sort(list_intersect(vals, nxt)), ',') AS shared FROM n WHERE len(list_intersect(vals, nxt)) > 0""")
def adjacent_shared(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey", "o_orderkey").agg(F.collect_set(F.col("l_suppkey") % 30).alias("vals"))
    return rv.neighbours_that_share(o, ["o_custkey"], "o_orderkey", "vals").select("o_custkey", "o_orderkey", "following", F.array_join("shared", ",").alias("shared"))


@query("SELECT event_id, user_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS heading FROM events")
def section_forward(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "ts")
    return rv.section(e, ["user_id"], ["ts", "event_id"], F.when(F.col("event_type") == "signup", F.col("event_id")), "heading").select("event_id", "user_id", "heading")


@query("SELECT p_partkey FROM part WHERE NOT (p_type LIKE 'STANDARD%' OR p_type LIKE 'PROMO%') AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50)")
def layout_rows(spark, d):
    pooled = table(spark, d, "lineitem").where("l_quantity = 50").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, d, "part").where(~sc.begins_with(F.col("p_type"), ("STANDARD", "PROMO"))).select("p_partkey").join(pooled, "p_partkey", "left_anti")


# Reference graphs

REFS = "e AS (SELECT l_suppkey AS src, l_partkey AS dst, l_returnflag = 'N' AND l_linenumber = 1 AS indirect FROM lineitem)"


def refs(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), ((F.col("l_returnflag") == "N") & (F.col("l_linenumber") == 1)).alias("indirect"))


@query(f"WITH {REFS} SELECT src, count(DISTINCT dst) FILTER (NOT indirect) AS callees, count(*) FILTER (NOT indirect) AS sites, count(*) FILTER (indirect) AS indirect FROM e GROUP BY src")
def callees(spark, d):
    return gr.callees(refs(spark, d), "indirect")


@query("""WITH s AS (SELECT p_partkey * 8 AS lo, p_partkey * 8 + 8 AS hi, p_partkey AS id FROM part), r AS (SELECT l_orderkey AS site, l_partkey * 8 + CASE WHEN l_linenumber > 4 THEN l_linenumber % 8 ELSE 0 END AS place FROM lineitem)
SELECT id, count(*) FILTER (place = lo) AS exact, count(*) FILTER (place > lo) AS interior FROM s JOIN r ON place >= lo AND place < hi GROUP BY id""")
def refs_exact_interior(spark, d):
    spans = table(spark, d, "part").select(F.lit(0).alias("s"), (F.col("p_partkey") * 8).alias("lo"), (F.col("p_partkey") * 8 + 8).alias("hi"), F.col("p_partkey").alias("id"))
    at = table(spark, d, "lineitem").select((F.col("l_partkey") * 8 + F.when(F.col("l_linenumber") > 4, F.col("l_linenumber") % 8).otherwise(0)).alias("lo"))
    points = at.groupBy("lo").agg(F.count("*").alias("k")).select(F.lit(0).alias("s"), "lo", (F.col("lo") + 1).alias("hi"), "k")
    met = iv.overlaps(spans, points, ["s"])
    return met.groupBy(F.col("l_id").alias("id")).agg(F.sum(F.when(F.col("r_lo") == F.col("l_lo"), F.col("r_k")).otherwise(0)).alias("exact"), F.sum(F.when(F.col("r_lo") > F.col("l_lo"), F.col("r_k")).otherwise(0)).alias("interior"))


@query("""WITH RECURSIVE f AS (SELECT p_partkey AS node, CASE WHEN p_partkey % 90 = 0 THEN p_partkey + 30 WHEN p_partkey % 30 = 0 AND p_partkey % 60 <> 0 THEN p_partkey - 30 ELSE p_partkey // 2 END AS next FROM part WHERE p_partkey % 3 = 0 AND p_partkey > 1),
e AS (SELECT l_suppkey AS src, l_partkey AS dst FROM lineitem), t AS (SELECT node, next AS target, 1 AS hops FROM f UNION ALL SELECT t.node, f.next, hops + 1 FROM t JOIN f ON t.target = f.node WHERE hops < 100),
z AS (SELECT node, target, hops FROM t WHERE target NOT IN (SELECT node FROM f))
SELECT coalesce(z.target, e.dst) AS dst, src, count(*) AS n, CAST(min(coalesce(hops, 0)) AS BIGINT) AS hops FROM e LEFT JOIN z ON e.dst = z.node WHERE src NOT IN (SELECT node FROM f) AND (z.target IS NOT NULL OR e.dst NOT IN (SELECT node FROM f)) GROUP BY ALL""")
def effective_incoming(spark, d):
    p = F.col("p_partkey")
    to = F.when(p % 90 == 0, p + 30).when((p % 30 == 0) & (p % 60 != 0), p - 30).otherwise(F.floor(p / 2).cast("long"))
    forwards = table(spark, d, "part").where("p_partkey % 3 = 0 and p_partkey > 1").select(p.alias("node"), to.alias("next"))
    return gr.effective_incoming(refs(spark, d).select("src", "dst"), forwards)


@query("""WITH RECURSIVE e AS (SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part WHERE p_partkey > 1 UNION SELECT p_partkey, p_partkey // 3 FROM part WHERE p_partkey > 2),
c AS (SELECT src, dst, 1 AS depth FROM e UNION SELECT c.src, e.dst, depth + 1 FROM c JOIN e ON c.dst = e.src) SELECT src, dst, min(depth) AS depth FROM c GROUP BY src, dst""")
def include_closure(spark, d):
    p, part = F.col("p_partkey"), table(spark, d, "part")
    to = lambda k: part.where(p >= k).select(p.alias("src"), F.floor(p / k).cast("long").alias("dst"))
    return gr.closure(to(2).unionByName(to(3)))


# Scalars


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_brand || '::' || p_brand WHEN 1 THEN p_brand || '::~' || p_brand WHEN 2 THEN p_brand || '::f' || p_size WHEN 3 THEN 'g' || p_size WHEN 4 THEN 'f' || p_size || '::clip' ELSE 'N' || p_size || '::' || p_brand || '::m' END AS short FROM (SELECT p_partkey, replace(p_brand, '#', '') AS p_brand, p_size FROM part)""")
def mangled_names(spark, d):
    b, n = F.replace("p_brand", F.lit("#"), F.lit("")), F.col("p_size").cast("string")
    forms = [("??0", b, "@@QAE@XZ"), ("??1", b, "@@UAE@XZ"), ("?f", n, "@", b, "@@QAEXXZ"), ("_g", n, "@8"), ("_?clip@?1??f", n, "@", b, "@@QAEXXZ@4HA"), ("?m@", b, "@N", n, "@@2HA")]
    name = F.element_at(F.array(*[F.concat(*[F.lit(x) if isinstance(x, str) else x for x in f]) for f in forms]), (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", sc.short_name(name).alias("short"))


@query("""SELECT p_partkey, CASE WHEN k < 3 THEN ['virtual', 'static', 'free function'][k + 1] WHEN k = 3 THEN 'unknown' END AS storage, CASE WHEN k = 3 THEN '?s@?1??f@@4EA$S' WHEN k = 4 THEN 'v' || p_size || '$S' ELSE name END AS masked, k > 2 AS volatile,
  CASE WHEN p_size % 4 = 0 THEN 4 WHEN p_size % 4 = 1 THEN 12 WHEN p_size % 4 = 2 THEN 0 ELSE 8 END AS known, CASE WHEN p_size % 4 = 1 THEN 1 ELSE 0 END AS objects, CASE p_size % 4 WHEN 0 THEN 'varargs' WHEN 1 THEN 'object' ELSE '' END AS blind
FROM (SELECT p_partkey, p_size, p_partkey % 5 AS k, CASE p_partkey % 5 WHEN 0 THEN '?f' || p_size || '@C@@UAEXXZ' WHEN 1 THEN '?f' || p_size || '@C@@SAXXZ' ELSE '?f' || p_size || '@@YAXXZ' END AS name FROM part)""")
def name_spellings(spark, d):
    """Names and parameter lists made of parts: what their letters say, their spelling without counters, the stack they take."""
    n, k = F.col("p_size").cast("string"), F.col("p_partkey") % 5
    forms = [("?f", n, "@C@@UAEXXZ"), ("?f", n, "@C@@SAXXZ"), ("?f", n, "@@YAXXZ"), ("?s@?", F.substring(n, -1, 1), "??f@@4EA$S", n), ("v", n, "$S", F.col("p_partkey").cast("string"))]
    name = F.element_at(F.array(*[F.concat(*[F.lit(x) if isinstance(x, str) else x for x in f]) for f in forms]), (k + 1).cast("int"))
    lists = ["int, ...", "class C *, double, struct D<int, class E>", "void", "enum E, float const"]
    given = F.element_at(F.array(*map(F.lit, lists)), (F.col("p_size") % 4 + 1).cast("int"))
    t = table(spark, d, "part").select("p_partkey", nm.storage(name).alias("storage"), nm.masked(name).alias("masked"), nm.volatile(name).alias("volatile"), nm.parameter_bytes(given).alias("b"))
    return t.select("p_partkey", "storage", "masked", "volatile", "b.*")


@query("""WITH m AS (SELECT p_partkey, p_size % 12 AS shift, CASE WHEN p_partkey % 3 = 0 THEN p_partkey * 77777 ELSE CAST(round(pow(2.0, 32 + p_size % 12) / (p_partkey % 60 + 2)) AS BIGINT) END AS magic FROM part), x AS (SELECT *, CASE WHEN magic > 0 THEN pow(2.0, 32 + shift) / magic END AS exact FROM m)
SELECT p_partkey, magic, CASE WHEN round(exact) >= 2 AND abs(exact - round(exact)) < 0.02 THEN CAST(round(exact) AS BIGINT) END AS divisor FROM x""")
def magic_divisor(spark, d):
    shift = F.col("p_size") % 12
    magic = F.when(F.col("p_partkey") % 3 == 0, F.col("p_partkey") * 77777).otherwise(F.round(F.pow(F.lit(2.0), shift + 32) / (F.col("p_partkey") % 60 + 2)).cast("long"))
    return table(spark, d, "part").select("p_partkey", magic.alias("magic"), sc.divisor(magic, shift).alias("divisor"))


@query("""WITH o AS (SELECT o_orderkey AS k, o_orderkey % 90 AS a, o_custkey % 50 AS b, o_orderkey % 3 AS kind FROM orders),
c AS (SELECT k, 'branches' AS unit, b AS n FROM o WHERE kind = 0 UNION SELECT k, 'calls', a FROM o WHERE kind = 0 UNION SELECT k, 'relocs', a FROM o WHERE kind < 2 AND a = b)
SELECT k AS o_orderkey, CASE kind WHEN 2 THEN 1 ELSE 2 END AS sentences, count(unit) AS claims, coalesce(string_agg(unit || '=' || n, ' ' ORDER BY unit, n), '') AS agreed FROM o LEFT JOIN c USING (k) GROUP BY ALL""")
def sentence_claims(spark, d):
    """Sentences made of the numbers of an order: one that agrees, one that also diverges, one about a trial."""
    a, b, kind = F.col("o_orderkey") % 90, F.col("o_custkey") % 50, F.col("o_orderkey") % 3
    head = F.when(kind == 0, F.format_string("Both sides agree at %d calls and %d branches (score 99.5 exact).", a, b)).otherwise(F.format_string("The base has %d calls vs %d, but both match;", a, b))
    text = F.when(kind == 2, F.format_string("A trial had %d/%d relocs and the same %d calls.", a, a, b)).otherwise(F.concat(head, F.format_string(" it holds %d/%d relocs", a, b)))
    t = table(spark, d, "orders").select("o_orderkey", text.alias("text")).withColumn("said", sc.agreed_counts(F.col("text"), ["calls", "branches", "relocs"]))
    agreed = F.array_join(F.transform("said", lambda x: F.concat(x["unit"], F.lit("="), x["n"].cast("string"))), " ")
    return t.select("o_orderkey", F.size(sc.sentences(F.col("text"))).alias("sentences"), F.size("said").cast("long").alias("claims"), agreed.alias("agreed"))


@query()
def blanked_code(spark, d):
    """Texts as code with comments: what blanking leaves, of the same length. Tested against plain code."""
    c = table(spark, d, "conversations")
    code = F.concat(F.lit("f('//', \"/*\"); /* "), F.coalesce("text", F.lit("")), F.lit(" */ g(1); // "), F.coalesce("role", F.lit("")), F.lit("\nh();"))
    return c.select("conv_id", "turn", code.alias("code")).withColumn("blanked", sc.blank_comments(F.col("code")))


@query()
def top_level_parts(spark, d):
    """Arguments at the top level of a list with brackets in it. Tested against plain code."""
    text = F.concat(F.lit("f("), F.col("p_name"), F.lit(", a[1,2]), "), F.col("p_type"), F.when(F.col("p_size") % 2 == 0, F.lit(", <x,y>, ")).otherwise(F.lit("")))
    return table(spark, d, "part").select("p_partkey", text.alias("text"), sc.split_top(text).alias("parts"))


# Gates


@query("""SELECT 'segment' AS gate, 'DOMAIN' AS category, CAST(c_custkey AS VARCHAR) AS key, 'c_mktsegment=' || c_mktsegment AS detail FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')
UNION ALL SELECT 'lines', 'ORPHAN', CAST(l_partkey AS VARCHAR), '' FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 3)
UNION ALL SELECT 'names', 'SHARED', p_name, CAST(count(*) AS VARCHAR) FROM part GROUP BY p_name HAVING count(*) > 1
UNION ALL SELECT 'order', 'SIZE', CAST(o_orderkey AS VARCHAR), 'negative' FROM orders WHERE o_totalprice < 0
UNION ALL SELECT 'nothing', 'VACUOUS', '', 'no row was audited'
UNION ALL SELECT 'brands', CASE WHEN floor IS NULL THEN 'NO-FLOOR' ELSE 'ABOVE' END, metric, concat_ws(' over ', n, floor) FROM (SELECT p_brand AS metric, count(*) AS n FROM part GROUP BY 1) LEFT JOIN (SELECT p_brand AS metric, count(*) AS floor FROM part WHERE p_size > 1 AND p_brand NOT LIKE '%5' GROUP BY 1) USING (metric) WHERE floor IS NULL OR n > floor""")
def gate_findings(spark, d):
    t = lambda name: table(spark, d, name)
    part, found = t("part"), gt.Registry()
    none = lambda: (t("orders").where("false"), t("orders").where("false").select(F.lit("x").alias("category"), F.lit("").alias("key"), F.lit("").alias("detail")))
    metric = part.select(F.col("p_brand").alias("metric"), "p_size")
    n = lambda df, name: df.groupBy("metric").agg(F.count("*").alias(name))
    found.add("segment", "fast", lambda: (t("customer"), gt.outside_domain(t("customer"), "c_custkey", "c_mktsegment", ["BUILDING", "MACHINERY"])))
    found.add("lines", "fast", lambda: (t("lineitem"), gt.not_in(t("lineitem").select(F.col("l_partkey").alias("p_partkey")), part.where("p_size > 3").select("p_partkey"), "p_partkey", "ORPHAN")))
    found.add("names", "normal", lambda: (part, part.groupBy(F.col("p_name").alias("key")).agg(F.count("*").alias("n")).where("n > 1").select(F.lit("SHARED").alias("category"), "key", F.col("n").cast("string").alias("detail"))))
    found.add("order", "normal", lambda: (t("orders"), t("orders").where("o_totalprice < 0").select(F.lit("SIZE").alias("category"), F.col("o_orderkey").alias("key"), F.lit("negative").alias("detail"))))
    found.add("nothing", "normal", none)
    found.add("brands", "normal", lambda: (part, gt.above_floor(n(metric, "n"), n(metric.where("p_size > 1 and metric not like '%5'"), "floor"))))
    found.add("slow", "full", none)
    return found.findings("normal")
