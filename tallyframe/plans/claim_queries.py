"""Queries of claim resolution, ledgers and reconciliation, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyframe.operators import ledger as lg
from tallyframe.operators import resolve as rs
from tallyframe.sources.tables import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


PRECEDENCE, SIZED = ("dyninit", "src", "lib", "eh"), ("src", "lib")
CLAIMS = """census AS (SELECT p_partkey AS key, CAST(p_size AS BIGINT) AS size FROM part),
claims AS (SELECT l_partkey AS key, 'src' AS channel, 'L' || (l_suppkey % 7) AS name, 'u' || (l_orderkey % 10) AS unit, CAST(l_quantity AS BIGINT) AS size FROM lineitem WHERE l_quantity >= 46
UNION ALL SELECT p_partkey, 'lib', p_brand, 'lib', CAST(p_size + 1 AS BIGINT) FROM part WHERE p_partkey % 3 = 0
UNION ALL SELECT p_partkey, 'dyninit', 'init' || (p_partkey % 11), 'u3', CAST(4 AS BIGINT) FROM part WHERE p_partkey % 17 = 0
UNION ALL SELECT o_orderkey, 'eh', 'eh' || (o_orderkey % 5), 'u1', CAST(8 AS BIGINT) FROM orders WHERE o_orderkey % 4 = 0
UNION ALL SELECT p_partkey, 'other', 'x', 'u0', CAST(1 AS BIGINT) FROM part WHERE p_partkey % 29 = 0)
"""


def claims(spark, d):
    part, line, orders = (table(spark, d, t) for t in ("part", "lineitem", "orders"))
    lit = F.lit
    census = part.select(F.col("p_partkey").alias("key"), F.col("p_size").cast("long").alias("size"))
    row = lambda df, key, channel, name, unit, size: df.select(F.col(key).alias("key"), lit(channel).alias("channel"), name.alias("name"), unit.alias("unit"), size.cast("long").alias("size"))
    tag = lambda prefix, c: F.concat(lit(prefix), c.cast("string"))
    p, o = F.col("p_partkey"), F.col("o_orderkey")
    return census, (
        row(line.where("l_quantity >= 46"), "l_partkey", "src", tag("L", F.col("l_suppkey") % 7), tag("u", F.col("l_orderkey") % 10), F.col("l_quantity"))
        .unionByName(row(part.where(p % 3 == 0), "p_partkey", "lib", F.col("p_brand"), lit("lib"), F.col("p_size") + 1))
        .unionByName(row(part.where(p % 17 == 0), "p_partkey", "dyninit", tag("init", p % 11), lit("u3"), lit(4)))
        .unionByName(row(orders.where(o % 4 == 0), "o_orderkey", "eh", tag("eh", o % 5), lit("u1"), lit(8)))
        .unionByName(row(part.where(p % 29 == 0), "p_partkey", "other", lit("x"), lit("u0"), lit(1)))
    )



OWNED = CLAIMS + """, heads AS (SELECT key, channel, name, min(unit) AS unit FROM claims WHERE channel <> 'other' GROUP BY key, channel, name),
sizes AS (SELECT h.key, h.channel, h.name, h.unit, min(c.size) AS size FROM heads h JOIN claims c ON c.key = h.key AND c.channel = h.channel AND c.name = h.name AND c.unit = h.unit GROUP BY ALL),
others AS (SELECT h.key, h.channel, h.name, string_agg(DISTINCT c.unit, ';' ORDER BY c.unit) AS also_units FROM heads h JOIN claims c ON c.key = h.key AND c.channel = h.channel AND c.name = h.name AND c.unit <> h.unit GROUP BY ALL),
owned AS (SELECT s.*, coalesce(also_units, '') AS also_units FROM sizes s LEFT JOIN others USING (key, channel, name))
"""


@query("WITH " + OWNED + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY CASE channel WHEN 'dyninit' THEN 0 WHEN 'src' THEN 1 WHEN 'lib' THEN 2 ELSE 3 END, name) AS place FROM owned),
aliases AS (SELECT key, string_agg(channel || ':' || name, '|' ORDER BY place) AS aliases FROM ranked WHERE place > 1 OR channel = 'dyninit' GROUP BY key)
SELECT c.key, CASE WHEN r.channel IN ('src', 'lib') AND r.size > 0 AND r.size <= c.size THEN r.size ELSE c.size END AS size,
  CASE WHEN r.channel = 'dyninit' THEN '' ELSE coalesce(r.name, '') END AS name, coalesce(r.unit, '') AS unit, coalesce(r.channel, '') AS channel, coalesce(r.also_units, '') AS also_units, coalesce(a.aliases, '') AS aliases
FROM census c LEFT JOIN (SELECT * FROM ranked WHERE place = 1) r USING (key) LEFT JOIN aliases a USING (key)""")
def claim_resolution(spark, d):
    census, c = claims(spark, d)
    return rs.resolve(census, c, PRECEDENCE, SIZED, blanked=("dyninit",))


#: Kinds of rows, units that emit a name, and bands of units along the keys.
MODEL = CLAIMS + """, kinds AS (SELECT p_partkey AS key, CAST(p_size AS BIGINT) AS size, CASE WHEN p_partkey % 5 = 0 THEN 'thunk' WHEN p_partkey % 31 = 0 THEN 'eh' ELSE '' END AS kind FROM part),
emitted AS (SELECT DISTINCT 'u' || (l_orderkey % 10) AS unit, 'L' || (l_suppkey % 7) AS name FROM lineitem WHERE l_suppkey % 7 <> 2 AND (l_orderkey + l_suppkey) % 3 = 0),
bands AS (SELECT p_partkey AS lo, p_partkey + 8 AS hi, 'u' || (p_partkey // 10 % 10) AS unit FROM part WHERE p_partkey % 10 = 0), known AS (SELECT * FROM claims WHERE channel <> 'other'),
marked AS (SELECT k.*, (unit, name) IN (SELECT (unit, name) FROM emitted) AS emits FROM known k), groups AS (SELECT key, name, count(DISTINCT unit) AS units, bool_or(emits) AS some_ FROM marked GROUP BY key, name),
kept AS (SELECT m.* FROM marked m JOIN groups USING (key, name) WHERE emits OR units = 1 OR NOT some_),
one AS (SELECT key, channel, name, min(unit) AS first, list_sort(list(DISTINCT unit)) AS all_ FROM kept GROUP BY ALL),
chosen AS (SELECT o.*, CASE WHEN b.unit IN (SELECT unnest(all_)) THEN b.unit ELSE first END AS unit FROM one o LEFT JOIN bands b ON o.key >= b.lo AND o.key < b.hi AND len(all_) > 1),
owned AS (SELECT c.key, c.channel, c.name, c.unit, list_filter(c.all_, lambda x: x <> c.unit) AS also, (SELECT min(size) FROM kept k WHERE k.key = c.key AND k.channel = c.channel AND k.name = c.name AND k.unit = c.unit) AS size FROM chosen c),
ranked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY CASE channel WHEN 'dyninit' THEN 0 WHEN 'src' THEN 1 WHEN 'lib' THEN 2 ELSE 3 END, name) AS place FROM owned),
aliases AS (SELECT key, string_agg(channel || ':' || name, '|' ORDER BY place) AS aliases FROM ranked WHERE place > 1 OR channel = 'dyninit' GROUP BY key), win AS (SELECT r.*, k.kind, k.size AS room FROM ranked r JOIN kinds k USING (key) WHERE place = 1)
"""
ADMITTED = {"src": ["", "thunk"], "lib": [""], "dyninit": [""]}


def model(spark, d):
    census, c = claims(spark, d)
    p, part, line = F.col("p_partkey"), table(spark, d, "part"), table(spark, d, "lineitem")
    tag = lambda prefix, x: F.concat(F.lit(prefix), x.cast("string"))
    kinds = census.withColumn("kind", F.when(F.col("key") % 5 == 0, "thunk").when(F.col("key") % 31 == 0, "eh").otherwise(""))
    some = line.where("l_suppkey % 7 <> 2 and (l_orderkey + l_suppkey) % 3 = 0")
    emitted = some.select(tag("u", F.col("l_orderkey") % 10).alias("unit"), tag("L", F.col("l_suppkey") % 7).alias("name")).distinct()
    bands = part.where(p % 10 == 0).select(p.alias("lo"), (p + 8).alias("hi"), tag("u", F.floor(p / 10) % 10).alias("unit"))
    return rs.model(kinds, c, emitted, bands, ADMITTED, PRECEDENCE, SIZED, ("dyninit",), 1 << 16)


@query("WITH " + MODEL + """SELECT c.key, c.kind, CASE WHEN r.channel IN ('src', 'lib') AND r.size > 0 AND r.size <= c.size THEN r.size ELSE c.size END AS size, CASE WHEN r.channel = 'dyninit' THEN '' ELSE coalesce(r.name, '') END AS name,
  coalesce(r.unit, '') AS unit, coalesce(r.channel, '') AS channel, coalesce(array_to_string(r.also, ';'), '') AS also_units, coalesce(a.aliases, '') AS aliases FROM kinds c LEFT JOIN win r USING (key) LEFT JOIN aliases a USING (key)""")
def model_bindings(spark, d):
    return model(spark, d)[0]


@query("WITH " + MODEL + """SELECT 'KIND' AS violation, key, channel, name FROM win WHERE channel = 'src' AND kind NOT IN ('', 'thunk') OR channel IN ('lib', 'dyninit') AND kind <> ''
UNION ALL SELECT 'NOT-EMITTED', key, channel, name FROM marked GROUP BY key, channel, name HAVING count(DISTINCT unit) > 1 AND (key, name) NOT IN (SELECT (key, name) FROM marked WHERE emits)
UNION ALL SELECT 'CROSSES', key, channel, name FROM win WHERE channel IN ('src', 'lib') AND size > room
UNION ALL SELECT 'UNKNOWN-CHANNEL', key, channel, name FROM claims WHERE channel = 'other' UNION ALL SELECT 'ORPHAN', key, channel, name FROM known WHERE key NOT IN (SELECT key FROM census)""")
def model_violations(spark, d):
    return model(spark, d)[1]


@query("WITH " + CLAIMS + "SELECT key, channel, name, unit FROM claims WHERE key NOT IN (SELECT key FROM census)")
def orphan_claims(spark, d):
    census, c = claims(spark, d)
    return rs.orphans(census, c).select("key", "channel", "name", "unit")


@query("WITH " + OWNED + "SELECT key, channel, name, unit, also_units FROM owned WHERE also_units <> ''")
def also_units(spark, d):
    _, c = claims(spark, d)
    return rs.owners(c.where("channel <> 'other'")).select("key", "channel", "name", "unit", F.array_join("also_units", ";").alias("also_units")).where("also_units <> ''")


@query("WITH " + CLAIMS + "SELECT k.key, c.channel, c.name, c.size, k.size AS room FROM claims c JOIN census k USING (key) WHERE c.channel IN ('src', 'lib') AND c.size > k.size")
def oversized_claims(spark, d):
    census, c = claims(spark, d)
    return rs.oversized(census, c, SIZED).select("key", "channel", "name", "size", "room")


@query("SELECT name, count(DISTINCT key) AS n_keys, min(key) AS first_key, max(key) AS last_key FROM (SELECT p_brand || '/' || p_type AS name, p_partkey AS key FROM part WHERE NOT regexp_matches(p_type, '^S')) GROUP BY name HAVING count(DISTINCT key) > 1")
def name_injectivity(spark, d):
    rows = table(spark, d, "part").where("not p_type rlike '^S'").select(F.concat_ws("/", "p_brand", "p_type").alias("label"), F.col("p_partkey").alias("key"))
    return rs.shared_names(rows, "label", "key")


@query("WITH " + CLAIMS + "SELECT key, min(name) FILTER (channel = 'src') AS src_name, min(name) FILTER (channel = 'lib') AS lib_name FROM claims GROUP BY key HAVING count(*) FILTER (channel = 'src') > 0 AND count(*) FILTER (channel = 'lib') > 0")
def channel_overlap(spark, d):
    _, c = claims(spark, d)
    name = lambda ch: F.min(F.when(F.col("channel") == ch, F.col("name")))
    return c.groupBy("key").agg(name("src").alias("src_name"), name("lib").alias("lib_name")).where("src_name is not null and lib_name is not null")


@query("""WITH c AS (SELECT CASE WHEN p_type LIKE 'STANDARD%' THEN 'target' WHEN p_size < 5 THEN 'thunk' WHEN p_size < 10 THEN 'helper' WHEN p_partkey % 13 = 0 THEN 'dyninit' WHEN p_brand LIKE '%1' THEN 'static' WHEN p_partkey % 7 = 0 THEN 'eh' WHEN p_size % 16 = 0 THEN 'pad' ELSE 'target' END AS category, p_size FROM part)
SELECT category, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS bytes FROM c GROUP BY category""")
def universe_categories(spark, d):
    category = (
        F.when(F.col("p_type").startswith("STANDARD"), "target").when(F.col("p_size") < 5, "thunk").when(F.col("p_size") < 10, "helper").when(F.col("p_partkey") % 13 == 0, "dyninit")
        .when(F.col("p_brand").endswith("1"), "static").when(F.col("p_partkey") % 7 == 0, "eh").when(F.col("p_size") % 16 == 0, "pad").otherwise("target")
    )
    return table(spark, d, "part").groupBy(category.alias("category")).agg(F.count("*").alias("n"), F.sum("p_size").alias("bytes"))


@query("""SELECT r_name, n_name, count(*) AS n, CAST(sum(s_suppkey % 97 + 1) AS BIGINT) AS bytes, CAST(sum(CASE WHEN s_acctbal >= 9000 THEN s_suppkey % 97 + 1 ELSE 0 END) AS BIGINT) AS exact_bytes,
round(sum(CASE WHEN s_acctbal >= 9000 THEN 100 ELSE (s_suppkey * 37 % 100) END * (s_suppkey % 97 + 1)) / sum(s_suppkey % 97 + 1)::DOUBLE, 4) AS fuzzy
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name""")
def module_rollup(spark, d):
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    s = s.select("r_name", "n_name", (F.col("s_suppkey") % 97 + 1).alias("size"), F.when(F.col("s_acctbal") >= 9000, 100).otherwise(F.col("s_suppkey") * 37 % 100).cast("double").alias("pct"))
    return lg.weighted(s, ["r_name", "n_name"], "pct", "size")


@query("""WITH t AS (SELECT o_orderpriority, sum(o_orderkey % 1000) AS total, count(*) AS n FROM orders GROUP BY 1), c AS (SELECT o_orderpriority, sum(o_orderkey % 1000) AS carved, count(*) AS m FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)
SELECT o_orderpriority, CAST(total - coalesce(carved, 0) AS BIGINT) AS bytes, n - coalesce(m, 0) AS n, round(100.0 * (total - coalesce(carved, 0)) / total, 4)::DOUBLE AS share FROM t LEFT JOIN c USING (o_orderpriority)""")
def carve_subtract(spark, d):
    size = F.col("o_orderkey") % 1000
    g = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.sum(size).alias("total"), F.count("*").alias("n"), F.sum(F.when(F.col("o_orderstatus") == "P", size).otherwise(0)).alias("carved"), F.count_if(F.col("o_orderstatus") == "P").alias("m"))
    left = F.col("total") - F.col("carved")
    return g.select("o_orderpriority", left.alias("bytes"), (F.col("n") - F.col("m")).alias("n"), F.round(F.coalesce(F.try_divide(left * 100.0, F.col("total")), F.lit(0.0)), 4).alias("share"))


SNAPS = """WITH g AS (SELECT l_suppkey, l_linenumber, CAST(l_quantity AS BIGINT) AS q, l_partkey FROM lineitem),
snapshot AS (SELECT 'u' || ((l_suppkey + CASE WHEN l_suppkey % 19 = 0 THEN 1 ELSE 0 END) % 5) AS unit, 'f' || (l_suppkey + CASE WHEN l_suppkey % 23 = 0 THEN 100000 ELSE 0 END) AS fn, (sum(q) * 7919 % 10001) / 100.0::DOUBLE AS pct, 'h' || (sum(l_partkey) % 2) AS fp, CASE WHEN l_suppkey % 31 = 0 THEN NULL ELSE l_suppkey * 16 END AS addr
  FROM g WHERE l_linenumber >= 3 AND l_suppkey % 10 <> 3 GROUP BY l_suppkey),
ledger AS (SELECT 'u' || (l_suppkey % 5) AS unit, 'f' || l_suppkey AS fn, (sum(q) * 104729 % 10001) / 100.0::DOUBLE AS best, (sum(q) * 104729 % 10001 - sum(q) % 3) / 100.0::DOUBLE AS cur, (sum(q) * 104729 % 10001 + l_suppkey % 2) / 100.0::DOUBLE AS hist, l_suppkey % 4 + 1 AS tries, 'h' || (sum(l_partkey) % 2) AS fp, CASE WHEN l_suppkey % 37 = 0 THEN NULL ELSE l_suppkey * 16 END AS addr, CASE WHEN l_suppkey % 3 = 0 THEN 'absent' ELSE '' END AS state
  FROM g WHERE l_linenumber <= 4 AND l_suppkey % 10 <> 7 GROUP BY l_suppkey)
"""


def snaps(spark, d):
    s = F.col("l_suppkey")
    g = table(spark, d, "lineitem").select("l_suppkey", "l_linenumber", F.col("l_quantity").cast("long").alias("q"), "l_partkey")
    tag = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    agg = lambda df: df.groupBy("l_suppkey").agg(F.sum("q").alias("q"), F.sum("l_partkey").alias("p"))
    cur = agg(g.where((F.col("l_linenumber") >= 3) & (s % 10 != 3)))
    snapshot = cur.select(
        tag("u", (s + F.when(s % 19 == 0, 1).otherwise(0)) % 5).alias("unit"), tag("f", s + F.when(s % 23 == 0, 100000).otherwise(0)).alias("fn"), (F.col("q") * 7919 % 10001 / 100.0).cast("double").alias("pct"),
        tag("h", F.col("p") % 2).alias("fp"), F.when(s % 31 != 0, s * 16).alias("addr"),
    )
    old = agg(g.where((F.col("l_linenumber") <= 4) & (s % 10 != 7)))
    best = F.col("q") * 104729 % 10001
    ledger = old.select(
        tag("u", s % 5).alias("unit"), tag("f", s).alias("fn"), (best / 100.0).cast("double").alias("best"), ((best - F.col("q") % 3) / 100.0).cast("double").alias("cur"), ((best + s % 2) / 100.0).cast("double").alias("hist"),
        (s % 4 + 1).alias("tries"), tag("h", F.col("p") % 2).alias("fp"), F.when(s % 37 != 0, s * 16).alias("addr"), F.when(s % 3 == 0, "absent").otherwise("").alias("state"),
    )
    return snapshot, ledger


MOVED = SNAPS + """, s1 AS (SELECT addr, min(unit) AS unit, min(fn) AS fn FROM snapshot WHERE addr IS NOT NULL GROUP BY addr HAVING count(*) = 1), l1 AS (SELECT addr, min(unit) AS unit, min(fn) AS fn FROM ledger WHERE addr IS NOT NULL GROUP BY addr HAVING count(*) = 1),
moved AS (SELECT s1.unit, s1.fn, l1.unit AS old_unit, l1.fn AS old_fn FROM s1 JOIN l1 USING (addr) WHERE (s1.unit, s1.fn) NOT IN (SELECT (unit, fn) FROM ledger) AND (l1.unit, l1.fn) NOT IN (SELECT (unit, fn) FROM snapshot))
"""


@query(MOVED + """, sources AS (SELECT 'u' || (l_suppkey % 5) AS unit, 'f' || l_suppkey AS fn, 'h' || (sum(l_partkey) % 2) AS now FROM lineitem WHERE l_suppkey % 4 <> 1 GROUP BY l_suppkey), c AS (SELECT s.*, m.old_unit AS mu, b.best, b.fp AS old_fp FROM snapshot s LEFT JOIN moved m USING (unit, fn) LEFT JOIN ledger b ON b.unit = coalesce(m.old_unit, s.unit) AND b.fn = coalesce(m.old_fn, s.fn))
SELECT unit, fn, CASE WHEN mu = unit THEN 'RENAMED' ELSE 'MOVED' END AS event FROM c WHERE mu IS NOT NULL
UNION ALL SELECT unit, fn, event FROM (SELECT unit, fn, CASE WHEN best IS NULL THEN 'NEW' WHEN round(pct, 4) < best - 0.01 THEN 'REGRESS' WHEN fp <> old_fp THEN 'TOUCHED' WHEN pct > best + 0.01 THEN 'IMPROVE' END AS event FROM c) WHERE event IS NOT NULL
UNION ALL SELECT unit, fn, CASE WHEN addr IN (SELECT addr FROM snapshot WHERE addr IS NOT NULL) OR now <> fp THEN 'REMOVED' WHEN state = 'absent' THEN 'KNOWN-ABSENT' ELSE 'LOST' END FROM ledger LEFT JOIN sources USING (unit, fn) WHERE (unit, fn) NOT IN (SELECT (unit, fn) FROM snapshot) AND (unit, fn) NOT IN (SELECT (old_unit, old_fn) FROM moved)""")
def regression_classify(spark, d):
    """The fingerprint of all lines of a supplier is what its source is now."""
    key = F.col("l_suppkey")
    lines = table(spark, d, "lineitem").where(key % 4 != 1).groupBy(key).agg(F.sum("l_partkey").alias("p"))
    sources = lines.select(F.concat(F.lit("u"), (key % 5).cast("string")).alias("unit"), F.concat(F.lit("f"), key.cast("string")).alias("fn"), F.concat(F.lit("h"), (F.col("p") % 2).cast("string")).alias("fp"))
    return lg.classify(*snaps(spark, d), sources)


@query(SNAPS + """, once AS (SELECT addr, min(best) AS best, min(hist) AS hist, min(tries) AS tries, min(fp) AS fp FROM ledger WHERE addr IS NOT NULL GROUP BY addr HAVING count(*) = 1),
j AS (SELECT s.*, coalesce(l.best, o.best) AS l_best, CASE WHEN l.best IS NULL THEN o.hist ELSE l.hist END AS l_hist, CASE WHEN l.best IS NULL THEN o.tries ELSE l.tries END AS l_tries, CASE WHEN l.best IS NULL THEN o.fp ELSE l.fp END AS l_fp, CASE WHEN l.best IS NULL THEN o.addr ELSE l.addr END AS l_addr
  FROM snapshot s LEFT JOIN ledger l USING (unit, fn) LEFT JOIN once o ON o.addr = s.addr)
SELECT unit, fn, CASE WHEN l_best IS NULL OR addr <> l_addr OR fp <> l_fp THEN pct ELSE greatest(l_best, pct) END AS best, pct AS cur, greatest(pct, coalesce(l_hist, pct)) AS hist,
CAST(CASE WHEN l_best IS NULL OR addr <> l_addr THEN 1 WHEN fp <> l_fp THEN l_tries + 1 ELSE l_tries END AS BIGINT) AS tries, fp, addr, '' AS state FROM j
UNION ALL SELECT unit, fn, best, cur, hist, CAST(tries AS BIGINT), fp, addr, 'absent' FROM ledger WHERE (unit, fn) NOT IN (SELECT (unit, fn) FROM snapshot) AND addr IS NOT NULL AND addr NOT IN (SELECT addr FROM snapshot WHERE addr IS NOT NULL)""")
def bank_merge(spark, d):
    return lg.merge(*snaps(spark, d))


@query(SNAPS + "SELECT unit, fn, pct, best, CASE WHEN round(cur, 4) < best - 0.01 THEN 'carried' ELSE 'fresh' END AS kind FROM snapshot JOIN ledger USING (unit, fn) WHERE round(pct, 4) < best - 0.01")
def currency_split(spark, d):
    return lg.carried(*snaps(spark, d))


@query(SNAPS + """SELECT coalesce(s.unit, l.unit) AS unit, coalesce(s.fn, l.fn) AS fn, s.pct, l.best, CASE WHEN l.best IS NULL THEN 'ADDED' WHEN s.pct IS NULL THEN 'GONE' WHEN abs(s.pct - l.best) > 0.01 THEN 'CHANGED' ELSE 'SAME' END AS verdict FROM snapshot s FULL JOIN ledger l ON s.unit = l.unit AND s.fn = l.fn""")
def report_diff(spark, d):
    s, l = snaps(spark, d)  # noqa: E741
    j = s.select("unit", "fn", "pct").join(l.select("unit", "fn", "best"), ["unit", "fn"], "full_outer")
    verdict = F.when(F.col("best").isNull(), "ADDED").when(F.col("pct").isNull(), "GONE").when(F.abs(F.col("pct") - F.col("best")) > lg.EPS, "CHANGED").otherwise("SAME")
    return j.select("unit", "fn", "pct", "best", verdict.alias("verdict"))


@query(SNAPS + "SELECT l.unit, l.fn, l.best, l.hist, round(l.hist - l.best, 4) AS headroom, s.pct FROM ledger l LEFT JOIN snapshot s USING (unit, fn) WHERE l.best < 99.995")
def headroom_inventory(spark, d):
    s, l = snaps(spark, d)  # noqa: E741
    j = l.where("best < 99.995").join(s.select("unit", "fn", "pct"), ["unit", "fn"], "left")
    return j.select("unit", "fn", "best", "hist", F.round(F.col("hist") - F.col("best"), 4).alias("headroom"), "pct").orderBy(F.desc("headroom"), F.asc_nulls_last("pct"))


BAND = "CASE WHEN hist >= 100 THEN 0 WHEN cur >= 95 THEN 1 WHEN cur >= 90 THEN 2 ELSE 3 END"


@query(SNAPS + f"SELECT unit, fn, CAST({BAND} AS INTEGER) AS band, row_number() OVER (ORDER BY {BAND}, cur DESC, hist, fn) AS place FROM ledger ORDER BY place LIMIT 200")
def campaign_rank(spark, d):
    _, l = snaps(spark, d)  # noqa: E741
    band = F.when(F.col("hist") >= 100, 0).when(F.col("cur") >= 95, 1).when(F.col("cur") >= 90, 2).otherwise(3)
    top = l.withColumn("band", band).orderBy("band", F.desc("cur"), "hist", "fn").limit(200)  # a report of the first 200
    return top.select("unit", "fn", "band", F.row_number().over(Window.orderBy("band", F.desc("cur"), "hist", "fn")).cast("long").alias("place"))


@query("""WITH r AS (SELECT l_returnflag, l_linestatus, l_suppkey, l_extendedprice, l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_returnflag, l_linestatus, l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS n FROM lineitem)
SELECT l_returnflag, l_linestatus, l_suppkey, l_extendedprice, l_orderkey FROM (SELECT *, row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS m FROM r WHERE n = 1) WHERE m <= 50""")
def frontier_topm(spark, d):
    state = ["l_returnflag", "l_linestatus", "l_suppkey"]
    rank = [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey"]
    best = F.min(F.struct((-F.col("l_extendedprice")).alias("less"), "l_orderkey", "l_linenumber", "l_partkey")).alias("best")
    top = table(spark, d, "lineitem").groupBy(*state).agg(best).select(*state, (-F.col("best.less")).alias("l_extendedprice"), "best.l_orderkey", "best.l_linenumber", "best.l_partkey")
    return top.orderBy(*rank).limit(50).select(*state, "l_extendedprice", "l_orderkey")


WALL = """WITH found AS (SELECT l_partkey AS key, string_agg(DISTINCT l_shipmode, ',' ORDER BY l_shipmode) AS signals FROM (SELECT l_partkey, l_returnflag AS l_shipmode FROM lineitem WHERE l_partkey % 4 <> 1 AND l_linenumber < 3) GROUP BY l_partkey),
wall AS (SELECT l_partkey AS key, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS signals FROM lineitem WHERE l_partkey % 4 <> 2 AND l_linenumber >= 3 GROUP BY l_partkey) """


@query(WALL + "SELECT coalesce(f.key, w.key) AS key, f.signals AS found, w.signals AS listed, CASE WHEN w.key IS NULL THEN 'NEW' WHEN f.key IS NULL THEN 'GONE' WHEN f.signals <> w.signals THEN 'CHANGED' ELSE 'SAME' END AS verdict FROM found f FULL JOIN wall w ON f.key = w.key")
def set_reconcile(spark, d):
    line = table(spark, d, "lineitem").select(F.col("l_partkey").alias("key"), "l_linenumber", "l_returnflag")
    sets = lambda df, name: df.groupBy("key").agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias(name))
    found = sets(line.where("key % 4 <> 1 and l_linenumber < 3"), "found")
    listed = sets(line.where("key % 4 <> 2 and l_linenumber >= 3"), "listed")
    verdict = F.when(F.col("listed").isNull(), "NEW").when(F.col("found").isNull(), "GONE").when(F.col("found") != F.col("listed"), "CHANGED").otherwise("SAME")
    return found.join(listed, "key", "full_outer").select("key", "found", "listed", verdict.alias("verdict"))


@query("""WITH m AS (SELECT p_brand AS metric, count(*) AS n FROM part GROUP BY 1), f AS (SELECT p_brand AS metric, count(*) AS floor FROM part WHERE p_size > 1 AND p_brand NOT LIKE '%5' GROUP BY 1)
SELECT metric, n, floor, CASE WHEN floor IS NULL THEN 'NO-FLOOR' ELSE 'ABOVE' END AS finding FROM m LEFT JOIN f USING (metric) WHERE floor IS NULL OR n > floor""")
def ratchet_floor(spark, d):
    part = table(spark, d, "part").select(F.col("p_brand").alias("metric"), "p_size")
    floors = part.where("p_size > 1 and metric not like '%5'").groupBy("metric").agg(F.count("*").alias("floor"))
    j = part.groupBy("metric").agg(F.count("*").alias("n")).join(floors, "metric", "left").where("floor is null or n > floor")
    return j.withColumn("finding", F.when(F.col("floor").isNull(), "NO-FLOOR").otherwise("ABOVE"))
