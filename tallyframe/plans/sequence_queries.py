"""Queries of operators on ordered and two-sided evidence, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyframe.operators import alignment as al
from tallyframe.operators import repeats as rp
from tallyframe.operators import sequences as sq
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


def turns(spark, d):
    """Words of each turn and of the next one of its conversation."""
    w = Window.partitionBy("conv_id").orderBy("turn", "text")
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("([^ ]+)"), F.lit(1))
    c = table(spark, d, "conversations").withColumn("l", words)
    return c.withColumn("r", F.lead("l").over(w)).where("r is not null").select("conv_id", "turn", "l", "r")


@query()
def difflib_residual(spark, d):
    """Tested against plain code."""
    return sq.aligned(turns(spark, d), ["conv_id", "turn"], "l", "r")


@query("""WITH s AS (SELECT l_orderkey, list(l_returnflag || l_linestatus ORDER BY l_linenumber, l_returnflag || l_linestatus) FILTER (l_linenumber % 2 = 1) AS l, list(l_returnflag || l_linestatus ORDER BY l_linenumber, l_returnflag || l_linestatus) FILTER (l_linenumber % 2 = 0) AS r FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, CASE WHEN l = r THEN 'none' WHEN list_sort(l) = list_sort(r) THEN 'schedule' WHEN list_sort([x[1] for x in l]) = list_sort([x[1] for x in r]) THEN 'regname' WHEN len(l) <> len(r) THEN 'length' ELSE 'content' END AS class FROM s WHERE l IS NOT NULL AND r IS NOT NULL""")
def residual_classes(spark, d):
    """The two lanes of an order's lines, a handful each."""
    lane = lambda n: F.transform(F.array_sort(F.collect_list(F.when(F.col("l_linenumber") % 2 == n, F.struct("l_linenumber", F.concat("l_returnflag", "l_linestatus").alias("w"))))), lambda x: x["w"])
    s = table(spark, d, "lineitem").groupBy("l_orderkey").agg(lane(1).alias("l"), lane(0).alias("r")).where("size(l) > 0 and size(r) > 0")
    return s.select("l_orderkey", sq.residual_class(F.col("l"), F.col("r"), lambda x: F.substring(x, 1, 1)).alias("class"))


NAMES = [c for c, *_ in sq.CODES]
ROWS = ", ".join(f"('{c}', '{no}', {f"'{twin}'" if twin else 'NULL'}, '{group}')" for c, no, twin, group in sq.CODES)


@query(f"""WITH codes(code, comp, twin, grp) AS (VALUES {ROWS}), c AS (SELECT l_orderkey AS unit, {NAMES}[l_partkey % 16 + 1] AS code, sum(CASE WHEN l_linenumber % 2 = 1 THEN 1 ELSE -1 END) AS d FROM lineitem GROUP BY ALL),
g AS (SELECT u.unit, codes.*, coalesce(d, 0) AS d FROM (SELECT DISTINCT unit FROM c) u CROSS JOIN codes LEFT JOIN c ON c.unit = u.unit AND c.code = codes.code),
f AS (SELECT g.*, greatest(g.d, 0) AS o, greatest(-g.d, 0) AS r, least(greatest(g.d, 0), greatest(-x.d, 0)) AS flip, least(greatest(x.d, 0), greatest(-g.d, 0)) AS back FROM g JOIN g x ON x.unit = g.unit AND x.code = g.comp),
s AS (SELECT *, o - flip AS ro, r - back AS rr FROM f), t AS (SELECT s.*, coalesce(s.ro > 0 AND s.ro = y.rr, false) AS signed FROM s LEFT JOIN s y ON y.unit = s.unit AND y.code = s.twin)
SELECT unit, CASE WHEN bool_or(signed) THEN 'SIGNED' WHEN (bool_or(ro > 0 AND grp = 'EQ') AND bool_or(rr > 0 AND grp = 'ORD')) OR (bool_or(ro > 0 AND grp = 'ORD') AND bool_or(rr > 0 AND grp = 'EQ')) THEN 'OPERATOR' ELSE 'POLARITY' END AS kind,
CAST(sum(flip) AS BIGINT) AS flips, CAST(sum(o + r) AS BIGINT) AS delta, sum(o) = sum(r) AS balanced FROM t GROUP BY unit HAVING sum(o + r) > 0""")
def branch_codes(spark, d):
    line = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("unit"), F.element_at(F.array(*map(F.lit, NAMES)), (F.col("l_partkey") % 16 + 1).cast("int")).alias("code"), "l_linenumber")
    return sq.branch_codes(line, "unit", "code", F.col("l_linenumber") % 2 == 1)


@query("""WITH c AS (SELECT event_id // 64 AS unit, event_id AS pos, CASE WHEN event_type IN ('click', 'error') THEN event_id - user_id % 90 END AS target, event_type = 'view' AS call FROM events),
p AS (SELECT *, row_number() OVER w AS place, CAST(coalesce(sum(CASE WHEN call THEN 1 ELSE 0 END) OVER (PARTITION BY unit ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS calls FROM c WINDOW w AS (PARTITION BY unit ORDER BY pos))
SELECT b.unit, h.place AS head, b.place AS branch, b.place - h.place AS span, b.calls - h.calls AS calls FROM p b JOIN p h ON b.unit = h.unit AND b.target = h.pos AND b.target < b.pos""")
def loop_spans(spark, d):
    target = F.when(F.col("event_type").isin("click", "error"), F.col("event_id") - F.col("user_id") % 90)
    code = table(spark, d, "events").select(F.floor(F.col("event_id") / 64).alias("unit"), F.col("event_id").alias("at"), target.alias("target"), "event_type")
    return sq.loops(code, "unit", "at", "target", F.col("event_type") == "view")


@query("""WITH RECURSIVE r AS (SELECT o_custkey AS unit, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS at, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS k, date_diff('day', CAST(o_orderdate AS DATE), CAST(lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS DATE)) AS gap FROM orders),
p(unit, lo, hi) AS (SELECT unit, CAST(1 AS BIGINT), max(k) FROM r GROUP BY unit UNION ALL
SELECT unit, CASE WHEN k - lo + 1 <= hi - k THEN k + 1 ELSE lo END, CASE WHEN k - lo + 1 <= hi - k THEN hi ELSE k END FROM (SELECT p.unit, lo, hi, CAST(max(gap * 10000000 + k) % 10000000 AS BIGINT) AS k FROM p JOIN r ON p.unit = r.unit AND r.k >= lo AND r.k < hi AND gap >= 200 GROUP BY p.unit, lo, hi) WHERE least(k - lo + 1, hi - k) <= 3),
e AS (SELECT unit, max(lo) AS lo, min(hi) AS hi FROM p GROUP BY unit), n AS (SELECT unit, count(*) AS n FROM r GROUP BY unit)
SELECT unit, any_value(n) AS n, any_value(n) - count(*) AS outliers, min(r.at) AS lo, max(r.at) AS hi FROM r JOIN e USING (unit) JOIN n USING (unit) WHERE k BETWEEN e.lo AND e.hi GROUP BY unit""")
def outlier_peel(spark, d):
    days = F.unix_date(F.col("o_orderdate").cast("date")).cast("long")
    return sq.clusters(table(spark, d, "orders").select(F.col("o_custkey").alias("unit"), days.alias("at")), "unit", "at", gap=200)


@query("""WITH c AS (SELECT l_suppkey AS space, l_orderkey * 8 + l_linenumber AS key, l_orderkey * 40 + l_linenumber * 4 AS lo, l_orderkey * 40 + l_linenumber * 4 + CAST(l_quantity AS BIGINT) - 2 AS hi, l_returnflag AS kind FROM lineitem),
r AS (SELECT *, max(hi) OVER (PARTITION BY space ORDER BY lo RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach, count(*) OVER (PARTITION BY space, lo) AS n FROM c)
SELECT space, key, 'KIND' AS violation FROM r WHERE kind NOT IN ('A', 'N') UNION ALL SELECT space, key, 'EXTENT' FROM r WHERE hi <= lo UNION ALL SELECT space, key, 'RANGE' FROM r WHERE lo < 0 OR hi > 50000
UNION ALL SELECT space, key, 'DUPLICATE' FROM r WHERE n > 1 UNION ALL SELECT space, key, 'OVERLAP' FROM r WHERE reach > lo""")
def census_violations(spark, d):
    lo = F.col("l_orderkey") * 40 + F.col("l_linenumber") * 4
    c = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("space"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("key"), lo.alias("lo"), (lo + F.col("l_quantity").cast("long") - 2).alias("hi"), F.col("l_returnflag").alias("kind"))
    return sq.census_violations(c, ["space"], "key", "lo", "hi", "kind", ["A", "N"], 50000)


@query("""WITH u AS (SELECT l_orderkey AS key, min(l_returnflag) AS content FROM lineitem WHERE l_linenumber = 1 GROUP BY 1), h AS (SELECT l_orderkey AS key, min(l_returnflag) AS content FROM lineitem WHERE l_linenumber = 2 GROUP BY 1)
SELECT key, CASE WHEN h.content IS NULL THEN 'excluded' WHEN u.content IS NULL THEN 'local' WHEN h.content = u.content THEN 'exact' WHEN h.content = replace(u.content, 'A', 'N') THEN 'rename' WHEN key % 2 = 0 THEN 'target' ELSE 'seam' END AS class FROM u FULL JOIN h USING (key)""")
def parity_classes(spark, d):
    side = lambda n: table(spark, d, "lineitem").where(F.col("l_linenumber") == n).groupBy(F.col("l_orderkey").alias("key")).agg(F.min("l_returnflag").alias("content"))
    return sq.parity(side(1), side(2), "key", "content", F.regexp_replace("content", "A", "N"), F.col("key") % 2 == 0)


@query("""WITH e AS (SELECT DISTINCT o_custkey AS src, l_suppkey AS dst, l_shipdate < TIMESTAMP '1998-01-01' AS old FROM orders JOIN lineitem ON l_orderkey = o_orderkey), b AS (SELECT src, dst FROM e WHERE old), t AS (SELECT src, dst FROM e WHERE NOT old)
SELECT coalesce(b.src, t.src) AS src, coalesce(b.dst, t.dst) AS dst, CASE WHEN b.src IS NOT NULL AND t.src IS NOT NULL THEN 'MATCH' WHEN t.src IS NOT NULL THEN CASE WHEN t.dst IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) THEN 'MISSING' ELSE 'UNDEFINED' END WHEN b.dst IN (SELECT dst FROM t) THEN 'EXTRA' ELSE 'INLINED' END AS cause FROM b FULL JOIN t ON b.src = t.src AND b.dst = t.dst""")
def edge_reconcile(spark, d):
    e = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("src"), F.col("l_suppkey").alias("dst"), "l_shipdate")
    old = F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp_ntz")
    return sq.reconciled(e.where(old), e.where(~old), table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("node")))


@query("""WITH c AS (SELECT p_partkey AS key, md5(p_type) AS stamp, 'cached ' || p_type AS value FROM part WHERE p_size > 10), n AS (SELECT p_partkey AS key, md5(CASE WHEN p_size > 40 THEN p_brand ELSE p_type END) AS stamp FROM part)
SELECT n.key, n.stamp, CASE WHEN c.stamp = n.stamp THEN c.value ELSE 'new ' || n.stamp END AS value, coalesce(c.stamp = n.stamp, false) AS reused FROM n LEFT JOIN c USING (key)""")
def fingerprint_cache(spark, d):
    part = table(spark, d, "part")
    cache = part.where("p_size > 10").select(F.col("p_partkey").alias("key"), F.md5("p_type").alias("stamp"), F.concat(F.lit("cached "), F.col("p_type")).alias("value"))
    now = part.select(F.col("p_partkey").alias("key"), F.md5(F.when(F.col("p_size") > 40, F.col("p_brand")).otherwise(F.col("p_type"))).alias("stamp"))
    return sq.refreshed(cache, now, ["key"], "stamp", "value", F.concat(F.lit("new "), F.col("stamp")))


@query("""WITH n AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'name' || doc_id ELSE '$S' || doc_id END AS name, coalesce(text, '') AS content FROM documents)
SELECT doc_id, name, CASE WHEN name LIKE '$S%' THEN '$S_' || substr(sha256(content), 1, 12) ELSE name END AS content_name FROM n""")
def content_names(spark, d):
    name = F.concat(F.when(F.col("doc_id") % 3 == 0, "name").otherwise("$S"), F.col("doc_id").cast("string"))
    n = table(spark, d, "documents").select("doc_id", name.alias("name"), F.coalesce("text", F.lit("")).alias("content"))
    return n.select("doc_id", "name", sq.content_name(F.col("name"), F.col("content"), r"^\$S[0-9]+$").alias("content_name"))


PATTERNS = {"capitals": "[A-Z]+", "numbers": "[0-9]+", "links": "https?://", "marks": "[!?]", "licenses": "[Ll]icen[cs]e"}


@query("SELECT source, m.metric AS metric, CAST(sum(m.n) AS BIGINT) AS n FROM (SELECT source, unnest([" + ", ".join(f"{{'metric': '{n}', 'n': len(regexp_extract_all(coalesce(text, ''), '{p}'))}}" for n, p in PATTERNS.items()) + "]) AS m FROM documents) GROUP BY ALL")
def metric_vector(spark, d):
    return sq.metrics(table(spark, d, "documents"), "source", "text", PATTERNS)


@query()
def alignment_residual(spark, d):
    """Each turn of a conversation aligned with the next. Tested against brute force."""
    keys, pairs = ["conv_id", "turn"], numbered_turns(spark, d)
    sizes = pairs.select("pair", *keys, F.size("l").alias("n"), F.size("r").alias("m"))
    found = al.chunks(al.matches(al.spread(pairs, ["pair"], "l", "r"), ["pair"]), sizes, ["pair"])
    return al.residuals(found, sizes, ["pair"]).join(sizes, "pair").select(*keys, "n", "m", "residual", "chunks")


def numbered_turns(spark, d):
    """A conversation may have a turn twice, and no id."""
    return cut(turns(spark, d).withColumn("pair", F.monotonically_increasing_id()))


#: An instruction for each line of an order: the two lanes of an order are the sides of a pair.
FORMS = ["mov eax,[esi+0x{k}]", "mov {r},ebx", "mov [esi+0x{k}],{r}", "add {r},0x{k}", "call X|f{k}", "push {r}", "lea {r},[esi+0x{k}]", "ret"]


@query()
def instruction_residuals(spark, d):
    """Classes of differences between the returned and the other lines of an order, as code. Tested on cases of every class."""
    at = lambda xs, k: F.element_at(F.array(*map(F.lit, xs)), (k + 1).cast("int"))
    p = F.col("l_partkey")
    code = F.replace(F.replace(at(FORMS, p % len(FORMS)), F.lit("{r}"), at(["eax", "ecx", "edx"], F.col("l_linenumber") % 3)), F.lit("{k}"), F.lower(F.hex(4 + p % 5 * 4)))
    line = table(spark, d, "lineitem").withColumn("code", code)
    order = F.struct("l_linenumber", "l_partkey", "l_quantity", "code")
    lane = lambda ours: F.transform(F.array_sort(F.collect_list(F.when((F.col("l_returnflag") == "R") == ours, order))), lambda x: x["code"])
    pairs = cut(line.groupBy("l_orderkey").agg(lane(True).alias("l"), lane(False).alias("r")))
    sizes = pairs.select("l_orderkey", F.size("l").alias("n"), F.size("r").alias("m"))
    tokens = al.spread(pairs, ["l_orderkey"], "l", "r")
    return al.residual_classes(tokens, al.matches(tokens, ["l_orderkey"]), sizes, ["l_orderkey"])


@query("""WITH t AS (SELECT user_id AS unit, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, event_type AS token FROM events),
s AS (SELECT unit, list(token ORDER BY pos) AS all_ FROM t GROUP BY unit),
same AS (SELECT a.unit, a.pos AS i, b.pos - a.pos AS d, a.pos - row_number() OVER (PARTITION BY a.unit, b.pos - a.pos ORDER BY a.pos) AS island FROM t a JOIN t b ON a.unit = b.unit AND a.token = b.token AND a.pos < b.pos),
runs AS (SELECT unit, d, min(i) AS i, count(*) AS length FROM same GROUP BY unit, d, island HAVING count(*) >= 4),
starts AS (SELECT unit, i AS start, length FROM runs UNION SELECT unit, i + d, length FROM runs),
texts AS (SELECT unit, length, all_[start + 1 : start + length] AS text, count(*) AS copies FROM starts JOIN s USING (unit) GROUP BY ALL)
SELECT unit, length, copies, (SELECT min(p) FROM unnest(range(0, len(all_))) AS u(p) WHERE all_[p + 1 : p + length] = text) AS "at", text[-1] AS last, CASE WHEN text[-1] IN ('purchase', 'error') THEN 'suffix' ELSE 'prefix' END AS kind FROM texts JOIN s USING (unit)""")
def repeated_runs(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    tokens = table(spark, d, "events").select(F.col("user_id").alias("unit"), (F.row_number().over(w) - 1).alias("pos"), F.col("event_type").alias("token"))
    return rp.maximal_runs(cut(tokens), terminal=F.col("token").isin("purchase", "error"))
