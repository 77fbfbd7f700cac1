"""Queries of matching, graph, text and record operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyframe.operators import graph as gr
from tallyframe.operators import matching as mt
from tallyframe.operators import signatures as sg
from tallyframe.sources.tables import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


@query("""WITH l AS (SELECT doc_id, md5(text) AS k FROM documents WHERE doc_id % 2 = 0), r AS (SELECT doc_id AS other_id, md5(text) AS k FROM documents WHERE doc_id % 2 = 1),
n AS (SELECT k, count(DISTINCT doc_id) AS hits FROM l GROUP BY k), c AS (SELECT k, count(DISTINCT other_id) AS candidates, min(other_id) AS match FROM r GROUP BY k)
SELECT doc_id, coalesce(candidates, 0) AS candidates, CASE WHEN candidates = 1 THEN match END AS match, CASE WHEN candidates IS NULL THEN '' WHEN candidates = 1 AND hits = 1 THEN 'HIGH' ELSE 'AMBIG' END AS confidence FROM l JOIN n USING (k) LEFT JOIN c USING (k)""")
def bijective_match(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.md5(F.col("text")).alias("k"))
    return mt.bijective(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1").withColumnRenamed("doc_id", "other_id"), "k", "doc_id", "other_id")


@query("""WITH s AS (SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z]+')) AS fixed, len(regexp_extract_all(text, '[^ ]+')) AS length, md5(text) AS k FROM documents), a AS (SELECT *, count(*) OVER (PARTITION BY k) > 1 AS ambiguous FROM s)
SELECT doc_id, length, fixed, ambiguous, CASE WHEN length >= 16 AND fixed >= 10 AND NOT ambiguous THEN 'HIGH' WHEN NOT ambiguous THEN 'MEDIUM' WHEN length >= 16 AND fixed >= 10 THEN 'AMBIG' ELSE 'LOW' END AS confidence FROM a WHERE length >= 8 AND fixed >= 6""")
def fid_confidence(spark, d):
    words = lambda p: F.size(F.regexp_extract_all("text", F.lit(f"({p})"), F.lit(1))).cast("long")
    s = table(spark, d, "documents").select("doc_id", words("[A-Za-z]+").alias("fixed"), words("[^ ]+").alias("length"), F.md5(F.col("text")).alias("k"))
    many = s.groupBy("k").agg((F.count("*") > 1).alias("ambiguous"))
    s = s.join(many, "k").withColumn("confidence", mt.grade(F.col("length"), F.col("fixed"), F.col("ambiguous"))).where("confidence is not null")
    return s.select("doc_id", "length", "fixed", "ambiguous", "confidence")


@query("""WITH m AS (SELECT doc_id, md5(regexp_replace(text, '[0-9]+', '#', 'g')) AS mask, length(text) AS n FROM documents) SELECT mask, count(*) AS copies, min(doc_id) AS first_id, max(n) AS longest FROM m GROUP BY mask HAVING count(*) > 1""")
def masked_match(spark, d):
    m = table(spark, d, "documents").select("doc_id", F.md5(mt.masked(F.col("text"), "[0-9]+", "#")).alias("mask"), F.length("text").cast("long").alias("n"))
    return m.groupBy("mask").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"), F.max("n").alias("longest")).where("copies > 1")


@query("""WITH w AS (SELECT doc_id, string_split(text, ' ') AS t FROM documents),
s AS (SELECT DISTINCT doc_id, 1 AS narrow, array_to_string(t[i + 1 : i + 12], ' ') AS g FROM w, unnest(range(0, len(t) - 11)) AS u(i)
UNION ALL SELECT DISTINCT doc_id, 0, array_to_string(t[i + 1 : i + 24], ' ') FROM w, unnest(range(0, len(t) - 23)) AS u(i) WHERE len(list_distinct(t[i + 1 : i + 24])) = 1),
m AS (SELECT narrow, g FROM s GROUP BY ALL HAVING count(*) > 1), k AS (SELECT * FROM s JOIN m USING (narrow, g)),
c AS (SELECT doc_id, md5(string_agg(narrow || g, chr(10) ORDER BY narrow, g)) AS class, sum(narrow) AS shared, count(*) AS n FROM k GROUP BY doc_id), r AS (SELECT class, min(doc_id) AS a FROM c GROUP BY class),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, sum(x.narrow) AS shared, min(x.narrow) AS least FROM k x JOIN k y ON x.narrow = y.narrow AND x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL)
SELECT a, doc_id AS b, CAST(shared AS BIGINT) AS shared, true AS same FROM c JOIN r USING (class) WHERE doc_id <> a AND (shared >= 2 OR n > shared)
UNION ALL SELECT a, b, CAST(shared AS BIGINT), false FROM p WHERE (shared >= 2 OR least = 0) AND a IN (SELECT a FROM r) AND b IN (SELECT a FROM r)""")
def shingle_clone_pairs(spark, d):
    return mt.clones(table(spark, d, "documents"), "doc_id", F.split("text", " "), wide=24, narrow=12)


BAGS = """WITH l AS (SELECT s_nationkey AS unit, l_returnflag || l_linestatus || (l_linenumber % 5) AS key FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_shipdate < TIMESTAMP '1998-01-01'),
r AS (SELECT s_nationkey AS unit, l_returnflag || l_linestatus || (l_linenumber % 6) AS key FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_shipdate >= TIMESTAMP '1998-01-01'),
a AS (SELECT unit, key, count(*) AS n_left FROM l GROUP BY ALL), b AS (SELECT unit, key, count(*) AS n_right FROM r GROUP BY ALL),
j AS (SELECT coalesce(a.unit, b.unit) AS unit, coalesce(a.key, b.key) AS key, coalesce(n_left, 0) AS n_left, coalesce(n_right, 0) AS n_right FROM a FULL JOIN b ON a.unit = b.unit AND a.key = b.key) """


def bags(spark, d):
    line = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    side = lambda cond, k: line.where(cond).select(F.col("s_nationkey").alias("unit"), F.concat("l_returnflag", "l_linestatus", (F.col("l_linenumber") % k).cast("string")).alias("key"))
    early = F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp_ntz")
    return mt.bag_difference(side(early, 5), side(~early, 6), ["unit"], "key")


@query(BAGS + "SELECT unit, key, n_left, n_right, n_left - n_right AS surplus FROM j WHERE n_left <> n_right")
def multiset_diff(spark, d):
    return bags(spark, d).drop("exclusive")


@query(BAGS + "SELECT unit, key, n_left, n_right FROM j WHERE least(n_left, n_right) = 0 AND greatest(n_left, n_right) >= 2")
def exclusive_keys(spark, d):
    return bags(spark, d).where("exclusive").select("unit", "key", "n_left", "n_right")


@query("""SELECT c_custkey, CASE WHEN c_nationkey % 5 = 0 THEN 'referent' WHEN c_acctbal < 0 THEN 'inline' WHEN c_mktsegment = 'BUILDING' THEN 'cfg' WHEN c_acctbal > 9000 THEN 'regalloc' ELSE 'none' END AS divergence FROM customer""")
def divergence_ladder(spark, d):
    steps = [(F.col("c_nationkey") % 5 == 0, "referent"), (F.col("c_acctbal") < 0, "inline"), (F.col("c_mktsegment") == "BUILDING", "cfg"), (F.col("c_acctbal") > 9000, "regalloc")]
    return table(spark, d, "customer").select("c_custkey", mt.ladder(*steps).alias("divergence"))


@query("""WITH a AS (SELECT o_custkey, list(o_orderstatus ORDER BY o_orderkey) AS x FROM orders WHERE o_orderkey % 2 = 0 GROUP BY o_custkey), b AS (SELECT o_custkey, list(o_orderstatus ORDER BY o_orderkey) AS y FROM orders WHERE o_orderkey % 2 = 1 GROUP BY o_custkey),
p AS (SELECT o_custkey, x, y FROM a JOIN b USING (o_custkey)) SELECT o_custkey, array_to_string(x, ',') AS left_run, array_to_string(y, ',') AS right_run FROM p WHERE list_sort(x) = list_sort(y) AND x <> y""")
def permuted_runs(spark, d):
    o = table(spark, d, "orders")

    def run(lane: int, name: str):
        mine = o.where(F.col("o_orderkey") % 2 == lane).groupBy("o_custkey")
        return mine.agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))), lambda s: s["o_orderstatus"]).alias(name))

    p = run(0, "x").join(run(1, "y"), "o_custkey").where((F.array_sort("x") == F.array_sort("y")) & (F.col("x") != F.col("y")))
    return p.select("o_custkey", F.array_join("x", ",").alias("left_run"), F.array_join("y", ",").alias("right_run"))


@query("""WITH s AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id, event_id % 2 ORDER BY event_id) AS n, event_id % 2 AS lane FROM events),
j AS (SELECT a.user_id, a.n, a.event_type = b.event_type AS same FROM s a JOIN s b ON a.user_id = b.user_id AND a.n = b.n AND a.lane = 0 AND b.lane = 1)
SELECT user_id, coalesce(min(n) FILTER (NOT same) - 1, count(*)) AS prefix FROM j GROUP BY user_id""")
def common_prefix_len(spark, d):
    w = Window.partitionBy("user_id", "lane").orderBy("event_id")
    s = table(spark, d, "events").select("user_id", "event_type", "event_id", (F.col("event_id") % 2).alias("lane")).withColumn("n", F.row_number().over(w))
    j = s.where("lane = 0").select("user_id", "n", "event_type").join(s.where("lane = 1").select("user_id", "n", F.col("event_type").alias("other")), ["user_id", "n"])
    return j.groupBy("user_id").agg(F.coalesce(F.min(F.when(F.col("event_type") != F.col("other"), F.col("n"))) - 1, F.count("*")).cast("long").alias("prefix"))


EDGES = "SELECT o_custkey AS src, l_suppkey AS dst FROM orders JOIN lineitem ON l_orderkey = o_orderkey"


@query(f"WITH e AS ({EDGES}) SELECT dst, src, count(*) AS n FROM e GROUP BY dst, src")
def callers_count(spark, d):
    e = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("src"), F.col("l_suppkey").alias("dst"))
    return gr.callers(e)


@query("""WITH RECURSIVE f AS (SELECT p_partkey AS node, p_partkey // 2 AS next FROM part WHERE p_partkey % 3 <> 0 AND p_partkey > 1),
e AS (SELECT DISTINCT l_orderkey AS src, l_partkey AS dst FROM lineitem),
c AS (SELECT src, dst, dst AS target, 0 AS hops FROM e UNION ALL SELECT src, dst, next, hops + 1 FROM c JOIN f ON target = node WHERE hops < 4)
SELECT src, dst, CAST(arg_max(target, hops) AS BIGINT) AS target, max(hops) AS hops FROM (SELECT DISTINCT * FROM c) GROUP BY src, dst""")
def forwarder_chase(spark, d):
    f = table(spark, d, "part").where("p_partkey % 3 <> 0 and p_partkey > 1").select(F.col("p_partkey").alias("node"), F.floor(F.col("p_partkey") / 2).cast("long").alias("next"))
    e = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()
    return gr.chase(e, f).select("src", "dst", "target", "hops")


LINKS = "SELECT p_partkey AS src, (p_partkey * 7 + p_size) % 2000 AS dst FROM part WHERE p_partkey % 4 <> 0"


def links(spark, d):
    p = table(spark, d, "part").where("p_partkey % 4 <> 0")
    return p.select(F.col("p_partkey").alias("src"), ((F.col("p_partkey") * 7 + F.col("p_size")) % 2000).alias("dst"))


@query(f"WITH RECURSIVE e AS ({LINKS}), r AS (SELECT p_partkey AS node FROM part WHERE p_partkey % 50 = 1 UNION SELECT dst FROM r JOIN e ON node = src) SELECT p_partkey AS dead FROM part WHERE p_partkey NOT IN (SELECT node FROM r)")
def reachability_dead(spark, d):
    part = table(spark, d, "part").select(F.col("p_partkey").alias("node"))
    return part.join(gr.reachable(links(spark, d), part.where("node % 50 = 1")), "node", "left_anti").select(F.col("node").alias("dead"))


@query(f"WITH RECURSIVE e AS ({LINKS}), a AS (SELECT p_partkey AS start, p_partkey AS ancestor, 0 AS depth FROM part UNION SELECT start, src, depth + 1 FROM a JOIN e ON ancestor = dst WHERE depth < 4) SELECT start, ancestor, min(depth) AS depth FROM a GROUP BY start, ancestor HAVING min(depth) > 0")
def ancestry_depth4(spark, d):
    return gr.ancestors(links(spark, d), table(spark, d, "part").select(F.col("p_partkey").alias("node")))


@query("""WITH RECURSIVE t AS (SELECT CAST(p_partkey AS BIGINT) AS node, CASE WHEN p_partkey % 40 <> 0 THEN p_partkey - p_partkey % 2 - CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 0 END END AS parent FROM part WHERE p_partkey > 1),
k AS (SELECT t.node, p.node AS parent FROM t LEFT JOIN t p ON t.parent = p.node), c AS (SELECT node, node AS root, 0 AS depth FROM k UNION ALL SELECT c.node, k.parent, depth + 1 FROM c JOIN k ON c.root = k.node WHERE k.parent IS NOT NULL)
SELECT node, CAST(arg_max(root, depth) AS BIGINT) AS root, max(depth) AS depth FROM c GROUP BY node""")
def closure_roots(spark, d):
    p = F.col("node")
    t = table(spark, d, "part").where("p_partkey > 1").select(F.col("p_partkey").alias("node"))
    t = t.withColumn("parent", F.when(p % 40 != 0, p - p % 2 - F.when(p % 2 == 0, 2).otherwise(0)))
    k = t.join(t.select(F.col("node").alias("parent"), F.lit(True).alias("there")), "parent", "left").select("node", F.when(F.col("there"), F.col("parent")).alias("parent"))
    return gr.roots_of(k)


@query("""SELECT page_id, len(regexp_extract_all(html, '[ -~\\t]{4,}')) AS runs, list_max(list_transform(regexp_extract_all(html, '[ -~\\t]{4,}'), lambda x: length(x))) AS longest FROM pages""".replace("\\t", "\t"))
def string_runs(spark, d):
    found = F.regexp_extract_all("html", F.lit("([\\x20-\\x7e\\t]{4,})"), F.lit(1))
    return table(spark, d, "pages").select("page_id", F.size(found).cast("long").alias("runs"), F.array_max(F.transform(found, F.length)).cast("long").alias("longest"))


@query("""WITH t AS (SELECT doc_id, unnest(list_distinct(string_split(text, ' '))) AS literal FROM documents), s AS (SELECT doc_id, CAST(sum(CASE WHEN regexp_matches(literal, '[0-9]{3}|[A-Z]{3}|@') THEN 3 ELSE 1 END) AS BIGINT) AS score FROM t WHERE length(literal) >= 4 GROUP BY doc_id)
SELECT doc_id, score FROM s ORDER BY score DESC, doc_id LIMIT 100""")
def literal_rank(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(F.split("text", " "))).alias("literal")).where(F.length("literal") >= 4)
    s = t.groupBy("doc_id").agg(F.sum(F.when(F.col("literal").rlike("[0-9]{3}|[A-Z]{3}|@"), 3).otherwise(1)).alias("score"))
    return s.orderBy(F.desc("score"), "doc_id").limit(100)  # a report of the first hundred


@query("""WITH t AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '("[^"]*"|[A-Za-z_][A-Za-z0-9_]*|[0-9]+|[^\\sA-Za-z0-9_])')) AS tok FROM conversations)
SELECT conv_id, turn, count(*) FILTER (regexp_matches(tok, '^[A-Za-z_]')) AS ids, count(*) FILTER (regexp_matches(tok, '^[0-9]')) AS nums, count(*) FILTER (regexp_matches(tok, '^"')) AS strs, count(*) AS tokens FROM t GROUP BY conv_id, turn""")
def token_classes(spark, d):
    t = table(spark, d, "conversations").select("conv_id", "turn", mt.token_classes(F.col("text")).alias("t")).where(F.size("t") > 0)
    n = lambda kind: F.size(F.filter("t", lambda x: x == kind)).cast("long")
    return t.select("conv_id", "turn", n("ID").alias("ids"), n("NUM").alias("nums"), n("STR").alias("strs"), F.size("t").cast("long").alias("tokens"))


@query("""WITH h AS (SELECT lang, hex(encode(text)) AS x FROM documents WHERE text <> ''), c AS (SELECT lang, substr(x, 2 * i + 1, 2) AS two FROM h, unnest(range(0, length(x) // 2)) u(i))
SELECT lang, CAST(('0x' || two) AS INTEGER) AS code, count(*) AS n FROM c GROUP BY lang, two""")
def byte_histogram(spark, d):
    return mt.byte_histogram(table(spark, d, "documents"), "lang", "text")


def last_lines(docs):
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    keyed = lines.withColumn("id", ((F.col("pos") * 7 + F.col("doc_id")) % 5).cast("long"))
    last = keyed.groupBy("doc_id", "id").agg(F.max(F.struct("pos", F.length("line").cast("long").alias("chars"))).alias("last"))
    return last.select("doc_id", "id", "last.chars", F.col("last.pos").cast("long").alias("pos"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents), i AS (SELECT *, (pos * 7 + doc_id) % 5 AS id FROM l)
SELECT doc_id, CAST(id AS BIGINT) AS id, arg_max(length(line), pos) AS chars, CAST(max(pos) AS BIGINT) AS pos FROM i GROUP BY doc_id, id""")
def positional_join_last_all(spark, d):
    return last_lines(table(spark, d, "documents"))


@query("""WITH m AS (SELECT l_partkey AS path, l_linenumber AS mount, min(l_suppkey) AS value, bool_or(l_returnflag = 'R' AND l_quantity > 45) AS disabled FROM lineitem GROUP BY ALL), f AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY mount) AS n FROM m)
SELECT path, mount, CASE WHEN disabled THEN NULL ELSE value END AS value, disabled FROM f WHERE n = 1""")
def overlay_lookup(spark, d):
    m = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("path"), F.col("l_linenumber").alias("mount")).agg(F.min("l_suppkey").alias("value"), F.bool_or((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45)).alias("disabled"))
    # A disabled record is found, and ends the search: it does not fall through to a later mount.
    first = m.groupBy("path").agg(F.min(F.struct("mount", "value", "disabled")).alias("f"))
    return first.select("path", "f.mount", F.when(~F.col("f.disabled"), F.col("f.value")).alias("value"), "f.disabled")


@query("SELECT o_orderkey, CAST(o_orderkey & 7 AS BIGINT) AS flags, CAST((o_orderkey >> 3) & 31 AS BIGINT) AS regs, CAST((o_orderkey >> 8) & 63 AS BIGINT) AS frame, (o_orderkey >> 14) & 1 = 1 AS has_seh FROM orders")
def bitfield_decode(spark, d):
    k = F.col("o_orderkey")
    part = lambda shift, mask: F.shiftright(k, shift).bitwiseAND(F.lit(mask))
    return table(spark, d, "orders").select("o_orderkey", part(0, 7).cast("long").alias("flags"), part(3, 31).cast("long").alias("regs"), part(8, 63).cast("long").alias("frame"), (part(14, 1) == 1).alias("has_seh"))


FIELDS = "(VALUES (0, 4, 'key', false), (4, 8, 'custkey', false), (12, 4, 'status', false), (16, 8, 'price', true), (24, 16, 'date.parts', false), (32, 4, 'date.day', false)) f(off, size, path, is_float)"


@query(f"SELECT o_orderkey, CAST(o_orderkey % 48 AS BIGINT) AS at_off, (SELECT arg_min(path, size) FROM {FIELDS} WHERE off <= o_orderkey % 48 AND o_orderkey % 48 < off + size) AS path FROM orders")
def nested_field_at(spark, d):
    fields = spark.createDataFrame([(0, 4, "key"), (4, 8, "custkey"), (12, 4, "status"), (16, 8, "price"), (24, 16, "date.parts"), (32, 4, "date.day")], "off long, size long, path string")
    # The innermost field over each byte: one row a byte, so the lookup is an equi-join.
    at = fields.select(F.explode(F.sequence("off", F.col("off") + F.col("size") - 1)).alias("at_off"), "size", "path").groupBy("at_off").agg(F.min_by("path", "size").alias("path"))
    return table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 48).alias("at_off")).join(at, "at_off", "left").select("o_orderkey", "at_off", "path")


@query("SELECT c.key, c.name, count(*) AS sites, count(DISTINCT a.fn) AS fns, max(a.width) AS width FROM (SELECT l_partkey AS key, l_orderkey AS fn, l_linenumber AS width FROM lineitem) a JOIN (SELECT p_partkey AS key, p_name AS name FROM part) c USING (key) WHERE key BETWEEN 100 AND 400 GROUP BY c.key, c.name")
def sql_map(spark, d):
    from tallyframe.plans.sql_surface import SqlMap

    m = SqlMap(spark)
    m.register("access", table(spark, d, "lineitem").select(F.col("l_partkey").alias("key"), F.col("l_orderkey").alias("fn"), F.col("l_linenumber").alias("width")))
    m.register("claim", table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name")))
    return m.sql("SELECT c.key, c.name, count(*) AS sites, count(DISTINCT a.fn) AS fns, max(a.width) AS width FROM {access} a JOIN {claim} c USING (key) WHERE key BETWEEN :lo AND :hi GROUP BY c.key, c.name", lo=100, hi=400)


@query("""SELECT doc_id, regexp_extract(text, '[0-9]+') AS digits, replace(replace(text, chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n') AS escaped, substr(sha1(text), 1, 12) AS fp, split_part(source, 'c', 2) AS tail FROM documents""")
def scalar_text(spark, d):
    from tallyframe.functions import scalars as sc

    text = F.col("text")
    return table(spark, d, "documents").select("doc_id", sc.first_digits(text).alias("digits"), sc.escape(text).alias("escaped"), sc.fingerprint(text).alias("fp"), F.split_part("source", F.lit("c"), F.lit(2)).alias("tail"))


@query("""SELECT o_orderkey, lower(printf('0x%x', o_orderkey)) AS hex, CAST(((o_orderkey * 37 + 32768) % 65536 + 65536) % 65536 - 32768 AS BIGINT) AS wrapped, CAST(-(o_orderkey // 7) AS BIGINT) AS truncated, CAST((o_orderkey + 15) // 16 * 16 AS BIGINT) AS aligned FROM orders""")
def scalar_integers(spark, d):
    from tallyframe.functions import scalars as sc

    k = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", sc.to_hex(k).alias("hex"), sc.wrap16(k * 37).alias("wrapped"), sc.truncating_div(-k, F.lit(7)).alias("truncated"), sc.align(k, 16).alias("aligned"))


@query("""WITH d AS (SELECT doc_id, regexp_extract_all(text, '[^ ]+') AS w FROM documents), s AS (SELECT min(doc_id) AS sig, w[11:18] AS p FROM d WHERE len(w) >= 18 GROUP BY w[11:18]),
places AS (SELECT doc_id AS unit, i AS start, w[i + 1 : i + 8] AS x FROM d, unnest(range(0, greatest(len(w) - 7, 0))) AS u(i))
SELECT unit, start, sig, CAST(8 AS INTEGER) AS length, CAST(7 AS INTEGER) AS fixed FROM places JOIN s ON x[1:3] = p[1:3] AND x[5:8] = p[5:8]""")
def signature_probe(spark, d):
    """Eight words of every document, the fourth any word, looked for in all; each once, under its first document."""
    words = F.regexp_extract_all("text", F.lit("([^ ]+)"), F.lit(1))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("unit"), words.alias("payload"), F.lit(None).cast("array<int>").alias("sites"))
    sigs = docs.where("size(payload) >= 18").groupBy(F.slice("payload", 11, 8).alias("payload")).agg(F.min("unit").alias("sig")).withColumn("sites", F.array(F.lit(3)))
    return sg.probe(docs, sigs)


@query("""WITH h AS (SELECT DISTINCT l_orderkey AS location, 'p' || l_partkey AS identity, CAST(l_quantity AS BIGINT) AS length, CAST(l_quantity AS BIGINT) - l_linenumber % 5 AS fixed FROM lineitem), k AS (SELECT * FROM h WHERE length >= 8 AND fixed >= 6),
a AS (SELECT k.*, reverse, names FROM k JOIN (SELECT identity, count(DISTINCT location) AS reverse FROM k GROUP BY identity) USING (identity) JOIN (SELECT location, count(DISTINCT identity) AS names FROM k GROUP BY location) USING (location))
SELECT location, identity, length, fixed, reverse, names, CASE WHEN reverse = 1 AND names = 1 THEN CASE WHEN length >= 16 AND fixed >= 10 THEN 'HIGH' ELSE 'MEDIUM' END WHEN length >= 16 AND fixed >= 10 THEN 'AMBIG' ELSE 'LOW' END AS confidence FROM a""")
def two_way_confidence(spark, d):
    hits = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("location"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("identity"), F.col("l_quantity").cast("long").alias("length"), (F.col("l_quantity").cast("long") - F.col("l_linenumber") % 5).alias("fixed"))
    return mt.graded(hits, "location", "identity")
