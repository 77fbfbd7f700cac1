import pytest
from pyspark.sql import functions as F

from tallyframe.functions import scalars as sc
from tallyframe.operators import gates, graph, intervals, ledger, matching
from tallyframe.plans.sql_surface import SqlMap
from tallyframe.sources import tsv


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_coalesce_touching_and_tolerance(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 5, 9), (1, 12, 14), (1, 13, 20), (2, 0, 1)], "s int, lo long, hi long")
    assert rows(intervals.coalesce(df, ["s"], "lo", "hi"), "s", "lo", "hi", "parts") == [(1, 0, 9, 2), (1, 12, 20, 2), (2, 0, 1, 1)]
    assert rows(intervals.coalesce(df, ["s"], "lo", "hi", tolerance=3), "s", "lo", "hi") == [(1, 0, 20), (2, 0, 1)]
    assert rows(intervals.gaps(intervals.coalesce(df, ["s"], "lo", "hi"), ["s"]), "s", "gap_lo", "gap_hi") == [(1, 9, 12)]


def test_overlaps_come_once(spark):
    a = spark.createDataFrame([(0, 0, 1000)], "s int, lo long, hi long")
    b = spark.createDataFrame([(0, 5, 300), (0, 1000, 1001)], "s int, lo long, hi long")
    assert rows(intervals.overlaps(a, b, ["s"], 16), "lo", "hi") == [(5, 300)]


def test_asof_takes_an_anchor_at_the_point(spark):
    p = spark.createDataFrame([(1, 10), (1, 5)], "s int, pos long")
    a = spark.createDataFrame([(1, 10, "x"), (1, 20, "y")], "s int, pos long, name string")
    assert rows(intervals.asof(p, a, ["s"], "pos", ["name"]), "pos", "anchor_name") == [(10, "x"), (5, None)]
    assert rows(intervals.asof(p, a, ["s"], "pos", ["name"], forward=True), "pos", "anchor_name") == [(10, "x"), (5, "x")]


def test_ledger_events_and_merge(spark):
    snap = spark.createDataFrame([("u", "a", 90.0, "1", 1), ("u", "b", 50.0, "1", 2), ("v", "c", 10.0, "1", 3), ("u", "n", 1.0, "1", None)], "unit string, fn string, pct double, fp string, addr long")
    base = spark.createDataFrame(
        [("u", "a", 80.0, 80.0, 85.0, 2, "1", 1, ""), ("u", "b", 60.0, 60.0, 60.0, 1, "2", 2, ""), ("u", "c", 10.0, 10.0, 10.0, 1, "1", 3, ""), ("u", "gone", 5.0, 5.0, 5.0, 1, "1", 9, "absent")],
        "unit string, fn string, best double, cur double, hist double, tries long, fp string, addr long, state string",
    )
    assert rows(ledger.classify(snap, base), "fn", "event") == [("a", "IMPROVE"), ("b", "REGRESS"), ("c", "MOVED"), ("gone", "KNOWN-ABSENT"), ("n", "NEW")]
    assert rows(ledger.merge(snap, base), "fn", "best", "hist", "tries", "state") == [("a", 90.0, 90.0, 2, ""), ("b", 50.0, 60.0, 2, ""), ("c", 10.0, 10.0, 1, ""), ("gone", 5.0, 5.0, 1, "absent"), ("n", 1.0, 1.0, 1, "")]


def test_graph(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5)], "src long, dst long")
    start = spark.createDataFrame([(1,)], "node long")
    assert rows(graph.reachable(e, start), "node", "depth") == [(1, 0), (2, 1), (3, 2)]
    assert rows(graph.ancestors(e, start), "ancestor", "depth") == [(2, 2), (3, 1)]
    f = spark.createDataFrame([(2, 9), (9, 8)], "node long, next long")
    assert rows(graph.chase(e.where("src = 1"), f), "target", "hops") == [(8, 2)]


def test_gates(spark):
    r = gates.Registry()
    some = spark.createDataFrame([("a", "x"), ("b", None)], "id string, kind string")
    r.add("kinds", "fast", lambda: (some, gates.outside_domain(some, "id", "kind", ["x"])))
    r.add("empty", "normal", lambda: (some.where("false"), gates.outside_domain(some.where("false"), "id", "kind", ["x"])))
    assert rows(r.findings("fast"), "gate", "category", "key") == [("kinds", "DOMAIN", "b")]
    assert rows(r.findings("normal"), "gate", "category") == [("empty", "VACUOUS"), ("kinds", "DOMAIN")]
    with pytest.raises(ValueError):
        r.add("kinds", "fast", lambda: None)


def test_clones_link_copies(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(1, text), (2, "zz " + text), (3, "other words here")], "id long, text string")
    assert rows(matching.clones(df, "id", F.split("text", " "), 24, 12), "a", "b") == [(1, 2)]


def test_pairs_of_a_shingle_are_dealt_out(spark, monkeypatch):
    text = " ".join(f"w{i}" for i in range(14))
    df = spark.createDataFrame([(k, f"{text} own{k} more{k % 5}") for k in range(30)] + [(90 + k, f"x{k} {text} y{k}") for k in range(9)], "id long, text string")
    got = {}
    for most in (10**9, 100):
        monkeypatch.setattr(matching, "PAIRS", most)
        got[most] = sorted(map(tuple, matching.clones(df, "id", F.split("text", " "), 24, 12).collect()))
    assert got[100] == got[10**9] and len(got[100]) > 20


def test_equal_halves_of_runs_are_hashed_once(spark):
    df = spark.createDataFrame([([*range(30)],), ([*range(12)],), ([1, 2],), ([],)], "t array<bigint>")
    plan = df.select(matching.runs_of(F.col("t"), 12).alias("r"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("zip_with") == 4
    h = lambda *xs: F.xxhash64(*xs)
    two = lambda k: h(F.col("t")[k], F.col("t")[k + 1])
    three = lambda k: h(F.col("t")[k], two(k + 1))
    six = lambda k: h(three(k), three(k + 3))
    sizes = [len(r[0]) for r in df.select(matching.runs_of(F.col("t"), 12)).collect()]
    assert sizes == [19, 1, 0, 0]
    run = df.limit(1).select(matching.runs_of(F.col("t"), 12).alias("r"), h(six(0), six(6)).alias("a"), h(six(18), six(24)).alias("z")).first()
    assert (run.r[0], run.r[-1]) == (run.a, run.z)


def test_scalars(spark):
    df = spark.createDataFrame([("0x1f",), (" 12 ",), ("no",), (None,)], "t string")
    assert [r[0] for r in df.select(sc.parse_int(F.col("t"))).collect()] == [31, 12, None, None]
    one = spark.range(1).select(sc.wrap16(F.lit(40000)), sc.truncating_div(F.lit(-7), F.lit(2)), sc.align(F.lit(17), 16), sc.percent(F.lit(1), F.lit(0))).first()
    assert tuple(one) == (-25536, -3, 32, 0.0)


def test_sql_map(spark):
    m = SqlMap(spark)
    m.register("t", spark.createDataFrame([(1, "a_b"), (2, "acb")], "k int, name string"))
    assert rows(m.sql("select k from {t} where k > :lo", lo=1), "k") == [(2,)]
    assert rows(m.named("t", "name", "A_"), "k") == [(1,)]
    assert rows(m.within("t", "k", 1, 2), "k") == rows(m.at("t", "k", 1), "k") == [(1,)]


def test_tsv(spark, tmp_path):
    (tmp_path / "one.tsv").write_text('# banner\nrva\tname\n1\ta"b\n2\t\n')
    got = tsv.read_units(spark, str(tmp_path), "rva long, name string")
    assert rows(got, "rva", "name", "unit") == [(1, 'a"b', "one"), (2, None, "one")]
    (tmp_path / "two.tsv").write_text("rva\tname\nx\ty\n")
    with pytest.raises(Exception):
        tsv.read(spark, str(tmp_path / "two.tsv"), "rva long, name string").collect()
    df = spark.range(3)
    at = str(tmp_path / "out")
    assert tsv.write_if_changed(spark, df, at) and not tsv.write_if_changed(spark, df, at) and tsv.write_if_changed(spark, spark.range(4), at)
    assert tsv.set_digest(df, ["id"]) == tsv.set_digest(df.orderBy(F.desc("id")), ["id"]) != tsv.set_digest(spark.range(4), ["id"])
