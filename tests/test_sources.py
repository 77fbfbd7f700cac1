"""Versions of tables, harvests of what changed, scans that tell of bad rows, and maps in buckets."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import graph
from tallyframe.sources import persisted, tolerant, tsv, versions


def test_versions_survive_a_crash(spark, tmp_path, monkeypatch):
    at = f"{tmp_path}/t"
    assert versions.read(spark, at) is None
    assert tsv.write_if_changed(spark, spark.range(3), at) and not tsv.write_if_changed(spark, spark.range(3).repartition(2), at)
    whole = versions.folder
    monkeypatch.setattr(versions, "folder", lambda *a: (_ for _ in ()).throw(OSError("crash")))
    with pytest.raises(OSError):
        versions.publish(spark, spark.range(9), at)
    monkeypatch.setattr(versions, "folder", whole)
    # What the crash left behind is no version.
    assert versions.versions(spark, at) == [1] and versions.read(spark, at).count() == 3
    assert tsv.write_if_changed(spark, spark.range(4), at) and versions.versions(spark, at) == [2]
    assert versions.publish(spark, spark.range(5), at, keep=2) == 3 and versions.versions(spark, at) == [2, 3]
    assert tsv.differs(spark.range(2), spark.range(2).withColumn("x", F.lit(1))) and tsv.differs(spark.range(2), spark.range(2).union(spark.range(1)))


def test_harvest_reads_and_writes_what_changed(spark, tmp_path):
    os.mkdir(tmp_path / "in")
    text = {f"u{k}": f"a{k} b{k}" for k in range(5)} | {"odd [name]{x}": "q"}
    put = lambda n: (tmp_path / "in" / f"{n}.txt").write_text(text[n])
    for n in text:
        put(n)
    seen = spark.sparkContext.accumulator(0)

    def derive(files):
        def run(batches):
            for b in batches:
                seen.add(len(b))
                yield b

        told = files.mapInPandas(run, files.schema)
        return told.select("path", F.explode(F.split(F.decode("content", "UTF-8"), " ")).alias("word"))

    h = versions.Harvest(spark, f"{tmp_path}/out")
    rows = lambda: sorted((os.path.basename(r.path).removesuffix(".txt").replace("%20", " "), r.word) for r in h.rows().collect())
    want = lambda: sorted((n, w) for n, t in text.items() for w in t.split(" "))
    assert h.rows() is None and len(h.run(f"{tmp_path}/in", derive)) == 6 and seen.value == 6
    assert [x[1] for x in rows()] == [x[1] for x in want()]
    assert h.run(f"{tmp_path}/in", derive) == [] and seen.value == 6
    text["u3"] = "new words here"
    put("u3")
    os.utime(tmp_path / "in" / "u1.txt", (time.time() + 5, time.time() + 5))  # the same contents at another time
    assert [os.path.basename(p) for p in h.run(f"{tmp_path}/in", derive)] == ["u3.txt"] and seen.value == 7
    assert [x[1] for x in rows()] == [x[1] for x in want()]
    assert h.run(f"{tmp_path}/in", derive) == []
    os.remove(tmp_path / "in" / "u0.txt")
    del text["u0"]
    assert h.run(f"{tmp_path}/in", derive) == [] and seen.value == 7
    assert [x[1] for x in rows()] == [x[1] for x in want()]


def test_reports(spark, tmp_path):
    old, new = tmp_path / "a.json", tmp_path / "b.json"
    old.write_text('{"name":"x","functions":[]}\n')
    new.write_text('{"name":"u","functions":[{"name":"f","size":"16","fuzzy_match_percent":99.5},{"name":"__ehhandler$f","size":"8"}]}\n\nnot json\n{"functions":[]}\n{"name":"v"}\n{"name":"w","functions":[{"name":"g","size":"x"}]}\n')
    os.utime(old, (1, 1))
    assert tolerant.freshest(spark, [str(old), str(tmp_path / "none"), str(new)]) == str(new)
    with pytest.raises(FileNotFoundError):
        tolerant.freshest(spark, [str(tmp_path / "none")])
    rows, warnings = tolerant.scores(spark, [str(old), str(new)])
    assert sorted(map(tuple, rows.collect())) == [("u", "__ehhandler$f", 8, 0.0, True), ("u", "f", 16, 99.5, False), ("w", "g", 0, 0.0, False)]
    assert sorted((r.text, r.reason) for r in warnings.collect()) == [("not json", "no JSON of a unit"), ('{"functions":[]}', "no name")]


def test_ledgers_in_many_blocks(spark, tmp_path):
    rnd = random.Random(2)
    lines, want, bad, section = ["# a header", ""], {}, [], None
    for k in range(3000):
        x = rnd.random()
        if k % 700 == 0:
            section = rnd.choice(["units", "functions"]) if k else "functions"
            lines.append(f"# [{section}]\tunit\tfn")
        elif x < 0.05:
            lines.append("# comment [functions]")
        elif x < 0.1:
            row = rnd.choice(["u\tf", "u\tf\tx\t1\t1\tfp", "u\tf\t1\t1\t1.5\tfp", "u\tf\t1\t1\t1\tfp\tzz"])
            lines.append(row)
            bad += [row] * (section == "functions")
        else:
            key = (f"u{rnd.randrange(9)}", f"f{rnd.randrange(99)}")
            more = rnd.choice([[], ["0x10"], ["", ""], ["1f", "77.5", "absent"]])
            lines.append("\t".join([*key, "90.5", "80", str(k), "fp", *more]))
            if section == "functions":
                want[key] = (90.5, 80.0, k, "fp", int(more[0], 16) if more and more[0] else None, float(more[1]) if len(more) > 1 and more[1] else 90.5, more[2] if len(more) > 2 else "")
    (tmp_path / "ledger.tsv").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows, warnings = tolerant.ledger(spark, str(tmp_path / "ledger.tsv"))
        assert tolerant.in_sections(spark, str(tmp_path / "ledger.tsv")).select("block").distinct().count() > 5
        assert {(r.unit, r.fn): tuple(r)[2:] for r in rows.collect()} == want
        assert sorted(r.text for r in warnings.collect()) == sorted(bad)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_persisted_map_moves_no_rows(spark, tmp_path):
    fns = spark.range(1000).select(F.col("id").alias("fn"), F.concat(F.lit("f"), F.col("id").cast("string")).alias("name"))
    sites = spark.range(5000).select((F.col("id") % 1000).alias("fn"), F.col("id").alias("site"))
    m = persisted.persist(spark, {"functions": fns, "sites": sites}, f"{tmp_path}/map", "kept", 8, order={"sites": ["site"]})
    # By size alone Spark would send the smaller side to all tasks.
    shown = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false", "spark.sql.maxMetadataStringLength": "9999"}
    for k, v in shown.items():
        spark.conf.set(k, v)
    try:
        joined = m.sql("SELECT * FROM {functions} JOIN {sites} USING (fn)")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 5000 and "Exchange" not in plan and "SortMergeJoin" in plan
        look = m.at("sites", "fn", 7)
        assert look.count() == 5 and "SelectedBucketsCount: 1 out of 8" in look._jdf.queryExecution().executedPlan().toString()
    finally:
        for k in shown:
            spark.conf.unset(k)
        for t in ("functions", "sites"):
            spark.sql(f"DROP TABLE kept_{t}")


def test_deep_graphs(spark):
    n = 300
    line = spark.createDataFrame([(k, k + 1) for k in range(n)], "src long, dst long")
    assert graph.reachable(line.where("src < 60"), spark.createDataFrame([(0,)], "node long")).count() == 61
    got = {(r.src, r.dst): r.depth for r in graph.closure(line.where("src < 100").union(spark.createDataFrame([(0, 50), (100, 98)], "src long, dst long"))).collect()}
    assert got[0, 60] == 11 and got[0, 50] == 1 and got[98, 98] == 3 and got[1, 50] == 49
    up = spark.createDataFrame([(k, k - 1 if k else None) for k in range(n)] + [(900, 901), (901, 900), (950, 999)], "node long, parent long")
    roots = {r.node: (r.root, r.depth) for r in graph.roots_of(up).collect()}
    assert roots == {**{k: (0, k) for k in range(n)}, 950: (999, 1)}
