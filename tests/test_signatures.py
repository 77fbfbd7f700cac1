"""Masked signatures against a comparison at every place."""

import random
import re

from tallyframe.operators import signatures

KIND = "payload array<int>, sites array<int>"


def plain(texts, sigs, pads):
    out = []
    for unit, t, t_sites in texts:
        for sig, s, s_sites in sigs:
            if not t or not s:
                continue
            s = list(s)
            while len(s) > 1 and s[-1] in pads:
                s.pop()
            wild = {x for x in s_sites or [] if 0 <= x < len(s)}
            if len(wild) == len(s):
                continue
            for k in range(len(t) - len(s) + 1):
                if all(i in wild or t[k + i] == s[i] for i in range(len(s))) and all(x - k in wild for x in t_sites or [] if k <= x < k + len(s)):
                    out.append((unit, k, sig, len(s), len(s) - len(wild)))
    return sorted(out)


def test_probe_against_all_places(spark):
    rnd = random.Random(5)
    texts = [(u, [rnd.choice([0, 0, 1, 2, 3]) for _ in range(rnd.choice([0, 1, 5, 40]))], rnd.choice([None, [], [3], [7, 8]])) for u in range(25)]
    texts += [(90, None, None), (91, [0] * 60, [30]), (91, [0] * 60, [30])]
    sigs = []
    for k in range(40):
        _, t, _ = rnd.choice(texts)
        t = t or [1]
        at = rnd.randrange(len(t))
        s = t[at : at + rnd.choice([1, 2, 3, 6, 12])] + rnd.choice([[], [9, 9], [9]])
        sigs.append((k, s, rnd.choice([None, [], [1], [0, 2], [3, 4], [99, -1]])))
    sigs += [(70, [], None), (71, None, None), (72, [1, 2], [0, 1]), (73, [9, 9], None)]
    for pads in ((9,), ()):
        for piece in (4, 2048):
            got = signatures.probe(spark.createDataFrame(texts, f"unit int, {KIND}"), spark.createDataFrame(sigs, f"sig int, {KIND}"), pads, piece)
            assert sorted(map(tuple, got.collect())) == plain(texts, sigs, pads)


def test_a_common_run_brings_no_candidates(spark):
    """All texts and signatures begin alike; each is looked up by what it has alone."""
    texts = [(u, [5, 5, 5, 5, 5, 5, u, u + 1000, u, u], None) for u in range(300)]
    sigs = [(u, [5, 5, 5, 5, 5, 5, u, u + 1000, u, u], [0]) for u in range(300)]
    got = signatures.probe(spark.createDataFrame(texts, f"unit int, {KIND}"), spark.createDataFrame(sigs, f"sig int, {KIND}"))
    assert sorted((r.unit, r.sig) for r in got.collect()) == [(u, u) for u in range(300)]
    for node in got._jdf.queryExecution().optimizedPlan().toString().splitlines():
        assert "CartesianProduct" not in node and "Join Cross" not in node


def test_nothing_to_look_for(spark):
    texts = spark.createDataFrame([(1, [1, 2], None)], f"unit int, {KIND}")
    assert signatures.probe(texts, spark.createDataFrame([], f"sig int, {KIND}")).collect() == []
    assert signatures.probe(texts.where("false"), spark.createDataFrame([(1, [1], None)], f"sig int, {KIND}")).collect() == []


def test_texts_are_not_kept_between_steps(spark, monkeypatch):
    """What is written between steps has no column of texts but those of the signatures."""
    kept = []
    monkeypatch.setattr(signatures, "cut", lambda df, cut=signatures.cut: kept.append(df.columns) or cut(df))
    texts = [(u, [u, 2, 3, 4, 5], None) for u in (1, 1, None)]
    got = signatures.probe(spark.createDataFrame(texts, f"unit int, {KIND}"), spark.createDataFrame([(7, [2, 3, 4], None)], f"sig int, {KIND}"))
    assert sorted(map(tuple, got.collect()), key=repr) == [(1, 1, 7, 3, 3), (1, 1, 7, 3, 3), (None, 1, 7, 3, 3)]
    assert not any({"part", "near"} & set(c) for c in kept) and len(kept) == 4


def test_texts_are_not_dealt_out(spark):
    """Pieces of texts are cut where the texts are read: none is grouped or joined."""
    texts = spark.range(40).selectExpr("id as unit", "transform(sequence(1, 3000), x -> cast(x * (id + 1) as int)) as payload", "cast(null as array<int>) as sites")
    sigs = spark.createDataFrame([(k, [k + 1, 0, 3 * k + 3, 4 * k + 4, 5 * k + 5, 6 * k + 6], [1]) for k in range(40)], f"sig int, {KIND}")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = signatures.probe(texts, sigs)
        assert sorted((r.unit, r.start, r.sig) for r in got.collect()) == [(u, 0, u) for u in range(40)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    plan = got._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert any("Join" in x for x in plan) and not any("part#" in x and re.search("Aggregate|Join|Sort", x) for x in plan)
