"""Operators behind the reports, scalars and graphs against plain code."""

import random

from pyspark.sql import functions as F

from tallyframe.functions import scalars as sc
from tallyframe.operators import graph, intervals, ledger, review
from tallyframe.sources import codecs


def plain_blanked(code):
    """One character at a time: what is in quotes stays, a comment is spaces up to its line's end or its end mark."""
    out, i, quote = "", 0, ""
    while i < len(code):
        two = code[i : i + 2]
        if quote:
            step = 2 if code[i] == "\\" else 1
            out += code[i : i + step]
            quote = "" if step == 1 and code[i] == quote else quote
            i += step
        elif two in ("//", "/*"):
            end = code.find("\n" if two == "//" else "*/", i)
            end = len(code) if end < 0 else end
            out += "".join(c if c == "\n" else " " for c in code[i:end])
            i = end
        else:
            quote = code[i] if code[i] in "\"'" else ""
            out += code[i]
            i += 1
    return out


def test_blanked_comments(spark):
    rnd = random.Random(5)
    codes = ["", "a /* b\nc */ d", "x // y", "'\\'' // z", '"/*" f() /* "q" */', "/*/ x */ y", "/**/ z", "a / b", '"open // x', "/* open"]
    codes += ["".join(rnd.choices("ab/*\"'\\\n ", k=rnd.randint(0, 25))) for _ in range(400)]
    rows = spark.createDataFrame(list(enumerate(codes)), "id long, code string").select("id", sc.blank_comments(F.col("code")).alias("out")).collect()
    assert {r.id: r.out for r in rows} == {i: plain_blanked(c) for i, c in enumerate(codes)}


def plain_parts(text):
    out, depth, cur = [], 0, ""
    for ch in text:
        depth += (ch in "(<[") - (ch in ")>]")
        if ch == "," and not depth:
            out, cur = [*out, cur.strip(" ")], ""
        else:
            cur += ch
    return [*out, cur.strip(" ")] if cur.strip(" ") else out


def test_top_level_parts(spark):
    rnd = random.Random(6)
    texts = ["", "a", "a,b", "f(a,b), c", ",", "a,,b", "a, "] + ["".join(rnd.choices("ab,()<>[] ", k=rnd.randint(0, 20))) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string").select("id", sc.split_top(F.col("t")).alias("out")).collect()
    assert {r.id: r.out for r in rows} == {i: plain_parts(t) for i, t in enumerate(texts)}


def test_short_names(spark):
    names = {"?open@CMirrorFile@@QAE": "CMirrorFile::open", "??0CX@@QAE@XZ": "CX::CX", "??1CX@@": "CX::~CX", "??_7CX@@6B@": "CX::`vftable'", "??HCX@@": "CX::operator", "_main@8": "main", "plain": "plain", "?f@B@A@@YA": "A::B::f", "?f@@YA": "f", "_?clip@?1??RenderFrame@CImage@@QAE@4HA": "RenderFrame::clip", "?clip@?1??Draw@@YAXXZ@4HA": "Draw::clip", "??_R4CX@@6B@": "CX::`RTTI'", "??_C@_03x@": "`string'", "?": "?", "_?": "?", "___x@4": "x", "__@": "__@", "": "", "?m@A@?5x@B@@": "A::m"}
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", sc.short_name(F.col("n")).alias("s")).collect()
    assert {r.n: r.s for r in rows} == names


def test_divisors(spark):
    rows = [(d, s, round(2 ** (32 + s) / d)) for d in (2, 3, 7, 10, 641, 65_535) for s in (0, 3, 11)] + [(None, 5, 0), (None, 0, -7), (None, 2, 3 * 10**9 + 1), (None, 31, 123_456_789_012)]
    got = spark.createDataFrame(rows, "d long, s int, m long").select("d", "s", "m", sc.divisor(F.col("m"), F.col("s")).alias("got")).collect()
    plain = lambda m, s: (lambda d: d if d >= 2 and abs(2 ** (32 + s) - d * m) * 50 < m else None)((2 ** (33 + s) + m) // (2 * m)) if m > 0 else None
    assert [r.got for r in got] == [plain(r.m, r.s) for r in got] and all(r.got == r.d for r in got if r.d and r.d < 600)


def test_agreed_counts(spark):
    said = {
        "Both agree at 24 calls, 96 branches; base has 15 vs retail 16 returns.": [("branches", 96), ("calls", 24)],
        "it is 59/59 calls but 3/4 branches": [("calls", 59)], "the trial had the same 5 calls": [], "0x5 calls match": [], "score 99.5. Same 7 Calls": [("calls", 7)], "": [], "5 calls": [],
    }
    got = spark.createDataFrame([(t,) for t in said], "t string").select("t", sc.agreed_counts(F.col("t"), ["calls", "branches", "returns"]).alias("c")).collect()
    assert {r.t: [tuple(x) for x in r.c] for r in got} == said


def test_a_renamed_row_excuses_no_neighbour(spark):
    snap = "unit string, fn string, pct double, fp string, addr long"
    led = "unit string, fn string, best double, cur double, hist double, tries long, fp string, addr long, state string"
    snapshot = spark.createDataFrame([("u", "new", 90.0, "h", 32), ("u", "f", 50.0, "h", 16)], snap)
    old = spark.createDataFrame([("u", "old", 90.0, 90.0, 90.0, 1, "h", 32, ""), ("u", "f", 80.0, 80.0, 80.0, 1, "h", 16, "")], led)
    assert [r.neighbour for r in review.exempted(snapshot, old).collect()] == [False]
    grown = snapshot.unionByName(spark.createDataFrame([("u", "more", 10.0, "h", 64)], snap))
    assert [r.neighbour for r in review.exempted(grown, old).collect()] == [True]


def test_a_row_that_vanished_with_an_edit_is_removed(spark):
    led = "unit string, fn string, best double, cur double, hist double, tries long, fp string, addr long, state string"
    old = spark.createDataFrame([("u", f, 90.0, 90.0, 90.0, 1, "h", None, s) for f, s in (("a", ""), ("b", ""), ("c", "absent"), ("d", ""))], led)
    none = spark.createDataFrame([], "unit string, fn string, pct double, fp string, addr long")
    sources = spark.createDataFrame([("u", "a", "edited"), ("u", "b", "h"), ("u", "c", "h")], "unit string, fn string, fp string")
    assert {r.fn: r.event for r in ledger.classify(none, old, sources).collect()} == {"a": "REMOVED", "b": "LOST", "c": "KNOWN-ABSENT", "d": "LOST"}


def test_effective_incoming_goes_round_no_circle(spark):
    edges = spark.createDataFrame([(100, 1), (101, 3), (101, 3), (102, 5), (103, 7), (1, 2)], "src long, dst long")
    forwards = spark.createDataFrame([(1, 2), (2, 3), (5, 6), (6, 5), (8, 5)], "node long, next long")
    got = sorted(tuple(r) for r in graph.effective_incoming(edges, forwards).collect())
    assert got == [(3, 100, 1, 2), (3, 101, 2, 0), (7, 103, 1, 0)]


def test_overlaps_of_any_length(spark):
    rnd = random.Random(7)
    side = lambda n: [(rnd.randint(0, 1), lo, lo + rnd.choice([0, 1, 2, 7, 64, 5000]), i) for i in range(n) for lo in [rnd.randint(-300, 3000)]]
    a, b = side(120), side(150)
    frame = lambda rows: spark.createDataFrame(rows, "s int, lo long, hi long, id long")
    got = sorted((r.l_id, r.r_id, r.lo, r.hi) for r in intervals.overlaps(frame(a), frame(b), ["s"]).collect())
    assert got == sorted((x[3], y[3], max(x[1], y[1]), min(x[2], y[2])) for x in a for y in b if x[0] == y[0] and max(x[1], y[1]) < min(x[2], y[2]))


def test_a_moved_row_keeps_its_history(spark):
    old = spark.createDataFrame([("u", "f", 90.0, 80.0, 95.0, 3, "h", 16, "")], "unit string, fn string, best double, cur double, hist double, tries long, fp string, addr long, state string")
    new = spark.createDataFrame([("v", "g", 70.0, "h", 16)], "unit string, fn string, pct double, fp string, addr long")
    assert [tuple(r) for r in ledger.merge(new, old).collect()] == [("v", "g", 90.0, 70.0, 95.0, 3, "h", 16, "")]


def test_equal_counts_keep_the_sort_s_order():
    rnd = random.Random(9)
    for _ in range(50):
        counts = [rnd.randint(0, 3) for _ in range(256)]
        order = codecs.falling(counts)
        assert sorted(order) == list(range(256)) and all(counts[a] >= counts[b] for a, b in zip(order, order[1:]))
    assert codecs.falling([0] * 4) == [1, 2, 3, 0]
