"""Decorated names by example."""

from pyspark.sql import functions as F

from tallyframe.functions import names


def values(spark, rows, kind, f):
    got = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], f"k int, {kind}").select("k", f).orderBy("k").collect()
    return [r[1] for r in got]


def test_storage(spark):
    told = {"?f@C@@UAEXXZ": "virtual", "?f@C@@QAEXXZ": "non-virtual", "?f@C@@SAXXZ": "static", "?f@@YAXXZ": "free function", "?f@C@@WA@EXXZ": "virtual-thunk", "?x@C@@2HA": "unknown", "_main": None, "??0C@@QAE@XZ": "non-virtual", "": None}
    assert values(spark, [(n,) for n in told], "n string", names.storage(F.col("n"))) == list(told.values())


def test_masks_and_spellings(spark):
    told = {"_x$S12": "_x$S", "?$S4@?3??f@@YAXXZ@4EA$S9": "?$S@?1??f@@YAXXZ@4EA$S", "$S7": "$S7", "a@?BA@??g": "a@?1??g", "plain": "plain"}
    assert values(spark, [(n,) for n in told], "n string", names.masked(F.col("n"))) == list(told.values())
    assert values(spark, [(n,) for n in told], "n string", names.volatile(F.col("n"))) == [a != b for a, b in told.items()]
    rows = [("f", False, "_f"), ("?f@@YAXXZ", False, "?f@@YAXXZ"), ("?t@@3QBHB", False, "?t@@3PBHB"), ("v", True, "_v$S"), ("?v@@3HA", True, "_?v@@3HA$S")]
    assert values(spark, [r[:2] for r in rows], "n string, i boolean", names.spelled(F.col("n"), F.col("i"))) == [r[2] for r in rows]
    assert values(spark, [("f",), ("?g@@YA",)], "n string", names.spelled(F.col("n"))) == ["_f", "?g@@YA"]
    assert values(spark, [("_v$S", 16), ("_v", 16)], "n string, a long", names.distinct_name(F.col("n"), F.col("a"))) == ["_v$S16", None]


def test_parameter_bytes(spark):
    told = {
        "void": (0, 0, ""), "": (0, 0, ""), "int": (4, 0, ""), "unsigned char, double": (12, 0, ""), "class C *, struct D &": (8, 0, ""), "class C": (0, 1, "object"), "enum E, int const": (8, 0, ""),
        "int, ...": (4, 0, "varargs"), "class C, ..., int": (0, 1, "varargs"), "void (__cdecl *)(int, int), int": (8, 0, ""), "int (__thiscall C::*)(void)": (0, 1, "member-pointer"), "int (__thiscall C::*)(void), class D": (0, 2, "object"), "class map<int, class X>, __int64": (8, 1, "object"), None: (0, 0, "no-parameters"),
    }
    assert [tuple(x) for x in values(spark, [(n,) for n in told], "n string", names.parameter_bytes(F.col("n")))] == list(told.values())


def test_a_list_is_cut_once(spark):
    """However often its parts are looked at."""
    from pyspark.sql import functions as F

    from tallyframe.functions import names, scalars

    for f in (names.parameter_bytes, scalars.split_top):
        plan = spark.range(1).select(f(F.concat(F.lit("a, "), F.col("id").cast("string"))).alias("x"))._jdf.queryExecution().analyzed().toString()
        assert plan.count("split(") == 1 and plan.count("aggregate(") <= 2
