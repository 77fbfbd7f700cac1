"""Reconciliation of symbols by name, address and content, audits of references, and slots bound along hierarchies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.operators.graph import cut, terminals
from tallyframe.operators.intervals import asof

#: Rows that a task of a join with ancestors makes, and rows of one key that a task has.
PART, HOT = 1_000_000, 50_000


def _pair(*columns: Column) -> list[Column]:
    """Two hashes of the same values."""
    return [F.xxhash64(F.lit(s), *columns).alias(f"_h{s}") for s in (1, 2)]


def refine(symbols: DataFrame, refs: DataFrame, content: Sequence[str]) -> tuple[DataFrame, int]:
    """symbols (id, ...) with class, the smallest id of those that nothing tells apart, and the number of rounds it took.

    refs: (id, slot, to). Symbols start in classes of equal content; a round splits those whose references lead, slot by
    slot, to other classes, as often. Rounds are counted and end when none splits a class, so a circle of equals stays one
    class. A reference to what is no symbol stands for itself. A symbol's references are summed as hashes, twice, and not
    gathered, so it may have any number of them; classes are decided by 128 bits.
    """
    classes = cut(symbols.select("id", *_pair(*[F.col(c) for c in content])))
    known, rounds = classes.select("_h1", "_h2").distinct().count(), 0
    links = cut(refs.groupBy("id", "slot", "to").agg(F.count("*").alias("n")))
    number = lambda c: F.sum(c.cast("decimal(38,0)"))
    while True:
        to = classes.select(F.col("id").alias("to"), F.col("_h1").alias("_t1"), F.col("_h2").alias("_t2"))
        led = links.join(to, "to", "left").select("id", "slot", "n", *[F.coalesce(F.col(f"_t{s}"), F.xxhash64(F.lit("outside"), F.lit(s), "to")).alias(f"_t{s}") for s in (1, 2)])
        led = led.groupBy("id", "slot", "_t1", "_t2").agg(F.sum("n").alias("n"))
        sums = led.groupBy("id").agg(*[number(F.xxhash64(F.lit(s), "slot", "_t1", "_t2", "n")).alias(f"_s{s}") for s in (1, 2)])
        split = cut(classes.join(sums, "id", "left").select("id", *_pair(F.col("_h1"), F.col("_h2"), F.col("_s1"), F.col("_s2"))))
        found = split.select("_h1", "_h2").distinct().count()
        if found == known:
            break
        classes, known, rounds = split, found, rounds + 1
    least = classes.groupBy("_h1", "_h2").agg(F.min("id").alias("class"))
    return symbols.join(classes.join(least, ["_h1", "_h2"]).select("id", "class"), "id"), rounds


def conflicts(classed: DataFrame, name: str = "name", addr: str = "addr") -> DataFrame:
    """(kind, key, classes, ids) of refined symbols: NAME or ADDRESS for one that several classes share, ALIAS for a class of several names.

    ids counts symbols. A null name or address is none.
    """
    shared = lambda kind, by: classed.where(F.col(by).isNotNull()).groupBy(F.col(by).cast("string").alias("key")).agg(F.count_distinct("class").alias("classes"), F.count("*").alias("ids")).where("classes > 1").select(F.lit(kind).alias("kind"), "key", "classes", "ids")
    alias = classed.groupBy(F.col("class").cast("string").alias("key")).agg(F.count_distinct(name).alias("names"), F.count("*").alias("ids")).where("names > 1")
    return shared("NAME", name).unionByName(shared("ADDRESS", addr)).unionByName(alias.select(F.lit("ALIAS").alias("kind"), "key", F.lit(1).cast("long").alias("classes"), "ids"))


def spelled(asked: DataFrame, names: DataFrame) -> DataFrame:
    """(name, addr) for each asked name: all addresses of its spelling, else of that without one underscore in front, else with one more."""
    forms = F.array(F.struct(F.lit(0).alias("k"), F.col("name").alias("form")), F.struct(F.lit(1).alias("k"), F.when(F.col("name").startswith("_"), F.expr("substring(name, 2)")).alias("form")), F.struct(F.lit(2).alias("k"), F.concat(F.lit("_"), "name").alias("form")))
    tried = asked.select("name").distinct().select("name", F.inline(forms)).where("form is not null")
    hit = cut(tried.join(names.select(F.col("name").alias("form"), "addr").distinct(), "form"))
    best = hit.groupBy("name").agg(F.min("k").alias("k"))
    return hit.join(best, ["name", "k"]).select("name", "addr").distinct()


def landed(rows: DataFrame, forwards: DataFrame | None) -> DataFrame:
    """rows whose addr is followed through forwards (node, next) to its end; one that goes round in circles stays."""
    if forwards is None:
        return rows
    ends = terminals(forwards).select(F.col("node").alias("addr"), F.col("target").alias("_end"))
    return rows.join(ends, "addr", "left").withColumn("addr", F.coalesce("_end", "addr")).drop("_end")


def audit(ours: DataFrame, actual: DataFrame, names: DataFrame, defined: DataFrame, forwards: DataFrame | None = None) -> DataFrame:
    """Findings (unit, verdict, name, addr, n) of a unit's references against those that are really there.

    ours: (unit, name, addend, relative); actual: (unit, addr); names: (name, addr), a name may have several; defined:
    names (name) that resolve elsewhere. A relative reference goes to the symbol itself, others to its address and addend.
    Compared as multisets of addresses behind forwarders:

    * FAKE: a name that begins with ? and neither resolves nor is defined. Other names that do not resolve say nothing.
    * WRONG: an address that we refer to more often than is really done, with the first name that leads there; n is by
      how much. A name of several addresses is taken to be whichever of them is there, and the smallest if none is.
    * MISSING: an address that is really referred to more often than we do, with no name.
    """
    counted = cut(ours.groupBy("unit", "name", "addend", "relative").agg(F.count("*").alias("n")))
    where = cut(spelled(counted, names))
    known = where.select("name").distinct()
    fake = counted.where(F.col("name").startswith("?")).join(known, "name", "left_anti").join(defined.select("name"), "name", "left_anti")
    fake = fake.groupBy("unit", "name").agg(F.sum("n").alias("n")).select("unit", F.lit("FAKE").alias("verdict"), "name", F.lit(None).cast("long").alias("addr"), "n")
    there = cut(landed(actual.select("unit", "addr"), forwards).groupBy("unit", "addr").agg(F.count("*").alias("there")))
    aimed = landed(counted.join(where, "name").withColumn("addr", F.col("addr") + F.when(F.col("relative"), F.lit(0)).otherwise(F.col("addend"))), forwards)
    # Of several addresses one that is there, else any, the smallest first.
    pick = aimed.join(there, ["unit", "addr"], "left").groupBy("unit", "name", "addend", "relative").agg(F.first("n").alias("n"), F.min(F.struct(F.col("there").isNull().alias("absent"), "addr")).alias("p"))
    expected = pick.groupBy("unit", F.col("p.addr").alias("addr")).agg(F.sum("n").alias("ours"), F.min("name").alias("name"))
    both = expected.join(there, ["unit", "addr"], "full_outer").withColumn("d", F.coalesce("ours", F.lit(0)) - F.coalesce("there", F.lit(0))).where("d <> 0")
    odd = both.select("unit", F.when(F.col("d") > 0, "WRONG").otherwise("MISSING").alias("verdict"), F.when(F.col("d") > 0, F.col("name")).alias("name"), "addr", F.abs("d").alias("n"))
    return odd.unionByName(fake)


def dealt(many: DataFrame, few: DataFrame, on: Sequence[str], rows: float, hot: int = HOT) -> DataFrame:
    """many joined with few by a key, about rows rows, in tasks of a counted size.

    A key that more than `hot` rows of many have is dealt out by their hashes, with copies of few's rows for each part.
    """
    on = list(on)
    crowded = cut(many.groupBy(*on).agg(F.ceil(F.count("*") / hot).alias("_k")).where("_k > 1"))
    n = 1 + int(rows // PART)
    if crowded.isEmpty():
        return many.repartition(n, *on).join(few.repartition(n, *on), on)
    # At most a row for each `hot` rows of many.
    one, parts = F.coalesce("_k", F.lit(1)), F.broadcast(crowded)
    part = F.pmod(F.xxhash64(*[c for c in many.columns if c not in on]), one).cast("int")
    left = many.join(parts, on, "left").withColumn("_s", part).drop("_k")
    right = few.join(parts, on, "left").withColumn("_s", F.explode(F.sequence(F.lit(0), (one - 1).cast("int")))).drop("_k")
    by = [*on, "_s"]
    return left.repartition(n, *by).join(right.repartition(n, *by), by).drop("_s")


def bound_slots(bases: DataFrame, bindings: DataFrame, hot: int = HOT) -> DataFrame:
    """(class, slot, owner, symbol, depth): what each slot of a class is bound to, by itself or its nearest ancestor.

    bases: (class, base), several bases allowed; bindings: (class, slot, symbol). Of ancestors as near the smallest owner,
    then symbol, wins. Links to ancestors double in length each round, and slots that are not bound within a length are
    taken over from the ancestors at that length, the nearest binding of a slot first: rounds are as the logarithm of the
    depth, which is not capped. A class with every slot there is needs no longer links, nor does one below it that they
    would pass through. Ancestors that many classes have are dealt out; symbols are looked up at the end.
    """
    best = F.min(F.struct("depth", "owner")).alias("_b")
    own = cut(bindings.groupBy("class", "slot").agg(F.min("symbol").alias("symbol")))
    bound = own.select("class", "slot", F.lit(0).cast("long").alias("depth"), F.col("class").alias("owner"))
    slots = own.select("slot").distinct().count()
    up = cut(bases.select("class", F.col("base").alias("ancestor")).where("class is not null and base is not null and class <> base").distinct())
    most = up.select("class").distinct().count()
    length = 1
    while length <= most and (links := up.count()):
        held = bound.groupBy("class").agg(F.count("*").alias("n"))
        each = held.agg(F.avg("n")).first()[0] or 1
        above = bound.select(F.col("class").alias("ancestor"), "slot", (F.col("depth") + F.lit(length)).alias("depth"), "owner")
        found = dealt(up, above, ["ancestor"], links * each, hot).groupBy("class", "slot").agg(best).select("class", "slot", "_b.*")
        # What is bound is bound within the length, and nearer than anything from here.
        bound = bound.unionByName(cut(found.join(bound, ["class", "slot"], "left_anti")))
        full = bound.groupBy("class").agg(F.count("*").alias("n")).where(F.col("n") == slots).select("class")
        live = cut(up.join(full, "class", "left_anti"))
        on = up.select(F.col("class").alias("ancestor"), F.col("ancestor").alias("_next"))
        up = cut(dealt(live, on, ["ancestor"], live.count() * links / most, hot).select("class", F.col("_next").alias("ancestor")).distinct())
        length *= 2
    symbols = own.select(F.col("class").alias("owner"), "slot", "symbol")
    return dealt(bound, symbols, ["owner", "slot"], bound.count(), hot).select("class", "slot", "owner", "symbol", "depth")


def slot_findings(bound: DataFrame, tables: DataFrame) -> DataFrame:
    """(class, slot, finding) of slot tables (class, slot, symbol; symbol null if unknown) against bound_slots.

    UNBOUND: nothing in the class or above it binds the slot; FOREIGN: what is in the table is bound, but something else is
    expected; MISSING: a slot that is bound has no place in the class's table. Classes without a table are not judged.
    """
    asked = tables.groupBy("class", "slot").agg(F.min("symbol").alias("there"))
    judged = bound.join(tables.select("class").distinct(), "class", "left_semi").select("class", "slot", "symbol", F.lit(True).alias("_bound"))
    j = asked.withColumn("_asked", F.lit(True)).join(judged, ["class", "slot"], "full_outer")
    finding = F.when(F.col("_bound").isNull(), "UNBOUND").when(F.col("_asked").isNull(), "MISSING").when(F.col("there") != F.col("symbol"), "FOREIGN")
    return j.select("class", "slot", finding.alias("finding")).where("finding is not null")


def attribute(gaps: DataFrame, accesses: DataFrame, claims: DataFrame, definitions: DataFrame, width: int) -> DataFrame:
    """(gap_lo, fn, site, target, verdict, hits, base, symbol, size, storage, library, member): what touched gaps are part of.

    gaps: (lo, hi, touched, verdict), none overlapping another, of which those that are touched and no padding are asked
    about; accesses: (fn, site, target), site being a place of fn; claims: (fn, library, name) say which library's
    function fn is; definitions: (library, name, offset, addend, symbol, size, storage, member) say what that function
    refers to at an offset. An access is FOUND if all definitions that fit it agree, and then names the symbol and where it
    begins; AMBIGUOUS if they do not; UNKNOWN if none fits. Accesses at site 0 are no code and are left out.

    Accesses meet gaps in a sweep over the one space in cells of the width, not in a join.
    """
    asked = gaps.where("touched > 0 and verdict <> 'PAD'").select(F.col("lo").alias("target"), "lo", "hi")
    within = asof(accesses.where("site <> 0"), asked, [], "target", ["lo", "hi"], ties=["anchor_lo"], width=width).where("target < anchor_hi")
    facts = ["base", "addend", "symbol", "size", "storage", "library", "member"]
    said = ["addend", "symbol", "size", "storage", "library", "member"]
    offset = (F.col("site") - F.col("fn")).alias("offset")
    place = within.select(F.col("anchor_lo").alias("gap_lo"), "fn", "site", "target", offset).distinct()
    # What fits is summed up for a function's claim and an offset, not for each access; few functions have several claims.
    known = definitions.where("addend is not null").select("library", "name", "offset", "addend", "symbol", "size", "storage", "member").distinct()
    summed = lambda rows, by: rows.groupBy(*by).agg(F.count("*").alias("hits"), F.min(F.struct(*said)).alias("h"))
    every = claims.select("fn", "library", "name").distinct()
    many = cut(every.groupBy("fn").agg(F.count("*").alias("n"), F.min(F.struct("library", "name")).alias("c")))
    fits = many.where("n = 1").select("fn", "c.*").join(summed(known, ["library", "name", "offset"]), ["library", "name"]).select("fn", "offset", "hits", "h")
    several = cut(many.where("n > 1").select("fn"))
    if not several.isEmpty():
        at = accesses.join(several, "fn", "left_semi").select("fn", offset).distinct().join(every, "fn")
        fits = fits.unionByName(summed(at.join(known, ["library", "name", "offset"]).select("fn", "offset", *said).distinct(), ["fn", "offset"]))
    told = place.join(fits, ["fn", "offset"], "left").withColumn("hits", F.coalesce("hits", F.lit(0).cast("long")))
    told = told.withColumn("h", F.struct((F.col("target") - F.col("h.addend")).alias("base"), "h.*"))
    verdict = F.when(F.col("hits") == 1, "FOUND").when(F.col("hits") > 1, "AMBIGUOUS").otherwise("UNKNOWN")
    only = [F.when(F.col("hits") == 1, F.col(f"h.{c}")).alias(c) for c in facts if c != "addend"]
    return told.select("gap_lo", "fn", "site", "target", verdict.alias("verdict"), "hits", *only)
