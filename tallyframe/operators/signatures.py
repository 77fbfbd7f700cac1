"""Masked signatures looked for in sequences: an index on each signature's rarest run of fixed values, then a check both ways."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.operators.graph import cut

#: Lengths of runs that are indexed: a signature has its longest of them.
RUNS = (4, 2, 1)
#: Values of a sequence that are compared in one row; its pieces overlap by the longest signature.
PIECE = 2048
#: Buckets of runs' hashes with 64 bits each, by which runs are told apart first: the most rows that are broadcast.
BUCKETS = 1 << 19
#: The three bits that a run sets in its bucket.
BITS = " | ".join(f"shiftleft(1L, cast(shiftrightunsigned(value, {k}) & 63 as int))" for k in (40, 46, 52))


def trimmed(payload: Column, pads: Sequence) -> Column:
    """The sequence without padding at its end; one value is left at least."""
    last = F.array_max(F.transform(payload, lambda x, i: F.when(~x.isin(*pads), i + 1))) if pads else F.size(payload)
    return F.slice(payload, F.lit(1), F.greatest(F.coalesce(last, F.lit(1)), F.lit(1)))


def none(column: str) -> Column:
    return F.coalesce(column, F.array().cast("array<int>"))


def fixed_runs(n: int) -> Column:
    """(run, offset, value) of every n fixed values in a row of `payload`, `sites` being places that are not."""
    at = F.filter(F.sequence(F.lit(0), F.greatest(F.size("payload") - n, F.lit(0))), lambda i: (i + n <= F.size("payload")) & ~F.exists("sites", lambda s: (s >= i) & (s < i + n)))
    return F.transform(at, lambda i: F.struct(F.lit(n).alias("run"), i.cast("long").alias("offset"), F.xxhash64(F.slice("payload", i + 1, n)).alias("value")))


def probe(texts: DataFrame, signatures: DataFrame, pads: Sequence = (), piece: int = PIECE) -> DataFrame:
    """(unit, start, sig, length, fixed): places where a signature stands in a sequence.

    texts: (unit, payload, sites), signatures: (sig, payload, sites); sites are places from 0 whose value may be any. A
    signature loses padding at its end; it stands where all its fixed values do and where no site of the text falls on one
    of them. One without fixed values stands nowhere. A null payload is empty, null sites are none; a unit or sig that is
    there twice is found twice.

    A signature is looked up by a run of its fixed values, by the one that texts have least if it has several, so a run
    that all texts have brings no candidates unless a signature has no other. Texts are read where they are: only places
    whose run may be looked for are dealt out, each with as many values around it as a signature may have.
    """
    sigs = signatures.where("payload is not null and size(payload) > 0").withColumn("_s", F.monotonically_increasing_id()).withColumn("payload", trimmed(F.col("payload"), pads))
    sigs = cut(sigs.select("_s", "sig", "payload", F.filter(F.array_distinct(none("sites")), lambda x: (x >= 0) & (x < F.size("payload"))).alias("sites")))
    best = F.lit(None)
    for n in reversed(RUNS):
        best = F.when(F.size(fixed_runs(n)) > 0, fixed_runs(n)).otherwise(best)
    runs = cut(sigs.select("_s", F.inline(best)))
    kinds = [r["run"] for r in runs.select("run").distinct().collect()]
    # Only signatures with several runs have a choice; where none has, no text is read for it.
    choice = runs.join(runs.groupBy("_s").agg(F.count("*").alias("n")).where("n > 1").select("_s"), "_s", "left_semi")
    counts = _places(texts, choice, kinds, piece, 0, max(kinds, default=0)).groupBy("run", "value").agg(F.count("*").alias("n"))
    counts = cut(counts.join(choice.select("run", "value").distinct(), ["run", "value"], "left_semi"))
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "run", "value")).alias("r")
    index = runs.join(counts, ["run", "value"], "left").groupBy("_s").agg(rarest, F.count("*").alias("_n")).where("_n = 1 or r.n > 0")
    full = sigs.select("_s", "sig", F.col("payload").alias("_payload"), F.col("sites").alias("_sites"))
    index = cut(index.join(full, "_s").select("sig", "_payload", "_sites", F.col("r.offset").cast("int").alias("offset"), "r.run", "r.value"))
    length, base = F.size("_payload"), F.col("pos") - F.col("offset") - F.col("first")
    before, after = index.agg(F.max("offset"), F.max(length - F.col("offset"))).first()
    j = _places(texts, index, kinds, piece, before or 0, after or 0).join(index, ["run", "value"])
    forth = F.forall(F.sequence(F.lit(0), length - 1), lambda i: F.array_contains("_sites", i) | F.coalesce(F.get("around", base + i) == F.get("_payload", i), F.lit(False)))
    back = F.forall("near", lambda s: (s < base) | (s >= base + length) | F.array_contains("_sites", s - base))
    found = j.where((base >= 0) & (base + length <= F.size("around"))).where(forth & back)
    return found.select("unit", (F.col("pos") - F.col("offset")).cast("long").alias("start"), "sig", length.alias("length"), (length - F.size("_sites")).alias("fixed"))


def _places(texts: DataFrame, wanted: DataFrame, kinds: Sequence[int], piece: int, before: int, after: int) -> DataFrame:
    """(unit, run, value, pos, first, around, near): places in texts with a run that wanted (run, value) has, and a few others.

    around has the values from `first`, up to `before` ahead of the place, to `after` from it on; near the sites among them, counted from `first`.
    """
    known = texts.select("unit", "payload", none("sites").alias("sites"), F.size("payload").alias("size"))
    # Pieces and places come from sequences, in generated code: a row has its text at hand and copies none of it.
    whole = F.sequence(F.lit(0), F.col("size") - 1, F.lit(piece))
    pieces = known.select("*", F.explode(F.when(F.col("size") > 0, whole)).alias("at")).withColumn("from", F.greatest(F.col("at") - before, F.lit(0)))
    pieces = pieces.select("unit", "sites", "at", "from", F.slice("payload", F.col("from") + 1, F.col("at") + piece + after - F.col("from")).alias("part"), F.least(F.lit(piece), F.col("size") - F.col("at")).alias("n"))
    places = pieces.select("unit", "sites", "from", "part", F.explode(F.sequence("at", F.col("at") + F.col("n") - 1)).alias("pos"))
    # A run over the end of a text is shorter than n, and equals none.
    said = F.array(*[F.struct(F.lit(n).alias("run"), F.xxhash64(F.slice("part", F.col("pos") - F.col("from") + 1, n)).alias("value")) for n in kinds])
    said = places.select("*", F.inline(said.cast("array<struct<run:int,value:bigint>>")))
    # Most runs of texts are in no signature: they go before anything is dealt out.
    bucket, bits = F.col("value").bitwiseAND(F.lit(BUCKETS - 1)).alias("_bucket"), F.expr(BITS)
    marks = wanted.select(bucket, bits.alias("_bits")).groupBy("_bucket").agg(F.bit_or("_bits").alias("_marks"))
    some = said.withColumns({"_bucket": bucket, "_bits": bits}).join(F.broadcast(marks), "_bucket").where("_marks & _bits = _bits")
    some = some.withColumn("first", F.greatest(F.col("pos") - before, F.lit(0)))
    near = F.transform(F.filter("sites", lambda s: (s >= F.col("first")) & (s < F.col("pos") + after)), lambda s: s - F.col("first"))
    return some.select("unit", "run", "value", "pos", "first", F.slice("part", F.col("first") - F.col("from") + 1, F.col("pos") + after - F.col("first")).alias("around"), near.alias("near"))
