"""Matching by content: masked digests, bijectivity, grades of confidence, shingles, bags of features."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.operators.graph import cut

#: Fixed values of the grades: shortest signature at all, shortest substantial one, and how much of each must be fixed.
LEAST, LEAST_FIXED, SUBSTANTIAL, SUBSTANTIAL_FIXED = 8, 6, 16, 10


def masked(text: Column, pattern: str, by: str) -> Column:
    """The text with every match of the pattern blanked, so that equal masks mean equal fixed parts."""
    return F.regexp_replace(text, pattern, by)


def bijective(left: DataFrame, right: DataFrame, key: str, left_id: str, right_id: str) -> DataFrame:
    """left_id, candidates, the match if there is one, and confidence: HIGH if it is the only one both ways, AMBIG if not, '' without any.

    Candidates are counted by key before sides are joined, so a key that many rows share never makes all their pairs.
    """
    r = right.groupBy(key).agg(F.count_distinct(right_id).alias("candidates"), F.min(right_id).alias("match"))
    l = left.groupBy(key).agg(F.count_distinct(left_id).alias("hits"))  # noqa: E741
    j = left.select(left_id, key).join(l, key).join(r, key, "left")
    grade = F.when(F.col("candidates").isNull(), "").when((F.col("candidates") == 1) & (F.col("hits") == 1), "HIGH").otherwise("AMBIG")
    return j.select(left_id, F.coalesce("candidates", F.lit(0)).alias("candidates"), F.when(F.col("candidates") == 1, F.col("match")).alias("match"), grade.alias("confidence"))


def grade(length: Column, fixed: Column, ambiguous: Column) -> Column:
    """HIGH, MEDIUM, AMBIG or LOW; null for a signature too short to count."""
    substantial = (length >= SUBSTANTIAL) & (fixed >= SUBSTANTIAL_FIXED)
    graded = F.when(substantial & ~ambiguous, "HIGH").when(~ambiguous, "MEDIUM").when(substantial, "AMBIG").otherwise("LOW")
    return F.when((length >= LEAST) & (fixed >= LEAST_FIXED), graded)


def graded(hits: DataFrame, location: str, identity: str) -> DataFrame:
    """hits (location, identity, length, fixed) with reverse, names and confidence: the locations of an identity and the
    identities of a location, and a grade (see grade) that is ambiguous if either is more than one. Equal hits count once;
    one too short for a grade counts nowhere and is left out.
    """
    long_ = hits.distinct().where((F.col("length") >= LEAST) & (F.col("fixed") >= LEAST_FIXED))
    many = lambda by, other, name: long_.groupBy(by).agg(F.count_distinct(other).alias(name))
    j = long_.join(many(identity, location, "reverse"), identity).join(many(location, identity, "names"), location)
    return j.withColumn("confidence", grade(F.col("length"), F.col("fixed"), (F.col("reverse") > 1) | (F.col("names") > 1)))


def token_classes(text: Column, words: Sequence[str] = ()) -> Column:
    """Tokens with identifiers, numbers and quoted strings as ID, NUM and STR; the given words and marks stand for themselves."""
    tokens = F.regexp_extract_all(text, F.lit(r'("[^"]*"|[A-Za-z_][A-Za-z0-9_]*|[0-9]+|[^\sA-Za-z0-9_])'), F.lit(1))
    kind = lambda t: F.when(t.isin(*words) if words else F.lit(False), t).when(t.rlike('^"'), F.lit("STR")).when(t.rlike("^[A-Za-z_]"), F.lit("ID")).when(t.rlike("^[0-9]"), F.lit("NUM")).otherwise(t)
    return F.transform(tokens, kind)


def byte_histogram(rows: DataFrame, by: str, text: str) -> DataFrame:
    """(by, code, n): how often each byte of 0 to 255 is in the texts; bytes that are in none have no row."""

    def run(batches):
        for b in batches:
            blobs = b.column(1).cast(pa.binary()).to_pylist()
            keys = pc.dictionary_encode(b.column(0))
            for k, value in enumerate([*keys.dictionary, pa.scalar(None, keys.dictionary.type)]):
                mine = np.asarray(pc.fill_null(keys.indices, -1)) == (k if value.is_valid else -1)
                joined = b"".join(blobs[i] or b"" for i in np.flatnonzero(mine))
                n = np.bincount(np.frombuffer(joined, np.uint8), minlength=256)
                code = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([value.as_py()] * len(code), keys.dictionary.type), pa.array(code, pa.int32()), pa.array(n[code], pa.int64())], [by, "code", "n"])

    kind = rows.schema[by].dataType.simpleString()
    return rows.select(by, text).mapInArrow(run, f"`{by}` {kind}, code int, n long").groupBy(by, "code").agg(F.sum("n").alias("n"))

#: Pairs, both ways, that a task of a join of rows with a common shingle makes.
PAIRS = 4_000_000


def runs_of(hashes: Column, width: int) -> Column:
    """The hash of every run of `width` hashes: runs are joined from two halves, so in steps as the width's logarithm."""
    if width == 1:
        return hashes
    half = width // 2
    n = F.greatest(F.size(hashes) - (width - 1), F.lit(0))
    both = lambda one, two: F.zip_with(F.slice(one, F.lit(1), n), F.slice(two, F.lit(half + 1), n), lambda a, b: F.xxhash64(a, b))
    if 2 * half < width or half == 1:
        return both(runs_of(hashes, half), runs_of(hashes, width - half))
    # Equal halves are hashed once, as the one entry of an array.
    return F.get(F.transform(F.array(runs_of(hashes, half)), lambda h: both(h, h)), 0)


def clones(rows: DataFrame, key: str, tokens: Column, wide: int, narrow: int, stride: int = 1) -> DataFrame:
    """Pairs (a, b, shared, same) of rows that share a wide shingle, or two narrow ones; shared counts narrow ones.

    Rows with the same shared shingles are one class, which stands under its first row: with `same`, b is a further row of
    a's class; without, a and b are the first rows of two classes, and each row of one makes such a pair with each of the
    other. A wide run in common has narrow runs in common, two different ones unless it repeats itself: only then it is a
    shingle of its own. Shingles found in the same classes are joined once, with their number as weight.
    """
    spans = (wide - narrow) // stride + 1
    t = rows.select(key, tokens.alias("_t")).where(F.size("_t") >= narrow)
    t = t.withColumn("_t", F.transform("_t", lambda w: F.xxhash64(w)))
    runs_ = runs_of(F.col("_t"), narrow)
    t = t.withColumn("_h", F.filter(runs_, lambda _, i: i % stride == 0) if stride > 1 else runs_)
    alike = lambda k: (F.get("_h", k) == F.get("_h", k + (spans - 1))) & (F.size(F.array_distinct(F.slice("_h", k + 1, spans))) == 1)
    last = F.floor((F.size("_t") - wide) / stride).cast("int")
    again = F.when(F.size("_t") >= wide, F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), alike)).otherwise(F.array().cast("array<int>"))
    runs = F.transform(again, lambda k: F.xxhash64(F.lit("wide"), F.slice("_t", k * stride + 1, wide)))
    kind = lambda digests, bit: F.transform(digests, lambda x: x.bitwiseAND(F.lit(-2)).bitwiseOR(F.lit(bit)))
    # A narrow digest is odd. They are dealt and sorted once, and not joined with their counts: a digest has a row a document at most.
    s = t.select(F.col(key).alias("row"), F.explode(F.array_distinct(F.concat(kind("_h", 1), kind(runs, 0)))).alias("digest")).repartition("digest")
    w = Window.partitionBy("digest")
    common = s.withColumn("one", F.min("row").over(w)).withColumn("other", F.max("row").over(w)).where("one <> other")
    s = cut(common.select("row", "digest", F.col("digest").bitwiseAND(F.lit(1)).alias("narrow")).distinct())
    mark = lambda c: [F.count("*").alias("n"), F.bit_xor(F.xxhash64(c)).alias("x"), F.sum(F.xxhash64(F.lit(1), c).cast("decimal(38,0)")).alias("y")]
    sets = cut(s.groupBy("row").agg(*mark("digest"), F.sum("narrow").alias("shared")))
    classes = cut(sets.groupBy("n", "x", "y").agg(F.min("row").alias("a")))
    same = sets.join(classes, ["n", "x", "y"]).where("row <> a and (shared >= 2 or n > shared)").select("a", F.col("row").alias("b"), "shared", F.lit(True).alias("same"))
    reps = s.join(classes.select(F.col("a").alias("row")), "row", "left_semi")
    found = cut(reps.groupBy("digest", "narrow").agg(*mark("row")).where("n > 1"))
    weighed = cut(found.groupBy("n", "x", "y", "narrow").agg(F.min("digest").alias("digest"), F.count("*").alias("weight")))
    # Tasks by the pairs they make; the rows of a shingle that makes more are dealt out, each part with all to pair with.
    parts = F.ceil(F.col("n").cast("double") * F.col("n") / PAIRS).cast("int")
    p = cut(reps.drop("narrow").join(weighed.select("digest", "narrow", "weight", parts.alias("_k")), "digest"))
    tasks = 1 + int((weighed.agg(F.sum(F.col("n").cast("double") * F.col("n"))).first()[0] or 0) // PAIRS)
    two = p.select("digest", F.col("row").alias("b"), F.explode(F.sequence(F.lit(0), F.col("_k") - 1)).alias("_s"))
    one = p.select("digest", F.pmod(F.xxhash64("row"), F.col("_k")).cast("int").alias("_s"), F.col("row").alias("a"), "narrow", "weight")
    by = ["digest", "_s"]
    pairs = one.repartition(tasks, *by).join(two.repartition(tasks, *by), by).where("a < b").groupBy("a", "b")
    pairs = pairs.agg(F.sum(F.col("narrow") * F.col("weight")).alias("shared"), F.min("narrow").alias("least")).where("shared >= 2 or least = 0")
    return same.unionByName(pairs.select("a", "b", "shared", F.lit(False).alias("same")))


def bag_difference(left: DataFrame, right: DataFrame, by: Sequence[str], key: str) -> DataFrame:
    """Keys whose counts differ (by, key, n_left, n_right, surplus); exclusive: one side has none and the other two or more."""
    l = left.groupBy(*by, key).agg(F.count("*").alias("n_left"))  # noqa: E741
    r = right.groupBy(*by, key).agg(F.count("*").alias("n_right"))
    j = l.join(r, [*by, key], "full_outer").fillna(0, ["n_left", "n_right"]).withColumn("surplus", F.col("n_left") - F.col("n_right")).where("surplus <> 0")
    return j.withColumn("exclusive", (F.least("n_left", "n_right") == 0) & (F.greatest("n_left", "n_right") >= 2))


def ladder(*steps: tuple[Column, str], otherwise: str = "none") -> Column:
    """The name of the first step that holds."""
    out = F.when(*steps[0])
    for condition, name in steps[1:]:
        out = out.when(condition, name)
    return out.otherwise(otherwise)
