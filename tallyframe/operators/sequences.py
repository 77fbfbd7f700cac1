"""Operators on ordered and two-sided evidence: residuals of alignments, branch codes, loops, outliers, censuses and caches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.operators.graph import cut

# The codes of conditional branches as (code, its negation, the same relation of the other signedness, group).
CODES = (
    ("je", "jne", None, "EQ"), ("jne", "je", None, "EQ"),
    ("jl", "jge", "jb", "ORD"), ("jle", "jg", "jbe", "ORD"), ("jg", "jle", "ja", "ORD"), ("jge", "jl", "jae", "ORD"),
    ("jb", "jae", "jl", "ORD"), ("jbe", "ja", "jle", "ORD"), ("ja", "jbe", "jg", "ORD"), ("jae", "jb", "jge", "ORD"),
    ("js", "jns", None, ""), ("jns", "js", None, ""), ("jo", "jno", None, ""), ("jno", "jo", None, ""),
    ("jp", "jnp", None, ""), ("jnp", "jp", None, ""),
)
#: A gap from here on may part outliers from a cluster, if they are this many at most.
OUTLIER_GAP, MOST_OUTLIERS = 0x8000, 3


def residual(left: Sequence[str], right: Sequence[str]) -> tuple[int, int]:
    """(residual, chunks) of an alignment: chunks that differ, and their longer sides summed."""
    differ = [max(b - a, d - c) for kind, a, b, c, d in SequenceMatcher(None, left, right, autojunk=False).get_opcodes() if kind != "equal"]
    return sum(differ), len(differ)


def aligned(pairs: DataFrame, keys: Sequence[str], left: str, right: str) -> DataFrame:
    """(keys, residual, chunks) of each pair of word lists; a null list is empty.

    Pairs are aligned on executors, a batch at a time; a pair of n and m words may take n * m steps.
    """

    def align(batches: Iterator) -> Iterator:
        for pdf in batches:
            words = lambda v: [] if v is None else list(v)
            found = [residual(words(a), words(b)) for a, b in zip(pdf[left], pdf[right], strict=True)]
            out = pdf[list(keys)].copy()
            out["residual"], out["chunks"] = [f[0] for f in found], [f[1] for f in found]
            yield out

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.select(*keys).schema.fields]
    return pairs.select(*keys, left, right).mapInPandas(align, ", ".join([*fields, "residual long", "chunks long"]))


def residual_class(left: Column, right: Column, mask) -> Column:
    """What kind of difference two word lists have: none, order only, names only (equal once masked), length or content."""
    bag = lambda words: F.array_sort(F.transform(words, mask))
    steps = F.when(left == right, "none").when(F.array_sort(left) == F.array_sort(right), "schedule").when(bag(left) == bag(right), "regname")
    return steps.when(F.size(left) != F.size(right), "length").otherwise("content")


def branch_codes(rows: DataFrame, unit: str, code: str, ours: Column) -> DataFrame:
    """Units whose branch codes differ between two sides: (unit, kind, flips, delta, balanced).

    A surplus of a code on one side cancels a surplus of its negation on the other (a flip). What is left is SIGNED if a
    code stands against its twin of the other signedness as often, OPERATOR if equality stands against order, else
    POLARITY. One aggregation with a sum a code: one shuffle, whatever the number of rows of a unit.
    """
    sign = F.when(ours, 1).otherwise(-1)
    sums = rows.groupBy(unit).agg(*[F.sum(F.when(F.col(code) == c, sign).otherwise(0)).alias(f"_{c}") for c, *_ in CODES])
    over = lambda c, side: F.greatest(F.col(f"_{c}") * side, F.lit(0))
    flip = {c: F.least(over(c, 1), over(no, -1)) for c, no, _, _ in CODES}
    left = {c: over(c, 1) - flip[c] for c, *_ in CODES}
    right = {c: over(c, -1) - flip[no] for c, no, _, _ in CODES}
    some = lambda conds: reduce(lambda a, b: a | b, conds)
    total = lambda cols: reduce(lambda a, b: a + b, cols)
    signed = some((left[c] > 0) & (left[c] == right[twin]) for c, _, twin, _ in CODES if twin)
    holds = lambda side, group: some(side[c] > 0 for c, _, _, g in CODES if g == group)
    operator = (holds(left, "EQ") & holds(right, "ORD")) | (holds(left, "ORD") & holds(right, "EQ"))
    extra = total(over(c, 1) for c, *_ in CODES), total(over(c, -1) for c, *_ in CODES)
    kind = F.when(signed, "SIGNED").when(operator, "OPERATOR").otherwise("POLARITY")
    return sums.where(extra[0] + extra[1] > 0).select(unit, kind.alias("kind"), total(flip.values()).alias("flips"), (extra[0] + extra[1]).alias("delta"), (extra[0] == extra[1]).alias("balanced"))


def loops(code: DataFrame, unit: str, at: str, target: str, call: Column) -> DataFrame:
    """(unit, head, branch, span, calls) of branches back to an instruction of their unit, by places from 1.

    code has one row an instruction; target is null where it is no branch. calls counts calls from the head up to the branch.
    """
    w = Window.partitionBy(unit).orderBy(at)
    placed = code.select(unit, at, target, F.row_number().over(w).cast("long").alias("_place"), F.coalesce(F.sum(F.when(call, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long").alias("_calls"))
    heads = placed.select(F.col(unit).alias("_unit"), F.col(at).alias("_head"), F.col("_place").alias("head"), F.col("_calls").alias("_before"))
    j = placed.where(F.col(target) < F.col(at)).join(heads, (F.col(unit) == F.col("_unit")) & (F.col(target) == F.col("_head")))
    return j.select(unit, "head", F.col("_place").alias("branch"), (F.col("_place") - F.col("head")).alias("span"), (F.col("_calls") - F.col("_before")).alias("calls"))


def clusters(rows: DataFrame, unit: str, at: str, gap: int = OUTLIER_GAP, most: int = MOST_OUTLIERS) -> DataFrame:
    """(unit, n, outliers, lo, hi): the dense run of a unit's addresses once small remote groups are peeled off.

    The widest gap (of equals the last) of what is left parts off its smaller side (of equals the lower), while it is
    `gap` wide and that side has `most` rows at most. Peeling an end changes no other gap, so wide gaps are found once and
    gone through once, the widest first; a unit's wide gaps, not its rows, are one task's.
    """
    w = Window.partitionBy(unit).orderBy(at)
    placed = rows.where(F.col(at).isNotNull()).select(unit, at, F.row_number().over(w).cast("long").alias("_k"), (F.lead(at).over(w) - F.col(at)).alias("_gap"))
    placed = cut(placed)
    sizes = placed.groupBy(unit).agg(F.max("_k").alias("n"))
    wide = placed.where(F.col("_gap") >= gap).select(unit, "_k", "_gap").join(sizes, unit)

    def peel(key, table):
        lo, hi = 1, table.column("n")[0].as_py()
        for _, k in sorted(zip(table.column("_gap").to_pylist(), table.column("_k").to_pylist()), reverse=True):
            if not lo <= k < hi:
                continue  # peeled off already
            low, high = k - lo + 1, hi - k
            if min(low, high) > most:
                break
            lo, hi = (k + 1, hi) if low <= high else (lo, k)
        return pa.table([pa.array([key[0].as_py()], key[0].type), pa.array([lo], pa.int64()), pa.array([hi], pa.int64())], names=[unit, "_lo", "_hi"])

    kind = rows.schema[unit].dataType.simpleString()
    ends = wide.groupBy(unit).applyInArrow(peel, f"`{unit}` {kind}, _lo long, _hi long")
    inside = placed.join(sizes, unit).join(ends, unit, "left").where(F.col("_k").between(F.coalesce("_lo", F.lit(1)), F.coalesce("_hi", "n")))
    return inside.groupBy(unit).agg(F.first("n").alias("n"), (F.first("n") - F.count("*")).alias("outliers"), F.min(at).alias("lo"), F.max(at).alias("hi"))


def census_violations(rows: DataFrame, by: Sequence[str], key: str, start: str, end: str, kind: str, kinds: Sequence[str], most: int) -> DataFrame:
    """(by, key, violation) of a census of extents: KIND outside its domain, EXTENT not positive, RANGE not in [0, most),
    DUPLICATE start within a space, OVERLAP with an extent that starts before. A row may have several; null is no kind."""
    space = [F.col(c) for c in by]
    reach = F.max(end).over(Window.partitionBy(*by).orderBy(start).rangeBetween(Window.unboundedPreceding, -1))
    again = rows.groupBy(*by, start).agg(F.count("*").alias("_n")).where("_n > 1").select(*by, start, F.lit(True).alias("_again"))
    seen = rows.withColumn("_reach", reach).join(again, [*by, start], "left")
    checks = (
        (~F.coalesce(F.col(kind).isin(*kinds), F.lit(False)), "KIND"), (F.col(end) <= F.col(start), "EXTENT"),
        ((F.col(start) < 0) | (F.col(end) > most), "RANGE"), (F.col("_again").isNotNull(), "DUPLICATE"), (F.col("_reach") > F.col(start), "OVERLAP"),
    )
    found = F.filter(F.array(*[F.when(cond, name) for cond, name in checks]), lambda v: v.isNotNull())
    return seen.select(*space, key, F.explode(found).alias("violation"))


def parity(upstream: DataFrame, local: DataFrame, key: str, content: str, renamed: Column, target: Column) -> DataFrame:
    """(key, class): each row of either side by path and content: exact, rename (equal once `renamed`), target or seam,
    excluded where it is not here, local where it is not upstream."""
    up = upstream.select(key, F.col(content).alias("_up"), renamed.alias("_renamed"))
    j = up.join(local.select(key, F.col(content).alias("_here")), key, "full_outer")
    here = F.col("_here")
    kind = F.when(here.isNull(), "excluded").when(F.col("_up").isNull(), "local").when(here == F.col("_up"), "exact")
    return j.select(key, kind.when(here == F.col("_renamed"), "rename").when(target, "target").otherwise("seam").alias("class"))


def reconciled(base: DataFrame, target: DataFrame, defined: DataFrame) -> DataFrame:
    """(src, dst, cause) of the edges (src, dst) of two graphs: MATCH in both; in the target alone UNDEFINED if the base
    defines no such dst (node), else MISSING; in the base alone INLINED if nothing in the target refers to dst, else EXTRA."""
    b, t = (df.select("src", "dst").distinct().withColumn(name, F.lit(True)) for df, name in ((base, "_b"), (target, "_t")))
    known = defined.select(F.col("node").alias("dst")).distinct().withColumn("_known", F.lit(True))
    called = target.select("dst").distinct().withColumn("_called", F.lit(True))
    j = b.join(t, ["src", "dst"], "full_outer").join(known, "dst", "left").join(called, "dst", "left")
    lost = F.when(F.col("_known").isNull(), "UNDEFINED").otherwise("MISSING")
    more = F.when(F.col("_called").isNull(), "INLINED").otherwise("EXTRA")
    return j.select("src", "dst", F.when(F.col("_b") & F.col("_t"), "MATCH").when(F.col("_t"), lost).otherwise(more).alias("cause"))


def refreshed(cache: DataFrame, current: DataFrame, key: Sequence[str], stamp: str, value: str, compute: Column) -> DataFrame:
    """current rows with value and reused: the cached value where the stamp is the same, else computed anew; what is
    gone falls out of the cache. compute is evaluated only for rows that changed."""
    old = cache.select(*key, F.col(stamp).alias("_stamp"), F.col(value).alias("_value"))
    same = F.coalesce(F.col(stamp) == F.col("_stamp"), F.lit(False))
    j = current.join(old, list(key), "left")
    return j.select(*key, stamp, F.when(same, F.col("_value")).otherwise(compute).alias(value), same.alias("reused"))


def content_name(name: Column, content: Column, volatile: str) -> Column:
    """The name, or, where it matches the volatile pattern, the name without ordinals and with a digest of the content."""
    return F.when(name.rlike(volatile), F.concat(F.regexp_replace(name, "[0-9]+", ""), F.lit("_"), F.substring(F.sha2(content, 256), 1, 12))).otherwise(name)


def metrics(rows: DataFrame, by: str, text: str, patterns: dict[str, str]) -> DataFrame:
    """(by, metric, n): how often each pattern matches in a group's texts; groups without a match have 0."""
    counts = [F.sum(F.coalesce(F.regexp_count(text, F.lit(p)), F.lit(0))).alias(name) for name, p in patterns.items()]
    wide = rows.groupBy(by).agg(*counts)
    return wide.select(by, F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("n")) for n in patterns])).alias("m")).select(by, "m.metric", "m.n")
