"""Alignment of pairs of token sequences, the chunks in which they differ, and what kind of difference it is.

Tokens that both sides of a stretch have once are anchors; the longest chain of anchors that rise on both sides is matched
and parts the stretch into gaps, which are aligned in turn. A gap without anchors takes a longest common subsequence.

Short pairs are aligned whole, many a task. A long pair is never in one task: anchors are found by counting tokens by
stretch; anchors that no other crosses are on every longest chain and cut the others into segments, which are chained
apart, so that the result is that of the whole; then each gap is a stretch of the next round. What has no anchors left is
aligned a gap a task, in time as the product of its sides and memory as their sum.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.operators.graph import cut

#: Tokens of both sides of a pair that is aligned whole.
SHORT = 20_000
#: Below so many, plain lists are faster than arrays.
FEW = 64


def rising(values: Sequence[int]) -> list[int]:
    """Places of a longest rising subsequence; a later value replaces an earlier one at the end of as long a run."""
    ends, last, before = [], [], []
    for k, v in enumerate(values):
        at = bisect_left(ends, v)
        before.append(last[at - 1] if at else -1)
        ends[at : at + 1], last[at : at + 1] = [v], [k]
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(k)
        k = before[k]
    return out[::-1]


def lengths(a: Sequence[int], b: Sequence[int]) -> Sequence[int]:
    """Lengths of longest common subsequences of a and each beginning of b."""
    if len(b) < FEW:
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for k, y in enumerate(b):
                new.append(max(row[k + 1], row[k] + (x == y), new[k]))
            row = new
        return row
    b, row = np.asarray(b), np.zeros(len(b) + 1, np.int64)
    for x in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (b == x)))
    return row


def common(a: Sequence[int], b: Sequence[int]) -> list[tuple[int, int]]:
    """Matched places of a longest common subsequence, found by halving a; of equals b is parted as early as possible."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, i_end, j, j_end = todo.pop()
        while i < i_end and j < j_end and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < i_end and j < j_end and a[i_end - 1] == b[j_end - 1]:
            i_end, j_end = i_end - 1, j_end - 1
            out.append((i_end, j_end))
        if i == i_end or j == j_end:
            continue
        if i_end - i == 1:
            at = next((k for k in range(j, j_end) if b[k] == a[i]), None)
            if at is not None:
                out.append((i, at))
            continue
        half = (i + i_end) // 2
        left, right = lengths(a[i:half], b[j:j_end]), lengths(a[half:i_end][::-1], b[j:j_end][::-1])[::-1]
        both = np.add(left, right) if j_end - j >= FEW else [x + y for x, y in zip(left, right)]
        cut_ = j + (int(both.argmax()) if j_end - j >= FEW else both.index(max(both)))
        todo += [(i, half, j, cut_), (half, i_end, cut_, j_end)]
    return sorted(out)


def match(a: Sequence[int], b: Sequence[int]) -> list[tuple[int, int]]:
    """Matched places of two sequences of numbers, by anchors, then by gaps."""
    a, b = (x.tolist() if isinstance(x, np.ndarray) else x for x in (a, b))
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, i_end, j, j_end = todo.pop()
        if i == i_end or j == j_end:
            continue
        ours, theirs = a[i:i_end], b[j:j_end]
        n_one, n_two = Counter(ours), Counter(theirs)
        if n_one.keys().isdisjoint(n_two):
            continue
        two = {t: k for k, t in enumerate(theirs)}
        both = [(k, two[t]) for k, t in enumerate(ours) if n_one[t] == 1 and n_two.get(t) == 1]
        chain = [both[k] for k in rising([x[1] for x in both])]
        if not chain:
            out += [(i + x, j + y) for x, y in common(ours, theirs)]
            continue
        ends = [(-1, -1), *chain, (i_end - i, j_end - j)]
        out += [(i + x, j + y) for x, y in chain]
        todo += [(i + p + 1, i + q, j + r + 1, j + s) for (p, r), (q, s) in zip(ends, ends[1:])]
    return sorted(out)


def _fields(df: DataFrame, keys: Sequence[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema.fields)


def _within(keys: Sequence[str], aligner):
    """A group of tokens (keys, ours, pos, token) to its matched places."""

    def run(key, table):
        side, pos, token = (table.column(c).to_numpy(zero_copy_only=False) for c in ("ours", "pos", "token"))
        order = np.lexsort((pos, ~side))
        side, pos, token = side[order], pos[order], token[order]
        n = int(side.sum())
        found = aligner(token[:n], token[n:])
        names = [*keys[: len(key)], "i", "j"]
        columns = [pa.array([k.as_py()] * len(found), k.type) for k in key] + [pa.array([int(pos[x]) for x, _ in found], pa.int64()), pa.array([int(pos[n + y]) for _, y in found], pa.int64())]
        return pa.Table.from_arrays(columns, names=names)

    return run


def _whole(keys: Sequence[str]):
    """Batches of pairs (keys, _l and _r: lists of places and tokens in order) to their matched places (keys, i, j)."""

    def run(batches):
        for batch in batches:
            sides = []
            for c in ("_l", "_r"):
                column = batch.column(c)
                rows = column.flatten()
                sides.append((np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())]).tolist(), rows.field("pos").to_pylist(), rows.field("token").to_pylist()))
            (l_at, l_pos, l_token), (r_at, r_pos, r_token) = sides
            which, i, j = [], [], []
            for k in range(batch.num_rows):
                p, q = l_at[k], r_at[k]
                for x, y in match(l_token[p : l_at[k + 1]], r_token[q : r_at[k + 1]]):
                    which.append(k)
                    i.append(l_pos[p + x])
                    j.append(r_pos[q + y])
            rows = batch.select(list(keys)).take(pa.array(which, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(i, pa.int64()), pa.array(j, pa.int64())], names=[*keys, "i", "j"])

    return run


def _chained(keys: Sequence[str]):
    """A segment of anchors (keys, i, j) to those of its longest chain."""

    def run(key, table):
        i, j = (table.column(c).to_numpy() for c in ("i", "j"))
        order = np.argsort(i, kind="stable")
        some = order[rising(j[order].tolist())]
        return pa.Table.from_arrays([pa.array([k.as_py()] * len(some), k.type) for k in key] + [pa.array(i[some]), pa.array(j[some])], names=[*keys, "i", "j"])

    return run


def anchors(tokens: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, i, j, segment): tokens that both sides of a stretch have once; no anchor of a segment crosses one of another."""
    once = lambda ours: F.count_if(F.col("ours") == ours)
    at = lambda ours: F.max(F.when(F.col("ours") == ours, F.col("pos")))
    both = tokens.groupBy(*keys, "token").agg(once(True).alias("_l"), once(False).alias("_r"), at(True).alias("i"), at(False).alias("j")).where("_l = 1 and _r = 1").select(*keys, "i", "j")
    w = Window.partitionBy(*keys).orderBy("i")
    before = F.max("j").over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min("j").over(w.rowsBetween(0, Window.unboundedFollowing))
    # A segment begins where all before lie below all that follow on the other side as well.
    begins = F.coalesce((before < after).cast("long"), F.lit(1).cast("long"))
    return both.withColumn("_b", begins).withColumn("segment", F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_b")


def matches(tokens: DataFrame, keys: Sequence[str], short: int = SHORT) -> DataFrame:
    """(keys, i, j): matched places of pairs; tokens: keys, ours (whose side), pos from 0, token.

    Tokens are compared by value; null ones equal each other. Keys must not be null.
    """
    keys = list(keys)
    rows = cut(tokens.select(*keys, "ours", F.col("pos").cast("long").alias("pos"), F.xxhash64("token").alias("token")))
    long_ = cut(rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > short).select(*keys))
    none = long_.isEmpty()
    small = rows if none else rows.join(long_, keys, "left_anti")
    # Short pairs go to Python many at a time, and only those that have a token on both sides: the others match nothing.
    side = lambda ours: F.array_sort(F.collect_list(F.when(F.col("ours") == ours, F.struct("pos", "token"))))
    short_ = small.groupBy(*keys).agg(side(True).alias("_l"), side(False).alias("_r")).where(F.arrays_overlap("_l.token", "_r.token"))
    out = short_.mapInArrow(_whole(keys), f"{_fields(rows, keys)}, i long, j long")
    if none:
        return out
    stretch = [*keys, "gap"]
    open_ = cut(rows.join(long_, keys).withColumn("gap", F.lit(0).cast("long")))
    done = None
    while True:
        held = anchors(open_, stretch)
        chain = cut(held.groupBy(*stretch, "segment").applyInArrow(_chained([*stretch, "segment"]), f"{_fields(open_, stretch)}, segment long, i long, j long").select(*stretch, "i", "j"))
        if chain.isEmpty():
            break
        found = chain.select(*keys, "i", "j")
        done = found if done is None else done.unionByName(found)
        # A token's gap is told by the last matched place before it, on its own side, which names the one on the other.
        side = lambda ours, c: done.select(*keys, F.lit(ours).alias("ours"), F.col(c).alias("pos"), F.col("i").alias("_i"))  # noqa: B023, E731
        marks = side(True, "i").unionByName(side(False, "j"))
        w = Window.partitionBy(*keys, "ours").orderBy("pos", F.col("_i").isNull()).rowsBetween(Window.unboundedPreceding, 0)
        both = open_.drop("gap").withColumn("_i", F.lit(None).cast("long")).unionByName(marks.withColumn("token", F.lit(None).cast("long")))
        both = both.withColumn("gap", F.coalesce(F.last("_i", ignorenulls=True).over(w) + 1, F.lit(0))).withColumn("_m", F.max(F.col("_i").isNotNull()).over(Window.partitionBy(*keys, "ours", "pos")))
        rest = both.where("not _m").drop("_i", "_m")
        # Gaps without tokens on one of the sides match nothing more.
        two = rest.groupBy(*stretch).agg(F.count_distinct("ours").alias("_sides")).where("_sides = 2").select(*stretch)
        open_ = cut(rest.join(two, stretch))
    last = open_.groupBy(*stretch).applyInArrow(_within(stretch, common), f"{_fields(open_, stretch)}, i long, j long").select(*keys, "i", "j")
    every = last if done is None else done.unionByName(last)
    return out.unionByName(every)


def spread(pairs: DataFrame, keys: Sequence[str], left: str, right: str) -> DataFrame:
    """Tokens of pairs of arrays; a null array is an empty one."""
    side = lambda c, ours: pairs.select(*keys, F.lit(ours).alias("ours"), F.posexplode(c).alias("pos", "token"))
    return side(left, True).unionByName(side(right, False))


def chunks(matched: DataFrame, sizes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, lo, hi, other_lo, other_hi) of what lies between matched runs of pairs (keys, n, m: their lengths), empty ones left out."""
    keys = list(keys)
    ends = sizes.select(*keys, F.col("n").cast("long").alias("i"), F.col("m").cast("long").alias("j"))
    w = Window.partitionBy(*keys).orderBy("i", "j")
    after = lambda c: F.coalesce(F.lag(c).over(w) + 1, F.lit(0).cast("long"))
    gaps = matched.select(*keys, "i", "j").unionByName(ends).select(*keys, after("i").alias("lo"), F.col("i").alias("hi"), after("j").alias("other_lo"), F.col("j").alias("other_hi"))
    return gaps.where("lo < hi or other_lo < other_hi")


def residuals(chunked: DataFrame, sizes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, residual, chunks) of every pair: the longer sides of its chunks summed, and how many there are."""
    keys = list(keys)
    sums = chunked.groupBy(*keys).agg(F.sum(F.greatest(F.col("hi") - F.col("lo"), F.col("other_hi") - F.col("other_lo"))).alias("residual"), F.count("*").alias("chunks"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return sizes.select(*keys).join(sums, keys, "left").select(*keys, zero("residual"), zero("chunks"))


# Registers, those that a callee keeps, and the shapes of a copy, a store, immediates and displacements once
# registers are written r.
REGISTERS = r"\b(?:e?(?:ax|bx|cx|dx|si|di|bp)|[abcd][lh])\b"
COPY, STORE = r"^mov r,r$", r"^(?:mov|fstp|fst) (?:DWORD PTR |WORD PTR |BYTE PTR )?\[[^\]]*\],"
IMMEDIATE, DISPLACEMENT = r"(?<![\w+\-\[])(0x[0-9a-f]+)(?![\w\]])", r"\[r(?:\+r(?:\*\d)?)?([+-]0x[0-9a-f]+)?\]"
MATERIAL = r"^(?:lea r,\[r(?:\+r(?:\*\d)?)?\+(0x[0-9a-f]+)\]|add r,(0x[0-9a-f]+))$"


def stripped(code: Column) -> Column:
    """An instruction with every register written r; what it refers to, after |, stays, and a forced zero displacement goes."""
    head, ref = F.substring_index(code, "|", 1), F.regexp_extract(code, r"(\|.*)$", 1)
    return F.concat(F.replace(F.regexp_replace(head, REGISTERS, "r"), F.lit("+0x0]"), F.lit("]")), ref)


def residual_classes(tokens: DataFrame, matched: DataFrame, sizes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, class, deficit) of every pair, by what its unmatched instructions differ in; the first that fits of

    none, schedule (the same instructions), regname (the same but for registers), arm-copy and extra-copy (the side that
    has more has register copies for it, the other none), dup-store, extra-store and missing-store (likewise stores; dup
    if ours repeats one that it has), immediate, subobject (two or more displacements, all off by one constant that some
    pointer is made with), displacement, referent (a name that the other side has nowhere), selection (other operations)
    and operand. deficit: instructions the other side has more, registers aside.

    Differences of bags are sums of counts by pair and value, so no pair is gathered. Matched places hold equal codes, so
    what is left of the bags differs as the whole bags do: of the matches only their number counts, which tells whether
    anything is left.
    """
    keys = list(keys)
    count = lambda cond, c="d": F.sum(F.when(cond, F.abs(c)).otherwise(0))
    code = tokens.select(*keys, "ours", F.col("token").alias("code")).groupBy(*keys, "code").agg(F.count_if("ours").alias("_b"), F.count_if(~F.col("ours")).alias("_t"))
    code = code.withColumn("key", stripped(F.col("code"))).withColumn("_again", (F.col("_b") > F.col("_t")) & (F.col("_b") > 1))
    net = code.groupBy(*keys, "key").agg(F.sum(F.col("_b") - F.col("_t")).alias("d"), F.sum("_b").alias("_b"), F.sum("_t").alias("_t"), F.max("_again").alias("_again"), F.max(F.col("_b") != F.col("_t")).alias("inexact"))
    net = cut(net.withColumn("bare", F.substring_index("key", "|", 1)))
    copy, store, ours, theirs = F.col("bare").rlike(COPY), F.col("bare").rlike(STORE), F.col("d") > 0, F.col("d") < 0
    # The parts of what differs, and all names, each summed up by pair and value.
    number = F.coalesce(F.conv(F.regexp_extract("_x", "0x([0-9a-f]+)", 1), 16, 10).try_cast("long"), F.lit(0)) * F.when(F.col("_x").startswith("-"), -1).otherwise(1)
    each = lambda kind, xs: F.transform(xs, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("_x")))
    all_of = lambda pattern: F.coalesce(F.regexp_extract_all("bare", F.lit(pattern), F.lit(1)), F.array().cast("array<string>"))
    displaced = all_of(DISPLACEMENT)
    parts = F.concat(each("immediate", all_of(IMMEDIATE)), each("operation", F.array(F.substring_index("bare", " ", 1))), each("displaced", displaced))
    names = each("referent", F.filter(F.array(F.regexp_extract("key", r"\|(.*)$", 1)), lambda x: x != ""))
    valued = net.select(*keys, "d", "_b", "_t", F.inline(F.when(F.col("d") != 0, F.concat(parts, names)).otherwise(names)))
    valued = valued.withColumn("_x", F.when(F.col("kind") == "displaced", number.cast("string")).otherwise(F.col("_x")))
    valued = valued.groupBy(*keys, "kind", "_x").agg(F.sum("d").alias("d"), F.sum("_b").alias("_b"), F.sum("_t").alias("_t"))
    valued = valued.where((F.col("d") != 0) & ((F.col("kind") != "referent") | F.when(ours, F.col("_t") == 0).otherwise(F.col("_b") == 0)))
    odd = valued.groupBy(*keys).agg(*[F.max(F.col("kind") == k).alias(k) for k in ("immediate", "operation", "displaced", "referent")])
    shown = F.size(displaced)
    facts = net.groupBy(*keys).agg(
        F.sum(F.col("_b") + F.col("_t")).alias("tokens"), F.max("inexact").alias("inexact"), F.max(F.col("_again") & store).alias("again"),
        *[count(c & s).alias(f"{m}{name}") for name, c in (("all", F.lit(True)), ("copy", copy), ("store", store)) for m, s in (("b_", ours), ("t_", theirs))],
        F.sum(F.when(ours, F.col("d") * shown).otherwise(0)).alias("b_shown"), F.sum(F.when(theirs, -F.col("d") * shown).otherwise(0)).alias("t_shown"),
    )
    facts = cut(facts)
    # Displacements move together only where one side has two and the other has any.
    may = facts.where("least(b_shown, t_shown) >= 1 and greatest(b_shown, t_shown) >= 2").select(*keys)
    constant = F.coalesce(*[F.nullif(F.regexp_extract("bare", MATERIAL, g), F.lit("")) for g in (1, 2)])
    moving = cut(net.where((F.col("d") != 0) & (shown > 0) | constant.isNotNull()).join(may, keys, "left_semi"))
    places = moving.where("d <> 0").select(*keys, ours.alias("ours"), F.abs("d").alias("n"), F.explode(displaced).alias("_x"))
    places = places.groupBy(*keys, "ours", number.alias("_x")).agg(F.sum("n").alias("n"))
    # Constants that a pointer is made with, on either side, tried in both directions.
    made = moving.select(*keys, constant.alias("_x")).where("_x is not null")
    made = made.select(*keys, number.alias("_k")).where("_k <> 0").distinct().select(*keys, "_k", F.explode(F.array(F.lit(True), F.lit(False))).alias("_split"))
    moved = places.join(made, keys).withColumn("n", F.when((F.col("_split") == F.col("ours")) & (F.col("_x") == F.col("_k")), F.col("n") - 1).otherwise(F.col("n"))).where("n > 0")
    moved = moved.withColumn("_x", F.when(F.col("_split") == F.col("ours"), F.col("_x") + F.col("_k")).otherwise(F.col("_x")))
    tried = moved.groupBy(*keys, "_k", "_split", "_x").agg(
        F.sum(F.when(F.col("ours"), F.col("n")).otherwise(-F.col("n"))).alias("d"), F.sum(F.when(F.col("_split") != F.col("ours"), F.col("n")).otherwise(0)).alias("_folded"), F.max("ours").alias("_b"), F.max(~F.col("ours")).alias("_t")
    )
    tried = tried.groupBy(*keys, "_k", "_split").agg(F.max(F.col("d") != 0).alias("off"), F.sum("_folded").alias("_folded"), F.max("_b").alias("_b"), F.max("_t").alias("_t"))
    shifted = tried.where("not off and _folded >= 2 and _b and _t").select(*keys, F.lit(True).alias("shifted")).distinct()
    found = matched.groupBy(*keys).agg(F.count("*").alias("found"))
    j = sizes.select(*keys).join(facts, keys, "left").join(odd, keys, "left").join(shifted, keys, "left").join(found, keys, "left")
    c = F.col
    deficit = F.coalesce(c("t_all") - c("b_all"), F.lit(0))
    left = F.coalesce(c("tokens"), F.lit(0)) > 2 * F.coalesce(c("found"), F.lit(0))
    kind = F.when(~left, "none").when(~c("inexact"), "schedule").when(c("b_all") + c("t_all") == 0, "regname")
    kind = kind.when((deficit > 0) & (c("t_copy") >= deficit) & (c("b_copy") == 0), "arm-copy").when((deficit < 0) & (c("b_copy") >= -deficit) & (c("t_copy") == 0), "extra-copy")
    kind = kind.when((deficit < 0) & (c("b_store") >= -deficit) & (c("t_store") == 0), F.when(c("again"), "dup-store").otherwise("extra-store")).when((deficit > 0) & (c("t_store") >= deficit) & (c("b_store") == 0), "missing-store")
    kind = kind.when(c("immediate"), "immediate").when(c("displaced") & c("shifted"), "subobject").when(c("displaced"), "displacement").when(c("referent"), "referent").when(c("operation"), "selection").otherwise("operand")
    return j.select(*keys, kind.alias("class"), deficit.alias("deficit"))
