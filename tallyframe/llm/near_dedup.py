"""Near-duplicate groups by a chosen-path set similarity join.

Documents are sets of word shingles. Equal sets are one class. In each of TREES independent trees a class goes to the
node of its minwise token; a node of at most SMALL classes is compared exhaustively. A larger node first compares its
classes with one drawn by lot, and with that of its classes which was most similar to those drawn: that costs one
comparison for each class, and links most of a large group. A node whose classes are linked by then is done. Where at
most FEW stand apart from the rest, these are compared with all of the node; any other node branches: it draws one or
two of the minwise positions, 1 / 0.75 on the average, and sends its classes down by their tokens there, so that a pair
at the limit of similarity is expected in one child of each node it is in, however deep. What is still larger after
LEVELS is compared all the same, in blocks: nothing is left out for a node's size.

Sketches of the minwise tokens, a byte each, rule out what cannot reach the similarity; what remains is confirmed on the
full sets, and linked classes form components. A pair at the limit of similarity misses the first level of all trees
with probability 0.25 ** TREES; only pairs between components that are not linked otherwise depend on it at all.

Edge cases: a null or empty text has no shingles and no links; with fewer words than a shingle the whole sequence is
one; texts of any length are taken whole; repeated rows with one doc_id are one document if their sets agree, and are
linked through their doc_id else; a row with a null doc_id has no component and is kept; further columns are ignored;
an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import common
from tallyframe.llm.components import components

SHINGLE = 5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Trees, minwise positions of a sketch (the first TREES of them are the trees' first tokens), and levels below the first.
TREES, SLOTS, LEVELS = 16, 100, 8
#: Classes of a node that are compared exhaustively; classes that stand apart in a node and are compared with all of it.
SMALL, FEW = 24, 1024
#: Classes of a node that are compared in one task, those apart and all: larger nodes are split into blocks and parts.
BLOCK, PART = 1024, 4096
#: Sketches agree in so many of SLOTS places at least: 75 are expected at 0.75, and this is over five deviations less.
AGREE = 52
#: Bytes of shingles in one block of sets that are confirmed together.
BLOCK_BYTES = 8 << 20
SLICE = 2 << 20
#: Classes whose numbers and documents, 24 bytes each, are sent to all tasks; more are joined by shuffle.
SENT = 400_000
PAIR = "a long, b long, agree int"
PAIR_TYPES = (pa.int64(), pa.int64(), pa.int32())


def shingle_sets(docs: list[bytes], k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document."""
    words, bounds = common.word_hashes(docs, lower=True)
    hashes = common.window_hashes(words, k)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(hashes[a : b - k + 1]))
        elif b > a:
            out.append(common.window_hashes(words[a:b], b - a) ^ np.uint64(b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sketches(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """[set, tree]: the first minwise token of each tree; [set, slot]: the last byte of each minwise token; sets are not empty."""
    flat = np.concatenate(sets)
    first = np.cumsum([0, *map(len, sets)])[:-1]
    draw = np.random.default_rng(20_240_229)
    odd = draw.integers(0, 1 << 63, SLOTS, np.uint64) * np.uint64(2) + np.uint64(1)
    add = draw.integers(0, 1 << 63, SLOTS, np.uint64)
    heads, slots = np.zeros((len(sets), TREES), "<u4"), np.zeros((len(sets), SLOTS), np.uint8)
    for j in range(SLOTS):
        x = flat * odd[j]
        x += add[j]
        x ^= x >> np.uint64(29)
        x *= common.MIX1
        x >>= np.uint64(32)
        least = np.minimum.reduceat(x.astype(np.uint32), first)
        slots[:, j] = least.astype(np.uint8)
        if j < TREES:
            heads[:, j] = least
    return heads, slots


def describe(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_key, n_shingles, two hashes of the set, and its heads and sketch (null for an empty set)."""

    def run(batches):
        common.no_tool()
        for b in common.slices(batches, most=SLICE):
            sets = shingle_sets(common.blobs(b), shingle)
            full = [s for s in sets if len(s)]
            heads, slots = sketches(full) if full else ((), ())
            rows = iter(zip(heads, slots))
            out = ([], [], [], [], [])
            for s in sets:
                x = (len(s), int(np.sum(s, dtype=np.uint64).view(np.int64)), int(np.bitwise_xor.reduce(common.mix(s)).view(np.int64)) if len(s) else 0, *(x.tobytes() for x in next(rows))) if len(s) else (0, 0, 0, None, None)
                for to, v in zip(out, x):
                    to.append(v)
            columns = [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], ["doc_id", "text_key", "n_shingles", "s1", "s2", "heads", "sketch"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    return rows.mapInArrow(run, "doc_id long, text_key long, n_shingles long, s1 long, s2 long, heads binary, sketch binary")


def views(column) -> list[np.ndarray]:
    """The sets of a column of bytes, without copies of them."""
    out = []
    for c in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        _, ends, data = c.buffers()
        ends = np.frombuffer(ends, np.int32, len(c) + 1, 4 * c.offset).tolist() if len(c) else [0]
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        out += [data[a:b].view(np.uint64) for a, b in zip(ends, ends[1:])]
    return out


def table_of(column) -> np.ndarray:
    """[row, slot] of a column of sketches."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), SLOTS)


def sizes_allow(n, m):
    return 100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m)


def batch_of(found: list[tuple]) -> pa.RecordBatch:
    """Pairs (p, q, agree) as a < b."""
    p, q, agree = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((np.minimum(p, q), np.maximum(p, q), agree.astype(np.int32)), PAIR_TYPES)], ["a", "b", "agree"])


def exhaustive(nodes: DataFrame, across: bool = False) -> DataFrame:
    """nodes (members: array of rep, n, sketch and, if across, component; at most SMALL): pairs (of two components, if
    across) whose sketches and sizes allow the similarity."""

    def run(batches):
        for batch in batches:
            members, found = batch.column(0), []
            for i in range(batch.num_rows):
                m = members[i].values
                rep, n, s = np.asarray(m.field("rep")), np.asarray(m.field("n")), table_of(m.field("sketch"))
                x, y = np.triu_indices(len(rep), 1)
                if across:
                    c = np.asarray(m.field("component"))
                    two = c[x] != c[y]
                    x, y = x[two], y[two]
                agree = (s[x] == s[y]).sum(axis=1)
                ok = (agree >= AGREE) & sizes_allow(n[x], n[y])
                found.append((rep[x[ok]], rep[y[ok]], agree[ok]))
            yield batch_of(found)

    return nodes.mapInArrow(run, PAIR)


def with_drawn(large: DataFrame) -> DataFrame:
    """large (path, rep, n, sketch, drawn_rep, drawn_n, drawn_sketch): rep, other, agree, and whether the pair may reach the similarity."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            rep, n, other, m = (np.asarray(b.column(i)) for i in (0, 1, 3, 4))
            agree = (table_of(b.column(2)) == table_of(b.column(5))).sum(axis=1).astype(np.int32)
            ok = (agree >= AGREE) & (rep != other) & sizes_allow(n, m)
            yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(other), pa.array(agree), pa.array(ok)], ["rep", "other", "agree", "ok"])

    return large.select("rep", "n", "sketch", "drawn_rep", "drawn_n", "drawn_sketch").mapInArrow(run, "rep long, other long, agree int, ok boolean")


def possible(compared: DataFrame) -> DataFrame:
    return compared.where("ok").select(F.least("rep", "other").alias("a"), F.greatest("rep", "other").alias("b"), "agree")


def candidates(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """classes (rep, n, heads, sketch): distinct pairs (a < b, agree) that meet in a small node, or with a drawn class of
    a larger one, and may reach the similarity; and (path, rep) of larger nodes."""
    trees = F.array(*[F.lit(t) for t in range(TREES)])
    paths = classes.select("rep", F.explode(trees).alias("tree"), "heads").select("rep", F.xxhash64("tree", F.expr("substring(heads, tree * 4 + 1, 4)")).alias("path"))
    sizes = common.stash(paths.groupBy("path").agg(F.count("*").alias("size")).where(F.col("size") > 1))
    # Sketches are fetched only for classes that share a node with another.
    here = common.stash(paths.join(sizes, "path"))
    level = common.stash(here.join(classes.drop("heads"), "rep"))
    small = level.where(F.col("size") <= SMALL).groupBy("path").agg(F.collect_list(F.struct("rep", "n", "sketch")).alias("members"))
    found = exhaustive(small.select("members"))
    large = level.where(F.col("size") > SMALL)
    lot = F.struct(F.xxhash64("path", "rep").alias("lot"), F.col("rep").alias("drawn_rep"), F.col("n").alias("drawn_n"), F.col("sketch").alias("drawn_sketch"))
    drawn = common.stash(large.groupBy("path").agg(F.min(lot).alias("drawn")).select("path", "drawn.*"))
    if not drawn.isEmpty():
        compared = common.stash(with_drawn(large.join(drawn, "path")))
        middle = compared.where("rep <> other").groupBy("rep").agg(F.avg("agree").alias("mean"))
        lead = F.struct("mean", F.col("rep").alias("drawn_rep"), F.col("n").alias("drawn_n"), F.col("sketch").alias("drawn_sketch"))
        best = common.stash(common.stash(large.join(middle, "rep")).groupBy("path").agg(F.max(lead).alias("best")).select("path", "best.drawn_rep", "best.drawn_n", "best.drawn_sketch"))
        found = found.unionAll(possible(compared)).unionAll(possible(with_drawn(large.join(best, "path"))))
    return common.stash(found.groupBy("a", "b").agg(F.max("agree").alias("agree"))), large.select("path", "rep")


def to_compare(level: DataFrame) -> DataFrame:
    """(near, rep, apart): what has to be compared on full sets, of level (path, rep, n, component, sketch; size, main,
    n_out of the node). Those apart from the node's commonest component, main, are held against all of the node, in
    blocks and parts; who meets a class of another component whose sketch and size allow the similarity is returned for
    the component near, once: as many rows as classes, not as pairs."""
    blocks, parts = F.ceil(F.col("n_out") / BLOCK).cast("int"), F.ceil(F.col("size") / PART).cast("int")
    block_of, part_of = F.pmod(F.xxhash64("rep"), blocks).cast("int"), F.pmod(F.xxhash64("rep", F.lit(1)), parts).cast("int")
    row = ["path", "rep", "n", "component", "sketch"]
    out = level.where("component <> main").select(*row, block_of.alias("block"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    all_ = level.select(*row, "main", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), part_of.alias("part"))

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        hit = np.zeros(right.num_rows, bool)
        found = []
        if left.num_rows and right.num_rows:
            n, c, s = right.column("n").to_numpy(), right.column("component").to_numpy(), table_of(right.column("sketch"))
            for rep, m, d, t in zip(*(left.column(k).to_pylist() for k in ("rep", "n", "component", "sketch"))):
                may = np.flatnonzero((c != d) & sizes_allow(n, m))
                may = may[(s[may] == np.frombuffer(t, np.uint8)).sum(axis=1) >= AGREE]
                hit[may] = True
                if len(may):
                    found.append(rep)
        y = right.column("rep").to_numpy()[hit] if right.num_rows else np.zeros(0, np.int64)
        near = right.column("main")[0].as_py() if right.num_rows else 0
        return pa.table({"near": pa.array(np.full(len(found) + len(y), near), pa.int64()), "rep": pa.array(np.concatenate([np.array(found, np.int64), y])), "apart": pa.array(np.arange(len(found) + len(y)) < len(found))})

    key = ["path", "block", "part"]
    return out.groupBy(*key).cogroup(all_.groupBy(*key)).applyInArrow(compare, "near long, rep long, apart boolean")


def apart(crowded: DataFrame, classes: DataFrame, placed: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """What meets in larger nodes (crowded: path, rep) and is in two components (placed: rep, component) although it may
    reach the similarity: pairs (a < b, agree) of small nodes further down, and (near, rep, apart) as of to_compare().
    None if no node has two components."""
    level = common.stash(crowded.join(placed, "rep"))
    pairs, crowds = [], []
    for depth in range(LEVELS + 1):
        by = level.groupBy("path", "component").agg(F.count("*").alias("k")).groupBy("path")
        told = by.agg(F.sum("k").alias("size"), F.max(F.struct("k", "component")).alias("most"))
        told = common.stash(told.where("size > most.k").select("path", "size", F.col("most.component").alias("main"), (F.col("size") - F.col("most.k")).alias("n_out")))
        if told.isEmpty():
            break
        level = level.join(told, "path")
        if not depth:
            level = level.join(classes.select("rep", "n", "sketch"), "rep")
        level = common.stash(level)
        if depth:
            small = level.where(F.col("size") <= SMALL).groupBy("path").agg(F.collect_list(F.struct("rep", "n", "component", "sketch")).alias("members"))
            pairs.append(common.stash(exhaustive(small.select("members"), across=True)))
        few = (F.col("n_out") <= FEW) | F.lit(depth == LEVELS)
        crowds.append(common.stash(to_compare(level.where((F.col("size") > SMALL) & few))))
        rest = level.where((F.col("size") > SMALL) & ~few)
        if rest.isEmpty():
            break
        # One position, or in one node of three another too: 1 / 0.75 on the average.
        place = lambda i: F.pmod(F.xxhash64("path", F.lit(i)), F.lit(SLOTS)).cast("int")  # noqa: E731, B023
        places = F.when(F.pmod(F.xxhash64("path", F.lit(0)), F.lit(3)) == 0, F.array_distinct(F.array(place(1), place(2)))).otherwise(F.array(place(1)))
        rest = rest.select("path", "rep", "component", "n", "sketch", F.explode(places).alias("place"))
        level = common.stash(rest.select(F.xxhash64("path", "place", F.expr("substring(sketch, place + 1, 1)")).alias("path"), "rep", "component", "n", "sketch"))
    if not crowds:
        return None
    all_ = lambda found, schema: found[0] if len(found) == 1 else found[0].unionAll(all_(found[1:], schema)) if found else placed.sparkSession.createDataFrame([], schema)
    return common.stash(all_(pairs, PAIR).groupBy("a", "b").agg(F.max("agree").alias("agree"))), common.stash(all_(crowds, None).groupBy("near", "rep").agg(F.max("apart").alias("apart")))


def full_sets(reps: DataFrame, texts: tuple[DataFrame, DataFrame], shingle: int = SHINGLE) -> DataFrame:
    """The shingles of each class of reps (rep), from texts: (doc_id, text_key, text), and (rep, doc_id, text_key) of a
    document of each class."""
    docs, ones = texts
    some = common.stash(ones.join(reps, "rep", "left_semi"))
    some = F.broadcast(some) if some.count() <= SENT else some

    def sets(batches):
        common.no_tool()
        for b in common.slices(batches, most=SLICE):
            found = shingle_sets(common.blobs(b), shingle)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.tobytes() for s in found], pa.binary())], ["rep", "shingles"])

    return common.stash(docs.join(some, ["doc_id", "text_key"]).select("rep", "text").mapInArrow(sets, "rep long, shingles binary"))


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= PERCENT * (len(x) + len(y) - both)


def confirm(pairs: DataFrame, texts: tuple[DataFrame, DataFrame], shingle: int = SHINGLE) -> DataFrame:
    """Those pairs (a, b) whose full sets reach the similarity; each set travels once for each of its pairs."""
    ends = common.stash(pairs.select(F.col("a").alias("rep")).unionAll(pairs.select(F.col("b").alias("rep"))).distinct())
    full = full_sets(ends, texts, shingle)

    def check(batches):
        for b in batches:
            out = ([], [])
            for a, c, x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), views(b.column(2)), views(b.column(3))):
                if similar(x, y):
                    out[0].append(a)
                    out[1].append(c)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["a", "b"])

    one = full.select(F.col("rep").alias("a"), F.col("shingles").alias("set_a"))
    two = full.select(F.col("rep").alias("b"), F.col("shingles").alias("set_b"))
    return common.stash(pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "set_a", "set_b").mapInArrow(check, "a long, b long").distinct())


def confirm_crowds(crowds: DataFrame, classes: DataFrame, placed: DataFrame, texts: tuple[DataFrame, DataFrame], shingle: int = SHINGLE) -> DataFrame:
    """Links (a, b) between components, of crowds (near, rep, apart): each apart against all of its near, on full sets.

    The sets of those apart go together in blocks, and each other set travels once for each block. A task returns links
    that join components within it, no more than there are classes; components() has the rest from these.
    """
    rows = crowds.join(placed, "rep").join(classes.select("rep", (8 * F.col("n")).alias("bytes")), "rep")
    size = rows.groupBy("near").agg(F.ceil(F.sum(F.when(F.col("apart"), F.col("bytes"))) / BLOCK_BYTES).cast("int").alias("blocks"), F.ceil(F.sum("bytes") / BLOCK_BYTES).cast("int").alias("parts"))
    rows = common.stash(rows.join(common.stash(size.where("blocks > 0")), "near"))
    full = full_sets(rows.select("rep").distinct(), texts, shingle).dropDuplicates(["rep"])
    rows = common.stash(rows.join(full, "rep").select("near", "rep", "component", "apart", "shingles", "blocks", "parts"))
    block_of, part_of = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"), F.pmod(F.xxhash64("rep", F.lit(1)), F.col("parts")).cast("int")
    left = rows.where("apart").select("near", block_of.alias("block"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "rep", "component", "shingles")
    right = rows.select("near", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), part_of.alias("part"), "rep", "component", "shingles")

    def check(left: pa.Table, right: pa.Table) -> pa.Table:
        out = ([], [])
        if left.num_rows and right.num_rows:
            x, cx = left.column("rep").to_pylist(), left.column("component").to_pylist()
            sets = views(left.column("shingles"))
            size = np.fromiter(map(len, sets), np.int64, len(sets))
            flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            up: dict[int, int] = {}

            def top(c: int) -> int:
                while c in up:
                    c = up[c]
                return c

            for y, cy, s in zip(right.column("rep").to_pylist(), right.column("component").to_pylist(), views(right.column("shingles"))):
                lo, hi = np.searchsorted(flat, s, "left"), np.searchsorted(flat, s, "right")
                n = hi - lo
                at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                both = np.bincount(owner[at], minlength=len(sets))
                for i in np.flatnonzero(100 * both >= PERCENT * (size + len(s) - both)).tolist():
                    p, q = top(cx[i]), top(cy)
                    if p != q:
                        up[p] = q
                        out[0].append(min(x[i], y))
                        out[1].append(max(x[i], y))
        return pa.table({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64())})

    key = ["near", "block", "part"]
    return common.stash(left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(check, "a long, b long"))


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (rep, component) after their components are linked by links (a, b) of reps."""
    at = lambda end, name: labels.select(F.col("rep").alias(end), F.col("component").alias(name))
    edges = common.stash(links.join(at("a", "ca"), "a").join(at("b", "cb"), "b").where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct())
    if edges.isEmpty():
        return labels
    least = components(edges).select(F.col("node").alias("component"), F.col("component").alias("least"))
    return common.stash(labels.join(least, "component", "left").select("rep", F.coalesce("least", "component").alias("component")))


def between(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs (a, b, agree) whose ends are in two components, with these (ca, cb)."""
    at = lambda end, name: labels.select(F.col("rep").alias(end), F.col("component").alias(name))
    return common.stash(pairs.join(at("a", "ca"), "a").join(at("b", "cb"), "b").where("ca <> cb"))


def groups(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_shingles, component_id, kept."""
    docs = docs.select("doc_id", "text")
    told = common.stash(describe(docs, shingle))
    key = ["n_shingles", "s1", "s2"]
    real = told.where("n_shingles > 0 and doc_id is not null")
    whole = real.groupBy(*key).agg(F.min(F.struct("doc_id", "text_key")).alias("one"), F.max("heads").alias("heads"), F.max("sketch").alias("sketch"))
    # Numbers of their own, as rows with one doc_id may stand in several classes; written, so that they stay.
    all_ = common.stash(whole.select(F.monotonically_increasing_id().alias("rep"), *key, "one.*", "heads", "sketch"))
    classes = all_.select("rep", F.col("n_shingles").alias("n"), "heads", "sketch")
    texts = docs.withColumn("text_key", F.xxhash64("text")), all_.select("rep", "doc_id", "text_key")
    # A doc_id with rows of different sets links their classes.
    many = real.select("doc_id", *key).distinct().groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    held = common.stash(real.join(many, "doc_id", "left_semi").select("doc_id", *key).distinct().join(all_.select("rep", *key), key).select("doc_id", "rep"))
    shared = held.join(held.groupBy("doc_id").agg(F.min("rep").alias("a")), "doc_id").select("a", F.col("rep").alias("b")).where("a <> b")

    pairs, crowded = candidates(classes)
    # First each class with the most similar of the earlier ones, then what is not in one component yet.
    first = pairs.groupBy("b").agg(F.max(F.struct("agree", (-F.col("a")).alias("less"))).alias("best")).select((-F.col("best.less")).alias("a"), "b")
    tree = components(confirm(first, texts, shingle)).withColumnRenamed("node", "rep")
    labels = common.stash(classes.select("rep").join(tree, "rep", "left").select("rep", F.coalesce("component", "rep").alias("component")))
    links, left = shared, between(pairs, labels)
    if not left.isEmpty():
        links = links.unionAll(confirm(left, texts, shingle))
    labels = joined(labels, links)
    if late := apart(crowded, classes, labels):
        pairs, crowds = late
        links = confirm_crowds(crowds, classes, labels, texts, shingle)
        labels = joined(labels, links if pairs.isEmpty() else links.unionAll(confirm(pairs, texts, shingle)))
    named = labels.join(all_.select("rep", *key, "doc_id"), "rep")
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_key = common.stash(named.join(least, "component").select(*key, "component_id"))
    out = told.select("doc_id", *key).join(of_key, key, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(common.table(spark, sf_dir, "documents"))
