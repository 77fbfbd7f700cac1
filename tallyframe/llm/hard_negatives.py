"""Hard-negative mining: branch and bound over ball trees, a tree for each part of the rows.

Rows are dealt into parts of about PART rows: a label with many rows has parts of its own, by hash of vec_id, labels with
few rows share parts. Each part becomes a ball tree: nodes are ranges of its rows with a centre, a radius and the label
of all their rows, if they share one. The inner product of a query with any row of a ball lies within |query| * radius
of that with the centre, so a node is pruned where even its upper bound is below the score window or strictly below
the query's current kth score, where its lower bound is above the window, and where its label rules it out.

Two searches use it. The first finds each anchor's POSITIVES best rows of its own label; their scores give the windows in
which the second looks for the NEGATIVES best rows of other labels. Anchors go out in chunks of CHUNK bytes, each against
all trees; trees are searched in rounds, a few of each label first, and later rounds start from the kth scores found so
far: what a round returns beyond them is small, and the sum over rounds grows with the logarithm of the number of parts.
Scores are whole numbers and exact; ties go to the smaller vec_id.

Edge cases: rows without label or vec_id, whose vector is null, empty or has an entry that is null or not finite, take no
part, nor do rows whose length is not the commonest (the longer of two as common). Of rows with one vec_id that with the
smallest (label, vector) takes part. Entries are held within 2**26. An anchor without other rows of its label, or whose
positives have negative scores, has no rows in the result; fewer positives or negatives than asked for give fewer rows.
Further columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.llm import common, vectors

SCALE, HELD = 256, 2**26
POSITIVES = NEGATIVES = 5
#: The score of a negative lies between LEAST / 100 of its positive's and the positive's.
LEAST = 80
#: Rows of a part, and of a leaf of its tree.
PART, LEAF = 2048, 64
#: Bytes of anchors' vectors that are sent to all tasks at once, and anchors that descend a tree together.
CHUNK, TOGETHER = 8 << 20, 512
#: A round searches so many times the parts of all before it.
GROWTH, FIRST = 8, 8
#: Labels with parts of their own that are sent to all tasks; more are joined by shuffle.
SENT_LABELS = 1_000_000
NONE = -(2**62)


def prepared(embeddings: DataFrame, label: Column) -> tuple[DataFrame, int]:
    """Rows that take part: vec_id, label, v (bytes of 32-bit integers), and the length of their vectors."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    rows = vectors.usable(rows, "v").where("vec_id is not null and label is not null")
    k = vectors.usual_length([tuple(r) for r in rows.groupBy(F.size("v")).count().collect()])
    floors = F.transform("v", lambda x: F.greatest(F.least(F.floor(F.greatest(F.least(x * SCALE, F.lit(float(HELD))), F.lit(-float(HELD)))), F.lit(HELD)), F.lit(-HELD)).cast("int"))
    rows = rows.where(F.size("v") == k).select("vec_id", "label", floors.alias("v"))
    one = rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r"))
    return common.stash(one.select("vec_id", "r.label", "r.v")), k


def parted(rows: DataFrame) -> DataFrame:
    """rows with own (the label that all rows of the part share, else null) and part, a number within it."""
    counts = rows.groupBy("label").agg(F.count("*").alias("rows"))
    large = counts.where(F.col("rows") >= PART // 4).select("label", F.ceil(F.col("rows") / PART).alias("parts"))
    large = common.cut(large)
    if large.count() <= SENT_LABELS:
        large = F.broadcast(large)
    few = rows.join(large, "label", "left_anti").count()
    told = rows.join(large, "label", "left")
    hashed = F.xxhash64("vec_id")
    shared = F.pmod(F.xxhash64("label"), F.lit(max(1, -(-few // PART))))
    return told.select("vec_id", rows["label"], "v", F.when(F.col("parts").isNotNull(), rows["label"]).alias("own"), F.when(F.col("parts").isNotNull(), F.pmod(hashed, F.col("parts"))).otherwise(shared).alias("part"))


class Tree:
    """A ball tree over rows (n, k) of whole numbers; nodes in preorder."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, leaf: int = LEAF):
        order, nodes = np.arange(len(ids)), []
        real = rows.astype(np.float64)

        def build(start: int, end: int) -> int:
            at = len(nodes)
            own = real[order[start:end]]
            centre = own.mean(axis=0)
            radius = float(np.sqrt(((own - centre) ** 2).sum(axis=1).max()))
            told = labels[order[start:end]]
            same = bool((told == told[0]).all())
            nodes.append([start, end, -1, -1, centre, radius, same, told[0]])
            if end - start > leaf and radius > 0:
                # Split at the median along the line between two rows that lie far apart.
                a = own[((own - centre) ** 2).sum(axis=1).argmax()]
                b = own[((own - a) ** 2).sum(axis=1).argmax()]
                along, half = own @ (b - a), (end - start) // 2
                order[start:end] = order[start:end][np.argsort(along, kind="stable")]
                nodes[at][2] = build(start, start + half)
                nodes[at][3] = build(start + half, end)
            return at

        build(0, len(ids))
        self.ids, self.labels, self.rows = ids[order], labels[order], rows[order]
        start, end, left, right, centres, radii, same, told = zip(*nodes)
        self.spans = np.array([start, end, left, right], np.int32)
        self.centres, self.radii = np.array(centres), np.array(radii)
        self.same, self.told = np.array(same, np.int8), np.array(told, np.int64)

    PARTS = (("ids", np.int64), ("labels", np.int64), ("rows", np.int32), ("spans", np.int32), ("centres", np.float64), ("radii", np.float64), ("same", np.int8), ("told", np.int64))
    SCHEMA = ", ".join(f"{n} binary" for n, _ in PARTS)

    def dump(self) -> list[bytes]:
        return [np.ascontiguousarray(getattr(self, n), t).tobytes() for n, t in self.PARTS]

    @classmethod
    def load(cls, values: list[bytes], k: int) -> Tree:
        t = cls.__new__(cls)
        for (n, kind), b in zip(cls.PARTS, values):
            setattr(t, n, np.frombuffer(b, kind))
        t.rows, t.centres, t.spans = t.rows.reshape(-1, k), t.centres.reshape(-1, k), t.spans.reshape(4, -1)
        return t


def built(k: int):
    def run(key, table):
        ids = table.column("vec_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        rows = np.asarray(table.column("v").combine_chunks().flatten(), np.int32).reshape(-1, k)
        tree = Tree(ids[order], table.column("label").to_numpy()[order], rows[order])
        own, part = key[0].as_py(), key[1].as_py()
        return pa.table([[own], [part], [round_of(part)], *[[x] for x in tree.dump()]], names=["own", "part", "round", *[n for n, _ in Tree.PARTS]]).cast(pa.schema([("own", pa.int64()), ("part", pa.int64()), ("round", pa.int32()), *[(n, pa.binary()) for n, _ in Tree.PARTS]]))

    return run


def round_of(part: int) -> int:
    k, most = 0, FIRST
    while part >= most:
        k, most = k + 1, most * GROWTH
    return k


def trees(rows: DataFrame, k: int) -> DataFrame:
    """A row for each part: own, part, round and its tree. Parts have a counted size, so a task holds one of about PART rows."""
    return common.stash(parted(rows).groupBy("own", "part").applyInArrow(built(k), f"own long, part long, round int, {Tree.SCHEMA}"))


class Best:
    """The k best (score, id) of every slot (query and window), with each slot's kth score so far."""

    def __init__(self, kth: np.ndarray, k: int):
        self.kth, self.k = kth.copy(), k
        self.slot, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, slot: np.ndarray, score: np.ndarray, id_: np.ndarray) -> None:
        if not len(slot):
            return
        touched = np.zeros(len(self.kth), bool)
        touched[slot] = True
        again = touched[self.slot]
        s, v, i = np.concatenate([self.slot[again], slot]), np.concatenate([self.score[again], score]), np.concatenate([self.id[again], id_])
        order = np.lexsort((i, -v, s))
        s, v, i = s[order], v[order], i[order]
        first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        place = np.arange(len(s)) - np.repeat(first, np.diff(np.r_[first, len(s)]))
        kth = place == self.k - 1
        self.kth[s[kth]] = np.maximum(self.kth[s[kth]], v[kth])
        some = place < self.k
        self.slot, self.score, self.id = np.concatenate([self.slot[~again], s[some]]), np.concatenate([self.score[~again], v[some]]), np.concatenate([self.id[~again], i[some]])


def search(tree: Tree, ids, labels, queries, low, high, kth, same: bool, k: int) -> Best:
    """Best rows of the tree for each query and window: low, high and kth are (queries, windows), same: of its own label.

    A window with low above high is none. kth are scores that k rows elsewhere reach.
    """
    w = low.shape[1]
    best = Best(kth.ravel(), k)
    norms = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1))
    size = int(np.abs(queries).max(initial=0)) * int(np.abs(tree.rows).max(initial=0)) * queries.shape[1]
    q = queries.astype(np.float64)
    rows = tree.rows.astype(np.float64 if size < 2**53 else np.int64)
    asked = queries.astype(rows.dtype)
    real_low, real_high = low.astype(np.float64), high.astype(np.float64)
    middle = q @ tree.centres.T
    reach = norms[:, None] * tree.radii[None, :]
    slack = 1e-9 * (norms[:, None] * (np.sqrt((tree.centres**2).sum(axis=1)) + tree.radii)[None, :]) + 1e-6
    upper, lower = middle + reach + slack, middle - reach - slack

    def open_(node: int, active: np.ndarray) -> np.ndarray:
        if tree.same[node]:
            active = active[(labels[active] == tree.told[node]) == same]
        up, down = upper[active, node][:, None], lower[active, node][:, None]
        now = best.kth.reshape(-1, w)[active]
        fits = (up >= real_low[active]) & (down <= real_high[active]) & (low[active] <= high[active]) & (np.minimum(up, real_high[active]) >= now)
        return active[fits.any(axis=1)]

    todo = [(0, np.arange(len(ids)))]
    while todo:
        node, active = todo.pop()
        active = open_(node, active)
        if not len(active):
            continue
        start, end, left, right = tree.spans[:, node].tolist()
        if left >= 0:
            # The child that promises more on the whole is looked at first.
            near, far = (left, right) if upper[active, left].sum() >= upper[active, right].sum() else (right, left)
            todo += [(far, active), (near, active)]
            continue
        scores = (asked[active] @ rows[start:end].T).astype(np.int64)
        fit = (labels[active][:, None] == tree.labels[None, start:end]) == same
        fit &= ids[active][:, None] != tree.ids[None, start:end]
        for x in range(w):
            hit = fit & (scores >= np.maximum(low[active, x], best.kth.reshape(-1, w)[active, x])[:, None]) & (scores <= high[active, x][:, None])
            a, b = np.nonzero(hit)
            best.add(active[a] * w + x, scores[a, b], tree.ids[start:end][b])
    return best


FOUND = "anchor_id long, slot int, id long, score long"


def searched(chunk, same: bool, k: int):
    """Batches of trees to the best rows of each anchor and window in each; the chunk: (ids, labels, vectors, low, high, kth), broadcast."""

    def run(batches):
        ids, labels, told, low, high, kth = chunk.value
        for b in batches:
            for r in range(b.num_rows):
                tree = Tree.load([b.column(n)[r].as_buffer() for n, _ in Tree.PARTS], told.shape[1])
                for at in range(0, len(ids), TOGETHER):
                    cut = slice(at, at + TOGETHER)
                    best = search(tree, ids[cut], labels[cut], told[cut], low[cut], high[cut], kth[cut], same, k)
                    if len(best.slot):
                        w = low.shape[1]
                        yield pa.RecordBatch.from_arrays([pa.array(ids[cut][best.slot // w]), pa.array((best.slot % w).astype(np.int32)), pa.array(best.id), pa.array(best.score)], names=["anchor_id", "slot", "id", "score"])

    return run


def top(found: DataFrame, k: int) -> DataFrame:
    """found with rank, the k best of each anchor and window."""
    order = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rounds_over(forest: DataFrame, rounds: list[int], ids, labels, told, low, high, same: bool, k: int) -> DataFrame:
    """The k best rows for each anchor of a chunk and each of its windows, over all trees (anchor_id, slot, id, score, rank)."""
    spark, kth = forest.sparkSession, np.full(low.shape, NONE, np.int64)
    place, out = {a: i for i, a in enumerate(ids.tolist())}, None
    for n in rounds:
        sent = spark.sparkContext.broadcast((ids, labels, told, low, high, kth))
        got = forest.where(F.col("round") == n).mapInArrow(searched(sent, same, k), FOUND)
        out = common.stash(top(got if out is None else out.unionByName(got), k).drop("rank"))
        if n != rounds[-1]:
            for r in out.groupBy("anchor_id", "slot").agg(F.count("*").alias("n"), F.min("score").alias("kth")).where(F.col("n") == k).collect():  # of a chunk's anchors
                kth[place[r["anchor_id"]], r["slot"]] = r["kth"]
        sent.unpersist()
    return top(out, k)


def chunks(anchors: DataFrame, k: int):
    """Anchors in pieces of CHUNK bytes: ids, labels, vectors; the driver asks for one partition at a time, of about a chunk."""
    most, rows = max(1, CHUNK // (4 * k)), []
    for r in anchors.repartition(max(1, -(-anchors.count() // most)), "vec_id").toLocalIterator():
        rows.append((r["vec_id"], r["label"], np.array(r["v"], np.int32)))
        if len(rows) == most:
            yield tuple(map(np.array, zip(*rows)))
            rows = []
    if rows:
        yield tuple(map(np.array, zip(*rows)))


MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(embeddings: DataFrame, anchors: Column, label: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """Hard negatives of the rows for which `anchors` (of vec_id) holds: see MINED; label: an expression of the columns."""
    spark = embeddings.sparkSession
    rows, k = prepared(embeddings, F.col("label") if label is None else label)
    out = spark.createDataFrame([], MINED)
    if not k:
        return out
    forest = trees(rows, k)
    rounds = sorted(r["round"] for r in forest.select("round").distinct().collect())
    parts = []
    for ids, labels, told in chunks(rows.where(anchors), k):
        n = len(ids)
        any_ = np.full((n, 1), NONE, np.int64), np.full((n, 1), -NONE, np.int64)
        mine_ = rounds_over(forest, rounds, ids, labels, told, *any_, True, positives)
        mine_ = common.stash(mine_.select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), (F.col("rank") - 1).alias("slot")))
        low, high = np.full((n, positives), 1, np.int64), np.zeros((n, positives), np.int64)
        place = {a: i for i, a in enumerate(ids.tolist())}
        for r in mine_.collect():  # of a chunk's anchors
            s, at = r["positive_score"], (place[r["anchor_id"]], r["slot"])
            if s >= 0:
                low[at], high[at] = -(-LEAST * s // 100), s
        wrong = rounds_over(forest, rounds, ids, labels, told, low, high, False, negatives)
        wrong = wrong.select("anchor_id", "slot", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
        parts.append(common.stash(wrong.join(mine_, ["anchor_id", "slot"]).select(*out.columns)))
    for p in parts:
        out = out.unionByName(p)
    return out


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


ORACLE_SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.id) QUALIFY row_number() OVER w <= 5
"""
