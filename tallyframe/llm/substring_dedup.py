"""Exact substring dedup by relative Lempel-Ziv parsing against an index of reference blocks.

A window is WINDOW consecutive words; a word goes if a window over it begins anywhere else too. Every window has an
anchor, the run of ANCHOR words in it with the smallest hash (the first of equals), so equal windows have equal anchors
at the same place. A maximal row of windows with one anchor, and all words they cover, is a reference block.

1. Index: anchors are counted over all documents; those met twice or more can be referred to. Blocks of such an anchor
   that are equal as a whole are duplicate spans; the commonest block of an anchor is its reference block.
2. Parse: where the blocks of an anchor are not all equal, each is factored against the reference block: from the anchor
   the factor is extended greedily, word by word, to the left and to the right. A factor of WINDOW words or more is a
   duplicate span, in the document and in the reference.
3. Boundaries: a factor ends where its document leaves the reference. Windows across its ends, and only these, are
   compared with those of the anchor's other blocks, each of which is a reference to the others.

A window that equals one of the reference holds the anchor at the same place, so it is inside of the factor; one that
equals a window of another block is across the ends of both factors. So the parse is exact, but for the hashes of words,
of 62 bits, of blocks and of windows, of over 90 bits. The two broadcasts are bit maps of fixed size that only skip
work: where they are full, more rows are compared, with the same result.

Edge cases: a null or empty text has no words; a text of under WINDOW words keeps all; a text may repeat itself; texts
of any length are parsed whole; repeated rows are copies of each other, so that both lose their windows; a null doc_id
is a value like any other; further columns are kept by dedup(); an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.llm import common

WINDOW, ANCHOR = 35, 8
#: Bits of the maps, as a power of two: 16 MB each.
MAP_BITS = 27
#: Words of a map that are gathered as one byte string.
PIECE = 1 << 13
SLICE = 2 << 20
KEY = ["doc_id", "text_key"]
#: Columns that dedup() adds.
NEW = ("n_words", "n_removed", "kept_sha256")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id and text with a key of the text, so that rows that share a doc_id only are kept apart."""
    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")


def cut_blocks(docs: list[bytes], window: int, anchor: int):
    """All blocks of the documents: document, first window (from the document's start), windows, anchor hash, block hash,
    and the anchor's place in the block; and the hashes of all words with the documents' bounds."""
    words, bounds = common.word_hashes(docs)
    n, span = len(words), window - anchor + 1
    none = np.zeros(0, np.int64)
    if n < window:
        return none, none, none, none.view(np.uint64), none.view(np.uint64), none, words, bounds
    least = common.window_hashes(words, anchor)
    where = np.arange(len(least))

    def joined(off: int):
        a, b = least[:-off], least[off:]
        right = b < a
        return np.where(right, b, a), np.where(right, where[off:], where[:-off])

    all_anchors, size = least, 1
    while size * 2 <= span:
        least, where = joined(size)
        size *= 2
    if span > size:
        least, where = joined(span - size)
    doc_of = np.repeat(np.arange(len(docs)), np.diff(bounds))
    starts = np.flatnonzero(np.arange(n) + window <= bounds[1:][doc_of])
    if not len(starts):
        return none, none, none, none.view(np.uint64), none.view(np.uint64), none, words, bounds
    at = where[starts]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    lo, count = starts[first], np.diff(np.concatenate([first, [len(starts)]]))
    length = count + window - 1
    inverse = pow(common.R_WORD, -1, 1 << 64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * common.powers(inverse, n), dtype=np.uint64)])
    block = common.mix((total[lo + length] - total[lo]) * common.powers(common.R_WORD, n)[lo + length - 1] + length.astype(np.uint64))
    doc = doc_of[lo]
    return doc, lo - bounds[doc], count, all_anchors[at[first]], block, at[first] - lo, words, bounds


def slot(x: np.ndarray) -> np.ndarray:
    """Where a hash stands in a map."""
    return (common.mix(x.view(np.uint64)) >> np.uint64(64 - MAP_BITS)).astype(np.int64)


def occurrence(doc_id: np.ndarray, text_key: np.ndarray, lo: np.ndarray) -> np.ndarray:
    return common.mix(common.mix(doc_id.view(np.uint64)) ^ text_key.view(np.uint64)) + lo.astype(np.uint64)


def bit_map(df: DataFrame, value) -> np.ndarray:
    """A map of the numbers `value(batch)` of df's rows: at most 2**MAP_BITS / 64 words come to the driver."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                s = np.unique(slot(value(b)))
                yield pa.RecordBatch.from_arrays([pa.array(s >> 6), pa.array(s & 63)], ["word", "bit"])

    words = df.mapInArrow(run, "word long, bit long").groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, cast(bit as int))")).alias("bits"))

    def pack(t: pa.Table) -> pa.Table:
        piece = np.zeros(PIECE, np.int64)
        word = t.column("word").to_numpy()
        piece[word % PIECE] = t.column("bits").to_numpy()
        return pa.table({"piece": pa.array([int(word[0]) // PIECE], pa.int64()), "data": pa.array([piece.tobytes()], pa.binary())})

    # Pieces of the map are put together on executors: the driver gets a few hundred byte strings, not millions of rows.
    pieces = words.withColumn("piece", F.floor(F.col("word") / PIECE)).groupBy("piece").applyInArrow(pack, "piece long, data binary")
    out = np.zeros(1 << (MAP_BITS - 6), np.int64)
    for r in pieces.toLocalIterator():
        out[r.piece * PIECE : (r.piece + 1) * PIECE] = np.frombuffer(r.data, np.int64)
    return out


def marked(bits: np.ndarray, x: np.ndarray) -> np.ndarray:
    s = slot(x)
    return (bits[s >> 6] >> (s & 63)) & 1 == 1


def numbers(b: pa.RecordBatch, i: int) -> np.ndarray:
    return np.asarray(pa.compute.fill_null(b.column(i), 0)).astype(np.int64)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def spans(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """Duplicate spans (doc_id, text_key, lo, hi): words lo to hi of the document, hi not included."""
    spark = docs.sparkSession

    def anchors(batches):
        common.no_tool()
        for b in common.slices(batches, most=SLICE):
            _, _, _, h, *_ = cut_blocks(common.blobs(b), window, anchor)
            yield pa.RecordBatch.from_arrays([signed(h)], ["anchor"])

    met = docs.select("text").mapInArrow(anchors, "anchor long").groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    index = spark.sparkContext.broadcast(bit_map(met.select("anchor"), lambda b: numbers(b, 0)))

    def parse(batches):
        common.no_tool()
        for b in common.slices(batches, most=SLICE):
            doc, lo, count, h, block, *_ = cut_blocks(common.blobs(b), window, anchor)
            keep = marked(index.value, h)
            doc = doc[keep]
            columns = [b.column(0).take(pa.array(doc)), b.column(1).take(pa.array(doc)), pa.array(lo[keep].astype(np.int32)), pa.array(count[keep].astype(np.int32)), signed(h[keep]), signed(block[keep])]
            yield pa.RecordBatch.from_arrays(columns, [*KEY, "lo", "n_windows", "anchor", "block"])

    rows = keyed(docs)
    parsed = common.stash(rows.mapInArrow(parse, "doc_id long, text_key long, lo int, n_windows int, anchor long, block long"))
    blocks = parsed.groupBy("anchor", "block").agg(F.count("*").alias("copies"), F.min(F.struct(*KEY, "lo")).alias("one"))
    blocks = common.stash(blocks)
    # Written before the join, so that both its sides are plain tables and a hot anchor's blocks can be split.
    kinds = blocks.groupBy("anchor").agg(F.sum("copies").alias("all_copies"), F.min("copies").alias("fewest"), F.max(F.struct("copies", "block")).alias("most"))
    kinds = common.stash(kinds.where(F.col("all_copies") > 1).select("anchor", "fewest", F.col("most.block").alias("ref_block")))
    known = common.stash(blocks.join(kinds, "anchor").select("anchor", "block", "copies", "fewest", "one"))
    # Blocks that have an equal: the whole factor is a span.
    equal = known.where(F.col("copies") > 1).select("anchor", "block")
    whole = parsed.join(equal, ["anchor", "block"]).select(*KEY, "lo", (F.col("lo") + F.col("n_windows") + (window - 1)).alias("hi"))
    # One copy of each block whose anchor also has a block without an equal.
    open_blocks = known.where(F.col("fewest") == 1).select("one.*")
    chosen = spark.sparkContext.broadcast(bit_map(open_blocks, lambda b: occurrence(numbers(b, 0), numbers(b, 1), numbers(b, 2)).view(np.int64)))

    def fetch(batches):
        common.no_tool()
        for b in common.slices(batches, most=SLICE):
            doc, lo, count, h, block, place, words, bounds = cut_blocks(common.blobs(b), window, anchor)
            keep = marked(index.value, h)
            keep[keep] = marked(chosen.value, occurrence(numbers(b, 0)[doc[keep]], numbers(b, 1)[doc[keep]], lo[keep]))
            doc, lo, count = doc[keep], lo[keep], count[keep]
            some, at = pa.array(doc), bounds[doc] + lo
            held = [words[i : i + n].tobytes() for i, n in zip(at.tolist(), (count + window - 1).tolist())]
            columns = [signed(h[keep]), signed(block[keep]), b.column(0).take(some), b.column(1).take(some), pa.array(lo.astype(np.int32)), pa.array(place[keep].astype(np.int32)), pa.array(held, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["anchor", "block", *KEY, "lo", "place", "words"])

    held = common.stash(rows.mapInArrow(fetch, "anchor long, block long, doc_id long, text_key long, lo int, place int, words binary"))
    heads = kinds.where(F.col("fewest") == 1).select("anchor", F.col("ref_block").alias("block"))
    refs = common.stash(held.join(heads, ["anchor", "block"]).dropDuplicates(["anchor"]).select("anchor", *[F.col(c).alias(f"ref_{c}") for c in ("block", *KEY, "lo", "place", "words")]))
    pairs = held.join(refs, "anchor").where("block <> ref_block")
    found = common.stash(factored(pairs, window))
    twice = common.stash(found.where("w1 is not null").groupBy("w1", "w2").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("w1", "w2"))
    some = found.join(twice, ["w1", "w2"]).select(*KEY, "lo", "hi")
    return whole.unionAll(found.where("w1 is null").select(*KEY, "lo", "hi")).unionAll(some)


def leading(a: np.ndarray, at: np.ndarray, b: np.ndarray, bt: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
    """How many values agree, most at most, of a from at and b from bt on, in steps of 1 or -1."""
    out = np.zeros(len(most), np.int64)
    full = np.flatnonzero(most > 0)
    if len(full):
        n = most[full]
        first = np.cumsum(n) - n
        k = np.arange(int(n.sum())) - np.repeat(first, n)
        differ = a[np.repeat(at[full], n) + step * k] != b[np.repeat(bt[full], n) + step * k]
        out[full] = np.minimum.reduceat(np.where(differ, k, np.repeat(n, n)), first)
    return out


def factored(pairs: DataFrame, window: int) -> DataFrame:
    """(doc_id, text_key, lo, hi, w1, w2) of blocks beside their reference blocks (ref_): duplicate spans of both with null
    w1, and the windows outside of each block's factor with their hashes."""

    def run(batches):
        common.no_tool()
        for b in batches:
            if not b.num_rows:
                continue
            c = {f.name: b.column(i) for i, f in enumerate(b.schema)}
            of = lambda name: np.asarray(c[name]).astype(np.int64)  # noqa: E731, B023
            x, y = ([np.frombuffer(v, np.uint64) for v in c[n].to_pylist()] for n in ("words", "ref_words"))  # noqa: B023
            n, m = (np.fromiter(map(len, v), np.int64, len(v)) for v in (x, y))
            x, y = np.concatenate(x), np.concatenate(y)
            at, bt, p, q = np.cumsum(n) - n, np.cumsum(m) - m, of("place"), of("ref_place")
            left = leading(x, at + p - 1, y, bt + q - 1, np.minimum(p, q), -1)
            right = leading(x, at + p, y, bt + q, np.minimum(n - p, m - q), 1)
            lo, hi = p - left, p + right  # the factor's ends in the block
            long = hi - lo >= window
            lo, hi = np.where(long, lo, 0), np.where(long, hi, 0)
            count = n - window + 1
            row = np.repeat(np.arange(len(n)), count)
            start = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            out = ~((start >= lo[row]) & (start + window <= hi[row]))
            row, start = row[out], start[out]
            one, two = (common.rolling_hashes(x, window, base)[at[row] + start] if len(row) else np.zeros(0, np.uint64) for base in (common.R_WORD, common.R_WORD2))
            spans_of = np.flatnonzero(long)
            take = pa.array(np.concatenate([spans_of, row]))
            w1 = pa.array(np.concatenate([np.zeros(len(spans_of), np.int64), one.view(np.int64)]), mask=np.arange(len(take)) < len(spans_of))
            w2 = pa.array(np.concatenate([np.zeros(len(spans_of), np.int32), (two >> np.uint64(32)).astype(np.uint32).view(np.int32)]))
            begin = of("lo")[np.asarray(take)] + np.concatenate([lo[spans_of], start])
            end = of("lo")[np.asarray(take)] + np.concatenate([hi[spans_of], start + window])
            yield pa.RecordBatch.from_arrays([c["doc_id"].take(take), c["text_key"].take(take), pa.array(begin.astype(np.int32)), pa.array(end.astype(np.int32)), w1, w2], names)
            # The same factors, where the reference has them; equal ones once.
            shift = of("ref_lo") + q - p
            same = pa.table([c["ref_doc_id"].take(pa.array(spans_of)), c["ref_text_key"].take(pa.array(spans_of)), pa.array((shift + lo)[spans_of].astype(np.int32)), pa.array((shift + hi)[spans_of].astype(np.int32))], names[:4])
            for part in same.group_by(names[:4]).aggregate([]).to_batches():
                none = [pa.nulls(part.num_rows, pa.int64()), pa.nulls(part.num_rows, pa.int32())]
                yield pa.RecordBatch.from_arrays([*[part.column(part.schema.get_field_index(k)) for k in names[:4]], *none], names)

    names = [*KEY, "lo", "hi", "w1", "w2"]
    return pairs.select("doc_id", "text_key", "lo", "place", "words", "ref_doc_id", "ref_text_key", "ref_lo", "ref_place", "ref_words").mapInArrow(run, "doc_id long, text_key long, lo int, hi int, w1 long, w2 int")


def covered(lo: np.ndarray, hi: np.ndarray, n: int) -> np.ndarray:
    """Which of n words the spans cover."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, lo, 1)
    np.add.at(edge, hi, -1)
    return np.cumsum(edge[:n]) > 0


def dedup(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, keep_text: bool = True) -> DataFrame:
    """docs with its duplicate windows' words taken out of text, and n_words, n_removed and kept_sha256.

    Rows that lose nothing keep their text as it is; in others kept words are joined by one space. Columns of docs
    named like the new ones are replaced; keep_text=False leaves out all but doc_id and the new ones.
    """
    kept = [f for f in docs.schema.fields if f.name.lower() not in NEW and (keep_text or f.name in ("doc_id", "text"))]
    docs = docs.select([f"`{f.name}`" for f in kept])
    found = spans(docs, window, anchor).groupBy(*KEY).agg(F.collect_set(F.struct("lo", "hi")).alias("found_spans"))
    found = found.select(F.col("doc_id").alias("found_id"), F.col("text_key").alias("found_key"), F.transform("found_spans", lambda s: s["lo"]).alias("found_lo"), F.transform("found_spans", lambda s: s["hi"]).alias("found_hi"))
    joined = docs.join(found, docs["doc_id"].eqNullSafe(F.col("found_id")) & (F.xxhash64(docs["text"]) == F.col("found_key")), "left").drop("found_id", "found_key")
    out = [f for f in kept if keep_text or f.name == "doc_id"]
    schema = T.StructType([*out, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())])
    text_at = [f.name for f in kept].index("text")

    def run(batches):
        common.no_tool()
        for b in common.slices(batches):
            n_words, n_removed, digests, texts = [], [], [], []
            lows, highs = b.column(b.num_columns - 2), b.column(b.num_columns - 1)
            for i, blob in enumerate(common.blobs(b)):
                words = blob.split()
                n_words.append(len(words))
                if not lows[i].is_valid:
                    n_removed.append(0)
                    left = b" ".join(words)
                    texts.append(None)
                else:
                    gone = covered(np.asarray(lows[i].values), np.asarray(highs[i].values), len(words))
                    left = b" ".join([w for w, x in zip(words, gone.tolist()) if not x])
                    n_removed.append(int(gone.sum()))
                    texts.append(left.decode())
                digests.append(hashlib.sha256(left).hexdigest())
            columns = [*b.columns[:-2]]
            if keep_text:
                columns[text_at] = pa.array([t if t is not None else o for t, o in zip(texts, b.column(text_at).to_pylist())], pa.string())
            else:
                columns = [b.column(b.schema.get_field_index("doc_id"))]
            columns += [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in schema.fields])

    return joined.mapInArrow(run, schema)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(common.table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
