"""Token ids in Simple-8b files.

File format (version 1). A store is a folder of Parquet files, so that Spark's committer makes each task's output
whole or absent on any shared file system. One row is a segment: consecutive documents of a shard in ascending doc_id
order. Columns: shard (ascending ranges of doc_id), start (ids of the shard before the segment), doc_ids, doc_lens, and
payload, little-endian:

    magic b"S8B1" | u32 ids in the segment | u32 blocks | u32 words of each block | the blocks' 64-bit words

A block holds BLOCK ids (the last one what is left) and decodes by itself. The upper 4 bits of a word select how its 60
lower bits are packed: COUNTS ids of BITS bits each, lowest first. Selector 15 is the escape: the next word is one raw
id of up to 64 bits. Selectors 0 and 1 are runs of 240 and 120 zeros.

Edge cases: a null or empty text has only its end id; a document longer than a segment is a segment of its own; rows
with equal doc_id are ordered by text; a null doc_id comes first; further columns are ignored; an empty table gives an
empty table.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.llm import common

#: Fixed values of the format: by selector, how many ids a word holds and of how many bits.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 64], np.int64)
#: Selector 14 holds two ids of 30 bits; one id of up to 60 bits has no selector of its own and is escaped.
ESCAPE = 15
MAGIC = b"S8B1"
BLOCK = 65_536
#: A segment is closed when it has so many ids.
SEGMENT = 262_144
#: Words whose ids a worker remembers; when it is full, those of the present batch stay.
CACHE = 1_500_000
#: Bytes of text that are encoded together: the more, the fewer equal words are looked up.
SLICE = 16 << 20


def pack(ids: np.ndarray) -> np.ndarray:
    """The 64-bit words of one block: each takes the selector that holds the most of the next ids."""
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64)
    ids = ids.astype(np.uint64)
    small = ids < np.uint64(1 << 31)
    need = np.where(small, np.frexp(ids.astype(np.float64))[1], 64).astype(np.uint8)  # bits of each id
    best = np.full(n, ESCAPE, np.uint8)
    doubled, size = {1: need}, 1  # by c, the widest of the next c ids
    fits = []
    for s in range(14, -1, -1):
        c = int(COUNTS[s])
        if c > n:
            break
        p = 1 << (c.bit_length() - 1)
        while size < p:  # a window of c joins two windows of a power of two
            half = doubled[size]
            doubled[size * 2] = np.maximum(half[:-size], half[size:])
            size *= 2
        if doubled[p].min() > BITS[s]:
            break  # longer windows are no narrower, and have fewer bits for each id
        most = doubled[p] if p == c else np.maximum(doubled[p][: n - c + 1], doubled[p][c - p : c - p + n - c + 1])
        fits.append((s, np.flatnonzero(most <= BITS[s])))
    for s, places in fits:
        best[places] = s
    step = COUNTS[best].tolist()
    at, starts = 0, []
    put = starts.append
    while at < n:
        put(at)
        at += step[at]
    starts = np.array(starts)
    chosen = best[starts]
    width = np.where(chosen == ESCAPE, 2, 1)
    place = np.cumsum(width) - width
    out = np.zeros(int(width.sum()), np.uint64)
    out[place] = chosen.astype(np.uint64) << np.uint64(60)
    for s in range(2, 15):
        mine = np.flatnonzero(chosen == s)
        for j in range(int(COUNTS[s]) if len(mine) else 0):
            out[place[mine]] |= ids[starts[mine] + j] << np.uint64(j * int(BITS[s]))
    raw = chosen == ESCAPE
    out[place[raw] + 1] = ids[starts[raw]]
    return out


def unpack(words: np.ndarray) -> np.ndarray:
    """The ids of a block."""
    if not len(words):
        return np.zeros(0, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    suspects = np.flatnonzero(selector == ESCAPE)
    for i in suspects.tolist():  # a word after an escape is no selector
        if not raw[i] and i + 1 < len(words):
            raw[i + 1] = True
    heads = np.flatnonzero(~raw)
    selector = selector[heads]
    counts = COUNTS[selector]
    ends = np.cumsum(counts)
    out = np.zeros(int(ends[-1]), np.uint64)
    begin = ends - counts
    for s in range(2, 15):
        mine = selector == s
        if mine.any():
            w, b, mask = words[heads[mine]], begin[mine], np.uint64((1 << int(BITS[s])) - 1)
            for j in range(int(COUNTS[s])):
                out[b + j] = (w >> np.uint64(j * int(BITS[s]))) & mask
    mine = selector == ESCAPE
    out[begin[mine]] = words[heads[mine] + 1]
    return out


def dump(ids: np.ndarray) -> bytes:
    """A segment's payload."""
    blocks = [pack(ids[i : i + BLOCK]) for i in range(0, len(ids), BLOCK)]
    head = np.array([len(ids), len(blocks), *map(len, blocks)], "<u4").tobytes()
    return MAGIC + head + b"".join(b.astype("<u8").tobytes() for b in blocks)


def load(payload: bytes) -> np.ndarray:
    """The ids of a segment's payload."""
    if payload[:4] != MAGIC:
        raise ValueError("not a Simple-8b segment")
    total, n = np.frombuffer(payload, "<u4", 2, 4).tolist()
    sizes = np.frombuffer(payload, "<u4", n, 12)
    words = np.frombuffer(payload, "<u8", int(sizes.sum()), 12 + 4 * n)
    ends = np.cumsum(sizes)
    ids = np.concatenate([unpack(words[e - s : e]) for s, e in zip(sizes.tolist(), ends.tolist())] or [np.zeros(0, np.uint64)])
    if len(ids) != total:
        raise ValueError("a Simple-8b segment is damaged")
    return ids


class Encoder:
    """A tokenizer of the tokenizers library, as it is loaded, that remembers the ids of words.

    apart: white space has no ids and no match crosses it, as for the tokenizer used here, so equal words of a batch go
    to the library once; else whole texts go to it. A text with the string of a special token goes to it whole, as that
    string may stand across words. A text without combining marks is put in lower case first where the tokenizer does
    so itself: with a mark the order of composing and lowering would matter.
    """

    def __init__(self, path: str, apart: bool):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.apart = apart
        # The words that are remembered, their ids one after the other, and how many each has.
        self.words, self.flat, self.size = pa.array([], pa.string()), np.zeros(0, "<u4"), np.zeros(0, np.int64)
        self.lower = self.library.normalizer is not None and self.library.normalizer.normalize_str("A") == "a"
        added = self.library.get_added_tokens_decoder()
        self.strings = [t.content for t in added.values()]
        # Many words go to the library as one text, between them a special token.
        self.mark = max(((i, t.content) for i, t in added.items() if t.special and not (t.lstrip or t.rstrip or t.single_word or t.normalized)), default=None)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each has; a null is an empty text."""
        column = pc.fill_null(column.cast(pa.string()), "")
        special = np.zeros(len(column), bool)
        for x in self.strings:  # in any case: lowering may make one
            special |= np.asarray(pc.match_substring(column, x, ignore_case=True))
        odd = np.flatnonzero(special) if self.apart else np.arange(len(column))
        parts = self.whole([column[i].as_py() for i in odd.tolist()])
        if not self.apart:
            return np.concatenate([np.zeros(0, "<u4"), *parts]), np.fromiter(map(len, parts), np.int64, len(parts))
        if len(odd):
            column = pc.if_else(pa.array(special), "", column)
        ids, counts = self.by_word(lowered(column) if self.lower else column)
        if len(odd):
            pieces = np.split(ids, np.cumsum(counts)[:-1])
            for i, x in zip(odd.tolist(), parts):
                pieces[i], counts[i] = x, len(x)
            ids = np.concatenate(pieces)
        return ids, counts

    def by_word(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        split = pc.ascii_split_whitespace(column)
        bounds = np.asarray(split.offsets) - split.offsets[0].as_py()
        coded = split.flatten().dictionary_encode()
        met = coded.dictionary
        place = pc.index_in(met, self.words)
        fresh = met.filter(pc.is_null(place))
        if len(self.words) + len(fresh) > CACHE:  # those of the present batch stay
            stay = np.asarray(place.drop_null())
            self.flat, self.size = gather(self.flat, self.size, stay), self.size[stay]
            self.words = self.words.take(pa.array(stay))
            place = pc.index_in(met, self.words)
        if len(fresh):
            parts = self.learn(fresh)
            self.flat = np.concatenate([self.flat, *parts])
            self.size = np.concatenate([self.size, np.fromiter(map(len, parts), np.int64, len(parts))])
            self.words = pa.concat_arrays([self.words, fresh])
            place = pc.index_in(met, self.words)
        which = np.asarray(place)[np.asarray(coded.indices)]
        ends = np.concatenate([[0], np.cumsum(self.size[which])])
        return gather(self.flat, self.size, which), np.diff(ends[bounds])

    def learn(self, fresh: pa.Array) -> list[np.ndarray]:
        """The ids of words, none of which has the string of a special token in it."""
        if self.mark is None:
            return self.whole(fresh.to_pylist())
        mark, between = self.mark
        bounds = [*range(0, len(fresh), 1000), len(fresh)]
        lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), fresh)
        out = []
        for a, b, ids in zip(bounds, bounds[1:], self.whole(pc.binary_join(lists, between).to_pylist())):
            cuts = np.flatnonzero(ids == mark)
            if len(cuts) == b - a - 1:
                out += [ids[x:y] for x, y in zip([0, *(cuts + 1).tolist()], [*cuts.tolist(), len(ids)])]
            else:  # a word and the token beside it made another special token
                out += self.whole(fresh[a:b].to_pylist())
        return out


def gather(flat: np.ndarray, size: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The runs of flat (their lengths in size) named by which, one after the other."""
    first, out = np.cumsum(size) - size, []
    for a in range(0, len(which), 1 << 18):
        w = which[a : a + (1 << 18)]
        n = size[w]
        at = np.repeat(first[w] - (np.cumsum(n) - n), n)
        at += np.arange(len(at))
        out.append(flat[at])
    return np.concatenate([flat[:0], *out])


def lowered(column: pa.Array) -> pa.Array:
    """The strings with A to Z in lower case, but for those with a combining mark."""
    raw = column.cast(pa.binary())
    marks = pc.or_(pc.match_substring(raw, b"\xcc"), pc.match_substring(raw, b"\xcd"))
    low = pc.ascii_lower(column)
    return pc.if_else(marks, column, low) if pc.any(marks).as_py() else low


STORE = "shard int, start long, doc_ids array<long>, doc_lens array<long>, payload binary"


def write(docs: DataFrame, path: str, to: str, end_id: int = 1, apart: bool = False, shards: int | None = None) -> None:
    """Encode docs (doc_id, text) in ascending doc_id order, end_id after each document, into a store at `to`."""
    spark = docs.sparkSession
    n = shards or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select("doc_id", "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches):
        tool, shard = common.tool(("tokens", path, apart), lambda: Encoder(path, apart)), TaskContext.get().partitionId()
        start, ids, doc_ids, doc_lens, held = 0, [], [], [], 0

        def close():
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([start], pa.int64()), pa.array([doc_ids], pa.list_(pa.int64())), pa.array([doc_lens], pa.list_(pa.int64())), pa.array([dump(np.concatenate(ids))], pa.binary())], ["shard", "start", "doc_ids", "doc_lens", "payload"])

        for b in common.slices(batches, most=SLICE):
            coded, counts = tool.encode(b.column(1))
            coded = np.insert(coded, np.cumsum(counts), end_id)
            at = 0
            for doc_id, n in zip(b.column(0).to_pylist(), (counts + 1).tolist()):
                ids.append(coded[at : at + n])
                doc_ids.append(doc_id)
                doc_lens.append(n)
                at += n
                held += n
                if held >= SEGMENT:
                    yield close()
                    start, ids, doc_ids, doc_lens, held = start + held, [], [], [], 0
            ids = [np.concatenate(ids)] if ids else []  # not views that keep the whole slice
        if doc_ids:
            yield close()

    rows.mapInArrow(run, STORE).write.option("compression", "zstd").parquet(to)


def read(spark: SparkSession, at: str, digest: bool = False) -> DataFrame:
    """Per document of a store: doc_id, start (ids of all documents before it), n_tokens, ids (binary, 32-bit).

    With digest=True ids_crc32, the CRC of the ids as 32-bit words, stands for the ids.
    """
    last = "ids_crc32" if digest else "ids"
    store = spark.read.schema(STORE).parquet(at)
    # One row of a few bytes for each shard, as many as the writer had partitions: small enough to send.
    sizes = store.select("shard", F.aggregate("doc_lens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("shard").agg(F.sum("n").alias("n"))
    before = sizes.select("shard", (F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("before"))

    def run(batches):
        for b in common.slices(batches, "payload"):
            out = ([], [], [], [])
            for start, docs, lens, payload, base in zip(*(b.column(i).to_pylist() for i in range(5))):
                ids = load(payload).astype("<u4")
                ends = np.cumsum(lens)
                for d, n, e in zip(docs, lens, ends.tolist()):
                    for to, x in zip(out, (d, base + start + e - n, n, zlib.crc32(ids[e - n : e]) if digest else ids[e - n : e].tobytes())):
                        to.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int64() if digest else pa.binary()))], ["doc_id", "start", "n_tokens", last])

    return store.join(F.broadcast(before), "shard").select("start", "doc_ids", "doc_lens", "payload", "before").mapInArrow(run, f"doc_id long, start long, n_tokens long, {last} {'long' if digest else 'binary'}")


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    to = f"{common.shared_dir(spark).rstrip('/')}/token-store-{uuid.uuid4().hex}"
    write(common.table(spark, sf_dir, "documents"), P.path("word_bpe_49k.json"), to, end_id=1, apart=True)
    told = common.stash(read(spark, to, digest=True))  # a few numbers a document; the store itself is not left behind
    common.remove(spark, to)
    return told
