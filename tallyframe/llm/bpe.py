"""Byte-level BPE encoding and decoding.

Every match of the pre-token pattern is merged on its own. A segment tree stands over the byte positions of a
pre-token; its leaves hold the rank of the pair that begins there, its root the leftmost minimum. A merge takes the
root, joins two live neighbours and updates three leaves, each in logarithmic time. Many pre-tokens are merged in step
as rows of arrays; one of over LANES bytes has a tree of its own.

Edge cases: a null or empty text has no ids (n_tokens 0, digests of the empty string); a text of any length is encoded
whole; repeated rows give repeated results; further columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from tallyframe.llm import common

#: Pre-tokens of at most so many bytes are merged in step with others.
LANES = 64
#: Rows merged in step at a time, so that their arrays stay in the processor's cache.
ROWS = 2048
#: Words, and pre-tokens, whose ids a worker remembers; when it is full, those of the present batch stay.
CACHE = 200_000
SLICE = 1 << 20
#: In the arrays: no pair. Ranks are below 2**24, so that a rank and a position below LANES fit 31 bits.
NONE = np.int32(2**31 - 1)


def white(pattern: str) -> str:
    """The pattern with white space as Unicode's property, which is what the tokenizer's own regex library takes it as."""
    return pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")


class Ranks:
    """A vocabulary file of ranks, the pairs that merge into each token, and the ids of words met so far."""

    def __init__(self, path: str, pattern: str):
        lines = [x.split() for x in open(path, "rb").read().splitlines() if x.strip()]
        self.ranks = {base64.b64decode(a): int(b) for a, b in lines}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.pattern = regex.compile(white(pattern))
        self.pairs = {}
        for whole, rank in self.ranks.items():
            for cut in range(1, len(whole)):
                a, b = self.ranks.get(whole[:cut]), self.ranks.get(whole[cut:])
                if a is not None and b is not None:
                    self.pairs[a << 32 | b] = rank
        self.hash_pairs()
        self.bytes = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        self.words: dict[str, bytes | None] = {}
        self.pieces: dict[str, bytes] = {}

    def hash_pairs(self) -> None:
        """Pairs in an open-addressed table of arrays, at most a quarter full, that many pairs are looked up in at once."""
        keys = np.fromiter(self.pairs, np.int64, len(self.pairs))
        ranks = np.fromiter(self.pairs.values(), np.int32, len(self.pairs))
        self.bits = max(8, len(keys).bit_length() + 2)
        self.slot_key, self.slot_rank, self.probes = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32), 0
        todo = np.arange(len(keys))
        slot = self.slot(keys)
        while len(todo):
            self.probes += 1
            free = todo[self.slot_key[slot[todo]] == -1]
            self.slot_key[slot[free]] = keys[free]  # of those that meet in a slot, the last one written has it
            self.slot_rank[slot[free]] = ranks[free]
            todo = todo[self.slot_key[slot[todo]] != keys[todo]]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * common.ODD) >> np.uint64(64 - self.bits)).view(np.int64)

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank that each pair of ids merges into, -1 where there is none."""
        key = a.astype(np.int64) << 32 | b
        slot = self.slot(key)
        found = self.slot_key.take(slot)
        out = self.slot_rank.take(slot)
        out[found != key] = -1
        todo = np.flatnonzero((found != key) & (found != -1))
        for _ in range(self.probes):
            if not len(todo):
                break
            at = (slot[todo] + 1) & ((1 << self.bits) - 1)
            slot[todo] = at
            found = self.slot_key[at]
            hit = found == key[todo]
            out[todo[hit]] = self.slot_rank[at[hit]]
            todo = todo[~hit & (found != -1)]
        return out

    def merge_rows(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Merge pieces of 2 to width bytes (width: a power of two) in step, one row of the flat arrays for each.

        A leaf is its pair's rank and its position in one number, so the root of a row is the leftmost minimum.
        """
        n, shift, mask = len(pieces), width.bit_length() - 1, width - 1
        lens = np.fromiter(map(len, pieces), np.int32, n)
        raw = np.frombuffer(b"".join([p.ljust(width, b"\0") for p in pieces]), np.uint8)
        ids = self.bytes.astype(np.int32)[raw]  # [row * width + position]
        place = np.arange(width, dtype=np.int32)
        after = np.where(place >= lens[:, None] - 1, width, place + 1).astype(np.int32).ravel()  # width stands for the end
        before = np.tile(place - 1, n)
        tree = np.full((n, 2 * width), NONE, np.int32)
        grid = ids.reshape(n, width)
        rank = self.pair_rank(grid[:, :-1].ravel(), grid[:, 1:].ravel()).reshape(n, width - 1)
        tree[:, width:-1] = np.where((rank >= 0) & (place[:-1] < lens[:, None] - 1), rank << shift | place[:-1], NONE)
        level = width
        while level > 1:
            np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2], out=tree[:, level // 2 : level])
            level //= 2
        tree = tree.ravel()
        dead = (place >= lens[:, None]).ravel()
        rows = np.flatnonzero(tree[1 :: 2 * width] < NONE)
        while len(rows):
            row, leaf = rows * width, rows * (2 * width) + width
            root = tree.take(leaf - (width - 1))
            at, new = root & mask, root >> shift
            here = row + at
            right = after.take(here)
            beyond, left = after.take(row + right), before.take(here)
            ids[here] = new
            after[here] = beyond
            dead[row + right] = True
            tree[leaf + right] = NONE
            has, had = beyond < width, left >= 0
            before[(row + beyond)[has]] = at[has]
            r = self.pair_rank(new, ids.take(row + (beyond & mask)))
            tree[leaf + at] = np.where(has & (r >= 0), r << shift | at, NONE)
            lrow, left = row[had], left[had]
            r = self.pair_rank(ids.take(lrow + left), new[had])
            tree[leaf[had] + left] = np.where(r >= 0, r << shift | left, NONE)
            base = np.concatenate([leaf, leaf, leaf[had]]) - width
            node = np.concatenate([right, at, left]) + width
            for _ in range(shift):
                node = node >> 1
                child = base + 2 * node
                tree[base + node] = np.minimum(tree.take(child), tree.take(child + 1))
            rows = rows[tree.take(leaf - (width - 1)) < NONE]
        flat = ids[~dead].astype("<u4").tobytes()
        ends = (4 * np.cumsum((~dead).reshape(n, width).sum(axis=1))).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def merge_one(self, piece: bytes) -> list[int]:
        """The same for one long pre-token, with the tree in a list; leaves are (rank, position) as one number."""
        n = len(piece)
        ids = self.bytes[np.frombuffer(piece, np.uint8)].tolist()
        width = 1 << (n - 1).bit_length()
        none = 1 << 80
        pairs, shift = self.pairs, 40
        low = (1 << shift) - 1
        tree = [none] * (2 * width)
        for i in range(n - 1):
            if (r := pairs.get(ids[i] << 32 | ids[i + 1])) is not None:
                tree[width + i] = r << shift | i
        for i in range(width - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])
        after, before, dead = list(range(1, n + 1)), list(range(-1, n)), bytearray(n)

        def put(pos: int, value: int) -> None:
            node = pos + width
            tree[node] = value
            node >>= 1
            while node:
                a, b = tree[2 * node], tree[2 * node + 1]
                tree[node] = a if a < b else b
                node >>= 1

        while (root := tree[1]) < none:
            at, new = root & low, root >> shift
            right = after[at]
            beyond, left = after[right], before[at]
            ids[at], after[at], before[beyond], dead[right] = new, beyond, at, 1
            put(right, none)
            r = pairs.get(new << 32 | ids[beyond]) if beyond < n else None
            put(at, none if r is None else r << shift | at)
            if left >= 0:
                r = pairs.get(ids[left] << 32 | new)
                put(left, none if r is None else r << shift | left)
        return [x for x, gone in zip(ids, dead) if not gone]

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each pre-token, as little-endian 32-bit integers."""
        out: list = [None] * len(pieces)
        by_width: dict[int, list[int]] = {}
        get = self.ranks.get
        for i, p in enumerate(pieces):
            if (r := get(p)) is not None:
                out[i] = r.to_bytes(4, "little")
            elif len(p) <= LANES:
                by_width.setdefault(max(4, 1 << (len(p) - 1).bit_length()), []).append(i)
            else:
                out[i] = np.array(self.merge_one(p), "<u4").tobytes()
        for width, group in by_width.items():
            for at in range(0, len(group), ROWS):
                part = group[at : at + ROWS]
                for i, x in zip(part, self.merge_rows([pieces[i] for i in part], width)):
                    out[i] = x
        return out

    def whole(self, t: str) -> bytes:
        """The ids of a text, by its matches."""
        return b"".join(self.known(self.pattern.findall(t)))

    def known(self, found: list[str]) -> list[bytes]:
        """The ids of matches; those not met yet are merged and remembered."""
        have = self.pieces
        new = list({p for p in found if p not in have})
        if len(have) + len(new) > CACHE:
            self.pieces = have = {p: have[p] for p in found if p in have}
        have.update(zip(new, self.merge([p.encode() for p in new])))
        return list(map(have.__getitem__, found))

    def learn(self, words: list[str]) -> None:
        """Remember the ids of words with the space before them; None for one that does not end a match at both its ends."""
        split = [[] if not w or w[0].isspace() or w[-1].isspace() else self.pattern.findall(" " + w) for w in words]
        coded = self.known([p for ps in split for p in ps])
        at = 0
        for w, ps in zip(words, split):
            n = len(ps)
            self.words[w] = None if not n else coded[at] if n == 1 else b"".join(coded[at : at + n])
            at += n

    def encode(self, docs: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers.

        A single space between two characters that are not white space always begins a match, so texts are cut there
        and the ids of what is between are remembered; a text with other spaces is cut into its matches at once.
        """
        split = [t.split(" ") for t in docs]
        have = self.words
        new = {w for s in split for w in s if w not in have}
        if len(have) + len(new) > CACHE:
            self.words = have = {w: have[w] for s in split for w in s if w in have}
        self.learn(list(new))
        get = have.__getitem__
        out = []
        for t, s in zip(docs, split):
            first = s[0]
            if not t:
                out.append(b"")
            elif not first or first[0].isspace() or first[-1].isspace():
                out.append(self.whole(t))
            else:
                try:
                    out.append(self.whole(first) + b"".join(map(get, s[1:])))
                except TypeError:  # joined with None
                    out.append(self.whole(t))
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode(docs: DataFrame, path: str, pattern: str, ids: bool = False, text: str = "text") -> DataFrame:
    """docs' columns, and n_tokens, ids_sha256 and decoded_sha256; with ids=True also the ids (binary, 32-bit words).

    path is a file every executor has, as installed with the tokenizer package; it is read once a worker. Columns of
    docs named like the new ones are replaced.
    """
    kept = [f for f in docs.schema.fields if f.name.lower() not in {"n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if ids else [])}]
    docs = docs.select([f"`{f.name}`" for f in kept])
    extra = [pa.field("n_tokens", pa.int64()), pa.field("ids_sha256", pa.string()), pa.field("decoded_sha256", pa.string())] + [pa.field("ids", pa.binary())] * ids
    from pyspark.sql import types as T

    schema = T.StructType([*kept, T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()), *([T.StructField("ids", T.BinaryType())] if ids else [])])

    def run(batches):
        ranks = common.tool(("bpe", path, pattern), lambda: Ranks(path, pattern))
        for b in common.slices(batches, text, SLICE):
            coded = ranks.encode(common.texts(b, text))
            new = [
                pa.array([len(c) // 4 for c in coded], pa.int64()),
                pa.array([hashlib.sha256(c).hexdigest() for c in coded], pa.string()),
                pa.array([hashlib.sha256(ranks.decode(c)).hexdigest() for c in coded], pa.string()),
            ] + [pa.array(coded, pa.binary())] * ids
            yield pa.RecordBatch.from_arrays([*b.columns, *new], schema=pa.schema([*b.schema, *extra]))

    return docs.mapInArrow(run, schema)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    coded = encode(common.table(spark, sf_dir, "documents").select("doc_id", "text"), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    return coded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
