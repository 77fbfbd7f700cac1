"""Benchmark decontamination by greedy string tiling.

Documents and items become token sequences (letters, digits and underscores, lower case). Runs of SEED tokens that both
have join them; for each pair that meets, greedy string tiling by running Karp-Rabin matches marks the longest common
passages that don't overlap, again and again down to SEED tokens, wherever they stand; the pair counts if the tiles
cover THRESHOLD of the item. So a passage is found whole, in parts, and in another order.

A pair that reaches the threshold shares at least so many seeds that an item may leave its most frequent ones out of
the index; this drops no pair, and a phrase common to all items brings no candidates. The benchmark is sent in blocks
of bounded size, each against all documents.

Edge cases: null and empty texts match nothing; an item of under SEED tokens is found where all of them stand in a
row, and one without tokens nowhere; texts of any length are taken whole; repeated documents and items give repeated
pairs; a null id stays null; further columns are ignored; an empty table gives an empty table. Ties between equally
long tiles go to the first in the item, then in the document.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import common

SEED, THRESHOLD = 5, 0.5
#: Bytes of item text in one block of the benchmark.
BLOCK_BYTES = 16 << 20
TOKENS = re.compile(r"\w+").findall
SCHEMA = "doc_id long, item_id long, coverage double, n_tokens long, n_tiles int"


def tile(item: np.ndarray, doc: np.ndarray, least: int = SEED) -> list[tuple[int, int, int]]:
    """Tiles (start in item, start in doc, length), none overlapping another; values below 0 match nothing.

    The longest length that free places of both still share is found by halving, as what shares a passage shares all
    shorter ones; each trial is one running hash over both. All tiles of that length are then marked in one walk: a place
    of the document that is no longer free stays so, so that no list of equal places is gone through twice, and long
    repetitive texts take no longer than others. There are no more lengths than the square root of twice the item's.
    """
    taken_i, taken_d = item < 0, doc < 0
    values_i, values_d = common.mix(item.astype(np.uint64)), common.mix(doc.astype(np.uint64))
    out: list[tuple[int, int, int]] = []

    def free(values: np.ndarray, taken: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Places where n values in a row are free, and their hashes."""
        if len(values) < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        marks = np.concatenate([[0], np.cumsum(taken)])
        at = np.flatnonzero(marks[n:] == marks[:-n])
        return at, common.rolling_hashes(values, n)[at]

    def shared(n: int) -> bool:
        one = np.unique(free(values_i, taken_i, n)[1])
        two = free(values_d, taken_d, n)[1]
        return bool(len(one) and len(two) and (one[np.minimum(np.searchsorted(one, two), len(one) - 1)] == two).any())

    most = min(len(item), len(doc))
    while most >= least and shared(least):
        low, high = least, most
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if shared(middle) else (low, middle - 1)
        at, hashes = free(values_d, taken_d, low)
        order = np.argsort(hashes, kind="stable")
        at, hashes = at[order], hashes[order]
        next_: dict[int, int] = {}
        for p, h in zip(*(x.tolist() for x in free(values_i, taken_i, low))):
            if taken_i[p] or taken_i[p + low - 1]:  # tiles of this length and longer only: one that overlaps covers an end
                continue
            k = next_.get(h)
            if k is None:
                k = int(np.searchsorted(hashes, np.uint64(h)))
            while k < len(at) and hashes[k] == h and (taken_d[at[k]] or taken_d[at[k] + low - 1]):
                k += 1
            next_[h] = k
            while k < len(at) and hashes[k] == h:
                t = int(at[k])
                if not (taken_d[t] or taken_d[t + low - 1]) and (item[p : p + low] == doc[t : t + low]).all():
                    out.append((p, t, low))
                    taken_i[p : p + low] = taken_d[t : t + low] = True
                    break
                k += 1  # other tokens of the same hash
        most = low - 1
    return out


class Block:
    """A block of the benchmark: its vocabulary, its items' token numbers, and the index of their rarer seeds."""

    def __init__(self, items: list[tuple[int | None, str | None]], threshold: float, seed: int):
        self.vocab: dict[str, int] = {}
        self.threshold, self.seed = threshold, seed
        self.ids, self.tokens = [], []
        short: dict[int, dict[tuple[int, ...], list[int]]] = {}
        ids: list[tuple[int | None, tuple[int, ...]]] = []
        for item_id, text in items:
            words = TOKENS((text or "").lower())
            numbers = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words]
            if len(words) >= seed:
                self.ids.append(item_id)
                self.tokens.append(np.array(numbers, np.int64))
            elif words:
                ids.append((item_id, tuple(numbers)))
        # Items too short for a seed come after the others; by length and tokens, their places.
        for item_id, numbers in ids:
            short.setdefault(len(numbers), {}).setdefault(numbers, []).append(len(self.ids))
            self.ids.append(item_id)
        self.short = short
        hashes = [self.seeds(t) for t in self.tokens]
        df = Counter(h for hs in hashes for h in set(hs.tolist()))
        self.every = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)
        index: dict[int, list[int]] = {}
        for i, (t, hs) in enumerate(zip(self.tokens, hashes)):
            spare = max(1, math.ceil(threshold * len(t) / seed)) - 1
            rare = sorted(hs.tolist(), key=lambda h: (df[h], h))
            for h in set(rare[: len(rare) - spare]):
                index.setdefault(h, []).append(i)
        self.index = index
        self.own = [set(hs.tolist()) for hs in hashes]

    def seeds(self, tokens: np.ndarray) -> np.ndarray:
        return common.window_hashes(common.mix(tokens.astype(np.uint64)), self.seed)

    def match(self, texts: list[str]) -> list[tuple[int, int, float, int, int]]:
        """(document's place, item's place, coverage, tokens, tiles) of the pairs that reach the threshold."""
        if not self.ids:
            return []
        get, k = self.vocab.get, self.seed
        parts = []
        for t in texts:
            words = TOKENS(t.lower())
            parts.append(np.fromiter((get(w, 0) for w in words), np.int64, len(words)))
            parts.append(np.zeros(1, np.int64))
        flat = np.concatenate(parts)
        ends = np.cumsum([len(p) for p in parts])[1::2]
        n = len(flat) - k + 1
        known = np.concatenate([[0], np.cumsum(flat > 0)])
        out = self.whole(flat, known, ends)
        at = np.flatnonzero(known[k:] - known[:-k] == k) if n > 0 and self.tokens else np.zeros(0, np.int64)
        if not len(at):
            return out
        h = common.mix(flat.astype(np.uint64))
        value = h[at].copy()
        for j in range(1, k):
            value = value * np.uint64(common.R_WORD) + h[at + j]
        value = common.mix(value)
        near = np.minimum(np.searchsorted(self.every, value), len(self.every) - 1)
        hit = self.every[near] == value
        at, value = at[hit], value[hit]
        owner = np.searchsorted(ends, at, side="right")
        cuts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1], [True]])) if len(owner) else np.zeros(0, np.int64)
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            doc, here, seen = int(owner[lo]), at[lo:hi], value[lo:hi].tolist()
            some = set(seen)
            candidates = {i for v in some for i in self.index.get(v, ())}
            for i in sorted(candidates):
                item, mine = self.tokens[i], self.own[i]
                if not self.reaches(item, mine, some):
                    continue
                places = here[[j for j, v in enumerate(seen) if v in mine]]
                # What of the document lies in shared seeds; gaps become one token that matches nothing.
                cover = np.unique((places[:, None] + np.arange(k)).ravel())
                gap = np.flatnonzero(np.diff(cover) > 1) + 1
                doc_tokens = np.insert(flat[cover], gap, -1)
                tiles = tile(item, doc_tokens, k)
                share = sum(t[2] for t in tiles) / len(item)
                if share >= self.threshold:
                    out.append((doc, i, share, len(item), len(tiles)))
        return out

    def whole(self, flat: np.ndarray, known: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, float, int, int]]:
        """Items too short for a seed, in the documents that have all their tokens in a row."""
        found = set()
        for k, items in self.short.items():
            first = np.unique(np.fromiter((x[0] for x in items), np.int64, len(items)))
            at = np.flatnonzero((known[k:] - known[:-k] == k) & np.isin(flat[: len(flat) - k + 1], first)) if len(flat) >= k else ()
            for i in at:
                for item in items.get(tuple(flat[i : i + k].tolist()), ()):
                    found.add((int(np.searchsorted(ends, i, side="right")), item, 1.0, k, 1))
        return sorted(found)

    def reaches(self, item: np.ndarray, mine: set[int], seen: set[int]) -> bool:
        """Whether the item's seeds that the document has cover enough of it: no tiling covers more."""
        has = np.array([h in seen for h in self.seeds(item).tolist()], bool)
        cover = np.convolve(has, np.ones(self.seed, np.int64)) > 0
        return cover.sum() >= self.threshold * len(item)


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, seed: int = SEED) -> DataFrame:
    """Pairs (doc_id, item_id, coverage, n_tokens, n_tiles) of documents that hold a benchmark item; n_tokens is the item's."""
    spark = docs.sparkSession
    items = benchmark.select("item_id", "text").where("text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    out = None
    for i in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i).collect()
        held = spark.sparkContext.broadcast(Block([tuple(r) for r in rows], threshold, seed))

        def run(batches, held=held):
            common.no_tool()
            block = held.value
            for b in common.slices(batches):
                ids = b.column(0).to_pylist()
                found = block.match(common.texts(b))
                columns = list(zip(*((ids[d], block.ids[i], share, n, m) for d, i, share, n, m in found))) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int32()))], ["doc_id", "item_id", "coverage", "n_tokens", "n_tiles"])

        part = docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
        out = part if out is None else out.unionAll(part)
    return out


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
