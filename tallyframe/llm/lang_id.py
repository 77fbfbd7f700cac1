"""Language identification of spans and documents.

Character n-gram counts of each language are gathered from all training documents into hashed tables. A word's script
narrows the candidate languages to those that write in it; its n-grams score the candidates; Viterbi over the words of
a document, with a penalty for each switch, labels spans of mixed-language text. The document's language is that with
the most letters in its spans, its score their share.

Edge cases: a null text, or one without a letter, is `und` with score 0, as is everything when there are no training
rows; one-letter texts get the likeliest language; texts of any length are labelled whole; ties go to the language that
sorts first; repeated rows give repeated results; a null lang teaches nothing; further columns are ignored; an empty
table gives an empty table.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import common

#: First and last code point of scripts. What is in none of them is a script of its own (0).
SCRIPTS = [
    ("latin", 0x41, 0x24F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x370, 0x3FF), ("greek", 0x1F00, 0x1FFF), ("cyrillic", 0x400, 0x52F), ("armenian", 0x530, 0x58F), ("hebrew", 0x590, 0x5FF),
    ("arabic", 0x600, 0x6FF), ("arabic", 0x750, 0x77F), ("devanagari", 0x900, 0x97F), ("bengali", 0x980, 0x9FF), ("gurmukhi", 0xA00, 0xA7F), ("gujarati", 0xA80, 0xAFF), ("tamil", 0xB80, 0xBFF),
    ("telugu", 0xC00, 0xC7F), ("kannada", 0xC80, 0xCFF), ("malayalam", 0xD00, 0xD7F), ("thai", 0xE00, 0xE7F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF), ("hangul", 0xAC00, 0xD7A3),
    ("ethiopic", 0x1200, 0x137F), ("khmer", 0x1780, 0x17FF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("han", 0x20000, 0x2FA1F),
]
NAMES = ["other", *dict.fromkeys(n for n, _, _ in SCRIPTS)]
#: A language writes in a script that holds this share of its letters.
SCRIPT_SHARE = 0.001
ORDERS, BITS = (2, 3, 4), 15
WIDTH = len(ORDERS) << BITS
#: Log-probability lost by a switch of language between two words, and by a language that does not write in the script.
SWITCH, FOREIGN = 9.0, 60.0
#: Words whose scores a worker remembers.
CACHE = 600_000
SLICE = 24 << 20
LETTERS = re.compile(r"[^\W\d_]+").findall
SEP = 10

_scripts: list[np.ndarray] = []


def script_table() -> np.ndarray:
    if not _scripts:
        t = np.zeros(0x110000, np.int32)
        for name, a, b in SCRIPTS:
            t[a : b + 1] = NAMES.index(name)
        _scripts.append(t)
    return _scripts[0]


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the words (with their ends), the word each comes from, and the words' code points."""
    points = np.frombuffer(("\n" + "\n".join(words) + "\n").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    edge = points == SEP
    word = np.cumsum(edge) - 1  # a separator belongs to the word after it
    buckets, owners = [], []
    for k, n in enumerate(ORDERS):
        m = len(points) - n + 1
        if m <= 0:
            continue
        h = points[:m].copy()
        inner = np.zeros(m, bool)
        for j in range(1, n):
            h = h * np.uint64(0x100000001B3) + points[j : j + m]
            if j < n - 1:
                inner |= edge[j : j + m]
        ok = np.flatnonzero(~inner & ~(edge[:m] & edge[n - 1 : n - 1 + m] & (n == 2)))
        buckets.append((common.mix(h[ok]) >> np.uint64(64 - BITS)).astype(np.int64) + (k << BITS))
        owners.append(word[ok])
    if not buckets:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), points
    return np.concatenate(buckets), np.concatenate(owners), points


def count(docs: DataFrame) -> DataFrame:
    """Counts (lang, bucket, n) over docs (lang, text); buckets from WIDTH on are letters by script."""

    def run(batches):
        from collections import Counter

        seen: dict[str, Counter] = {}
        totals: dict[str, np.ndarray] = {}

        def fold():
            table = script_table()
            for lang, words in seen.items():
                total = totals.setdefault(lang, np.zeros(WIDTH + len(NAMES)))
                keys = list(words)
                n = np.fromiter(words.values(), np.float64, len(words))
                for at in range(0, len(keys), 100_000):
                    part, weight = keys[at : at + 100_000], n[at : at + 100_000]
                    bucket, owner, points = grams(part)
                    total += np.bincount(bucket, weight[np.minimum(owner, len(part) - 1)], len(total))
                    lens = np.fromiter(map(len, part), np.int64, len(part))
                    total += np.bincount(WIDTH + table[points[points != SEP].astype(np.int64)], np.repeat(weight, lens), len(total))
            seen.clear()

        for b in common.slices(batches):
            for lang, text in zip(b.column(0).to_pylist(), common.texts(b)):
                seen.setdefault(lang, Counter()).update(LETTERS(text.lower()))
            if sum(map(len, seen.values())) > CACHE:
                fold()
        fold()
        for lang, total in totals.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at], pa.float64())], ["lang", "bucket", "n"])

    rows = docs.select("lang", "text").where("lang is not null and text is not null").mapInArrow(run, "lang string, bucket int, n double")
    return rows.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Model:
    """Log-probabilities of n-gram buckets for each language, and which languages write in which script."""

    def __init__(self, counts: list[tuple[str, int, float]]):
        self.langs = sorted({lang for lang, _, _ in counts})
        place = {x: i for i, x in enumerate(self.langs)}
        full = np.zeros((WIDTH + len(NAMES), len(self.langs)))
        for lang, bucket, n in counts:
            full[bucket, place[lang]] = n
        self.logs = np.zeros((WIDTH, len(self.langs)), np.float32)
        for k in range(len(ORDERS)):
            part = full[k << BITS : (k + 1) << BITS] + 0.05
            self.logs[k << BITS : (k + 1) << BITS] = np.log(part / part.sum(axis=0)) / len(ORDERS)
        letters = full[WIDTH:]
        self.allowed = letters >= SCRIPT_SHARE * np.maximum(1, letters.sum(axis=0))
        self.allowed[~self.allowed.any(axis=1)] = True  # a script nobody writes tells nothing

    def scores(self, words: list[str]) -> np.ndarray:
        """[word, language]: what each word's n-grams say, less FOREIGN where the language does not write its script."""
        out = np.zeros((len(words), len(self.langs)), np.float32)
        bucket, owner, _ = grams(words)
        order = np.argsort(owner, kind="stable")
        bucket, owner = bucket[order], owner[order]
        keep = owner < len(words)
        bucket, owner = bucket[keep], owner[keep]
        if len(owner):
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            out[owner[first]] = np.add.reduceat(self.logs[bucket], first, axis=0)
        table = script_table()
        script = table[np.fromiter((ord(w[0]) for w in words), np.int64, len(words))]
        out -= np.where(self.allowed[script], 0, FOREIGN).astype(np.float32)
        none = [i for i, w in enumerate(words) if not w.isalpha() and not any(map(str.isalpha, w))]
        out[none] = 0
        return out


class Ids(dict):
    """Numbers words as they come."""

    def __missing__(self, w):
        n = self[w] = len(self)
        return n


def label(docs: list[np.ndarray], table: np.ndarray, switch: float = SWITCH) -> list[np.ndarray]:
    """The likeliest language of each word, by Viterbi in step over all documents: step t takes the t-th word of each.

    docs: for each document its words as rows of table [word, language].
    """
    order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
    lens = np.array([len(docs[i]) for i in order], np.int64)
    if not len(lens) or not lens[0]:
        return [np.zeros(0, np.uint8) for _ in docs]
    live = np.searchsorted(-lens, -np.arange(1, lens[0] + 1), side="right")  # documents that have a t-th word
    begins = np.concatenate([[0], np.cumsum(lens)])
    flat = np.concatenate([docs[i] for i in order])
    n_langs = table.shape[1]
    path = np.zeros((len(flat), n_langs), bool)  # whether the best way into a language is a switch
    best = np.zeros(len(flat), np.uint8 if n_langs < 256 else np.int32)
    v = table[flat[begins[:-1][: live[0]]]].astype(np.float32)
    ends = np.zeros((len(docs), n_langs), np.float32)
    last = live[0]
    for t in range(1, int(lens[0])):
        k = int(live[t])
        if k < last:
            ends[k:last] = v[k:last]
            v = v[:k]
            last = k
        at = begins[:k] + t
        top = v.argmax(axis=1)
        best[at - 1] = top
        jump = (v[np.arange(k), top] - np.float32(switch))[:, None]
        path[at] = v < jump
        v = np.maximum(v, jump)
        v += table[flat[at]]
    ends[:last] = v[:last]
    labels = np.zeros(len(flat), best.dtype)
    now = np.zeros(len(docs), np.int64)
    for t in range(int(lens[0]) - 1, -1, -1):
        k = int(live[t])
        fresh = int(live[t + 1]) if t + 1 < lens[0] else 0
        now[fresh:k] = ends[fresh:k].argmax(axis=1)
        at = begins[:k] + t
        labels[at] = now[:k]
        if t:
            switched = path[at, now[:k]]
            now[:k] = np.where(switched, best[at - 1], now[:k])
    out: list = [None] * len(docs)
    for j, i in enumerate(order):
        out[i] = labels[begins[j] : begins[j + 1]]
    return out


class Tagger:
    def __init__(self, model: Model):
        self.model, self.ids = model, Ids()
        self.table, self.weight = np.zeros((1024, len(model.langs)), np.float32), np.zeros(1024, np.int64)
        self.known = 0

    def words(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.ids) > CACHE:
            self.ids, self.known = Ids(), 0
        get = self.ids.__getitem__
        docs = []
        for t in texts:
            found = LETTERS(t.lower())
            docs.append(np.fromiter(map(get, found), np.int32, len(found)))
        n = len(self.ids)
        if n > len(self.table):
            size = max(n, 2 * len(self.table))
            self.table = np.concatenate([self.table[: self.known], np.zeros((size - self.known, self.table.shape[1]), np.float32)])
            self.weight = np.concatenate([self.weight[: self.known], np.zeros(size - self.known, np.int64)])
        new = list(self.ids)[self.known :]
        for at in range(0, len(new), 50_000):
            part = new[at : at + 50_000]
            to = self.known + at
            self.table[to : to + len(part)] = self.model.scores(part)
            self.weight[to : to + len(part)] = [len(w) if w.isalpha() else sum(map(str.isalpha, w)) for w in part]
        self.known = n
        return docs

    def spans(self, texts: list[str]) -> list[list[tuple[str, int, int]]]:
        """For each text its spans (language, first word, word after the last)."""
        out = []
        for x in label(self.words(texts), self.table):
            cuts = [0, *(np.flatnonzero(x[1:] != x[:-1]) + 1).tolist(), len(x)] if len(x) else [0]
            out.append([(self.model.langs[x[a]], a, b) for a, b in zip(cuts, cuts[1:])])
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        docs = self.words(texts)
        langs, scores = [], []
        for words, x in zip(docs, label(docs, self.table)):
            letters = np.bincount(x, self.weight[words], len(self.model.langs)) if len(x) else np.zeros(1)
            total = letters.sum()
            langs.append(self.model.langs[int(letters.argmax())] if total else "und")
            scores.append(float(letters.max() / total) if total else 0.0)
        return langs, scores


def identify(docs: DataFrame, train: DataFrame) -> DataFrame:
    """docs (doc_id, held_out, text) with lang_pred and score; learns from train (lang, text)."""
    counts = [tuple(r) for r in count(train).toLocalIterator()]  # at most WIDTH and the scripts for each language
    held = docs.sparkSession.sparkContext.broadcast(Model(counts))
    key = f"languages {held._jbroadcast.id()}"

    def run(batches):
        tagger = common.tool(key, lambda: Tagger(held.value))
        for b in common.slices(batches, most=SLICE):
            langs, scores = tagger.predict(common.texts(b)) if tagger.model.langs else (["und"] * b.num_rows, [0.0] * b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").withColumn("held_out", common.held_out(4, 2))
    return identify(docs.select("doc_id", "held_out", "text"), docs.where(~F.col("held_out")).select("lang", "text"))
