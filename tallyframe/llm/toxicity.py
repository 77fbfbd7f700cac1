"""Toxicity by a noisy channel.

A token with signs of disguise (leetspeak, separators inside, letters drawn out, letters spaced apart) is a lattice of
characters: what each character may stand for, what may be dropped, how long a repeat was meant to be. Viterbi under a
character trigram model, counted over all documents, restores the likeliest word. Restored words and their beginnings
are the features of a logistic regression, fitted on a bounded sample of labelled rows.

Edge cases: a null or empty text has no features and scores the regression's base rate; without usable labels everything
scores 0; texts of any length are scored whole; ties in the lattice go to the reading found first; of several labels
for one document the highest counts; null labels are ignored; repeated rows give repeated results; further columns are
ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import copy
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import common
from tallyframe.llm.lang_id import LETTERS

#: Labelled rows the classifier is fitted on, at most, of either label.
SAMPLE_TOXIC, SAMPLE_CLEAN = 4_000, 8_000
#: Features: so many candidates from the toxic sample, in at least MIN_DOCS of its documents, and so many in the end.
CANDIDATES, FEATURES, MIN_DOCS = 40_000, 1_000, 3
#: A feature is this many times as frequent in toxic documents, by more than chance brings about in a million words.
LIFT, SURPRISE = 6.0, 22.0
RIDGE = 0.05
PREFIXES = (4, 5, 6, 7)
#: What is read at once of a run of spaced letters: so many different ones in a row that none of PREFIXES is cut, however drawn
#: out, with a few signs between them. Letters that come more than three times in a row are read as three.
REACH = re.compile(r"[\W_]{0,6}(?:([^\W_])\1*[\W_]{0,6}){1,12}")
LONG, DRAWN_OUT = 36, re.compile(r"(.)\1{3,}")
THRESHOLD = 0.7
#: Hashed tables of the character model: trigrams and their contexts.
TRI_BITS, BI_BITS = 20, 16
#: Words held while counting; tokens a worker remembers.
HELD, CACHE = 100_000, 150_000
#: Longer tokens are read each time they come, so that what a worker remembers stays small.
REMEMBERED = 40
#: Bytes of text that are worked on together.
SLICE = 2 << 20
#: Log-probabilities the character model remembers.
MEMO = 1 << 17
#: What a character may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "*": "aeiou", "#": "aeiou", "%": "aeiou", "§": "s", "ß": "b"}
#: Characters that may only be fillers between letters, and log-probabilities of the channel.
FILLERS = set("._-*~'`,:;/\\|+=^#")
P_LEET, P_WILD, P_DROP, P_FOLD, P_KEEP_TWO, P_END = -1.0, -3.0, -0.3, -0.2, -1.0, -1.3
EDGE = "".join(map(chr, range(0x21, 0x30))) + ":;<=>?[\\]^_`{|}~«»“”„‘’…–—¿¡"
SPACED = re.compile(r"(?<![^\s])(?:[^\W_]|[@$!|*+])(?>[ ._\-*]{1,2}(?:[^\W_]|[@$!|*+])){3,}(?![^\s.,;:!?])")
DRAWN = re.compile(r"([^\W\d_])\1\1")


def context(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a * np.uint64(0x100000001B3) + b


def table_counts(words: list[str], n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed counts of trigrams and of their first two characters; a word begins with two line feeds and ends with one."""
    points = np.frombuffer(("\n\n" + "\n\n".join(words) + "\n").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    lens = np.fromiter(map(len, words), np.int64, len(words)) + 2
    weight = np.repeat(n, lens)
    size = len(points) - 2
    c = context(points[:size], points[1 : size + 1])
    ok = np.flatnonzero(~((points[1 : size + 1] == 10) & (points[:size] != 10)))  # not over a word's end
    weight = weight[: size][ok] if len(weight) >= size else np.pad(weight, (0, size - len(weight)))[ok]
    t = common.mix(c * np.uint64(0x9E3779B1) + points[2 : size + 2])[ok]
    tri = np.bincount((t >> np.uint64(64 - TRI_BITS)).astype(np.int64), weight, 1 << TRI_BITS)
    bi = np.bincount((common.mix(c[ok]) >> np.uint64(64 - BI_BITS)).astype(np.int64), weight, 1 << BI_BITS)
    return tri, bi


def count_characters(docs: DataFrame) -> DataFrame:
    """Character trigram counts (bucket, n) over all texts; buckets below 2**TRI_BITS are trigrams, above it contexts."""

    def run(batches):
        common.no_tool()
        seen: Counter = Counter()
        tri, bi = np.zeros(1 << TRI_BITS), np.zeros(1 << BI_BITS)

        def fold():
            words = list(seen)
            n = np.fromiter(seen.values(), np.float64, len(words))
            for at in range(0, len(words), 100_000):
                if part := words[at : at + 100_000]:
                    a, b = table_counts(part, n[at : at + 100_000])
                    np.add(tri, a, out=tri)
                    np.add(bi, b, out=bi)
            seen.clear()

        for b in common.slices(batches, most=SLICE):
            for text in common.texts(b):
                seen.update(LETTERS(text.lower()))
            if len(seen) > HELD:
                fold()
        fold()
        full = np.concatenate([tri, bi])
        at = np.flatnonzero(full)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(full[at], pa.float64())], ["bucket", "n"])

    return docs.select("text").mapInArrow(run, "bucket int, n double").groupBy("bucket").agg(F.sum("n").alias("n"))


class CharModel:
    def __init__(self, buckets: np.ndarray, n: np.ndarray):
        full = np.zeros((1 << TRI_BITS) + (1 << BI_BITS))
        full[buckets] = n
        self.tri, self.bi = full[: 1 << TRI_BITS].astype(np.float32), full[1 << TRI_BITS :].astype(np.float32)
        self.memo: dict[str, float] = {}

    def log(self, abc: str) -> float:
        """Log-probability of the third character after the first two, smoothed by one in a thousand contexts."""
        got = self.memo.get(abc)
        if got is None:
            m = (1 << 64) - 1
            a, b, c = map(ord, abc)
            ctx = (a * 0x100000001B3 + b) & m
            x = self.tri[mix(ctx * 0x9E3779B1 + c & m) >> (64 - TRI_BITS)]
            y = self.bi[mix(ctx) >> (64 - BI_BITS)]
            if len(self.memo) >= MEMO:
                self.memo.clear()
            got = self.memo[abc] = math.log((float(x) + 0.01) / (float(y) + 10.0))
        return got


def mix(x: int) -> int:
    """common.mix() of one number."""
    m = (1 << 64) - 1
    x = (x + 0x9E3779B97F4A7C15) & m
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & m
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & m
    return x ^ (x >> 31)


def lattice(token: str, ends: bool = False) -> list[list[tuple[str, float]]]:
    """For each run of a character, the strings it may stand for with their log-probabilities in the channel.

    With ends a filler may also be a line feed, which ends a word.
    """
    out, i = [], 0
    while i < len(token):
        c, j = token[i], i + 1
        while j < len(token) and token[j] == c:
            j += 1
        n, ways = j - i, []
        if c.isalpha():
            if n <= 2:
                ways.append((c * n, 0.0))
                if n == 2:
                    ways.append((c, -2.5))
            else:
                ways += [(c, P_FOLD), (c * 2, P_KEEP_TWO)]
        if c in LEET:
            options = LEET[c]
            p = P_WILD if len(options) > 2 else P_LEET
            for o in options:
                ways.append((o, p + (P_FOLD if n > 1 else 0.0)))
                if n == 2:
                    ways.append((o * 2, 2 * p))
        if c in FILLERS or not c.isalnum():
            ways.append(("", P_DROP))
            if ends:
                ways.append(("\n", P_END))
        if not ways:
            ways.append((c * min(n, 2), 0.0))
        out.append(ways)
        i = j
    return out


def decode(token: str, model: CharModel, ends: bool = False) -> tuple[str, float]:
    """The likeliest word behind a token, and its log-probability with its end; words between line feeds where ends allows several."""
    states: dict[str, tuple[float, tuple]] = {"\n\n": (0.0, ())}  # a reading is a chain of its pieces, last one first
    log = model.log
    for ways in lattice(token, ends):
        after: dict[str, tuple[float, tuple]] = {}
        for two, (p, said) in states.items():
            for way, q in ways:
                s, r = two, p + q
                for ch in way:
                    if ch != "\n":
                        r += log(s + ch)
                        s = s[1] + ch
                    elif s != "\n\n":
                        r += log(s + ch)
                        s = "\n\n"
                if s not in after or r > after[s][0]:
                    after[s] = (r, (way, said))
        states = after
    best, said = max(((p + (log(s + "\n") if s != "\n\n" or not ends else 0.0), w) for s, (p, w) in states.items()), key=lambda x: x[0])
    out = []
    while said:
        out.append(said[0])
        said = said[1]
    return "".join(reversed(out)), best


def words_of(token: str, model: CharModel) -> list[str]:
    """What a token (no white space) may say: the words in it as they stand, and the restored one."""
    t = token.lower()
    core = t.strip(EDGE)
    if core.isalpha() and not DRAWN.search(core):
        lead = t[: len(t) - len(t.lstrip(EDGE))]
        tail = t[len(lead) + len(core) :]
        if (len(tail) > 1 or tail not in ("$", "@", "!", "|")) and lead not in ("$", "@", "!", "|"):
            return [core]
    plain = LETTERS(t)
    if not plain:
        return plain
    tail = t[-1:]
    whole = t.strip("\"'()[]{}<>,.;:?") if tail in "$@!|" else core
    n = sum(map(str.isalpha, whole))
    if n < 1 or 3 * n < len(re.sub(r"(.)\1+", r"\1", whole)):
        return plain
    word, _ = decode(whole, model)
    found = [*plain, word]
    if any(c in FILLERS or not c.isalnum() for c in whole):
        found += [w for w in decode(whole, model, ends=True)[0].split("\n") if w]
    if whole != core and core:
        found.append(core if core.isalpha() and not DRAWN.search(core) else decode(core, model)[0])
    return found


def unspaced(text: str, model: CharModel) -> list[str]:
    """Words whose letters stand apart, where the model likes them better joined.

    The gaps do not tell where a word begins, and trigrams do not know words: what begins at each letter is read too, as
    far as features reach. A letter that repeats the one before it begins nothing else. What a piece says is decoded once
    a text, and pieces are of bounded length, so that time grows with the text and not with its square.
    """
    out: dict[str, None] = {}
    read: dict[str, tuple[str, float]] = {}

    def said(part: str) -> tuple[str, float]:
        if part not in read:
            read[part] = decode(part, model)
        return read[part]

    for m in SPACED.finditer(text):
        letters = DRAWN_OUT.sub(r"\1\1\1", re.sub(r"[ ._\-]", "", m[0].lower()))
        alone = np.concatenate([[0.0], np.cumsum([said(c)[1] for c in letters])])
        for at in range(max(1, len(letters) - PREFIXES[0] + 1)):
            if at and letters[at] == letters[at - 1]:
                continue
            part = letters if not at and len(letters) <= LONG else found[0] if (found := REACH.match(letters, at)) else letters[at : at + LONG]
            word, p = said(part)
            if p > alone[at + len(part)] - alone[at]:
                out[word] = None
    return list(out)


def features(words: list[str]) -> list[str]:
    """A restored word's features: itself, and its beginnings."""
    out = []
    for w in words:
        out.append(f"={w}")
        out += [w[:n] for n in PREFIXES if len(w) >= n]
    return out


def of_text(text: str, model: CharModel, memo: dict[str, list[str]]) -> set[str]:
    out: set[str] = set()
    for token in set(text.split()):
        got = memo.get(token)
        if got is None:
            got = features(words_of(token, model))
            if len(token) <= REMEMBERED:
                memo[token] = got
        out.update(got)
    for w in unspaced(text, model):
        out.update(features([w]))
    return out


def fit(rows: list[np.ndarray], labels: np.ndarray, n: int) -> tuple[np.ndarray, float]:
    """Logistic regression on sets of features by Newton's method, with an L2 penalty; n is at most FEATURES."""
    x = np.zeros((len(rows), n + 1), np.float32)  # factors in the same precision: no copy of it is made in another
    x[:, n] = 1
    for i, r in enumerate(rows):
        x[i, r] = 1
    penalty = np.full(n + 1, RIDGE)
    penalty[n] = 1e-6
    w = np.zeros(n + 1)
    w[n] = np.log((labels.sum() + 0.5) / (len(labels) - labels.sum() + 0.5))
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip((x @ w.astype(np.float32)).astype(np.float64), -30, 30)))
        r = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((x * r[:, None].astype(np.float32)).T @ x + np.diag(penalty), x.T @ (labels - p).astype(np.float32) - penalty * w)
        w += np.clip(step, -2, 2)
    return w[:n], float(w[n])


def surprise(a: float, b: float, n_a: float, n_b: float) -> float:
    """Log-likelihood ratio of a feature found in a of n_a toxic and b of n_b clean documents; 0 if it isn't toxic ones it is for."""
    if a * n_b <= LIFT * b * n_a:
        return 0.0
    share = n_a / (n_a + n_b)
    return 2 * (a * math.log(a / ((a + b) * share)) + (b * math.log(b / ((a + b) * (1 - share))) if b else 0.0))


def train(docs: DataFrame, labels: DataFrame, model: CharModel) -> tuple[dict[str, float], float]:
    """Weights by feature, and the base; docs (doc_id, text), labels (doc_id, toxic)."""
    spark = docs.sparkSession
    share = spark.sparkContext.broadcast(model)
    one = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    sample = one.where("toxic").orderBy(*order).limit(SAMPLE_TOXIC).unionAll(one.where("not toxic").orderBy(*order).limit(SAMPLE_CLEAN))

    def read(batches):
        common.no_tool()
        memo: dict[str, list[str]] = {}
        for b in common.slices(batches, most=SLICE):
            if len(memo) > CACHE // 8:
                memo.clear()
            found = [sorted(of_text(t, share.value, memo)) for t in common.texts(b)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(found, pa.list_(pa.string()))], ["doc_id", "toxic", "f"])

    # The sample has a bounded number of rows; its ids are small enough to send.
    rows = common.cut(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "text", "toxic").mapInArrow(read, "doc_id long, toxic boolean, f array<string>"))
    size = dict(map(tuple, rows.groupBy("toxic").count().collect()))
    a, b = size.get(True, 0), size.get(False, 0)
    if not a or not b:
        return {}, -30.0
    toxic = rows.where("toxic").select(F.explode("f").alias("f")).groupBy("f").agg(F.count("*").alias("a")).where(F.col("a") >= MIN_DOCS)
    top = toxic.orderBy(F.desc("a"), "f").limit(CANDIDATES)
    clean = rows.where("not toxic").select(F.explode("f").alias("f")).join(F.broadcast(top), "f").groupBy("f").agg(F.count("*").alias("b"))
    counted = top.join(clean, "f", "left").select("f", "a", F.coalesce("b", F.lit(0)).alias("b")).collect()
    chosen = sorted(((surprise(r.a, r.b, a, b), r.f) for r in counted), key=lambda x: (-x[0], x[1]))[:FEATURES]
    chosen = [x for x in chosen if x[0] >= SURPRISE]
    if not chosen:
        return {}, -30.0
    names = sorted(f for _, f in chosen)
    place = {f: i for i, f in enumerate(names)}
    held = F.array_intersect("f", F.lit(names))
    data = rows.select("toxic", held.alias("f")).collect()
    w, base = fit([np.array([place[f] for f in r.f], np.int64) for r in data], np.array([float(r.toxic) for r in data]), len(names))
    return {f: float(x) for f, x in zip(names, w)}, base


class Scorer:
    def __init__(self, model: CharModel, weights: dict[str, float], base: float):
        self.model, self.base = model, base
        names = sorted(weights)
        self.place = {f: i for i, f in enumerate(names)}
        self.weights = [weights[f] for f in names]
        self.memo: dict[str, tuple[int, ...]] = {}

    def ids(self, words: list[str]) -> tuple[int, ...]:
        get = self.place.get
        return tuple(sorted({i for f in features(words) if (i := get(f)) is not None}))

    def score(self, text: str) -> float:
        memo, hits = self.memo, set()
        for token in text.split():
            got = memo.get(token)
            if got is None:
                if len(memo) > CACHE:
                    memo.clear()
                got = self.ids(words_of(token, self.model))
                if len(token) <= REMEMBERED:
                    memo[token] = got
            if got:
                hits.update(got)
        for w in unspaced(text, self.model):
            hits.update(self.ids([w]))
        z = self.base + sum(self.weights[i] for i in sorted(hits))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def character_model(docs: DataFrame) -> CharModel:
    counts = count_characters(docs).toPandas()  # at most 2**TRI_BITS + 2**BI_BITS rows
    return CharModel(counts["bucket"].to_numpy(np.int64), counts["n"].to_numpy())


def score(docs: DataFrame, labels: DataFrame, name: str = "score") -> DataFrame:
    """docs with the column `name` added (one of that name is replaced); labels (doc_id, toxic) teaches."""
    from pyspark.sql import types as T

    model = character_model(docs)
    weights, base = train(docs, labels, model)
    held = docs.sparkSession.sparkContext.broadcast(Scorer(model, weights, base))
    key = f"toxicity {held._jbroadcast.id()}"
    kept = [f for f in docs.schema.fields if f.name.lower() != name.lower()]
    schema = T.StructType([*kept, T.StructField(name, T.DoubleType())])

    def run(batches):
        tool = common.tool(key, lambda: copy.copy(held.value))
        tool.memo = {} if tool.memo is held.value.memo else tool.memo  # the broadcast's own stays empty
        for b in common.slices(batches, most=SLICE):
            out = pa.array([tool.score(t) for t in common.texts(b)], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, out], schema=pa.schema([*b.schema, pa.field(name, pa.float64())]))

    return docs.select([f"`{f.name}`" for f in kept]).mapInArrow(run, schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", common.held_out(3, 1).alias("held_out"), "text")
    labels = common.table(spark, sf_dir, "labels").where(~common.held_out(3, 1)).select("doc_id", "toxic")
    return score(docs, labels).select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
