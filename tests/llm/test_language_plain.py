"""Language identification against a plain version: counts in dictionaries, one document and one word at a time."""

import collections
import math
import re
import zlib

from tallyframe.llm import lang_id

SF = "/root/testdata/sf0.001"
M = 2**64 - 1


def bucket(gram):
    """A number of 15 bits, by the order of the gram."""
    h = 0
    for c in gram:
        h = (h * 0x100000001B3 + ord(c)) & M
    h = (h + 0x9E3779B97F4A7C15) & M
    h = ((h ^ h >> 30) * 0xBF58476D1CE4E5B9) & M
    h = ((h ^ h >> 27) * 0x94D049BB133111EB) & M
    return len(gram), (h ^ h >> 31) >> 49


def grams(word):
    s = f"\n{word}\n"
    return [bucket(s[i : i + n]) for n in (2, 3, 4) for i in range(len(s) - n + 1)]


def script(c):
    return next((name for name, a, b in lang_id.SCRIPTS if a <= ord(c) <= b), "other")


def words_of(text):
    return re.findall(r"[^\W\d_]+", (text or "").lower())


def plain(rows):
    """doc_id to (language, score)."""
    counts, letters = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for r in rows:
        if r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            for w in words_of(r.text):
                counts[r.lang].update(grams(w))
                letters[r.lang].update(map(script, w))
    langs = sorted(counts)
    total = {x: collections.Counter() for x in langs}
    for x in langs:
        for (n, _), k in counts[x].items():
            total[x][n] += k
    writes = {x: {s for s, k in letters[x].items() if k >= 0.001 * max(1, sum(letters[x].values()))} for x in langs}
    some = set().union(*writes.values())
    memo = {}

    def score(w):
        if w not in memo:
            s = script(w[0])
            memo[w] = [sum(math.log((counts[x][g] + 0.05) / (total[x][g[0]] + 0.05 * 2**15)) / 3 for g in grams(w)) - (60.0 if s in some and s not in writes[x] else 0.0) for x in langs]
        return memo[w]

    out = {}
    for r in rows:
        words = words_of(r.text)
        best, ways = [0.0] * len(langs), []
        for w in words:
            top = max(range(len(langs)), key=best.__getitem__)
            way = [k if not ways or best[k] >= best[top] - 9.0 else top for k in range(len(langs))]
            best = [best[way[k]] - (9.0 if way[k] != k else 0.0) + p for k, p in enumerate(score(w))]
            ways.append(way)
        share = collections.Counter()
        at = max(range(len(langs)), key=best.__getitem__)
        for w, way in zip(reversed(words), reversed(ways)):
            share[langs[at]] += len(w)
            at = way[at]
        lang = min(share, key=lambda x: (-share[x], x)) if share else "und"
        out[r.doc_id] = (lang, share[lang] / sum(share.values()) if share else 0.0)
    return out


def test_against_plain_code(spark):
    want = plain(spark.read.parquet(f"{SF}/documents.parquet").collect())
    got = {r.doc_id: (r.lang_pred, r.score) for r in lang_id.op1_language_id(spark, SF).collect()}
    assert got.keys() == want.keys()
    # The operator adds in single precision: a span's border may move by a word.
    assert {d: x[0] for d, x in got.items()} == {d: x[0] for d, x in want.items()}
    assert all(abs(got[d][1] - want[d][1]) < 0.05 for d in want) and sum(abs(got[d][1] - want[d][1]) < 1e-9 for d in want) > 0.97 * len(want)
