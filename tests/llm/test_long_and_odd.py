"""Every operator and stage on texts of a megabyte, and the values that odd rows get."""

import base64
import collections
import hashlib
import random
import time
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import bpe, decontaminate, html_text, lang_id, license_scan, near_dedup, quality, queries, substring_dedup, token_store, toxicity, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = {1: "a " * 500_000, 2: "word " * 200_000, 3: "s t u p i d " * 80_000, 4: "x" * 30_000, 5: " ".join(random.Random(1).choices(["alpha", "beta", "gamma", "delta"], k=150_000))}
SHORT = {6: "The short one, in plain words.", 7: "Ein kurzer Text auf Deutsch, mit Worten.", 8: "", 9: None}
TEXTS = LONG | SHORT


@pytest.fixture(scope="module")
def long_(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("long"))
    rows = [(d, t, "de" if d in (2, 7) else "en", "s", len(t or "")) for d, t in TEXTS.items()]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(d, 1, int(d in (3, 5))) for d in TEXTS], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    items = [(1, "word " * 40, "k"), (2, "a " * 2_000, "k"), (3, "alpha beta gamma delta " * 500, "k"), (4, "none of these words", "k")]
    spark.createDataFrame(items, "item_id long, text string, doc_id string").withColumn("coverage", F.lit("clash")).write.parquet(f"{at}/benchmark.parquet")
    pages = [(1, "http://h/" + "a/" * 400_000, "<article>" + "<p>word, </p>" * 60_000), (2, "x://" + "b." * 300_000 + "com/en/", "<div>" * 200_000 + "deep"), (3, "http://net/es/", "<" * 300_000)]
    spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("row", F.lit(3)).withColumn("text", F.lit("clash")).write.parquet(f"{at}/pages.parquet")
    return at


def timed(df):
    began = time.time()
    rows = df.collect()
    assert time.time() - began < 90
    return rows


def by_id(rows):
    out = {r.doc_id: r for r in rows}
    assert set(out) == set(TEXTS) and len(rows) == len(TEXTS)
    return out


def test_long_texts_language_and_toxicity(spark, long_):
    for r in timed(lang_id.op1_language_id(spark, long_)):
        assert 0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert (r.lang_pred == "und") == (r.doc_id in (8, 9)) and r.lang_pred in ("und", "en", "de")
    scores = by_id(timed(toxicity.op3_toxicity(spark, long_)))
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in scores.values())
    assert scores[8].score == scores[9].score


def test_long_texts_benchmark(spark, long_):
    rows = timed(decontaminate.op2_decontaminate(spark, long_))
    got = {(r.doc_id, r.item_id): r.coverage for r in rows}
    assert got[2, 1] == got[1, 2] == 1.0 and {d for d, i in got if i == 4} == set() and {d for d, _ in got} <= {1, 2, 5}


def test_long_texts_tokens(spark, long_):
    import tiktoken
    from tokenizers import Tokenizer

    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}, special_tokens={})
    for d, r in by_id(timed(bpe.op5_byte_bpe(spark, long_))).items():
        ids = np.array(library.encode_ordinary(TEXTS[d] or ""), "<u4")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((TEXTS[d] or "").encode()).hexdigest())
    t, start = Tokenizer.from_file(P.path("word_bpe_49k.json")), 0
    rows = by_id(timed(token_store.op8_token_store(spark, long_)))
    for d in sorted(TEXTS):
        ids = np.array([*t.encode(TEXTS[d] or "", add_special_tokens=False).ids, 1], "<u4")
        assert (rows[d].start, rows[d].n_tokens, rows[d].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_long_texts_repeats(spark, long_):
    words = {d: (t or "").split() for d, t in TEXTS.items()}
    for d, r in by_id(timed(quality.op6_quality_rules(spark, long_))).items():
        w = words[d]
        count = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        twice = {j for i in range(len(w) - 4) if count[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.base_failed) == (len(w), sum(map(len, w)), len(twice), len(w) < 10 or 100 * len(twice) > 20 * len(w))
    for d, r in by_id(timed(substring_dedup.op7_substring_dedup(spark, long_))).items():
        w = words[d]
        if d in (1, 2, 3):
            assert (r.n_words, r.n_removed) == (len(w), len(w))
        elif d != 5:
            assert (r.n_words, r.n_removed, r.kept_sha256) == (len(w), 0, hashlib.sha256(" ".join(w).encode()).hexdigest())
    sets = {d: len({tuple(w[i : i + 5]) for i in range(len(w) - 4)}) if len(w) >= 5 else int(bool(w)) for d, w in ((d, [x.lower() for x in w]) for d, w in words.items())}
    assert {d: (r.n_shingles, r.component_id) for d, r in by_id(timed(near_dedup.op9_near_dedup(spark, long_))).items()} == {d: (n, d) for d, n in sets.items()}
    assert {d: r.n_words for d, r in by_id(timed(license_scan.op13_license_scan(spark, long_))).items()} == {d: len(license_scan.plain_words(t or "")) for d, t in TEXTS.items()}


def test_long_pages(spark, long_):
    rows = {r.page_id: r for r in timed(html_text.op4_main_text(spark, long_))}
    assert rows[1].text == " ".join(["word,"] * 60_000) and rows[2].text == "deep" and rows[3].n_chars == len(rows[3].text)
    rows = {r.page_id: (len(r.host), len(r.path), r.rule, r.verdict) for r in timed(url_filter.op10_url_filter(spark, long_))}
    assert rows == {1: (1, 800_001, None, "allow"), 2: (600_003, 4, "com/", "allow"), 3: (3, 4, "net/es/", "block")}


@pytest.mark.parametrize("at", range(5))
def test_long_texts_in_stages(spark, long_, at):
    import corpus_pipeline

    name, stage = corpus_pipeline.STAGES[at]
    docs = spark.read.parquet(f"{long_}/documents.parquet")
    rows = by_id(timed(stage(spark, docs, long_))) if name in ("substring_dedup", "byte_bpe", "near_dedup") else {r.doc_id: r for r in timed(stage(spark, docs, long_))}
    if name == "decontaminate":
        assert {3, 4, 6, 7, 8, 9} <= set(rows) and not {1, 2} & set(rows)
    elif name == "substring_dedup":
        assert [rows[d].text for d in (1, 2, 3)] == [""] * 3 and all(rows[d].text == TEXTS[d] for d in (4, 6, 7, 8, 9))
    elif name == "toxicity":
        assert {6, 7, 8, 9} <= set(rows)


ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "!!! ..."), (5, "the same text of words here"), (5, "the same text of words here"), (None, "the same text of words here"), (6, "漢字 かな"), (6, "other words in a row")]


def test_values_of_odd_rows(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("odd"))
    rows = [(d, t, lang, "s", 0) for (d, t), lang in zip(ODD, ["en", None, "en", "en", "en", "en", None, "ja", "en"])]
    spark.createDataFrame(rows, DOCS).withColumn("lang_pred", F.lit("clash")).withColumn("score", F.lit(7)).withColumn("kept", F.lit("no")).write.parquet(f"{at}/documents.parquet")
    labels = spark.createDataFrame([(5, 1, 1), (5, 1, 1), (2, None, 0), (6, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    labels.withColumn("text", F.lit("clash")).withColumn("score", F.lit(3)).write.parquet(f"{at}/labels.parquet")
    got = collections.Counter((r.doc_id, r.held_out, r.lang_pred == "und") for r in lang_id.op1_language_id(spark, at).collect())
    held = lambda d, n, k: zlib.crc32(str(d).encode() if d is not None else b"") % n == k
    assert got == collections.Counter((d, held(d, 4, 2), not any(map(str.isalpha, t or ""))) for d, t in ODD)
    scored = toxicity.op3_toxicity(spark, at).collect()
    assert collections.Counter((r.doc_id, r.held_out) for r in scored) == collections.Counter((d, held(d, 3, 1)) for d, _ in ODD)
    assert len({r.score for r in scored if r.doc_id in (1, 2, 3)}) == 1 and len({r.score for r in scored if r.doc_id == 5}) == 1
    judged = quality.op6_quality_rules(spark, at).collect()
    count = lambda t: len((t or "").split())
    assert collections.Counter((r.doc_id, r.n_words, r.n_repeat_words, r.base_failed, r.kept) for r in judged) == collections.Counter((d, count(t), 0, True, False) for d, t in ODD)
    assert set(queries.QUERIES) >= {"op1_language_id", "op13_license_scan"}
