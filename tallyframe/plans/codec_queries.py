"""Round trips of the record codecs over table rows, and their SQL: what comes back is what went in."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tallyframe.sources import codecs
from tallyframe.sources.tables import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def through(df, schema: str, convert):
    """df's rows, through convert (a row's values to the result's), in Arrow batches."""

    def run(batches):
        for b in batches:
            rows = [convert(*values) for values in zip(*(c.to_pylist() for c in b.columns))]
            columns = list(zip(*rows)) or [()] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], fields)

    kinds = {"long": pa.int64(), "string": pa.string(), "int": pa.int32()}
    fields, types = zip(*((name, kinds[kind]) for name, kind in (x.split() for x in schema.split(", "))))
    return df.mapInArrow(run, schema)


def texts(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", "text")


def digest(data: bytes) -> str:
    return hashlib.md5(data).hexdigest()


@query("SELECT doc_id, (octet_length(encode(text)) + 1) // 2 AS words, md5(text) AS md5 FROM documents WHERE text IS NOT NULL")
def word_rle_roundtrip(spark, d):
    def convert(doc_id, text):
        raw = text.encode()
        words = np.frombuffer(raw + b"\0" * (len(raw) % 2), "<u2").tolist()
        back = codecs.word_rle_decode(codecs.word_rle_encode(words))
        return doc_id, len(back), digest(np.array(back, "<u2").tobytes()[: len(raw)])

    return through(texts(spark, d), "doc_id long, words long, md5 string", convert)


@query("SELECT doc_id, octet_length(encode(text)) AS n, md5(text) AS md5 FROM documents WHERE text IS NOT NULL")
def huffman_roundtrip(spark, d):
    def convert(doc_id, text):
        raw = text.encode()
        counts = Counter(raw)
        codec = codecs.Huffman([counts[i] for i in range(256)])
        back = codec.decode(*codec.encode(raw))
        return doc_id, len(back), digest(back)

    return through(texts(spark, d), "doc_id long, n long, md5 string", convert)


@query("SELECT doc_id, len(string_split(text, chr(10))) AS records, md5(text) AS md5 FROM documents WHERE text IS NOT NULL")
def text_records_roundtrip(spark, d):
    def convert(doc_id, text):
        back = codecs.text_records(codecs.text_encode(text.encode().split(b"\n")))
        return doc_id, len(back), digest(b"\n".join(back))

    return through(texts(spark, d), "doc_id long, records long, md5 string", convert)


@query("SELECT p_partkey, p_size % 20 + 1 AS width, p_partkey % 9 + 1 AS height, CAST(CASE WHEN p_partkey % 2 = 0 THEN 24 ELSE 8 END AS BIGINT) AS bits, CAST(((p_size % 20 + 1) * CASE WHEN p_partkey % 2 = 0 THEN 24 ELSE 8 END + 31) // 32 * 4 AS BIGINT) AS row_bytes, CAST(CASE WHEN p_partkey % 2 = 0 THEN 0 ELSE 256 END AS BIGINT) AS colors FROM part")
def bmp_metrics(spark, d):
    def convert(key, size):
        width, height, bits = size % 20 + 1, key % 9 + 1, 24 if key % 2 == 0 else 8
        row = (width * bits + 31) // 32 * 4
        got = codecs.bmp_parse(codecs.bmp_encode(width, height, bits, b"" if bits == 24 else bytes(1024), bytes(row * height)))
        return key, got["width"], got["height"], got["bits"], got["row"], got["colors"]

    return through(table(spark, d, "part").select("p_partkey", F.col("p_size").cast("long")), "p_partkey long, width long, height long, bits long, row_bytes long, colors long", convert)


@query("SELECT p_partkey, p_size % 5 + 1 AS width, p_partkey % 4 + 1 AS height, (p_size % 5 + 1) * (p_partkey % 4 + 1) * 3 * (p_partkey % 256) AS total FROM part")
def ppm_decode(spark, d):
    def convert(key, size):
        width, height, value = size % 5 + 1, key % 4 + 1, key % 256
        n = width * height * 3
        body = b" ".join([b"%d" % value] * n) + b"\n" if key % 2 else bytes([value]) * n
        got = codecs.ppm_parse(b"P%d\n# made\n%d %d\n255\n" % (3 if key % 2 else 6, width, height) + body)
        return key, got["width"], got["height"], sum(got["pixels"])

    return through(table(spark, d, "part").select("p_partkey", F.col("p_size").cast("long")), "p_partkey long, width long, height long, total long", convert)


RECORD = (("key", "u32"), ("name", "text"), ("sizes", "u16[]"))


@query("SELECT p_partkey, p_name AS name, p_size * 3 AS total FROM part")
def record_roundtrip(spark, d):
    def convert(key, name, size):
        got, end = codecs.record(codecs.record_encode({"key": key, "name": name, "sizes": [size, size, size]}, RECORD), RECORD)
        return got["key"], got["name"], sum(got["sizes"])

    return through(table(spark, d, "part").select("p_partkey", "p_name", F.col("p_size").cast("long")), "p_partkey long, name string, total long", convert)


@query("SELECT o_orderkey, o_custkey AS a, o_orderkey % 1000 AS b FROM orders")
def pointer_roundtrip(spark, d):
    def convert(key, customer):
        a, b = codecs.pointer_words(codecs.pointer_encode([customer, key % 1000]))
        return key, a, b

    return through(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey long, a long, b long", convert)


@query("SELECT doc_id, octet_length(encode(text)) AS n, md5(text) AS md5 FROM documents WHERE text IS NOT NULL")
def save_roundtrip(spark, d):
    def convert(doc_id, text):
        got = codecs.save_parse(codecs.save_encode(text.encode(), b"made" if doc_id % 2 else None))
        return doc_id, len(got["payload"]), digest(got["payload"])

    return through(texts(spark, d), "doc_id long, n long, md5 string", convert)
