import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tallyframe.sources import codecs as c


@given(st.lists(st.integers(0, 3) | st.integers(0, 65535), max_size=600))
def test_word_rle_round_trip(words):
    assert c.word_rle_decode(c.word_rle_encode(words)) == words


def test_word_rle_tokens():
    assert c.word_rle_encode([7, 7, 7]) == b"\x03\0\0\0\x83\x07\0"
    assert c.word_rle_encode([1, 2]) == b"\x02\0\0\0\x02\x01\0\x02\0"
    assert len(c.word_rle_encode([5] * 128)) == 4 + 3 + 3
    for bad in (b"", b"\x01\0\0\0", b"\x01\0\0\0\0", b"\x01\0\0\0\x82\x01\0", b"\x02\0\0\0\x02\x01\0"):
        with pytest.raises(c.CodecError):
            c.word_rle_decode(bad)


def test_save_and_character():
    got = c.save_parse(c.save_encode(b"abc", b"note"))
    assert got["payload"] == b"abc" and len(got["rest"]) == 256 and got["declared"] == 16 + 3 + 256
    with pytest.raises(c.CodecError, match="magic"):
        c.save_parse(b"\0" * 16)
    with pytest.raises(c.CodecError, match="version"):
        c.save_parse(c.save_encode(b"")[:8] + b"\x01\0\0\x80" + b"\0\0\0\0")
    assert c.character_parse(c.character_encode([1, 2, 3, 4], b"xyz")) == {"metadata": [1, 2, 3, 4], "packed": b"xyz\0", "ignored": b""}
    assert c.character_parse(b"\0" * 17)["ignored"] == b"\0"


def test_huffman_round_trip():
    rnd = random.Random(5)
    for counts in ([0] * 256, list(range(256)), [rnd.randrange(1000) for _ in range(256)]):
        h = c.Huffman(counts)
        data = rnd.randbytes(300)
        packed, bits = h.encode(data)
        assert h.decode(packed, bits) == data
    assert sum(2.0 ** -n for _, n in h.codes.values()) == 1.0


def test_pictures():
    pixels = bytes(range(8))
    bmp = c.bmp_encode(2, 2, 8, b"\0" * 1024, pixels)
    got = c.bmp_parse(bmp)
    assert (got["width"], got["height"], got["row"], got["pixels"]) == (2, 2, 4, pixels)
    gap = bmp[:10] + (54 + 1024 + 5).to_bytes(4, "little") + bmp[14:1078] + b"12345" + pixels
    assert c.bmp_parse(gap)["pixels"] == pixels
    assert c.bmp_parse(gap, contiguous=True)["pixels"] == b"12345" + pixels[:3]
    assert c.ppm_parse(b"P3\n# note\n2 1\n255\n-1 256 3 4 5 6\n")["pixels"] == bytes([255, 0, 3, 4, 5, 6])
    assert c.ppm_parse(b"P6\n1 1\n255\nabcd")["pixels"] == b"abc"
    assert c.ppm_parse(b"GIF")["pixels"] == b""
    with pytest.raises(c.CodecError):
        c.ppm_parse(b"P6\n2 2\n255\nabc")
    cells = [[[1, -2], [3, 4]], [[5, 6], [-7, 8]]]
    assert c.radial_parse(c.radial_encode(9, 2, cells)) == {"outer": 9, "inner": 2, "cells": cells}


def test_texts_and_vectors():
    assert c.text_records(c.text_encode([b"a", b"", b"bc"])) == [b"a", b"", b"bc"]
    for bad in (b"", b"a", b"a\r"):
        with pytest.raises(c.CodecError):
            c.text_records(bad)
    assert c.item_ids(b"\x01\0\x02\0\x09") == [1, 2]
    for words in ([], [1, 2], [3] * 70000):
        assert c.pointer_words(c.pointer_encode(words)) == words
    assert c.suppressed(b"a/b\r\nc\n\x01x\nd\n") == ["a/b", "c"]
    assert c.sections("[a]\nxx\n;no\n[b]\nyy\n[a]\nzz\n") == {"a": ["zz"], "b": ["yy"]}


def test_resource_tree():
    record = lambda value, size, flags, name: (0).to_bytes(4, "little") + value.to_bytes(4, "little") + size.to_bytes(4, "little") + flags.to_bytes(4, "little") + name.ljust(16, b"\0")
    payload = b"hello"
    head = b"".join(x.to_bytes(4, "little") for x in (c.RES_TAG, 0, 2, 0, 24 + len(payload), 3))
    data = head + payload + record(2, 1, 1, b"dir") + record(24, 5, c.RES_DISABLED, b"off.txt") + record(24, 5, 0, b"a.txt")
    assert c.res_parse(data) == [{"path": "dir/a.txt", "offset": 24, "size": 5, "disabled": False}, {"path": "off.txt", "offset": 24, "size": 5, "disabled": True}]
    with pytest.raises(c.CodecError):
        c.res_parse(head + payload)


@given(st.integers(-(2**31), 2**31 - 1), st.text(st.characters(max_codepoint=255), max_size=300), st.lists(st.integers(0, 65535), max_size=50))
def test_records(n, text, values):
    schema = [("n", "i32"), ("name", "text"), ("values", "u16[]")]
    row = {"n": n, "name": text, "values": values}
    raw = c.record_encode(row, schema)
    assert c.record(raw, schema) == (row, len(raw))
    with pytest.raises(c.CodecError):
        c.record(raw[:-1], schema) if values or text else c.record(raw[:3], schema)


def test_decoded_column(spark):
    df = spark.createDataFrame([(1, bytearray(c.word_rle_encode([4, 4]))), (2, bytearray(b"\1")), (3, None)], "id int, data binary")
    rows = {r.id: (r.value, r.error) for r in c.decoded(df, "data", c.word_rle_decode).collect()}
    assert rows == {1: ("[4, 4]", None), 2: (None, "truncated"), 3: (None, None)}


def test_huffman_takes_time_as_the_text():
    import time

    raw = bytes(range(97, 123)) * 40_000
    codec, began = c.Huffman([raw.count(bytes([i])) for i in range(256)]), time.process_time()
    assert codec.decode(*codec.encode(raw)) == raw
    assert time.process_time() - began < 10
