"""Decoders and encoders of structured binary records.

Plain functions on bytes raise CodecError with a reason; decoded() applies one to a binary column in Arrow batches and
puts reasons into a column of their own, so one damaged record never fails a job.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class CodecError(ValueError):
    """A record that breaks its format; the message is a short reason."""


def need(ok: bool, reason: str) -> None:
    if not ok:
        raise CodecError(reason)


def u32(data: bytes, at: int, signed: bool = False) -> int:
    need(0 <= at and at + 4 <= len(data), "truncated")
    return int.from_bytes(data[at : at + 4], "little", signed=signed)


# Words in runs: a count of words, then tokens; a token with bit 7 repeats one word, another holds literal words.
LONGEST_RUN = 127


def word_rle_encode(words: Sequence[int]) -> bytes:
    out, i, n = [struct.pack("<I", len(words))], 0, len(words)
    while i < n:
        j = i + 1
        while j < n and words[j] == words[i] and j - i < LONGEST_RUN:
            j += 1
        if j - i > 1:
            out.append(struct.pack("<BH", 0x80 | (j - i), words[i]))
        else:
            while j < n and j - i < LONGEST_RUN and not (j + 1 < n and words[j] == words[j + 1]):
                j += 1
            out.append(struct.pack(f"<B{j - i}H", j - i, *words[i:j]))
        i = j
    return b"".join(out)


def word_rle_decode(data: bytes) -> list[int]:
    total, at, out = u32(data, 0), 4, []
    while len(out) < total:
        need(at < len(data), "truncated token")
        token, n = data[at], data[at] & 0x7F
        need(n > 0, "empty token")
        at += 1
        if token & 0x80:
            need(at + 2 <= len(data), "truncated value")
            out += [int.from_bytes(data[at : at + 2], "little")] * n
            at += 2
        else:
            need(at + 2 * n <= len(data), "truncated literal")
            out += struct.unpack_from(f"<{n}H", data, at)
            at += 2 * n
    need(len(out) == total, "too many words")
    return out


# Save envelope: fixed values of its header.
SAVE_MAGIC, SAVE_VERSION, SAVE_TRAILER = 0x26677341, 0x0BAD0002, 256


def save_parse(data: bytes) -> dict:
    need(u32(data, 0) == SAVE_MAGIC, "magic")
    need(u32(data, 8, signed=True) >= SAVE_VERSION, "version")
    size = u32(data, 12)
    need(16 + size <= len(data), "truncated payload")
    return {"declared": u32(data, 4), "version": u32(data, 8, signed=True), "payload": data[16 : 16 + size], "rest": data[16 + size :]}


def save_encode(payload: bytes, description: bytes | None = None) -> bytes:
    tail = b"" if description is None else description[: SAVE_TRAILER - 1].ljust(SAVE_TRAILER, b"\0")
    return struct.pack("<4I", SAVE_MAGIC, 16 + len(payload) + len(tail), SAVE_VERSION, len(payload)) + payload + tail


def character_parse(data: bytes) -> dict:
    need(len(data) >= 16, "truncated metadata")
    even = len(data) // 2 * 2
    return {"metadata": list(struct.unpack_from("<4I", data)), "packed": data[16:even], "ignored": data[even:]}


def character_encode(metadata: Sequence[int], packed: bytes) -> bytes:
    return struct.pack("<4I", *metadata) + packed + b"\0" * (len(packed) & 1)


#: Ranges of so many symbols or fewer are sorted by selection.
CUTOFF = 8


def falling(counts: Sequence[int]) -> list[int]:
    """Symbols by falling count, equal ones as the C runtime's quicksort of the format's time leaves them: the pivot is the
    middle one, brought to the front; short ranges are sorted by selection, the first of the least frequent going last."""
    order, todo = list(range(len(counts))), [(0, len(counts) - 1)]

    def swap(i: int, j: int) -> None:
        order[i], order[j] = order[j], order[i]

    while todo:
        first, last = todo.pop()
        if last - first < CUTOFF:
            for end in range(last, first, -1):
                swap(min(range(first, end + 1), key=lambda i: counts[order[i]]), end)
            continue
        swap(first + (last - first + 1) // 2, first)
        pivot, up, down = counts[order[first]], first, last + 1
        while True:
            up = next((i for i in range(up + 1, last + 1) if counts[order[i]] < pivot), last + 1)
            down = next((i for i in range(down - 1, first, -1) if counts[order[i]] > pivot), first)
            if down < up:
                break
            swap(up, down)
        swap(first, down)
        todo += [(first, down - 1), (up, last)]
    return order


class Huffman:
    """Byte codes from 256 counts. Symbols come in falling order of their counts; each is put into the lighter branch from
    the root down, branch one winning ties."""

    def __init__(self, counts: Sequence[int]):
        need(len(counts) == 256, "256 counts are needed")
        order = falling(counts)
        self.weight, self.symbol, self.zero, self.one = [counts[order[0]] + 1], [order[0]], [-1], [-1]
        for s in order[1:]:
            self._put(s, counts[s] + 1)
        self.codes: dict[int, tuple[int, int]] = {}
        stack = [(0, 0, 0)]
        while stack:
            node, code, length = stack.pop()
            if self.zero[node] < 0:
                self.codes[self.symbol[node]] = (code, length)
            else:
                stack += [(self.zero[node], code, length + 1), (self.one[node], code | 1 << length, length + 1)]

    def _node(self, weight: int, symbol: int) -> int:
        for to, v in ((self.weight, weight), (self.symbol, symbol), (self.zero, -1), (self.one, -1)):
            to.append(v)
        return len(self.weight) - 1

    def _put(self, symbol: int, weight: int) -> None:
        node = 0
        while self.zero[node] >= 0:
            self.weight[node] += weight
            node = self.one[node] if self.weight[self.one[node]] <= self.weight[self.zero[node]] else self.zero[node]
        old = self._node(self.weight[node], self.symbol[node])
        self.one[node], self.zero[node] = old, self._node(weight, symbol)
        self.weight[node] += weight

    def encode(self, data: bytes) -> tuple[bytes, int]:
        """The packed bits, lowest first, and how many they are."""
        # Whole bytes leave the number as they come, so that it stays short.
        out, acc, held, n = bytearray(), 0, 0, 0
        for b in data:
            code, length = self.codes[b]
            acc |= code << held
            held += length
            if held >= 512:
                whole = held // 8
                out += (acc & (1 << 8 * whole) - 1).to_bytes(whole, "little")
                acc, held, n = acc >> 8 * whole, held - 8 * whole, n + 8 * whole
        out += acc.to_bytes((held + 7) // 8, "little")
        return bytes(out), n + held

    def decode(self, packed: bytes, bits: int) -> bytes:
        need(bits <= 8 * len(packed), "truncated bits")
        out, node, steps = bytearray(), 0, {}
        # A byte is a step of its own: where it leads from a node, and what it says on the way, is remembered.
        for byte in packed[: bits // 8]:
            step = steps.get((node, byte))
            if step is None:
                step = steps[node, byte] = self._walk(node, byte, 8)
            out += step[0]
            node = step[1]
        if bits % 8:
            said, node = self._walk(node, packed[bits // 8], bits % 8)
            out += said
        need(node == 0, "unfinished code")
        return bytes(out)

    def _walk(self, node: int, byte: int, bits: int) -> tuple[bytes, int]:
        """The symbols that the lowest bits of a byte say from a node on, and the node they lead to."""
        out = bytearray()
        for i in range(bits):
            node = self.one[node] if byte >> i & 1 else self.zero[node]
            if self.zero[node] < 0:
                out.append(self.symbol[node])
                node = 0
        return bytes(out), node


def bmp_parse(data: bytes, contiguous: bool = False) -> dict:
    """Header, palette and pixels; contiguous: pixels follow the palette, whatever the offset says."""
    need(data[:2] == b"BM", "magic")
    need(len(data) >= 54, "truncated header")
    offset = u32(data, 10)
    header, width, height = u32(data, 14), u32(data, 18, True), u32(data, 22, True)
    bits, size, used = int.from_bytes(data[28:30], "little"), u32(data, 34), u32(data, 46)
    colors = used or {1: 2, 4: 16, 8: 256, 16: 0, 24: 0, 32: 0}.get(bits, -1)
    need(colors >= 0, "bit count")
    row = (width * bits + 31) // 32 * 4
    size = size or row * height
    need(width >= 0 and height >= 0 and size >= 0, "dimensions")
    start = 54 + 4 * colors if contiguous else offset
    need(54 + 4 * colors <= start and start + size <= len(data), "truncated pixels")
    return {"header": header, "width": width, "height": height, "bits": bits, "colors": colors, "row": row, "palette": data[54 : 54 + 4 * colors], "pixels": data[start : start + size]}


def bmp_encode(width: int, height: int, bits: int, palette: bytes, pixels: bytes) -> bytes:
    start = 54 + len(palette)
    return struct.pack("<2sIHHI", b"BM", start + len(pixels), 0, 0, start) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, bits, 0, len(pixels), 0, 0, len(palette) // 4, 0) + palette + pixels


def ppm_parse(data: bytes) -> dict:
    """P3 or P6 in a narrow grammar: comment lines only after the magic, at column 0; the greatest value is not read."""
    line = data[:99].split(b"\n", 1)[0]
    magic = line[:2]
    if magic not in (b"P3", b"P6"):
        return {"magic": magic.decode("latin-1"), "width": 0, "height": 0, "pixels": b""}
    at = len(line) + 1

    def next_line() -> bytes:
        nonlocal at
        need(at < len(data), "truncated header")
        end = data.find(b"\n", at, at + 99)
        end = min(len(data), at + 99) if end < 0 else end + 1
        got, at = data[at:end], end
        return got

    got = next_line()
    while got.startswith(b"#"):
        got = next_line()
    size = got.split()
    need(len(size) >= 2 and all(x.lstrip(b"+-").isdigit() for x in size[:2]), "dimensions")
    width, height = int(size[0]), int(size[1])
    need(width > 0 and height > 0 and width * height * 3 < 1 << 31, "dimensions")
    next_line()
    n = width * height * 3
    if magic == b"P6":
        need(at + n <= len(data), "truncated pixels")
        pixels = data[at : at + n]
    else:
        values = data[at:].split(None, n)[:n]
        need(len(values) == n and all(v.lstrip(b"+-").isdigit() for v in values), "truncated pixels")
        pixels = bytes(int(v) & 0xFF for v in values)
    return {"magic": magic.decode(), "width": width, "height": height, "pixels": pixels}


def radial_parse(data: bytes) -> dict:
    """Outer radius, size, inner radius and a square of signed pairs in row-major order."""
    outer, n, inner = u32(data, 0), u32(data, 4), u32(data, 8)
    need(12 + 4 * n * n <= len(data), "truncated cells")
    cells = np.frombuffer(data, "<i2", 2 * n * n, 12).reshape(n, n, 2).tolist()
    return {"outer": outer, "inner": inner, "cells": cells}


def radial_encode(outer: int, inner: int, cells: list) -> bytes:
    return struct.pack("<3I", outer, len(cells), inner) + np.array(cells, "<i2").tobytes()


def text_records(data: bytes) -> list[bytes]:
    """Records that each end with a carriage return and one byte that is not looked at."""
    need(bool(data), "empty")
    out, at = [], 0
    while at < len(data):
        end = data.find(b"\r", at)
        need(end >= 0, "no carriage return")
        need(end + 1 < len(data), "no byte after the carriage return")
        out.append(data[at:end])
        at = end + 2
    return out


def text_encode(records: Sequence[bytes]) -> bytes:
    need(all(b"\r" not in r for r in records), "carriage return in a record")
    return b"".join(r + b"\r\n" for r in records)


def item_ids(data: bytes) -> list[int]:
    """16-bit ids; an odd last byte is ignored."""
    return list(struct.unpack_from(f"<{len(data) // 2}H", data))


def pointer_words(data: bytes) -> list[int]:
    """A 16-bit count, 0xffff for a 32-bit one after it, and 32-bit words."""
    need(len(data) >= 2, "truncated count")
    n, at = int.from_bytes(data[:2], "little"), 2
    if n == 0xFFFF:
        n, at = u32(data, 2), 6
    need(at + 4 * n <= len(data), "truncated words")
    return list(struct.unpack_from(f"<{n}I", data, at))


def pointer_encode(words: Sequence[int]) -> bytes:
    n = len(words)
    head = struct.pack("<H", n) if n < 0xFFFF else struct.pack("<HI", 0xFFFF, n)
    return head + struct.pack(f"<{n}I", *words)


# Resource tree: fixed values of its header and flags.
RES_TAG, RES_DIRECTORY, RES_DISABLED = 0x31415926, 0x1, 0x20000000


def res_parse(data: bytes, directory_flag: int = RES_DIRECTORY) -> list[dict]:
    """All records under the root with their paths; directories first name their children by index and count."""
    need(u32(data, 0) == RES_TAG, "magic")
    first, count, index, total = u32(data, 4), u32(data, 8), u32(data, 16), u32(data, 20)
    need(index + 32 * total <= len(data) and first + count <= total, "index")
    out, stack = [], [("", first, count)]
    seen = 0
    while stack:
        path, first, count = stack.pop()
        for i in range(first, first + count):
            seen += 1
            need(i < total and seen <= total, "child")
            at = index + 32 * i
            value, size, flags = u32(data, at + 4), u32(data, at + 8), u32(data, at + 12)
            name = path + data[at + 16 : at + 32].split(b"\0")[0].decode("latin-1")
            if flags & directory_flag:
                stack.append((name + "/", value, size))
            else:
                need(value + size <= len(data), "payload")
                out.append({"path": name, "offset": value, "size": size, "disabled": bool(flags & RES_DISABLED)})
    return sorted(out, key=lambda r: r["path"].lower())


def suppressed(listing: bytes) -> list[str]:
    """Paths of a suppression list; reading stops at the first line that does not begin with a printable character."""
    out = []
    for line in listing.split(b"\n"):
        if not line or not 0x20 < line[0] < 0x7F:
            break
        out.append(line.rstrip(b"\r").decode("latin-1"))
    return out


def sections(text: str) -> dict[str, list[str]]:
    """[name] sections; lines under two characters or with a leading ; are skipped, a later section of a name replaces the earlier."""
    out: dict[str, list[str]] = {}
    now: list[str] | None = None
    for line in text.splitlines():
        if len(line) < 2 or line.startswith(";"):
            continue
        if line.startswith("[") and "]" in line:
            now = out[line[1 : line.index("]")]] = []
        elif now is not None:
            now.append(line)
    return out


#: Widths of the record decoder's field types.
FIELDS = {"u8": "B", "i8": "b", "u16": "H", "i16": "h", "u32": "I", "i32": "i", "f32": "f", "f64": "d"}


def record(data: bytes, schema: Sequence[tuple[str, str]], at: int = 0) -> tuple[dict, int]:
    """One record of ordered fields and the place after it. Types: FIELDS, text (1, 3 or 7 byte length prefix), type[] (counted)."""
    out = {}
    for name, kind in schema:
        if kind == "text":
            need(at < len(data), "truncated text")
            n, at = data[at], at + 1
            if n == 0xFF:
                need(at + 2 <= len(data), "truncated text")
                n, at = int.from_bytes(data[at : at + 2], "little"), at + 2
                if n == 0xFFFF:
                    n, at = u32(data, at), at + 4
            need(at + n <= len(data), "truncated text")
            out[name], at = data[at : at + n].decode("latin-1"), at + n
        elif kind.endswith("[]"):
            need(at + 2 <= len(data), "truncated count")
            n, at = int.from_bytes(data[at : at + 2], "little"), at + 2
            if n == 0xFFFF:
                n, at = u32(data, at), at + 4
            code = FIELDS[kind[:-2]]
            width = n * struct.calcsize("<" + code)
            need(at + width <= len(data), "truncated array")
            out[name], at = list(struct.unpack_from(f"<{n}{code}", data, at)), at + width
        else:
            code = "<" + FIELDS[kind]
            need(at + struct.calcsize(code) <= len(data), "truncated field")
            out[name], at = struct.unpack_from(code, data, at)[0], at + struct.calcsize(code)
    return out, at


def record_encode(values: dict, schema: Sequence[tuple[str, str]]) -> bytes:
    out = []
    for name, kind in schema:
        v = values[name]
        if kind == "text":
            raw = v.encode("latin-1")
            n = len(raw)
            out.append((struct.pack("<B", n) if n < 0xFF else struct.pack("<BH", 0xFF, n) if n < 0xFFFF else struct.pack("<BHI", 0xFF, 0xFFFF, n)) + raw)
        elif kind.endswith("[]"):
            head = struct.pack("<H", len(v)) if len(v) < 0xFFFF else struct.pack("<HI", 0xFFFF, len(v))
            out.append(head + struct.pack(f"<{len(v)}{FIELDS[kind[:-2]]}", *v))
        else:
            out.append(struct.pack("<" + FIELDS[kind], v))
    return b"".join(out)


def bgr(pixel: Column, shifts: tuple[int, int, int], widths: tuple[int, int, int]) -> Column:
    """Blue, green and red (array of three) of a packed 16-bit pixel, each widened to eight bits."""
    channel = lambda s, w: F.shiftleft(F.shiftright(pixel, s).bitwiseAND(F.lit((1 << w) - 1)), 8 - w)
    return F.array(*[channel(s, w) for s, w in zip(shifts, widths)])


def decoded(df: DataFrame, column: str, parse: Callable[[bytes], object]) -> DataFrame:
    """df with value (the parsed record as JSON, bytes in hexadecimal) and error (null if it parsed)."""

    @F.pandas_udf("value string, error string")
    def run(blobs: pd.Series) -> pd.DataFrame:
        values, errors = [], []
        for b in blobs:
            try:
                values.append(None if b is None else json.dumps(parse(bytes(b)), default=lambda x: x.hex()))
                errors.append(None)
            except CodecError as e:
                values.append(None)
                errors.append(str(e))
        return pd.DataFrame({"value": values, "error": errors})

    return df.withColumn("_parsed", run(column)).select(*df.columns, "_parsed.value", "_parsed.error")
