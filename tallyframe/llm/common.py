"""Helpers the training-data operators share: reading tables, cutting lineage, Arrow columns, word hashing."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words end at these bytes only: space and \x09-\x0D, which is also what bytes.split() splits at.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of one Arrow batch that are worked on together, by bytes of text.
SLICE_BYTES = 8 << 20
#: Bytes of a row group of tables between steps: a task's writer holds as much.
ROW_GROUP = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder driver and executors share; a temporary one only where the session names none and is a local one."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tallyframe-"))
    return named or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there, so a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stash(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it from there; the table goes when the driver's JVM ends."""
    spark = df.sparkSession
    at = f"{shared_dir(spark).rstrip('/')}/tallyframe-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", ROW_GROUP).parquet(at)
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(at)


def remove(spark: SparkSession, at: str) -> None:
    """Delete a folder of the shared file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_tool: dict = {}


def tool(key, make):
    """What a Python worker keeps from task to task under the key; a worker keeps one such thing, as they take memory."""
    if key not in _tool:
        no_tool()
        _tool[key] = make()
    return _tool[key]


def no_tool() -> None:
    """For tasks that need no such thing, and the memory for themselves."""
    if _tool:
        _tool.clear()
        gc.collect()
    give_back()


def give_back() -> None:
    """Free memory that the allocators of this process hold goes back to the machine."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def held_out(n: int, r: int):
    """crc32 of doc_id as text, modulo n, is r; a null doc_id is hashed as the empty text."""
    return (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % n) == r


def slices(batches, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about `most` bytes of the column, one row at least."""
    for b in batches:
        if not b.num_rows:
            continue
        col = b.column(b.schema.get_field_index(column))
        ends = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(col), 0), dtype=np.int64))
        at = 0
        while at < b.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield b.slice(at, to - at)
            at = to
        if at and ends[-1] > most // 2:  # what was made of a large batch does not stay
            del b, col
            give_back()


def texts(b: pa.RecordBatch, column: str = "text") -> list[str]:
    """The column's values, null as the empty text."""
    return ["" if x is None else x for x in b.column(b.schema.get_field_index(column)).to_pylist()]


def blobs(b: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The column's values as UTF-8 bytes, null as none."""
    col = b.column(b.schema.get_field_index(column)).cast(pa.binary())
    return [x or b"" for x in col.to_pylist()]


MIX1, MIX2, ODD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads every input bit over the whole word."""
    x = x + ODD
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


_powers: dict[int, np.ndarray] = {}
#: Powers that are kept for the next batch, of each base.
KEPT = 1 << 16


def powers(base: int, n: int, prime: int = 0) -> np.ndarray:
    """base**0 .. base**(n-1), modulo the prime if one is named (below 2**31), else modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 10)
        with np.errstate(over="ignore"):
            if prime:
                have = np.ones(size, np.uint64)
                at = 1
                while at < size:
                    some = have[: min(at, size - at)]
                    have[at : at + len(some)] = some * np.uint64(pow(base, at, prime)) % np.uint64(prime)
                    at *= 2
            else:
                have = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, base & (2**64 - 1), np.uint64)]))
        _powers[base] = have if size <= KEPT else have[:KEPT].copy()
    return have[:n]


R_WORD, R_WORD2 = 0xD6E8FEB86659FD93 | 1, 0xA0761D6478BD642F
#: Primes, and a base for each, of the polynomials over a word's bytes: over a field words of n bytes that differ agree for
#: n of the bases at most, which modulo a power of two is not so.
BYTES = ((2_147_483_647, 1_583_458_089), (2_147_483_629, 784_588_716))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_hashes(docs: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit content hash of every word of the documents, and where each document's words begin (len(docs)+1).

    A word's hash is two polynomials over its bytes, modulo two primes, mixed; it is the same in every process.
    """
    data = np.frombuffer(b" ".join(docs) + b" ", np.uint8)
    if lower:
        data = _LOWER[data]
    space = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    lens = np.fromiter((len(d) + 1 for d in docs), np.int64, len(docs))
    bounds = np.searchsorted(starts, np.concatenate([[0], np.cumsum(lens)]))
    # Every word is summed with powers counted from its own start, so equal words agree wherever they stand.
    word_of = np.repeat(np.arange(len(starts)), ends - starts)
    inside = np.flatnonzero(~space)
    offset = inside - starts[word_of]
    top = int(offset.max()) + 1 if len(offset) else 1
    if not len(starts):
        return np.zeros(0, np.uint64), bounds
    values = data[inside].astype(np.uint64)
    values += np.uint64(1)
    first = np.concatenate([[0], np.cumsum(ends - starts)[:-1]])
    # A term is below 2**39, so that sums are exact for words of up to 32 MB; longer ones are reduced on the way.
    out = np.zeros(len(starts), np.uint64)
    for shift, (prime, base) in zip((0, 32), BYTES):
        terms = values * powers(base, top, prime)[offset]
        if top > 1 << 24:
            terms %= np.uint64(prime)
        out |= np.add.reduceat(terms, first) % np.uint64(prime) << np.uint64(shift)
    return mix(out), bounds


_inverses: dict[int, int] = {}


def window_hashes(words: np.ndarray, k: int, base: int = R_WORD) -> np.ndarray:
    """Hash of every run of k consecutive values (len-k+1 of them), also over document edges: callers mask those."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n].copy()
    b = np.uint64(base)
    for j in range(1, k):
        out *= b
        out += words[j : j + n]
    return mix(out)


def rolling_hashes(words: np.ndarray, k: int, base: int = R_WORD) -> np.ndarray:
    """As window_hashes, in time independent of k: prefix sums with falling powers (an odd base has an inverse)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    inverse = _inverses.setdefault(base, pow(base, -1, 1 << 64))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers(inverse, len(words)), dtype=np.uint64)])
    return mix((total[k:] - total[:-k]) * powers(base, len(words))[k - 1 :][:n])
