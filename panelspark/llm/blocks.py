"""Helpers of the operators: Arrow columns as byte blocks, vectorised words and hashes, partition counts."""

from __future__ import annotations

import ctypes
import math
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

U64 = np.uint64
#: Bytes of text that one vectorised step holds; a longer document is a step of its own.
STEP_BYTES = 1 << 20
#: Bytes of text that one shuffled partition should hold.
PART_BYTES = 32 << 20


def texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text) of a documents table; a null text is empty, further columns are left out."""
    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))


def part_count(docs: DataFrame, column: str = "text", part_bytes: int = PART_BYTES) -> int:
    """Shuffle partitions for a table: the session's number, more when the bytes of ``column`` ask for it."""
    size = docs.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / part_bytes))


def remembered(key: str, make: Callable):
    """What ``make`` gives, once per worker process: functions travel by value, so their own globals don't outlive a task."""
    held = sys.modules.setdefault("_panelspark_worker", types.ModuleType("_panelspark_worker")).__dict__
    if key not in held:
        held[key] = make()
    return held[key]


def tidied(function: Callable) -> Callable:
    """``function`` for mapInArrow; after each task its worker, which waits for others, gives back the memory that is free."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
        if trim:
            trim(0)

    return run


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column without nulls, and where each value starts and ends."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.dtype(np.int64 if wide else np.int32)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind, len(column) + 1, column.offset * kind.itemsize).astype(np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return held[at[0] : at[-1]], at - at[0]


def steps(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds about ``limit`` bytes of text, or one document."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = utf8(batch.column(batch.schema.get_field_index(text)))
        low = 0
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(at, at[low] + limit, "right")) - 1)
            yield batch.slice(low, high - low)
            low = high


def integers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """An integer column without nulls as numpy."""
    return np.asarray(batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False), np.int64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x7FB5D329728EA185)
    x = x ^ (x >> U64(27))
    x = x * U64(0x81DADEF4BC2DD44D)
    return x ^ (x >> U64(33))


#: One random odd-looking 64-bit value for each byte, and the base of the running polynomial with its inverse.
BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
BASE = 0x5851F42D4C957F2D
INVERSE = pow(BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, by doubling."""
    out = np.ones(max(n, 1), U64)
    done = 1
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * U64(pow(base, done, 1 << 64))
        done += more
    return out


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of BASE and of INVERSE; a worker keeps the most that it ever needed, as shorter ones are their start."""
    held = remembered("powers", dict)
    if len(held.get("up", ())) < n:
        size = max(1 << (n - 1).bit_length(), 1 << 16)
        held.clear()
        held["up"], held["down"] = powers(BASE, size), powers(INVERSE, size)
    return held["up"], held["down"]


class Polynomial:
    """Hashes of any byte ranges of a block, from one running sum modulo 2^64."""

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        up, self.down = _powers(n)
        self.sums = np.zeros(n, U64)
        np.cumsum(BYTE[data] * up[: n - 1], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


def lower_table() -> np.ndarray:
    """Byte map that lower-cases A-Z alone."""
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    return out


def blank_words() -> np.ndarray:
    """Bytes of a word of ``[^\\x20\\x09-\\x0D]+``."""
    out = np.ones(256, bool)
    out[[0x20, 9, 10, 11, 12, 13]] = False
    return out


LOWER, WORD = lower_table(), blank_words()


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, start and end of every word, and the index of its document; words never cross documents."""
    data = LOWER[data]
    inside = WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    before = np.concatenate(([False], inside[:-1])) if len(data) else inside
    after = np.concatenate((inside[1:], [False])) if len(data) else inside
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return data, start, end, np.searchsorted(at, start, "right") - 1


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of the block and the index of its document."""
    data, start, end, doc = words(data, at)
    return Polynomial(data)(start, end), doc


def six(keys: np.ndarray) -> bytes:
    """The low 48 bits of each key, six bytes each."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unsix(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8")


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of every run of equal sorted keys, and for every key the number of its run."""
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1
