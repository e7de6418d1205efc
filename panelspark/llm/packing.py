"""Best-two-fit packing of token sequences into bins of fixed length."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import steps, texts, tidied
from .encode import STEP, Encoder

CAPACITY = 2048
END_ID = 0
#: Pieces that are packed together; each shard leaves at most about one bin partly filled.
SHARD_PIECES = 16_384
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of at most ``capacity`` tokens of every document, ``end_id`` appended.

    Only documents longer than ``capacity`` are cut; their first piece takes the remainder.  A null
    or empty text is the end id alone; a row without doc_id keeps a null doc_id; repeated rows are
    separate documents; an empty table gives no rows.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder.of(tokenizer)
        for batch in steps(batches, limit=STEP):
            out = []
            for doc, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1))):
                ids = np.append(ids, np.array([end_id], "<u4")).astype("<u4")
                first = len(ids) if len(ids) <= capacity else len(ids) % capacity or capacity
                for k, (low, high) in enumerate(zip([0, *range(first, len(ids), capacity)], [*range(first, len(ids), capacity), len(ids)])):
                    out.append((doc, k, low, high - low, zlib.crc32(ids[low:high].tobytes())))
            columns = list(zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32())] + [pa.array(c, pa.int64()) for c in columns[2:]], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return texts(docs).mapInArrow(tidied(pieces), PIECES)


def best_two_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers, none over ``capacity``.

    A bin is filled greedily with the longest unpacked item that fits.  Where a gap is left, the
    bin's smallest item gives way to the two unpacked items that fill its room plus the gap best,
    if these fill it better than it did.
    """
    held: dict[int, list[int]] = {}
    for item in range(len(lengths) - 1, -1, -1):
        if not 0 < lengths[item] <= capacity:
            raise ValueError(f"length {lengths[item]} doesn't fit {capacity}")
        held.setdefault(lengths[item], []).append(item)
    mask = sum(1 << n for n in held)  # bit n: an unpacked item of length n

    def take(n: int) -> int:
        nonlocal mask
        item = held[n].pop()
        if not held[n]:
            mask ^= 1 << n
        return item

    bins = []
    while mask:
        chosen, gap = [], capacity
        while fits := mask & ((1 << (gap + 1)) - 1):
            n = fits.bit_length() - 1
            chosen.append(take(n))
            gap -= n
        if gap and mask:
            smallest = lengths[chosen[-1]]
            room, best, pair = gap + smallest, smallest, None
            rest = mask & ((1 << room) - 1)
            while rest and best < room:
                a = rest.bit_length() - 1
                if 2 * a <= best:
                    break
                rest ^= 1 << a
                seconds = mask & ((1 << (min(room - a, a) + 1)) - 1)
                if len(held[a]) < 2:
                    seconds &= ~(1 << a)
                b = seconds.bit_length() - 1
                if b > 0 and a + b > best:
                    best, pair = a + b, (a, b)
            if pair:
                back = chosen.pop()
                chosen += [take(pair[0]), take(pair[1])]
                held.setdefault(smallest, []).append(back)
                mask |= 1 << smallest
        bins.append(chosen)
    return bins


def pack(pieces: DataFrame, shards: int, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with sequence_id and offset: shards of pieces are packed independently, by best-two-fit."""

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        lengths = rows["length"].tolist()
        sequence, offset = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        for k, items in enumerate(best_two_fit(lengths, capacity)):
            at = 0
            for item in items:
                sequence[item], offset[item] = k, at
                at += lengths[item]
        rows["sequence_id"] = sequence + (rows["shard"].to_numpy(np.int64) << 32)
        rows["offset"] = offset
        return rows.drop(columns="shard")

    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "start", "length", "ids_crc32"), F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInPandas(packed, PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.  See ``cut_pieces`` for nulls and ties."""
    shards = max(1, math.ceil(docs.count() / shard_pieces))
    return pack(cut_pieces(docs, tokenizer, capacity, end_id), shards, capacity)
