"""Hash keys of documents, dealt to buckets in packed form: a block of documents gives one row per bucket."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .blocks import U64, six, unsix

#: Keys that a worker gathers before it deals them out.
UNIT_KEYS = 2_000_000
DEALT = "bucket int, kind int, body binary"


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of 64-bit keys: their top 20 bits, so that the 46 bits kept beside it stay almost independent."""
    return ((keys >> U64(44)) % U64(buckets)).astype(np.int64)


def pack_keys(docs: np.ndarray, slot: np.ndarray, keys: np.ndarray, flags: np.ndarray, buckets: int, kind: int, extras: Sequence[np.ndarray] = ()) -> list[tuple[int, int, bytes]]:
    """Rows (bucket, kind, body) of keys: 46 bits of each key and 2 flags, grouped by document; ``slot`` points into ``docs``; 48 bits of each of ``extras`` go along."""
    bucket = bucket_of(keys, buckets)
    kept = ((keys & U64((1 << 46) - 1)) << U64(2)) | flags.astype(U64)
    order = np.argsort(bucket * len(docs) + slot, kind="stable")
    bucket, slot, kept = bucket[order], slot[order], kept[order]
    extras = [extra[order] for extra in extras]
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    rows = []
    for low, high in zip([0, *cuts], [*cuts, len(bucket)]):
        if low == high:
            continue
        new = np.concatenate(([0], np.flatnonzero(np.diff(slot[low:high])) + 1))
        ids = docs[slot[low:high][new]]
        body = np.int32(len(new)).tobytes() + ids.astype("<i8").tobytes() + np.diff([*new, high - low]).astype("<i4").tobytes() + six(kept[low:high])
        rows.append((int(bucket[low]), kind, b"".join([body, *(six(extra[low:high]) for extra in extras)])))
    return rows


def unpack_extra(bodies: list[bytes], which: int = 0) -> np.ndarray:
    """The 48 bits of one of the extras that go along with every entry."""
    parts = [np.zeros(0, U64)]
    for body in bodies:
        n = int(np.frombuffer(body, "<i4", 1)[0])
        total = int(np.frombuffer(body, "<i4", n, 4 + 8 * n).sum())
        low = 4 + 12 * n + 6 * total * (which + 1)
        parts.append(unsix(body[low : low + 6 * total]))
    return np.concatenate(parts)


def unpack_keys(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc, key (46 bits) and flags of every entry."""
    docs, keys = [np.zeros(0, np.int64)], [np.zeros(0, U64)]
    for body in bodies:
        n = int(np.frombuffer(body, "<i4", 1)[0])
        ids, counts = np.frombuffer(body, "<i8", n, 4), np.frombuffer(body, "<i4", n, 4 + 8 * n)
        docs.append(np.repeat(ids, counts))
        keys.append(unsix(body[4 + 12 * n : 4 + 12 * n + 6 * int(counts.sum())]))
    kept = np.concatenate(keys)
    return np.concatenate(docs), kept >> U64(2), (kept & U64(3)).astype(np.int64)


def dealt_batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    bucket, kind, body = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(kind, pa.int32()), pa.array(body, pa.binary())], names=["bucket", "kind", "body"])


def by_bucket(dealt: DataFrame, buckets: int) -> DataFrame:
    """One partition per bucket."""
    return dealt.repartitionById(buckets, "bucket")
