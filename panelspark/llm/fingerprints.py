"""Context-triggered piecewise hashing of documents, compared by edit distance."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import cut
from .blocks import U64, Polynomial, mix, part_count, steps, texts

#: Bytes of the rolling window, smallest block size, most chunks that the finest signature holds, signatures.
WINDOW, SMALLEST, CHUNKS, SIZES = 7, 3, 64, 3
LETTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
ROLL = (mix(np.arange(257, dtype=U64) * U64(0xA0761D6478BD642F)) & U64(0xFFFFFFFF)).astype(np.uint32)
ROLL[0] = 0


def fingerprints(values: list[bytes]) -> list[str]:
    """``block:signature:coarser:coarsest signature`` of every value, over all its bytes.

    A chunk ends where the hash of the last bytes hits a multiple of the block size; each chunk
    gives one letter.  The block size is the smallest 3 * 2^i that leaves at most 64 chunks, so no
    chunk is ever left out; each coarser signature has twice the block size of the one before.
    """
    sizes = np.array([len(v) for v in values], np.int64)
    at = np.concatenate(([0], np.cumsum(sizes)))
    data = np.frombuffer(b"".join(values), np.uint8)
    doc = np.repeat(np.arange(len(values)), sizes)
    # windows don't reach into the value before: gaps of zeros between values
    padded = np.zeros(len(data) + (WINDOW - 1) * (len(values) + 1), np.uint16)
    place = np.arange(len(data)) + (WINDOW - 1) * (doc + 1)
    padded[place] = data.astype(np.uint16) + 1
    part = ROLL[padded]
    roll = np.zeros(len(padded), np.uint32)
    factor = 1
    for back in range(WINDOW):
        roll[back:] += part[: len(part) - back] * np.uint32(factor)
        factor = factor * 0x2C1B3C6D % (1 << 32)
    hit = mix(roll[place].astype(U64)) >> U64(20)
    hit += U64(1)
    ends = np.flatnonzero(hit % U64(SMALLEST) == 0)
    low = hit[ends]
    level = np.log2((low & (~low + U64(1))).astype(np.float64)).astype(np.int64)
    level = np.minimum(level, 40)
    counts = np.bincount(doc[ends] * 42 + level, minlength=42 * len(values)).reshape(-1, 42)
    at_least = counts[:, ::-1].cumsum(axis=1)[:, ::-1]
    first = np.argmax(at_least < CHUNKS, axis=1)
    hashes = Polynomial(data)
    last = at[1:][sizes > 0] - 1
    signatures = []
    for coarser in range(SIZES):
        stops = np.union1d(ends[level >= first[doc[ends]] + coarser], last)
        starts = np.concatenate(([0], stops[:-1] + 1)) if len(stops) else stops
        letters = LETTERS[(hashes(starts, stops + 1) >> U64(58)).astype(np.int64)].tobytes().decode()
        cuts = np.concatenate(([0], np.cumsum(np.bincount(doc[stops], minlength=len(values)))))
        signatures.append([letters[a:b] for a, b in zip(cuts[:-1], cuts[1:])])
    return [":".join((str(SMALLEST << int(i)), *own)) for i, *own in zip(first, *signatures)]


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: edit-distance likeness of two fingerprints at the smallest block size that they share; 0 without a shared one."""
    x, y = F.split(a, ":"), F.split(b, ":")

    def near(s: Column, t: Column) -> Column:
        longest = F.greatest(F.length(s), F.length(t))
        return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(s, t) / longest)

    value = F.when(a == b, 1.0)
    for apart in range(SIZES):
        value = value.when(x[0].cast("long") == y[0].cast("long") * (1 << apart), near(x[1], y[1 + apart]))
        value = value.when(y[0].cast("long") == x[0].cast("long") * (1 << apart), near(x[1 + apart], y[1]))
    return value.otherwise(0.0)


ROW = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, next_fingerprint string, text string, part int, place string"


def _edited(text: str, following: str) -> bytes:
    half = len(text) // 2
    return (text[: len(text) - half] + following[:half]).encode()


def neighbour_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint of every document, of its edited text, and their likeness to it and to the next document's.

    The edited text has its last floor(n/2) code points replaced by the first as many of the next
    document by ascending doc_id (after the last: the first).  A null text is empty; rows of one
    doc_id follow each other by text; rows without doc_id come first; a lone row is its own next;
    an empty table gives no rows.

    Documents are dealt by ranges of doc_id; only the first and last document of each range travel
    again, to meet across ranges.
    """
    plain = texts(docs)
    parts = part_count(plain)
    dealt = plain.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        carried: tuple[int, str, str] | None = None  # the row that still waits for its next
        head = None

        def rows(pairs: list[tuple[int, str, str, str, str]]) -> list[tuple]:
            edited = [_edited(text, following) for _, text, _, following, _ in pairs]
            own = fingerprints(edited)
            return [(doc, len(text), hashlib.sha256(e).hexdigest(), f, o, nf, None, part, "inner") for (doc, text, f, _, nf), e, o in zip(pairs, edited, own)]

        for batch in steps(batches):
            ids, values = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            found = list(zip(ids, values, fingerprints([v.encode() for v in values])))
            if head is None:
                head = found[0]
            chain = ([carried] if carried else []) + found
            carried = chain[-1]
            if len(chain) > 1:
                yield _batch(rows([(a[0], a[1], a[2], b[1], b[2]) for a, b in zip(chain[:-1], chain[1:])]))
        if head is not None:
            yield _batch([(d, len(t), None, f, None, None, t, part, place) for (d, t, f), place in ((head, "head"), (carried, "tail"))])

    done = cut(dealt.mapInArrow(walk, ROW))
    edges = done.filter("place <> 'inner'")
    order = sorted(r.part for r in edges.filter("place = 'head'").select("part").collect())  # one number per partition
    spark = docs.sparkSession
    follows = spark.createDataFrame([(a, b) for a, b in zip(order, order[1:] + order[:1])], "part int, next_part int")
    heads = edges.filter("place = 'head'").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fp"))
    tails = edges.filter("place = 'tail'").join(follows, "part").join(heads, "next_part")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            if not rows:
                continue
            edited = [_edited(r["text"], r["next_text"]) for r in rows]
            yield _batch([(r["doc_id"], r["n_chars"], hashlib.sha256(e).hexdigest(), r["fingerprint"], f, r["next_fp"], None, r["part"], "tail") for r, e, f in zip(rows, edited, fingerprints(edited))])

    closed = tails.select("doc_id", "n_chars", "fingerprint", "text", "part", "next_text", "next_fp").mapInArrow(close, ROW)
    every = done.filter("place = 'inner'").unionByName(closed)
    return every.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string()]
    names = [c.split()[0] for c in ROW.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
