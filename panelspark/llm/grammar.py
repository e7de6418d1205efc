"""Token ids in Re-Pair grammar files: written in ascending doc_id order, read back by random access."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import U64, mix, part_count, steps, texts
from .encode import STEP, Encoder
from .storage import written

END_ID = 1
#: Ids of one grammar, smallest frequency of a replaced pair, most pairs replaced in a round, share that a round must save, rounds.
BLOCK_IDS, LEAST, PAIRS_A_ROUND, LEAST_SAVED, ROUNDS = 1 << 20, 8, 8192, 0.02, 24
HEAD = "<4sIIIII"
FIELDS = "part int, block long, part_start long, n_ids long, content binary"


def replace_pairs(ids: np.ndarray, last: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair over one block: the symbols left, which of them end a document, and the rules (left, right).

    Each round counts all neighbouring pairs, ranks the frequent ones, and replaces every place
    whose pair outranks the pairs it overlaps; rule k stands for symbol ``base + k``.  No rule spans
    two documents.  Rules only use symbols of earlier rounds.
    """
    seq, rules = ids.astype(np.int64), []
    made = base
    for _ in range(ROUNDS):
        if len(seq) < 2:
            break
        code = (seq[:-1] << 32) | seq[1:]
        fine = ~last[:-1]
        slot = (mix(code.astype(U64)) >> U64(44)).astype(np.int32)
        often = np.flatnonzero(fine & (np.bincount(slot[fine], minlength=1 << 20)[slot] >= LEAST))
        if not len(often):
            break
        ranked = np.sort(code[often])
        first = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
        count = np.diff(np.concatenate((first, [len(ranked)])))
        pairs, count = ranked[first[count >= LEAST]], count[count >= LEAST]
        order = np.lexsort((pairs, -count))[:PAIRS_A_ROUND]
        if not len(order):
            break
        sought = np.append(pairs[order], -1)  # by rank; the last is no pair's
        rank = np.full(len(seq) + 1, len(order), np.int32)  # rank[i + 1] belongs to the pair at i
        left = np.arange(len(order), dtype=np.int32)
        while len(left):  # pairs that share a slot are looked up one after another, the more frequent first
            own, first = np.unique((mix(sought[left].astype(U64)) >> U64(44)).astype(np.int64), return_index=True)
            table = np.full(1 << 20, len(order), np.int32)
            table[own] = left[first]
            guess = table[slot[often]]
            hit = sought[guess] == code[often]
            rank[often[hit] + 1] = guess[hit]
            left = np.delete(left, first)
            often = often[~hit & (guess < len(order))]  # what is in the slot of a pair, but isn't this pair
        own = rank[1:-1]
        at = np.flatnonzero((own < len(order)) & (own < rank[:-2]) & (own <= rank[2:]))
        used = np.bincount(rank[at + 1], minlength=len(order))
        at = at[used[rank[at + 1]] > 1]
        kept = np.flatnonzero(used > 1)
        if not len(at):
            break
        name = np.zeros(len(order), np.int64)
        name[kept] = made + np.arange(len(kept))
        made += len(kept)
        rules.append(pairs[order[kept]])
        seq[at] = name[rank[at + 1]]
        last[at] = last[at + 1]
        stay = np.ones(len(seq), bool)
        stay[at + 1] = False
        saved = len(at) / len(seq)
        seq, last = seq[stay], last[stay]
        if saved < LEAST_SAVED:
            break
    flat = np.concatenate(rules) if rules else np.zeros(0, np.int64)
    return seq, last, np.stack([flat >> 32, flat & 0xFFFFFFFF], axis=1)


def to_file(docs: list[int | None], ids: list[np.ndarray], base: int) -> bytes:
    """The file image of a block: header, rules, expansion lengths, symbols, and for each document its id, first symbol and first token."""
    sizes = np.array([len(i) for i in ids], np.int64)
    flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    last = np.zeros(len(flat), bool)
    last[np.cumsum(sizes) - 1] = True
    symbols, ends, rules = replace_pairs(flat, last, base)
    lengths = np.ones(len(rules), np.int64)
    for k, (a, b) in enumerate(rules.tolist()):
        lengths[k] = (1 if a < base else lengths[a - base]) + (1 if b < base else lengths[b - base])
    width = "<u2" if base + len(rules) <= 1 << 16 else "<u4"
    first_symbol = np.concatenate(([0], np.flatnonzero(ends) + 1))
    first_token = np.concatenate(([0], np.cumsum(sizes)))
    missing = np.array([d is None for d in docs], np.uint8)
    parts = [
        struct.pack(HEAD, b"RPG1", base, len(rules), len(symbols), len(docs), 2 if width == "<u2" else 4), rules.astype("<u4").tobytes(), lengths.astype("<u4").tobytes(), symbols.astype(width).tobytes(),
        np.array([d or 0 for d in docs], "<i8").tobytes(), missing.tobytes(), first_symbol.astype("<u4").tobytes(), first_token.astype("<u4").tobytes(),
    ]
    return b"".join(parts)


class GrammarFile:
    """Random access to the documents of a file image."""

    def __init__(self, content: bytes):
        magic, self.base, n_rules, n_symbols, self.n_docs, width = struct.unpack_from(HEAD, content)
        if magic != b"RPG1":
            raise ValueError("not a grammar file")
        at = struct.calcsize(HEAD)

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(content, kind, n, at)
            at += out.nbytes
            return out

        self.rules = take("<u4", 2 * n_rules).reshape(-1, 2).astype(np.int64)
        self.lengths = take("<u4", n_rules)
        self.symbols = take(f"<u{width}", n_symbols)
        self.doc_ids, self.missing = take("<i8", self.n_docs), take("u1", self.n_docs).astype(bool)
        self.first_symbol, self.first_token = take("<u4", self.n_docs + 1), take("<u4", self.n_docs + 1)

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """Token ids of symbols: every rule that occurs is expanded once, then all symbols are filled in."""
        seq = symbols.astype(np.int64)
        used, place = np.unique(seq, return_inverse=True)
        pool, sizes = used, np.where(used >= self.base, 0, 1)
        sizes[used >= self.base] = self.lengths[used[used >= self.base] - self.base]
        while (rule := pool >= self.base).any():
            times = 1 + rule
            start = np.cumsum(times) - times
            pair = self.rules[pool[rule] - self.base]
            pool = np.repeat(pool, times)
            pool[start[rule]], pool[start[rule] + 1] = pair[:, 0], pair[:, 1]
        starts, counts = np.cumsum(sizes) - sizes, sizes[place]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        return pool.astype("<u4")[np.arange(total) + np.repeat(starts[place] - ends + counts, counts)]

    def document(self, k: int) -> np.ndarray:
        """Token ids of the k-th document of the file."""
        return self.expand(self.symbols[self.first_symbol[k] : self.first_symbol[k + 1]])

    def token_length(self, symbol: int) -> int:
        return 1 if symbol < self.base else int(self.lengths[symbol - self.base])


def write_grammars(docs: DataFrame, tokenizer: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Files of token ids in ascending doc_id order, as a table (part, block, part_start, n_ids, content) in the shared folder.

    Documents are dealt by ranges of doc_id; each part writes its documents in blocks of about
    ``block_ids`` ids, each with its own grammar.  Rows of one doc_id are ordered by text, rows
    without doc_id come first.
    """
    plain = texts(docs)
    dealt = plain.repartitionByRange(part_count(plain), "doc_id").sortWithinPartitions("doc_id", "text")

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder.of(tokenizer)
        base = max(encode.tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1)
        part = TaskContext.get().partitionId()
        held_docs, held, n, start, block = [], [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            image = to_file(held_docs, held, base)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block]), pa.array([start]), pa.array([n]), pa.array([image], pa.binary())], names=["part", "block", "part_start", "n_ids", "content"])

        for batch in steps(batches, limit=STEP):
            for doc, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1))):
                held_docs.append(doc)
                held.append(np.append(ids, np.uint32(end_id)).astype(np.uint32))
                n += len(ids) + 1
                if n >= block_ids:
                    yield flush()
                    start, block = start + n, block + 1
                    held_docs, held, n = [], [], 0
        if held:
            yield flush()

    return written(dealt.mapInArrow(files, FIELDS))


def read_grammars(files: DataFrame) -> DataFrame:
    """One row per document of the files: doc_id, start (ids before it), n_tokens, ids_crc32 of its little-endian 32-bit ids."""
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("ids"))  # one row per part
    before = totals.select("part", (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("before"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                file = GrammarFile(content.as_py())
                tokens = file.first_token.astype(np.int64)
                ids = file.expand(file.symbols)
                sums = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(tokens[:-1], tokens[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(file.doc_ids.astype(np.int64), mask=file.missing), pa.array(start + tokens[:-1]), pa.array(np.diff(tokens)), pa.array(sums, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    placed = files.join(before, "part").select((F.col("before") + F.col("part_start")).alias("start"), "content")
    return placed.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def grammar_round_trip(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Writes the ids of all documents and returns what the files say.  Null texts are empty; an empty table gives no rows."""
    return read_grammars(write_grammars(docs, tokenizer, end_id))
