"""Distributed n-gram language model: buckets of words hold their own tries and score all documents' tokens."""

from __future__ import annotations

import math
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import U64, mix, part_count, six, steps, unsix, utf8, word_hashes
from .eliasfano import Trie
from .exchange import bucket_of, by_bucket
from .storage import written

#: Weight of a bigram count beside a trigram count, and of the unigram probability beside counts.
BIGRAM, UNIGRAM = 0.05, 200.0
FOLDS, HELD_OUT = 7, 2
#: Documents (expected) of the sample that proposes frequent words, their least share there, and the share from which a word's entries are dealt by the word before too.
SAMPLE_DOCS, PROPOSED, FREQUENT = 2000, 1 / 4000, 1 / 1000
#: Tokens and documents of a unit; smallest hashes of the estimate of distinct words; bytes of text of a bucket.
UNIT_TOKENS, UNIT_DOCS, SMALLEST, BUCKET_BYTES = 2_000_000, 60_000, 4096, 16 << 20
END, START, BEFORE_START = (int(x) for x in mix(np.arange(1, 4, dtype=U64) * U64(0xD1342543DE82EF95)))
ENTRIES, DOCS, WORDS = 0, 1, 2


def _tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hash of every token (the end included), of the one and the two before, and its document in the batch."""
    word, doc = word_hashes(*utf8(batch.column(1)))
    n = batch.num_rows
    count = np.bincount(doc, minlength=n) + 1
    owner = np.repeat(np.arange(n), count)
    last = np.cumsum(count) - 1
    token = np.full(len(owner), END, U64)
    inner = np.ones(len(owner), bool)
    inner[last] = False
    token[inner] = word
    first = last - count + 1
    before = np.concatenate(([U64(START)], token[:-1])).astype(U64)
    before[first] = START
    two = np.concatenate(([U64(BEFORE_START)], before[:-1])).astype(U64)
    two[first] = BEFORE_START
    return token, before, two, owner


def _proposed(docs: DataFrame) -> np.ndarray:
    """Hashes of words that are frequent in a bounded sample; they only decide how entries are dealt."""
    rows = docs.count()
    share = min(1.0, SAMPLE_DOCS / max(rows, 1))
    part = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            word, times = np.unique(_tokens(batch)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(times.astype(np.int64))], names=["word", "n"])

    counted = part.mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = counted.orderBy(F.desc("n"), "word").limit(int(1 / PROPOSED)).toPandas()
    return np.sort(top["word"].to_numpy(np.int64)[top["n"].to_numpy() >= PROPOSED * max(1, top["n"].sum())].view(U64))


def _statistics(docs: DataFrame, proposed: np.ndarray) -> tuple[int, int, int, dict[int, int]]:
    """Training tokens and documents, an estimate of distinct training words, and exact counts of proposed words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, rows, least = 0, 0, np.zeros(0, U64)
        exact = np.zeros(len(proposed), np.int64)
        for batch in steps(batches):
            train = batch.column(2).to_numpy(zero_copy_only=False)
            token, _, _, owner = _tokens(batch)
            token = token[train[owner]]
            tokens, rows = tokens + len(token), rows + int(train.sum())
            if len(proposed) and len(token):
                place = np.minimum(np.searchsorted(proposed, token), len(proposed) - 1)
                exact += np.bincount(place[proposed[place] == token], minlength=len(proposed))
            least = np.unique(np.concatenate((least, token)))[:SMALLEST]
        yield pa.RecordBatch.from_arrays(
            [pa.array([tokens]), pa.array([rows]), pa.array([least.tobytes()], pa.binary()), pa.array([exact.astype("<i8").tobytes()], pa.binary())], names=["tokens", "rows", "least", "exact"]
        )

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, rows, least, exact = 0, 0, np.zeros(0, U64), np.zeros(len(proposed), np.int64)
        for batch in batches:
            tokens, rows = tokens + sum(batch.column(0).to_pylist()), rows + sum(batch.column(1).to_pylist())
            for blob, counts in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                least = np.unique(np.concatenate((least, np.frombuffer(blob, "<u8"))))[:SMALLEST]
                exact = exact + np.frombuffer(counts, "<i8")
        yield pa.RecordBatch.from_arrays(
            [pa.array([tokens]), pa.array([rows]), pa.array([least.tobytes()], pa.binary()), pa.array([exact.astype("<i8").tobytes()], pa.binary())], names=["tokens", "rows", "least", "exact"]
        )

    kind = "tokens long, rows long, least binary, exact binary"
    parts = docs.mapInArrow(count, kind)
    few = parts.repartition(16, F.xxhash64("least", "tokens")).mapInArrow(join, kind).collect()  # at most 16 rows of fixed size
    least, exact = np.zeros(0, U64), np.zeros(len(proposed), np.int64)
    for row in few:
        least = np.unique(np.concatenate((least, np.frombuffer(row.least, "<u8"))))[:SMALLEST]
        exact = exact + np.frombuffer(row.exact, "<i8")
    distinct = len(least) if len(least) < SMALLEST else int((SMALLEST - 1) / (int(least[-1]) / 2**64))
    return sum(r.tokens for r in few), sum(r.rows for r in few), distinct, dict(zip(proposed.tolist(), exact.tolist()))


def _word_bytes(tokens: int) -> int:
    """Bytes of the hash of the word before, so that chance matches weigh under a hundredth of the unigram part."""
    return min(6, max(4, math.ceil(math.log2(max(2, 100 * tokens / UNIGRAM)) / 8)))


def _deal(docs: DataFrame, buckets: int, frequent: np.ndarray, wide: int) -> DataFrame:
    """Token entries of units of documents, by bucket of the word; frequent words by that and the word before."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        held, ids, train, count = [], [], [], 0

        def flush() -> pa.RecordBatch:
            unit = part << 24 | number
            token, before, two, slot = (np.concatenate(x) for x in zip(*held))
            known = np.concatenate(train)
            doc = np.concatenate(ids)
            total = np.bincount(slot, minlength=len(doc))
            body = np.concatenate([doc.astype("<i8"), total.astype("<i8"), known.astype("<i8"), np.concatenate(missing).astype("<i8")]).tobytes()
            rows = [(int(unit % buckets), unit, DOCS, body)]
            place = np.minimum(np.searchsorted(frequent, token), len(frequent) - 1)
            routed = np.where(frequent[place] == token, mix(token ^ mix(before + U64(0x1F3D5B79))), token)
            bucket = bucket_of(routed, buckets)
            order = np.lexsort((token, bucket))
            bucket, token, before, two, slot = bucket[order], token[order], before[order], two[order], slot[order]
            flags = np.packbits(known).tobytes()
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            for low, high in zip([0, *cuts], [*cuts, len(bucket)]):
                new = np.concatenate(([0], np.flatnonzero(np.diff(token[low:high])) + 1))
                head = np.array([len(doc), len(new), high - low], "<i4").tobytes()
                parts = [head, flags, six(token[low:high][new]), np.diff([*new, high - low]).astype("<i4").tobytes()]
                parts += [_bytes(before[low:high] >> U64(8), wide), two[low:high].astype("<u2").tobytes(), slot[low:high].astype("<u4").tobytes()]
                rows.append((int(bucket[low]), unit, ENTRIES, b"".join(parts)))
            a, b, c, d = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int64()), pa.array(c, pa.int32()), pa.array(d, pa.binary())], names=["bucket", "unit", "kind", "body"])

        missing: list[np.ndarray] = []
        for batch in steps(batches):
            token, before, two, owner = _tokens(batch)
            held.append((token, before, two, owner + count))
            column = batch.column(0)
            ids.append(column.fill_null(0).to_numpy(zero_copy_only=False))
            missing.append(column.is_null().to_numpy(zero_copy_only=False))
            train.append(batch.column(2).to_numpy(zero_copy_only=False))
            count += batch.num_rows
            if sum(len(h[0]) for h in held) >= UNIT_TOKENS or count >= UNIT_DOCS - 5000:
                yield flush()
                number += 1
                held, ids, train, missing, count = [], [], [], [], 0
        if held:
            yield flush()

    return by_bucket(docs.mapInArrow(deal, "bucket int, unit long, kind int, body binary"), buckets)


def _bytes(values: np.ndarray, n: int) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n]).tobytes()


def _of_bytes(data: bytes, n: int) -> np.ndarray:
    out = np.zeros((len(data) // n, 8), np.uint8)
    out[:, :n] = np.frombuffer(data, np.uint8).reshape(-1, n)
    return out.reshape(-1).view("<u8")


def _counted(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted columns: where each distinct row starts, and how often it occurs."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    first = np.flatnonzero(new)
    return first, np.diff([*first, len(keys[0])])


def build_trie(path: str, word: np.ndarray, before: np.ndarray, two: np.ndarray, frequent: dict[int, int], unit: float, wide: int) -> tuple[list[dict], int]:
    """Trie of training entries, sorted by (word, before, two); words counted beyond this bucket have their counts in ``frequent``.

    Numerator of a node: what counts and the unigram probability ``unit * (count + 1)`` give its
    words; denominators are those of the context (before, word) and of a word after an unseen one.
    """
    first, c1 = _counted(word)
    keys = word[first]
    total = np.array([frequent.get(int(w), int(c)) for w, c in zip(keys, c1)], np.float64) if frequent else c1.astype(np.float64)
    second, c2 = _counted(word, before)
    third, c3 = _counted(word, before, two)
    up2 = np.searchsorted(first, second, "right") - 1
    up3 = np.searchsorted(second, third, "right") - 1
    share = UNIGRAM * unit * (total + 1)
    values = [
        {"above": np.log10(share), "below": np.log10(BIGRAM * total + UNIGRAM)},
        {"above": np.log10(BIGRAM * c2 + share[up2]), "below": np.log10(c2 + BIGRAM * total[up2] + UNIGRAM)},
        {"above": np.log10(c3 + BIGRAM * c2[up3] + share[up2][up3])},
    ]
    return Trie.write(path, (48, 8 * wide, 16), [keys, before[second], two[third]], [keys, up2, up3], values), len(keys)


def _score(dealt: DataFrame, frequent: dict[int, int], unit: float, wide: int) -> DataFrame:
    """(unit, kind, body): sums over the bucket's tokens for each document of a unit."""
    hot = {w & ((1 << 48) - 1): c for w, c in frequent.items()}
    names = np.array(sorted(hot), U64)
    amounts = np.array([hot[int(w)] for w in names], np.int64)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, units, sizes, columns, done = [], [], [], [], []
        for batch in batches:
            for name, kind, body in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if kind == DOCS:
                    done.append((name, DOCS, body))
                    continue
                n_docs, n_words, n = np.frombuffer(body, "<i4", 3).tolist()
                at = 12
                flags = np.unpackbits(np.frombuffer(body, np.uint8, -(-n_docs // 8), at))[:n_docs].astype(bool)
                at += -(-n_docs // 8)
                word = np.repeat(unsix(body[at : at + 6 * n_words]), np.frombuffer(body, "<i4", n_words, at + 6 * n_words))
                at += 10 * n_words
                before = _of_bytes(body[at : at + wide * n], wide)
                two = np.frombuffer(body, "<u2", n, at + wide * n)
                slot = np.frombuffer(body, "<u4", n, at + (wide + 2) * n).astype(np.int64)
                columns.append((word, before, two, slot + sum(sizes), flags[slot]))
                units.append(name)
                sizes.append(n_docs)
        n_distinct = 0
        if columns:
            word, before, two, slot, train = (np.concatenate(x) for x in zip(*columns))
            order = np.lexsort((two, before, word))
            word, before, two, slot, train = word[order], before[order], two[order], slot[order], train[order]
            with tempfile.TemporaryDirectory() as folder:
                path = os.path.join(folder, "trie")
                form, n_distinct = build_trie(path, word[train], before[train], two[train], hot, unit, wide)
                trie = Trie(path, (48, 8 * wide, 16), form)
                # each distinct trigram is looked up once
                new = np.ones(len(word), bool)
                new[1:] = (word[1:] != word[:-1]) | (before[1:] != before[:-1]) | (two[1:] != two[:-1])
                which = np.cumsum(new) - 1
                w, v, u = word[new], before[new], two[new]
                n1 = trie.find(0, np.zeros(len(w), np.int64), w)
                n2 = trie.find(1, n1, v)
                n3 = trie.find(2, n2, u)
                # a frequent word may have no training entry in this bucket
                spot = np.minimum(np.searchsorted(names, w), max(len(names) - 1, 0))
                times = np.where(names[spot] == w, amounts[spot], 0).astype(np.float64) if len(names) else np.zeros(len(w))
                above = np.log10(UNIGRAM * unit * (times + 1))
                below = np.log10(BIGRAM * times + UNIGRAM)
                count = np.log10(times + 1)
                for level, node in enumerate((n1, n2, n3)):
                    hit = node >= 0
                    above[hit] = trie.value(level, "above", node[hit])
                    if level < 2:
                        below[hit] = trie.value(level, "below", node[hit])
                del trie
            # the base is not quantised: counts as they are
            first, c1 = _counted(word[train])
            if len(first):
                own = word[train][first]
                spot = np.minimum(np.searchsorted(own, w), len(own) - 1)
                mine = (own[spot] == w) & (times == 0)
                count[mine] = np.log10(c1[spot[mine]] + 1)
            below[w == U64(END & ((1 << 48) - 1))] = 0.0  # nothing follows the end
            size = sum(sizes)
            sums = [np.bincount(slot, (above - below)[which], size), np.bincount(slot, count[which], size), np.bincount(slot, (count > 0)[which], size)]
            here = np.bincount(slot, minlength=size) > 0
            low = 0
            for name, n in zip(units, sizes):
                some = np.flatnonzero(here[low : low + n])
                body = some.astype("<u4").tobytes() + sums[0][low + some].astype("<f8").tobytes() + sums[1][low + some].astype("<f8").tobytes() + sums[2][low + some].astype("<i4").tobytes()
                out.append((name, ENTRIES, body))
                low += n
            n_distinct -= int(np.isin(own, names).sum()) if len(first) else 0  # frequent words are counted apart
        out += done
        if columns:
            out.append((-1, WORDS, np.int64(n_distinct).tobytes()))
        if out:
            a, b, c = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int32()), pa.array(c, pa.binary())], names=["unit", "kind", "body"])

    return dealt.mapInArrow(score, "unit long, kind int, body binary")


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, words long"


def _combine(scored: DataFrame, start: float) -> DataFrame:
    """Rows of documents from the sums of all buckets, and rows with the number of distinct words of a bucket."""

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, sums, words = {}, {}, 0
        for batch in batches:
            for unit, kind, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if kind == DOCS:
                    docs[unit] = np.frombuffer(body, "<i8").reshape(4, -1)
                elif kind == WORDS:
                    words += int(np.frombuffer(body, "<i8")[0])
                else:
                    sums.setdefault(unit, []).append(body)
        for unit, table in docs.items():
            n = table.shape[1]
            score, base, known = np.full(n, -start), np.zeros(n), np.zeros(n, np.int64)
            for body in sums.pop(unit, ()):
                k = len(body) // 24
                slot = np.frombuffer(body, "<u4", k).astype(np.int64)
                score[slot] += np.frombuffer(body, "<f8", k, 4 * k)
                base[slot] += np.frombuffer(body, "<f8", k, 12 * k)
                known[slot] += np.frombuffer(body, "<i4", k, 20 * k)
            yield pa.RecordBatch.from_arrays(
                [pa.array(table[0], pa.int64(), mask=table[3].astype(bool)), pa.array(table[2] == 0), pa.array(table[1]), pa.array(known), pa.array(base), pa.array(score), pa.nulls(n, pa.int64())],
                names=["doc_id", "held_out", "n_tokens", "n_known", "base", "score", "words"],
            )
        if words:
            empty = [pa.nulls(1, k) for k in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]
            yield pa.RecordBatch.from_arrays([*empty, pa.array([words])], names=["doc_id", "held_out", "n_tokens", "n_known", "base", "score", "words"])

    # bucket sums of units whose number is -1 are spread by their content
    key = F.when(F.col("unit") < 0, F.xxhash64("body")).otherwise(F.col("unit"))
    return scored.repartition(int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions")), key).mapInArrow(combine, RESULT)


def language_scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folds: int = FOLDS, held: int = HELD_OUT) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, then one end.  Learnt from the
    documents whose crc32(doc_id as text) modulo ``folds`` isn't ``held``.  Null texts are empty; a
    missing doc_id counts as empty text; repeated rows count each time; an empty table gives no rows.

    p(w | u v) = (c(uvw) + B c(vw) + U p(w)) / (c(uv) + B c(v) + U), p(w) = (c(w) + 1) / (N + V + 1),
    where B = BIGRAM, U = UNIGRAM and V is estimated (exact in base_score).  The numerator needs only counts of trigrams that
    end with w, the denominator only those of bigrams that end with v: each word's bucket holds a
    trie of what stood before it, gives both logarithms for its tokens, and a document's score is
    their sum.  No bucket needs another's counts, and no process holds the whole model.
    """
    fold = F.crc32(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit(""))) % folds
    plain = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"), (fold != held).alias("train"))
    tokens, rows, distinct, exact = _statistics(plain, _proposed(plain))
    frequent = {w: c for w, c in exact.items() if c >= max(1, FREQUENT * tokens)}
    frequent[END] = rows
    unit = 1.0 / (tokens + distinct + 1)
    wide = _word_bytes(tokens)
    dealt = _deal(plain, part_count(plain, part_bytes=BUCKET_BYTES), np.array(sorted(frequent), U64), wide)
    start = math.log10(rows + BIGRAM * rows + UNIGRAM)
    done = written(_combine(_score(dealt, frequent, unit, wide), start))
    vocabulary = (done.agg(F.sum("words")).first()[0] or 0) + sum(1 for c in frequent.values() if c)
    spread = math.log10(tokens + vocabulary + 1)
    return done.filter("words is null").select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * spread).alias("base_score"), "score"
    )
