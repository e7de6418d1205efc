"""Repeated byte strings across documents, from a collection Burrows-Wheeler transform built column by column."""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import U64, Polynomial, integers, mix, part_count, runs, six, steps, texts, tidied, unsix, utf8
from .exchange import DEALT, bucket_of, by_bucket, dealt_batch, pack_keys, unpack_extra, unpack_keys
from .storage import written

#: Bytes of a repeated string, bytes of an anchor, different stretches from which those of an anchor are dealt window by window.
SPAN, ANCHOR, CROWD = 50, 16, 256
SLIDE = SPAN - ANCHOR + 1
#: No byte of UTF-8: what stands before the first symbol of a string.
END = 255
#: Places of the anchor in a window that are sifted together: before strings travel, and where they are compared.
FIRST_SIEVE, SIEVE = 12, 6
#: Bytes of one stretch of a document whose anchors are found at once, strings of one transform, bytes gathered before dealing.
STRETCH, STRINGS, UNIT_BYTES = 1 << 20, 1 << 14, 8 << 20
#: Anchors gathered before dealing: each takes some hundred bytes while a unit is sorted.
UNIT_KEYS = 500_000
PIECES, COVERED = 1, 2
PIECE = np.dtype([("doc", "<i8"), ("row", "<i8"), ("start", "<i8"), ("size", "<i4")])
SPANS = np.dtype([("doc", "<i8"), ("row", "<i8"), ("start", "<i8"), ("end", "<i8")])


def anchored(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of SPAN-byte windows that share an anchor: document, first and last window start, hash and place of the anchor.

    The anchor of a window is the ANCHOR-byte string in it with the smallest hash, the leftmost of
    equal ones: equal windows have equal anchors, wherever they stand.
    """
    found = []
    n = len(data)
    for base in range(0, max(n - SPAN + 1, 0), STRETCH):
        part = data[base : base + STRETCH + SPAN - 1]
        starts = np.arange(len(part) - ANCHOR + 1)
        gram = Polynomial(part)(starts, starts + ANCHOR)
        low = (gram & ~U64((1 << 24) - 1)) | starts.astype(U64)
        reach, width = low, 1
        while width * 2 <= SLIDE:
            reach = np.minimum(reach[:-width], reach[width:])
            width *= 2
        windows = len(part) - SPAN + 1
        pick = (np.minimum(reach[:windows], reach[SLIDE - width : SLIDE - width + windows]) & U64((1 << 24) - 1)).astype(np.int64)
        doc = np.searchsorted(at, base + np.arange(windows), "right") - 1
        good = np.flatnonzero(base + np.arange(windows) + SPAN <= at[doc + 1])
        if not len(good):
            continue
        pick, doc = pick[good], doc[good]
        new = np.ones(len(good), bool)
        new[1:] = (pick[1:] != pick[:-1]) | (doc[1:] != doc[:-1]) | (good[1:] != good[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(good)) - 1
        found.append((doc[first], base + good[first], base + good[last], mix(gram[pick[first]]), base + pick[first]))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, U64), none
    return tuple(np.concatenate(x) for x in zip(*found))


def column_transform(data: np.ndarray, start: np.ndarray, size: np.ndarray, folder: str) -> tuple[np.ndarray, np.ndarray]:
    """Burrows-Wheeler transform and longest common prefixes of a collection of strings.

    Every round inserts one more symbol of each string, from its end: the place of the longer suffix
    follows from the rank of its first symbol in the transform so far, the common prefix with its
    neighbours from the smallest one between this and the nearest equal symbols.  Transform and
    prefixes are read from, and written to, files in sequence; a round holds one round's arrays.
    """
    n = len(start)
    last = data[start + size - 1]
    row, string = np.arange(n), np.arange(n)
    done = 0  # symbols inserted of every live string

    def put(file: BinaryIO, values: np.ndarray) -> None:
        file.seek(0)
        values.tofile(file)

    def held(file: BinaryIO) -> np.ndarray:
        file.seek(0)
        return np.fromfile(file, np.uint8)

    # written over in place: they only grow, and a file that is emptied first is flushed to the disk each time
    with open(os.path.join(folder, "transform"), "w+b") as transform, open(os.path.join(folder, "prefixes"), "w+b") as prefixes:
        put(transform, last)
        put(prefixes, np.zeros(n, np.uint8))
        while len(string):
            bwt, lcp = held(transform), held(prefixes)
            order = np.argsort(bwt, kind="stable")
            # ranks of the live strings, which go on in the order of these
            here, number = np.zeros(len(bwt), bool), np.empty(len(bwt), np.int32)
            here[row], number[row] = True, np.arange(len(row), dtype=np.int32)
            k = np.flatnonzero(here[order])
            row = order[k]
            string = string[number[row]]
            symbol = bwt[row]
            live = int(np.count_nonzero(bwt != END))
            place = n + k
            padded = np.append(lcp, np.uint8(END))
            before, after = order[np.maximum(k - 1, 0)], order[np.minimum(k + 1, len(bwt) - 1)]
            up = np.flatnonzero((k > 0) & (bwt[before] == symbol))
            down = np.flatnonzero((k + 1 < live) & (bwt[after] == symbol))
            own = np.zeros(len(row), np.uint8)
            own[up] = _smallest(padded, before[up] + 1, row[up] + 1)
            below = _smallest(padded, row[down] + 1, after[down] + 1)
            done += 1
            left = size[string] - done  # symbols before the suffix that is now inserted
            following = np.where(left > 0, data[start[string] + np.maximum(left, 1) - 1], END).astype(np.uint8)
            fresh = np.zeros(n + live, bool)
            fresh[place] = True
            old = ~fresh
            out = np.empty(n + live, np.uint8)
            out[old] = bwt
            out[place] = following
            put(transform, out)
            out[old] = lcp
            out[place] = own
            out[place[down] + 1] = below
            put(prefixes, out)
            go = left > 0
            row, string = place[go], string[go]
        return held(transform), held(prefixes)


def _smallest(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """1 + the smallest value of each range, at most END - 1."""
    if not len(low):
        return np.zeros(0, np.uint8)
    # in ascending order: between two ranges, reduceat goes over all values from the end of one to the start of the next
    order = np.argsort(low)
    least = np.empty(len(low), values.dtype)
    least[order] = np.minimum.reduceat(values, np.stack([low[order], high[order]], axis=1).ravel())[::2]
    return np.minimum(least, END - 2) + np.uint8(1)


def earliest(data: np.ndarray, start: np.ndarray, size: np.ndarray, doc: np.ndarray, folder: str) -> tuple[np.ndarray, np.ndarray]:
    """(string, offset) of every SPAN-byte window whose bytes are also a window of a string of a smaller document."""
    n = len(start)
    bwt, lcp = column_transform(data, start, size, folder)
    order = np.argsort(bwt, kind="stable")
    onward = np.empty(len(bwt), np.int64)
    onward[order] = n + np.arange(len(bwt))
    group = np.cumsum(lcp < SPAN) - 1
    group -= group[0]
    least = np.full(int(group[-1]) + 1, np.iinfo(np.int64).max)
    row, string, length, seen = np.arange(n), np.arange(n), 0, []
    while len(string):
        if length >= SPAN:
            of = group[row]
            # strings of one round, by group: the smallest document of each
            by = np.lexsort((doc[string], of))
            first = by[np.concatenate(([True], of[by][1:] != of[by][:-1]))]
            least[of[first]] = np.minimum(least[of[first]], doc[string[first]])
            seen.append((string, size[string] - length, of))
        go = size[string] > length
        row, string = onward[row[go]], string[go]
        length += 1
    if not seen:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    string, offset, of = (np.concatenate(x) for x in zip(*seen))
    hit = least[of] < doc[string]
    return string[hit], offset[hit]


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of spans as maximal runs; touching spans are one."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    first = np.flatnonzero(np.concatenate(([True], start[1:] > end[:-1])))
    return start[first], end[np.append(first[1:], len(start)) - 1]


def _merged_rows(rows: np.ndarray) -> np.ndarray:
    """Spans merged within each (doc, row)."""
    rows = rows[np.lexsort((rows["start"], rows["row"], rows["doc"]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows["doc"][1:] != rows["doc"][:-1]) | (rows["row"][1:] != rows["row"][:-1])
    cuts = np.flatnonzero(new)
    out = []
    for a, b in zip(cuts, [*cuts[1:], len(rows)]):
        low, high = merged(rows["start"][a:b], rows["end"][a:b])
        part = np.empty(len(low), SPANS)
        part["doc"], part["row"], part["start"], part["end"] = rows["doc"][a], rows["row"][a], low, high
        out.append(part)
    return np.concatenate(out) if out else rows


def _name(anchor: np.ndarray, sign: np.ndarray) -> np.ndarray:
    """46 bits that name a stretch: its anchor (46 bits) and its bytes (48 bits of their hash)."""
    return mix(anchor ^ mix(sign + U64(0x632BE59BD9B4E019))) >> U64(18)


def _classes(sieve: int) -> list[tuple[int, int]]:
    """Bytes before and behind an anchor that all windows have in which it stands at one of ``sieve`` neighbouring places."""
    rest = SPAN - ANCHOR
    return [(before, max(0, rest - (before + sieve - 1))) for before in range(0, rest + 1, sieve)]


def _cores(hashes: Polynomial, first: np.ndarray, last: np.ndarray, place: np.ndarray) -> np.ndarray:
    """16 bits for each class of FIRST_SIEVE: a hash of the bytes that its windows share, 0 where a stretch has none of them."""
    out = np.zeros(len(place), U64)
    for k, (before, behind) in enumerate(_classes(FIRST_SIEVE)):
        low, high = place - before, place + ANCHOR + behind
        there = np.flatnonzero((low >= first) & (high <= last + SPAN))
        out[there] |= (hashes(low[there], high[there]) % U64(65535) + U64(1)) << U64(16 * k)
    return out


def _anchors(plain: DataFrame, buckets: int) -> DataFrame:
    """Anchor hashes of every document with the hashes of the stretch around them and of its cores, by bucket."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, slots, keys, signs, cores, held, base = [], [], [], [], [], 0, 0

        def flush() -> pa.RecordBatch:
            key = np.concatenate(keys)
            return dealt_batch(pack_keys(np.concatenate(ids), np.concatenate(slots), key, np.zeros(len(key), np.int8), buckets, 0, [np.concatenate(signs), np.concatenate(cores)]))

        for batch in steps(batches):
            data, at = utf8(batch.column(1))
            doc, first, last, key, place = anchored(data, at)
            if not len(key):
                continue
            hashes = Polynomial(data)
            ids.append(integers(batch, "doc_id"))
            slots.append(base + doc)
            keys.append(key)
            signs.append(hashes(first, last + SPAN))
            cores.append(_cores(hashes, first, last, place))
            base += batch.num_rows
            held += len(key)
            if held >= UNIT_KEYS:
                yield flush()
                ids, slots, keys, signs, cores, held, base = [], [], [], [], [], 0, 0
        if keys:
            yield flush()

    return by_bucket(plain.mapInArrow(tidied(deal), DEALT), buckets)


GONE, SENT, CROWDED = 1, 2, 3


def _met(group: np.ndarray, cores: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which stretches of a group have a core that a stretch of another document has, too; equal windows have equal cores."""
    out = np.zeros(len(group), bool)
    for k in range(len(_classes(FIRST_SIEVE))):
        core = (cores >> U64(16 * k)) & U64(65535)
        some = np.flatnonzero(core)
        code = (group[some].astype(U64) << U64(16)) | core[some]
        order = np.argsort(code, kind="stable")
        some = some[order]
        if len(some):
            start, which = runs(code[order])
            out[some] |= (np.minimum.reduceat(doc[some], start) != np.maximum.reduceat(doc[some], start))[which]
    return out


def _shared(dealt: DataFrame, buckets: int) -> DataFrame:
    """(doc, keys): what is to become of a document's stretches, as 46 bits of their name and 2 of their fate; one row per document.

    A stretch that is the same in a smaller document is GONE as a whole.  Of the others, those that
    share their anchor and a core with a stretch of another document are SENT to be compared, as
    single windows where an anchor has many (CROWDED).  Nothing is said of the rest: no window of
    theirs is in another document, or all have the same stretch and this is the smallest document.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bodies = []
        for batch in batches:
            bodies += batch.column(2).to_pylist()
        doc, key, _ = unpack_keys(bodies)
        sign, cores = unpack_extra(bodies), unpack_extra(bodies, 1)
        del bodies
        if not len(key):
            return
        order = np.lexsort((doc, sign, key))
        doc, key, sign, cores = doc[order], key[order], sign[order], cores[order]
        start, which = runs(key)
        several = (np.minimum.reduceat(doc, start) != np.maximum.reduceat(doc, start))[which]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (sign[1:] != sign[:-1])
        first = np.flatnonzero(new)
        least = doc[first][np.cumsum(new) - 1]
        # the copies of a stretch in its smallest document stand for all others
        met = np.zeros(len(key), bool)
        some = np.flatnonzero(several & (doc == least))
        met[some] = _met(which[some], cores[some], doc[some])
        kinds = np.add.reduceat((new & met).astype(np.int64), start)[which]
        fate = np.where(doc > least, GONE, np.where(met, np.where(kinds > CROWD, CROWDED, SENT), 0))
        keep = fate > 0
        doc, out = doc[keep], (_name(key[keep], sign[keep]) << U64(2) | fate[keep].astype(U64)).astype("<u8")
        if not len(doc):
            return
        # packed by the bucket of the document: a row for each document would be as many rows as documents times buckets
        target = (mix(doc.astype(U64)) % U64(buckets)).astype(np.int64)
        order = np.lexsort((doc, target))
        doc, out, target = doc[order], out[order], target[order]
        cuts, _ = runs(target)
        rows = []
        for a, b in zip(cuts, [*cuts[1:], len(doc)]):
            first, _ = runs(doc[a:b])
            rows.append((int(target[a]), 0, np.int32(len(first)).tobytes() + doc[a:b][first].astype("<i8").tobytes() + np.diff([*first, b - a]).astype("<i4").tobytes() + six(out[a:b])))
        yield dealt_batch(rows)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bodies = []
        for batch in batches:
            bodies += batch.column(2).to_pylist()
        doc, name, fate = unpack_keys(bodies)
        if not len(doc):
            return
        order = np.argsort(doc, kind="stable")
        doc, out = doc[order], (name << U64(2) | fate.astype(U64))[order]
        cuts, _ = runs(doc)
        blobs = [six(out[a:b]) for a, b in zip(cuts, [*cuts[1:], len(doc)])]
        yield pa.RecordBatch.from_arrays([pa.array(doc[cuts]), pa.array(blobs, pa.binary())], names=["doc", "keys"])

    return by_bucket(dealt.mapInArrow(tidied(find), DEALT), buckets).mapInArrow(tidied(gather), "doc long, keys binary")


def _dealt_spans(covered: np.ndarray, buckets: int) -> list[tuple[int, int, bytes]]:
    """Spans that are settled already, by document."""
    target = (mix(covered["doc"].astype(U64)) % U64(buckets)).astype(np.int64)
    by = np.argsort(target, kind="stable")
    return [(int(target[part[0]]), COVERED, covered[part].tobytes()) for part in np.split(by, np.flatnonzero(np.diff(target[by])) + 1) if len(part)]


def _pieces(marked: DataFrame, buckets: int) -> DataFrame:
    """Stretches that are to be compared, by bucket of their anchor; those of crowded anchors as single windows, by bucket of their bytes.

    Of equal strings of a unit only those of the smallest document travel.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # doc, row, start, size, hash, bucket, bytes of the block, place in it
        settled: list[np.ndarray] = []
        gathered = 0

        def flush() -> Iterator[pa.RecordBatch]:
            rows = _dealt_spans(np.concatenate(settled), buckets) if settled else []
            if sum(len(h[0]) for h in held):
                rows += strings_of()
            if rows:
                yield dealt_batch(rows)

        def strings_of() -> list[tuple[int, int, bytes]]:
            doc, row, start, size, sign, bucket, block, place = (np.concatenate(x) for x in zip(*[(*h[:6], np.full(len(h[0]), k), h[7]) for k, h in enumerate(held)]))
            blocks = [h[6] for h in held]
            order = np.lexsort((doc, sign))
            group = runs(sign[order])
            least = doc[order][group[0]][group[1]]
            kept, gone = order[doc[order] == least], order[doc[order] > least]
            rows = []
            if len(gone):
                covered = np.empty(len(gone), SPANS)
                covered["doc"], covered["row"], covered["start"], covered["end"] = doc[gone], row[gone], start[gone], start[gone] + size[gone]
                rows += _dealt_spans(_merged_rows(covered), buckets)
            kept = kept[np.argsort(bucket[kept], kind="stable")]
            for part in np.split(kept, np.flatnonzero(np.diff(bucket[kept])) + 1):
                head = np.empty(len(part), PIECE)
                head["doc"], head["row"], head["start"], head["size"] = doc[part], row[part], start[part], size[part]
                strings = b"".join(blocks[b][p : p + s].tobytes() for b, p, s in zip(block[part], place[part], size[part]))
                rows.append((int(bucket[part[0]]), PIECES, np.int32(len(part)).tobytes() + head.tobytes() + strings))
            return rows

        for batch in steps(batches):
            data, at = utf8(batch.column(1))
            ids, row = integers(batch, "doc_id"), integers(batch, "row")
            wanted, fates = [], []
            for k, blob in enumerate(batch.column(3).to_pylist()):
                keys = np.unique(unsix(blob))
                wanted.append(mix(keys >> U64(2)) + U64(k))
                fates.append((keys & U64(3)).astype(np.int64))
            doc, first, last, key, _ = anchored(data, at)
            want, fate = np.concatenate(wanted), np.concatenate(fates)
            if not len(key) or not len(want):
                continue
            hashes = Polynomial(data)
            name = _name(key & U64((1 << 46) - 1), hashes(first, last + SPAN) & U64((1 << 48) - 1))
            mine = mix(name) + doc.astype(U64)  # the name and the document as one number
            by = np.argsort(want, kind="stable")
            spot = np.minimum(np.searchsorted(want[by], mine), len(want) - 1)
            fate = np.where(want[by][spot] == mine, fate[by][spot], 0)
            gone, whole, single = (np.flatnonzero(fate == f) for f in (GONE, SENT, CROWDED))
            if len(gone):
                covered = np.empty(len(gone), SPANS)
                covered["doc"], covered["row"] = ids[doc[gone]], row[doc[gone]]
                covered["start"], covered["end"] = first[gone] - at[doc[gone]], last[gone] + SPAN - at[doc[gone]]
                settled.append(_merged_rows(covered))
            count = last[single] - first[single] + 1
            one = np.repeat(first[single], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            d = np.concatenate((doc[whole], np.repeat(doc[single], count)))
            start = np.concatenate((first[whole], one))
            size = np.concatenate((last[whole] - first[whole] + SPAN, np.full(len(one), SPAN)))
            sign = hashes(start, start + size)
            bucket = np.concatenate((bucket_of(mix(key[whole]), buckets), bucket_of(mix(sign[len(whole) :]), buckets)))
            held.append((ids[d], row[d], start - at[d], size, sign, bucket, data, start))
            gathered += int(size.sum()) + len(data)
            if gathered >= UNIT_BYTES:
                yield from flush()
                held, settled, gathered = [], [], 0
        yield from flush()

    return by_bucket(marked.mapInArrow(tidied(deal), DEALT), buckets)


def _spans(pieces: DataFrame) -> DataFrame:
    """(doc, row, spans): what is to be removed of a document, as far as one bucket knows."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        covered, heads, strings = [np.zeros(0, SPANS)], [np.zeros(0, PIECE)], []
        for batch in batches:
            for kind, body in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if kind == COVERED:
                    covered.append(np.frombuffer(body, SPANS))
                else:
                    n = int(np.frombuffer(body, "<i4", 1)[0])
                    heads.append(np.frombuffer(body, PIECE, n, 4))
                    strings.append(body[4 + n * PIECE.itemsize :])
        head, data = np.concatenate(heads), np.frombuffer(b"".join(strings), np.uint8)
        if len(head):
            size = head["size"].astype(np.int64)
            start = np.cumsum(size) - size
            sign = np.empty(len(size), U64)
            for some in _blocks(start, size):
                base = start[some.start]
                sign[some] = Polynomial(data[base : start[some.stop - 1] + size[some.stop - 1]])(start[some] - base, start[some] + size[some] - base)
            order = np.lexsort((head["doc"], sign))
            first, which = runs(sign[order])
            least = head["doc"][order][first]
            rest = np.ones(len(order), bool)
            rest[first] = False
            # copies of a string of a smaller document
            copy = order[head["doc"][order] > least[which]]
            covered.append(_cover(head, copy, np.zeros(len(copy), np.int64), size[copy] - SPAN))
            same = order[rest & (head["doc"][order] == least[which])]
            twin = which[rest & (head["doc"][order] == least[which])]
            distinct = order[first]
            place = [_first_anchor(data, start[some], size[some]) for some in np.split(distinct, range(STRINGS, len(distinct), STRINGS))]
            key, anchor = (np.concatenate(x) for x in zip(*place))
            numbers = np.flatnonzero(_extended(data, start[distinct], size[distinct], anchor))
            # one transform for each set of anchors that can share a window
            part = (mix(key[numbers]) % U64(max(1, -(-len(numbers) // STRINGS)))).astype(np.int64)
            for p in np.unique(part):
                mine = numbers[part == p]
                chosen = distinct[mine]
                with tempfile.TemporaryDirectory() as folder:
                    string, offset = earliest(data, start[chosen], size[chosen], head["doc"][chosen].astype(np.int64), folder)
                if not len(string):
                    continue
                by = np.lexsort((offset, string))
                string, offset = string[by], offset[by]
                new = np.ones(len(string), bool)
                new[1:] = (string[1:] != string[:-1]) | (offset[1:] != offset[:-1] + 1)
                low = np.flatnonzero(new)
                high = np.append(low[1:], len(string)) - 1
                covered.append(_cover(head, chosen[string[low]], offset[low], offset[high]))
                if len(same):  # further places of these strings in their documents
                    member = np.searchsorted(mine, twin)
                    ok = (member < len(mine)) & (mine[np.minimum(member, len(mine) - 1)] == twin)
                    lows = np.searchsorted(string[low], member[ok])
                    highs = np.searchsorted(string[low], member[ok], "right")
                    count = highs - lows
                    pick = np.repeat(lows, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                    covered.append(_cover(head, np.repeat(same[ok], count), offset[low[pick]], offset[high[pick]]))
        rows = np.concatenate(covered)
        if not len(rows):
            return
        rows = _merged_rows(rows)
        new = np.concatenate(([True], (rows["doc"][1:] != rows["doc"][:-1]) | (rows["row"][1:] != rows["row"][:-1])))
        cuts = np.flatnonzero(new)
        pairs = np.stack([rows["start"], rows["end"]], axis=1).astype("<i8")
        blobs = [pairs[a:b].tobytes() for a, b in zip(cuts, [*cuts[1:], len(rows)])]
        yield pa.RecordBatch.from_arrays([pa.array(rows["doc"][cuts]), pa.array(rows["row"][cuts]), pa.array(blobs, pa.binary())], names=["doc", "row", "spans"])

    return pieces.mapInArrow(tidied(judge), "doc long, row long, spans binary")


def _first_anchor(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the anchor of the first window of every string, and its place in the string; all its windows share it."""
    block = data[(start[:, None] + np.arange(SPAN)).ravel()]
    _, first, _, key, place = anchored(block, np.arange(0, len(block) + 1, SPAN))
    return key, place - first


def _extended(data: np.ndarray, start: np.ndarray, size: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Which strings agree with another one on most of some window around the anchor.

    A window has SPAN - ANCHOR further bytes; by how many of them stand before the anchor, windows
    fall into classes of SIEVE, and equal windows agree at least on what all of their class have.
    """
    classes = _classes(SIEVE)
    sign, there = np.zeros((len(classes), len(start)), U64), np.zeros((len(classes), len(start)), bool)
    order = np.argsort(start, kind="stable")
    start, size, anchor = start[order], size[order], anchor[order]
    for some in _blocks(start, size):
        base = start[some.start]
        hashes = Polynomial(data[base : start[some.stop - 1] + size[some.stop - 1]])
        for k, (before, behind) in enumerate(classes):
            low, high = anchor[some] - before, anchor[some] + ANCHOR + behind
            mine = some.start + np.flatnonzero((low >= 0) & (high <= size[some]))
            there[k, mine] = True
            sign[k, mine] = hashes(start[mine] - base + anchor[mine] - before, start[mine] - base + anchor[mine] + ANCHOR + behind)
    keep = np.zeros(len(start), bool)
    for k in range(len(classes)):
        mine = np.flatnonzero(there[k])
        _, which, count = np.unique(sign[k, mine], return_inverse=True, return_counts=True)
        keep[mine] |= count[which] > 1
    out = np.zeros(len(start), bool)
    out[order] = keep
    return out


def _blocks(start: np.ndarray, size: np.ndarray) -> Iterator[slice]:
    """Stretches of strings that follow each other in a block, of about STRETCH bytes each or of one string: hashing takes 50 bytes a byte."""
    low = 0
    while low < len(start):
        high = max(low + 1, int(np.searchsorted(start + size, start[low] + STRETCH, "right")))
        yield slice(low, high)
        low = high


def _cover(head: np.ndarray, item: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Spans of the windows low..high (offsets) of pieces."""
    out = np.empty(len(item), SPANS)
    out["doc"], out["row"] = head["doc"][item], head["row"][item]
    out["start"], out["end"] = head["start"][item] + low, head["start"][item] + high + SPAN
    return out


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _judged(docs: DataFrame, doc_id: str, text: str, function, schema: str, rest: Column | None = None) -> DataFrame:
    """``function`` over documents with the spans to remove (binary pairs from all buckets, null: none) and ``rest``, whatever else of a row goes along.

    What becomes of the stretches is written, so that anchors don't lie on the disks together with strings and texts.
    """
    plain = texts(docs, doc_id, text) if rest is None else docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"), rest.alias("rest"))
    kept = ["rest"] if rest is not None else []
    buckets = part_count(plain)
    known = plain.filter("doc_id is not null")
    wanted = written(_shared(_anchors(known.select("doc_id", "text"), buckets), buckets)).withColumnRenamed("doc", "doc_id")
    # what else goes along isn't left out: the join below shares this one's exchange of the texts only if both have the same columns
    marked = known.join(wanted, "doc_id").select("doc_id", "text", F.xxhash64("text").alias("row"), "keys", *kept)
    spans = _spans(_pieces(marked, buckets)).groupBy(F.col("doc").alias("span_doc")).agg(F.collect_list(F.struct("row", "spans")).alias("found"))
    mine = F.filter("found", lambda s: s["row"] == F.xxhash64("text"))
    judged = known.join(spans, known["doc_id"] == spans["span_doc"], "left").select("doc_id", "text", F.transform(mine, lambda s: s["spans"]).alias("spans"), *kept)
    nameless = plain.filter("doc_id is null").select("doc_id", "text", F.lit(None).cast("array<binary>").alias("spans"), *kept)
    # a union below the function would keep both joins from sharing one exchange of the texts
    return judged.mapInArrow(tidied(function), schema).unionByName(nameless.mapInArrow(tidied(function), schema))


def _cut_out(text: bytes, blobs: list[bytes] | None) -> tuple[bytes, int, int]:
    """Kept bytes, removed bytes, maximal removed runs."""
    if not blobs:
        return text, 0, 0
    pairs = np.frombuffer(b"".join(blobs), "<i8").reshape(-1, 2)
    low, high = merged(pairs[:, 0], pairs[:, 1])
    kept = b"".join(text[a:b] for a, b in zip([0, *high], [*low, len(text)]))
    return kept, int((high - low).sum()), len(low)


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Each byte goes that a SPAN-byte string covers which also starts in a document with a smaller
    doc_id; strings are judged on the input.  Null texts are empty.  Rows of one doc_id don't remove
    each other's bytes; rows without doc_id neither remove nor lose anything; an empty table gives
    no rows.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            data, at = utf8(batch.column(1))
            raw = data.tobytes()
            rows = []
            for k, blobs in enumerate(batch.column(2).to_pylist()):
                kept, gone, n = _cut_out(raw[at[k] : at[k + 1]], blobs)
                rows.append((int(at[k + 1] - at[k]), gone, n, hashlib.sha256(kept).hexdigest()))
            n_bytes, removed, n_spans, sha = zip(*rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n_bytes, removed, n_spans)), pa.array(sha)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _judged(docs, doc_id, text, digest, RESULT)


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with what is left of every text; null texts stay null, further columns stay as they are, whatever their names.

    A removed run that ends inside a character takes the rest of this character along, as the bytes
    left would be no text.  The column ``text`` is the last one.
    """
    others = [c for c in docs.columns if c != text]
    # by number: a column may have any name here
    rest = F.struct(F.col(f"`{text}`").isNull().alias("no_text"), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(others)])
    kinds = ", ".join(["no_text: boolean", *[f"c{k}: {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(others)]])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            data, at = utf8(batch.column(1))
            raw = data.tobytes()
            kept = [_cut_out(raw[at[k] : at[k + 1]], blobs)[0].decode("utf-8", "ignore") for k, blobs in enumerate(batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.string()), batch.column(3)], names=["text", "rest"])

    left = _judged(docs, doc_id, text, cut, f"text string, rest struct<{kinds}>", rest)
    return left.select(*[F.col(f"rest.c{k}").alias(c) for k, c in enumerate(others)], F.when(~F.col("rest.no_text"), F.col("text")).alias(text))
