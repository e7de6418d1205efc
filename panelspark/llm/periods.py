"""Periodic runs of words by recompression: a run-length grammar of each block of texts answers exact extension queries."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import WORD, steps, utf8

#: Shortest run in words and in periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Candidates that are extended together; symbols of a document at which compression ends.
CANDIDATES, TOP = 1 << 21, 4
RESULT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


class Level(NamedTuple):
    """A string of symbols and how the next shorter string is made of it."""

    symbol: np.ndarray
    #: Place in the next string of the symbol that each one is part of, and the first one of each symbol of the next string.
    up: np.ndarray
    down: np.ndarray
    #: None where equal neighbours were joined; else which symbols can only be the last of a pair.
    late: np.ndarray | None


class Grammar:
    """Recompression of a string: blocks of equal symbols and pairs of different ones get names by turns.

    Names are given by exact equality, so that equal stretches are parsed alike up to their edges.
    Symbols from ``n_words`` on are separators: each occurs once and is never joined with another.
    """

    def __init__(self, words: np.ndarray, n_words: int, seed: int = 12):
        symbol = words.astype(np.int32)
        n_names = int(symbol.max(initial=0)) + 1
        fixed = n_names  # names below are words and separators
        draw = np.random.default_rng(seed)
        self.levels: list[Level] = []
        while True:
            same = symbol[1:] == symbol[:-1]
            if same.any():
                first = np.flatnonzero(np.concatenate(([True], ~same)))
                size = np.diff(first, append=len(symbol))
                made = symbol[first]
                long = np.flatnonzero(size > 1)
                names, _ = pd.factorize(made[long].astype(np.int64) << 31 | size[long])
                made[long] = n_names + names
                n_names += int(names.max()) + 1
                symbol = self._shorter(symbol, first, made, None)
            alone = (symbol >= n_words) & (symbol < fixed)
            places = np.flatnonzero(alone)
            if int(np.diff(places).max(initial=1)) - 1 <= TOP:
                break
            side = (symbol.astype(np.uint32) * np.uint32(draw.integers(1 << 32) | 1)) >> np.uint32(31) == 1
            late = side & ~alone
            head = np.flatnonzero(~side[:-1] & ~alone[:-1] & late[1:])
            if not len(head):
                continue
            names, _ = pd.factorize(symbol[head].astype(np.int64) << 32 | symbol[head + 1])
            stay = np.ones(len(symbol), bool)
            stay[head + 1] = False
            made = symbol.copy()
            made[head] = n_names + names
            n_names += int(names.max()) + 1
            symbol = self._shorter(symbol, np.flatnonzero(stay), made[stay], late)
        self.top = symbol
        self.mirrored = [
            Level(x.symbol[::-1], (len(x.down) - 2 - x.up)[::-1], len(x.symbol) - x.down[::-1], None if x.late is None else self._leading(x)[::-1]) for x in self.levels
        ]

    def _shorter(self, symbol: np.ndarray, first: np.ndarray, made: np.ndarray, late: np.ndarray | None) -> np.ndarray:
        begins = np.zeros(len(symbol), np.int32)
        begins[first] = 1
        self.levels.append(Level(symbol, np.cumsum(begins, dtype=np.int32) - 1, np.append(first, len(symbol)).astype(np.int32), late))
        return made

    @staticmethod
    def _leading(level: Level) -> np.ndarray:
        """Seen from the other end, the symbols that can be the first of a pair take the place of the last ones."""
        return ~level.late

    def common(self, a: np.ndarray, b: np.ndarray, back: bool = False) -> np.ndarray:
        """Length of the longest common extension of places a and b (never the same), to the right or ``back`` to the left."""
        levels, top, n = (self.mirrored, self.top[::-1], len(self.levels[0].symbol) if self.levels else len(self.top)) if back else (self.levels, self.top, 0)
        a, b = (n - 1 - a, n - 1 - b) if back else (a.copy(), b.copy())
        began = a.copy()
        live, ended = np.arange(len(a)), []
        for level in levels:
            x, y = a[live], b[live]
            ux, uy = level.up[x], level.up[y]
            inside = (level.down[ux] != x) | (level.down[uy] != y)  # both at starts: the next string decides
            equal = level.symbol[x] == level.symbol[y]
            stop = inside & ~equal
            if level.late is None:
                left, right = level.down[ux + 1] - x, level.down[uy + 1] - y
                ahead = np.where(inside & equal, np.minimum(left, right), 0)
                stop |= inside & (left != right)
            else:
                ahead = (inside & equal).astype(np.int64)
            x, y = x + ahead, y + ahead
            a[live], b[live] = x, y
            ended.append(live[stop])
            go = ~stop
            live = live[go]
            a[live], b[live] = level.up[np.minimum(x[go], len(level.up) - 1)], level.up[np.minimum(y[go], len(level.up) - 1)]
        walking = live
        while len(walking):
            walking = walking[top[a[walking]] == top[b[walking]]]
            a[walking] += 1
            b[walking] += 1
        for level, stopped in zip(levels[::-1], ended[::-1]):
            # the symbols of the next string differ: at most one step of this one is left
            x, y = level.down[a[live]].astype(np.int64), level.down[b[live]].astype(np.int64)
            equal = level.symbol[x] == level.symbol[y]
            ahead = equal.astype(np.int64)
            if level.late is None:
                ux, uy = level.up[x], level.up[y]
                ahead = np.where(equal, np.minimum(level.down[ux + 1] - x, level.down[uy + 1] - y), 0)
            a[live], b[live] = x + ahead, y + ahead
            live = np.concatenate((live, stopped))
        return a - began


def grid(size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Candidates (document, place, period), some thousands at a time: for every period the multiples of a step that no run can avoid.

    A run of period p has at least max(LEAST_WORDS - p, (LEAST_PERIODS - 1) * p) places in a row
    that equal the one p ahead, so one of them is a multiple of that number: about n log n places.
    """
    doc = np.flatnonzero(size >= LEAST_WORDS)
    most = size[doc] // LEAST_PERIODS
    ends = np.cumsum(most)
    low, total = 0, int(ends[-1]) if len(ends) else 0
    while low < total:
        high = min(total, low + CANDIDATES // 4)
        number = np.arange(low, high)
        of = np.searchsorted(ends, number, "right")
        period = number - (ends[of] - most[of]) + 1
        step = np.maximum(LEAST_WORDS - period, (LEAST_PERIODS - 1) * period)
        count = (size[doc[of]] - 1 - period) // step + 1
        done = 0
        sums = np.cumsum(count)
        while done < len(count):
            until = max(done + 1, int(np.searchsorted(sums, (sums[done - 1] if done else 0) + CANDIDATES, "right")))
            some = slice(done, until)
            times = count[some]
            nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            yield np.repeat(doc[of[some]], times), nth * np.repeat(step[some], times), np.repeat(period[some], times)
            done = until
        low = high


def periodic_runs(words: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length, period) of all runs, by document, start and period; ``words``: equal numbers for equal words, document by document."""
    none = np.zeros(0, np.int64)
    if not (size >= LEAST_WORDS).any():
        return none, none, none, none
    n_words = int(words.max(initial=0)) + 1
    n = len(size)
    begin = np.cumsum(size) - size + np.arange(n) + 1  # a separator stands before every document, one after the last
    line = np.empty(len(words) + n + 1, np.int64)
    inner = np.ones(len(line), bool)
    inner[begin - 1] = inner[-1] = False
    line[inner], line[~inner] = words, n_words + np.arange(n + 1)
    grammar, found = None, []
    for doc, place, period in grid(size):
        at = begin[doc] + place
        hit = np.flatnonzero(line[at] == line[at + period])
        if not len(hit):
            continue
        grammar = grammar or Grammar(line, n_words)
        doc, at, period = doc[hit], at[hit], period[hit]
        low = at - grammar.common(at - 1, at - 1 + period, back=True)
        high = at + period + grammar.common(at, at + period)
        good = high - low >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period)
        found.append(np.stack([doc[good], low[good] - begin[doc[good]], high[good] - low[good], period[good]]))
    if not found:
        return none, none, none, none
    doc, start, length, period = np.concatenate(found, axis=1)
    order = np.lexsort((period, length, start, doc))
    doc, start, length, period = doc[order], start[order], length[order], period[order]
    new = np.ones(len(doc), bool)  # of one stretch the smallest period counts
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    doc, start, length, period = doc[new], start[new], length[new], period[new]
    order = np.lexsort((period, start, doc))
    return doc[order], start[order], length[order], period[order]


def numbered_words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for every word ``[^\\x20\\x09-\\x0D]+`` of the block, equal for equal words, and the words of every document."""
    inside = WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    start = np.flatnonzero(inside & (~np.concatenate(([False], inside[:-1])) | edge[:-1]))
    before = np.concatenate(([0], np.cumsum(inside)))
    offsets = np.append(before[start], before[-1]).astype(np.int64)
    held = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[inside]))])
    return held.dictionary_encode().indices.to_numpy().astype(np.int64), np.bincount(np.searchsorted(at, start, "right") - 1, minlength=len(at) - 1)


def rewritten(n: int, h: int | None) -> np.ndarray | None:
    """Which original word stands at each place of a document that is made periodic from one place on; None: it isn't."""
    if h is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    place = np.arange(n)
    place[a:] = a + (place[a:] - a) % period
    return place


def judged(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The result's rows of a batch (doc_id, text, h)."""
    data, at = utf8(batch.column(1))
    words, size = numbered_words(data, at)
    first = np.cumsum(size) - size
    moved = {k: place for k, (n, h) in enumerate(zip(size.tolist(), batch.column(2).to_pylist())) if (place := rewritten(n, h)) is not None}
    for k, place in moved.items():
        part = slice(first[k], first[k] + size[k])
        words[part] = words[part][place]
    doc, start, length, period = periodic_runs(words, size)
    bounds = np.searchsorted(doc, np.arange(len(size) + 1))
    raw, nothing = data.tobytes(), hashlib.sha256(b"").hexdigest()
    rows = []
    for k, (low, high) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        text = raw[at[k] : at[k + 1]].split()  # at the same six bytes
        if k in moved:
            text = [text[i] for i in moved[k].tolist()]
        if low == high:
            rows.append((0, None, None, None, None, nothing, hashlib.sha256(b" ".join(text)).hexdigest()))
            continue
        s, n, q = start[low:high], length[low:high], period[low:high]
        change = np.zeros(len(text) + 1, np.int64)
        np.add.at(change, s + q, 1)
        np.add.at(change, s + n, -1)
        kept = [text[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
        best = int(np.lexsort((q, s, -(n / q)))[0])  # quotients of numbers below 2^26 differ as doubles where they differ
        listed = "".join(f"{x},{y},{z}\n" for x, y, z in zip(s.tolist(), n.tolist(), q.tolist()))
        top = int(s[best]), int(n[best]), int(q[best])
        rows.append((high - low, *top, 1000 * top[1] // top[2], hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest()))
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays(
        [batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:5]), *(pa.array(c, pa.string()) for c in columns[5:])],
        names=["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"],
    )


def period_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_runs, the run with the greatest exponent, digests of all runs and of the text without repetitions.

    A run is a longest stretch of words with smallest period q and at least max(24, 3 q) words; of
    each, all words after the first period go.  Documents whose crc32(doc_id as text) ends in the
    digit 0 are made periodic first.  No shuffle: each step compresses about a megabyte of text, or
    one longer text, in memory of some hundred bytes a word.  Null texts are empty; a row without
    doc_id is judged as it is; repeated rows are judged each; further columns are left out; an empty
    table gives no rows.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            yield judged(batch)

    key = F.col(f"`{doc_id}`").cast("long")
    plain = docs.select(key.alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"), F.crc32(key.cast("string")).alias("h"))
    return plain.mapInArrow(judge, RESULT)
