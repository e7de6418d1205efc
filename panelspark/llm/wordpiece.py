"""Greedy word-piece lengths by a linear longest-match automaton."""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .blocks import WORD, Polynomial, remembered, steps, texts, utf8

#: Bytes of text that share one pass over their distinct words; words over LONG bytes are walked alone.
PASS_BYTES, LONG = 8 << 20, 48
NOWHERE = -1


class Automaton:
    """A trie of word-initial pieces and one of later pieces, with failure links and popped-token counts.

    The link of a node leads to the state after the greedy tokens of its string are popped;
    ``popped`` says how many these are.  A word is walked byte by byte without building pieces; a
    word without a greedy tokenisation is one unknown token.
    """

    def __init__(self, initial: set[bytes], later: set[bytes]):
        children: list[dict[int, int]] = [{}, {}]  # 0: start of a word, 1: later in a word
        final = [False, False]
        for root, pieces in ((0, initial), (1, later)):
            for piece in pieces:
                node = root
                for byte in piece:
                    step = children[node].get(byte)
                    if step is None:
                        step = children[node][byte] = len(children)
                        children.append({})
                        final.append(False)
                    node = step
                if piece:
                    final[node] = True
        link, popped = [NOWHERE] * len(children), [0] * len(children)
        queue = deque([0, 1])
        while queue:
            node = queue.popleft()
            for byte, step in children[node].items():
                if final[step]:
                    link[step], popped[step] = 1, 1
                else:
                    at, count = link[node], popped[node]
                    while at != NOWHERE and byte not in children[at]:
                        count += popped[at]
                        at = link[at]
                    if at != NOWHERE:
                        link[step], popped[step] = children[at][byte], count
                queue.append(step)
        self.children = children
        self.link, self.popped = np.array(link, np.int64), np.array(popped, np.int64)
        edges = sorted((node << 8 | byte, step) for node, held in enumerate(children) for byte, step in held.items())
        self.edges = np.array([e for e, _ in edges] or [-1], np.int64)
        self.steps = np.array([s for _, s in edges] or [0], np.int64)

    @classmethod
    def of_vocabulary(cls, path: str) -> Automaton:
        """The byte-level vocabulary of a tokenizer file: pieces marked with a leading blank start a word, the others go on."""

        def load() -> Automaton:
            shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
            byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
            with open(path, encoding="utf-8") as file:
                names = json.load(file)["model"]["vocab"]
            pieces = [bytes(byte_of[c] for c in name) for name in names if all(c in byte_of for c in name)]
            return cls({p[1:] for p in pieces if p[:1] == b" " and len(p) > 1}, {p for p in pieces if p[:1] != b" "})

        return remembered(f"automaton {path}", load)

    def count(self, word: bytes) -> tuple[int, bool]:
        """Tokens of one word, and whether it is unknown."""
        node, tokens = 0, 0
        for byte in word:
            while byte not in self.children[node]:
                tokens += int(self.popped[node])
                node = int(self.link[node])
                if node == NOWHERE:
                    return 1, True
            node = self.children[node][byte]
        while node != 1:
            tokens += int(self.popped[node])
            node = int(self.link[node])
            if node == NOWHERE:
                return 1, True
        return tokens, False

    def counts(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of many words of a block, and which are unknown."""
        size = end - start
        tokens, unknown = np.zeros(len(start), np.int64), np.zeros(len(start), bool)
        for k in np.flatnonzero(size > LONG):
            tokens[k], unknown[k] = self.count(data[start[k] : end[k]].tobytes())
        live = np.flatnonzero(size <= LONG)
        live = live[np.argsort(-size[live], kind="stable")]
        node = np.zeros(len(live), np.int64)
        for step in range(LONG + 1):
            if not len(live):
                break
            ended = size[live] == step
            byte = data[np.minimum(start[live] + step, len(data) - 1)].astype(np.int64)
            todo = np.arange(len(live))
            while len(todo):
                at = node[todo]
                key = at << 8 | byte[todo]
                place = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
                over = ended[todo]
                go = ~over & (self.edges[place] == key)
                node[todo[go]] = self.steps[place[go]]
                stop = over & (at == 1)
                fall = todo[~go & ~stop]
                tokens[live[fall]] += self.popped[node[fall]]
                node[fall] = self.link[node[fall]]
                lost = node[fall] == NOWHERE
                unknown[live[fall[lost]]] = True
                todo = fall[~lost]
            keep = ~ended & (node != NOWHERE)
            live, node = live[keep], node[keep]
        tokens[unknown] = 1
        return tokens, unknown


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """One row per document: doc_id, n_words, n_tokens, n_unknown: greedy longest-match word pieces of every whole text.

    Words are ``[^\\x20\\x09-\\x0D]+``.  Null and empty texts have no words; repeated rows and rows
    without doc_id are counted like any other; an empty table gives no rows.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton.of_vocabulary(vocabulary)
        for batch in steps(batches, limit=PASS_BYTES):
            data, at = utf8(batch.column(1))
            inside = WORD[data]
            edge = np.zeros(len(data) + 1, bool)
            edge[at] = True
            start = np.flatnonzero(inside & (~np.concatenate(([False], inside[:-1])) | edge[:-1])) if len(data) else np.zeros(0, np.int64)
            end = np.flatnonzero(inside & (~np.concatenate((inside[1:], [False])) | edge[1:])) + 1 if len(data) else start
            n_words = n_tokens = n_unknown = np.zeros(batch.num_rows)
            if len(start):
                doc = np.searchsorted(at, start, "right") - 1
                _, first, which = np.unique(Polynomial(data)(start, end), return_index=True, return_inverse=True)
                tokens, unknown = automaton.counts(data, start[first], end[first])
                n_words = np.bincount(doc, minlength=batch.num_rows)
                n_tokens = np.bincount(doc, tokens[which], batch.num_rows)
                n_unknown = np.bincount(doc, unknown[which], batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array(x.astype(np.int64)) for x in (n_words, n_tokens, n_unknown)], names=["doc_id", "n_words", "n_tokens", "n_unknown"])

    return texts(docs).mapInArrow(count, "doc_id long, n_words long, n_tokens long, n_unknown long")
