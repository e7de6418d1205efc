"""Toxicity by a bidirectional gated recurrent network with attention pooling over character and word inputs."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import LOWER, U64, Polynomial, steps, texts, tidied, utf8

#: Most labelled documents of each class that a fit takes, by the order of a hash of doc_id.
FIT_TOXIC, FIT_CLEAN = 2500, 3500
FOLDS, HELD_OUT = 5, 0
#: Words of a window and from one window to the next; letters of a character gram; documents of the fit in which an input must occur.
WINDOW, STRIDE, GRAM, LEAST = 40, 20, 4, 4
#: Sizes of the word and character embeddings, of a direction's state and of the attention.
WORD_DIM, CHAR_DIM, STATE, ATTEND = 10, 10, 12, 12
BATCH, EPOCHS, LEAST_STEPS, RATE, SEED = 128, 8, 250, 0.01, 7
STEP = 2 << 20
#: Bytes of text, documents and windows that the fit holds in one step.
BLOCK, BLOCK_DOCS, BLOCK_WINDOWS = 1 << 20, 256, 1024

_inside = np.ones(256, bool)
_inside[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = False


class Words:
    """Words (digits, letters, anything beyond ASCII; A-Z lower-cased) of a block, and the hashes of distinct ones and of their character grams."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        data = LOWER[data]
        inside = _inside[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[at] = True
        start = np.flatnonzero(inside & (~np.concatenate(([False], inside[:-1])) | edge[:-1])) if len(data) else np.zeros(0, np.int64)
        end = np.flatnonzero(inside & (~np.concatenate((inside[1:], [False])) | edge[1:])) + 1 if len(data) else start
        self.doc = np.searchsorted(at, start, "right") - 1
        hashes = Polynomial(data)
        self.word, first, self.which = np.unique(hashes(start, end), return_index=True, return_inverse=True)
        low, size = start[first], end[first] - start[first]
        # grams of every distinct word: each GRAM bytes, and the shorter ones at its two ends
        count = np.maximum(size - GRAM + 1, 1)
        self.owner = np.repeat(np.arange(len(first)), count)
        place = low[self.owner] + np.arange(len(self.owner)) - np.repeat(np.cumsum(count) - count, count)
        self.gram = hashes(place, np.minimum(place + GRAM, (low + size)[self.owner]))
        self.gram[np.searchsorted(self.owner, np.arange(len(first)))] ^= U64(0x9E3779B97F4A7C15)  # the first gram of a word is one of its own

    @classmethod
    def joined(cls, texts: list[str]) -> Words:
        """Of a list of texts, worked out in blocks of about BLOCK bytes or one text."""
        raw = [t.encode() for t in texts]
        ends = np.cumsum([len(r) for r in raw])
        parts, low = [], 0
        while low < len(raw):
            high = max(low + 1, int(np.searchsorted(ends, ends[low] + BLOCK)))
            at = np.concatenate(([0], np.cumsum([len(r) for r in raw[low:high]]))).astype(np.int64)
            part = cls(np.frombuffer(b"".join(raw[low:high]), np.uint8), at)
            part.doc, part.which = (part.doc + low).astype(np.int32), part.which.astype(np.int32)
            parts.append(part)
            low = high
        out = cls(np.zeros(0, np.uint8), np.zeros(1, np.int64))
        if not parts:
            return out
        out.doc = np.concatenate([p.doc for p in parts])
        out.word, first, number = np.unique(np.concatenate([p.word for p in parts]), return_index=True, return_inverse=True)
        base = np.cumsum([0, *(len(p.word) for p in parts)])
        out.which = np.concatenate([number[b + p.which] for b, p in zip(base, parts)]).astype(np.int32)
        owner, gram = np.concatenate([p.owner + b for b, p in zip(base, parts)]), np.concatenate([p.gram for p in parts])
        cuts = np.searchsorted(owner, first), np.searchsorted(owner, first, "right")
        count = cuts[1] - cuts[0]
        out.owner = np.repeat(np.arange(len(first)), count)
        out.gram = gram[np.repeat(cuts[0], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
        return out


def _places(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """1 + the place in a sorted table, 0 for what isn't there."""
    if not len(table):
        return np.zeros(len(values), np.int64)
    spot = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return np.where(table[spot] == values, spot + 1, 0)


def windows_of(doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """First word of every window and its document: WINDOW words each STRIDE words, so that any passage of half a window lies whole in one."""
    count = np.bincount(doc, minlength=n_docs)
    first = np.cumsum(count) - count
    n = np.where(count > 0, 1 + np.maximum(0, -(-(count - WINDOW) // STRIDE)), 0)
    owner = np.repeat(np.arange(n_docs), n)
    return first[owner] + STRIDE * (np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)), owner


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Embeddings, a GRU in each direction, attention over the states of a window's words, and a logit."""

    def __init__(self, words: np.ndarray, grams: np.ndarray, random: np.random.Generator):
        self.words, self.grams = words, grams
        inputs, both = WORD_DIM + CHAR_DIM, 2 * STATE
        draw = lambda *shape: (random.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"word": (0.3 * random.standard_normal((len(words) + 1, WORD_DIM))).astype(np.float32), "gram": (0.3 * random.standard_normal((len(grams) + 1, CHAR_DIM))).astype(np.float32)}
        self.p["word"][0] = 0
        self.p["gram"][0] = 0
        for side in "fb":
            self.p |= {f"W{side}": draw(inputs, 3 * STATE), f"U{side}": draw(STATE, 3 * STATE), f"c{side}": np.zeros(3 * STATE, np.float32)}
        self.p |= {"A": draw(both, ATTEND), "a": np.zeros(ATTEND, np.float32), "v": draw(ATTEND, 1)[:, 0], "o": draw(both, 1)[:, 0], "bias": np.zeros(1, np.float32)}
        self.slope, self.shift = 1.0, 0.0

    def inputs(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word and gram places of distinct words, and for each the share that one gram has in its mean."""
        return _places(self.words, words.word), _places(self.grams, words.gram), (1 / np.maximum(np.bincount(words.owner, minlength=len(words.word)), 1)).astype(np.float32)

    def vectors(self, words: Words) -> np.ndarray:
        word, gram, share = self.inputs(words)
        mean = np.zeros((len(word), CHAR_DIM), np.float32)
        if len(word):
            cuts = np.searchsorted(words.owner, np.arange(len(word)))
            mean = np.add.reduceat(self.p["gram"][gram], cuts, axis=0) * share[:, None]
        return np.concatenate((self.p["word"][word], mean), axis=1)

    def _run(self, side: str, inner: np.ndarray, order: range, keep: bool):
        """States over time for projected inputs (time, windows, 3 STATE); what the way back needs."""
        h = np.zeros((inner.shape[1], STATE), np.float32)
        U, states, saved = self.p[f"U{side}"], [None] * len(inner), []
        for t in order:
            x, s = inner[t], h @ U[:, : 2 * STATE]
            gates = _sigmoid(x[:, : 2 * STATE] + s)
            z, r = gates[:, :STATE], gates[:, STATE:]
            n = np.tanh(x[:, 2 * STATE :] + (r * h) @ U[:, 2 * STATE :])
            new = h + z * (n - h)
            if keep:
                saved.append((t, h, z, r, n))
            h = states[t] = new
        return np.stack(states), saved

    def logits(self, vectors: np.ndarray, index: np.ndarray, keep: bool = False):
        """Logit of every window; ``index`` (windows, WINDOW) points into ``vectors``, -1 beyond the end of a text."""
        mask = index >= 0
        at = np.maximum(index, 0).T
        states, saved = [], []
        for side, order in (("f", range(WINDOW)), ("b", range(WINDOW - 1, -1, -1))):
            inner = (vectors @ self.p[f"W{side}"] + self.p[f"c{side}"])[at] * mask.T[:, :, None]
            out, back = self._run(side, inner, order, keep)
            states.append(out)
            saved.append(back)
        h = np.concatenate(states, axis=2)
        tanh = np.tanh(h @ self.p["A"] + self.p["a"])
        e = np.where(mask.T, tanh @ self.p["v"], -1e9)
        e = np.exp(e - e.max(axis=0))
        weight = e / e.sum(axis=0)
        pooled = (weight[:, :, None] * h).sum(axis=0)
        logit = pooled @ self.p["o"] + self.p["bias"][0]
        return (logit, (mask, at, saved, h, tanh, weight, pooled)) if keep else logit

    def gradients(self, vectors: np.ndarray, index: np.ndarray, label: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Of the mean cross-entropy: by parameter, and by input vector."""
        logit, (mask, at, saved, h, tanh, weight, pooled) = self.logits(vectors, index, True)
        p, g = self.p, {}
        d = ((_sigmoid(logit) - label) / len(label)).astype(np.float32)
        g["o"], g["bias"] = pooled.T @ d, np.array([d.sum()], np.float32)
        d_pooled = d[:, None] * p["o"]
        d_h = weight[:, :, None] * d_pooled
        d_weight = (h * d_pooled).sum(axis=2)
        d_e = weight * (d_weight - (weight * d_weight).sum(axis=0))
        g["v"] = (tanh * d_e[:, :, None]).sum(axis=(0, 1))
        d_a = d_e[:, :, None] * p["v"] * (1 - tanh**2)
        g["A"], g["a"] = np.tensordot(h, d_a, axes=((0, 1), (0, 1))), d_a.sum(axis=(0, 1))
        d_h = d_h + d_a @ p["A"].T
        d_vectors = np.zeros_like(vectors)
        for k, side in enumerate("fb"):
            U, W = p[f"U{side}"], p[f"W{side}"]
            d_inner, d_U, carry = np.zeros((WINDOW, len(label), 3 * STATE), np.float32), np.zeros_like(U), np.zeros((len(label), STATE), np.float32)
            for t, before, z, r, n in reversed(saved[k]):
                total = d_h[t, :, k * STATE : (k + 1) * STATE] + carry
                d_n = total * z * (1 - n**2)
                d_z = total * (n - before) * z * (1 - z)
                back = d_n @ U[:, 2 * STATE :].T
                d_r = back * before * r * (1 - r)
                gates = np.concatenate((d_z, d_r), axis=1)
                d_U[:, 2 * STATE :] += (r * before).T @ d_n
                d_U[:, : 2 * STATE] += before.T @ gates
                carry = total * (1 - z) + back * r + gates @ U[:, : 2 * STATE].T
                d_inner[t] = np.concatenate((gates, d_n), axis=1)
            d_inner *= mask.T[:, :, None]
            flat, place = d_inner.reshape(-1, 3 * STATE), at.reshape(-1)
            by_word = np.stack([np.bincount(place, flat[:, j], len(vectors)) for j in range(3 * STATE)], axis=1).astype(np.float32)
            g[f"U{side}"], g[f"W{side}"], g[f"c{side}"] = d_U, vectors.T @ by_word, flat.sum(axis=0)
            d_vectors += by_word @ W.T
        return g, d_vectors

    def scores(self, words: Words, n_docs: int, rows: int = 4096) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logits of all overlapping windows, their documents, and their first words."""
        first, owner = windows_of(words.doc, n_docs)
        index = _index(words, first, owner)
        vectors = self.vectors(words)
        out = [self.logits(vectors, index[k : k + rows]) for k in range(0, len(index), rows)]
        return np.concatenate(out) if out else np.zeros(0), owner, first

    def documents(self, words: Words, n_docs: int) -> np.ndarray:
        """Probability of each document: the calibrated one of its most toxic window; 0 without a word."""
        logit, owner, _ = self.scores(words, n_docs)
        best = np.full(n_docs, -np.inf)
        np.maximum.at(best, owner, logit)
        return np.where(np.isfinite(best), _sigmoid(self.slope * np.where(np.isfinite(best), best, 0) + self.shift), 0.0)


def _index(words: Words, first: np.ndarray, owner: np.ndarray) -> np.ndarray:
    place = first[:, None] + np.arange(WINDOW)
    safe = np.minimum(place, max(len(words.doc) - 1, 0))
    if not len(words.doc):
        return np.full((0, WINDOW), -1, np.int32)
    good = (place < len(words.doc)) & (words.doc[safe] == owner[:, None])
    return np.where(good, words.which[safe], -1).astype(np.int32)


def _document_counts(words: Words, chosen: np.ndarray, label: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray], np.ndarray, np.ndarray]:
    """In how many chosen documents, toxic and others, each distinct word and each distinct gram occurs; the grams, and the gram numbers of ``words.gram``."""
    table, code = np.unique(words.gram, return_inverse=True)
    cuts = np.searchsorted(words.owner, np.arange(len(words.word) + 1))
    by_word, by_gram = np.zeros((2, len(words.word))), np.zeros((2, len(table)))
    bounds = np.searchsorted(words.doc, np.arange(0, len(label) + BLOCK_DOCS, BLOCK_DOCS))
    for low, high in zip(bounds[:-1], bounds[1:]):
        mine = low + np.flatnonzero(chosen[words.doc[low:high]])
        doc, word = np.divmod(np.unique(words.doc[mine].astype(np.int64) * len(words.word) + words.which[mine]), max(len(words.word), 1))
        count = np.diff(cuts)[word]
        gram = code[np.repeat(cuts[word], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
        gram_doc, gram = np.divmod(np.unique(np.repeat(doc, count) * len(table) + gram), max(len(table), 1))
        for held, docs, values in ((by_word, doc, word), (by_gram, gram_doc, gram)):
            held[0] += np.bincount(values, label[docs], held.shape[1])
            held[1] += np.bincount(values, 1 - label[docs], held.shape[1])
    return by_word, by_gram, table, code


def calibrated(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic regression of ``y`` on one number, each row counted ``weight`` times; both slightly drawn to 1 and 0."""
    weight = weight / weight.sum()
    inputs, start = np.stack((x, np.ones_like(x)), axis=1).astype(np.float64), np.array([1.0, 0.0])
    at = start.copy()

    def loss(point: np.ndarray) -> float:
        z = inputs @ point
        return float(weight @ (np.logaddexp(0, z) - y * z) + 5e-4 * ((point - start) ** 2).sum())

    for _ in range(100):  # Newton's steps, halved until they gain
        p = _sigmoid(inputs @ at)
        gradient = inputs.T @ (weight * (p - y)) + 1e-3 * (at - start)
        move = np.linalg.solve((inputs * (weight * p * (1 - p))[:, None]).T @ inputs + 1e-3 * np.eye(2), gradient)
        now = loss(at)
        while loss(at - move) > now and np.abs(move).max() > 1e-9:
            move = move / 2
        at = at - move
        if np.abs(move).max() <= 1e-9:
            break
    return float(at[0]), float(at[1])


def fit(rows: list[tuple[str, int]], clean: float = 1.0, toxic: float = 1.0) -> Network:
    """A network fitted to (text, toxic) rows, each of which stands for ``clean`` or ``toxic`` labelled documents.

    A document's label says only that some window is toxic.  The fit starts from the windows whose
    words and character grams are most typical of toxic documents, then takes each document's
    highest-scoring window by the network itself.  A fifth of the rows is kept from the descent and
    calibrates the score of the highest window, each row with the number it stands for.
    """
    random = np.random.default_rng(SEED)
    label = np.array([t for _, t in rows], np.float32)
    words = Words.joined([t for t, _ in rows])
    aside = np.arange(len(rows)) % 5 == 4 if len(rows) >= 50 else np.zeros(len(rows), bool)
    by_word, by_gram, grams, code = _document_counts(words, ~aside, label)
    often_word, often_gram = by_word.sum(axis=0) >= LEAST, by_gram.sum(axis=0) >= LEAST
    word_table, gram_table = words.word[often_word], grams[often_gram]
    net = Network(word_table, gram_table, random)
    if not len(words.doc) or label.min() == label.max():
        net.shift = 0.0 if not len(rows) else (4.0 if label.min() else -4.0)
        net.slope = 0.0
        return net

    def lift(counts: np.ndarray, often: np.ndarray) -> np.ndarray:
        """How far each frequent input is more frequent in toxic documents, in standard errors; 0 for rare ones."""
        p, q = counts[0] / max(label[~aside].sum(), 1), counts[1] / max((1 - label[~aside]).sum(), 1)
        return np.where(often, (p - q) / np.sqrt((p + q + 1e-6) * (1 / max(label.sum(), 1) + 1 / max((1 - label).sum(), 1))), 0.0)

    cuts = np.searchsorted(words.owner, np.arange(len(words.word)))
    value = np.maximum(lift(by_word, often_word), 0.7 * np.maximum.reduceat(lift(by_gram, often_gram)[code], cuts))
    del by_word, by_gram, grams, code
    first, owner = windows_of(words.doc, len(rows))
    spans = range(0, len(first), BLOCK_WINDOWS)
    index = np.concatenate([_index(words, first[k : k + BLOCK_WINDOWS], owner[k : k + BLOCK_WINDOWS]) for k in spans])
    typical = np.concatenate([np.where(index[k : k + BLOCK_WINDOWS] >= 0, value[np.maximum(index[k : k + BLOCK_WINDOWS], 0)], -9.0).max(axis=1) for k in spans])
    moments = {k: [np.zeros_like(x), np.zeros_like(x)] for k, x in net.p.items()}
    step = 0
    # small tables get more passes, so that the descent has steps enough
    epochs = max(EPOCHS, -(-LEAST_STEPS * BATCH // max(1, 2 * int((~aside).sum()))))
    for epoch in range(epochs):
        if epoch in (3 * epochs // 8, 5 * epochs // 8):
            vectors = net.vectors(words)
            typical = np.concatenate([net.logits(vectors, index[k : k + BLOCK_WINDOWS]) for k in spans])
        order = np.lexsort((-typical, owner))
        best = order[np.concatenate(([True], owner[order][1:] != owner[order][:-1]))]
        best = best[~aside[owner[best]]]
        harmless = np.flatnonzero((label[owner] == 0) & ~aside[owner])
        other = random.choice(harmless, min(len(harmless), len(best)), replace=False)
        chosen = np.concatenate((best, other))
        random.shuffle(chosen)
        for low in range(0, len(chosen), BATCH):
            part = chosen[low : low + BATCH]
            used, local = np.unique(index[part], return_inverse=True)
            local = local.reshape(len(part), WINDOW)
            if used[0] < 0:
                used, local = used[1:], local - 1
            sub = _Some(words, used)
            vectors = net.vectors(sub)
            g, d_vectors = net.gradients(vectors, local, label[owner[part]])
            places, gram_places, share = net.inputs(sub)
            g["word"], g["gram"] = np.zeros_like(net.p["word"]), np.zeros_like(net.p["gram"])
            np.add.at(g["word"], places, d_vectors[:, :WORD_DIM])
            np.add.at(g["gram"], gram_places, (d_vectors[:, WORD_DIM:] * share[:, None])[sub.owner])
            g["word"][0] = 0
            g["gram"][0] = 0
            step += 1
            for k, grad in g.items():
                m, v = moments[k]
                m += 0.1 * (grad - m)
                v += 0.001 * (grad**2 - v)
                net.p[k] -= RATE * (1 - epoch / epochs) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)
    vectors = net.vectors(words)
    logit = np.concatenate([net.logits(vectors, index[k : k + BLOCK_WINDOWS]) for k in spans])
    top = np.full(len(rows), -np.inf)
    np.maximum.at(top, owner, logit)
    use = np.isfinite(top) & (aside if aside.any() else True)
    x, y = top[use], label[use]
    slope, shift = calibrated(x, y, np.where(y > 0, toxic, clean))
    net.slope, net.shift = max(slope, 0.05), shift
    return net


class _Some:
    """Some of the distinct words of a block."""

    def __init__(self, words: Words, used: np.ndarray):
        self.word = words.word[used]
        cuts = np.searchsorted(words.owner, used), np.searchsorted(words.owner, used, "right")
        count = cuts[1] - cuts[0]
        self.owner = np.repeat(np.arange(len(used)), count)
        self.gram = words.gram[np.repeat(cuts[0], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]


def fold_of(doc_id, folds: int = FOLDS):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds


def fit_sample(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", folds: int = FOLDS, held: int = HELD_OUT) -> tuple[DataFrame, float, float]:
    """At most FIT_TOXIC and FIT_CLEAN labelled documents outside the held-out fold, and for how many labelled ones a clean and a toxic one stand."""
    marked = labels.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{toxic}`").cast("int").alias("toxic")).filter("doc_id is not null and toxic is not null")
    marked = marked.filter(fold_of(F.col("doc_id"), folds) != held).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    each_clean, each_toxic = (max(1.0, total.get(k, 0) / most) for k, most in ((0, FIT_CLEAN), (1, FIT_TOXIC)))
    rank = F.xxhash64("doc_id")
    some = marked.filter("toxic = 1").orderBy(rank, "doc_id").limit(FIT_TOXIC).unionByName(marked.filter("toxic = 0").orderBy(rank, "doc_id").limit(FIT_CLEAN))
    named = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    # at most FIT_TOXIC + FIT_CLEAN ids
    rows = named.join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    return rows, each_clean, each_toxic


def fitted(sample: DataFrame, clean: float, toxic: float) -> Network:
    """``fit`` of the rows of ``fit_sample`` by doc_id, in one task; only the network's numbers come to the driver."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [row for batch in batches for row in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(vars(fit(rows, clean, toxic)))], pa.binary())], names=["network"])

    # at most FIT_TOXIC + FIT_CLEAN rows
    made = sample.select("doc_id", "text", "toxic").repartition(1).sortWithinPartitions("doc_id").mapInArrow(tidied(learn), "network binary").collect()
    if not made:
        return fit([])
    network = Network.__new__(Network)
    vars(network).update(pickle.loads(bytes(made[0]["network"])))
    return network


def toxicity_scores(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", folds: int = FOLDS, held: int = HELD_OUT) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted; see ``scored_rows``."""
    return scored_rows(docs, labels, doc_id, text, toxic, folds, held).drop("row_hash")


def scored_rows(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", folds: int = FOLDS, held: int = HELD_OUT) -> DataFrame:
    """One row per document: doc_id, row_hash (xxhash64 of its text), held_out, score, predicted.

    Fitted on labelled documents whose crc32(doc_id as text) modulo ``folds`` isn't ``held``; only
    the text is an input.  Every whole text is scored by all its overlapping windows.  A text
    without words scores 0 as does a null one; a missing doc_id counts as empty text for the fold;
    repeated rows get equal scores; null labels are left out; without usable labels every text with
    words scores 0.5; an empty table gives no rows.
    """
    sample, each_clean, each_toxic = fit_sample(docs, labels, doc_id, text, toxic, folds, held)
    network = fitted(sample, each_clean, each_toxic)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, limit=STEP):
            words = Words(*utf8(batch.column(1)))
            value = network.documents(words, batch.num_rows).astype(np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), batch.column(2), pa.array(value), pa.array((value >= 0.5).astype(np.int32))], names=["doc_id", "row_hash", "held_out", "score", "predicted"])

    plain = texts(docs, doc_id, text).withColumn("held_out", fold_of(F.col("doc_id"), folds) == held).withColumn("row_hash", F.xxhash64("text"))
    return plain.mapInArrow(tidied(score), "doc_id long, row_hash long, held_out boolean, score double, predicted int")
