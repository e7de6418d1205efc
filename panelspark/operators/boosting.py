"""Boosted trees and forests refitted at every rolling origin, with forecasts fed back into their lags.

A tree is grown from sums of rows and residuals per (origin, node, feature, bin).  Blocks of a long series give such sums
on their own and Spark adds them up, so no task holds a series and the trees of all origins of all series grow one level
a job.  Origins are taken in groups: a block is read once for a whole group, whose trees are its one row of state.

Targets are whole numbers (``UNIT`` to a standard deviation), so the sums are exact and don't depend on the order in which
blocks arrive: a job repeated after a lost executor grows the same trees.

A refit per origin costs rows x origins x trees; the sums that are shuffled grow with origins alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .backtest import with_origin
from .features import add_past_features
from .forecast import tails
from .lineage import cut, stored
from .ordered import attach
from .split import SplitSpec

KEY = "series_id"
BLOCK_ROWS = 1 << 16
MODELS = 128
UNIT = 1 << 20
#: Residuals are squared at this many units, so that the squares of a block add up exactly.
COARSE = 1 << 10
LOSS = -1


@dataclass(frozen=True)
class Trees:
    """``members`` above 1 is a forest: each member sees its own bootstrap of the rows and ``share`` of the features at a node.

    ``patience`` rounds without a smaller error on the held-out suffix of the history end the boosting; 0 holds nothing out.
    """

    lags: Sequence[int] = (1, 2, 12)
    month: bool = True
    rounds: int = 20
    depth: int = 2
    rate: float = 0.3
    bins: int = 32
    least: int = 3
    ridge: float = 1.0
    patience: int = 3
    members: int = 1
    share: float = 1.0
    seed: int = 42

    def __post_init__(self) -> None:
        if self.members > 1 and self.patience:
            raise ValueError("a forest has no rounds to stop")
        if not 13 <= self.bins <= 256:
            raise ValueError("bins: 13 to 256")

    @property
    def n_features(self) -> int:
        return len(self.lags) + self.month

    @property
    def n_nodes(self) -> int:
        return 2 ** (self.depth + 1) - 1


def forest(lags: Sequence[int] = (1, 2, 12), members: int = 20, depth: int = 4, share: float = 0.6, **settings) -> Trees:
    """Trees side by side: one round at full rate, nothing held out."""
    return Trees(lags=lags, rounds=1, depth=depth, rate=1.0, ridge=0.0, patience=0, members=members, share=share, **settings)


def _first(partition: str) -> Column:
    return F.col("n_train") if partition == "validation" else F.col("n_train") + F.col("n_val")


def _bin(value: Column, edges: Column) -> Column:
    return F.size(F.filter(edges, lambda e: e < value))


# ---------------------------------------------------------------- blocks and models


def _blocks(parts: DataFrame, numbers: DataFrame, shape: Trees, partition: str, block: int) -> DataFrame:
    """(series, blk, first_pos, pos, q, x): rows with a target and all lags, packed by block; ``x`` holds a byte per feature and row."""
    end = F.col("n_train") + F.col("n_val") if partition == "validation" else F.col("n")
    names = [f"lag_{v}" for v in shape.lags]
    rows = add_past_features(parts.filter(F.col("pos") < end), shape.lags).dropna(subset=["target", *names])
    rows = attach(rows, numbers, KEY, "pos")
    features = [_bin(F.col(c), F.col("edges")) for c in names] + ([F.month("date") - 1] if shape.month else [])
    whole = F.rint((F.col("target") - F.col("centre")) / F.col("spread") * UNIT).cast("bigint")
    rows = rows.select(KEY, F.floor(F.col("pos") / block).cast("bigint").alias("blk"), "pos", whole.alias("q"), *[f.cast("int").alias(f"x{i}") for i, f in enumerate(features)])
    kind = parts.schema[KEY].dataType.simpleString()

    def pack(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        x = pdf[[f"x{i}" for i in range(shape.n_features)]].to_numpy(np.uint8).T
        pos = pdf.pos.to_numpy(np.int64)
        return pd.DataFrame([(key[0], key[1], pos[0], pos.tobytes(), pdf.q.to_numpy(np.int64).tobytes(), np.ascontiguousarray(x).tobytes())], columns=[KEY, "blk", "first_pos", "pos", "q", "x"])

    return stored(rows.groupBy(KEY, "blk").applyInPandas(pack, f"{KEY} {kind}, blk bigint, first_pos bigint, pos binary, q binary, x binary"))


def _numbers(parts: DataFrame, shape: Trees, partition: str) -> DataFrame:
    """Centre, spread and bin edges of each series, from the rows before its first origin alone."""
    known = parts.filter(F.col("pos") < _first(partition)).filter(F.col("target").isNotNull())
    shares = [i / shape.bins for i in range(1, shape.bins)]
    spread = F.stddev_pop("target")
    out = known.groupBy(KEY).agg(F.avg("target").alias("centre"), F.when(spread > 0, spread).otherwise(1.0).alias("spread"), F.percentile_approx(F.col("target").cast("double"), shares, 10000).alias("edges"))
    return cut(out.withColumn("edges", F.array_distinct("edges")))


def _models(parts: DataFrame, numbers: DataFrame, spec: SplitSpec, shape: Trees, partition: str) -> DataFrame:
    """One row per group of origins, without trees yet.

    ``fit_ends`` is where the held-out suffix of each history starts; ``kept`` is -1 while a model still grows.
    """
    per = max(1, MODELS // shape.members)
    asked = with_origin(parts, spec, partition).select(KEY, "origin", _first(partition).alias("_first")).distinct()
    rows = F.greatest(F.col("origin") - max(shape.lags), F.lit(0))
    # the share and the least number of rows of ``split.suffix_split``, counted in rows that have all lags
    held = F.when(rows < 7, 0).otherwise(F.least(F.greatest(F.lit(5), F.ceil(rows * F.lit(0.2))), rows - 1)) if shape.patience else F.lit(0)
    asked = asked.withColumn("grp", F.floor((F.col("origin") - F.col("_first")) / (spec.horizon * per)).cast("bigint")).withColumn("fit_end", (F.col("origin") - held).cast("bigint"))
    listed = asked.groupBy(KEY, "grp").agg(F.sort_array(F.collect_list(F.struct("origin", "fit_end"))).alias("_o"))
    empty = F.lit(b"")
    out = listed.select(
        KEY, "grp", F.col("_o.origin").alias("origins"), F.col("_o.fit_end").alias("fit_ends"),
        F.array_repeat(F.lit(-1), F.size("_o") * shape.members).alias("kept"),
        empty.alias("feature"), empty.alias("threshold"), empty.alias("value"), empty.alias("loss"),
    )
    return stored(out.join(numbers, KEY))


def _opened(row, shape: Trees) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature (-1: a leaf), highest bin that goes left, and value of (model, tree, node)."""
    size = (len(row.kept), -1, shape.n_nodes) if len(row.feature) else (len(row.kept), 0, shape.n_nodes)
    return tuple(np.frombuffer(b, kind).reshape(size) for b, kind in ((row.feature, np.int16), (row.threshold, np.int16), (row.value, np.float64)))


def _node(feature: np.ndarray, threshold: np.ndarray, x: np.ndarray, depth: int) -> np.ndarray:
    """The node of one tree that each column of ``x`` falls into."""
    node, column = np.zeros(x.shape[1], np.int64), np.arange(x.shape[1])
    for _ in range(depth):
        f = feature[node]
        right = x[f, column] > threshold[node]
        node = np.where(f >= 0, 2 * node + 1 + right, node)
    return node


def _predicted(feature: np.ndarray, threshold: np.ndarray, value: np.ndarray, x: np.ndarray, depth: int) -> np.ndarray:
    """Sum over the trees of one model."""
    total = np.zeros(x.shape[1])
    for f, c, v in zip(feature, threshold, value):
        total += v[_node(f, c, x, depth)]
    return total


POISSON = np.cumsum([math.exp(-1.0) / math.factorial(i) for i in range(9)])


def _weights(pos: np.ndarray, member: int, seed: int) -> np.ndarray:
    """How often each row is drawn by a member: Poisson with mean 1, from the row's position."""
    with np.errstate(over="ignore"):
        z = pos.astype(np.uint64) + np.uint64(seed * 1_000_003 + member + 1) * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
        z ^= z >> np.uint64(31)
    return np.searchsorted(POISSON, z.astype(np.float64) / 2.0**64, side="right").astype(np.int64)


# ---------------------------------------------------------------- one level


CELL = "k int, node int, f int, bin int, n bigint, g bigint"


def _sums(blocks: DataFrame, models: DataFrame, shape: Trees, spec: SplitSpec, done: int, level: int) -> DataFrame:
    """Rows and residuals per (model, node of this level, feature, bin); at level 0 also the squared error of the held-out suffix."""
    groups = models.groupBy(KEY).agg(F.max("grp").alias("_last"))
    reach = models.select(KEY, "grp", F.element_at("origins", -1).alias("_end"), "origins", "fit_ends", "kept", "feature", "threshold", "value").filter(F.array_contains("kept", -1))
    units = attach(blocks, groups, KEY, "blk").withColumn("grp", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_last")))).drop("_last")
    units = attach(units, reach, [KEY, "grp"], "blk").filter(F.col("first_pos") < F.col("_end"))
    kind = models.schema[KEY].dataType.simpleString()
    lowest = 2**level - 1

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = []
            for row in frame.itertuples(index=False):
                pos, q = np.frombuffer(row.pos, np.int64), np.frombuffer(row.q, np.int64)
                x = np.frombuffer(row.x, np.uint8).reshape(shape.n_features, -1)
                feature, threshold, value = _opened(row, shape)
                for k in np.flatnonzero(np.asarray(row.kept) < 0):
                    origin, fit_end = row.origins[k // shape.members], row.fit_ends[k // shape.members]
                    upto, fit = np.searchsorted(pos, (origin, fit_end))
                    if upto == 0:
                        continue
                    rest = q[:upto] - np.rint(_predicted(feature[k, :done], threshold[k, :done], value[k, :done], x[:, :upto], shape.depth)).astype(np.int64)
                    if level == 0 and upto > fit:
                        far = np.rint(rest[fit:] / COARSE)
                        found.append((row, k, 0, LOSS, np.zeros(1, np.int64), np.array([upto - fit]), np.array([far @ far])))
                    if fit == 0:
                        continue
                    rest, mine = rest[:fit], x[:, :fit]
                    node = _node(feature[k, done], threshold[k, done], mine, level) if level else np.zeros(fit, np.int64)
                    drawn = _weights(pos[:fit], k % shape.members, shape.seed) if shape.members > 1 else np.ones(fit, np.int64)
                    drawn = drawn * (node >= lowest)  # rows that ended in a leaf above this level count no more
                    at = np.maximum(node - lowest, 0) * shape.bins
                    for f in range(shape.n_features):
                        n = np.bincount(at + mine[f], drawn, 2**level * shape.bins)
                        g = np.bincount(at + mine[f], drawn * rest, 2**level * shape.bins)
                        full = np.flatnonzero(n)
                        found.append((row, k, full // shape.bins + lowest, f, full % shape.bins, n[full], g[full]))
            if found:
                yield pd.concat([pd.DataFrame({KEY: getattr(r, KEY), "grp": r.grp, "k": k, "node": node, "f": f, "bin": b, "n": n.astype(np.int64), "g": g.astype(np.int64)}) for r, k, node, f, b, n, g in found if len(b)])

    cells = units.select(KEY, "grp", "pos", "q", "x", "origins", "fit_ends", "kept", "feature", "threshold", "value").mapInPandas(add, f"{KEY} {kind}, grp bigint, {CELL}")
    return cells.groupBy(KEY, "grp", "k", "node", "f", "bin").agg(F.sum("n").alias("n"), F.sum("g").alias("g"))


def _split(n: np.ndarray, g: np.ndarray, allowed: np.ndarray, shape: Trees) -> tuple[int, int] | None:
    """Feature and highest left bin of the best split of a node, from its (feature, bin) sums; ties: first feature, lowest bin."""
    left_n, left_g = n.cumsum(axis=1)[:, :-1], g.cumsum(axis=1)[:, :-1]
    all_n, all_g = n[0].sum(), g[0].sum()
    right_n, right_g = all_n - left_n, all_g - left_g
    may = (left_n >= shape.least) & (right_n >= shape.least) & allowed[:, None]
    if not may.any():
        return None
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left_g**2 / (left_n + shape.ridge) + right_g**2 / (right_n + shape.ridge) - all_g**2 / (all_n + shape.ridge)
    gain = np.where(may, gain, -np.inf)
    best = int(gain.argmax())
    # a gain below the rounding of its own terms is none
    if gain.flat[best] <= 1e-9 * (1.0 + all_g**2 / (all_n + shape.ridge)):
        return None
    return best // gain.shape[1], best % gain.shape[1]


def _allowed(shape: Trees, member: int, node: int) -> np.ndarray:
    out = np.ones(shape.n_features, bool)
    if shape.share < 1:
        out[:] = False
        out[np.random.default_rng([shape.seed, member, node]).permutation(shape.n_features)[: math.ceil(shape.share * shape.n_features)]] = True
    return out


def _settled(kept: np.ndarray, loss: np.ndarray, held: np.ndarray, done: int, patience: int, last: bool) -> np.ndarray:
    """Trees kept by each model: those up to the smallest error of its suffix, once it has waited long enough."""
    for k in np.flatnonzero(kept < 0):
        best = int(loss[k, 1 : done + 1].argmin()) + 1 if held[k] and done else done
        if last or (held[k] and done - best >= patience):
            kept[k] = best
    return kept


def _grown(models: DataFrame, cells: DataFrame, shape: Trees, done: int, level: int, last: bool) -> DataFrame:
    """The models with one more level; ``done`` trees are complete, the first of them is the mean of the fitted rows."""

    def grow(key, held_rows: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        out = held_rows.copy()
        if not len(out):
            return out
        row = next(out.itertuples(index=False))
        kept, (feature, threshold, value) = np.array(row.kept), _opened(row, shape)
        size = len(kept)
        loss = np.frombuffer(row.loss, np.int64).reshape(size, -1) if len(row.loss) else np.zeros((size, 0), np.int64)
        errors = found[found.f == LOSS]
        held = np.repeat(np.asarray(row.origins) > np.asarray(row.fit_ends), shape.members)
        if level == 0:
            now = np.zeros(size, np.int64)
            now[errors.k.to_numpy()] = errors.g.to_numpy()
            loss = np.concatenate([loss, now[:, None]], axis=1)
            kept = _settled(kept, loss, held, done, shape.patience, last)
            fresh = (size, 1, shape.n_nodes)
            feature, threshold, value = (np.concatenate([a, np.full(fresh, v, a.dtype)], axis=1) for a, v in ((feature, -1), (threshold, 0), (value, 0.0)))
        else:
            feature, threshold, value = feature.copy(), threshold.copy(), value.copy()
        sums = found[found.f != LOSS]
        if done == 0:  # a model without rows has no forecast
            kept[np.setdiff1d(np.arange(size), sums.k.unique())] = 0
        if last:
            feature, threshold, value = feature[:, :-1], threshold[:, :-1], value[:, :-1]
        else:
            for (k, node), one in sums.groupby(["k", "node"], sort=False):
                if kept[k] >= 0:
                    continue
                n, g = (np.zeros((shape.n_features, shape.bins)) for _ in range(2))
                n[one.f, one.bin], g[one.f, one.bin] = one.n, one.g
                if done == 0:
                    value[k, 0, 0] = g[0].sum() / n[0].sum()
                    continue
                if level == 0:
                    value[k, done, 0] = shape.rate * g[0].sum() / (n[0].sum() + shape.ridge)
                best = _split(n, g, _allowed(shape, k % shape.members, node), shape)
                if best is not None:
                    f, b = best
                    feature[k, done, node], threshold[k, done, node] = f, b
                    for child, part in ((2 * node + 1, slice(None, b + 1)), (2 * node + 2, slice(b + 1, None))):
                        value[k, done, child] = shape.rate * g[f, part].sum() / (n[f, part].sum() + shape.ridge)
        packed = {"kept": kept.tolist(), **{c: np.ascontiguousarray(a).tobytes() for c, a in (("feature", feature), ("threshold", threshold), ("value", value), ("loss", loss))}}
        for column, made in packed.items():
            out[column] = [made]
        return out

    return stored(models.groupBy(KEY, "grp").cogroup(cells.groupBy(KEY, "grp")).applyInPandas(grow, models.schema))


def fit_trees(parts: DataFrame, spec: SplitSpec, shape: Trees = Trees(), partition: str = "validation", block: int = BLOCK_ROWS) -> DataFrame:
    """Trees of every origin, one row per group of origins; see ``tree_fits`` and ``boosted_forecast``.

    A history is the rows before its origin that have a target and all lags.  Its last fifth (at least five positions; none
    below seven) is held out where ``patience`` is set and ends the boosting; the trees up to its smallest error stay.
    Rows without a target or a lag are left out; a history without rows gives no forecast.
    """
    parts = cut(parts)
    numbers = _numbers(parts, shape, partition)
    blocks = _blocks(parts, numbers, shape, partition, block)
    models = _models(parts, numbers, spec, shape, partition)
    for done in range(shape.rounds + 1):
        for level in range(shape.depth if done else 1):
            models = _grown(models, _sums(blocks, models, shape, spec, done, level), shape, done, level, False)
        if models.filter(F.array_contains("kept", -1)).isEmpty():
            return models
    return _grown(models, _sums(blocks, models, shape, spec, shape.rounds + 1, 0), shape, shape.rounds + 1, 0, True)


def tree_fits(models: DataFrame, shape: Trees = Trees()) -> DataFrame:
    """(series, origin, held_from, member, rounds): rounds of trees kept beyond the mean; ``held_from`` is null where nothing is held out."""
    per = models.select(KEY, "origins", "fit_ends", F.posexplode("kept").alias("_k", "_kept"))
    at = F.floor(F.col("_k") / shape.members).cast("int")
    origin, end = F.get("origins", at), F.get("fit_ends", at)
    return per.select(KEY, origin.alias("origin"), F.when(end < origin, end).alias("held_from"), F.pmod("_k", F.lit(shape.members)).cast("int").alias("member"), F.when(F.col("_kept") > 0, F.col("_kept") - 1).alias("rounds"))


def boosted_forecast(parts: DataFrame, spec: SplitSpec, shape: Trees = Trees(), partition: str = "validation", block: int = BLOCK_ROWS) -> DataFrame:
    """(series, origin, step, pos, date, y, yhat) of trees refitted at every origin on all rows before it.

    Later steps read earlier forecasts of their origin as lags.  Every row to be forecast has a row; ``yhat`` is null
    where the history has no rows or lacks a value a lag needs.
    """
    models = fit_trees(parts, spec, shape, partition, block)
    wanted = with_origin(parts, spec, partition)
    reach = max(shape.lags)
    steps = wanted.groupBy(KEY, "origin").agg(F.sort_array(F.collect_list(F.struct("step", F.month("date").alias("month")))).alias("_s"))
    ready = tails(parts, wanted, reach).filter((F.size("tail") == reach) & ~F.exists("tail", F.isnull))
    state = ready.join(steps, [KEY, "origin"]).select(KEY, "origin", "tail", F.col("_s.month").alias("months"))
    spots = models.select(KEY, "grp", F.posexplode("origins").alias("at", "origin"))
    state = state.join(spots, [KEY, "origin"])
    kind = parts.schema[KEY].dataType.simpleString()

    def run(key, asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(held):
            row = next(held.itertuples(index=False))
            feature, threshold, value = _opened(row, shape)
            edges = np.asarray(row.edges)
            for one in asked.itertuples(index=False):
                mine = [(k, row.kept[k]) for k in range(one.at * shape.members, (one.at + 1) * shape.members) if row.kept[k] > 0]
                said = [float(v) for v in one.tail]
                for step, month in enumerate(one.months if mine else [], start=1):
                    x = [np.searchsorted(edges, said[-v], side="left") for v in shape.lags] + ([month - 1] if shape.month else [])
                    x = np.array(x, np.uint8)[:, None]
                    guess = [_predicted(feature[k, :t], threshold[k, :t], value[k, :t], x, shape.depth)[0] for k, t in mine]
                    said.append(float(row.centre + row.spread * np.mean(guess) / UNIT))
                    out.append((key[0], one.origin, step, said[-1]))
        return pd.DataFrame(out, columns=[KEY, "origin", "step", "yhat"])

    fitted = models.withColumnsRenamed({KEY: "_key", "grp": "_grp"})
    guesses = state.groupBy(KEY, "grp").cogroup(fitted.groupBy("_key", "_grp")).applyInPandas(run, f"{KEY} {kind}, origin bigint, step bigint, yhat double")
    return wanted.join(guesses, [KEY, "origin", "step"], "left").select(KEY, "origin", "step", "pos", "date", F.col("target").alias("y"), "yhat")
