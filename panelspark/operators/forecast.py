"""Forecasters refitted at every rolling origin, written so that no task needs a whole series.

* Least-squares models (autoregression, additive trend and season, elastic net) need only sums of
  products of their features.  These are partial aggregates per stretch between origins, summed
  along the origins; the solve is a few small matrices per row.
* Exponential smoothing with additive parts is affine in its state.  A block of a long series is
  one affine map, maps are chained, and blocks then run in parallel from their known start.  One
  pass gives the state at every origin, so no history is read twice.
* Nearest neighbours search cells around pivots, leaving out cells the triangle inequality excludes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .backtest import with_origin
from .lineage import cut
from .ordered import attach, framed, running
from .split import SplitSpec

KEY = "series_id"


# ---------------------------------------------------------------- sums of products along origins


def _stretch(spec: SplitSpec, partition: str) -> Column:
    """0 for the rows before the first origin, then 1, 2, ... for the rows between origins."""
    first = F.col("n_train") if partition == "validation" else F.col("n_train") + F.col("n_val")
    return F.when(F.col("pos") < first, 0).otherwise(F.floor((F.col("pos") - first) / spec.horizon) + 1).cast("bigint")


def normal_equations(parts: DataFrame, features: Sequence[Column], target: Column, spec: SplitSpec, partition: str = "validation") -> DataFrame:
    """(series, origin, n, g): sums of products of (features, target) over all rows before each origin.

    ``g`` is the upper triangle, row by row.  Rows with a missing feature or target do not count.
    """
    names = [f"_f{i}" for i in range(len(features) + 1)]
    first = F.col("n_train") if partition == "validation" else F.col("n_train") + F.col("n_val")
    last_row = F.col("n_train") + F.col("n_val") if partition == "validation" else F.col("n")
    rows = parts.filter(F.col("pos") < last_row)
    rows = rows.select(KEY, _stretch(spec, partition).alias("_c"), first.alias("_first"), *[f.cast("double").alias(n) for f, n in zip([*features, target], names)])
    rows = rows.dropna(subset=names)
    products = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    sums = rows.groupBy(KEY, "_c", "_first").agg(F.count(F.lit(1)).cast("double").alias("_n"), *[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"_g{k}") for k, (i, j) in enumerate(products)])
    # stretches before an origin are those numbered up to the origin's own number minus one; the sums
    # are added up along the origins in long form, one short sequence per product
    entries = F.array(F.col("_n"), *[F.col(f"_g{k}") for k in range(len(products))])
    long = sums.select(KEY, "_c", "_first", F.posexplode(entries).alias("_k", "_v"))
    totals = running(long, [KEY, "_k"], {"_s": ("sum", F.col("_v"), True)}, pos="_c")
    listed = totals.groupBy(KEY, "_c", "_first").agg(F.sort_array(F.collect_list(F.struct("_k", "_s"))).alias("_l"))
    origin = (F.col("_first") + F.col("_c") * spec.horizon).cast("bigint")
    return listed.select(KEY, origin.alias("origin"), F.get("_l._s", F.lit(0)).alias("n"), F.slice("_l._s", 2, len(products)).alias("g"))


def _unpack(g: np.ndarray, size: int) -> np.ndarray:
    full = np.zeros((size, size))
    full[np.triu_indices(size)] = g
    return full + full.T - np.diag(np.diag(full))


def _ridge(xx: np.ndarray, xy: np.ndarray) -> np.ndarray:
    scale = np.sqrt(np.maximum(np.diag(xx), 1e-300))
    a = xx / np.outer(scale, scale) + 1e-9 * np.eye(len(xx))
    return np.linalg.solve(a, xy / scale) / scale


def tails(parts: DataFrame, wanted: DataFrame, reach: int) -> DataFrame:
    """(series, origin, tail): the last ``reach`` targets before each origin, oldest first."""
    spots = wanted.select(KEY, "origin").distinct().select(KEY, "origin", F.explode(F.sequence(F.col("origin") - reach, F.col("origin") - 1)).alias("pos"))
    found = spots.join(parts.select(KEY, "pos", "target"), [KEY, "pos"])
    return found.groupBy(KEY, "origin").agg(F.sort_array(F.collect_list(F.struct("pos", "target"))).alias("_t")).select(KEY, "origin", F.col("_t.target").alias("tail"))


def _forecast(rows: DataFrame, solve: Callable, horizon: int, keep: str) -> DataFrame:
    """Apply a per-origin solver to rows of sums and tails: (series, origin, step, yhat)."""

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            ids, origins, steps, values = [], [], [], []
            for row in pdf.itertuples(index=False):
                for s, v in enumerate(solve(row), start=1):
                    ids.append(getattr(row, KEY))
                    origins.append(row.origin)
                    steps.append(s)
                    values.append(float(v))
            yield pd.DataFrame({KEY: ids, "origin": origins, "step": steps, "yhat": values})

    return rows.mapInPandas(batches, f"{KEY} {keep}, origin bigint, step bigint, yhat double")


def _scored(parts: DataFrame, forecasts: DataFrame, spec: SplitSpec, partition: str) -> DataFrame:
    wanted = with_origin(parts, spec, partition)
    out = wanted.join(forecasts, [KEY, "origin", "step"], "left")
    return out.select(KEY, "origin", "step", "pos", "date", F.col("target").alias("y"), "yhat")


# ---------------------------------------------------------------- autoregression


def _difference(d: int, seasonal_d: int, m: int) -> np.ndarray:
    poly = np.array([1.0])
    for _ in range(d):
        poly = np.convolve(poly, [1.0, -1.0])
    for _ in range(seasonal_d):
        poly = np.convolve(poly, [1.0, *[0.0] * (m - 1), -1.0])
    return poly


def ar_ols(parts: DataFrame, spec: SplitSpec, p: int = 2, d: int = 1, seasonal_p: int = 0, seasonal_d: int = 0, m: int = 0, partition: str = "validation") -> DataFrame:
    """Autoregression by least squares on the (seasonally) differenced series, refitted at every origin.

    No moving-average terms: it is an AR model, as the name says.
    """
    poly = _difference(d, seasonal_d, m)
    lags = [*range(1, p + 1), *[m * k for k in range(1, seasonal_p + 1)]]
    lags = sorted(set(lags))
    back = len(poly) - 1 + max(lags, default=0)
    shifted = lambda w, k: F.lag("target", k).over(w) if k else F.col("target")

    def differenced(lag: int):
        def build(w):
            out = shifted(w, lag)
            for k, c in enumerate(poly[1:], start=1):
                if c:
                    out = out + float(c) * shifted(w, lag + k)
            return out

        return build

    cols = {f"_z{k}": differenced(k) for k in [0, *lags]}
    rows = framed(parts, KEY, cols, back=back)
    sums = normal_equations(rows, [F.lit(1.0), *[F.col(f"_z{k}") for k in lags]], F.col("_z0"), spec, partition)
    size = len(lags) + 2
    wanted = with_origin(parts, spec, partition).select(KEY, "origin").distinct()
    ready = sums.join(wanted, [KEY, "origin"]).join(tails(parts, wanted, back), [KEY, "origin"])
    horizon = spec.horizon

    def solve(row) -> list[float]:
        g = _unpack(np.asarray(row.g), size)
        beta = _ridge(g[:-1, :-1], g[:-1, -1])
        y = list(row.tail)
        out = []
        for _ in range(horizon):
            z = [float(np.dot(poly, [y[-1 - k - j] for j in range(len(poly))])) for k in range(max(lags, default=0))]
            step = beta[0] + sum(b * z[k - 1] for b, k in zip(beta[1:], lags))
            value = step - sum(c * y[-k] for k, c in enumerate(poly[1:], start=1))
            y.append(value)
            out.append(value)
        return out

    kind = parts.schema[KEY].dataType.simpleString()
    return _scored(parts, _forecast(ready, solve, horizon, kind), spec, partition)


# ---------------------------------------------------------------- additive regression


@dataclass(frozen=True)
class Additive:
    """Piecewise linear trend (hinges evenly over the first 80 % of training) and Fourier seasons."""

    hinges: int = 4
    seasons: tuple[tuple[float, int], ...] = ((365.25, 3),)

    def features(self) -> list[Column]:
        t = F.col("pos") / F.col("n_train")
        day = F.unix_micros(F.col("date").cast("timestamp")) / F.lit(86400e6)
        out = [F.lit(1.0), t]
        out += [F.greatest(F.lit(0.0), t - 0.8 * (k + 1) / (self.hinges + 1)) for k in range(self.hinges)]
        for period, order in self.seasons:
            for k in range(1, order + 1):
                angle = day * F.lit(2.0 * np.pi * k / period)
                out += [F.sin(angle), F.cos(angle)]
        return out


# fixed values: seasons by frequency family (period in days, Fourier order)
SEASONS = {
    "monthly": ((365.25, 3),),
    "weekly": ((365.25, 4),),
    "daily": ((365.25, 4), (7.0, 3)),
    "hourly": ((7.0, 3), (1.0, 4)),
}


def additive_regression(parts: DataFrame, spec: SplitSpec, shape: Additive, partition: str = "validation") -> DataFrame:
    """Trend plus seasons by normal equations, refitted at every origin; no prior on the trend changes."""
    features = shape.features()
    sums = normal_equations(parts, features, F.col("target"), spec, partition)
    size = len(features) + 1

    def solve(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            betas = [_ridge(g[:-1, :-1], g[:-1, -1]).tolist() for g in (_unpack(np.asarray(v), size) for v in pdf.g)]
            yield pd.DataFrame({KEY: pdf[KEY], "origin": pdf.origin, "beta": betas})

    kind = parts.schema[KEY].dataType.simpleString()
    betas = sums.mapInPandas(solve, f"{KEY} {kind}, origin bigint, beta array<double>")
    wanted = with_origin(parts, spec, partition).withColumn("_x", F.array(*[f.cast("double") for f in features]))
    product = F.aggregate(F.zip_with("_x", "beta", lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
    out = wanted.join(betas, [KEY, "origin"], "left")
    return out.select(KEY, "origin", "step", "pos", "date", F.col("target").alias("y"), product.alias("yhat"))


# ---------------------------------------------------------------- elastic net on lag, rolling and calendar features


def _coordinate_descent(xx, xy, n, alpha, l1_ratio, rounds=1000, tol=1e-10):
    """Elastic net on centred sums: (1/2n)|y-Xw|^2 + alpha*l1*|w| + alpha*(1-l1)/2*|w|^2."""
    w = np.zeros(len(xy))
    l1, l2 = alpha * l1_ratio * n, alpha * (1.0 - l1_ratio) * n
    for _ in range(rounds):
        moved = 0.0
        for j in range(len(w)):
            rho = xy[j] - xx[j] @ w + xx[j, j] * w[j]
            new = np.sign(rho) * max(abs(rho) - l1, 0.0) / (xx[j, j] + l2) if xx[j, j] + l2 > 0 else 0.0
            moved, w[j] = max(moved, abs(new - w[j])), new
        if moved < tol * max(1e-12, float(np.max(np.abs(w)))):
            break
    return w


def _centred(g: np.ndarray, n: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centred sums of products, cross products with the target, and means; feature 0 is the constant."""
    mean = g[0] / n
    full = g - n * np.outer(mean, mean)
    return full[1:-1, 1:-1], full[1:-1, -1], mean


def elastic_net(
    parts: DataFrame,
    spec: SplitSpec,
    lags: Sequence[int] = (1, 2, 12),
    windows: Sequence[int] = (3,),
    alpha: float = 1.0,
    l1_ratio: float = 0.5,
    partition: str = "validation",
) -> DataFrame:
    """Elastic net on lags, rolling means and month terms; one fit per origin, forecasts feed the lags.

    The penalty is per row and unscaled features are used, as in the usual single-machine solver.
    """
    from .features import add_calendar, add_past_features

    rows = add_calendar(add_past_features(parts, lags, windows), quarter=False, time_idx=False)
    names = [*[f"lag_{k}" for k in lags], *[f"rolling_mean_{w}" for w in windows], "month_sin", "month_cos"]
    sums = normal_equations(rows, [F.lit(1.0), *[F.col(c) for c in names]], F.col("target"), spec, partition)
    size = len(names) + 2
    reach = max([*lags, *windows])
    wanted = with_origin(rows, spec, partition)
    months = wanted.groupBy(KEY, "origin").agg(F.sort_array(F.collect_list(F.struct("step", "month_sin", "month_cos"))).alias("_m"))
    months = months.select(KEY, "origin", F.col("_m.month_sin").alias("ms"), F.col("_m.month_cos").alias("mc"))
    ready = sums.join(months, [KEY, "origin"]).join(tails(parts, wanted, reach), [KEY, "origin"])

    def solve(row) -> list[float]:
        xx, xy, mean = _centred(_unpack(np.asarray(row.g), size), row.n)
        w = _coordinate_descent(xx, xy, row.n, alpha, l1_ratio)
        bias = mean[-1] - w @ mean[1:-1]
        y, out = list(row.tail), []
        for s in range(len(row.ms)):
            x = [*[y[-k] for k in lags], *[float(np.mean(y[-k:])) for k in windows], row.ms[s], row.mc[s]]
            value = bias + float(np.dot(w, x))
            y.append(value)
            out.append(value)
        return out

    kind = parts.schema[KEY].dataType.simpleString()
    return _scored(parts, _forecast(ready, solve, spec.horizon, kind), spec, partition)


def calendar_elastic_net(parts: DataFrame, spec: SplitSpec, alpha: float = 0.01, l1_ratio: float = 0.5, partition: str = "validation") -> DataFrame:
    """Calendar-only elastic net fitted once on training; needs no recursion and no further refit."""
    from .features import add_calendar

    rows = add_calendar(parts).withColumn("time_idx", F.col("time_idx") / F.col("n_train"))
    names = ["month_sin", "month_cos", "quarter_sin", "quarter_cos", "time_idx"]
    sums = normal_equations(rows, [F.lit(1.0), *[F.col(c) for c in names]], F.col("target"), spec, partition)
    first = parts.groupBy(KEY).agg(F.max(F.col("n_train") if partition == "validation" else F.col("n_train") + F.col("n_val")).alias("origin"))
    once = sums.join(first, [KEY, "origin"])
    size = len(names) + 2

    def solve(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for g, n in zip(pdf.g, pdf.n):
                xx, xy, mean = _centred(_unpack(np.asarray(g), size), n)
                w = _coordinate_descent(xx, xy, n, alpha, l1_ratio)
                out.append([float(mean[-1] - w @ mean[1:-1]), *w.tolist()])
            yield pd.DataFrame({KEY: pdf[KEY], "beta": out})

    kind = parts.schema[KEY].dataType.simpleString()
    betas = once.mapInPandas(solve, f"{KEY} {kind}, beta array<double>")
    wanted = attach(with_origin(rows, spec, partition), betas, KEY, "pos")
    product = F.get("beta", F.lit(0))
    for i, c in enumerate(names, start=1):
        product = product + F.get("beta", F.lit(i)) * F.col(c)
    return wanted.select(KEY, "origin", "step", "pos", "date", F.col("target").alias("y"), product.alias("yhat"))


# ---------------------------------------------------------------- exponential smoothing

ETS_BLOCK = 1 << 18
# smoothing parameters tried: level, trend, season
GRID = [(a, b, g) for a in (0.1, 0.3, 0.5, 0.7, 0.9) for b in (0.05, 0.2) for g in (0.1, 0.3)]


def _smooth_block(y, start, state, m, trend, season, grid):
    """Run the recursion over one block for all parameter triples: (states before each row, errors)."""
    a, b, g = (np.array(c) for c in zip(*grid))
    level, slope, ring = state[:, 0].copy(), state[:, 1].copy(), state[:, 2:].copy()
    before = np.empty((len(y), *state.shape))
    errors = np.empty((len(y), len(grid)))
    for t, value in enumerate(y):
        before[t, :, 0], before[t, :, 1], before[t, :, 2:] = level, slope, ring
        i = (start + t) % m if season else 0
        s = ring[:, i] if season else 0.0
        e = value - level - slope - s
        errors[t] = e
        level = level + slope + a * e
        if trend:
            slope = slope + a * b * e
        if season:
            ring[:, i] = s + g * (1.0 - a) * e
    final = np.concatenate([level[:, None], slope[:, None], ring], axis=1)
    return before, errors, final


def _block_map(y, start, m, dim, trend, season, grid):
    """The block as one affine map per parameter triple: state' = M state + v."""
    zero = _smooth_block(y, start, np.zeros((len(grid), dim)), m, trend, season, grid)[2]
    columns = []
    for j in range(dim):
        unit = np.zeros((len(grid), dim))
        unit[:, j] = 1.0
        columns.append(_smooth_block(y, start, unit, m, trend, season, grid)[2] - zero)
    return np.stack(columns, axis=2), zero


def smoothing_states(
    parts: DataFrame,
    spec: SplitSpec,
    trend: str | None = "add",
    seasonal: str | None = "add",
    m: int = 12,
    partition: str = "validation",
    block: int = ETS_BLOCK,
    grid: Sequence[tuple[float, float, float]] = tuple(GRID),
) -> DataFrame:
    """(series, origin, p, state, sse): state before each origin and squared error so far, for every parameter triple p of the grid.

    Multiplicative parts are smoothed additively on the logarithm and need a positive target.
    """
    if seasonal and m < 2:
        raise ValueError("a seasonal part needs a period of at least 2")
    logs = "mul" in (trend, seasonal)
    problem = F.raise_error(F.lit("multiplicative smoothing needs a positive target")).cast("double")
    value = F.when(F.col("target") <= 0, problem).otherwise(F.log("target")) if logs else F.col("target")
    has_trend, has_season = trend is not None, seasonal is not None
    period = m if has_season else 1
    dim = 2 + (m if has_season else 0)
    grid = [tuple(p) for p in grid]
    kind = parts.schema[KEY].dataType.simpleString()
    first = F.col("n_train") if partition == "validation" else F.col("n_train") + F.col("n_val")
    last_row = F.col("n_train") + F.col("n_val") if partition == "validation" else F.col("n")
    rows = parts.filter(F.col("pos") < last_row).select(
        KEY, "pos", value.alias("y"), first.alias("first"), F.floor(F.col("pos") / block).alias("blk"), F.floor((last_row - 1) / block).alias("last_blk")
    )
    # start: mean of the first season, mean change to the second, deviations from the mean
    head = rows.filter(F.col("pos") < 2 * period).groupBy(KEY).agg(F.sort_array(F.collect_list(F.struct("pos", "y"))).alias("_h"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, v: x + v)
    ys = F.col("_h.y")
    level = total(F.slice(ys, 1, period)) / period
    slope = (total(F.slice(ys, period + 1, period)) - total(F.slice(ys, 1, period))) / (period * period) if has_trend else F.lit(0.0)
    ring = F.transform(F.slice(ys, 1, period), lambda v: v - level) if has_season else F.expr("array()").cast("array<double>")
    start = cut(head.filter(F.size("_h") == 2 * period).select(KEY, F.concat(F.array(level, slope), ring).alias("state")))

    # blocks before a series' last one as affine maps, chained to the state each block starts with
    def maps(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        mat, vec = _block_map(pdf.y.to_numpy(), int(pdf.pos.iloc[0]), period, dim, has_trend, has_season, grid)
        return pd.DataFrame({KEY: pdf[KEY].iloc[0], "blk": pdf.blk.iloc[0], "p": range(len(grid)), "mat": [x.ravel().tolist() for x in mat], "vec": list(vec.tolist())})

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("blk")
        state = np.asarray(pdf.state.iloc[0], dtype=float)
        out = []
        for mat, vec in zip(pdf["mat"], pdf["vec"]):
            state = np.asarray(mat).reshape(dim, dim) @ state + np.asarray(vec)
            out.append(state.tolist())
        return pd.DataFrame({KEY: pdf[KEY], "blk": pdf.blk + 1, "p": pdf.p, "state": out})

    inner = rows.filter(F.col("blk") < F.col("last_blk"))
    mapped = inner.groupBy(KEY, "blk").applyInPandas(maps, f"{KEY} {kind}, blk bigint, p int, mat array<double>, vec array<double>")
    later = mapped.join(start, KEY).groupBy(KEY, "p").applyInPandas(chain, f"{KEY} {kind}, blk bigint, p int, state array<double>")
    later = later.groupBy(KEY, "blk").agg(F.sort_array(F.collect_list(F.struct("p", "state"))).alias("_s")).select(KEY, "blk", F.col("_s.state").alias("states"))
    begin = start.select(KEY, F.lit(0).cast("bigint").alias("blk"), F.array_repeat("state", len(grid)).alias("states"))
    starts = begin.unionByName(later).select(F.col(KEY).alias("_k"), F.col("blk").alias("_b"), "states")

    horizon, n_grid = spec.horizon, len(grid)

    def run(key, pdf: pd.DataFrame, st: pd.DataFrame) -> pd.DataFrame:
        columns = [KEY, "origin", "blk", "p", "sse", "total", "state"]
        if not len(pdf) or not len(st):
            return pd.DataFrame(columns=columns)
        pdf = pdf.sort_values("pos")
        pos, first_pos = pdf.pos.to_numpy(), int(pdf["first"].iloc[0])
        state = np.array([list(s) for s in st.states.iloc[0]], dtype=float)
        before, errors, final = _smooth_block(pdf.y.to_numpy(), int(pos[0]), state, period, has_trend, has_season, grid)
        squares = np.vstack([np.zeros(n_grid), np.cumsum(errors**2, axis=0)])
        at = np.flatnonzero((pos >= first_pos) & ((pos - first_pos) % horizon == 0))
        out = [(key[0], int(pos[i]), key[1], p, squares[i, p], np.nan, before[i, p].tolist()) for i in at for p in range(n_grid)]
        out += [(key[0], -1, key[1], p, np.nan, squares[-1, p], None) for p in range(n_grid)]
        return pd.DataFrame(out, columns=columns)

    schema = f"{KEY} {kind}, origin bigint, blk bigint, p int, sse double, total double, state array<double>"
    ran = cut(rows.groupBy(KEY, "blk").cogroup(starts.groupBy("_k", "_b")).applyInPandas(run, schema))
    earlier = running(ran.filter("origin < 0").select(KEY, "p", "blk", "total"), [KEY, "p"], {"_before": ("sum", F.col("total"), False)}, pos="blk")
    scored = ran.filter("origin >= 0").drop("total").join(earlier.select(KEY, "p", "blk", "_before"), [KEY, "p", "blk"])
    scored = scored.withColumn("sse", F.col("sse") + F.coalesce("_before", F.lit(0.0)))
    return scored.select(KEY, "origin", "p", "state", "sse")


def exponential_smoothing(
    parts: DataFrame,
    spec: SplitSpec,
    trend: str | None = "add",
    seasonal: str | None = "add",
    m: int = 12,
    partition: str = "validation",
    block: int = ETS_BLOCK,
    grid: Sequence[tuple[float, float, float]] = tuple(GRID),
) -> DataFrame:
    """Holt-Winters smoothing; at every origin the parameters with the smallest squared error so far.

    A seasonal part needs a period.  See ``smoothing_states`` for multiplicative parts.
    """
    logs = "mul" in (trend, seasonal)
    scored = smoothing_states(parts, spec, trend, seasonal, m, partition, block, grid)
    best = scored.groupBy(KEY, "origin").agg(F.min_by("state", F.struct(F.round("sse", 9), "p")).alias("state"))
    wanted = with_origin(parts, spec, partition).join(best, [KEY, "origin"], "left")
    ahead = F.get("state", F.lit(0)) + F.get("state", F.lit(1)) * F.col("step")
    if seasonal is not None:
        ahead = ahead + F.get("state", (F.pmod(F.col("pos"), F.lit(m)) + 2).cast("int"))
    return wanted.select(KEY, "origin", "step", "pos", "date", F.col("target").alias("y"), (F.exp(ahead) if logs else ahead).alias("yhat"))


# ---------------------------------------------------------------- nearest neighbours

PIVOTS = 16
CELL_ROWS = 20_000


def _distances(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    if p == 2:
        # differences rather than the expanded square, so that equal vectors are at distance zero
        return np.sqrt(np.maximum(((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2), 0.0))
    return (np.abs(a[:, None, :] - b[None, :, :]) ** p).sum(axis=2) ** (1.0 / p)


def _closest(a: np.ndarray, b: np.ndarray, ids: np.ndarray, k: int, p: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``b`` of the k rows nearest to the vector ``a``, ties by id, and their distances."""
    may = np.arange(len(b))
    if p == 2 and len(b) > k:
        # the expanded square leaves out what is farther by more than its rounding; the rest is compared by differences
        squares = np.einsum("ij,ij->i", b, b)
        rough, slack = squares - 2.0 * (b @ a), 1e-10 * (a @ a + squares.max())
        if np.isfinite(slack):
            may = np.flatnonzero(rough <= np.partition(rough, k - 1)[k - 1] + 2.0 * slack)
    d = _distances(a[None, :], b[may], p)[0]
    order = np.lexsort((ids[may], d))[:k]
    return may[order], d[order]


class Neighbours:
    """Training rows (key, id, x array of doubles, value) in cells around their nearest pivot, ready for exact searches.

    A query first searches its own cell, then only cells that may hold something closer than its
    k-th neighbour so far.  Cells are cut into pieces of bounded size and emit at most k rows per query.
    """

    def __init__(self, train: DataFrame, p: int = 2, key: str = KEY, pivots: int = PIVOTS, cell_rows: int = CELL_ROWS):
        self.p, self.key, self.cell_rows = p, key, cell_rows
        self.kind, self.ikind = train.schema[key].dataType.simpleString(), train.schema["id"].dataType.simpleString()
        pick = Window.partitionBy(key).orderBy(F.xxhash64("id"), "id")
        chosen = train.select(key, "id", "x").withColumn("_r", F.row_number().over(pick)).filter(F.col("_r") <= pivots)
        self.centres = cut(chosen.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_r", "x"))).alias("_p")).select(key, F.col("_p.x").alias("centres")))
        rows = self._placed(train.select(key, "id", "x", F.col("value").cast("double").alias("value")), "id", f"id {self.ikind}, x array<double>, value double")
        rows = cut(rows.withColumn("_d", F.get("to_pivots", F.col("cell"))).drop("to_pivots"))
        self.cells = cut(rows.groupBy(key, "cell").agg(F.max("_d").alias("radius"), F.min("id").alias("first"), F.count(F.lit(1)).alias("size")))
        self.pieces = self.cells.withColumn("pieces", F.ceil(F.col("size") / cell_rows).cast("int")).select(key, "cell", "pieces")
        rows = attach(rows, self.pieces, [key, "cell"], "id")
        self.rows = cut(rows.withColumn("piece", F.pmod(F.hash("id"), F.col("pieces"))).drop("pieces", "_d"))

    def _placed(self, rows: DataFrame, spread: str, fields: str) -> DataFrame:
        """``rows`` with their cell and the distances to all pivots."""
        p = self.p

        def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                near, far = np.zeros(len(frame), np.int32), [None] * len(frame)
                for _, some in frame.groupby(self_key, sort=False).indices.items():
                    centres = np.array([list(c) for c in frame["centres"].iloc[some[0]]], dtype=float)
                    d = _distances(np.array([list(x) for x in frame["x"].iloc[some]], dtype=float), centres, p)
                    near[some] = d.argmin(axis=1)
                    for k, line in zip(some.tolist(), d.tolist()):
                        far[k] = line
                out = frame.drop(columns=["centres"])
                out["cell"], out["to_pivots"] = near, far
                yield out

        self_key = self.key
        return attach(rows, self.centres, self.key, spread).select(*rows.columns, "centres").mapInPandas(assign, f"{self.key} {self.kind}, {fields}, cell int, to_pivots array<double>")

    def search(self, queries: DataFrame, k: int = 5) -> DataFrame:
        """(key, query_id, id, distance, value, rank): the k nearest rows of every query, ties by id.

        ``queries``: key, query_id, x, and if only rows with a smaller id count, ``before``.
        """
        key, p, cell_rows, limited = self.key, self.p, self.cell_rows, "before" in queries.columns
        qkind = queries.schema["query_id"].dataType.simpleString()
        extra = ["before"] if limited else []
        q = self._placed(queries.select(key, "query_id", "x", *extra), "query_id", f"query_id {qkind}, x array<double>" + (f", before {self.ikind}" if limited else ""))
        q = cut(q)

        def compare(keys, qs: pd.DataFrame, ts: pd.DataFrame) -> pd.DataFrame:
            columns = [key, "query_id", "id", "distance", "value"]
            if not len(qs) or not len(ts):
                return pd.DataFrame(columns=columns)
            tx = np.array([list(v) for v in ts.x], dtype=float)
            ids, values = ts["id"].to_numpy(), ts["value"].to_numpy()
            out = []
            qx = np.array([list(v) for v in qs.x], dtype=float)
            limits = qs["before"].to_numpy() if limited else None
            for i, query in enumerate(qs.query_id):
                may = np.flatnonzero(ids < limits[i]) if limited else slice(None)
                place, d = _closest(qx[i], tx[may], ids[may], k, p)
                out += [(keys[0], query, j, dist, v) for j, dist, v in zip(ids[may][place], d, values[may][place])]
            return pd.DataFrame(out, columns=columns)

        def visit(pairs: DataFrame) -> DataFrame:
            """``pairs``: key, query_id, x, cell.  Queries of a crowded cell are split as well."""
            crowd = pairs.groupBy(key, "cell").agg(F.ceil(F.count(F.lit(1)) / cell_rows).cast("int").alias("q_pieces"))
            spread = crowd.join(self.pieces, [key, "cell"])
            qs = attach(pairs, spread, [key, "cell"], "query_id").withColumn("q_piece", F.pmod(F.hash("query_id"), F.col("q_pieces")))
            qs = qs.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).drop("pieces", "q_pieces")
            ts = self.rows.join(spread.select(key, "cell", "q_pieces"), [key, "cell"]).withColumn("q_piece", F.explode(F.sequence(F.lit(0), F.col("q_pieces") - 1))).drop("q_pieces")
            by = [key, "cell", "piece", "q_piece"]
            ts = ts.withColumnsRenamed({c: f"_t_{c}" for c in by})
            found = qs.groupBy(*by).cogroup(ts.groupBy(*[f"_t_{c}" for c in by])).applyInPandas(compare, f"{key} {self.kind}, query_id {qkind}, id {self.ikind}, distance double, value double")
            top = Window.partitionBy(key, "query_id").orderBy("distance", "id")
            return found.withColumn("rank", F.row_number().over(top)).filter(F.col("rank") <= k)

        home = cut(visit(q.select(key, "query_id", "x", "cell", *extra)))
        bound = home.groupBy(key, "query_id").agg(F.when(F.count(F.lit(1)) >= k, F.max("distance")).alias("_ub"))
        reach = q.join(bound, [key, "query_id"], "left").select(key, "query_id", "x", *extra, F.col("cell").alias("_home"), "_ub", F.posexplode("to_pivots").alias("cell", "_dist"))
        reach = reach.filter(F.col("cell") != F.col("_home")).join(self.cells, [key, "cell"])
        reach = reach.filter(F.col("_ub").isNull() | (F.col("_dist") - F.col("radius") <= F.col("_ub") + 1e-9))
        if limited:  # a cell whose rows are all too late holds nothing
            reach = reach.filter(F.col("first") < F.col("before"))
        other = visit(reach.select(key, "query_id", "x", "cell", *extra))
        top = Window.partitionBy(key, "query_id").orderBy("distance", "id")
        both = home.drop("rank").unionByName(other.drop("rank"))
        return both.withColumn("rank", F.row_number().over(top).cast("bigint")).filter(F.col("rank") <= k)


def nearest(train: DataFrame, queries: DataFrame, k: int = 5, p: int = 2, key: str = KEY, pivots: int = PIVOTS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Exact k nearest training rows of every query: (key, query_id, id, distance, value, rank); see ``Neighbours``."""
    return Neighbours(train, p, key, pivots, cell_rows).search(queries, k)


def knn_regression(neighbours: DataFrame, weights: str = "uniform", key: str = KEY) -> DataFrame:
    """Mean of the neighbours' values, plain or weighted by inverse distance (exact hits count alone)."""
    hit = F.max((F.col("distance") == 0).cast("int")) == 1
    exact = F.avg(F.when(F.col("distance") == 0, F.col("value")))
    inverse = F.sum(F.when(F.col("distance") > 0, F.col("value") / F.col("distance"))) / F.sum(F.when(F.col("distance") > 0, 1.0 / F.col("distance")))
    value = F.avg("value") if weights == "uniform" else F.when(hit, exact).otherwise(inverse)
    return neighbours.groupBy(key, "query_id").agg(value.alias("yhat"))


def knn_forecast(parts: DataFrame, spec: SplitSpec, lags: Sequence[int], k: int = 5, weights: str = "uniform", p: int = 2, partition: str = "validation") -> DataFrame:
    """Nearest neighbours in lag space, at every origin among all rows before it; forecasts feed the lags of later steps.

    All origins of all series take a step at once: a round searches for one query per origin, whose
    last values, observed before the origin and forecast after it, travel in the row.
    """
    from .features import add_past_features

    end = F.col("n_train") + F.col("n_val") if partition == "validation" else F.col("n")
    names = [f"lag_{v}" for v in lags]
    rows = add_past_features(parts.filter(F.col("pos") < end), lags).dropna(subset=names)
    held = Neighbours(rows.select(KEY, F.col("pos").alias("id"), F.array(*names).alias("x"), F.col("target").alias("value")), p)
    wanted = with_origin(parts, spec, partition)
    reach = max(lags)
    state = cut(tails(parts, wanted, reach).filter(F.size("tail") == reach).withColumn("said", F.array().cast("array<double>")))
    for _ in range(spec.horizon):
        known = F.concat("tail", "said")
        x = F.array(*[F.element_at(known, -v) for v in lags])
        queries = state.select(KEY, F.col("origin").alias("query_id"), x.alias("x"), F.col("origin").alias("before"))
        guess = knn_regression(held.search(queries, k), weights).withColumnRenamed("query_id", "origin")
        state = cut(state.join(guess, [KEY, "origin"]).withColumn("said", F.concat("said", F.array("yhat"))).drop("yhat"))
    steps = state.select(KEY, "origin", F.posexplode("said").alias("step", "yhat")).withColumn("step", (F.col("step") + 1).cast("bigint"))
    return wanted.join(steps, [KEY, "origin", "step"], "left").select(KEY, "origin", "step", "pos", "date", F.col("target").alias("y"), "yhat")


# ---------------------------------------------------------------- trees, one pooled model


def tree_forecast(parts: DataFrame, spec: SplitSpec, kind: str = "random_forest", lags: Sequence[int] = (3, 6, 12), partition: str = "validation", **settings) -> DataFrame:
    """Random forest or gradient-boosted trees, trained once over all series scaled to their own training mean and spread.

    Training is distributed by the library; lags reach back at least a horizon.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

    from .features import add_calendar, add_past_features
    from .preprocess import fit_scaler

    if min(lags) < spec.horizon:
        raise ValueError("lags shorter than the horizon would read targets inside the origin")
    numbers = fit_scaler(parts.filter("split = 'train'"), "standard_scaler", ["target"])
    scaled = attach(parts, numbers, KEY, "pos").withColumn("z", (F.col("target") - F.col("_o_target")) / F.col("_d_target"))
    rows = add_calendar(add_past_features(scaled, lags, value="z"), time_idx=False).dropna(subset=[f"lag_{v}" for v in lags])
    names = [*[f"lag_{v}" for v in lags], "month_sin", "month_cos", "quarter_sin", "quarter_cos"]
    rows = VectorAssembler(inputCols=names, outputCol="features").transform(rows)
    common = {"featuresCol": "features", "labelCol": "z", "predictionCol": "zhat", "seed": 42}
    model = RandomForestRegressor(**common, **{"numTrees": 30, "maxDepth": 6, **settings}) if kind == "random_forest" else GBTRegressor(**common, **{"maxIter": 20, "maxDepth": 4, **settings})
    fitted = model.fit(rows.filter("split = 'train'").select("features", "z"))
    out = fitted.transform(with_origin(rows, spec, partition))
    return out.select(KEY, "origin", "step", "pos", "date", F.col("target").alias("y"), (F.col("zhat") * F.col("_d_target") + F.col("_o_target")).alias("yhat"))


# ---------------------------------------------------------------- dispatch and final evaluation

# protocol of each model: refit per origin, refit with forecasts fed back, or one fit
PROTOCOLS: dict[str, str] = {
    "seasonal_naive": "rolling_origin_refit",
    "ar_ols": "rolling_origin_refit",
    "exponential_smoothing": "rolling_origin_refit",
    "additive_regression": "rolling_origin_refit",
    "elastic_net": "rolling_origin_refit_causal_features",
    "calendar_elastic_net": "preprocessed_tabular_one_fit",
    "knn_forecast": "rolling_origin_refit_causal_features",
    "tree_forecast": "preprocessed_tabular_one_fit",
    "boosted_forecast": "rolling_origin_refit_causal_features",
}


def forecast(model: str, parts: DataFrame, spec: SplitSpec, partition: str = "validation", **settings) -> DataFrame:
    """Predictions of a model by name: (series, origin, step, pos, date, y, yhat)."""
    from .backtest import seasonal_naive
    from .boosting import boosted_forecast

    known = {
        "seasonal_naive": seasonal_naive, "ar_ols": ar_ols, "exponential_smoothing": exponential_smoothing, "additive_regression": additive_regression,
        "elastic_net": elastic_net, "calendar_elastic_net": calendar_elastic_net, "knn_forecast": knn_forecast, "tree_forecast": tree_forecast, "boosted_forecast": boosted_forecast,
    }
    if model not in known:
        raise ValueError(f"unknown model: {model}")
    return known[model](parts, spec, partition=partition, **settings)
