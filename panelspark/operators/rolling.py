"""Preprocessing chains refitted at every rolling origin, without copies of the history.

What a step learns from the rows before an origin is a function of sums and extremes, kept for each
stretch between origins and added up along them.  Replaced outliers are at most two rows of a
history, its largest ones; sums are corrected by what replacing them changes.  Box-Cox powers come
from a fixed grid, whose sums are all kept.  Models are then fitted on the transformed history of
each origin from sums of products, corrected alike, and their forecasts are inverted to the raw scale.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import forecast as L
from .backtest import with_origin
from .diagnostics import EPS, MAX_REPLACED, OUTLIER_Z, RADIUS
from .lineage import cut
from .ordered import attach, running
from .prefix import TILE, Prefixes
from .preprocess import SCALERS, TINY, Step
from .split import SplitSpec

KEY = "series_id"
#: Box-Cox powers that a rolling refit chooses from.
POWERS = tuple(round(-2 + 0.1 * k, 10) for k in range(41))
MARK = "struct<pos: bigint, old: double, new: double>"


# ---------------------------------------------------------------- sums and extremes before every origin


def _first(partition: str) -> Column:
    return F.col("n_train") if partition == "validation" else F.col("n_train") + F.col("n_val")


def _stretches(parts: DataFrame, spec: SplitSpec, partition: str) -> DataFrame:
    """Rows that some origin can see, with the stretch between origins they are in and the first origin."""
    end = F.col("n_train") + F.col("n_val") if partition == "validation" else F.col("n")
    return parts.filter(F.col("pos") < end).withColumn("_c", L._stretch(spec, partition)).withColumn("_first", _first(partition))


def _origin(spec: SplitSpec) -> Column:
    return (F.col("_first") + F.col("_c") * spec.horizon).cast("bigint").alias("origin")


def origin_table(parts: DataFrame, spec: SplitSpec, partition: str = "validation") -> DataFrame:
    """(series, origin) of a partition."""
    return with_origin(parts, spec, partition).select(KEY, "origin").distinct()


def sums_by_origin(parts: DataFrame, sums: Sequence[Column], spec: SplitSpec, partition: str = "validation", keys: Sequence[str] = ()) -> DataFrame:
    """(series, *keys, origin, s): sums of expressions over all rows before each origin; nulls count as nothing."""
    by = [KEY, *keys]
    per = _stretches(parts, spec, partition).groupBy(*by, "_c", "_first").agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(f"s{k}") for k, c in enumerate(sums)])
    long = per.select(*by, "_c", "_first", F.posexplode(F.array(*[f"s{k}" for k in range(len(sums))])).alias("_k", "_v"))
    totals = running(long, [*by, "_k"], {"_s": ("sum", F.col("_v"), True)}, pos="_c")
    listed = totals.groupBy(*by, "_c", "_first").agg(F.sort_array(F.collect_list(F.struct("_k", "_s"))).alias("_l"))
    return listed.select(*by, _origin(spec), F.col("_l._s").alias("s"))


def extremes_by_origin(parts: DataFrame, spec: SplitSpec, partition: str = "validation", value: str = "target") -> DataFrame:
    """(series, origin, low, top): the smallest value before each origin, and the MAX_REPLACED + 1 rows (value, at) with the largest ones, earlier rows first.

    A row that isn't among the largest when it arrives never will be, so the next largest is a
    running maximum over what arrives or is displaced.
    """
    rows = _stretches(parts, spec, partition)
    order = Window.partitionBy(KEY, "_c").orderBy(F.desc(value), "pos")  # cut to a few rows before the shuffle
    ranked = rows.select(KEY, "_c", "pos", value).withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= MAX_REPLACED + 1)
    pair = F.struct(F.col(value).alias("value"), (-F.col("pos")).alias("back"))
    new = ranked.groupBy(KEY, "_c").agg(F.collect_list(pair).alias("new"))
    per = rows.groupBy(KEY, "_c", "_first").agg(F.min(value).alias("least")).join(new, [KEY, "_c"])
    per = running(cut(per), KEY, {"low": ("min", F.col("least"), True)}, pos="_c")
    kept, was = [], []
    for k in range(MAX_REPLACED + 1):
        now, then = f"t{k}", f"p{k}"
        rest = F.array_except(F.array_compact(F.concat("new", *[F.array(c) for c in was])), F.array_compact(F.array(*kept))) if kept else F.col("new")
        per = per.withColumn("best", F.array_max(rest))
        per = running(per, KEY, {now: ("max", F.col("best"), True), then: ("max", F.col("best"), False)}, pos="_c").drop("best")
        kept, was = [*kept, F.col(now)], [*was, F.col(then)]
    top = F.transform(F.array_compact(F.array(*kept)), lambda t: F.struct(t["value"].alias("value"), (-t["back"]).alias("at")))
    return per.select(KEY, _origin(spec), "low", top.alias("top"))


# ---------------------------------------------------------------- outliers of every history


def outliers_by_origin(parts: DataFrame, spec: SplitSpec, partition: str = "validation", tile: int = TILE) -> DataFrame:
    """(series, origin, low, high, center, mad, scale, marks): the outlier step fitted on the rows before each origin.

    ``marks`` (pos, old, new): the at most MAX_REPLACED largest rows that lie more than OUTLIER_Z
    scales above the median, with the median of their unmarked neighbours; ``low`` and ``high`` are
    limits of the rows that stay.  Later rows change nothing.
    """
    origins = origin_table(parts, spec, partition)
    seen = cut(_stretches(parts, spec, partition).select(KEY, "pos", "target", "_c", "_first", "n", "n_train", "n_val"))
    middle = Prefixes(seen, tile=tile).medians(origins.withColumnRenamed("origin", "n")).withColumnRenamed("n", "origin")
    scaled = 1.4826 * F.col("mad")
    scale = F.when(scaled <= EPS, EPS * F.greatest(F.lit(1.0), F.abs("center")) * 16.0).otherwise(scaled)
    table = extremes_by_origin(seen, spec, partition).join(middle, [KEY, "origin"]).withColumn("scale", scale)
    far = F.filter(F.slice("top", 1, MAX_REPLACED), lambda t: (F.col("origin") >= 3) & ((t["value"] - F.col("center")) / F.col("scale") > OUTLIER_Z))
    table = cut(table.withColumn("far", far))
    # a mark's neighbours: the same for many origins
    marked = table.filter(F.size("far") > 0).select(KEY, "origin", F.sort_array("far.at").alias("all"), F.explode("far.at").alias("at"))
    marked = marked.withColumn("until", F.least("origin", F.col("at") + RADIUS + 1))
    cases = marked.select(KEY, "all", "at", "until").distinct()
    near = cases.withColumn("pos", F.explode(F.sequence(F.greatest(F.lit(0), F.col("at") - RADIUS), F.col("until") - 1))).filter(~F.array_contains("all", F.col("pos")))
    # at least two other rows stand within two places of a row, and at most one of them is marked
    around = near.join(seen.select(KEY, "pos", "target"), [KEY, "pos"]).groupBy(KEY, "all", "at", "until").agg(F.percentile("target", 0.5).alias("new"))
    new = marked.join(around, [KEY, "all", "at", "until"]).groupBy(KEY, "origin").agg(F.map_from_entries(F.collect_list(F.struct("at", "new"))).alias("news"))
    done = table.join(new, [KEY, "origin"], "left")
    marks = F.transform("far", lambda t: F.struct(t["at"].alias("pos"), t["value"].alias("old"), F.element_at("news", t["at"]).alias("new")))
    high = F.element_at("top", F.size("far") + 1)["value"]
    return done.select(KEY, "origin", "low", high.alias("high"), "center", "mad", "scale", F.sort_array(marks).alias("marks"))


# ---------------------------------------------------------------- fitted numbers of a chain


@dataclass(frozen=True)
class Chain:
    """A target chain: outlier replacement, then a transform, then a scaler; each may be missing."""

    outliers: bool = False
    transform: str | None = None
    scaler: str | None = None

    @classmethod
    def of(cls, steps: Sequence[Step]) -> Chain:
        place, got = -1, {}
        for step in steps:
            found = {"replace_outliers": 0, "log_transform": 1, "boxcox_transform": 1, "standard_scaler": 2, "minmax_scaler": 2}.get(step.name)
            if found is None or (found == 2 and step.scope != "target"):
                raise ValueError(f"{step.name}: not a step of a target chain")
            if found <= place:
                raise ValueError(f"{step.name}: outliers are replaced first, then one transform, then one scaler")
            place = found
            got[("outliers", "transform", "scaler")[found]] = True if found == 0 else ("boxcox" if step.name == "boxcox_transform" else step.method) if found == 1 else step.name
        return cls(**got)

    def forward(self, y: np.ndarray, shift: float = 0.0, power: float = 0.0) -> np.ndarray:
        y = np.asarray(y, float)
        if self.transform is None:
            return y
        x = y + (1.0 if self.transform == "log1p" else shift if self.transform == "boxcox" else 0.0)
        if self.transform != "boxcox" or abs(power) < TINY:
            return np.log(x)
        return (x**power - 1.0) / power

    def backward(self, z: np.ndarray, shift: float = 0.0, power: float = 0.0) -> np.ndarray:
        if self.transform is None:
            return z
        if self.transform != "boxcox":
            return np.expm1(z) if self.transform == "log1p" else np.exp(z)
        return (np.exp(z) if abs(power) < TINY else np.maximum(power * z + 1.0, TINY) ** (1.0 / power)) - shift

    def column(self, y: Column, shift: Column | None = None, power: Column | None = None) -> Column:
        """The transform as a column; null outside its domain, where only histories without the row are asked for."""
        if self.transform is None:
            return y
        x = y + (1.0 if self.transform == "log1p" else shift if self.transform == "boxcox" else 0.0)
        z = F.log(x) if self.transform != "boxcox" else F.when(F.abs(power) < TINY, F.log(x)).otherwise((F.pow(x, power) - 1.0) / power)
        return F.when(x > 0, z)


def chain_numbers(parts: DataFrame, steps: Sequence[Step], spec: SplitSpec, partition: str = "validation", powers: Sequence[float] = POWERS, tile: int = TILE) -> DataFrame:
    """(series, origin, marks, shift, power, offset, divisor): what the chain learns from the rows before each origin.

    Fixed logarithms have shift and power null, a missing scaler has offset 0 and divisor 1.
    A history with a value outside the domain of its logarithm fails the job.
    """
    chain = Chain.of(steps)
    fitted = outliers_by_origin(parts, spec, partition, tile) if chain.outliers else extremes_by_origin(parts, spec, partition).withColumn("high", F.element_at("top", 1)["value"])
    none = F.array().cast(f"array<{MARK}>")
    fitted = fitted.select(KEY, "origin", "low", "high", (F.col("marks") if chain.outliers else none).alias("marks"))
    fitted = cut(fitted.join(origin_table(parts, spec, partition), [KEY, "origin"]))
    boxcox = chain.transform == "boxcox"
    # marked rows are the largest, so they never are the minimum
    shift = F.when(F.col("low") <= 0, 1.0 - F.col("low")).otherwise(0.0) if boxcox else F.lit(None).cast("double")
    if chain.transform in ("log", "log1p"):
        outside = F.raise_error(F.lit(f"{chain.transform}: target outside its domain")).cast("double")
        fitted = fitted.withColumn("low", F.when(F.col("low") <= (-1.0 if chain.transform == "log1p" else 0.0), outside).otherwise(F.col("low")))
    fitted = fitted.withColumn("shift", shift)
    rows, keys = parts, []
    if boxcox:  # a series has as many shifts as its minimum has values at origins, mostly one
        rows, keys = attach(parts, fitted.select(KEY, "shift").distinct(), KEY, "pos"), ["shift"]
    if not boxcox and chain.scaler != "standard_scaler":
        sums = fitted.withColumn("s", F.array().cast("array<double>")).withColumn("y0", F.lit(None).cast("double"))
    else:
        start = parts.filter("pos = 0").select(KEY, F.col("target").alias("y0"))
        rows = attach(rows, start, KEY, "pos")
        curve = lambda y, p: chain.column(F.col(y), F.col("shift") if boxcox else None, F.lit(float(p)))
        # measured from the first value, so that squares don't swallow the spread
        steps_away = [curve("target", p) - curve("y0", p) for p in (powers if boxcox else (0.0,))]
        logs = [F.when(F.col("target") + F.col("shift") > 0, F.log(F.col("target") + F.col("shift")))] if boxcox else []
        sums = sums_by_origin(rows, [*logs, *[x for z in steps_away for x in (z, z * z)]], spec, partition, keys)
        sums = fitted.join(sums, [KEY, "origin", *keys]).join(start, KEY)
    kind = parts.schema[KEY].dataType.simpleString()
    grid = [float(p) for p in powers] if boxcox else [0.0]

    def learn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                n, shift, s = row.origin, (row.shift if boxcox else 0.0), np.asarray(row.s, float)
                old, new = (np.array([m[c] for m in row.marks]) for c in ("old", "new"))
                power, mean, spread = 0.0, 0.0, 1.0
                if len(s):
                    head, s = (s[0], s[1:]) if boxcox else (0.0, s)
                    found = []
                    for k, p in enumerate(grid):
                        start = chain.forward(row.y0, shift, p)
                        a, b = chain.forward(old, shift, p) - start, chain.forward(new, shift, p) - start
                        first, second = s[2 * k] + b.sum() - a.sum(), s[2 * k + 1] + (b * b).sum() - (a * a).sum()
                        found.append((float(start) + first / n, max(second / n - (first / n) ** 2, 0.0)))
                    best = 0
                    if boxcox:
                        logs = head + np.log(new + shift).sum() - np.log(old + shift).sum()
                        odds = [round((p - 1.0) * logs - n / 2.0 * np.log(v), 9) if v > 0 else -np.inf for p, (_, v) in zip(grid, found)]
                        best = min(range(len(grid)), key=lambda k: (-odds[k], abs(grid[k])))
                    power, (mean, spread) = grid[best], (found[best][0], np.sqrt(found[best][1]))
                if chain.scaler == "minmax_scaler":
                    ends = chain.forward(np.array([row.low, max([row.high, *new])]), shift, power)
                    mean, spread = ends[0], ends[1] - ends[0]
                elif chain.scaler is None:
                    mean, spread = 0.0, 1.0
                out.append((shift, power, float(mean), float(spread) if abs(spread) >= TINY else 1.0))
            got = pd.DataFrame(out, columns=["shift", "power", "offset", "divisor"])
            if not boxcox:
                got["shift"], got["power"] = None, None
            yield pd.concat([frame[[KEY, "origin", "marks"]].reset_index(drop=True), got], axis=1)

    return sums.select(KEY, "origin", "marks", "low", "high", "shift", "s", "y0").mapInPandas(learn, f"{KEY} {kind}, origin bigint, marks array<{MARK}>, shift double, power double, offset double, divisor double")


# ---------------------------------------------------------------- models on the transformed history


def chain_forecast(
    parts: DataFrame, steps: Sequence[Step], spec: SplitSpec, model: str = "ar", partition: str = "validation", p: int = 1, d: int = 1, m: int = 12, powers: Sequence[float] = POWERS, tile: int = TILE
) -> DataFrame:
    """Forecasts on the raw scale (series, origin, step, pos, date, y, yhat): at each origin the chain and the model are fitted on the rows before it.

    ``model``: ``ar`` (least squares, order p, d differences), ``mean`` (of the transformed history) or
    ``seasonal_naive`` (period m).  The rows of the partition after an origin aren't read for it.
    """
    if model not in ("ar", "mean", "seasonal_naive"):
        raise ValueError(f"unknown model: {model}")
    chain = Chain.of(steps)
    numbers = cut(chain_numbers(parts, steps, spec, partition, powers, tile))
    poly, lags = (L._difference(d, 0, 1), list(range(1, p + 1))) if model == "ar" else (np.array([1.0]), [])
    back = len(poly) - 1 + len(lags)
    reach = m if model == "seasonal_naive" else max(back, 1)
    boxcox = chain.transform == "boxcox"
    ready = numbers.join(L.tails(parts, numbers, reach), [KEY, "origin"])
    if model == "seasonal_naive":
        ready = ready.withColumn("g", F.array().cast("array<double>"))
    else:
        rows, same = parts, [KEY]
        if boxcox:  # a series for each curve that some origin chose
            curves = numbers.select(KEY, "shift", "power").distinct()
            rows = attach(parts, curves, KEY, "pos").withColumn("target", chain.column(F.col("target"), F.col("shift"), F.col("power")))
            rows = rows.withColumn(KEY, F.struct(KEY, "shift", "power"))
            same = [KEY, "shift", "power"]
        else:
            rows = parts.withColumn("target", chain.column(F.col("target")))
        lagged = lambda w, k: F.lag("target", k).over(w) if k else F.col("target")

        def differenced(lag: int):
            return lambda w: sum((float(c) * lagged(w, lag + k) for k, c in enumerate(poly) if c), F.lit(0.0))

        rows = L.framed(rows, KEY, {f"_z{k}": differenced(k) for k in [0, *lags]}, back=back)
        sums = L.normal_equations(rows, [F.lit(1.0), *[F.col(f"_z{k}") for k in lags]], F.col("_z0"), spec, partition).drop("n")
        if boxcox:
            sums = sums.select(*[F.col(f"{KEY}.{c}").alias(c) for c in same], "origin", "g")
        ready = ready.join(sums, [*same, "origin"])
    # values around marked rows, for what replacing them changes
    spots = numbers.filter(F.size("marks") > 0).select(KEY, "origin", F.explode("marks.pos").alias("at"))
    spots = spots.select(KEY, "origin", F.explode(F.sequence(F.greatest(F.lit(0), F.col("at") - back), F.least(F.col("at") + back, F.col("origin") - 1))).alias("pos")).distinct()
    around = spots.join(parts.select(KEY, "pos", "target"), [KEY, "pos"]).groupBy(KEY, "origin").agg(F.collect_list(F.struct("pos", "target")).alias("around"))
    ready = ready.join(around, [KEY, "origin"], "left")
    size, horizon = len(lags) + 2, spec.horizon

    def solve(row) -> list[float]:
        curve = (row.shift, row.power) if boxcox else (0.0, 0.0)
        marks = {int(x["pos"]): float(x["new"]) for x in row.marks}
        first = row.origin - len(row.tail)
        raw = np.array([marks.get(first + k, y) for k, y in enumerate(row.tail)], float)
        tail = (chain.forward(raw, *curve) - row.offset) / row.divisor
        if model == "seasonal_naive":
            guess = np.array([tail[len(tail) - m + s % m] for s in range(horizon)])
        else:
            g = L._unpack(np.asarray(row.g), size)
            if marks:
                held = {int(x["pos"]): float(x["target"]) for x in row.around}
                was = {k: float(chain.forward(y, *curve)) for k, y in held.items()}
                now = {k: float(chain.forward(marks.get(k, y), *curve)) for k, y in held.items()}
                for t in sorted({t for at in marks for t in range(max(at, back), min(at + back, row.origin - 1) + 1)}):
                    for sign, z in ((-1.0, was), (1.0, now)):
                        x = np.array([1.0, *[sum(c * z[t - lag - k] for k, c in enumerate(poly)) for lag in [*lags, 0]]])
                        g = g + sign * np.outer(x, x)
            scale = np.eye(size) / row.divisor
            scale[:, 0] -= row.offset * poly.sum() / row.divisor
            scale[0, 0], scale[0, 1:] = 1.0, 0.0
            g = scale @ g @ scale.T
            beta = L._ridge(g[:-1, :-1], g[:-1, -1])
            y, out = list(tail), []
            for _ in range(horizon):
                z = [sum(c * y[-1 - lag - k] for k, c in enumerate(poly)) for lag in range(len(lags))]
                y.append(beta[0] + float(np.dot(beta[1:], z)) - sum(c * y[-k] for k, c in enumerate(poly) if k))
                out.append(y[-1])
            guess = np.array(out)
        return chain.backward(guess * row.divisor + row.offset, *curve).tolist()

    kind = parts.schema[KEY].dataType.simpleString()
    return L._scored(parts, L._forecast(ready, solve, horizon, kind), spec, partition)
