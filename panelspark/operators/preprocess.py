"""Preprocessing chains: fit on training rows, replay on later rows, invert predictions in reverse.

A chain is an ordered list of steps.  Fitting gives, per step, a small table with one row of fitted
numbers per series; steps that learn nothing have none.  The description of a step holds no fitted
number, so fitting it again on more data needs nothing removed.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import diagnostics as D
from . import features as E
from .lineage import cut
from .ordered import attach

KEY = "series_id"
TINY = 1e-12


@dataclass(frozen=True)
class Step:
    name: str
    scope: str = "features"
    method: str = "log1p"
    lags: tuple[int, ...] = ()
    windows: tuple[int, ...] = ()
    functions: tuple[str, ...] = ("mean",)
    calendar: dict = field(default_factory=dict)

    @property
    def reach(self) -> int:
        return max([*self.lags, *self.windows, 0])

    def produces(self) -> list[str]:
        if self.name == "lag_features":
            return [f"lag_{k}" for k in self.lags]
        if self.name == "rolling_features":
            return [f"rolling_{f}_{w}" for w in self.windows for f in self.functions]
        return []


@dataclass(frozen=True)
class Fitted:
    step: Step
    numbers: DataFrame | None = None
    columns: tuple[str, ...] = ()


SCALERS = ("standard_scaler", "minmax_scaler")


# ---------------------------------------------------------------- scalers


def fit_scaler(rows: DataFrame, name: str, columns: Sequence[str]) -> DataFrame:
    """(series, offset and divisor of every column); a constant column is divided by 1."""
    aggs = []
    for c in columns:
        if name == "standard_scaler":
            offset, spread = F.avg(c), F.stddev_pop(c)
        else:
            offset, spread = F.min(c), F.max(c) - F.min(c)
        aggs += [offset.alias(f"_o_{c}"), F.when(F.abs(spread) < TINY, 1.0).otherwise(spread).alias(f"_d_{c}")]
    return rows.groupBy(KEY).agg(*aggs)


def apply_scaler(rows: DataFrame, numbers: DataFrame, columns: Sequence[str]) -> DataFrame:
    out = attach(rows, numbers, KEY, "pos")
    for c in columns:
        out = out.withColumn(c, (F.col(c) - F.col(f"_o_{c}")) / F.col(f"_d_{c}"))
    return out.drop(*[f"_{k}_{c}" for c in columns for k in "od"])


# ---------------------------------------------------------------- target transforms


def log_forward(y: Column, method: str) -> Column:
    low = -1.0 if method == "log1p" else 0.0
    outside = F.raise_error(F.lit(f"{method}: target outside its domain")).cast("double")
    return F.when(y <= low, outside).otherwise(F.log1p(y) if method == "log1p" else F.log(y))


def boxcox_forward(y: Column, lam: Column, shift: Column) -> Column:
    x = y + shift
    return F.when(F.abs(lam) < TINY, F.log(x)).otherwise((F.pow(x, lam) - 1.0) / lam)


def boxcox_inverse(z: Column, lam: Column, shift: Column) -> Column:
    base = F.greatest(lam * z + 1.0, F.lit(TINY))
    return F.when(F.abs(lam) < TINY, F.exp(z)).otherwise(F.pow(base, 1.0 / lam)) - shift


def _likelihoods(rows: DataFrame, candidates: Sequence[Column], tags: Sequence[str]) -> DataFrame:
    """Profile log-likelihood of every candidate power, all in one aggregate per series."""
    x = F.col("target") + F.col("shift")
    logs, n = F.sum(F.log(x)), F.count(F.lit(1))
    aggs = []
    for lam, tag in zip(candidates, tags):
        # the constant -1 / power doesn't change the variance, and would swallow it for large powers
        z = F.when(F.abs(lam) < TINY, F.log(x)).otherwise(F.pow(x, lam) / lam)
        aggs.append(((F.first(lam) - 1.0) * logs - n / 2.0 * F.log(F.var_pop(z))).alias(tag))
    return rows.groupBy(KEY, "shift").agg(*aggs)


def boxcox_shift(train: DataFrame) -> DataFrame:
    """Shift that makes the training target positive: 1 - min where it is not."""
    low = F.min("target")
    return train.groupBy(KEY).agg(F.when(low <= 0, 1.0 - low).otherwise(0.0).alias("shift"))


def boxcox_grid(train: DataFrame, powers: Sequence[float]) -> DataFrame:
    """(series, shift, power, likelihood) over a fixed grid of powers."""
    rows = attach(train, boxcox_shift(train), KEY, "pos")
    tags = [f"l{i}" for i in range(len(powers))]
    wide = _likelihoods(rows, [F.lit(float(p)) for p in powers], tags)
    entries = F.array(*[F.struct(F.lit(float(p)).alias("power"), F.col(t).alias("likelihood")) for p, t in zip(powers, tags)])
    return wide.select(KEY, "shift", F.explode(entries).alias("e")).select(KEY, "shift", "e.*")


def fit_boxcox(train: DataFrame, rounds: int = 3) -> DataFrame:
    """(series, shift, power): the most likely power, narrowed tenfold per round.

    The search starts at [-2, 2].  A series whose best power lies on the edge of what was searched is
    searched further out, in spans that double, until its maximum is inside or its likelihood can't be
    computed any more (a constant series, or powers beyond the range of doubles).
    """
    step = 0.1
    # a null sorts below every likelihood, so without any likelihood the power nearest to zero is taken
    known = F.when(~F.isnan("likelihood") & (F.abs("likelihood") != float("inf")), F.round("likelihood", 9))
    best = lambda df: df.groupBy(KEY, "shift").agg(F.max_by("power", F.struct(known, -F.abs("power"))).alias("power"))

    def around(rows: DataFrame, centres: DataFrame, offsets: Sequence[float]) -> DataFrame:
        """Likelihoods at ``power + offset`` of every series in ``centres``."""
        near = attach(rows.join(centres.select(KEY), KEY, "left_semi"), centres, KEY, "pos")
        tags = [f"l{i}" for i in range(len(offsets))]
        wide = _likelihoods(near, [F.col("power") + o for o in offsets], tags).join(centres.select(KEY, "power"), KEY)
        entries = F.array(*[F.struct((F.col("power") + o).alias("power"), F.col(t).alias("likelihood")) for o, t in zip(offsets, tags)])
        return wide.select(KEY, "shift", F.explode(entries).alias("e")).select(KEY, "shift", "e.*")

    start = best(boxcox_grid(train, [round(-2 + step * i, 10) for i in range(41)]))
    fitted, edge, span = cut(start.withColumn("step", F.lit(step))), 2.0, 2.0
    while True:
        outer = fitted.filter(F.abs("power") >= edge - 1e-9)
        if outer.isEmpty():
            break
        outward = span / 20.0
        further = around(train, outer.select(KEY, "shift", "power"), [i * outward for i in range(-20, 21)])
        moved = best(further).withColumn("step", F.lit(outward))
        fitted = cut(fitted.join(moved.select(KEY), KEY, "left_anti").unionByName(moved))
        edge, span = edge + span, span * 2.0
    for _ in range(rounds):
        near = [(i, o) for i, o in enumerate(range(-10, 11))]
        rows = attach(train, fitted, KEY, "pos")
        tags = [f"l{i}" for i, _ in near]
        at = lambda o: F.col("power") + F.col("step") * (o / 10.0)
        wide = _likelihoods(rows, [at(o) for _, o in near], tags).join(fitted.select(KEY, "power", "step"), KEY)
        entries = F.array(*[F.struct(at(o).alias("power"), F.col(t).alias("likelihood")) for (_, o), t in zip(near, tags)])
        found = best(wide.select(KEY, "shift", F.explode(entries).alias("e")).select(KEY, "shift", "e.*"))
        fitted = cut(found.join(fitted.select(KEY, (F.col("step") / 10.0).alias("step")), KEY))
    return fitted.drop("step")


# ---------------------------------------------------------------- chains


def fit(train: DataFrame, steps: Sequence[Step]) -> tuple[DataFrame, list[Fitted]]:
    """Transformed training rows and what each step learned.  Row counts never grow."""
    rows, made, log = train, [], []
    for step in steps:
        if step.name in SCALERS:
            columns = ["target"] if step.scope == "target" else list(made)
            if not columns:
                raise ValueError(f"{step.name}: no predictor columns to scale")
            numbers = fit_scaler(rows, step.name, columns)
            rows = apply_scaler(rows, numbers, columns)
            log.append(Fitted(step, numbers, tuple(columns)))
        elif step.name == "log_transform":
            rows = rows.withColumn("target", log_forward(F.col("target"), step.method))
            log.append(Fitted(step))
        elif step.name == "boxcox_transform":
            numbers = fit_boxcox(rows)
            rows = _boxcox(rows, numbers)
            log.append(Fitted(step, numbers))
        elif step.name == "replace_outliers":
            numbers = cut(D.outlier_replacements(rows).select(KEY, "pos", "replacement"))
            rows = _replace(rows, numbers)
            log.append(Fitted(step, numbers))
        elif step.name in ("lag_features", "rolling_features"):
            rows = E.complete(E.add_past_features(rows, step.lags, step.windows, step.functions), step.produces())
            made += step.produces()
            log.append(Fitted(step))
        elif step.name == "calendar_features":
            before = set(rows.columns)
            rows = E.add_calendar(rows, **step.calendar)
            made += [c for c in rows.columns if c not in before]
            log.append(Fitted(step))
        else:
            raise ValueError(f"unknown preprocessing step: {step.name}")
    return rows, log


def _boxcox(rows: DataFrame, numbers: DataFrame) -> DataFrame:
    out = attach(rows, numbers, KEY, "pos")
    return out.withColumn("target", boxcox_forward(F.col("target"), F.col("power"), F.col("shift"))).drop("power", "shift")


def _replace(rows: DataFrame, numbers: DataFrame) -> DataFrame:
    return rows.join(numbers, [KEY, "pos"], "left").withColumn("target", F.coalesce("replacement", "target")).drop("replacement")


def replay(history: DataFrame, new: DataFrame, log: Sequence[Fitted]) -> DataFrame:
    """Transform ``new`` rows with the fitted chain; of ``history`` only the rows lags reach into are read.

    Positions go on from the history; replaced outliers concern history rows only.
    """
    reach = sum(f.step.reach for f in log)
    tail = history.filter(F.col("pos") >= F.col("n_train") - reach) if "n_train" in history.columns else history
    rows = tail.withColumn("_is_new", F.lit(False)).unionByName(new.withColumn("_is_new", F.lit(True)), allowMissingColumns=True)
    for f in log:
        step = f.step
        if step.name in SCALERS:
            rows = apply_scaler(rows, f.numbers, f.columns)
        elif step.name == "log_transform":
            rows = rows.withColumn("target", log_forward(F.col("target"), step.method))
        elif step.name == "boxcox_transform":
            rows = _boxcox(rows, f.numbers)
        elif step.name == "replace_outliers":
            rows = rows.join(f.numbers.withColumn("_is_new", F.lit(False)), [KEY, "pos", "_is_new"], "left")
            rows = rows.withColumn("target", F.coalesce("replacement", "target")).drop("replacement")
        elif step.name in ("lag_features", "rolling_features"):
            rows = E.add_past_features(rows, step.lags, step.windows, step.functions)
        elif step.name == "calendar_features":
            rows = E.add_calendar(rows, **step.calendar)
    return rows.filter("_is_new").drop("_is_new")


def incomplete_features(rows: DataFrame, log: Sequence[Fitted]) -> DataFrame:
    """Rows of each series whose lag or rolling features are missing; must be empty before a model reads them."""
    names = [c for f in log for c in f.step.produces()]
    bad = F.lit(False)
    for c in names:
        bad = bad | F.col(c).isNull()
    return rows.filter(bad).groupBy(KEY).agg(F.count(F.lit(1)).alias("incomplete_rows"))


def invert(predictions: DataFrame, log: Sequence[Fitted], column: str = "yhat") -> DataFrame:
    """Predictions back on the raw scale, undoing the target steps from last to first."""
    rows = predictions
    for f in reversed(list(log)):
        y = F.col(column)
        if f.step.name in SCALERS and f.step.scope == "target":
            rows = attach(rows, f.numbers, KEY, "pos").withColumn(column, y * F.col("_d_target") + F.col("_o_target")).drop("_d_target", "_o_target")
        elif f.step.name == "log_transform":
            rows = rows.withColumn(column, F.expm1(y) if f.step.method == "log1p" else F.exp(y))
        elif f.step.name == "boxcox_transform":
            rows = attach(rows, f.numbers, KEY, "pos").withColumn(column, boxcox_inverse(y, F.col("power"), F.col("shift"))).drop("power", "shift")
    return rows


def fitted_log(log: Sequence[Fitted]) -> DataFrame | None:
    """The fitted numbers as one long table: (series, step_no, name, params)."""
    out = None
    for i, f in enumerate(log):
        if f.numbers is None:
            continue
        cols = [c for c in f.numbers.columns if c != KEY]
        pairs = [x for c in cols for x in (F.lit(c), F.col(c).cast("double"))]
        one = f.numbers.select(KEY, F.lit(i).alias("step_no"), F.lit(f.step.name).alias("name"), F.create_map(*pairs).alias("params"))
        out = one if out is None else out.unionByName(one)
    return out
