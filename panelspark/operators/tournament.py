"""Candidate tables: all candidates of all series are fitted at all origins from shared statistics, scored, and the winners refitted once.

A stretch between origins gives one matrix of products over the trend, the level and the last
differences of its rows.  Every linear candidate is a linear map of these, so it solves its own part
of the summed matrix.  Smoothing candidates share one pass of states; naive ones read the last season.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import forecast as L
from . import metrics as V
from . import split as J
from .backtest import with_origin
from .lineage import cut
from .ordered import attach, framed
from .split import SplitSpec

KEY = "series_id"
MODELS = ("seasonal_naive", "mean", "trend", "ar", "simple_smoothing")
ENTRY = "struct<candidate_id: bigint, model: string, settings: map<string, double>>"
FIT = "candidate_id bigint, model string, settings map<string, double>, n_used bigint, coefficients array<double>, in_sample_mse double, finite boolean"


def candidate_table(parts: DataFrame, candidates: Sequence[tuple[int, str, Mapping[str, float]]]) -> DataFrame:
    """(series, candidate_id, model, settings): the same candidates for every series.

    Settings: ``m`` of seasonal_naive, ``p`` and ``d`` of ar, ``alpha`` of simple_smoothing.
    """
    for number, model, _ in candidates:
        if model not in MODELS:
            raise ValueError(f"candidate {number}: unknown model {model}")
    entries = [F.struct(F.lit(n).cast("bigint").alias("candidate_id"), F.lit(m).alias("model"), F.create_map(*[x for k, v in s.items() for x in (F.lit(k), F.lit(float(v)))]).cast("map<string, double>").alias("settings")) for n, m, s in candidates]
    return parts.select(KEY).distinct().select(KEY, F.explode(F.array(*entries)).alias("e")).select(KEY, "e.*")


def _span(model: str, settings: Mapping[str, float]) -> int:
    """Differences that a candidate's rows reach back over."""
    return int(settings.get("p", 1)) + max(int(settings.get("d", 0)), 1) if model == "ar" else 1


def _map(model: str, settings: Mapping[str, float], reach: int) -> np.ndarray:
    """The candidate's (1, features, target) as linear maps of (1, pos, level, last ``reach`` differences)."""
    unit = np.eye(3 + reach)
    if model == "mean":
        return unit[[0, 2]]
    if model == "trend":
        return unit[[0, 1, 2]]
    p, d = int(settings.get("p", 1)), int(settings.get("d", 0))
    if d == 0:  # the level k rows ago is the level less the differences since
        line = [unit[2] - unit[3 : 3 + k].sum(axis=0) for k in range(p + 1)]
    else:
        poly = L._difference(d - 1, 0, 1)
        line = [sum(c * unit[3 + k + j] for j, c in enumerate(poly)) for k in range(p + 1)]
    return np.array([unit[0], *line[1:], line[0]])


def _solved(g: np.ndarray) -> tuple[np.ndarray, float]:
    """Least squares from products of (1, features, target): intercept and slopes, mean squared error."""
    n = g[0, 0]
    mean = g[0] / n
    centred = g[1:, 1:] - n * np.outer(mean[1:], mean[1:])
    xx, xy = centred[:-1, :-1], centred[:-1, -1]
    spread = np.sqrt(np.maximum(np.diag(xx), 0.0))
    use = spread > 1e-9 * np.sqrt(np.maximum(np.diag(g)[1:-1], 1e-300))  # a feature that doesn't vary explains nothing
    slope = np.zeros(len(xy))
    if use.any():
        by = spread[use]
        slope[use] = np.linalg.lstsq(xx[np.ix_(use, use)] / np.outer(by, by), xy[use] / by, rcond=1e-12)[0] / by
    error = max(float(centred[-1, -1] - 2 * slope @ xy + slope @ xx @ slope), 0.0) / n
    return np.array([mean[-1] - slope @ mean[1:-1], *slope]), error


def fit_candidates(parts: DataFrame, table: DataFrame, spec: SplitSpec, partition: str = "validation") -> DataFrame:
    """(series, origin, candidate_id, model, settings, n_used, coefficients, in_sample_mse, finite): every candidate at every origin.

    ``table``: as ``candidate_table`` gives it, or with other candidates for each series.  Rows from
    an origin on aren't used for it.  A candidate without a usable row has null numbers and isn't
    finite.  Coefficients: intercept and slopes; of smoothing the level; of naive ones none.  The
    shared matrix has (p + d + 3) squared entries for the longest candidate: meant for short memories.
    """
    table = cut(table.select(KEY, F.col("candidate_id").cast("bigint").alias("candidate_id"), "model", F.col("settings").cast("map<string, double>").alias("settings")))
    setting = lambda name, least: F.greatest(F.coalesce(F.try_element_at("settings", F.lit(name)), F.lit(0.0)), F.lit(float(least)))
    alphas = sorted(r.a for r in table.filter("model = 'simple_smoothing'").select(F.try_element_at("settings", F.lit("alpha")).alias("a")).distinct().collect() if r.a is not None)  # values of one setting
    span = F.when(F.col("model") == "ar", setting("p", 1) + setting("d", 1)).otherwise(1.0)
    reach = int(table.agg(F.max(span).alias("r")).first()["r"] or 1)
    start = parts.filter("pos = 0").select(KEY, F.col("target").alias("y0"))
    rows = attach(parts, start, KEY, "pos").withColumn("_u", F.col("target") - F.col("y0"))
    rows = framed(rows, KEY, {f"_d{k}": (lambda w, k=k: (F.lag("_u", k).over(w) if k else F.col("_u")) - F.lag("_u", k + 1).over(w)) for k in range(reach)}, back=reach)
    line = [F.lit(1.0), F.col("pos").cast("double"), F.col("_u"), *[F.col(f"_d{k}") for k in range(reach)]]
    sums = L.normal_equations(rows, line[:-1], line[-1], spec, partition)
    wanted = with_origin(parts, spec, partition).select(KEY, "origin").distinct()
    head = parts.filter(F.col("pos") < reach).groupBy(KEY).agg(F.sort_array(F.collect_list(F.struct("pos", "target"))).alias("_h")).select(KEY, F.col("_h.target").alias("head"))
    ready = wanted.join(sums, [KEY, "origin"], "left").join(head, KEY)
    if alphas:
        states = L.smoothing_states(parts, spec, None, None, 1, partition, grid=[(a, 0.0, 0.0) for a in alphas])
        states = states.groupBy(KEY, "origin").agg(F.map_from_entries(F.collect_list(F.struct("p", F.struct(F.get("state", F.lit(0)).alias("level"), "sse")))).alias("levels"))
        ready = ready.join(states, [KEY, "origin"], "left")
    else:
        ready = ready.withColumn("levels", F.lit(None).cast("map<int, struct<level: double, sse: double>>"))
    mine = table.groupBy(KEY).agg(F.sort_array(F.collect_list(F.struct("candidate_id", "model", F.map_entries("settings").alias("settings")))).alias("entries"))
    ready = attach(ready, mine, KEY, "origin")
    place = {a: k for k, a in enumerate(alphas)}
    kind = parts.schema[KEY].dataType.simpleString()

    def fit(row) -> Iterator[tuple]:
        base = np.asarray(row.head, float)
        u = base - base[0]
        d = np.diff(u, prepend=u[0])
        full = L._unpack(np.asarray(row.g, float), 3 + reach) if row.g is not None else np.zeros((3 + reach, 3 + reach))
        for entry in row.entries:
            number, model, settings = entry["candidate_id"], entry["model"], {x["key"]: x["value"] for x in entry["settings"]}
            done = (row.origin, None, None)
            if model == "seasonal_naive":
                done = (row.origin, [], None) if row.origin >= settings.get("m", 1) else done
            elif model == "simple_smoothing":
                at = place.get(settings.get("alpha"))
                state = row.levels.get(at) if row.levels is not None and at is not None else None
                if state is not None:
                    done = (row.origin, [state["level"]], state["sse"] / row.origin)
            else:
                by = _map(model, settings, reach)
                need = _span(model, settings) if model == "ar" and settings.get("d", 0) else int(settings.get("p", 1)) if model == "ar" else 0
                g = by @ full @ by.T
                for t in range(need, min(reach, row.origin, len(u))):  # rows before the first one that has all differences
                    x = by @ np.array([1.0, t, u[t], *[d[t - k] if t - k > 0 else 0.0 for k in range(reach)]])
                    g = g + np.outer(x, x)
                n = int(round(g[0, 0]))
                if n > 0:
                    beta, error = _solved(g)
                    level = model in ("mean", "trend") or not settings.get("d", 0)
                    if level:  # levels were measured from the first value
                        beta[0] += base[0] * (1.0 - (beta[1:].sum() if model == "ar" else 0.0))
                    done = (n, beta.tolist(), error)
            n, beta, error = done
            fine = beta is not None and bool(np.isfinite(beta).all())
            yield (getattr(row, KEY), row.origin, number, model, settings, n, beta if fine else None, error if fine else None, fine)

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [r for row in frame.itertuples(index=False) for r in fit(row)]
            yield pd.DataFrame(out, columns=[KEY, "origin", *[c.split()[0] for c in FIT.split(", ") if not c.startswith("double>")]])

    return ready.select(KEY, "origin", "g", "head", "levels", "entries").mapInPandas(batches, f"{KEY} {kind}, origin bigint, {FIT}")


def predict_candidates(fits: DataFrame, parts: DataFrame, spec: SplitSpec, partition: str = "validation") -> DataFrame:
    """(series, candidate_id, origin, step, pos, date, y, yhat): forecasts of a fitted table; not finite ones are null."""
    fits = cut(fits)
    setting = lambda name: F.coalesce(F.try_element_at("settings", F.lit(name)), F.lit(0.0))
    reach = int(fits.agg(F.max(F.greatest(setting("m"), setting("p") + setting("d"), F.lit(1.0))).alias("r")).first()["r"] or 1)
    origins = fits.select(KEY, "origin").distinct()
    ready = fits.join(L.tails(parts, origins, reach), [KEY, "origin"])
    horizon, kind = spec.horizon, parts.schema[KEY].dataType.simpleString()

    def forecast(row) -> list[float]:
        settings, beta, y = dict(row.settings), row.coefficients, [float(v) for v in row.tail]
        if not row.finite:
            return [float("nan")] * horizon
        if row.model == "seasonal_naive":
            m = int(settings.get("m", 1))
            return [y[len(y) - m + s % m] for s in range(horizon)]
        if row.model == "trend":
            return [beta[0] + beta[1] * (row.origin + s) for s in range(horizon)]
        if row.model in ("mean", "simple_smoothing"):
            return [beta[0]] * horizon
        p, poly = int(settings.get("p", 1)), L._difference(int(settings.get("d", 0)), 0, 1)
        out = []
        for _ in range(horizon):
            w = [sum(c * y[-1 - k - j] for j, c in enumerate(poly)) for k in range(p)]
            y.append(beta[0] + float(np.dot(beta[1:], w)) - sum(c * y[-j] for j, c in enumerate(poly) if j))
            out.append(y[-1])
        return out

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [(getattr(row, KEY), row.origin, row.candidate_id, s, v if np.isfinite(v) else None) for row in frame.itertuples(index=False) for s, v in enumerate(forecast(row), start=1)]
            yield pd.DataFrame(out, columns=[KEY, "origin", "candidate_id", "step", "yhat"])

    guessed = ready.mapInPandas(batches, f"{KEY} {kind}, origin bigint, candidate_id bigint, step bigint, yhat double")
    wanted = with_origin(parts, spec, partition).select(KEY, "origin", "step", "pos", "date", F.col("target").alias("y"))
    return wanted.join(guessed, [KEY, "origin", "step"]).select(KEY, "candidate_id", "origin", "step", "pos", "date", "y", "yhat")


def candidate_scores(parts: DataFrame, table: DataFrame, spec: SplitSpec, scale: DataFrame, partition: str = "validation") -> DataFrame:
    """All metrics of every candidate of every series; null where a forecast is missing or not finite."""
    predictions = predict_candidates(fit_candidates(parts, table, spec, partition), parts, spec, partition)
    return V.forecast_metrics(predictions, scale, [KEY, "candidate_id"])


def evaluated(parts: DataFrame, table: DataFrame, spec: SplitSpec, scale: DataFrame) -> DataFrame:
    """Each series' winner on validation, refitted on all rows before each test origin and scored there once.

    (series, candidate_id, model, validation_mase, n_test, test_mae, test_mase, scaled_mae).  The
    smallest mase wins, then the smallest candidate_id; a series whose candidates all lack one has no
    winner, and its test rows stay closed: its row is null but for the key.
    """
    search = J.search_rows(parts)
    trials = candidate_scores(search, table, spec, scale).select(F.col(KEY).alias("run_id"), F.col("candidate_id").alias("step"), F.col("candidate_id").alias("model"), "mase")
    best = V.winner(trials).filter(F.col("best_step").isNotNull())
    winners = cut(best.select(F.col("run_id").alias(KEY), F.col("best_step").alias("candidate_id"), F.col("best_mase").alias("validation_mase"), F.lit(True).alias("frozen")))
    entitled = J.open_holdout(parts, winners, winners.filter(F.lit(False)).select(KEY)).select(KEY, "pos")
    chosen = table.join(winners.select(KEY, "candidate_id"), [KEY, "candidate_id"], "left_semi")
    predictions = cut(predict_candidates(fit_candidates(parts.join(winners.select(KEY), KEY, "left_semi"), chosen, spec, "test"), parts, spec, "test").join(entitled, [KEY, "pos"], "left_semi"))
    tested = V.forecast_metrics(predictions, scale).select(KEY, F.col("n_predictions").alias("n_test"), F.col("mae").alias("test_mae"), F.col("mase").alias("test_mase"))
    scaled = V.scaled_test_metrics(predictions, parts.filter("split = 'train'")).select(KEY, "scaled_mae")
    named = winners.join(table.select(KEY, F.col("candidate_id").cast("bigint").alias("candidate_id"), "model"), [KEY, "candidate_id"])
    every = parts.select(KEY).distinct()
    return every.join(named, KEY, "left").join(tested, KEY, "left").join(scaled, KEY, "left").select(KEY, "candidate_id", "model", "validation_mase", "n_test", "test_mae", "test_mase", "scaled_mae")
