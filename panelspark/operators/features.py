"""Features derived from the target's own past and from the calendar."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from .ordered import framed

KEY = "series_id"
ROLLING = ("mean", "std", "min", "max")


def lag_columns(lags: Sequence[int], value: str = "target") -> dict:
    return {f"lag_{k}": (lambda w, k=k: F.lag(value, k).over(w)) for k in lags}


def _rolling(fn: str, size: int, value: str):
    agg = {"mean": F.avg, "std": F.stddev_pop, "min": F.min, "max": F.max}[fn]

    def build(w: WindowSpec) -> Column:
        past = w.rowsBetween(-size, -1)
        return F.when(F.count(value).over(past) == size, agg(value).over(past))

    return build


def rolling_columns(windows: Sequence[int], functions: Sequence[str] = ("mean",), value: str = "target") -> dict:
    """Statistics of the previous ``w`` rows, all of which must be present."""
    bad = set(functions) - set(ROLLING)
    if bad or any(w < 2 for w in windows):
        raise ValueError(f"unsupported rolling features: {sorted(bad) or list(windows)}")
    return {f"rolling_{f}_{w}": _rolling(f, w, value) for w in windows for f in functions}


def add_past_features(
    rows: DataFrame,
    lags: Sequence[int] = (),
    windows: Sequence[int] = (),
    functions: Sequence[str] = ("mean",),
    value: str = "target",
) -> DataFrame:
    """Lags and rolling statistics in one pass over the series; ``rows`` carries ``pos``."""
    cols = {**lag_columns(lags, value), **rolling_columns(windows, functions, value)}
    return framed(rows, KEY, cols, back=max([*lags, *windows]))


def complete(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    return rows.dropna(subset=list(names))


def add_calendar(
    rows: DataFrame,
    *,
    month: bool = True,
    quarter: bool = True,
    dayofweek: bool = False,
    time_idx: bool = True,
    date: str = "date",
) -> DataFrame:
    """Sine and cosine of month, quarter and weekday; ``time_idx`` is the position in the whole series."""
    parts = []
    if month:
        parts.append(("month", F.month(date), 12.0))
    if quarter:
        parts.append(("quarter", F.quarter(date), 4.0))
    if dayofweek:
        parts.append(("dayofweek", F.weekday(date), 7.0))
    for name, value, period in parts:
        angle = F.lit(2.0 * math.pi) * value.cast("double") / F.lit(period)
        rows = rows.withColumn(f"{name}_sin", F.sin(angle)).withColumn(f"{name}_cos", F.cos(angle))
    return rows.withColumn("time_idx", F.col("pos").cast("double")) if time_idx else rows


def history_tail(rows: DataFrame, lags: Sequence[int]) -> DataFrame:
    """The last ``max(lags)`` training targets of each series, as needed to replay the lags."""
    return rows.filter(F.col("pos") >= F.col("n_train") - max(lags)).filter(F.col("pos") < F.col("n_train"))


def training_windows(rows: DataFrame, lookback: int, horizon: int) -> DataFrame:
    """Sliding (x, y) pairs: ``lookback`` values followed by the next ``horizon`` values."""
    cols = {
        "x": lambda w: F.collect_list("target").over(w.rowsBetween(0, lookback - 1)),
        "y": lambda w: F.collect_list("target").over(w.rowsBetween(lookback, lookback + horizon - 1)),
    }
    out = framed(rows.select(KEY, "pos", "target"), KEY, cols, ahead=lookback + horizon)
    return out.filter((F.size("x") == lookback) & (F.size("y") == horizon)).select(KEY, F.col("pos").alias("start"), "x", "y")
