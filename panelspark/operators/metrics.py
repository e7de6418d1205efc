"""Forecast metrics per series, model or origin; everything is one partial aggregate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import framed

KEY = "series_id"


def metric_columns(y: str = "y", yhat: str = "yhat", eps: float = 1e-8) -> dict[str, Column]:
    """Aggregates for mse, rmse, mae, r2 and mape of a group of predictions.

    A group with a missing or non-finite prediction has no metrics: a model can't score by leaving hard rows out.
    """
    err = F.col(y) - F.col(yhat)
    mse = F.avg(err * err)
    total = F.var_pop(y)
    perfect = F.when(mse == 0, 1.0).otherwise(0.0)
    metrics = {
        "mse": mse,
        "rmse": F.sqrt(mse),
        "mae": F.avg(F.abs(err)),
        "r2": F.when(total > 0, 1.0 - mse / total).otherwise(perfect),
        "mape": F.avg(F.abs(err / F.greatest(F.abs(F.col(y)), F.lit(eps)))),
    }
    return {name: F.when(missing_forecasts(yhat) == 0, value) for name, value in metrics.items()}


def missing_forecasts(yhat: str = "yhat") -> Column:
    """How many predictions of a group are null, NaN or infinite."""
    value = F.col(yhat).cast("double")
    return F.count_if(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")))


def mase_scale(train: DataFrame, period: int | str = 1) -> DataFrame:
    """Mean absolute seasonal difference of the raw training target; null where undefined.

    ``period`` is one number for all series or the name of a column holding each series' own.
    """
    if isinstance(period, int):
        rows = framed(train, KEY, {"_past": lambda w: F.lag("target", period).over(w)}, back=period)
    else:
        rows = train.select(KEY, "pos", "target", period)
        past = rows.select(KEY, (F.col("pos") + F.col(period)).alias("pos"), F.col("target").alias("_past"))
        rows = rows.join(past, [KEY, "pos"], "left")
    naive = F.avg(F.abs(F.col("target") - F.col("_past")))
    return rows.groupBy(KEY).agg(F.when(naive >= 1e-10, naive).alias("scale"))


def mase_period(diagnostics: DataFrame) -> DataFrame:
    """(series, period, period_source): the detected period only if two full seasons were trained on.

    ``diagnostics`` carries seasonality_detected, seasonal_periods and n_train.
    """
    fits = (F.col("seasonal_periods") > 1) & (F.col("n_train") >= 2 * F.col("seasonal_periods"))
    detected = F.col("seasonality_detected")
    return diagnostics.select(
        KEY,
        "n_train",
        F.when(detected & fits, F.col("seasonal_periods")).otherwise(F.lit(1)).cast("bigint").alias("period"),
        F.when(~detected, "nonseasonal_detector")
        .when(fits, "detected_seasonality_period")
        .otherwise("detected_period_unavailable")
        .alias("period_source"),
    )


def mase_reference(train: DataFrame, periods: DataFrame) -> DataFrame:
    """The one denominator all candidates of a series are scored with."""
    rows = train.select(KEY, "pos", "target").join(periods.select(KEY, "period"), KEY)
    scale = mase_scale(rows, "period")
    return periods.join(scale, KEY, "left").withColumn("defined", F.col("scale").isNotNull())


def forecast_metrics(predictions: DataFrame, scale: DataFrame, by: Sequence[str] = (KEY,)) -> DataFrame:
    """All metrics per group, with mase against the series' scale (null where the scale is undefined)."""
    cols = metric_columns()
    got = predictions.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_predictions"), *[c.alias(k) for k, c in cols.items()]
    )
    return got.join(scale.select(KEY, "scale"), KEY, "left").withColumn("mase", F.col("mae") / F.col("scale")).drop("scale")


def scaled_test_metrics(predictions: DataFrame, train: DataFrame) -> DataFrame:
    """mse, mae and rmse on the scale where training spans 0 to 1; null for a constant training series."""
    limits = train.groupBy(KEY).agg(F.min("target").alias("_lo"), F.max("target").alias("_hi"))
    # the errors scale linearly, so the limits join the aggregates and not the rows
    err = F.col("y") - F.col("yhat")
    complete = missing_forecasts() == 0
    sums = predictions.groupBy(KEY).agg(F.when(complete, F.avg(err * err)).alias("_mse"), F.when(complete, F.avg(F.abs(err))).alias("_mae"))
    span = F.col("_hi") - F.col("_lo")
    span = F.when(span > 0, span)
    return sums.join(limits, KEY).select(
        KEY,
        (F.col("_mse") / (span * span)).alias("scaled_mse"),
        (F.col("_mae") / span).alias("scaled_mae"),
        (F.sqrt("_mse") / span).alias("scaled_rmse"),
    )


def per_origin(predictions: DataFrame, scale: DataFrame) -> DataFrame:
    """MAE and MASE of every forecast origin; null where a prediction of the origin is missing."""
    error = F.avg(F.abs(F.col("y") - F.col("yhat")))
    got = predictions.groupBy(KEY, "origin").agg(F.when(missing_forecasts() == 0, error).alias("mae"))
    return got.join(scale.select(KEY, "scale"), KEY, "left").withColumn("mase", F.col("mae") / F.col("scale")).drop("scale")


def winner(trials: DataFrame, key: str = "run_id") -> DataFrame:
    """Trial with the smallest defined mase, the earliest on ties."""
    scored = F.col("mase").isNotNull() & ~F.isnan("mase") & (F.abs("mase") != float("inf"))
    best = F.min_by(F.struct("step", "model", "mase"), F.when(scored, F.struct("mase", "step")))
    return trials.groupBy(key).agg(best.alias("_b")).select(
        key, F.col("_b.step").alias("best_step"), F.col("_b.model").alias("best_model"), F.col("_b.mase").alias("best_mase")
    )
