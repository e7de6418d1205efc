"""Rolling-origin evaluation: origins, leakage-free histories, alignment checks and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import running
from .split import SplitSpec

KEY = "series_id"


def origins(parts: DataFrame, spec: SplitSpec, partition: str = "validation") -> DataFrame:
    """One row per series and origin: the position forecasts start at, and how many steps.

    Validation is tiled by whole horizons, so every row of it is forecast exactly once.
    """
    rows = parts.filter(F.col("split") == partition)
    first = F.col("n_train") if partition == "validation" else F.col("n_train") + F.col("n_val")
    step = (F.col("pos") - first).cast("bigint")
    return (
        rows.withColumn("origin", (F.floor(step / spec.horizon) * spec.horizon + first).cast("bigint"))
        .groupBy(KEY, "origin")
        .agg(F.count(F.lit(1)).alias("horizon"), F.min("date").alias("forecast_start"), F.max("date").alias("forecast_end"))
    )


def with_origin(parts: DataFrame, spec: SplitSpec, partition: str = "validation") -> DataFrame:
    """Evaluation rows with their origin and step (1-based)."""
    first = F.col("n_train") if partition == "validation" else F.col("n_train") + F.col("n_val")
    ahead = F.col("pos") - first
    return parts.filter(F.col("split") == partition).withColumn(
        "origin", (F.floor(ahead / spec.horizon) * spec.horizon + first).cast("bigint")
    ).withColumn("step", (F.col("pos") - F.col("origin") + 1).cast("bigint"))


def seasonal_naive(parts: DataFrame, spec: SplitSpec, period: int, partition: str = "validation") -> DataFrame:
    """Forecast each step by the same season of the last season before the origin.

    The rows that supply forecasts are looked up by position, so the join key is as fine as the data
    and nothing beyond the origin can be read.
    """
    wanted = with_origin(parts, spec, partition)
    # step s reads origin - period + (s - 1) mod period
    source = F.col("origin") - period + F.pmod(F.col("step") - 1, F.lit(period))
    wanted = wanted.withColumn("_src", source.cast("bigint"))
    past = parts.select(KEY, F.col("pos").alias("_src"), F.col("target").alias("yhat"))
    out = wanted.join(past, [KEY, "_src"], "left")
    return out.select(KEY, "origin", "step", "pos", "date", F.col("target").alias("y"), "yhat")


def origin_audit(parts: DataFrame, spec: SplitSpec, partition: str = "validation") -> DataFrame:
    """Training and forecast limits of every origin of the expanding-history protocol."""
    per_origin = origins(parts, spec, partition)
    dates = parts.select(KEY, (F.col("pos") + 1).alias("origin"), F.col("date").alias("train_end"))
    start = parts.groupBy(KEY).agg(F.min("date").alias("train_start"))
    return per_origin.join(dates, [KEY, "origin"], "left").join(start, KEY).select(
        KEY, "origin", F.col("origin").alias("train_size"), "train_start", "train_end", "forecast_start", "forecast_end", "horizon"
    )


def alignment(expected: DataFrame, predictions: DataFrame) -> DataFrame:
    """Per series: evaluation rows without a prediction, surplus and repeated predictions."""
    a = expected.select(KEY, "date", F.lit(1).alias("_e"))
    b = predictions.groupBy(KEY, "date").agg(F.count(F.lit(1)).alias("_p"))
    both = a.join(b, [KEY, "date"], "full")
    return both.groupBy(KEY).agg(
        F.sum((F.col("_e").isNotNull() & F.col("_p").isNotNull()).cast("bigint")).alias("matched"),
        F.sum(F.col("_p").isNull().cast("bigint")).alias("missing"),
        F.sum(F.col("_e").isNull().cast("bigint")).alias("surplus"),
        F.coalesce(F.sum(F.col("_p") - 1), F.lit(0)).cast("bigint").alias("repeated"),
    )


def horizon_problems(predictions: DataFrame, spec: SplitSpec) -> DataFrame:
    """Per series: origins, predictions, origins of another length than the horizon, unusable forecasts."""
    per = predictions.groupBy(KEY, "origin").agg(
        F.count(F.lit(1)).alias("_c"), F.sum((F.col("yhat").isNull() | F.isnan("yhat")).cast("bigint")).alias("_bad")
    )
    return per.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("origins"),
        F.sum("_c").alias("n_predictions"),
        F.sum((F.col("_c") != spec.horizon).cast("bigint")).alias("odd_origins"),
        F.sum("_bad").alias("unusable"),
    )


def origin_levels(parts: DataFrame, spec: SplitSpec, partition: str = "validation") -> DataFrame:
    """Expanding-history mean forecast: one refit per origin, read off a running total.

    Aggregate-form models need no copy of the history per origin: the prefix totals at the
    origin are all that a refit uses.
    """
    level = parts.withColumn("_one", F.lit(1))
    level = running(level, KEY, {"_s": ("sum", F.col("target"), False)})
    fit = level.select(KEY, F.col("pos").alias("origin"), (F.col("_s") / F.col("pos")).alias("yhat"))
    wanted = with_origin(parts, spec, partition)
    return wanted.join(fit, [KEY, "origin"], "left").select(
        KEY, "origin", "step", "pos", "date", F.col("target").alias("y"), "yhat"
    )
