"""Exact per-key medians with bounded memory.

A bounded sketch brackets the middle ranks with four times its guaranteed error on each side.  Values
inside the bracket are counted one by one, those outside only as two totals, so that a key of any size
ranks a sliver of its values.  Should a middle rank ever fall outside the bracket, the job fails; it never
answers approximately.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import attach

ACCURACY = 20000


def exact_median(df: DataFrame, key: str, value: Column, name: str = "median", *, upper: bool = False) -> DataFrame:
    """One row per key: the exact median of the non-null values (``upper``: the upper middle value)."""
    rows = df.select(key, value.cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    slack = 4.0 / ACCURACY
    sketch = rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min("_v").alias("_min"),
        F.max("_v").alias("_max"),
        F.percentile_approx("_v", [0.5 - slack, 0.5 + slack], ACCURACY).alias("_q"),
    )
    small = F.col("_n") < ACCURACY // 8
    sketch = sketch.select(
        key,
        F.when(small, F.col("_min")).otherwise(F.col("_q")[0]).alias("_lo"),
        F.when(small, F.col("_max")).otherwise(F.col("_q")[1]).alias("_hi"),
        F.floor((F.col("_n") - 1) / 2).alias("_r1"),
        F.floor(F.col("_n") / 2).alias("_r2"),
    )
    placed = attach(rows, sketch, key, "_v")
    side = F.when(F.col("_v") < F.col("_lo"), -1).when(F.col("_v") > F.col("_hi"), 1).otherwise(0)
    counted = (
        placed.select(key, "_r1", "_r2", side.alias("_side"), F.when(side == 0, F.col("_v")).alias("_v"))
        .groupBy(key, "_r1", "_r2", "_side", "_v")
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    upto = F.sum("_c").over(Window.partitionBy(key).orderBy("_side", "_v"))
    ranked = counted.withColumn("_last", upto - 1).withColumn("_first", F.col("_last") - F.col("_c") + 1)
    at = lambda r: F.max(F.when(F.col(r).between(F.col("_first"), F.col("_last")), F.col("_v")))
    found = at("_r2") if upper else (at("_r1") + at("_r2")) / 2.0
    middle = ranked.groupBy(key).agg(found.alias(name))
    missed = F.raise_error(F.lit("median rank outside its bracket"))
    return middle.withColumn(name, F.when(F.col(name).isNull(), missed.cast("double")).otherwise(F.col(name)))
