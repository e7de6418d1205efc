"""Regular calendars: binning, empty bins, and position-wise linear interpolation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import running, with_position

KEY = "series_id"
CHUNK = 4096


def _day_no(c: Column) -> Column:
    return F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date"))


def _from_day(n: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), n.cast("int"))


# fixed values: weekday number (Monday 0) on which a weekly bin ends
WEEK_END = {"W-MON": 0, "W-TUE": 1, "W-WED": 2, "W-THU": 3, "W-FRI": 4, "W-SAT": 5, "W-SUN": 6, "W": 6}


def bin_number(date: Column, freq: str) -> Column:
    """Whole-number bin of a date; consecutive bins differ by one."""
    if freq == "D":
        return _day_no(date).cast("bigint")
    if freq == "h":
        return F.floor(F.unix_micros(date.cast("timestamp")) / F.lit(3600e6))
    if freq in WEEK_END:  # closed and labelled on the right: a bin holds the seven days up to its label
        return F.ceil((_day_no(date) - 4 - WEEK_END[freq]) / 7)
    if freq == "MS":
        return (F.year(date) * 12 + F.month(date) - 1).cast("bigint")
    if freq == "QS":
        return (F.year(date) * 4 + F.quarter(date) - 1).cast("bigint")
    if freq == "YS":
        return F.year(date).cast("bigint")
    raise ValueError(f"unsupported frequency: {freq}")


def bin_label(bin_no: Column, freq: str) -> Column:
    if freq == "D":
        return _from_day(bin_no)
    if freq == "h":
        return F.timestamp_seconds(bin_no * 3600)
    if freq in WEEK_END:
        return _from_day(bin_no * 7 + 4 + WEEK_END[freq])
    if freq == "MS":
        return F.make_date(F.floor(bin_no / 12).cast("int"), (F.pmod(bin_no, F.lit(12)) + 1).cast("int"), F.lit(1))
    if freq == "QS":
        return F.make_date(F.floor(bin_no / 4).cast("int"), (F.pmod(bin_no, F.lit(4)) * 3 + 1).cast("int"), F.lit(1))
    if freq == "YS":
        return F.make_date(bin_no.cast("int"), F.lit(1), F.lit(1))
    raise ValueError(f"unsupported frequency: {freq}")


def resample(panel: DataFrame, freq: str, agg: str = "mean") -> DataFrame:
    """One row per series and bin from its first to its last bin; empty bins have a null target.

    ``agg`` is mean, sum, min, max or any other one-argument aggregate name.  An empty bin sums to 0.
    """
    fn = {"mean": "avg"}.get(agg, agg)
    bins = panel.withColumn("_bin", bin_number(F.col("date"), freq))
    values = bins.groupBy(KEY, "_bin").agg(getattr(F, fn)("target").alias("target"))
    span = values.groupBy(KEY).agg(F.min("_bin").alias("_b0"), F.max("_bin").alias("_b1"))
    # two levels, so that a long calendar is spread over tasks before it is spelled out
    chunks = span.select(KEY, "_b1", F.explode(F.sequence("_b0", "_b1", F.lit(CHUNK).cast("bigint"))).alias("_c"))
    grid = chunks.repartition(KEY, "_c").select(
        KEY, F.explode(F.sequence("_c", F.least(F.col("_c") + CHUNK - 1, F.col("_b1")))).alias("_bin")
    )
    out = grid.join(values, [KEY, "_bin"], "left")
    target = F.coalesce("target", F.lit(0.0)) if agg == "sum" else F.col("target")
    return out.select(KEY, bin_label(F.col("_bin"), freq).alias("date"), target.alias("target"))


def interpolate(panel: DataFrame) -> DataFrame:
    """Fill null targets linearly by position; the edges take the nearest value."""
    rows = with_position(panel, KEY, "date", n=None)
    point = F.when(F.col("target").isNotNull(), F.struct(F.col("pos").alias("p"), F.col("target").alias("y")))
    rows = running(rows, KEY, {"_a": ("last", point, True), "_b": ("next", point, True)})
    between = F.col("_a.y") + (F.col("_b.y") - F.col("_a.y")) * (F.col("pos") - F.col("_a.p")) / (F.col("_b.p") - F.col("_a.p"))
    filled = F.coalesce("target", between, F.col("_a.y"), F.col("_b.y"))
    return rows.withColumn("was_missing", F.col("target").isNull()).withColumn("target", filled).drop("_a", "_b")
