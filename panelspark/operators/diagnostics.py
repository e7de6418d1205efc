"""Series diagnostics: frequency, moments, trend, autocorrelation, seasonality, skew and outliers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut
from .ordered import attach, framed, with_position
from .quantiles import exact_median

KEY = "series_id"
# fixed values: short names of weekdays (Monday first) and months
WEEKDAYS = ["MON", "TUE", "WED", "THU", "FRI", "SAT", "SUN"]
MONTHS = ["JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"]



def positioned(panel: DataFrame) -> DataFrame:
    """Rows with ``pos`` and ``n``; rows that have them already are not numbered again."""
    return panel if {"pos", "n"} <= set(panel.columns) else with_position(panel, KEY, "date")


# ---------------------------------------------------------------- moments

def data_summary(panel: DataFrame) -> DataFrame:
    """Counts, moments and a stationarity hint (differences much calmer than levels)."""
    whole = panel.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("n_obs"),
        F.avg("target").alias("mean"),
        F.stddev_pop("target").alias("std"),
        F.min("target").alias("min"),
        F.max("target").alias("max"),
        F.sum(F.col("target").isNull().cast("bigint")).alias("n_missing"),
        F.count("target").alias("_valid"),
    )
    valid = with_position(panel.filter(F.col("target").isNotNull()), KEY, "date", n=None)
    steps = framed(valid, KEY, {"_d": lambda w: F.col("target") - F.lag("target").over(w)}, back=1)
    calm = steps.groupBy(KEY).agg(F.stddev_pop("_d").alias("_sd"))
    return whole.join(calm, KEY, "left").select(
        KEY, "n_obs", "mean", "std", "min", "max", "n_missing",
        F.when(F.col("_valid") > 2, F.col("_sd") < F.col("std") * 0.5).alias("stationary"),
    )


def dataset_signature(panel: DataFrame) -> DataFrame:
    return panel.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("n_obs"),
        F.avg("target").alias("mean"),
        F.stddev_samp("target").alias("std"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
    )


def base_stats(panel: DataFrame) -> DataFrame:
    """Moments, volatility, difference noise and linear trend; zeros for series under five rows."""
    rows = positioned(panel)
    rows = framed(rows, KEY, {"_d": lambda w: F.col("target") - F.lag("target").over(w)}, back=1)
    t = F.col("pos").cast("double")
    s = rows.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("n_obs"),
        F.avg("target").alias("mean"),
        F.stddev_pop("target").alias("std"),
        F.min("target").alias("min"),
        F.max("target").alias("max"),
        F.avg(F.abs("target")).alias("_mean_abs"),
        F.stddev_pop("_d").alias("_sd"),
        F.regr_slope(F.col("target"), t).alias("slope"),
        F.regr_intercept(F.col("target"), t).alias("intercept"),
    )
    enough = F.col("n_obs") >= 5
    pick = lambda c: F.when(enough, c).otherwise(F.lit(0.0))
    return s.select(
        KEY,
        "n_obs",
        *[pick(F.col(c)).alias(c) for c in ("mean", "std", "min", "max", "slope", "intercept")],
        pick(F.abs("slope") * F.col("n_obs") / (F.col("std") + 1e-6)).alias("trend_strength"),
        pick(F.col("std") / (F.col("_mean_abs") + 1e-6)).alias("volatility_cv"),
        pick(F.col("_sd") / (F.col("std") + 1e-6)).alias("delta_noise"),
    )


def detrended(panel: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """Rows with ``pos`` and ``residual``: the linear trend removed where the series varies at all."""
    rows = positioned(panel)
    stats = base_stats(rows) if stats is None else stats
    rows = attach(rows, stats.select(KEY, "std", "slope", "intercept"), KEY, "pos")
    level = F.col("slope") * F.col("pos") + F.col("intercept")
    flat = (F.col("n") < 3) | (F.col("std") <= 1e-12)
    return rows.withColumn("residual", F.when(flat, F.col("target")).otherwise(F.col("target") - level)).drop(
        "std", "slope", "intercept"
    )


# ---------------------------------------------------------------- autocorrelation

NEAR_LAGS = 128

def autocorrelation(rows: DataFrame, lags: Sequence[int], value: str = "residual") -> DataFrame:
    """Pearson correlation of the series with itself ``lag`` rows later: (series, n, lag, acf).

    ``rows`` carries ``pos`` and ``n``; lags no series row can reach give no row.  The pairs are
    summed on the map side, so what is shuffled is one partial sum per (series, lag) and task.
    """
    near = sorted({k for k in lags if k <= NEAR_LAGS})
    far = sorted({k for k in lags if k > NEAR_LAGS})
    past = Window.currentRow - max(near, default=1)
    cols = {"_near": lambda w: F.reverse(F.collect_list(value).over(w.rowsBetween(past, -1)))}
    cols |= {f"_l{k}": (lambda w, k=k: F.lag(value, k).over(w)) for k in far}
    slim = rows.filter(F.col(value).isNotNull()).select(KEY, "pos", "n", value)
    wide = framed(slim, KEY, cols, back=max(lags))
    # lag 0 pairs a row with itself, which gives the spread of the whole series in the same pass
    wide = wide.withColumn("_near", F.concat(F.array(F.col(value)), "_near"))
    pairs = wide.select(KEY, "n", F.col(value).alias("_y"), F.posexplode("_near").alias("lag", "_x"))
    pairs = pairs.filter(F.col("lag").isin([0, *near]))
    if far:
        long_pairs = wide.select(
            KEY, "n", F.col(value).alias("_y"),
            F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"_l{k}").alias("x")) for k in far])).alias("p"),
        )
        long_pairs = long_pairs.filter(F.col("p.x").isNotNull()).select(KEY, "n", "_y", "p.lag", F.col("p.x").alias("_x"))
        pairs = pairs.unionByName(long_pairs)
    sums = pairs.groupBy(KEY, "n", "lag").agg(
        F.stddev_pop("_y").alias("_sy"), F.stddev_pop("_x").alias("_sx"), F.corr("_y", "_x").alias("_r")
    )
    # one row per lag, so this window never sees more rows than there are lags
    whole = F.max(F.when(F.col("lag") == 0, F.col("_sy"))).over(Window.partitionBy(KEY))
    flat = F.least("_sx", "_sy") < 1e-12
    acf = F.when(F.col("_all") >= 1e-12, F.when(flat, 0.0).otherwise(F.col("_r")))
    return sums.withColumn("_all", whole).filter(F.col("lag") > 0).select(KEY, "n", "lag", acf.alias("acf"))


# ---------------------------------------------------------------- frequency

def _workdays_until(day: Column) -> Column:
    """Weekdays from Monday 1970-01-05 up to and excluding ``day`` (days since 1970-01-01)."""
    x = day - 4
    return F.floor(x / 7) * 5 + F.least(F.pmod(x, F.lit(7)), F.lit(5))


def frequency_scores(panel: DataFrame, prefer_business: bool = True) -> DataFrame:
    """Tolerant frequency: the share of steps that match each calendar step, and the best one.

    A strict name is used where every step agrees: constant minutes, hours, days or weeks, month,
    quarter and year starts and ends, business days.
    """
    as_ts = F.col("date").cast("timestamp")
    moments = panel.filter(F.col("date").isNotNull()).select(KEY, as_ts.alias("date")).distinct()
    rows = with_position(moments, KEY, "date")
    rows = framed(rows, KEY, {"_prev": lambda w: F.lag("date").over(w)}, back=1)
    day, prev_day = F.to_date("date"), F.to_date("_prev")
    d = F.datediff(day, F.lit("1970-01-01").cast("date"))
    month_no = lambda c: F.year(c) * 12 + F.month(c)
    quarter_no = lambda c: F.year(c) * 4 + F.quarter(c)
    new_day = prev_day.isNull() | (day != prev_day)
    day_step = F.when(new_day, F.datediff(day, prev_day))
    m_step = month_no("date") - month_no("_prev")
    wd = F.weekday("date")
    micros = F.unix_micros("date") - F.unix_micros("_prev")
    midnight = F.col("date") == F.date_trunc("day", "date")
    bday_step = F.when(wd == 0, day_step == 3).otherwise((day_step == 1) & (wd < 5))
    agg = rows.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((day_step == 1).cast("double")).alias("s_d"),
        F.avg((day_step == 7).cast("double")).alias("s_w"),
        F.avg((m_step == 1).cast("double")).alias("s_m"),
        F.avg((quarter_no("date") - quarter_no("_prev") == 1).cast("double")).alias("s_q"),
        F.avg((F.year("date") - F.year("_prev") == 1).cast("double")).alias("s_y"),
        *[F.sum((new_day & (wd == k)).cast("bigint")).alias(f"_w{k}") for k in range(7)],
        F.sum(new_day.cast("bigint")).alias("_days"),
        F.min(d).alias("_d0"),
        F.max(d).alias("_d1"),
        F.min(micros).alias("_u0"),
        F.max(micros).alias("_u1"),
        F.min(m_step).alias("_m0"),
        F.max(m_step).alias("_m1"),
        F.min(wd).alias("_wd0"),
        F.max(F.month("date")).alias("_month"),
        F.min(F.month("date")).alias("_month0"),
        F.every(midnight).alias("_midnight"),
        F.every((F.dayofmonth("date") == 1) & midnight).alias("_starts"),
        F.every((day == F.last_day(day)) & midnight).alias("_ends"),
        F.every(F.coalesce(bday_step, wd < 5) & midnight).alias("_business"),
    )
    weekday_days = sum((F.col(f"_w{k}") for k in range(5)), F.lit(0))
    workdays = _workdays_until(F.col("_d1") + 1) - _workdays_until(F.col("_d0"))
    coverage = F.when(workdays > 0, weekday_days / workdays).otherwise(0.0)
    top = F.greatest(*[F.col(f"_w{k}") for k in range(7)])
    weekday_name = F.coalesce(*[F.when(F.col(f"_w{k}") == top, F.lit(f"W-{WEEKDAYS[k]}")) for k in range(7)])
    agg = agg.withColumn("weekly_name", weekday_name).withColumn(
        "s_b", F.when(weekday_days / F.col("_days") >= 0.95, coverage).otherwise(0.0) if prefer_business else F.lit(None).cast("double")
    )
    names = [("s_d", F.lit("D")), ("s_b", F.lit("B")), ("s_w", F.col("weekly_name")), ("s_m", F.lit("MS")), ("s_q", F.lit("QS")), ("s_y", F.lit("YS"))]
    best = F.greatest(*[F.col(s) for s, _ in names])
    best_name = F.coalesce(*[F.when(F.col(s) == best, name) for s, name in names])
    return agg.select(
        KEY, "n", *[F.round(s, 6).alias(s) for s, _ in names], "weekly_name",
        F.when(F.col("n") >= 3, best).alias("best_score"),
        F.when((F.col("n") >= 3) & (best >= 0.75), best_name).otherwise("unknown").alias("tolerant_freq"),
        F.when(F.col("n") >= 3, _strict()).alias("strict_freq"),
    ).withColumn("freq", F.coalesce("strict_freq", "tolerant_freq"))


def _strict() -> Column:
    u = F.col("_u0")
    uniform = F.col("_u0") == F.col("_u1")
    months = F.when(F.col("_m0") == F.col("_m1"), F.col("_m0"))
    month_name = F.element_at(F.array(*[F.lit(m) for m in MONTHS]), F.col("_month"))
    quarter_anchor = F.when(F.col("_month") % 3 == 0, "DEC").when(F.col("_month") % 3 == 2, "NOV").otherwise("OCT")
    times = lambda k, name: F.concat(F.when(k > 1, k.cast("string")).otherwise(""), name)
    edge = F.when(F.col("_starts"), "S").when(F.col("_ends"), "E")
    calendar = (
        F.when((months % 12 == 0) & (months > 0), times((months / 12).cast("int"), F.concat(F.lit("Y"), edge, F.lit("-"), month_name)))
        .when((months % 3 == 0) & (months > 0), times((months / 3).cast("int"), F.concat(F.lit("Q"), edge, F.lit("-"), quarter_anchor)))
        .when(months > 0, times(months.cast("int"), F.concat(F.lit("M"), edge)))
    )
    weekday = F.element_at(F.array(*[F.lit(w) for w in WEEKDAYS]), F.col("_wd0") + 1)
    whole = lambda unit: (u / unit).cast("bigint")
    day, hour, minute, second = 86400e6, 3600e6, 60e6, 1e6
    steady = (
        F.when(u % (7 * day) == 0, times(whole(7 * day), F.concat(F.lit("W-"), weekday)))
        .when(u % day == 0, times(whole(day), F.lit("D")))
        .when(u % hour == 0, times(whole(hour), F.lit("h")))
        .when(u % minute == 0, times(whole(minute), F.lit("min")))
        .when(u % second == 0, times(whole(second), F.lit("s")))
    )
    return F.coalesce(
        F.when(edge.isNotNull(), calendar),
        F.when(uniform, steady),
        F.when(F.col("_business"), F.lit("B")),
    )


# fixed values: lags and candidate periods per frequency family, with the default period
PERIODS: dict[str, tuple[list[int], list[int], int]] = {
    "hourly": ([24, 168], [24, 168], 24),
    "quarterly": ([4, 8], [4, 8], 4),
    "yearly": ([1, 2], [1, 2], 1),
    "monthly": ([6, 12, 24], [6, 12, 24], 12),
    "weekly": ([4, 13, 26, 52], [4, 13, 26, 52], 52),
    "daily": ([7, 14, 30, 90, 365], [7, 14, 30, 90, 365], 7),
    "unknown": ([7, 30], [7, 12, 24, 30, 52, 365], 7),
}


def frequency_family(freq: Column) -> Column:
    f = F.lower(F.coalesce(freq, F.lit("unknown")))
    plain = F.regexp_replace(f, r"^\d+", "")
    return (
        F.when(plain == "unknown", "unknown")
        .when(plain.contains("min"), "minutes")
        .when(plain == "h", "hourly")
        .when(plain.startswith("q"), "quarterly")
        .when(plain.startswith("y") | plain.startswith("a"), "yearly")
        .when(plain.startswith("m"), "monthly")
        .when(plain.startswith("w"), "weekly")
        .when(plain.startswith("d") | plain.startswith("b"), "daily")
        .otherwise("unknown")
    )


def period_config(freqs: DataFrame) -> DataFrame:
    """Add lags to check, candidate periods and the default period for each frequency name."""
    family = frequency_family(F.col("freq"))
    every = F.coalesce(F.nullif(F.regexp_extract("freq", r"^(\d+)", 1), F.lit("")).cast("int"), F.lit(1))
    sub_day = lambda per_day: F.greatest(F.lit(1), F.round(per_day / every).cast("int"))
    daily = F.when(F.col("_family") == "minutes", sub_day(F.lit(1440.0))).otherwise(sub_day(F.lit(24.0)))
    weekly = F.when(F.col("_family") == "minutes", sub_day(F.lit(10080.0))).otherwise(sub_day(F.lit(168.0)))
    lags = candidates = default = None
    for name, (l, c, d) in PERIODS.items():
        if name == "hourly":
            continue
        hit = F.col("_family") == name
        la, ca = F.array(*[F.lit(v) for v in l]), F.array(*[F.lit(v) for v in c])
        lags = F.when(hit, la) if lags is None else lags.when(hit, la)
        candidates = F.when(hit, ca) if candidates is None else candidates.when(hit, ca)
        default = F.when(hit, F.lit(d)) if default is None else default.when(hit, F.lit(d))
    short = F.array(daily, weekly)
    return (
        freqs.withColumn("_family", family)
        .withColumn("lags_to_check", lags.otherwise(short))
        .withColumn("candidate_periods", candidates.otherwise(short))
        .withColumn("default_period", default.otherwise(daily))
        .withColumnRenamed("_family", "family")
    )


# ---------------------------------------------------------------- seasonality and lag

ACF_THRESHOLD = 0.5


def seasonality(acf: DataFrame, config: DataFrame) -> DataFrame:
    """Best candidate period with enough autocorrelation, else the nearest usable default.

    ``acf``: (series, n, lag, acf) holding at least the candidate periods and lag 1; ``config``:
    ``period_config`` per series.
    """
    c = config.select(KEY, "candidate_periods", "default_period")
    rows = acf.join(c, KEY)
    longest = F.least(F.floor(F.col("n") / 2), F.array_max("candidate_periods"))
    rows = rows.withColumn("_max", F.when(F.col("n") > 2, longest).otherwise(F.lit(1)))
    usable = F.array_contains("candidate_periods", F.col("lag")) & (F.col("lag") <= F.col("_max"))
    rank = F.array_position("candidate_periods", F.col("lag"))
    strong = usable & (F.col("acf") >= ACF_THRESHOLD)
    s = rows.groupBy(KEY, "n", "default_period", "_max").agg(
        F.min_by("lag", F.when(strong, F.struct(-F.col("acf"), rank))).alias("_best"),
        F.max(F.when(strong, F.col("acf"))).alias("_best_acf"),
        F.min_by("lag", F.when(usable, F.struct(F.abs(F.col("lag") - F.col("default_period")), rank))).alias("_near"),
        F.map_from_entries(F.collect_list(F.struct("lag", "acf"))).alias("_acf"),
    )
    fallback = F.when(F.col("default_period") <= F.col("_max"), F.col("default_period")).otherwise(
        F.coalesce("_near", F.lit(1))
    )
    found = F.col("_best").isNotNull()
    fallback_acf = F.coalesce(F.try_element_at("_acf", fallback), F.lit(0.0))
    return s.select(
        KEY,
        "n",
        found.alias("seasonality_detected"),
        F.when(found, F.col("_best")).otherwise(F.lit(1)).cast("bigint").alias("seasonal_periods"),
        F.when(found, F.col("_best")).otherwise(fallback).cast("bigint").alias("best_period"),
        F.when(found, F.col("_best_acf")).otherwise(fallback_acf).alias("seasonality_acf"),
        F.when(found & (F.col("_best_acf") >= 0.7), "high").when(found, "medium").otherwise("low").alias("confidence"),
        F.col("default_period").cast("bigint").alias("default_period"),
    )


def suggested_lag(acf: DataFrame, season: DataFrame) -> DataFrame:
    """First significant local peak of the autocorrelation, clamped; at least the season if one was found.

    ``acf`` holds lags 1..100.
    """
    n = F.col("n")
    most = F.greatest(F.lit(2), F.least(F.lit(100), F.greatest(F.lit(4), F.floor(n / 4)), n - 1))
    check = F.least(F.floor(n / 3), F.lit(100), most)
    rows = acf.withColumn("_check", check).filter(F.col("lag") <= F.col("_check"))
    # at most 100 lags per series whatever its length
    w = Window.partitionBy(KEY).orderBy("lag")
    rows = rows.withColumn("_prev", F.lag("acf").over(w)).withColumn("_next", F.lead("acf").over(w))
    floor_ = F.greatest(F.lit(0.20), 1.96 / F.sqrt(n))
    peak = (
        (F.col("lag") >= 2)
        & (F.col("lag") < F.col("_check"))
        & (F.col("acf") >= F.col("_prev"))
        & (F.col("acf") >= F.col("_next"))
        & (F.col("acf") >= floor_)
    )
    peaks = rows.groupBy(KEY).agg(F.min(F.when(peak, F.col("lag"))).alias("first_peak"))
    out = season.join(peaks, KEY, "left")
    start = F.when(F.col("seasonality_detected"), F.greatest(F.lit(2), F.col("seasonal_periods"))).otherwise(F.lit(2))
    chosen = F.when(F.col("first_peak").isNull(), start).otherwise(
        F.when(F.col("seasonality_detected"), F.greatest(start, F.col("first_peak"))).otherwise(F.col("first_peak"))
    )
    value = F.when(n <= 2, F.lit(1)).otherwise(F.greatest(F.lit(2), F.least(chosen, most)))
    return out.withColumn("suggested_lag", value.cast("bigint"))


# ---------------------------------------------------------------- skew and outliers

def log_diagnostics(train: DataFrame) -> DataFrame:
    """Is a log transform possible (min > -1) and advisable (strong right skew or wide range)?"""
    y = F.col("target")
    s = train.filter(y.isNotNull()).groupBy(KEY).agg(
        F.count(F.lit(1)).alias("n"),
        F.skewness("target").alias("_g"),
        F.min("target").alias("min_target"),
        F.max("target").alias("max_target"),
    )
    mid = exact_median(train.filter(y > 0), KEY, y, "_median")
    n = F.col("n")
    skew = F.when(n >= 3, F.col("_g") * F.sqrt(n * (n - 1)) / (n - 2)).otherwise(0.0)
    skew = F.when(skew.isNull() | F.isnan(skew), 0.0).otherwise(skew)
    out = s.join(mid, KEY, "left").withColumn("skewness", skew)
    out = out.withColumn("range_ratio", F.when(F.col("_median") > 0, F.col("max_target") / F.col("_median")))
    out = out.withColumn("supported", F.col("min_target") > -1.0).withColumn("strong_skew", F.col("skewness") >= 1.5)
    out = out.withColumn("wide_range", F.coalesce(F.col("range_ratio") >= 100.0, F.lit(False)))
    return out.withColumn("recommended", F.col("supported") & (F.col("strong_skew") | F.col("wide_range"))).drop("_g", "_median")


OUTLIER_Z = 8.0
MAX_REPLACED = 2
RADIUS = 3
EPS = 2.220446049250313e-16


def robust_scale(train: DataFrame) -> DataFrame:
    """Median, MAD and the scaled MAD (never zero) per series; written once, it is read many times."""
    center = cut(exact_median(train, KEY, F.col("target"), "center"))
    off = attach(train.select(KEY, "target", "pos"), center, KEY, "pos")
    mad = exact_median(off, KEY, F.abs(F.col("target") - F.col("center")), "mad")
    scaled = 1.4826 * F.col("mad")
    tiny = EPS * F.greatest(F.lit(1.0), F.abs("center")) * 16.0
    return cut(center.join(mad, KEY).withColumn("scale", F.when(scaled <= EPS, tiny).otherwise(scaled)))


def robust_z(train: DataFrame, scale: DataFrame) -> DataFrame:
    return attach(train, scale, KEY, "pos").withColumn("robust_z", (F.col("target") - F.col("center")) / F.col("scale"))


def replaced_rows(scored: DataFrame) -> DataFrame:
    """The two largest rows above the threshold of each series.

    Spark cuts the ranking to two rows per series and task before it shuffles.
    """
    top = Window.partitionBy(KEY).orderBy(F.desc(F.abs("robust_z")), "pos")
    above = scored.filter((F.col("robust_z") > OUTLIER_Z) & (F.col("n_train") >= 3))
    return above.withColumn("_r", F.row_number().over(top)).filter(F.col("_r") <= MAX_REPLACED).drop("_r")


def outlier_summary(train: DataFrame) -> DataFrame:
    """Per series: candidates, replaced count, strength, fraction and share of variance explained."""
    scored = robust_z(train, robust_scale(train))
    marks = cut(replaced_rows(scored).select(KEY, "pos", "center", F.abs("robust_z").alias("_z")))
    pulled = scored.drop("center").join(marks, [KEY, "pos"], "left")
    s = pulled.groupBy(KEY).agg(
        F.count("target").alias("scanned"),
        F.sum((F.col("robust_z") > OUTLIER_Z).cast("bigint")).alias("candidates"),
        F.count("_z").alias("replaced_count"),
        F.max("_z").alias("_strength"),
        F.max(F.when(F.col("_z").isNotNull(), F.col("pos"))).alias("last_index"),
        F.var_pop("target").alias("_full"),
        F.var_pop(F.coalesce("center", "target")).alias("_ref"),
    )
    impact = F.when(F.col("_full") > 0, F.greatest(F.lit(0.0), (F.col("_full") - F.col("_ref")) / F.col("_full"))).otherwise(0.0)
    return s.select(
        KEY,
        "scanned",
        "candidates",
        "replaced_count",
        F.coalesce(F.try_divide("replaced_count", "scanned"), F.lit(0.0)).alias("outlier_fraction"),
        F.coalesce("_strength", F.lit(0.0)).alias("outlier_strength"),
        F.when(F.col("replaced_count") > 0, F.round(impact, 6)).otherwise(0.0).alias("variance_impact"),
        "last_index",
    )


def outlier_replacements(train: DataFrame) -> DataFrame:
    """(series, pos, original, replacement) of the replaced rows: neighbour median, else last clean value.

    At most two rows per series are replaced, so their neighbours are looked up by position.
    """
    marks = cut(replaced_rows(robust_z(train, robust_scale(train))).select(KEY, "pos", "target"))
    near = marks.select(KEY, F.col("pos").alias("at"), F.explode(F.sequence(F.col("pos") - RADIUS, F.col("pos") + RADIUS)).alias("pos"))
    others = train.select(KEY, "pos", "target").join(marks.select(KEY, "pos"), [KEY, "pos"], "left_anti")
    around = near.join(others, [KEY, "pos"]).groupBy(KEY, F.col("at").alias("pos")).agg(F.percentile("target", 0.5).alias("_near"))
    found = marks.join(around, [KEY, "pos"], "left")
    # only a marked row without any clean neighbour needs the long way
    lone = found.filter(F.col("_near").isNull()).select(KEY, F.col("pos").alias("at"))
    earlier = others.join(lone, KEY).filter(F.col("pos") < F.col("at"))
    prior = earlier.groupBy(KEY, F.col("at").alias("pos")).agg(F.max_by("target", "pos").alias("_prior"))
    whole = exact_median(others.join(lone.select(KEY).distinct(), KEY, "left_semi"), KEY, F.col("target"), "_all")
    return found.join(prior, [KEY, "pos"], "left").join(whole, KEY, "left").select(
        KEY, "pos", F.col("target").alias("original"), F.coalesce("_near", "_prior", "_all", "target").alias("replacement")
    )


def replace_outliers(train: DataFrame) -> DataFrame:
    """Training rows with the marked outliers replaced; the row count never changes."""
    fixes = outlier_replacements(train).select(KEY, "pos", "replacement")
    return train.join(fixes, [KEY, "pos"], "left").withColumn("target", F.coalesce("replacement", "target")).drop("replacement")
