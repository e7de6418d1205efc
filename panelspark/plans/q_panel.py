"""Panel diagnostics, splits, features and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import diagnostics as D
from ..operators import features as E
from ..operators import resample as R
from ..operators import split as J
from ..operators.ordered import running, with_position
from .panels import DAILY, HOURLY, MONTHLY, PANELS, POS, SPLIT, WEEKLY, daily, hourly, monthly, weekly, with_sql
from .registry import query

SPEC = J.SplitSpec(0.7, 0.2, 0.1, 3)


def rounded(df, names, digits=6):
    for c in names:
        df = df.withColumn(c, F.round(c, digits) + F.lit(0.0))
    return df


def train_of(panel):
    return J.chronological(panel, SPEC).filter("split = 'train'").withColumn("n", F.col("n_train"))


TRAIN = "train AS (SELECT * FROM parts WHERE split = 'train' AND n_train >= 30 AND n_val >= 3 AND n_test >= 3)"

# ------------------------------------------------------------------ splits


@query(
    "split_sizes",
    with_sql(MONTHLY, tail="""
    SELECT series_id, n, n - v - t AS n_train, v AS n_val, t AS n_test,
      CASE WHEN n < 3 THEN 'fewer_than_three_observations' WHEN v < 3 OR t < 3 THEN 'no_complete_window'
           WHEN n - v - t < 30 THEN 'training_too_short' END AS rejected
    FROM (SELECT series_id, n, CAST(floor(n * 2e-1) AS BIGINT) // 3 * 3 AS v, CAST(floor(n * 1e-1) AS BIGINT) // 3 * 3 AS t
          FROM (SELECT series_id, count(*) AS n FROM panel GROUP BY 1))"""),
)
def split_sizes(spark, sf):
    return J.size_table(monthly(spark, sf), SPEC)


@query(
    "split_rejections_daily_events",
    """SELECT series_id, n, n - v - t AS n_train, v AS n_val, t AS n_test,
      CASE WHEN n < 3 THEN 'fewer_than_three_observations' WHEN v < 3 OR t < 3 THEN 'no_complete_window'
           WHEN n - v - t < 30 THEN 'training_too_short' END AS rejected
    FROM (SELECT series_id, n, CAST(floor(n * 2e-1) AS BIGINT) // 3 * 3 AS v, CAST(floor(n * 1e-1) AS BIGINT) // 3 * 3 AS t
          FROM (SELECT event_type AS series_id, count(DISTINCT CAST(ts AS DATE)) AS n FROM events GROUP BY 1))""",
)
def split_rejections(spark, sf):
    panel = hourly(spark, sf).select("series_id", F.to_date("date").alias("date")).distinct()
    return J.size_table(panel, SPEC)


META = """SELECT series_id, split, count(*) AS rows, round(count(*) / max(n)::DOUBLE, 6) AS share, min(date) AS first_date,
  max(date) AS last_date, CASE WHEN split <> 'train' THEN count(*) // 3 END AS windows
  FROM parts WHERE n_train >= 30 AND n_val >= 3 AND n_test >= 3 GROUP BY 1, 2"""

for _name in ("monthly", "weekly", "daily"):
    _panel, _sql = PANELS[_name]
    query(f"split_metadata_{_name}", with_sql(_sql, POS, SPLIT, tail=META))(
        lambda spark, sf, _panel=_panel: J.split_metadata(J.chronological(_panel(spark, sf), SPEC), SPEC)
    )


@query(
    "one_shot_holdout",
    with_sql(MONTHLY, POS, SPLIT, tail="""SELECT series_id, date, round(target, 6) AS target FROM parts
      WHERE split = 'test' AND n_train >= 30 AND n_val >= 3 AND n_test >= 3 AND series_id < '4' AND series_id <> '1-URGENT'"""),
)
def one_shot_holdout(spark, sf):
    parts = J.chronological(monthly(spark, sf), SPEC)
    ids = parts.select("series_id").distinct()
    winners = ids.withColumn("frozen", F.col("series_id") < "4")
    scored = ids.filter(F.col("series_id") == "1-URGENT")
    return J.open_holdout(parts, winners, scored).select("series_id", "date", F.round("target", 6).alias("target"))


@query(
    "early_stopping_suffix",
    with_sql(DAILY, POS, SPLIT, TRAIN, tail="""SELECT series_id, inner_split, count(*) AS rows, min(date) AS first_date FROM (
      SELECT *, CASE WHEN pos >= n_train - CASE WHEN n_train < 7 THEN 0 ELSE least(greatest(5, ceil(n_train * 2e-1)), n_train - 1) END
        THEN 'early_stopping' ELSE 'fit' END AS inner_split FROM train) GROUP BY 1, 2"""),
)
def early_stopping_suffix(spark, sf):
    out = J.suffix_split(train_of(daily(spark, sf)))
    return out.groupBy("series_id", "inner_split").agg(F.count(F.lit(1)).alias("rows"), F.min("date").alias("first_date"))


@query(
    "evaluation_partition_contract",
    """WITH raw AS (
      SELECT o_orderpriority AS series_id, o_orderkey AS arrival,
        CASE WHEN o_orderstatus = 'P' AND o_orderkey % 97 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS date,
        CASE WHEN o_orderkey % 101 = 0 THEN NULL ELSE o_totalprice END AS target FROM orders),
    seen AS (SELECT *, lag(date) OVER (PARTITION BY series_id ORDER BY arrival) AS prev FROM raw),
    f AS (SELECT series_id, count(*) FILTER (date IS NULL) AS bad_dates, count(*) FILTER (target IS NULL) AS missing_targets,
      count(*) FILTER (date < prev) AS backward_steps, count(date) - count(DISTINCT date) AS duplicate_dates FROM seen GROUP BY 1)
    SELECT *, CASE WHEN bad_dates > 0 THEN 'invalid timestamps' WHEN missing_targets > 0 THEN 'missing targets'
      WHEN backward_steps > 0 THEN 'not chronological' WHEN duplicate_dates > 0 THEN 'duplicate timestamps' ELSE 'ok' END AS verdict FROM f""",
)
def evaluation_partition_contract(spark, sf):
    rows = spark.read.parquet(f"{sf}/orders.parquet").select(
        F.col("o_orderpriority").alias("series_id"),
        F.col("o_orderkey").alias("arrival"),
        F.when((F.col("o_orderstatus") == "P") & (F.col("o_orderkey") % 97 == 0), None).otherwise(F.to_date("o_orderdate")).alias("date"),
        F.when(F.col("o_orderkey") % 101 == 0, None).otherwise(F.col("o_totalprice")).alias("target"),
    )
    return J.partition_problems(rows)


@query(
    "target_unchanged_audit",
    with_sql(DAILY, POS, SPLIT, tail="""SELECT series_id, count(*) FILTER (split = 'test') AS removed, 0::BIGINT AS added,
      count(*) FILTER (split <> 'test' AND month(date) = 12) AS modified FROM parts
      WHERE n_train >= 30 AND n_val >= 3 AND n_test >= 3 GROUP BY 1"""),
)
def target_unchanged_audit(spark, sf):
    parts = J.chronological(daily(spark, sf), SPEC)
    touched = J.search_rows(parts).withColumn(
        "target", F.when(F.month("date") == 12, F.col("target") + 1).otherwise(F.col("target"))
    )
    return J.changed_targets(parts, touched)


# ------------------------------------------------------------------ moments and trend

SUMMARY = """SELECT p.series_id, count(*) AS n_obs, round(avg(target), 6) AS mean, round(stddev_pop(target), 6) AS std,
  round(min(target), 6) AS min, round(max(target), 6) AS max, count(*) FILTER (target IS NULL) AS n_missing,
  CASE WHEN count(target) > 2 THEN stddev_pop(d) < stddev_pop(target) * 5e-1 END AS stationary
  FROM (SELECT *, target - lag(target) OVER (PARTITION BY series_id ORDER BY date) AS d FROM panel) p GROUP BY 1"""
BASE = """SELECT series_id, count(*) AS n_obs, avg(target) AS mean, stddev_pop(target) AS std, min(target) AS min, max(target) AS max,
  regr_slope(target, pos) AS slope, regr_intercept(target, pos) AS intercept,
  abs(regr_slope(target, pos)) * count(*) / (stddev_pop(target) + 1e-6) AS trend_strength,
  stddev_pop(target) / (avg(abs(target)) + 1e-6) AS volatility_cv,
  stddev_pop(d) / (stddev_pop(target) + 1e-6) AS delta_noise
  FROM (SELECT *, target - lag(target) OVER (PARTITION BY series_id ORDER BY pos) AS d FROM {rows}) GROUP BY 1"""
BASE_COLS = ["mean", "std", "min", "max", "slope", "intercept", "trend_strength", "volatility_cv", "delta_noise"]

for _name in PANELS:
    _panel, _sql = PANELS[_name]
    query(f"data_summary_{_name}", with_sql(_sql, tail=SUMMARY))(
        lambda spark, sf, _panel=_panel: rounded(D.data_summary(_panel(spark, sf)), ["mean", "std", "min", "max"])
    )
    query(
        f"base_stats_trend_{_name}",
        with_sql(_sql, POS, f"base AS ({BASE.format(rows='pos')})",
                 tail="SELECT series_id, n_obs, " + ", ".join(f"round({c}, 6) AS {c}" for c in BASE_COLS) + " FROM base"),
    )(lambda spark, sf, _panel=_panel: rounded(D.base_stats(_panel(spark, sf)), BASE_COLS))


@query(
    "dataset_signature",
    with_sql(WEEKLY, tail="""SELECT series_id, count(*) AS n_obs, round(avg(target), 6) AS mean, round(stddev_samp(target), 6) AS std,
      min(date) AS first_date, max(date) AS last_date FROM panel GROUP BY 1"""),
)
def dataset_signature(spark, sf):
    return rounded(D.dataset_signature(weekly(spark, sf)), ["mean", "std"])


# ------------------------------------------------------------------ autocorrelation, seasonality, lag

RESID = """st AS (SELECT series_id, stddev_pop(target) AS sd, regr_slope(target, pos) AS b, regr_intercept(target, pos) AS a FROM train GROUP BY 1),
res AS (SELECT t.series_id, t.pos, count(*) OVER (PARTITION BY t.series_id) AS n,
  CASE WHEN n_train < 3 OR sd <= 1e-12 THEN target ELSE target - (b * t.pos + a) END AS r FROM train t JOIN st USING (series_id))"""


def _acf_sql(lags: str) -> str:
    return f"""lags AS (SELECT unnest({lags}) AS lag),
acfs AS (SELECT series_id, n, lag, CASE WHEN lag < n AND sall >= 1e-12 THEN CASE WHEN least(sx, sy) < 1e-12 THEN 0 ELSE c END END AS acf
  FROM (SELECT a.series_id, a.n, lag, stddev_pop(a.r) AS sy, stddev_pop(b.r) AS sx, corr(a.r, b.r) AS c
        FROM res a CROSS JOIN lags JOIN res b ON b.series_id = a.series_id AND b.pos = a.pos - lag GROUP BY 1, 2, 3)
  JOIN (SELECT series_id, stddev_pop(r) AS sall FROM res GROUP BY 1) USING (series_id))"""


def _train_acf(panel, lags):
    train = train_of(panel).select("series_id", "date", "target", "pos", "n")
    return D.autocorrelation(D.detrended(train), lags)


for _name, _lags in (("monthly", [6, 12, 24]), ("weekly", [4, 13, 26, 52]), ("daily", [7, 14, 30, 90, 365])):
    _panel, _sql = PANELS[_name]
    query(
        f"autocorrelation_{_name}",
        with_sql(_sql, POS, SPLIT, TRAIN, RESID, _acf_sql(str(_lags)),
                 tail="SELECT series_id, lag::BIGINT AS lag, round(acf, 6) AS acf FROM acfs WHERE lag < n"),
    )(
        lambda spark, sf, _panel=_panel, _lags=_lags: _train_acf(_panel(spark, sf), _lags)
        .filter(F.col("lag") < F.col("n"))
        .select("series_id", F.col("lag").cast("bigint").alias("lag"), (F.round("acf", 6) + F.lit(0.0)).alias("acf"))
    )

# per frequency name: candidate periods and default of the panels used here
SEASON = """cand AS (SELECT a.*, list_position({cands}, a.lag) AS rk, {default} AS dflt,
    CASE WHEN n > 2 THEN least(n // 2, {longest}) ELSE 1 END AS mx FROM acfs a),
season AS (SELECT series_id, max(n) AS n, max(dflt)::BIGINT AS default_period,
    arg_min(lag, (-acf, rk)) FILTER (rk IS NOT NULL AND lag <= mx AND acf >= 5e-1) AS best,
    max(acf) FILTER (rk IS NOT NULL AND lag <= mx AND acf >= 5e-1) AS best_acf,
    CASE WHEN max(dflt) <= max(mx) THEN max(dflt)
         ELSE coalesce(arg_min(lag, (abs(lag - dflt), rk)) FILTER (rk IS NOT NULL AND lag <= mx), 1) END AS fb
  FROM cand GROUP BY 1),
found AS (SELECT s.series_id, s.n, best IS NOT NULL AS seasonality_detected, coalesce(best, 1)::BIGINT AS seasonal_periods,
    coalesce(best, fb)::BIGINT AS best_period, default_period, coalesce(best_acf, acf, 0) AS seasonality_acf,
    CASE WHEN best_acf >= 7e-1 THEN 'high' WHEN best IS NOT NULL THEN 'medium' ELSE 'low' END AS confidence
  FROM season s LEFT JOIN acfs a ON a.series_id = s.series_id AND a.lag = fb)"""
LAGPICK = """pk AS (SELECT *, lag(acf) OVER w AS pv, lead(acf) OVER w AS nx FROM (
    SELECT *, least(n // 3, 100, greatest(2, least(100, greatest(4, n // 4), n - 1))) AS chk FROM acfs) WHERE lag <= chk
    WINDOW w AS (PARTITION BY series_id ORDER BY lag)),
fp AS (SELECT series_id, min(lag) FILTER (lag >= 2 AND lag < chk AND acf >= pv AND acf >= nx AND acf >= greatest(2e-1, 196e-2 / sqrt(n))) AS first_peak
  FROM pk GROUP BY 1)"""
LAGOUT = """SELECT series_id, seasonality_detected, seasonal_periods, best_period, default_period, round(seasonality_acf, 6) AS seasonality_acf, confidence,
  first_peak::BIGINT AS first_peak, CASE WHEN n <= 2 THEN 1 ELSE greatest(2, least(CASE
    WHEN first_peak IS NULL THEN CASE WHEN seasonality_detected THEN greatest(2, seasonal_periods) ELSE 2 END
    WHEN seasonality_detected THEN greatest(2, seasonal_periods, first_peak) ELSE first_peak END,
    greatest(2, least(100, greatest(4, n // 4), n - 1)))) END::BIGINT AS suggested_lag
  FROM found LEFT JOIN fp USING (series_id)"""


def season_and_lag(panel, family):
    _, candidates, default = D.PERIODS[family]
    acf = _train_acf(panel, sorted({*range(1, 101), *candidates}))
    config = acf.select("series_id").distinct().select(
        "series_id", F.array(*[F.lit(c) for c in candidates]).alias("candidate_periods"), F.lit(default).alias("default_period")
    )
    return D.suggested_lag(acf, D.seasonality(acf, config))


for _name, _family in (("monthly", "monthly"), ("weekly", "weekly"), ("daily", "daily")):
    _panel, _sql = PANELS[_name]
    _c = D.PERIODS[_family][1]
    query(
        f"seasonality_and_lag_{_name}",
        with_sql(_sql, POS, SPLIT, TRAIN, RESID, _acf_sql(str(sorted({*range(1, 101), *_c}))),
                 SEASON.format(cands=_c, default=D.PERIODS[_family][2], longest=max(_c)), LAGPICK, tail=LAGOUT),
    )(
        lambda spark, sf, _panel=_panel, _family=_family: rounded(
            season_and_lag(_panel(spark, sf), _family).drop("n"), ["seasonality_acf"]
        ).withColumn("first_peak", F.col("first_peak").cast("bigint"))
    )

# ------------------------------------------------------------------ frequency

FREQ = """m AS (SELECT DISTINCT series_id, CAST(date AS TIMESTAMP) AS date FROM panel),
p AS (SELECT *, lag(date) OVER (PARTITION BY series_id ORDER BY date) AS prev FROM m),
d AS (SELECT *, date::DATE - lag(date::DATE) OVER (PARTITION BY series_id ORDER BY date) AS ds FROM (SELECT DISTINCT series_id, date::DATE AS date FROM m)),
days AS (SELECT series_id, avg((ds = 1)::INT) AS s_d, avg((ds = 7)::INT) AS s_w, count(*) AS nd,
   count(*) FILTER (isodow(date) <= 5) AS wdn, min(date) AS d0, max(date) AS d1 FROM d GROUP BY 1),
wk AS (SELECT series_id, arg_min(w, (-c, w)) AS w FROM (SELECT series_id, isodow(date) - 1 AS w, count(*) AS c FROM d GROUP BY 1, 2) GROUP BY 1),
cov AS (SELECT series_id, CASE WHEN wdn / nd::DOUBLE >= 95e-2 THEN wdn / nullif((SELECT count(*) FROM range(days.d0::TIMESTAMP, days.d1::TIMESTAMP + INTERVAL 1 DAY, INTERVAL 1 DAY) r(x) WHERE isodow(x) <= 5), 0)::DOUBLE ELSE 0 END AS s_b FROM days),
ms AS (SELECT series_id, count(*) AS n,
   avg(((year(date) * 12 + month(date)) - (year(prev) * 12 + month(prev)) = 1)::INT) AS s_m,
   avg(((year(date) * 4 + quarter(date)) - (year(prev) * 4 + quarter(prev)) = 1)::INT) AS s_q,
   avg((year(date) - year(prev) = 1)::INT) AS s_y FROM p WHERE true GROUP BY 1),
sc AS (SELECT * FROM ms JOIN days USING (series_id) JOIN wk USING (series_id) JOIN cov USING (series_id)),
best AS (SELECT *, 'W-' || list_extract(['MON','TUE','WED','THU','FRI','SAT','SUN'], (w + 1)::INT) AS weekly_name,
   greatest(s_d, coalesce(s_b, 0), s_w, s_m, s_q, s_y) AS b FROM sc)"""
FREQOUT = """SELECT series_id, n, round(s_d, 6) AS s_d, round(coalesce(s_b, 0), 6) AS s_b, round(s_w, 6) AS s_w, round(s_m, 6) AS s_m, round(s_q, 6) AS s_q,
  round(s_y, 6) AS s_y, weekly_name, round(b, 6) AS best_score, CASE WHEN n < 3 OR b < 75e-2 THEN 'unknown'
   WHEN s_d = b THEN 'D' WHEN s_b = b THEN 'B' WHEN s_w = b THEN weekly_name WHEN s_m = b THEN 'MS' WHEN s_q = b THEN 'QS' ELSE 'YS' END AS tolerant_freq
  FROM best"""

for _name in PANELS:
    _panel, _sql = PANELS[_name]
    query(f"frequency_scores_{_name}", with_sql(_sql, FREQ, tail=FREQOUT))(
        lambda spark, sf, _panel=_panel: rounded(D.frequency_scores(_panel(spark, sf)), ["best_score"]).drop("strict_freq", "freq")
    )


def _all_panels(spark, sf):
    out = None
    for name, (fn, _) in PANELS.items():
        one = fn(spark, sf).select(F.concat(F.lit(f"{name}/"), "series_id").alias("series_id"), F.col("date").cast("timestamp").alias("date"), "target")
        out = one if out is None else out.unionByName(one)
    return out


ALL_PANELS = [*[_sql.replace("panel AS (", f"{_name}_panel AS (", 1) for _name, (_, _sql) in PANELS.items()],
              "panel AS (" + " UNION ALL ".join(f"SELECT '{_name}/' || series_id AS series_id, CAST(date AS TIMESTAMP) AS date, target FROM {_name}_panel" for _name in PANELS) + ")"]
# strict names of constant steps and month starts; these panels have neither month ends nor working days alone
STEADY = """moved AS (SELECT *, epoch(date)::BIGINT - epoch(lag(date) OVER w)::BIGINT AS u, (year(date) * 12 + month(date)) - lag(year(date) * 12 + month(date)) OVER w AS mo FROM (SELECT DISTINCT series_id, date FROM panel) WINDOW w AS (PARTITION BY series_id ORDER BY date)),
std AS (SELECT series_id, min(u) AS u0, max(u) AS u1, min(mo) AS m0, max(mo) AS m1, bool_and(day(date) = 1 AND date = date_trunc('day', date)) AS starts, min(isodow(date)) AS wd FROM moved GROUP BY 1),
nmd AS (SELECT o.series_id, tolerant_freq, CASE WHEN n < 3 THEN NULL WHEN starts AND m0 = m1 AND m0 = 1 THEN 'MS' WHEN u0 <> u1 THEN NULL
    WHEN u0 % 604800 = 0 THEN CASE WHEN u0 > 604800 THEN (u0 // 604800)::VARCHAR ELSE '' END || 'W-' || list_extract(['MON','TUE','WED','THU','FRI','SAT','SUN'], wd::INT)
    WHEN u0 % 86400 = 0 THEN CASE WHEN u0 > 86400 THEN (u0 // 86400)::VARCHAR ELSE '' END || 'D'
    WHEN u0 % 3600 = 0 THEN CASE WHEN u0 > 3600 THEN (u0 // 3600)::VARCHAR ELSE '' END || 'h' END AS strict_freq FROM ({scores}) o JOIN std USING (series_id)),
nam AS (SELECT *, coalesce(strict_freq, tolerant_freq) AS freq, coalesce(try_cast(nullif(regexp_extract(coalesce(strict_freq, tolerant_freq), '^[0-9]+'), '') AS INT), 1) AS every FROM nmd),
fam AS (SELECT *, CASE WHEN freq = 'unknown' THEN 'unknown' WHEN freq LIKE '%h' THEN 'hourly' WHEN freq LIKE 'QS%' THEN 'quarterly' WHEN freq LIKE 'YS%' THEN 'yearly' WHEN freq LIKE 'M%' THEN 'monthly' WHEN freq LIKE '%W-%' THEN 'weekly' ELSE 'daily' END AS family FROM nam)"""
PERIOD_TABLE = """SELECT series_id, freq, strict_freq, tolerant_freq, family,
  CASE family WHEN 'hourly' THEN greatest(1, round(24e0 / every)::INT) || ',' || greatest(1, round(168e0 / every)::INT) WHEN 'quarterly' THEN '4,8' WHEN 'yearly' THEN '1,2' WHEN 'monthly' THEN '6,12,24'
    WHEN 'weekly' THEN '4,13,26,52' WHEN 'daily' THEN '7,14,30,90,365' ELSE '7,30' END AS lags_to_check,
  CASE family WHEN 'hourly' THEN greatest(1, round(24e0 / every)::INT) || ',' || greatest(1, round(168e0 / every)::INT) WHEN 'quarterly' THEN '4,8' WHEN 'yearly' THEN '1,2' WHEN 'monthly' THEN '6,12,24'
    WHEN 'weekly' THEN '4,13,26,52' WHEN 'daily' THEN '7,14,30,90,365' ELSE '7,12,24,30,52,365' END AS candidate_periods,
  (CASE family WHEN 'hourly' THEN greatest(1, round(24e0 / every)::INT) WHEN 'quarterly' THEN 4 WHEN 'yearly' THEN 1 WHEN 'monthly' THEN 12 WHEN 'weekly' THEN 52 ELSE 7 END)::INT AS default_period FROM fam"""


@query("frequency_periods", with_sql(*ALL_PANELS, FREQ, STEADY.format(scores=FREQOUT), tail=PERIOD_TABLE))
def frequency_periods(spark, sf):
    freqs = D.frequency_scores(_all_panels(spark, sf)).select("series_id", "freq", "strict_freq", "tolerant_freq")
    out = D.period_config(freqs)
    return out.withColumn("lags_to_check", F.array_join("lags_to_check", ",")).withColumn(
        "candidate_periods", F.array_join("candidate_periods", ",")
    )


# ------------------------------------------------------------------ skew and outliers

for _name in ("hourly", "daily"):
    _panel, _sql = PANELS[_name]
    query(
        f"log_transform_diagnostics_{_name}",
        with_sql(_sql, POS, SPLIT, TRAIN, tail="""SELECT series_id, n, round(skewness, 6) AS skewness, round(min_target, 6) AS min_target,
          round(max_target, 6) AS max_target, round(range_ratio, 6) AS range_ratio, min_target > -1 AS supported, skewness >= 15e-1 AS strong_skew,
          coalesce(range_ratio >= 100, false) AS wide_range,
          min_target > -1 AND (skewness >= 15e-1 OR coalesce(range_ratio >= 100, false)) AS recommended
          FROM (SELECT series_id, count(*) AS n, coalesce(skewness(target), 0) AS skewness, min(target) AS min_target, max(target) AS max_target,
            max(target) / median(target) FILTER (target > 0) AS range_ratio FROM train GROUP BY 1)"""),
    )(
        lambda spark, sf, _panel=_panel: rounded(
            D.log_diagnostics(train_of(_panel(spark, sf))), ["skewness", "min_target", "max_target", "range_ratio"]
        )
    )

OUT = """c AS (SELECT series_id, median(target) AS center FROM train GROUP BY 1),
md AS (SELECT series_id, any_value(center) AS center, median(abs(target - center)) AS mad FROM train JOIN c USING (series_id) GROUP BY 1),
sc AS (SELECT series_id, center, CASE WHEN 14826e-4 * mad <= 2.220446049250313e-16 THEN 2.220446049250313e-16 * greatest(1, abs(center)) * 16 ELSE 14826e-4 * mad END AS scale FROM md),
z AS (SELECT t.*, center, (target - center) / scale AS z FROM train t JOIN sc USING (series_id)),
ab AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY abs(z) DESC, pos) <= 2 AS hit FROM z WHERE z > 8),
fl AS (SELECT z.*, coalesce(ab.hit, false) AS hit, ab.hit IS NOT NULL AS above FROM z LEFT JOIN ab USING (series_id, pos))"""
# spikes put where none occur, so that the rule has work on every panel
SPIKED = "spiked AS (SELECT series_id, date, CASE WHEN day(date) = 13 AND month(date) IN (4, 9) THEN target * 40 ELSE target END AS target FROM panel)"


def _spiked(panel):
    hit = (F.dayofmonth("date") == 13) & F.month("date").isin(4, 9)
    return panel.withColumn("target", F.when(hit, F.col("target") * 40).otherwise(F.col("target")))


SPIKE_POS = POS.replace("FROM panel", "FROM spiked")


@query(
    "outlier_summary",
    with_sql(DAILY, SPIKED, SPIKE_POS, SPLIT, TRAIN, OUT, tail="""
    SELECT series_id, count(*) AS scanned, count(*) FILTER (above) AS candidates, count(*) FILTER (hit) AS replaced_count,
      round(count(*) FILTER (hit) / count(*)::DOUBLE, 6) AS outlier_fraction, round(coalesce(max(abs(z)) FILTER (hit), 0), 6) AS outlier_strength,
      CASE WHEN count(*) FILTER (hit) > 0 THEN round(greatest(0, (var_pop(target) - var_pop(CASE WHEN hit THEN center ELSE target END)) / var_pop(target)), 6) ELSE 0 END AS variance_impact,
      max(pos) FILTER (hit) AS last_index FROM fl GROUP BY 1"""),
)
def outlier_summary(spark, sf):
    return rounded(D.outlier_summary(train_of(_spiked(daily(spark, sf)))), ["outlier_fraction", "outlier_strength", "variance_impact"])


@query(
    "outlier_replacement",
    with_sql(DAILY, SPIKED, SPIKE_POS, SPLIT, TRAIN, OUT, tail="""
    SELECT a.series_id, a.pos, round(any_value(a.target), 8) AS original,
      round(coalesce(median(b.target) FILTER (abs(b.pos - a.pos) <= 3), arg_max(b.target, b.pos) FILTER (b.pos < a.pos), median(b.target)), 8) AS replacement
    FROM fl a JOIN fl b ON b.series_id = a.series_id AND NOT b.hit WHERE a.hit GROUP BY 1, 2"""),
)
def outlier_replacement(spark, sf):
    return rounded(D.outlier_replacements(train_of(_spiked(daily(spark, sf)))), ["original", "replacement"], 8)


# ------------------------------------------------------------------ resampling

@query(
    "resample_monthly_interpolated",
    with_sql(MONTHLY, """g AS (SELECT series_id, CAST(unnest(generate_series(min(date)::TIMESTAMP, max(date)::TIMESTAMP, INTERVAL 1 MONTH)) AS DATE) AS date
        FROM panel GROUP BY 1),
      j AS (SELECT g.*, target, row_number() OVER (PARTITION BY series_id ORDER BY date) - 1 AS pos FROM g LEFT JOIN panel USING (series_id, date)
        -- every July is taken out, so that gaps exist at any size
      ), h AS (SELECT series_id, date, pos, CASE WHEN month(date) = 7 THEN NULL ELSE target END AS target FROM j),
      w AS (SELECT *, last_value(CASE WHEN target IS NOT NULL THEN pos END IGNORE NULLS) OVER a AS p0, last_value(target IGNORE NULLS) OVER a AS y0,
        first_value(CASE WHEN target IS NOT NULL THEN pos END IGNORE NULLS) OVER b AS p1, first_value(target IGNORE NULLS) OVER b AS y1 FROM h
        WINDOW a AS (PARTITION BY series_id ORDER BY pos ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY series_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""",
      tail="""SELECT series_id, date, pos, target IS NULL AS was_missing,
        round(coalesce(target, y0 + (y1 - y0) * (pos - p0) / (p1 - p0), y0, y1), 10) AS target FROM w"""),
)
def resample_monthly_interpolated(spark, sf):
    full = R.resample(monthly(spark, sf), "MS")
    return rounded(R.interpolate(full.withColumn("target", F.when(F.month("date") != 7, F.col("target")))), ["target"], 10)


RESAMPLED = {
    "D": ("date", "g.b::DATE", "INTERVAL 1 DAY"),
    "W-SUN": ("date + CAST((7 - isodow(date)) AS INT)", "g.b::DATE", "INTERVAL 7 DAY"),
    "MS": ("date_trunc('month', date)", "g.b::DATE", "INTERVAL 1 MONTH"),
    "QS": ("date_trunc('quarter', date)", "g.b::DATE", "INTERVAL 3 MONTH"),
    "YS": ("date_trunc('year', date)", "g.b::DATE", "INTERVAL 1 YEAR"),
}
for _freq, (_expr, _label, _step) in RESAMPLED.items():
    for _agg in ("mean", "sum", "median"):
        if _agg != "mean" and _freq not in ("MS", "W-SUN"):
            continue
        _val = {"mean": "round(target, 8)", "median": "round(target, 8)", "sum": "round(coalesce(target, 0), 8)"}[_agg]
        query(
            f"resample_{_freq.lower().replace('-', '_')}_{_agg}",
            with_sql(DAILY, f"v AS (SELECT series_id, CAST({_expr} AS TIMESTAMP) AS b, {'avg' if _agg == 'mean' else _agg}(target) AS target FROM panel GROUP BY 1, 2)",
                     f"g AS (SELECT series_id, unnest(generate_series(min(b), max(b), {_step})) AS b FROM v GROUP BY 1)",
                     tail=f"SELECT series_id, {_label} AS date, {_val} AS target FROM g LEFT JOIN v USING (series_id, b)"),
        )(
            lambda spark, sf, _freq=_freq, _agg=_agg: rounded(R.resample(daily(spark, sf), _freq, _agg), ["target"], 8)
        )


@query(
    "resample_hourly_mean",
    with_sql(HOURLY, "g AS (SELECT series_id, unnest(generate_series(min(date), max(date), INTERVAL 1 HOUR)) AS date FROM panel GROUP BY 1)",
             tail="SELECT series_id, strftime(date, '%Y-%m-%d %H:%M') AS date, round(target, 6) AS target FROM g LEFT JOIN panel USING (series_id, date)"),
)
def resample_hourly_mean(spark, sf):
    return rounded(R.resample(hourly(spark, sf), "h"), ["target"]).withColumn("date", F.date_format("date", "yyyy-MM-dd HH:mm"))


# ------------------------------------------------------------------ features

LAGS, WINDOWS = [1, 7, 30], [3, 14]
FEATURES = [f"lag_{k}" for k in LAGS] + [f"rolling_{f}_{w}" for w in WINDOWS for f in E.ROLLING]


def _rolling_sql():
    out = [f"round(lag(target, {k}) OVER s, 8) AS lag_{k}" for k in LAGS]
    for w in WINDOWS:
        for f, fn in (("mean", "avg"), ("std", "stddev_pop"), ("min", "min"), ("max", "max")):
            out.append(f"round(CASE WHEN pos >= {w} THEN {fn}(target) OVER (s ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING) END, {5 if f == 'std' else 8}) AS rolling_{f}_{w}")
    return ", ".join(out)


@query(
    "lag_rolling_features",
    with_sql(DAILY, POS, f"f AS (SELECT series_id, date, pos, {_rolling_sql()} FROM pos WINDOW s AS (PARTITION BY series_id ORDER BY pos))",
             tail="SELECT * FROM f WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in FEATURES)),
)
def lag_rolling_features(spark, sf):
    rows = E.add_past_features(with_position(daily(spark, sf), "series_id", "date", n=None), LAGS, WINDOWS, E.ROLLING)
    out = E.complete(rows, FEATURES).drop("target")
    return rounded(rounded(out, [c for c in FEATURES if "std" not in c], 8), [c for c in FEATURES if "std" in c], 5)


@query(
    "calendar_features",
    with_sql(DAILY, POS, tail="""SELECT series_id, date, round(sin(2 * pi() * month(date) / 12), 6) + 0 AS month_sin, round(cos(2 * pi() * month(date) / 12), 6) + 0 AS month_cos,
      round(sin(2 * pi() * quarter(date) / 4), 6) + 0 AS quarter_sin, round(cos(2 * pi() * quarter(date) / 4), 6) + 0 AS quarter_cos,
      round(sin(2 * pi() * (isodow(date) - 1) / 7), 6) + 0 AS dayofweek_sin, round(cos(2 * pi() * (isodow(date) - 1) / 7), 6) + 0 AS dayofweek_cos,
      pos::DOUBLE AS time_idx FROM pos"""),
)
def calendar_features(spark, sf):
    rows = with_position(daily(spark, sf), "series_id", "date", n=None)
    out = E.add_calendar(rows, dayofweek=True).drop("target", "pos")
    return rounded(out, [c for c in out.columns if c.endswith(("_sin", "_cos"))])


@query(
    "training_windows",
    with_sql(WEEKLY, POS, tail="""SELECT a.series_id, a.pos AS start, round(list_sum(list(b.target ORDER BY b.pos) FILTER (b.pos < a.pos + 8)), 6) AS x_sum,
      round(max(b.target) FILTER (b.pos = a.pos + 8), 6) AS y_first, round(max(b.target) FILTER (b.pos = a.pos + 10), 6) AS y_last
      FROM pos a JOIN pos b ON b.series_id = a.series_id AND b.pos BETWEEN a.pos AND a.pos + 10 GROUP BY 1, 2 HAVING count(*) = 11"""),
)
def training_windows(spark, sf):
    rows = with_position(weekly(spark, sf), "series_id", "date", n=None)
    out = E.training_windows(rows, 8, 3)
    total = F.aggregate("x", F.lit(0.0), lambda a, v: a + v)
    return rounded(
        out.select("series_id", "start", total.alias("x_sum"), F.element_at("y", 1).alias("y_first"), F.element_at("y", -1).alias("y_last")),
        ["x_sum", "y_first", "y_last"],
    )


@query(
    "running_best_level",
    with_sql(DAILY, POS, tail="""SELECT series_id, pos, round(max(target) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) AS best_before,
      round(sum(target) OVER (w ROWS UNBOUNDED PRECEDING), 6) AS total_so_far FROM pos WINDOW w AS (PARTITION BY series_id ORDER BY pos)"""),
)
def running_best_level(spark, sf):
    rows = with_position(daily(spark, sf), "series_id", "date", n=None)
    out = running(rows, "series_id", {"best_before": ("max", F.col("target"), False), "total_so_far": ("sum", F.col("target"), True)}, block=256)
    return rounded(out.select("series_id", "pos", "best_before", "total_so_far"), ["best_before", "total_so_far"])
