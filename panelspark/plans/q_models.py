"""Preprocessing chains, backtests, forecasters, metrics and the final evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import backtest as K
from ..operators import diagnostics as D
from ..operators import features as E
from ..operators import forecast as L
from ..operators import metrics as V
from ..operators import preprocess as P
from ..operators import split as J
from ..operators.lineage import cut
from .panels import DAILY, MONTHLY, POS, SPLIT, WEEKLY, daily, monthly, table, weekly, with_sql
from .q_panel import RESID, SEASON, SPEC, TRAIN, _acf_sql, rounded, season_and_lag, train_of
from .registry import query

KEY = "series_id"
FIT = "ok AS (SELECT * FROM parts WHERE n_train >= 30 AND n_val >= 3 AND n_test >= 3)"
#: Every series of the panel, and why it can't be split.
REASONS = """(SELECT DISTINCT series_id, CASE WHEN n < 3 THEN 'fewer_than_three_observations' WHEN n_val < 3 OR n_test < 3 THEN 'no_complete_window' WHEN n_train < 30 THEN 'training_too_short' END AS rejected FROM parts)"""


def _parts(panel):
    return J.chronological(panel, SPEC)


# ------------------------------------------------------------------ backtest with the seasonal naive model

# step s of an origin reads origin - m + (s - 1) % m
NAIVE = """org AS (SELECT *, n_train + (pos - n_train) // 3 * 3 AS origin, (pos - n_train) % 3 + 1 AS step FROM ok WHERE split = 'validation'),
pred AS (SELECT o.series_id, o.origin, o.step, o.pos, o.date, o.target AS y, p.target AS yhat FROM org o LEFT JOIN ok p ON p.series_id = o.series_id AND p.pos = o.origin - 12 + (o.step - 1) % 12)"""
SCALE = """scl AS (SELECT a.series_id, CASE WHEN avg(abs(a.target - b.target)) >= 1e-10 THEN avg(abs(a.target - b.target)) END AS scale FROM ok a JOIN ok b ON b.series_id = a.series_id AND b.pos = a.pos - 12
  WHERE a.split = 'train' GROUP BY 1)"""
METRICS = """met AS (SELECT series_id, count(*) AS n_predictions, avg((y - yhat) * (y - yhat)) AS mse, sqrt(avg((y - yhat) * (y - yhat))) AS rmse, avg(abs(y - yhat)) AS mae,
  CASE WHEN var_pop(y) > 0 THEN 1 - avg((y - yhat) * (y - yhat)) / var_pop(y) WHEN avg((y - yhat) * (y - yhat)) = 0 THEN 1 ELSE 0 END AS r2, avg(abs((y - yhat) / greatest(abs(y), 1e-8))) AS mape FROM pred GROUP BY 1)"""
METRIC_COLS = ["mse", "rmse", "mae", "r2", "mape", "mase"]
SCORED = "SELECT series_id, n_predictions, " + ", ".join(f"round({c}, 6) AS {c}" for c in METRIC_COLS[:5]) + ", round(mae / scale, 6) AS mase FROM met LEFT JOIN scl USING (series_id)"


def _naive(spark, sf, panel=monthly):
    parts = _parts(panel(spark, sf))
    return parts, K.seasonal_naive(parts, SPEC, 12)


@query("seasonal_naive_backtest_mase", with_sql(MONTHLY, POS, SPLIT, FIT, NAIVE, SCALE, METRICS, tail=SCORED))
def seasonal_naive_backtest_mase(spark, sf):
    parts, predictions = _naive(spark, sf)
    scale = V.mase_scale(parts.filter("split = 'train'"), 12)
    return rounded(V.forecast_metrics(predictions, scale), METRIC_COLS)


@query("seasonal_naive_backtest_weekly", with_sql(WEEKLY, POS, SPLIT, FIT, NAIVE, SCALE, METRICS, tail=SCORED))
def seasonal_naive_backtest_weekly(spark, sf):
    parts, predictions = _naive(spark, sf, weekly)
    return rounded(V.forecast_metrics(predictions, V.mase_scale(parts.filter("split = 'train'"), 12)), METRIC_COLS)


@query(
    "seasonal_naive_predictions",
    with_sql(DAILY, POS, SPLIT, FIT, NAIVE, tail="SELECT series_id, origin, step, pos, date, round(y, 8) AS y, round(yhat, 8) AS yhat FROM pred"),
)
def seasonal_naive_predictions(spark, sf):
    return rounded(_naive(spark, sf, daily)[1], ["y", "yhat"], 8)


@query(
    "expanding_mean_refit",
    with_sql(DAILY, POS, SPLIT, FIT, "org AS (SELECT *, n_train + (pos - n_train) // 3 * 3 AS origin, (pos - n_train) % 3 + 1 AS step FROM ok WHERE split = 'validation'),"
             "cum AS (SELECT series_id, pos, sum(target) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s FROM ok)",
             tail="SELECT o.series_id, o.origin, o.step, round(c.s / o.origin, 6) AS yhat FROM org o JOIN cum c ON c.series_id = o.series_id AND c.pos = o.origin"),
)
def expanding_mean_refit(spark, sf):
    out = K.origin_levels(_parts(daily(spark, sf)), SPEC)
    return rounded(out.select(KEY, "origin", "step", "yhat"), ["yhat"])


@query("mase_scales", with_sql(MONTHLY, POS, SPLIT, FIT, SCALE, tail="SELECT series_id, round(scale, 6) AS scale FROM scl"))
def mase_scales(spark, sf):
    return rounded(V.mase_scale(_parts(monthly(spark, sf)).filter("split = 'train'"), 12), ["scale"])


# the panel's first letter decides which series counts as seasonal, so that all three sources of a period occur
DET = """det AS (SELECT series_id, any_value(n_train) AS n_train, series_id < '4' AS detected, CASE WHEN series_id < '2' THEN 40 ELSE 12 END AS m FROM ok GROUP BY 1),
per AS (SELECT series_id, n_train, CASE WHEN detected AND n_train >= 2 * m THEN m ELSE 1 END::BIGINT AS period, CASE WHEN NOT detected THEN 'nonseasonal_detector'
  WHEN n_train >= 2 * m THEN 'detected_seasonality_period' ELSE 'detected_period_unavailable' END AS period_source FROM det)"""


def _periods(parts):
    det = parts.groupBy(KEY).agg(F.max("n_train").alias("n_train")).select(
        KEY, "n_train", (F.col(KEY) < "4").alias("seasonality_detected"), F.when(F.col(KEY) < "2", 40).otherwise(12).alias("seasonal_periods")
    )
    return V.mase_period(det)


@query(
    "mase_reference",
    with_sql(MONTHLY, POS, SPLIT, FIT, DET, tail="""SELECT per.series_id, per.n_train, period, period_source, round(avg(abs(a.target - b.target)), 6) AS scale, true AS defined FROM per
      JOIN ok a ON a.series_id = per.series_id AND a.split = 'train' JOIN ok b ON b.series_id = a.series_id AND b.pos = a.pos - period GROUP BY 1, 2, 3, 4"""),
)
def mase_reference(spark, sf):
    parts = _parts(monthly(spark, sf))
    return rounded(V.mase_reference(parts.filter("split = 'train'"), _periods(parts)), ["scale"])


_CANDIDATES, _DEFAULT = D.PERIODS["monthly"][1:]
DETECTED = """per AS (SELECT series_id, n_train, CASE WHEN seasonality_detected AND usable THEN seasonal_periods ELSE 1 END AS period, CASE WHEN NOT seasonality_detected THEN 'nonseasonal_detector'
    WHEN usable THEN 'detected_seasonality_period' ELSE 'detected_period_unavailable' END AS period_source
  FROM (SELECT f.*, n_train, seasonal_periods > 1 AND n_train >= 2 * seasonal_periods AS usable FROM found f JOIN (SELECT series_id, any_value(n_train) AS n_train FROM ok GROUP BY 1) USING (series_id))),
gap AS (SELECT a.series_id, avg(abs(a.target - b.target)) AS scale FROM per JOIN ok a ON a.series_id = per.series_id AND a.split = 'train' JOIN ok b ON b.series_id = a.series_id AND b.pos = a.pos - period GROUP BY 1)"""


@query(
    "mase_reference_detected",
    with_sql(MONTHLY, POS, SPLIT, FIT, TRAIN, RESID, _acf_sql(str(sorted({*range(1, 101), *_CANDIDATES}))), SEASON.format(cands=_CANDIDATES, default=_DEFAULT, longest=max(_CANDIDATES)), DETECTED,
             tail="SELECT p.series_id, n_train, period, period_source, CASE WHEN scale >= 1e-10 THEN round(scale, 6) END AS scale, CASE WHEN n_train IS NOT NULL THEN coalesce(scale >= 1e-10, false) END AS defined, rejected FROM " + REASONS + " p LEFT JOIN per ON per.series_id = p.series_id LEFT JOIN gap ON gap.series_id = p.series_id"),
)
def mase_reference_detected(spark, sf):
    """The period found by the diagnostics, carried into the one denominator of each series."""
    panel = monthly(spark, sf)
    parts = _parts(panel)
    found = season_and_lag(panel, "monthly").select(KEY, "seasonality_detected", "seasonal_periods")
    sizes = parts.groupBy(KEY).agg(F.max("n_train").alias("n_train"))
    scales = V.mase_reference(parts.filter("split = 'train'"), V.mase_period(found.join(sizes, KEY)))
    return rounded(J.accounted(scales, panel, SPEC), ["scale"])


@query(
    "per_origin_errors",
    with_sql(MONTHLY, POS, SPLIT, FIT, NAIVE, SCALE, tail="SELECT series_id, origin, round(avg(abs(y - yhat)), 6) AS mae, round(avg(abs(y - yhat)) / any_value(scale), 6) AS mase FROM pred JOIN scl USING (series_id) GROUP BY 1, 2"),
)
def per_origin_errors(spark, sf):
    parts, predictions = _naive(spark, sf)
    return rounded(V.per_origin(predictions, V.mase_scale(parts.filter("split = 'train'"), 12)), ["mae", "mase"])


@query(
    "scaled_test_metrics",
    with_sql(MONTHLY, POS, SPLIT, FIT, """org AS (SELECT *, n_train + n_val + (pos - n_train - n_val) // 3 * 3 AS origin, (pos - n_train - n_val) % 3 + 1 AS step FROM ok WHERE split = 'test'),
      pred AS (SELECT o.series_id, o.target AS y, p.target AS yhat FROM org o LEFT JOIN ok p ON p.series_id = o.series_id AND p.pos = o.origin - 12 + (o.step - 1) % 12),
      lim AS (SELECT series_id, min(target) AS lo, max(target) AS hi FROM ok WHERE split = 'train' GROUP BY 1)""",
             tail="""SELECT series_id, round(avg(((y - yhat) / (hi - lo)) * ((y - yhat) / (hi - lo))), 6) AS scaled_mse, round(avg(abs((y - yhat) / (hi - lo))), 6) AS scaled_mae,
               round(sqrt(avg(((y - yhat) / (hi - lo)) * ((y - yhat) / (hi - lo)))), 6) AS scaled_rmse FROM pred JOIN lim USING (series_id) GROUP BY 1"""),
)
def scaled_test_metrics(spark, sf):
    parts = _parts(monthly(spark, sf))
    predictions = K.seasonal_naive(parts, SPEC, 12, "test")
    return rounded(V.scaled_test_metrics(predictions, parts.filter("split = 'train'")), ["scaled_mse", "scaled_mae", "scaled_rmse"])


@query(
    "prediction_alignment",
    with_sql(DAILY, POS, SPLIT, FIT, "t AS (SELECT * FROM ok WHERE split = 'test')",
             tail="""SELECT series_id, count(*) FILTER (day(date) <> 5) AS matched, count(*) FILTER (day(date) = 5) AS missing, count(*) FILTER (day(date) = 9) AS surplus, count(*) FILTER (day(date) = 7) AS repeated FROM t GROUP BY 1"""),
)
def prediction_alignment(spark, sf):
    parts = _parts(daily(spark, sf))
    test = J.holdout_rows(parts)
    # some predictions are left out, some doubled, some dated outside the test rows
    got = test.filter(F.dayofmonth("date") != 5).select(KEY, "date")
    got = got.unionByName(test.filter(F.dayofmonth("date") == 7).select(KEY, "date"))
    got = got.unionByName(test.filter(F.dayofmonth("date") == 9).select(KEY, F.date_add("date", 36500).alias("date")))
    return K.alignment(test, got)


@query(
    "horizon_checks",
    with_sql(DAILY, POS, SPLIT, FIT, NAIVE, tail="""SELECT series_id, count(*) AS origins, sum(c)::BIGINT AS n_predictions, count(*) FILTER (c <> 3) AS odd_origins, sum(b)::BIGINT AS unusable FROM
      (SELECT series_id, origin, count(*) AS c, count(*) FILTER (yhat IS NULL) AS b FROM pred WHERE day(date) <> 11 GROUP BY 1, 2) GROUP BY 1"""),
)
def horizon_checks(spark, sf):
    predictions = _naive(spark, sf, daily)[1].filter(F.dayofmonth("date") != 11)
    return K.horizon_problems(predictions, SPEC)


@query(
    "origin_audit",
    with_sql(MONTHLY, POS, SPLIT, FIT, """o AS (SELECT series_id, n_train + (pos - n_train) // 3 * 3 AS origin, min(date) AS forecast_start, max(date) AS forecast_end, count(*) AS horizon FROM ok WHERE split = 'validation' GROUP BY 1, 2)""",
             tail="""SELECT o.series_id, o.origin, o.origin AS train_size, (SELECT min(date) FROM ok WHERE ok.series_id = o.series_id) AS train_start, p.date AS train_end, forecast_start, forecast_end, horizon
               FROM o JOIN ok p ON p.series_id = o.series_id AND p.pos = o.origin - 1"""),
)
def origin_audit(spark, sf):
    return K.origin_audit(_parts(monthly(spark, sf)), SPEC)


# ------------------------------------------------------------------ preprocessing

CONSTANT = "CASE WHEN abs({0}) < 1e-12 THEN 1 ELSE {0} END"


@query(
    "target_scalers",
    with_sql(MONTHLY, POS, SPLIT, FIT, f"""f AS (SELECT series_id, avg(target) AS mu, {CONSTANT.format('stddev_pop(target)')} AS sd, min(target) AS lo, {CONSTANT.format('(max(target) - min(target))')} AS rg FROM ok WHERE split = 'train' GROUP BY 1)""",
             tail="SELECT series_id, date, round((target - mu) / sd, 6) AS standard, round((target - lo) / rg, 6) AS minmax FROM ok JOIN f USING (series_id) WHERE split = 'validation'"),
)
def target_scalers(spark, sf):
    parts = _parts(monthly(spark, sf))
    train, new = parts.filter("split = 'train'"), parts.filter("split = 'validation'")
    out = None
    for name, alias in (("standard_scaler", "standard"), ("minmax_scaler", "minmax")):
        _, log = P.fit(train, [P.Step(name, scope="target")])
        one = P.replay(train, new, log).select(KEY, "date", F.col("target").alias(alias))
        out = one if out is None else out.join(one, [KEY, "date"])
    return rounded(out, ["standard", "minmax"])


@query(
    "log_round_trip",
    with_sql(MONTHLY, POS, SPLIT, FIT, """f AS (SELECT series_id, avg(ln(1 + target)) AS mu, stddev_pop(ln(1 + target)) AS sd FROM ok WHERE split = 'train' GROUP BY 1)""",
             tail="SELECT series_id, date, round((ln(1 + target) - mu) / sd, 6) AS scaled, round(target, 8) AS restored FROM ok JOIN f USING (series_id) WHERE split = 'validation'"),
)
def log_round_trip(spark, sf):
    parts = _parts(monthly(spark, sf))
    train, new = parts.filter("split = 'train'"), parts.filter("split = 'validation'")
    _, log = P.fit(train, [P.Step("log_transform"), P.Step("standard_scaler", scope="target")])
    moved = P.replay(train, new, log).withColumn("yhat", F.col("target"))
    out = P.invert(moved, log).select(KEY, "date", F.col("target").alias("scaled"), F.col("yhat").alias("restored"))
    return rounded(rounded(out, ["scaled"]), ["restored"], 8)


POWERS = [-2.0, -1.0, -0.5, 0.0, 0.5, 1.0, 2.0]
_LLF = " UNION ALL ".join(
    f"SELECT series_id, {p}::DOUBLE AS power, ({p}::DOUBLE - 1) * sum(ln(target)) - count(*) / 2e0 * ln(var_pop({'ln(target)' if p == 0 else f'(pow(target, {p}::DOUBLE) - 1) / {p}::DOUBLE'})) AS ll FROM train GROUP BY 1" for p in POWERS
)


@query("boxcox_likelihood", with_sql(MONTHLY, POS, SPLIT, TRAIN, f"g AS ({_LLF})", tail="SELECT series_id, 0::DOUBLE AS shift, power, round(ll, 5) AS likelihood FROM g"))
def boxcox_likelihood(spark, sf):
    return rounded(P.boxcox_grid(train_of(monthly(spark, sf)), POWERS), ["likelihood"], 5)


@query("boxcox_round_trip")
def boxcox_round_trip(spark, sf):
    panel = monthly(spark, sf)
    parts = _parts(panel)
    train, new = parts.filter("split = 'train'"), parts.filter("split = 'validation'")
    _, log = P.fit(train, [P.Step("boxcox_transform")])
    moved = P.replay(train, new, log).withColumn("yhat", F.col("target"))
    back = P.invert(moved, log).join(new.select(KEY, "pos", F.col("target").alias("raw")), [KEY, "pos"])
    gap = back.groupBy(KEY).agg(F.max(F.abs(F.col("yhat") - F.col("raw")) / F.abs("raw")).alias("relative_gap"))
    return rounded(J.accounted(gap.join(log[0].numbers, KEY), panel, SPEC), ["relative_gap", "power"])


_ROLL = "CASE WHEN pos >= 3 THEN avg(z) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) END"
_FEATS = ["lag_1", "lag_7", "rolling_mean_3", "month_sin"]
CHAIN = f"""lg AS (SELECT *, ln(1 + target) AS z FROM ok WHERE split <> 'test'),
ft AS (SELECT *, lag(z, 1) OVER w AS lag_1, lag(z, 7) OVER w AS lag_7, {_ROLL} AS rolling_mean_3, sin(2 * pi() * month(date) / 12) AS month_sin FROM lg WINDOW w AS (PARTITION BY series_id ORDER BY pos)),
fs AS (SELECT series_id, {", ".join(f"avg({c}) AS m_{c}, {CONSTANT.format(f'stddev_pop({c})')} AS s_{c}" for c in _FEATS)} FROM ft WHERE split = 'train' AND pos >= 10 GROUP BY 1)"""


@query(
    "fitted_chain_replay",
    with_sql(MONTHLY, POS, SPLIT, FIT, CHAIN, tail="SELECT ft.series_id, date, round(z, 6) AS target, " + ", ".join(f"round(({c} - m_{c}) / s_{c}, 6) AS {c}" for c in _FEATS) + " FROM ft JOIN fs USING (series_id) WHERE split = 'validation'"),
)
def fitted_chain_replay(spark, sf):
    parts = _parts(monthly(spark, sf))
    train, new = parts.filter("split = 'train'"), parts.filter("split = 'validation'")
    steps = [
        P.Step("log_transform"), P.Step("lag_features", lags=(1, 7)), P.Step("rolling_features", windows=(3,)),
        P.Step("calendar_features", calendar={"quarter": False, "time_idx": False}), P.Step("standard_scaler"),
    ]
    _, log = P.fit(train, steps)
    out = P.replay(train, new, log).select(KEY, "date", "target", *_FEATS)
    return rounded(out, ["target", *_FEATS])


@query("fitted_chain_numbers")
def fitted_chain_numbers(spark, sf):
    panel = daily(spark, sf)
    train = train_of(panel)
    steps = [P.Step("replace_outliers"), P.Step("log_transform"), P.Step("lag_features", lags=(1, 7)), P.Step("minmax_scaler"), P.Step("standard_scaler", scope="target")]
    _, log = P.fit(train, steps)
    rows = P.fitted_log(log)
    rows = rows.select(KEY, "step_no", "name", F.explode("params").alias("param", "value")).withColumn("value", F.round("value", 6))
    return J.accounted(rows, panel, SPEC)


@query(
    "incomplete_features",
    with_sql(MONTHLY, POS, SPLIT, FIT, tail="SELECT series_id, 12::BIGINT - 5 AS incomplete_rows FROM ok GROUP BY 1"),
)
def incomplete_features(spark, sf):
    parts = _parts(monthly(spark, sf))
    # a history of five rows cannot fill a lag of twelve: the first seven new rows lack it
    history = parts.filter("pos < 5").withColumn("n_train", F.lit(5))
    step = P.Fitted(P.Step("lag_features", lags=(1, 12)))
    return P.incomplete_features(P.replay(history, parts.filter("pos >= 5").drop("n_train"), [step]), [step])


# ------------------------------------------------------------------ forecasters

ORG = "org AS (SELECT *, n_train + (pos - n_train) // 3 * 3 AS origin, (pos - n_train) % 3 + 1 AS step FROM ok WHERE split = 'validation')"


def _predicted(df, digits=6):
    return rounded(df.select(KEY, "origin", "step", "yhat"), ["yhat"], digits)


@query(
    "linear_trend_refit",
    with_sql(WEEKLY, POS, SPLIT, FIT, ORG, """oo AS (SELECT DISTINCT series_id, origin FROM org),
      co AS (SELECT oo.series_id, oo.origin, regr_slope(h.target, h.pos) AS b, regr_intercept(h.target, h.pos) AS a FROM oo JOIN ok h ON h.series_id = oo.series_id AND h.pos < oo.origin GROUP BY 1, 2)""",
             tail="SELECT org.series_id, org.origin, step, round(a + b * pos, 4) AS yhat FROM org JOIN co USING (series_id, origin)"),
)
def linear_trend_refit(spark, sf):
    return _predicted(L.additive_regression(_parts(weekly(spark, sf)), SPEC, L.Additive(hinges=0, seasons=())), 4)


@query(
    "ar_one_refit",
    with_sql(MONTHLY, POS, SPLIT, FIT, ORG, """df AS (SELECT *, target - lag(target) OVER (PARTITION BY series_id ORDER BY pos) AS z FROM ok), dl AS (SELECT *, lag(z) OVER (PARTITION BY series_id ORDER BY pos) AS zl FROM df),
      oo AS (SELECT DISTINCT series_id, origin FROM org),
      co AS (SELECT oo.series_id, oo.origin, regr_slope(z, zl) AS b, regr_intercept(z, zl) AS a FROM oo JOIN dl h ON h.series_id = oo.series_id AND h.pos < oo.origin AND zl IS NOT NULL GROUP BY 1, 2),
      st AS (SELECT co.*, h.target AS y0, h.z AS z0 FROM co JOIN dl h ON h.series_id = co.series_id AND h.pos = co.origin - 1),
      fc AS (SELECT *, a + b * z0 AS z1, a + b * (a + b * z0) AS z2, a + b * (a + b * (a + b * z0)) AS z3 FROM st)""",
             tail="SELECT org.series_id, org.origin, step, round(y0 + z1 + CASE WHEN step > 1 THEN z2 ELSE 0 END + CASE WHEN step > 2 THEN z3 ELSE 0 END, 4) AS yhat FROM org JOIN fc USING (series_id, origin)"),
)
def ar_one_refit(spark, sf):
    return _predicted(L.ar_ols(_parts(monthly(spark, sf)), SPEC, p=1, d=1), 4)


SES = [(a, 0.0, 0.0) for a in (0.1, 0.3, 0.5, 0.7, 0.9)]


@query(
    "simple_smoothing_refit",
    with_sql(MONTHLY, POS, SPLIT, FIT, ORG, """al AS (SELECT unnest([1e-1, 3e-1, 5e-1, 7e-1, 9e-1]) AS a, unnest(range(5)) AS p),
      rc(series_id, p, a, pos, l, sse) AS (SELECT series_id, p, a, pos, target, 0e0 FROM ok CROSS JOIN al WHERE pos = 0
        UNION ALL SELECT rc.series_id, rc.p, rc.a, o.pos, rc.l + rc.a * (o.target - rc.l), rc.sse + (o.target - rc.l) * (o.target - rc.l) FROM rc JOIN ok o ON o.series_id = rc.series_id AND o.pos = rc.pos + 1),
      bs AS (SELECT series_id, pos + 1 AS origin, arg_min(l, (round(sse, 9), p)) AS l FROM rc GROUP BY 1, 2)""",
             tail="SELECT org.series_id, org.origin, step, round(l, 4) AS yhat FROM org JOIN bs USING (series_id, origin)").replace("WITH ", "WITH RECURSIVE ", 1),
)
def simple_smoothing_refit(spark, sf):
    return _predicted(L.exponential_smoothing(_parts(monthly(spark, sf)), SPEC, trend=None, seasonal=None, grid=SES), 4)


def _scores(predictions, parts, name):
    scale = V.mase_scale(parts.filter("split = 'train'"), 12)
    return V.forecast_metrics(predictions, scale).select(KEY, F.lit(name).alias("model"), "n_predictions", "mae", "mase")


MODELS = {
    "ar_seasonal": ("ar_ols", {"p": 2, "d": 1, "seasonal_p": 1, "m": 12}),
    "smoothing_additive": ("exponential_smoothing", {"m": 12}),
    "smoothing_multiplicative": ("exponential_smoothing", {"trend": "mul", "seasonal": "mul", "m": 12}),
    "additive_regression": ("additive_regression", {"shape": L.Additive(seasons=L.SEASONS["monthly"])}),
    "elastic_net": ("elastic_net", {"alpha": 0.05}),
    "calendar_elastic_net": ("calendar_elastic_net", {}),
    "knn": ("knn_forecast", {"lags": (1, 2, 12), "weights": "distance"}),
    "random_forest": ("tree_forecast", {"kind": "random_forest"}),
    "boosted_trees": ("tree_forecast", {"kind": "gbt"}),
}


def _knn_step(k: int, l1: str, l2: str, back: int, source: str) -> str:
    """One step of every origin: its query, the five nearest rows before the origin, their mean by inverse distance."""
    return f"""q{k} AS (SELECT {source}.*, {l1} AS a, {l2} AS b, h.target AS c FROM {source} JOIN ok h ON h.series_id = {source}.series_id AND h.pos = {source}.origin - {back}),
d{k} AS (SELECT q.series_id, q.origin, t.target, sqrt((q.a - l1) * (q.a - l1) + (q.b - l2) * (q.b - l2) + (q.c - l12) * (q.c - l12)) AS d, t.pos FROM q{k} q JOIN fe t ON t.series_id = q.series_id AND t.pos < q.origin AND l12 IS NOT NULL),
r{k} AS (SELECT *, row_number() OVER (PARTITION BY series_id, origin ORDER BY d, pos) AS rk FROM d{k}),
s{k} AS (SELECT q{k}.* EXCLUDE (a, b, c), y{k} FROM q{k} JOIN (SELECT series_id, origin, CASE WHEN min(d) = 0 THEN avg(target) FILTER (d = 0) ELSE sum(target / nullif(d, 0)) / sum(1 / nullif(d, 0)) END AS y{k} FROM r{k} WHERE rk <= 5 GROUP BY 1, 2) USING (series_id, origin))"""


KNN = ",\n".join(
    [
        "fe AS (SELECT series_id, pos, target, lag(target) OVER w AS l1, lag(target, 2) OVER w AS l2, lag(target, 12) OVER w AS l12 FROM ok WINDOW w AS (PARTITION BY series_id ORDER BY pos))",
        "s0 AS (SELECT DISTINCT o.series_id, o.origin, x.target AS p1, y.target AS p2 FROM org o JOIN ok x ON x.series_id = o.series_id AND x.pos = o.origin - 1 JOIN ok y ON y.series_id = o.series_id AND y.pos = o.origin - 2)",
        _knn_step(1, "p1", "p2", 12, "s0"), _knn_step(2, "y1", "p1", 11, "s1"), _knn_step(3, "y2", "y1", 10, "s2"),
    ]
)
#: Every series of the panel has a row: scores, or why it can't be split.
SETTLED = """SELECT p.series_id, '{name}' AS model, rejected, coalesce(c, 0) AS n_predictions, round(mae, 6) AS mae, round(mae / scale, 6) AS mase FROM
  """ + REASONS + """ p LEFT JOIN (SELECT series_id, count(*) AS c, avg(abs(y - yhat)) AS mae FROM pred GROUP BY 1) m ON m.series_id = p.series_id LEFT JOIN scl ON scl.series_id = p.series_id"""
BACKTEST_SQL = {
    "knn": with_sql(MONTHLY, POS, SPLIT, FIT, ORG, SCALE, KNN, "pred AS (SELECT org.series_id, org.target AS y, CASE step WHEN 1 THEN y1 WHEN 2 THEN y2 ELSE y3 END AS yhat FROM org JOIN s3 USING (series_id, origin))", tail=SETTLED.format(name="knn")),
}
for _name, (_model, _settings) in MODELS.items():

    def _run(spark, sf, _name=_name, _model=_model, _settings=_settings):
        panel = monthly(spark, sf)
        parts = _parts(panel)
        scores = J.accounted(_scores(L.forecast(_model, parts, SPEC, **_settings), parts, _name), panel, SPEC)
        scores = scores.withColumn("model", F.lit(_name)).withColumn("n_predictions", F.coalesce("n_predictions", F.lit(0).cast("bigint")))
        return rounded(scores, ["mae", "mase"])

    query(f"{_name}_backtest", BACKTEST_SQL.get(_name))(_run)


@query(
    "knn_label_regression",
    """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, label FROM embeddings), q AS (SELECT * FROM e WHERE vec_id % 10 = 0), t AS (SELECT * FROM e WHERE vec_id % 10 <> 0),
    d AS (SELECT q.vec_id AS query_id, t.vec_id AS id, t.label, sqrt(list_sum(list_transform(list_zip(q.x, t.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS d FROM q CROSS JOIN t),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS rk FROM d)
    SELECT query_id, round(avg(label), 6) AS uniform, round(sum(label / d) / sum(1 / d), 6) AS weighted, round(max(d), 6) AS farthest FROM r WHERE rk <= 5 GROUP BY 1""",
)
def knn_label_regression(spark, sf):
    e = table(spark, sf, "embeddings").select(F.lit("all").alias(KEY), "vec_id", F.col("embedding").cast("array<double>").alias("x"), "label")
    train = e.filter(F.col("vec_id") % 10 != 0).select(KEY, F.col("vec_id").alias("id"), "x", F.col("label").alias("value"))
    queries = e.filter(F.col("vec_id") % 10 == 0).select(KEY, F.col("vec_id").alias("query_id"), "x")
    found = cut(L.nearest(train, queries, 5))  # read three times
    plain = L.knn_regression(found).withColumnRenamed("yhat", "uniform")
    inverse = L.knn_regression(found, "distance").withColumnRenamed("yhat", "weighted")
    far = found.groupBy(KEY, "query_id").agg(F.max("distance").alias("farthest"))
    out = plain.join(inverse, [KEY, "query_id"]).join(far, [KEY, "query_id"]).drop(KEY)
    return rounded(out, ["uniform", "weighted", "farthest"])


# ------------------------------------------------------------------ final evaluation

PERIODS = [1, 6, 12]
_CAND = " UNION ALL ".join(
    f"SELECT '{p}' AS model, {i + 1} AS step, o.series_id, avg(abs(o.target - p.target)) AS mae FROM org o JOIN ok p ON p.series_id = o.series_id AND p.pos = o.origin - {p} + (o.step - 1) % {p} GROUP BY 3" for i, p in enumerate(PERIODS)
)
_TEST = " UNION ALL ".join(
    f"SELECT '{p}' AS model, o.series_id, o.target AS y, p.target AS yhat FROM tst o JOIN ok p ON p.series_id = o.series_id AND p.pos = o.origin - {p} + (o.tstep - 1) % {p}" for p in PERIODS
)


@query(
    "final_evaluation",
    with_sql(MONTHLY, POS, SPLIT, FIT, ORG, SCALE, f"cd AS ({_CAND}), win AS (SELECT cd.series_id, arg_min(model, (mae / scale, step)) AS model, min(mae / scale) AS validation_mase FROM cd JOIN scl USING (series_id) GROUP BY 1),"
             "tst AS (SELECT *, n_train + n_val + (pos - n_train - n_val) // 3 * 3 AS origin, (pos - n_train - n_val) % 3 + 1 AS tstep FROM ok WHERE split = 'test'),"
             f"pr AS ({_TEST}), lim AS (SELECT series_id, min(target) AS lo, max(target) AS hi FROM ok WHERE split = 'train' GROUP BY 1)",
             tail="""SELECT series_id, model, round(any_value(validation_mase), 6) AS validation_mase, round(avg(abs(y - yhat)), 6) AS test_mae, round(avg(abs(y - yhat)) / any_value(scale), 6) AS test_mase,
               round(avg(abs(y - yhat)) / (any_value(hi) - any_value(lo)), 6) AS scaled_mae, count(*) AS n_test FROM win JOIN pr USING (series_id, model) JOIN scl USING (series_id) JOIN lim USING (series_id) GROUP BY 1, 2"""),
)
def final_evaluation(spark, sf):
    """Choose each series' model on validation, freeze it, then score the holdout once with it."""
    parts = cut(_parts(monthly(spark, sf)))
    train = parts.filter("split = 'train'")
    scale = V.mase_scale(train, 12)
    scored = None
    for step, period in enumerate(PERIODS, start=1):
        one = V.forecast_metrics(K.seasonal_naive(J.search_rows(parts), SPEC, period), scale)
        one = one.select(F.col(KEY).alias("run_id"), F.lit(step).alias("step"), F.lit(str(period)).alias("model"), "mase")
        scored = one if scored is None else scored.unionByName(one)
    winners = V.winner(scored).select(F.col("run_id").alias(KEY), F.col("best_model").alias("model"), F.col("best_mase").alias("validation_mase"), F.lit(True).alias("frozen"))
    entitled = J.open_holdout(parts, winners, winners.filter(F.lit(False)).select(KEY)).select(KEY, "pos")
    out = None
    for period in PERIODS:
        mine = winners.filter(F.col("model") == str(period)).select(KEY)
        one = K.seasonal_naive(parts, SPEC, period, "test").join(mine, KEY, "left_semi")
        out = one if out is None else out.unionByName(one)
    out = out.join(entitled, [KEY, "pos"], "left_semi")
    metrics = V.forecast_metrics(out, scale).select(KEY, F.col("mae").alias("test_mae"), F.col("mase").alias("test_mase"), F.col("n_predictions").alias("n_test"))
    scaled = V.scaled_test_metrics(out, train).select(KEY, "scaled_mae")
    done = winners.select(KEY, "model", "validation_mase").join(metrics, KEY).join(scaled, KEY)
    return rounded(done, ["validation_mase", "test_mae", "test_mase", "scaled_mae"])
