"""Chains refitted at every origin and candidate tables, each beside SQL that refits on a copy of every history."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as V
from ..operators import preprocess as P
from ..operators import rolling as R
from ..operators import split as J
from ..operators import tournament as T
from ..operators.lineage import cut
from .panels import DAILY, MONTHLY, POS, SPLIT, WEEKLY, daily, monthly, weekly, with_sql
from .q_models import FIT, SCALE
from .q_panel import SPEC, SPIKE_POS, SPIKED, _spiked, rounded
from .registry import query

KEY = "series_id"


def _parts(panel):
    return J.chronological(panel, SPEC)


# ------------------------------------------------------------------ outliers at every origin

HISTORY = """org AS (SELECT DISTINCT series_id, n_train + (pos - n_train) // 3 * 3 AS origin FROM ok WHERE split = 'validation'),
his AS (SELECT o.series_id, o.origin, h.pos, h.date, h.target FROM org o JOIN ok h ON h.series_id = o.series_id AND h.pos < o.origin)"""
MARKED = """med AS (SELECT series_id, origin, median(target) AS center FROM his GROUP BY 1, 2),
dev AS (SELECT series_id, origin, any_value(center) AS center, median(abs(target - center)) AS mad FROM his JOIN med USING (series_id, origin) GROUP BY 1, 2),
sca AS (SELECT *, CASE WHEN 1.4826 * mad <= 2.220446049250313e-16 THEN 2.220446049250313e-16 * greatest(1, abs(center)) * 16 ELSE 1.4826 * mad END AS scale FROM dev),
ran AS (SELECT his.*, (target - center) / scale AS z, row_number() OVER (PARTITION BY series_id, origin ORDER BY target DESC, pos) AS r FROM his JOIN sca USING (series_id, origin)),
mrk AS (SELECT series_id, origin, pos, target AS old FROM ran WHERE r <= 2 AND z > 8),
nei AS (SELECT m.series_id, m.origin, m.pos, median(h.target) AS new FROM mrk m JOIN his h ON h.series_id = m.series_id AND h.origin = m.origin AND abs(h.pos - m.pos) <= 3
  LEFT JOIN mrk x ON x.series_id = h.series_id AND x.origin = h.origin AND x.pos = h.pos WHERE x.pos IS NULL GROUP BY 1, 2, 3)"""


@query(
    "outlier_numbers_by_origin",
    with_sql(DAILY, SPIKED, SPIKE_POS, SPLIT, FIT, HISTORY, MARKED, tail="""SELECT series_id, origin, round(center, 8) AS center, round(mad, 8) AS mad, round(scale, 8) AS scale, count(new) AS replaced,
      coalesce(string_agg(nei.pos::VARCHAR, ',' ORDER BY nei.pos), '') AS places, round(coalesce(sum(new), 0), 6) AS replacements FROM sca LEFT JOIN nei USING (series_id, origin) GROUP BY 1, 2, 3, 4, 5"""),
)
def outlier_numbers_by_origin(spark, sf):
    got = R.outliers_by_origin(_parts(_spiked(daily(spark, sf))), SPEC).join(R.origin_table(_parts(_spiked(daily(spark, sf))), SPEC), [KEY, "origin"])
    places = F.array_join(F.transform("marks", lambda m: m["pos"].cast("string")), ",")
    total = F.aggregate("marks", F.lit(0.0), lambda a, m: a + m["new"])
    out = got.select(KEY, "origin", "center", "mad", "scale", F.size("marks").cast("bigint").alias("replaced"), places.alias("places"), total.alias("replacements"))
    return rounded(rounded(out, ["center", "mad", "scale"], 8), ["replacements"])


# ------------------------------------------------------------------ fitted numbers at every origin

FULL = [P.Step("replace_outliers"), P.Step("boxcox_transform"), P.Step("standard_scaler", scope="target")]
POWERS = [round(-1 + 0.25 * k, 2) for k in range(9)]
_CURVE = {p: "ln(target)" if p == 0 else f"((pow(target, {p}::DOUBLE) - 1) / {p}::DOUBLE)" for p in POWERS}
_ODDS = " UNION ALL ".join(
    f"SELECT series_id, origin, {p}::DOUBLE AS power, ({p}::DOUBLE - 1) * sum(ln(target)) - count(*) / 2e0 * ln(var_pop({_CURVE[p]})) AS odds, avg({_CURVE[p]}) AS mu, stddev_pop({_CURVE[p]}) AS sd FROM rep GROUP BY 1, 2" for p in POWERS
)


@query(
    "chain_numbers_by_origin",
    with_sql(WEEKLY, SPIKED, SPIKE_POS, SPLIT, FIT, HISTORY, MARKED, "rep AS (SELECT his.series_id, his.origin, his.pos, coalesce(new, target) AS target FROM his LEFT JOIN nei USING (series_id, origin, pos))",
             f"odd AS ({_ODDS}), bst AS (SELECT series_id, origin, arg_min({{'p': power, 'm': mu, 's': sd}}, (-round(odds, 9), abs(power))) AS b FROM odd GROUP BY 1, 2)",
             tail="""SELECT series_id, origin, (SELECT count(*) FROM nei WHERE nei.series_id = bst.series_id AND nei.origin = bst.origin) AS replaced, 0::DOUBLE AS shift, b.p AS power, round(b.m, 6) AS "offset", round(b.s, 6) AS divisor FROM bst"""),
)
def chain_numbers_by_origin(spark, sf):
    got = R.chain_numbers(_parts(_spiked(weekly(spark, sf))), FULL, SPEC, powers=POWERS)
    out = got.select(KEY, "origin", F.size("marks").cast("bigint").alias("replaced"), "shift", "power", "offset", "divisor")
    return rounded(out, ["offset", "divisor"])


# ------------------------------------------------------------------ backtest with a chain refitted per origin

LOGGED = [P.Step("log_transform"), P.Step("standard_scaler", scope="target")]
# the chain and the model on each history, forecasts inverted
CHAINED = """lgh AS (SELECT series_id, origin, avg(ln(1 + target)) AS mu, stddev_pop(ln(1 + target)) AS sd FROM his GROUP BY 1, 2),
sch AS (SELECT his.series_id, his.origin, his.pos, (ln(1 + target) - mu) / sd AS z FROM his JOIN lgh USING (series_id, origin)),
dif AS (SELECT *, z - lag(z) OVER w AS dz FROM sch WINDOW w AS (PARTITION BY series_id, origin ORDER BY pos)),
lgd AS (SELECT *, lag(dz) OVER (PARTITION BY series_id, origin ORDER BY pos) AS dl FROM dif),
cof AS (SELECT series_id, origin, regr_slope(dz, dl) AS b, regr_intercept(dz, dl) AS a FROM lgd WHERE dl IS NOT NULL GROUP BY 1, 2),
stt AS (SELECT cof.*, mu, sd, l.z AS z0, l.dz AS d0 FROM cof JOIN lgh USING (series_id, origin) JOIN lgd l ON l.series_id = cof.series_id AND l.origin = cof.origin AND l.pos = cof.origin - 1),
arf AS (SELECT *, a + b * d0 AS d1, a + b * (a + b * d0) AS d2, a + b * (a + b * (a + b * d0)) AS d3 FROM stt),
wnt AS (SELECT *, n_train + (pos - n_train) // 3 * 3 AS origin, (pos - n_train) % 3 + 1 AS step FROM ok WHERE split = 'validation'),
prd AS (SELECT w.series_id, 'ar' AS model, w.target AS y, exp((z0 + d1 + CASE WHEN step > 1 THEN d2 ELSE 0 END + CASE WHEN step > 2 THEN d3 ELSE 0 END) * sd + mu) - 1 AS yhat FROM wnt w JOIN arf USING (series_id, origin)
  UNION ALL SELECT w.series_id, 'mean', w.target, exp(mu) - 1 FROM wnt w JOIN lgh USING (series_id, origin)
  UNION ALL SELECT w.series_id, 'seasonal_naive', w.target, exp(s.z * sd + mu) - 1 FROM wnt w JOIN sch s ON s.series_id = w.series_id AND s.origin = w.origin AND s.pos = w.origin - 12 + (w.step - 1) % 12 JOIN lgh l ON l.series_id = w.series_id AND l.origin = w.origin)"""
SETTLED = """SELECT p.sid AS series_id, p.model, rejected, coalesce(n, 0) AS n_predictions, round(mae, 6) AS mae, round(mae / scale, 6) AS mase FROM
  (SELECT series_id AS sid, model, CASE WHEN n < 3 THEN 'fewer_than_three_observations' WHEN n_val < 3 OR n_test < 3 THEN 'no_complete_window' WHEN n_train < 30 THEN 'training_too_short' END AS rejected
     FROM (SELECT DISTINCT series_id, n, n_train, n_val, n_test FROM parts), (SELECT unnest(['ar', 'mean', 'seasonal_naive']) AS model)) p
  LEFT JOIN (SELECT series_id, model, count(*) AS n, avg(abs(y - yhat)) AS mae FROM prd GROUP BY 1, 2) q ON q.series_id = p.sid AND q.model = p.model LEFT JOIN scl ON scl.series_id = p.sid"""


@query("chain_backtest", with_sql(MONTHLY, POS, SPLIT, FIT, HISTORY, CHAINED, SCALE, tail=SETTLED))
def chain_backtest(spark, sf):
    """Three models on a log and standard-scaler chain refitted per origin, scored on the raw scale; series that can't be split keep a row."""
    panel = monthly(spark, sf)
    parts = _parts(panel)
    scale = V.mase_scale(parts.filter("split = 'train'"), 12)
    out = None
    for model in ("ar", "mean", "seasonal_naive"):
        scores = V.forecast_metrics(R.chain_forecast(parts, LOGGED, SPEC, model), scale).select(KEY, "n_predictions", "mae", "mase")
        one = J.accounted(scores, panel, SPEC).withColumn("model", F.lit(model)).withColumn("n_predictions", F.coalesce("n_predictions", F.lit(0).cast("bigint")))
        out = one if out is None else out.unionByName(one)
    return rounded(out, ["mae", "mase"])


# ------------------------------------------------------------------ candidate tables

CANDIDATES = [
    (1, "seasonal_naive", {"m": 1}), (2, "seasonal_naive", {"m": 12}), (3, "ar", {"p": 1, "d": 1}), (4, "trend", {}),
    (5, "simple_smoothing", {"alpha": 0.3}), (6, "mean", {}), (7, "ar", {"p": 2, "d": 0}), (8, "simple_smoothing", {"alpha": 0.7}),
]
# every candidate refitted on a copy of each history, for the origins of both partitions
TRIED = """wnt AS (SELECT *, CASE WHEN split = 'test' THEN n_train + n_val ELSE n_train END AS base FROM ok WHERE split <> 'train'),
asked AS (SELECT series_id, split, pos, target AS y, base + (pos - base) // 3 * 3 AS origin, (pos - base) % 3 + 1 AS step FROM wnt),
org AS (SELECT DISTINCT series_id, split, origin FROM asked),
lgs AS (SELECT *, target - lag(target) OVER w AS dz, lag(target) OVER w AS y1, lag(target, 2) OVER w AS y2, lag(target) OVER w - lag(target, 2) OVER w AS dl FROM ok WINDOW w AS (PARTITION BY series_id ORDER BY pos)),
his AS (SELECT o.origin, o.split AS asked_split, h.* FROM org o JOIN lgs h ON h.series_id = o.series_id AND h.pos < o.origin),
lst AS (SELECT o.series_id, o.origin, h.target AS f0, h.y1 AS f1, h.dz AS d0 FROM org o JOIN lgs h ON h.series_id = o.series_id AND h.pos = o.origin - 1),
cof AS (SELECT series_id, origin, avg(target) AS mu, var_pop(target) AS var_mu, count(*) AS n, regr_slope(target, pos) AS tb, regr_intercept(target, pos) AS ta, (regr_syy(target, pos) - regr_sxy(target, pos) * regr_sxy(target, pos) / regr_sxx(target, pos)) / count(*) AS tm FROM his GROUP BY 1, 2),
arc AS (SELECT series_id, origin, count(*) AS an, regr_slope(dz, dl) AS ab, regr_intercept(dz, dl) AS aa, (regr_syy(dz, dl) - regr_sxy(dz, dl) * regr_sxy(dz, dl) / regr_sxx(dz, dl)) / count(*) AS am FROM his WHERE dl IS NOT NULL GROUP BY 1, 2),
two AS (SELECT series_id, origin, count(*) AS n2, avg(target) AS m0, avg(y1) AS m1, avg(y2) AS m2, var_pop(target) AS v0, var_pop(y1) AS v1, var_pop(y2) AS v2, covar_pop(target, y1) AS c01, covar_pop(target, y2) AS c02, covar_pop(y1, y2) AS c12 FROM his WHERE y2 IS NOT NULL GROUP BY 1, 2),
tws AS (SELECT *, (c01 * v2 - c02 * c12) / (v1 * v2 - c12 * c12) AS b1, (c02 * v1 - c01 * c12) / (v1 * v2 - c12 * c12) AS b2 FROM two),
twc AS (SELECT *, m0 - b1 * m1 - b2 * m2 AS b0, v0 - b1 * c01 - b2 * c02 AS bm FROM tws),
al AS (SELECT unnest([3e-1, 7e-1]) AS a, unnest([5, 8]) AS candidate_id),
rc(series_id, candidate_id, a, pos, l, sse) AS (SELECT series_id, candidate_id, a, pos, target, 0e0 FROM ok CROSS JOIN al WHERE pos = 0
  UNION ALL SELECT rc.series_id, rc.candidate_id, rc.a, o.pos, rc.l + rc.a * (o.target - rc.l), rc.sse + (o.target - rc.l) * (o.target - rc.l) FROM rc JOIN ok o ON o.series_id = rc.series_id AND o.pos = rc.pos + 1),
f1 AS (SELECT *, b0 + b1 * f0 + b2 * f1 AS g1 FROM lst JOIN twc USING (series_id, origin)), f2 AS (SELECT *, b0 + b1 * g1 + b2 * f0 AS g2 FROM f1), f3 AS (SELECT *, b0 + b1 * g2 + b2 * g1 AS g3 FROM f2),
prd AS (SELECT q.series_id, q.split, 1 AS candidate_id, y, h.target AS yhat FROM asked q JOIN ok h ON h.series_id = q.series_id AND h.pos = q.origin - 1
  UNION ALL SELECT q.series_id, q.split, 2, y, h.target FROM asked q JOIN ok h ON h.series_id = q.series_id AND h.pos = q.origin - 12 + (q.step - 1) % 12
  UNION ALL SELECT series_id, split, 3, y, f0 + (aa + ab * d0) + CASE WHEN step > 1 THEN aa + ab * (aa + ab * d0) ELSE 0 END + CASE WHEN step > 2 THEN aa + ab * (aa + ab * (aa + ab * d0)) ELSE 0 END FROM asked JOIN arc USING (series_id, origin) JOIN lst USING (series_id, origin)
  UNION ALL SELECT series_id, split, 4, y, ta + tb * pos FROM asked JOIN cof USING (series_id, origin)
  UNION ALL SELECT q.series_id, q.split, rc.candidate_id, y, l FROM asked q JOIN rc ON rc.series_id = q.series_id AND rc.pos = q.origin - 1
  UNION ALL SELECT series_id, split, 6, y, mu FROM asked JOIN cof USING (series_id, origin)
  UNION ALL SELECT series_id, split, 7, y, CASE step WHEN 1 THEN g1 WHEN 2 THEN g2 ELSE g3 END FROM asked JOIN f3 USING (series_id, origin)),
names AS (SELECT * FROM (VALUES """ + ", ".join(f"({n}, '{m}')" for n, m, _ in CANDIDATES) + ") v(candidate_id, model))"
_recursive = lambda sql: sql.replace("WITH ", "WITH RECURSIVE ", 1)


def _table(spark, sf):
    parts = cut(_parts(monthly(spark, sf)))
    return parts, T.candidate_table(parts, CANDIDATES), V.mase_scale(parts.filter("split = 'train'"), 12)


@query(
    "candidate_fits",
    _recursive(with_sql(MONTHLY, POS, SPLIT, FIT, TRIED, tail="""SELECT series_id, origin, candidate_id, n_used, round(b0, 4) AS b0, round(b1, 4) AS b1, round(b2, 4) AS b2, round(mse, 4) AS in_sample_mse, true AS finite FROM (
      SELECT series_id, origin, 3 AS candidate_id, an AS n_used, aa AS b0, ab AS b1, NULL AS b2, am AS mse FROM arc UNION ALL SELECT series_id, origin, 4, n, ta, tb, NULL, tm FROM cof
      UNION ALL SELECT series_id, origin, 6, n, mu, NULL, NULL, var_mu FROM cof UNION ALL SELECT series_id, origin, 7, n2, b0, b1, b2, bm FROM twc
      UNION ALL SELECT rc.series_id, pos + 1, candidate_id, pos + 1, l, NULL, NULL, sse / (pos + 1) FROM rc JOIN org ON org.series_id = rc.series_id AND org.origin = rc.pos + 1 AND org.split = 'validation'
      UNION ALL SELECT series_id, origin, c, origin, NULL, NULL, NULL, NULL FROM org, (SELECT unnest([1, 2]) AS c)) JOIN (SELECT series_id, origin FROM org WHERE split = 'validation') USING (series_id, origin)""")),
)
def candidate_fits(spark, sf):
    """The fitted table at every validation origin: coefficients, rows used, error on the history."""
    parts, candidates, _ = _table(spark, sf)
    fits = T.fit_candidates(J.search_rows(parts), candidates, SPEC)
    out = fits.select(KEY, "origin", F.col("candidate_id").cast("int").alias("candidate_id"), "n_used", *[F.get("coefficients", F.lit(k)).alias(f"b{k}") for k in range(3)], "in_sample_mse", "finite")
    return rounded(out, ["b0", "b1", "b2", "in_sample_mse"], 4)


@query(
    "candidate_backtest",
    _recursive(with_sql(MONTHLY, POS, SPLIT, FIT, TRIED, SCALE, tail="""SELECT series_id, candidate_id, model, count(*) AS n_predictions, round(avg(abs(y - yhat)), 5) AS mae, round(sqrt(avg((y - yhat) * (y - yhat))), 5) AS rmse, round(avg(abs(y - yhat)) / any_value(scale), 5) AS mase
      FROM prd JOIN names USING (candidate_id) JOIN scl USING (series_id) WHERE split = 'validation' GROUP BY 1, 2, 3""")),
)
def candidate_backtest(spark, sf):
    """A table of candidates, fitted at every origin of every series in one job and scored."""
    parts, candidates, scale = _table(spark, sf)
    scores = T.candidate_scores(J.search_rows(parts), candidates, SPEC, scale).join(candidates.select(KEY, "candidate_id", "model"), [KEY, "candidate_id"])
    return rounded(scores.select(KEY, F.col("candidate_id").cast("int").alias("candidate_id"), "model", "n_predictions", "mae", "rmse", "mase"), ["mae", "rmse", "mase"], 5)


@query(
    "candidate_evaluation",
    _recursive(with_sql(MONTHLY, POS, SPLIT, FIT, TRIED, SCALE, """vld AS (SELECT series_id, candidate_id, avg(abs(y - yhat)) / any_value(scale) AS mase FROM prd JOIN scl USING (series_id) WHERE split = 'validation' GROUP BY 1, 2),
      win AS (SELECT series_id, arg_min(candidate_id, (mase, candidate_id)) AS candidate_id, min(mase) AS mase FROM vld GROUP BY 1), lim AS (SELECT series_id, min(target) AS lo, max(target) AS hi FROM ok WHERE split = 'train' GROUP BY 1)""",
      tail="""SELECT series_id, candidate_id, model, round(any_value(win.mase), 5) AS validation_mase, count(*) AS n_test, round(avg(abs(y - yhat)), 5) AS test_mae, round(avg(abs(y - yhat)) / any_value(scale), 5) AS test_mase,
        round(avg(abs(y - yhat)) / (any_value(hi) - any_value(lo)), 5) AS scaled_mae FROM win JOIN prd USING (series_id, candidate_id) JOIN names USING (candidate_id) JOIN scl USING (series_id) JOIN lim USING (series_id) WHERE split = 'test' GROUP BY 1, 2, 3""")),
)
def candidate_evaluation(spark, sf):
    """Winner of each series on validation, refitted on training and validation rows, scored once on the test rows."""
    parts, candidates, scale = _table(spark, sf)
    out = T.evaluated(parts, candidates, SPEC, scale).withColumn("candidate_id", F.col("candidate_id").cast("int"))
    return rounded(out, ["validation_mase", "test_mae", "test_mase", "scaled_mae"], 5)
