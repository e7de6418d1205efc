"""Trees refitted at every origin; one split per origin is checked by SQL that searches a copy of every history."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import boosting as B
from ..operators import metrics as V
from ..operators import split as J
from .panels import MONTHLY, POS, SPLIT, monthly, with_sql
from .q_models import FIT, ORG, _parts, _predicted
from .q_panel import SPEC, rounded
from .registry import query

KEY = "series_id"
SPLIT_ONCE = B.Trees(lags=(1, 2, 12), month=False, rounds=1, depth=1, rate=1.0, bins=16, ridge=0.0, patience=0)
BOOSTED = B.Trees(rounds=12)
FOREST = B.forest()


def _step(k: int, p1: str, p2: str, source: str) -> str:
    """Step ``k`` of every origin: the lag that the split reads, then the mean of its side."""
    return f"""f{k} AS (SELECT s.*, c + s * (base + CASE WHEN f IS NULL THEN all_g / all_n WHEN CASE f WHEN 0 THEN {p1} WHEN 1 THEN {p2} ELSE h.target END <= e THEN gl / nl ELSE gr / nr END) / 1048576 AS y{k}
      FROM {source} s JOIN ok h ON h.series_id = s.series_id AND h.pos = s.origin - {13 - k})"""


ONE_SPLIT = """num AS (SELECT series_id, avg(target) AS c, CASE WHEN stddev_pop(target) > 0 THEN stddev_pop(target) ELSE 1 END AS s, count(*) AS m FROM ok WHERE pos < n_train GROUP BY 1),
rkd AS (SELECT series_id, target, row_number() OVER (PARTITION BY series_id ORDER BY target) AS r FROM ok WHERE pos < n_train),
edg AS (SELECT DISTINCT series_id, target AS e FROM rkd JOIN num USING (series_id) JOIN (SELECT unnest(range(1, 16)) AS i) ON r = greatest(CAST(ceil(i * m / 16e0) AS BIGINT), 1)),
lgd AS (SELECT series_id, pos, target, lag(target) OVER w AS l1, lag(target, 2) OVER w AS l2, lag(target, 12) OVER w AS l12 FROM ok WINDOW w AS (PARTITION BY series_id ORDER BY pos)),
his AS (SELECT o.series_id, o.origin, l1, l2, l12, CAST(round_even((target - c) / s * 1048576, 0) AS BIGINT) AS q FROM (SELECT DISTINCT series_id, origin FROM org) o
  JOIN lgd h ON h.series_id = o.series_id AND h.pos < o.origin AND l12 IS NOT NULL JOIN num ON num.series_id = o.series_id),
bas AS (SELECT series_id, origin, CAST(sum(q) AS DOUBLE) / count(*) AS base FROM his GROUP BY 1, 2),
res AS (SELECT his.*, q - CAST(round_even(base, 0) AS BIGINT) AS r FROM his JOIN bas USING (series_id, origin)),
tot AS (SELECT series_id, origin, CAST(count(*) AS DOUBLE) AS all_n, CAST(sum(r) AS DOUBLE) AS all_g FROM res GROUP BY 1, 2),
lng AS (SELECT series_id, origin, 0 AS f, l1 AS v, r FROM res UNION ALL SELECT series_id, origin, 1, l2, r FROM res UNION ALL SELECT series_id, origin, 2, l12, r FROM res),
cnd AS (SELECT series_id, origin, f, e, CAST(count(*) FILTER (v <= e) AS DOUBLE) AS nl, CAST(sum(r) FILTER (v <= e) AS DOUBLE) AS gl FROM lng JOIN edg USING (series_id) GROUP BY 1, 2, 3, 4),
gns AS (SELECT *, all_n - nl AS nr, all_g - gl AS gr, gl * gl / nl + (all_g - gl) * (all_g - gl) / (all_n - nl) - all_g * all_g / all_n AS gain FROM cnd JOIN tot USING (series_id, origin) WHERE nl >= 3 AND all_n - nl >= 3),
top AS (SELECT * FROM gns WHERE gain > 1e-9 * (1 + all_g * all_g / all_n) QUALIFY row_number() OVER (PARTITION BY series_id, origin ORDER BY gain DESC, f, e) = 1),
st AS (SELECT b.series_id, b.origin, base, c, s, tot.all_n, tot.all_g, f, e, nl, gl, nr, gr, x.target AS p1, y.target AS p2 FROM bas b JOIN num USING (series_id) JOIN tot ON tot.series_id = b.series_id AND tot.origin = b.origin
  LEFT JOIN top ON top.series_id = b.series_id AND top.origin = b.origin JOIN ok x ON x.series_id = b.series_id AND x.pos = b.origin - 1 JOIN ok y ON y.series_id = b.series_id AND y.pos = b.origin - 2),
""" + ",\n".join([_step(1, "p1", "p2", "st"), _step(2, "y1", "p1", "f1"), _step(3, "y2", "y1", "f2")])  # fmt: skip


@query(
    "one_split_refit",
    with_sql(MONTHLY, POS, SPLIT, FIT, ORG, ONE_SPLIT, tail="SELECT org.series_id, org.origin, step, round(CASE step WHEN 1 THEN y1 WHEN 2 THEN y2 ELSE y3 END, 4) AS yhat FROM org JOIN f3 USING (series_id, origin)"),
)
def one_split_refit(spark, sf):
    """The best single split of every history, forecasts fed back into its lags."""
    return _predicted(B.boosted_forecast(_parts(monthly(spark, sf)), SPEC, SPLIT_ONCE), 4)


def _scored(spark, sf, shape, name):
    panel = monthly(spark, sf)
    parts = _parts(panel)
    scale = V.mase_scale(parts.filter("split = 'train'"), 12)
    scores = V.forecast_metrics(B.boosted_forecast(parts, SPEC, shape), scale).select(KEY, "n_predictions", "mae", "mase")
    scores = J.accounted(scores, panel, SPEC).withColumn("model", F.lit(name)).withColumn("n_predictions", F.coalesce("n_predictions", F.lit(0).cast("bigint")))
    return rounded(scores, ["mae", "mase"])


@query("boosted_rolling_backtest")
def boosted_rolling_backtest(spark, sf):
    """Boosted trees refitted at every origin, stopped by the end of each history."""
    return _scored(spark, sf, BOOSTED, "boosted_trees")


@query("forest_rolling_backtest")
def forest_rolling_backtest(spark, sf):
    """A forest refitted at every origin."""
    return _scored(spark, sf, FOREST, "random_forest")


@query("boosted_rounds")
def boosted_rounds(spark, sf):
    """Rounds that early stopping keeps at every origin."""
    return B.tree_fits(B.fit_trees(_parts(monthly(spark, sf)), SPEC, BOOSTED), BOOSTED)
