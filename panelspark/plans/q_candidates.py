"""Candidate configurations, identities, readers and sinks."""

from __future__ import annotations

import math
import os
import uuid

from pyspark.sql import functions as F

from ..functions import identity as I
from ..functions import text as X
from ..operators import candidates as C
from ..operators import diagnostics as D
from ..operators import split as J
from ..operators.lineage import cut, shared_folder, stored
from ..sources import results as W
from ..sources import tables as R
from .panels import DAILY, HOURLY, MONTHLY, POS, SPLIT, daily, hourly, monthly, table, with_sql
from .q_documents import RAW, VALID, good_documents
from .q_ledger import MODELS, TRIALS, trials
from .q_panel import FREQ, SPEC, rounded
from .registry import query

KEY = "series_id"
#: Folders that one task writes.
RUNS_PER_TASK = 256

# ------------------------------------------------------------------ hyper-parameter rules


def candidates(spark, sf):
    """One candidate per line item: a model's defaults with one parameter changed, dropped or added."""
    li = table(spark, sf, "lineitem")
    model = F.element_at(F.array(*[F.lit(m) for m in MODELS]), (F.col("l_partkey") % 24 + 1).cast("int"))
    rows = li.select(
        F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("bigint"), F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("candidate_id"),
        model.alias("model"), F.col("l_linenumber").alias("_line"), (F.col("l_quantity").cast("int") % 6).alias("_twist"),
    )
    known = C.defaults_table(spark).select("model", F.col("hyperparameters").alias("_d"))
    rows = rows.join(F.broadcast(known), "model")
    entries = F.map_entries("_d")
    at = (F.col("_line") % F.size("_d")).cast("int")
    value = F.when(F.col("_twist") == 1, "-5").when(F.col("_twist") == 2, "abc").when(F.col("_twist") == 5, "0")
    changed = F.transform(entries, lambda e, i: F.struct(e["key"].alias("key"), F.when(i == at, F.coalesce(value, e["value"])).otherwise(e["value"]).alias("value")))
    dropped = F.filter(changed, lambda e, i: (i != at) | (F.col("_twist") != 3))
    added = F.when(F.col("_twist") == 4, F.concat(dropped, F.array(F.struct(F.lit("bogus").alias("key"), F.lit("1").alias("value"))))).otherwise(dropped)
    return rows.select("candidate_id", "model", F.map_from_entries(added).alias("hyperparameters"))


def _q(v):
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, (int, float)):
        return f"{v}::DOUBLE"
    if isinstance(v, list):
        return f"{v}::VARCHAR[]"
    return f"'{v}'"


_PLACE: dict = {}
_ROWS = []
for _r in C.RULES:
    _PLACE[_r[0]] = _PLACE.get(_r[0], -1) + 1
    _ROWS.append(f"({', '.join(_q(v) for v in _r)}, {_PLACE[_r[0]]})")
RULED = "rul(model, name, kind, words, low, high, low_open, high_open, required, dflt, place) AS (VALUES " + ", ".join(_ROWS) + f"""),
cnt AS (SELECT model, count(*) AS k FROM rul GROUP BY 1),
cnd AS (SELECT concat_ws('/', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::BIGINT, CAST(round(l_extendedprice * 100) AS BIGINT)) AS candidate_id, {MODELS}[l_partkey % 24 + 1] AS model, l_linenumber AS line, l_quantity::INT % 6 AS twist FROM lineitem),
prm AS (SELECT candidate_id, c.model, r.name, CASE WHEN r.place = line % k THEN CASE twist WHEN 1 THEN '-5' WHEN 2 THEN 'abc' WHEN 5 THEN '0' ELSE dflt END ELSE dflt END AS value, twist, r.place = line % k AS hit,
    kind, words, low, high, low_open, high_open, required FROM cnd c JOIN cnt USING (model) JOIN rul r USING (model)),
bad AS (SELECT candidate_id, model, name, CASE WHEN list_contains(words, value) THEN NULL WHEN kind = 'enum' THEN 'not_in_enum' WHEN kind = 'boolean' THEN CASE WHEN value NOT IN ('true', 'false') THEN 'not_boolean' END
    WHEN kind = 'list' THEN CASE WHEN NOT regexp_matches(value, '^[0-9]+(;[0-9]+)*$') OR value = '0' THEN 'bad_list' END
    WHEN kind = 'integer' AND NOT regexp_matches(value, '^-?[0-9]+$') THEN 'not_integer' WHEN kind = 'number' AND TRY_CAST(value AS DOUBLE) IS NULL THEN 'not_a_number'
    WHEN TRY_CAST(value AS DOUBLE) < low OR (low_open AND TRY_CAST(value AS DOUBLE) <= low) THEN 'below_minimum' WHEN TRY_CAST(value AS DOUBLE) > high OR (high_open AND TRY_CAST(value AS DOUBLE) >= high) THEN 'above_maximum' END AS problem
  FROM prm WHERE NOT (hit AND twist = 3)
  UNION ALL SELECT candidate_id, model, 'bogus', 'unknown_parameter' FROM cnd WHERE twist = 4
  UNION ALL SELECT candidate_id, model, name, 'missing_parameter' FROM prm WHERE hit AND twist = 3 AND required),
wid AS (SELECT candidate_id, model, max(value) FILTER (name = 'seasonal') AS sea, max(value) FILTER (name = 'seasonal_periods') AS sp, max(value) FILTER (name = 'nhead') AS nh, max(value) FILTER (name = 'hidden_size') AS hs, max(value) FILTER (name = 'n_head') AS n2,
    max(value) FILTER (name = 'seasonal_order.m') AS m, max(value) FILTER (name = 'seasonal_order.P') AS sp1, max(value) FILTER (name = 'seasonal_order.D') AS sd1, max(value) FILTER (name = 'seasonal_order.Q') AS sq1
  FROM prm WHERE NOT (hit AND twist = 3) GROUP BY 1, 2),
crs AS (SELECT candidate_id, model, '' AS name, CASE WHEN model = 'ETS' AND sea = 'null' AND coalesce(sp, 'null') <> 'null' THEN 'periods_without_season' WHEN model = 'ETS' AND sea <> 'null' AND coalesce(sp, 'null') = 'null' THEN 'season_without_periods'
    WHEN model = 'SARIMA' AND TRY_CAST(m AS INT) = 0 AND (TRY_CAST(sp1 AS INT) > 0 OR TRY_CAST(sd1 AS INT) > 0 OR TRY_CAST(sq1 AS INT) > 0) THEN 'season_without_periods' WHEN model = 'SARIMA' AND TRY_CAST(m AS INT) = 1 THEN 'period_of_one'
    WHEN model = 'Reformer' AND 32 % nullif(TRY_CAST(nh AS INT), 0) <> 0 THEN 'heads_do_not_divide' WHEN model IN ('Autoformer', 'Informer', 'FEDformer', 'PatchTST') AND TRY_CAST(hs AS INT) % nullif(TRY_CAST(n2 AS INT), 0) <> 0 THEN 'heads_do_not_divide' END AS problem FROM wid)"""


@query(
    "hyperparameter_rules",
    with_sql(RULED, tail="SELECT candidate_id, model, name, problem, count(*) AS times FROM (SELECT * FROM bad UNION ALL SELECT * FROM crs) WHERE problem IS NOT NULL GROUP BY 1, 2, 3, 4"),
)
def hyperparameter_rules(spark, sf):
    out = C.hyperparameter_violations(candidates(spark, sf), C.rule_table(spark))
    return out.groupBy("candidate_id", "model", "name", "problem").agg(F.count(F.lit(1)).alias("times"))


@query(
    "suggestion_grid",
    f"""WITH r AS (SELECT DISTINCT l_suppkey AS run_id FROM lineitem), a AS (SELECT unnest({C.SUGGESTIONS['KNN']['n_neighbors']}) AS n_neighbors), b AS (SELECT unnest({C.SUGGESTIONS['KNN']['weights']}) AS weights), c AS (SELECT unnest({C.SUGGESTIONS['KNN']['p']}) AS p)
    SELECT run_id, 'KNN' AS model, n_neighbors, weights, p FROM r, a, b, c""",
)
def suggestion_grid(spark, sf):
    runs = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("run_id")).distinct()
    out = C.suggestion_grid(runs, "KNN")
    return out.select("run_id", "model", *[F.element_at("hyperparameters", k).alias(k) for k in C.SUGGESTIONS["KNN"]])


# ------------------------------------------------------------------ chains

STEP = "name string, scope string, method string, lags array<int>, windows array<int>"


def _step(name, scope=None, method=None, lags=None, windows=None):
    none = lambda t: F.lit(None).cast(t)
    arr = lambda v: F.array(*[F.lit(x) for x in v]).cast("array<int>") if v is not None else none("array<int>")
    return F.struct(F.lit(name).alias("name"), (F.lit(scope) if scope else none("string")).alias("scope"), (F.lit(method) if method else none("string")).alias("method"), arr(lags).alias("lags"), arr(windows).alias("windows"))


CHAINS = [
    ("ok_features", [("replace_outliers",), ("lag_features", None, None, [1, 3]), ("Z-Score",)]),
    ("ok_target", [("log_transform", None, "log1p"), ("minmax scaler", "target")]),
    ("late_outliers", [("log_transform",), ("replace_outliers",)]),
    ("two_treatments", [("log_transform",), ("boxcox_transform",)]),
    ("scaler_first", [("standard_scaler",), ("lag_features", None, None, [1])]),
    ("scaler_alone", [("min-max scaler", "features")]),
    ("bad_lag", [("lag_features", None, None, [0, 2])]),
    ("unknown", [("seasonal_decompose",)]),
    ("twice", [("lag_features", None, None, [1]), ("zscore",), ("minmaxscaler",)]),
    ("bad_window", [("rolling_features", None, None, None, [1])]),
    ("empty", []),
]
# what each chain is called wrong for, by kind of model (feature-scaled, target-scaled, history-only, other)
VERDICTS = {
    "ok_features": (None, "features_not_consumed", "features_not_consumed", None),
    "ok_target": ("features_required", None, None, None),
    "late_outliers": ("outliers_not_first",) * 4,
    "two_treatments": ("target_treatments_exclusive",) * 4,
    "scaler_first": ("scaler_before_features", "features_not_consumed", "features_not_consumed", "scaler_before_features"),
    "scaler_alone": ("scaler_without_features", "feature_scaler_not_allowed", "scaler_without_features", "scaler_without_features"),
    "bad_lag": ("bad_lags",) * 4,
    "unknown": ("unknown_transformation",) * 4,
    "twice": ("scaler_repeated", "features_not_consumed", "features_not_consumed", "scaler_repeated"),
    "bad_window": ("bad_windows",) * 4,
    "empty": ("features_required", "target_scaler_required", None, None),
}
_KIND = "CASE WHEN model IN ('SVR', 'KNN', 'ElasticNet', 'MLP') THEN 1 WHEN model IN ('LSTM', 'N-BEATS', 'DLinear', 'Reformer', 'Autoformer', 'Informer', 'FEDformer', 'N-HiTS', 'PatchTST', 'TimesNet', 'TiDE') THEN 2 WHEN model IN ('ARIMA', 'SARIMA', 'ETS') THEN 3 ELSE 4 END"


@query(
    "chain_rules",
    f"""WITH t AS (SELECT {MODELS}[l_partkey % 24 + 1] AS model, {[c for c, _ in CHAINS]}[(l_orderkey + l_linenumber) % {len(CHAINS)} + 1] AS chain FROM lineitem),
    v(chain, problems) AS (VALUES {', '.join(f"('{c}', [{', '.join('NULL' if p is None else repr(p) for p in ps)}]::VARCHAR[])" for c, ps in VERDICTS.items())})
    SELECT model, chain, problems[{_KIND}] AS problem, count(*) AS candidates FROM t JOIN v USING (chain) GROUP BY ALL""",
)
def chain_rules(spark, sf):
    at = (F.col("l_orderkey") + F.col("l_linenumber")) % len(CHAINS)
    steps, name = None, None
    for i, (label, chain) in enumerate(CHAINS):
        arr = F.array(*[_step(*s) for s in chain]) if chain else F.from_json(F.lit("[]"), f"array<struct<{STEP.replace(' string', ':string').replace(' array', ':array')}>>")
        steps = F.when(at == i, arr) if steps is None else steps.when(at == i, arr)
        name = F.when(at == i, label) if name is None else name.when(at == i, label)
    model = F.element_at(F.array(*[F.lit(m) for m in MODELS]), (F.col("l_partkey") % 24 + 1).cast("int"))
    rows = table(spark, sf, "lineitem").select(model.alias("model"), name.alias("chain"), steps.alias("steps"))
    rows = rows.withColumn("problem", C.chain_problem(F.col("model"), F.col("steps")))
    return rows.groupBy("model", "chain", "problem").agg(F.count(F.lit(1)).alias("candidates"))


NAMES = ["Z-Score", " standard scaler ", "min_max_scaler", "LAG_FEATURES", "boxcox_transform", "pca", "minmaxscaler", "zscore", "log_transform", "wavelet"]
KNOWN = ["standard_scaler", "standard_scaler", "minmax_scaler", "lag_features", "boxcox_transform", None, "minmax_scaler", "standard_scaler", "log_transform", None]


@query(
    "transformation_names",
    f"SELECT {NAMES}[l_partkey % {len(NAMES)} + 1] AS name, [{', '.join('NULL' if k is None else repr(k) for k in KNOWN)}]::VARCHAR[][l_partkey % {len(NAMES)} + 1] AS canonical, count(*) AS steps FROM lineitem GROUP BY 1, 2".replace("]::VARCHAR[][", "][")
)
def transformation_names(spark, sf):
    name = F.element_at(F.array(*[F.lit(n) for n in NAMES]), (F.col("l_partkey") % len(NAMES) + 1).cast("int"))
    rows = table(spark, sf, "lineitem").select(name.alias("name"))
    return rows.groupBy("name", X.canonical_preprocessing(F.col("name")).alias("canonical")).agg(F.count(F.lit(1)).alias("steps"))


# ------------------------------------------------------------------ lags and windows

# diagnostics of one supplier's series
DIAGS = """dg AS (SELECT s_suppkey AS id, (s_suppkey % 5)::INT AS horizon, CASE WHEN s_suppkey % 4 > 0 THEN (s_suppkey % 37)::INT END AS suggested, CASE WHEN s_suppkey % 3 > 0 THEN (s_suppkey % 53)::INT END AS season,
  (30 + s_suppkey % 90)::INT AS n_train, ['D', 'W-SUN', 'MS', 'QS', 'h'][s_suppkey % 5 + 1] AS freq FROM supplier),
lg AS (SELECT *, list_filter(list_distinct([1, CASE WHEN horizon > 1 THEN least(horizon, 3) END, CASE WHEN suggested > 1 THEN suggested END, CASE WHEN season > 1 THEN season END]), lambda v: v IS NOT NULL AND v >= 1 AND v <= greatest(1, n_train // 3)) AS lags FROM dg)"""


def _diags(spark, sf):
    s = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(
        s.alias("id"), (s % 5).cast("int").alias("horizon"), F.when(s % 4 > 0, (s % 37).cast("int")).alias("suggested"), F.when(s % 3 > 0, (s % 53).cast("int")).alias("season"),
        (30 + s % 90).cast("int").alias("n_train"), F.element_at(F.array(*[F.lit(f) for f in ("D", "W-SUN", "MS", "QS", "h")]), (s % 5 + 1).cast("int")).alias("freq"),
    )


_c = F.col


def _lags():
    return C.default_lags(_c("horizon"), _c("suggested"), _c("season"), _c("n_train"))


@query("default_lags", with_sql(DIAGS, tail="SELECT id, array_to_string(list_sort(lags), ',') AS lags FROM lg"))
def default_lags(spark, sf):
    return _diags(spark, sf).select("id", F.array_join(F.array_sort(_lags()), ",").alias("lags"))


@query(
    "default_windows",
    with_sql(DIAGS, """wn AS (SELECT *, list_filter(list_concat([CASE WHEN season > 1 THEN season END, CASE WHEN suggested > 1 THEN suggested END, CASE WHEN horizon > 1 THEN greatest(2, least(horizon, 6)) END],
        CASE freq[1] WHEN 'D' THEN [7, 14, 30] WHEN 'W' THEN [4, 13, 26] WHEN 'Q' THEN [2, 4, 8] ELSE [3, 6, 12] END), lambda v: v IS NOT NULL AND v >= 2 AND v <= greatest(2, n_train // 3)) AS w FROM dg),
      un AS (SELECT id, unnest(w) AS v, generate_subscripts(w, 1) AS i FROM wn), fi AS (SELECT id, v, min(i) AS i FROM un GROUP BY 1, 2), rk AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY i) AS r FROM fi)""",
             tail="SELECT wn.id, coalesce((SELECT string_agg(v, ',' ORDER BY i) FROM rk WHERE rk.id = wn.id AND r <= 3), '3') AS windows FROM wn"),
)
def default_windows(spark, sf):
    w = C.default_windows(_c("freq"), _c("horizon"), _c("suggested"), _c("season"), _c("n_train"))
    return _diags(spark, sf).select("id", F.array_join(w, ",").alias("windows"))


@query(
    "lag_repair",
    with_sql(DIAGS, """gv AS (SELECT *, CASE id % 4 WHEN 0 THEN [] WHEN 1 THEN [1] WHEN 2 THEN range(1, greatest(1, coalesce(suggested, 1)) + 1) ELSE [99] END AS given FROM lg),
      ac AS (SELECT *, CASE WHEN len(given) = 0 THEN 'filled' WHEN len(list_filter(given, lambda v: NOT list_contains(lags, v))) = 0 THEN 'kept' WHEN id % 4 = 2 AND suggested > 1 AND list_contains(lags, suggested) THEN 'collapsed' ELSE 'rejected' END AS action FROM gv)""",
             tail="SELECT id, action, CASE action WHEN 'filled' THEN array_to_string(list_sort(lags), ',') WHEN 'kept' THEN array_to_string(list_sort(given), ',') WHEN 'collapsed' THEN array_to_string(list_sort(list_filter(lags, lambda v: list_contains(given, v))), ',') END AS lags FROM ac"),
)
def lag_repair(spark, sf):
    rows = _diags(spark, sf).withColumn("allowed", _lags())
    k = _c("id") % 4
    given = (
        F.when(k == 0, F.array().cast("array<int>")).when(k == 1, F.slice("allowed", 1, 1))
        .when(k == 2, F.sequence(F.lit(1), F.greatest(F.lit(1), F.coalesce("suggested", F.lit(1))))).otherwise(F.array(F.lit(99)))
    )
    fixed, action = C.repair_lags(_c("given"), _c("allowed"), _c("suggested"))
    out = rows.withColumn("given", given)
    return out.select("id", action.alias("action"), F.array_join(F.array_sort(fixed), ",").alias("lags"))


# ------------------------------------------------------------------ requests and target constraints


@query(
    "target_constraints",
    with_sql(DAILY, "shifted AS (SELECT series_id, target - CASE series_id WHEN 'A' THEN 0 WHEN 'N' THEN 400 ELSE min(target) OVER (PARTITION BY series_id) END AS target FROM panel)",
             tail="""SELECT series_id, round(min(target), 6) AS minimum, round(max(target), 6) AS maximum, bool_or(target < 0) AS contains_negative, bool_or(target = 0) AS contains_zero, bool_and(target > 0) AS strictly_positive,
               min(target) > -1 AS log1p_supported, CASE WHEN bool_and(target > 0) THEN 'add,mul,none' ELSE 'add,none' END AS ets_components FROM shifted GROUP BY 1"""),
)
def target_constraints(spark, sf):
    panel = daily(spark, sf)
    low = panel.groupBy(KEY).agg(F.min("target").alias("_low"))
    off = F.when(_c(KEY) == "A", 0.0).when(_c(KEY) == "N", 400.0).otherwise(_c("_low"))
    return rounded(C.target_constraints(panel.join(low, KEY).withColumn("target", _c("target") - off)), ["minimum", "maximum"])


REQ = f"""rq AS (SELECT l_orderkey, l_linenumber, {MODELS}[l_partkey % 24 + 1] AS model, CASE WHEN l_quantity > 45 THEN 'ARIMA' ELSE {MODELS}[l_partkey % 24 + 1] END AS requested, l_linestatus = 'F' AS refine, l_quantity::BIGINT AS q,
  CASE l_returnflag WHEN 'A' THEN ['log_transform'] WHEN 'R' THEN ['boxcox_transform'] ELSE ['lag_features'] END AS steps, CASE WHEN l_linenumber = 1 THEN 'log1p' WHEN l_linenumber = 2 THEN 'raw' END AS want, l_suppkey % 3 > 0 AS positive FROM lineitem)"""


@query(
    "request_rules",
    with_sql(REQ, tail="""SELECT model, problem, count(*) AS candidates FROM (SELECT model, CASE WHEN model <> requested THEN CASE WHEN refine THEN 'wrong_model_in_refine' ELSE 'wrong_model' END
      WHEN model IN ('N-BEATS', 'LSTM', 'DLinear', 'Reformer') AND q + 3 > 40 THEN 'memory_longer_than_training' WHEN model = 'ETS' AND q % 2 = 0 AND NOT positive THEN 'multiplicative_needs_positive_target'
      WHEN want = 'log1p' AND NOT positive THEN 'log_not_supported' WHEN want = 'log1p' AND list_contains(steps, 'boxcox_transform') THEN 'other_treatment' WHEN want = 'log1p' AND NOT list_contains(steps, 'log_transform') THEN 'log_missing'
      WHEN want = 'raw' AND (list_contains(steps, 'boxcox_transform') OR list_contains(steps, 'log_transform')) THEN 'raw_target_required' WHEN refine AND q = 7 THEN 'unchanged_configuration' END AS problem FROM rq) GROUP BY 1, 2"""),
)
def request_rules(spark, sf):
    model = F.element_at(F.array(*[F.lit(m) for m in MODELS]), (_c("l_partkey") % 24 + 1).cast("int"))
    q = _c("l_quantity").cast("bigint")
    memory = F.when(_c("model") == "N-BEATS", "lookback").otherwise("lag")
    rows = table(spark, sf, "lineitem").withColumn("model", model).select(
        "model", F.when(q > 45, "ARIMA").otherwise(_c("model")).alias("requested_model"), (_c("l_linestatus") == "F").alias("refine"),
        F.create_map(memory, q.cast("string"), F.lit("trend"), F.when(q % 2 == 0, "mul").otherwise("add")).alias("hyperparameters"),
        F.array(F.when(_c("l_returnflag") == "A", "log_transform").when(_c("l_returnflag") == "R", "boxcox_transform").otherwise("lag_features")).alias("steps"),
        F.when(_c("l_linenumber") == 1, "log1p").when(_c("l_linenumber") == 2, "raw").alias("required_treatment"), F.lit(40).alias("n_train"), F.lit(3).alias("horizon"),
        (_c("l_suppkey") % 3 > 0).alias("strictly_positive"), (_c("l_suppkey") % 3 > 0).alias("log1p_supported"),
        q.cast("string").alias("signature"), F.lit("7").alias("best_signature"),
    )
    return rows.withColumn("problem", C.request_problem()).groupBy("model", "problem").agg(F.count(F.lit(1)).alias("candidates"))


# ------------------------------------------------------------------ identities


def _signed(spark, sf):
    line, q = _c("l_linenumber").cast("string"), _c("l_quantity").cast("int").cast("string")
    model = F.element_at(F.array(*[F.lit(m) for m in MODELS]), (_c("l_partkey") % 24 + 1).cast("int"))
    hp = F.create_map(F.lit("v"), q, F.lit("error"), F.lit('"add"'), F.lit("a"), line)
    step = F.struct(F.lit("lag_features").alias("name"), F.create_map(F.lit("lags"), F.concat(F.lit("[1,"), line, F.lit("]")), F.lit("history_tail"), F.lit("[9]"), F.lit("_note"), F.lit('"x"')).alias("parameters"))
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", model.alias("model"), hp.alias("hp"), F.array(step).alias("steps"))
    return rows.withColumn("signature", I.configuration_signature(_c("model"), _c("hp"), _c("steps")))


SIGN = f"""sg AS (SELECT *, {MODELS}[l_partkey % 24 + 1] AS model FROM lineitem),
si AS (SELECT *, '{{"hyperparameters":{{"a":' || l_linenumber || CASE WHEN model = 'ETS' THEN '' ELSE ',"error":"add"' END || ',"v":' || l_quantity::INT || '}},"model":"' || model || '","preprocessing":[{{"name":"lag_features","parameters":{{"lags":[1,' || l_linenumber || ']}}}}]}}' AS signature FROM sg)"""


@query("configuration_signatures", with_sql(SIGN, tail="SELECT signature, count(*) AS candidates FROM si GROUP BY 1"))
def configuration_signatures(spark, sf):
    return _signed(spark, sf).groupBy("signature").agg(F.count(F.lit(1)).alias("candidates"))


@query(
    "candidate_identities",
    with_sql(SIGN, tail="""SELECT signature, l_suppkey AS dataset, ('0x' || substr(sha256('data-' || l_suppkey || '|42|' || signature), 1, 8))::BIGINT AS seed, 'candidate-' || substr(sha256(signature || '|42|0'), 1, 20) AS candidate_id, count(*) AS candidates FROM si GROUP BY 1, 2"""),
)
def candidate_identities(spark, sf):
    rows = _signed(spark, sf).groupBy("signature", _c("l_suppkey").alias("dataset")).agg(F.count(F.lit(1)).alias("candidates"))
    name = F.concat(F.lit("data-"), _c("dataset").cast("string"))
    return rows.withColumn("seed", I.candidate_seed(name, F.lit(42), _c("signature"))).withColumn("candidate_id", I.candidate_id(_c("signature"), F.lit(42), F.lit(0)))


MESSAGES = ["Configuration ALREADY tested", "bad   preprocessing\nchain", "Invalid model X", "You are in refine mode", "Hyperparameters outside the catalog", "Unknown preprocessing transformation: pca", "something else"]
CODES = ["duplicate_candidate", "invalid_preprocessing_contract", "ineligible_model", "wrong_model_in_refine", "invalid_model_contract", "invalid_preprocessing_contract", "no_valid_configuration"]
_MSG = "[" + ", ".join("'" + m.replace("\n", "' || chr(10) || '") + "'" for m in MESSAGES) + "]"


@query(
    "failure_messages",
    with_sql(TRIALS, f"m AS (SELECT *, {_MSG}[step % 7 + 1] AS message, step % 7 + 1 AS i FROM trials WHERE error_type IS NOT NULL)",
             tail=f"SELECT signature || '|' || error_type || '|' || lower(regexp_replace(message, '\\s+', ' ', 'g')) AS fingerprint, {CODES}[i] AS code, i = 6 AS non_retryable, count(*) AS failures FROM m GROUP BY ALL"),
)
def failure_messages(spark, sf):
    message = F.element_at(F.array(*[F.lit(m) for m in MESSAGES]), (_c("step") % 7 + 1).cast("int"))
    rows = trials(spark, sf).filter(_c("error_type").isNotNull()).withColumn("message", message)
    out = rows.select(I.failure_fingerprint(_c("signature"), _c("error_type"), _c("message")).alias("fingerprint"), I.rejection_code(_c("message")).alias("code"), I.non_retryable(_c("message")).alias("non_retryable"))
    return out.groupBy("fingerprint", "code", "non_retryable").agg(F.count(F.lit(1)).alias("failures"))


@query(
    "dataset_fingerprints",
    with_sql(DAILY, POS, tail="""SELECT series_id, count(*) AS rows, sum(('0x' || substr(md5(pos || '|' || strftime(date, '%Y-%m-%d') || '|' || CAST(round(target * 1e6) AS BIGINT)), 1, 8))::BIGINT)::BIGINT AS fingerprint FROM pos GROUP BY 1"""),
)
def dataset_fingerprints(spark, sf):
    from ..operators.ordered import with_position

    rows = with_position(daily(spark, sf), KEY, "date", n=None)
    digest = I.row_digest(_c("pos"), F.date_format("date", "yyyy-MM-dd"), F.round(_c("target") * 1e6).cast("bigint"))
    return rows.groupBy(KEY).agg(F.count(F.lit(1)).alias("rows"), F.sum(digest).alias("fingerprint"))


@query(
    "partition_fingerprint_audit",
    with_sql(MONTHLY, POS, SPLIT, tail="""SELECT series_id, split, count(*) AS size, min(date) AS start_date, max(date) AS end_date,
      sum(('0x' || substr(md5(pos || '|' || strftime(date, '%Y-%m-%d') || '|' || CAST(round(target * 1e8) AS BIGINT)), 1, 8))::BIGINT)::BIGINT AS fingerprint, 'date,target' AS columns FROM parts
      WHERE n_train >= 30 AND n_val >= 3 AND n_test >= 3 GROUP BY 1, 2"""),
)
def partition_fingerprint_audit(spark, sf):
    parts = J.chronological(monthly(spark, sf), SPEC)
    digest = I.row_digest(_c("pos"), F.date_format("date", "yyyy-MM-dd"), F.round(_c("target") * 1e8).cast("bigint"))
    used = ",".join(c for c in parts.columns if c in ("date", "target"))
    return parts.groupBy(KEY, "split").agg(
        F.count(F.lit(1)).alias("size"), F.min("date").alias("start_date"), F.max("date").alias("end_date"), F.sum(digest).alias("fingerprint"), F.lit(used).alias("columns")
    )


# ------------------------------------------------------------------ contracts on candidate JSON

_JSONS = ['{"model":"KNN","hp":{"k":3}}', '{"hp":{"Future_Covariates":["x"]}}', '{"steps":[{"name":"lag","on":"D2"}]}', '{"note":"uses regressors well"}', '{"a":{"my_regressor_x":1}}', '{"list":["d4","ok"]}']
_FOUND = [0, 1, 1, 0, 1, 1]
_TESTS = ['{"a":1}', '{"x":{"test_score":2}}', '{"audit":{"test_target_modified":false}}', '{"y_true_test":[1]}', '{"latest":3}', '{"Test_metrics":{"test_x":1}}']
_HELD = [0, 1, 0, 1, 0, 2]


@query(
    "outside_input_contract",
    f"SELECT l_suppkey AS run_id, l_partkey % 6 AS kind, count(*) AS candidates, sum({_FOUND}[l_partkey % 6 + 1])::BIGINT AS violations FROM lineitem GROUP BY 1, 2",
)
def outside_input_contract(spark, sf):
    json = F.element_at(F.array(*[F.lit(j) for j in _JSONS]), (_c("l_partkey") % 6 + 1).cast("int"))
    rows = table(spark, sf, "lineitem").select(_c("l_suppkey").alias("run_id"), (_c("l_partkey") % 6).alias("kind"), F.size(I.outside_inputs(json)).cast("bigint").alias("v"))
    return rows.groupBy("run_id", "kind").agg(F.count(F.lit(1)).alias("candidates"), F.sum("v").alias("violations"))


@query(
    "held_out_field_guard",
    f"SELECT l_suppkey AS run_id, l_partkey % 6 AS kind, count(*) AS configurations, sum({_HELD}[l_partkey % 6 + 1])::BIGINT AS forbidden FROM lineitem GROUP BY 1, 2",
)
def held_out_field_guard(spark, sf):
    json = F.element_at(F.array(*[F.lit(j) for j in _TESTS]), (_c("l_partkey") % 6 + 1).cast("int"))
    rows = table(spark, sf, "lineitem").select(_c("l_suppkey").alias("run_id"), (_c("l_partkey") % 6).alias("kind"), F.size(I.test_fields(json)).cast("bigint").alias("v"))
    return rows.groupBy("run_id", "kind").agg(F.count(F.lit(1)).alias("configurations"), F.sum("v").alias("forbidden"))


@query(
    "feature_provenance",
    """SELECT series_id, count(*) AS rows, 'lag_1,lag_7,rolling_mean_3,month_sin,month_cos,time_idx' AS features, 'month_sin,month_cos,time_idx' AS calendar, 'timestamp_only' AS calendar_source
    FROM (SELECT l_returnflag AS series_id, CAST(l_shipdate AS DATE) AS d FROM lineitem GROUP BY 1, 2) GROUP BY 1""",
)
def feature_provenance(spark, sf):
    from ..operators import features as E
    from ..operators.ordered import with_position

    rows = E.add_calendar(E.add_past_features(with_position(daily(spark, sf), KEY, "date", n=None), (1, 7), (3,)), quarter=False)
    record = R.numeric_provenance(R.model_features(rows))
    return rows.groupBy(KEY).agg(F.count(F.lit(1)).alias("rows")).select(
        KEY, "rows", F.lit(",".join(record["features"])).alias("features"), F.lit(",".join(record["calendar"])).alias("calendar"), F.lit(record["calendar_source"]).alias("calendar_source")
    )


# ------------------------------------------------------------------ readers and sinks


def _fresh(spark, name):
    return os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")


@query(
    "series_csv_round_trip",
    with_sql(MONTHLY, tail="SELECT 'd' || substr(series_id, 1, 1) AS series_id, date, round(target, 8) AS target FROM panel"),
)
def series_csv_round_trip(spark, sf):
    """The monthly panel as one CSV folder per series, read back through the reader."""
    panel = monthly(spark, sf).select(
        F.concat(F.lit("d"), F.substring(KEY, 1, 1)).alias("series"), F.date_format("date", "yyyy-MM-dd").alias(" Date "), _c("target").alias("OT"), F.lit(7).alias("D1"), F.monotonically_increasing_id().alias("index")
    )
    path = _fresh(spark, "series")
    panel.write.partitionBy("series").csv(path, header=True)
    raw = spark.read.csv(path, header=True)
    return rounded(R.as_series(raw, keys=["series"]).select(_c("series").alias(KEY), _c("date").cast("date").alias("date"), "target"), ["target"], 8)


@query(
    "series_file_discovery",
    with_sql(MONTHLY, tail="SELECT count(*) AS rows, min(date) AS first_date, max(date) AS last_date, round(sum(target), 6) AS total FROM panel"),
)
def series_file_discovery(spark, sf):
    path = _fresh(spark, "files")
    monthly(spark, sf).select(F.date_format("date", "yyyyMMdd").alias("ds"), _c("target").alias("value")).write.csv(path, header=True)
    out = R.read_series(spark, path)
    return out.agg(F.count(F.lit(1)).alias("rows"), F.min("date").cast("date").alias("first_date"), F.max("date").cast("date").alias("last_date"), F.round(F.sum("target"), 6).alias("total"))


@query(
    "excluded_numeric_columns",
    "SELECT o_orderpriority AS series_id, count(*) AS rows, 'o_custkey,o_orderkey' AS excluded FROM orders GROUP BY 1",
)
def excluded_numeric_columns(spark, sf):
    raw = table(spark, sf, "orders").withColumnsRenamed({"o_orderdate": "Date", "o_totalprice": "Target"})
    names = ",".join(sorted(R.excluded_numeric_columns(raw)))
    return raw.groupBy(_c("o_orderpriority").alias(KEY)).agg(F.count(F.lit(1)).alias("rows"), F.lit(names).alias("excluded"))


WSTRIP = r"regexp_replace(text, '^[\s\x0B\x{85}\p{Z}]+|[\s\x0B\x{85}\p{Z}]+$', '', 'g')"


@query(
    "documents_from_files",
    f"""SELECT 'csv' AS kind, doc_id, source, md5({WSTRIP}) AS facts FROM documents WHERE lang IN ('en', 'fr') UNION ALL SELECT 'parquet', doc_id, source, md5({WSTRIP} || ' | ' || lang) FROM documents WHERE lang NOT IN ('en', 'fr')""",
)
def documents_from_files(spark, sf):
    """Two languages through CSV with the text in ``final_search``, the others through Parquet with known names."""
    d = table(spark, sf, "documents")
    latin = _c("lang").isin("en", "fr")
    day = F.date_format(F.date_add(F.lit("1995-01-01").cast("date"), (_c("doc_id") % 2400).cast("int")), "yyyy-MM-dd")
    csv, parquet = _fresh(spark, "docs-csv"), _fresh(spark, "docs-parquet")
    texts = d.select("doc_id", "source", "lang", _c("text"), day.alias("end_date"))
    texts.filter(latin).select(_c("doc_id").alias("id"), "source", _c("text").alias("Final_Search_1"), _c("lang").alias("note"), "end_date").write.option("quoteAll", True).option("escape", '"').csv(csv, header=True)
    texts.filter(~latin).select(_c("doc_id").alias("id"), "source", "text", _c("lang").alias("title"), "end_date").write.parquet(parquet)
    read = lambda df, kind, any_text: R.as_documents(R.normalize_columns(df), source=_c("source"), any_text=any_text, keys=["id"]).withColumn("kind", F.lit(kind))
    left = read(spark.read.csv(csv, header=True, multiLine=True, escape='"'), "csv", True).withColumn("id", _c("id").cast("bigint"))
    both = left.unionByName(read(spark.read.parquet(parquet), "parquet", False), allowMissingColumns=True)
    return both.select("kind", _c("id").alias("doc_id"), "source", F.md5("facts").alias("facts"))


@query(
    "document_sources_merged",
    with_sql(RAW, VALID, "u AS (SELECT *, CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 1 END AS priority FROM docs), r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY priority, date DESC, doc_id DESC) AS r FROM u)",
             tail="SELECT series_id, doc_id, priority FROM r WHERE r <= 120"),
)
def document_sources_merged(spark, sf):
    docs = good_documents(spark, sf)
    even = docs.filter(_c("doc_id") % 2 == 0)
    odd = docs.filter(_c("doc_id") % 2 == 1).drop("start_date")
    return R.fill_from(even, odd, 120).select(KEY, "doc_id", "priority")


@query(
    "run_summaries_written",
    with_sql(TRIALS, tail="""SELECT 'run_' || run_id || '_x' AS run_id, arg_min(model, (mase, step)) AS winning_model, round(min(mase), 6) AS best_validation_mase, count(mase) AS valid_training_count, NULL::VARCHAR AS stop_reason FROM trials WHERE mase IS NOT NULL GROUP BY trials.run_id"""),
)
def run_summaries_written(spark, sf):
    """Summaries written one folder per run and read back."""
    rows = trials(spark, sf).filter(_c("mase").isNotNull())
    results = rows.groupBy("run_id").agg(
        F.min_by("model", F.struct("mase", "step")).alias("winning_model"), F.min("mase").alias("best_validation_mase"), F.count("mase").alias("valid_training_count")
    )
    results = results.withColumn("run_id", F.concat(F.lit("..run "), _c("run_id").cast("string"), F.lit("/x?")))
    path = _fresh(spark, "runs")
    results = cut(results)
    # a folder per run: the tasks follow the number of runs
    W.write_runs(W.summary(results).repartition(max(8, math.ceil(results.count() / RUNS_PER_TASK)), "run_id"), path, "parquet")
    back = spark.read.parquet(path)
    return rounded(back.select("run_id", "winning_model", "best_validation_mase", "valid_training_count", "stop_reason"), ["best_validation_mase"])


@query(
    "trace_events",
    with_sql(TRIALS, tail="SELECT run_id, 'search-event-' || row_number() OVER (PARTITION BY run_id ORDER BY step) AS event_id, model AS event_type, step AS iteration FROM trials"),
)
def trace_events(spark, sf):
    new = _events(spark, sf)
    have = new.filter("arrival <= 100")
    first = W.events(have)
    later = W.events(new.filter("arrival > 100"), first)
    return first.unionByName(later).select("run_id", "event_id", "event_type", "iteration")


def _events(spark, sf):
    return trials(spark, sf).select(
        "run_id", _c("step").alias("arrival"), _c("model").alias("event_type"), F.lit("2024-01-01T00:00:00").alias("timestamp"), _c("step").alias("iteration"), F.lit("fuzzy").alias("influence_mode"),
        F.concat(F.lit('{"mase":'), F.coalesce(_c("mase").cast("string"), F.lit("null")), F.lit("}")).alias("payload"),
    )


@query(
    "trace_appended_again",
    with_sql(TRIALS, tail="SELECT run_id, step // 8 AS batch_id, 'search-event-' || row_number() OVER (PARTITION BY run_id ORDER BY step) AS event_id, model AS event_type, step AS iteration FROM trials"),
)
def trace_appended_again(spark, sf):
    """Events written in batches, the first delivered again with the others, all of them twice: each is there once."""
    path = _fresh(spark, "trace")
    new = stored(_events(spark, sf).withColumn("batch_id", F.floor(_c("arrival") / 8)))
    for batch in (new.filter("batch_id = 0"), new, new):
        W.append_events(batch, path)
    return W.stored(spark, path).select("run_id", "batch_id", "event_id", "event_type", "iteration")


@query(
    "run_outputs_appended",
    with_sql(TRIALS, tail="""SELECT 'history' AS kind, run_id, step, model AS name, round(mase, 6) AS value FROM trials
      UNION ALL SELECT 'manifest', run_id, count(*), 'fuzzy', NULL FROM trials GROUP BY run_id"""),
)
def run_outputs_appended(spark, sf):
    """Histories and manifests appended in parts that overlap, read back."""
    rows = stored(trials(spark, sf).select("run_id", "step", "model", "mase"))
    runs = rows.groupBy("run_id").agg(F.count(F.lit(1)).alias("maximum_valid_trainings")).withColumn("influence_mode", F.lit("fuzzy"))
    history, manifests = _fresh(spark, "history"), _fresh(spark, "manifests")
    for part in (rows.filter("step % 2 = 0"), rows, rows):
        W.append_once(part, history, ["run_id", "step"])
    for _ in range(2):
        W.append_once(W.manifest(runs), manifests, ["run_id"])
    told = W.stored(spark, history).select(F.lit("history").alias("kind"), "run_id", "step", _c("model").alias("name"), F.round("mase", 6).alias("value"))
    known = W.stored(spark, manifests)
    return told.unionByName(known.select(F.lit("manifest").alias("kind"), "run_id", _c("maximum_valid_trainings").alias("step"), _c("influence_mode").alias("name"), F.lit(None).cast("double").alias("value")))


@query(
    "run_manifests",
    "SELECT l_suppkey AS run_id, 42 AS seed, 'fuzzy' AS influence_mode, 30 AS maximum_valid_trainings, 3 AS forecast_horizon, count(*)::VARCHAR AS semantic_document_filtering FROM lineitem GROUP BY 1",
)
def run_manifests(spark, sf):
    runs = table(spark, sf, "lineitem").groupBy(_c("l_suppkey").alias("run_id")).agg(F.count(F.lit(1)).cast("string").alias("semantic_document_filtering"))
    runs = runs.withColumns({"seed": F.lit(42), "influence_mode": F.lit("fuzzy"), "maximum_valid_trainings": F.lit(30), "forecast_horizon": F.lit(3), "internal_note": F.lit("x")})
    return W.manifest(runs)


@query(
    "frequency_period_names",
    with_sql(HOURLY, FREQ, tail="SELECT series_id, round(b, 6) AS best_score, n FROM best"),
)
def frequency_period_names(spark, sf):
    return rounded(D.frequency_scores(hourly(spark, sf)).select(KEY, "best_score", "n"), ["best_score"])
