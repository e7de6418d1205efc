"""Candidate configurations: hyper-parameter rules, chain rules, defaults, repairs and request rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X

# fixed values: model, hyper-parameter (a dotted name is one place of a tuple), kind, words allowed beside numbers,
# lowest and highest value (of a list: length), whether either is itself excluded, whether it must be given, default
RULES = [
    ("ARIMA", "order.p", "integer", [], 0, 5, False, False, True, "2"),
    ("ARIMA", "order.d", "integer", [], 0, 2, False, False, True, "1"),
    ("ARIMA", "order.q", "integer", [], 0, 5, False, False, True, "2"),
    ("SARIMA", "order.p", "integer", [], 0, 5, False, False, True, "3"),
    ("SARIMA", "order.d", "integer", [], 0, 2, False, False, True, "0"),
    ("SARIMA", "order.q", "integer", [], 0, 5, False, False, True, "1"),
    ("SARIMA", "seasonal_order.P", "integer", [], 0, 2, False, False, True, "0"),
    ("SARIMA", "seasonal_order.D", "integer", [], 0, 1, False, False, True, "1"),
    ("SARIMA", "seasonal_order.Q", "integer", [], 0, 2, False, False, True, "1"),
    ("SARIMA", "seasonal_order.m", "integer", [], 0, 366, False, False, True, "7"),
    ("Prophet", "seasonality_mode", "enum", ["additive", "multiplicative"], None, None, False, False, True, "additive"),
    ("Prophet", "changepoint_prior_scale", "number", [], 0, 1, True, False, True, "0.05"),
    ("ETS", "trend", "enum", ["add", "mul", "null"], None, None, False, False, True, "add"),
    ("ETS", "seasonal", "enum", ["add", "mul", "null"], None, None, False, False, True, "null"),
    ("ETS", "seasonal_periods", "integer", ["null"], 2, 366, False, False, False, "null"),
    ("MLP", "hidden_layer_sizes", "list", [], 1, 8, False, False, True, "64;32"),
    ("LSTM", "lag", "integer", [], 1, 512, False, False, True, "12"),
    ("LSTM", "hidden_size", "integer", [], 1, 4096, False, False, True, "64"),
    ("LSTM", "num_layers", "integer", [], 1, 16, False, False, True, "2"),
    ("LSTM", "dropout", "number", [], 0, 1, False, True, True, "0.1"),
    ("LSTM", "epochs", "integer", [], 1, 2000, False, False, True, "100"),
    ("LSTM", "learning_rate", "number", [], 0, 1, True, False, True, "0.001"),
    ("XGBoost", "n_estimators", "integer", [], 1, 10000, False, False, True, "200"),
    ("XGBoost", "max_depth", "integer", [], 1, 64, False, False, True, "6"),
    ("XGBoost", "learning_rate", "number", [], 0, 1, True, False, True, "0.05"),
    ("XGBoost", "subsample", "number", [], 0, 1, True, False, False, "0.8"),
    ("XGBoost", "colsample_bytree", "number", [], 0, 1, True, False, False, "0.8"),
    ("RandomForest", "n_estimators", "integer", [], 1, 10000, False, False, True, "200"),
    ("RandomForest", "max_depth", "integer", ["null"], 1, 256, False, False, True, "10"),
    ("LightGBM", "n_estimators", "integer", [], 1, 10000, False, False, True, "200"),
    ("LightGBM", "learning_rate", "number", [], 0, 1, True, False, True, "0.05"),
    ("LightGBM", "max_depth", "integer", ["-1"], 1, 256, False, False, True, "6"),
    ("CatBoost", "iterations", "integer", [], 1, 10000, False, False, True, "300"),
    ("CatBoost", "learning_rate", "number", [], 0, 1, True, False, True, "0.05"),
    ("CatBoost", "depth", "integer", [], 1, 16, False, False, True, "6"),
    ("N-BEATS", "lookback", "integer", [], 2, 512, False, False, True, "20"),
    ("N-BEATS", "hidden_units", "integer", [], 1, 4096, False, False, True, "256"),
    ("N-BEATS", "stacks", "integer", [], 1, 64, False, False, True, "2"),
    ("N-BEATS", "epochs", "integer", [], 1, 2000, False, False, True, "100"),
    ("Chronos", "model_size", "enum", ["tiny", "mini", "small"], None, None, False, False, True, "tiny"),
    ("DLinear", "lag", "integer", [], 2, 512, False, False, True, "24"),
    ("DLinear", "epochs", "integer", [], 1, 2000, False, False, True, "100"),
    ("Reformer", "lag", "integer", [], 2, 512, False, False, True, "30"),
    ("Reformer", "epochs", "integer", [], 1, 2000, False, False, True, "100"),
    ("Reformer", "nhead", "integer", [], 1, 16, False, False, True, "4"),
    ("Reformer", "num_layers", "integer", [], 1, 16, False, False, True, "2"),
    ("Reformer", "dim_feedforward", "integer", [], 1, 8192, False, False, True, "128"),
    ("Autoformer", "input_size", "integer", [], 2, 2048, False, False, True, "96"),
    ("Autoformer", "hidden_size", "integer", [], 1, 4096, False, False, True, "512"),
    ("Autoformer", "max_steps", "integer", [], 1, 2000, False, False, True, "10"),
    ("Autoformer", "n_head", "integer", [], 1, 16, False, False, True, "8"),
    ("Autoformer", "encoder_layers", "integer", [], 1, 16, False, False, True, "2"),
    ("Autoformer", "decoder_layers", "integer", [], 1, 16, False, False, True, "1"),
    ("Informer", "input_size", "integer", [], 2, 2048, False, False, True, "96"),
    ("Informer", "hidden_size", "integer", [], 1, 4096, False, False, True, "512"),
    ("Informer", "max_steps", "integer", [], 1, 2000, False, False, True, "10"),
    ("Informer", "n_head", "integer", [], 1, 16, False, False, True, "8"),
    ("Informer", "encoder_layers", "integer", [], 1, 16, False, False, True, "2"),
    ("Informer", "decoder_layers", "integer", [], 1, 16, False, False, True, "1"),
    ("FEDformer", "input_size", "integer", [], 2, 2048, False, False, True, "96"),
    ("FEDformer", "hidden_size", "integer", [], 1, 4096, False, False, True, "512"),
    ("FEDformer", "max_steps", "integer", [], 1, 2000, False, False, True, "10"),
    ("FEDformer", "n_head", "enum", ["8"], None, None, False, False, True, "8"),
    ("FEDformer", "encoder_layers", "integer", [], 1, 16, False, False, True, "2"),
    ("FEDformer", "decoder_layers", "integer", [], 1, 16, False, False, True, "1"),
    ("N-HiTS", "input_size", "integer", [], 2, 2048, False, False, True, "96"),
    ("N-HiTS", "max_steps", "integer", [], 1, 2000, False, False, True, "10"),
    ("PatchTST", "input_size", "integer", [], 2, 2048, False, False, True, "96"),
    ("PatchTST", "hidden_size", "integer", [], 1, 4096, False, False, True, "512"),
    ("PatchTST", "max_steps", "integer", [], 1, 2000, False, False, True, "10"),
    ("PatchTST", "n_head", "integer", [], 1, 16, False, False, True, "8"),
    ("PatchTST", "encoder_layers", "integer", [], 1, 16, False, False, True, "2"),
    ("TimesNet", "input_size", "integer", [], 2, 2048, False, False, True, "96"),
    ("TimesNet", "hidden_size", "integer", [], 1, 4096, False, False, True, "512"),
    ("TimesNet", "max_steps", "integer", [], 1, 2000, False, False, True, "10"),
    ("TiDE", "input_size", "integer", [], 2, 2048, False, False, True, "96"),
    ("TiDE", "hidden_size", "integer", [], 1, 4096, False, False, True, "512"),
    ("TiDE", "max_steps", "integer", [], 1, 2000, False, False, True, "10"),
    ("TiDE", "num_decoder_layers", "integer", [], 1, 16, False, False, True, "1"),
    ("ElasticNet", "alpha", "number", [], 0, 1000000, True, False, True, "1.0"),
    ("ElasticNet", "l1_ratio", "number", [], 0, 1, False, False, True, "0.5"),
    ("ElasticNet", "fit_intercept", "boolean", [], None, None, False, False, False, "true"),
    ("ElasticNet", "max_iter", "integer", [], 1, 1000000, False, False, False, "1000"),
    ("ElasticNet", "tol", "number", [], 0, 1, True, False, False, "0.0001"),
    ("ElasticNet", "selection", "enum", ["cyclic", "random"], None, None, False, False, False, "cyclic"),
    ("ElasticNet", "positive", "boolean", [], None, None, False, False, False, "false"),
    ("KNN", "n_neighbors", "integer", [], 1, 10000, False, False, True, "5"),
    ("KNN", "weights", "enum", ["uniform", "distance"], None, None, False, False, False, "uniform"),
    ("KNN", "algorithm", "enum", ["auto", "ball_tree", "kd_tree", "brute"], None, None, False, False, False, "auto"),
    ("KNN", "leaf_size", "integer", [], 1, 10000, False, False, False, "30"),
    ("KNN", "p", "integer", [], 1, 100, False, False, False, "2"),
    ("KNN", "metric", "enum", ["minkowski", "euclidean", "manhattan"], None, None, False, False, False, "minkowski"),
    ("SVR", "C", "number", [], 0, 1000000, True, False, True, "1.0"),
    ("SVR", "epsilon", "number", [], 0, 1000000, False, False, True, "0.1"),
    ("SVR", "kernel", "enum", ["rbf", "linear", "poly", "sigmoid"], None, None, False, False, True, "rbf"),
    ("SVR", "gamma", "number", ["scale", "auto"], 0, 1000000, True, False, False, "scale"),
    ("SVR", "degree", "integer", [], 1, 100, False, False, False, "3"),
    ("SVR", "coef0", "number", [], -1000000, 1000000, False, False, False, "0.0"),
    ("SVR", "shrinking", "boolean", [], None, None, False, False, False, "true"),
    ("SVR", "tol", "number", [], 0, 1, True, False, False, "0.001"),
    ("SVR", "cache_size", "number", [], 0, 1000000, True, False, False, "200.0"),
    ("SVR", "max_iter", "integer", ["-1"], 1, 1000000, False, False, False, "-1"),
]
# fixed values: values suggested for the models this library forecasts with
SUGGESTIONS = {
    "ARIMA": {"order": ["1,0,0", "1,1,1", "2,1,2", "3,1,2"]},
    "Prophet": {"seasonality_mode": ["additive", "multiplicative"], "changepoint_prior_scale": ["0.01", "0.05", "0.1", "0.5"]},
    "ETS": {"trend": ["add", "mul", "null"], "seasonal": ["add", "mul", "null"], "seasonal_periods": ["null", "4", "7", "12", "24", "52"]},
    "RandomForest": {"n_estimators": ["100", "200", "500"], "max_depth": ["5", "10", "null"]},
    "ElasticNet": {"alpha": ["0.1", "1.0", "10.0"], "l1_ratio": ["0.1", "0.5", "0.9"]},
    "KNN": {"n_neighbors": ["3", "5", "10"], "weights": ["uniform", "distance"], "p": ["1", "2"]},
}


def rule_table(spark: SparkSession) -> DataFrame:
    """The rules as a table of fixed size (about a hundred rows), small enough to be broadcast."""
    schema = "model string, name string, kind string, words array<string>, low double, high double, low_open boolean, high_open boolean, required boolean, default_value string"
    as_number = lambda v: None if v is None else float(v)
    return spark.createDataFrame([(*r[:4], as_number(r[4]), as_number(r[5]), *r[6:]) for r in RULES], schema)


def defaults_table(spark: SparkSession) -> DataFrame:
    """Default hyper-parameters of each model as a map: one row per model."""
    by_model: dict[str, dict[str, str]] = {}
    for m, name, *_, value in RULES:
        by_model.setdefault(m, {})[name] = value
    names = [(m, list(d), list(d.values())) for m, d in by_model.items()]
    table = spark.createDataFrame(names, "model string, names array<string>, vals array<string>")
    return table.select("model", F.map_from_arrays("names", "vals").alias("hyperparameters"))


def value_problem() -> Column:
    """What is wrong with ``value`` under its rule, or null."""
    value = F.col("value")
    number = value.try_cast("double")
    whole = value.rlike(r"^-?\d+$")
    below = F.when(F.col("low_open"), number <= F.col("low")).otherwise(number < F.col("low"))
    above = F.when(F.col("high_open"), number >= F.col("high")).otherwise(number > F.col("high"))
    parts = F.split(value, ";")
    positive = F.forall(parts, lambda p: p.rlike(r"^\d+$") & p.try_cast("int").between(1, 4096))
    return (
        F.when(F.col("kind").isNull(), "unknown_parameter")
        .when(F.array_contains("words", value), None)
        .when(F.col("kind") == "enum", "not_in_enum")
        .when((F.col("kind") == "boolean") & ~value.isin("true", "false"), "not_boolean")
        .when(F.col("kind") == "boolean", None)
        .when((F.col("kind") == "list") & (~positive | (F.size(parts) < F.col("low")) | (F.size(parts) > F.col("high"))), "bad_list")
        .when(F.col("kind") == "list", None)
        .when((F.col("kind") == "integer") & ~whole, "not_integer")
        .when((F.col("kind") == "number") & (number.isNull() | F.isnan(number)), "not_a_number")
        .when(below, "below_minimum")
        .when(above, "above_maximum")
    )


def hyperparameter_violations(candidates: DataFrame, rules: DataFrame) -> DataFrame:
    """(candidate_id, model, name, problem) for every broken rule.

    ``candidates``: candidate_id, model, hyperparameters (map of text).  The rules are joined to the
    parameters, a table of fixed size to one of any size.
    """
    rules = F.broadcast(rules)
    params = candidates.select("candidate_id", "model", F.explode("hyperparameters").alias("name", "value"))
    broken = params.join(rules, ["model", "name"], "left").withColumn("problem", value_problem())
    broken = broken.filter(F.col("problem").isNotNull()).select("candidate_id", "model", "name", "problem")
    needed = rules.filter("required").groupBy("model").agg(F.collect_list("name").alias("needed"))
    missing = candidates.join(F.broadcast(needed), "model").select(
        "candidate_id", "model", F.explode(F.array_except("needed", F.map_keys("hyperparameters"))).alias("name"), F.lit("missing_parameter").alias("problem")
    )
    get = lambda k: F.try_element_at("hyperparameters", F.lit(k))
    num = lambda k: get(k).try_cast("int")
    model = F.col("model")
    cross = (
        F.when((model == "ETS") & (get("seasonal") == "null") & (F.coalesce(get("seasonal_periods"), F.lit("null")) != "null"), "periods_without_season")
        .when((model == "ETS") & (get("seasonal") != "null") & (F.coalesce(get("seasonal_periods"), F.lit("null")) == "null"), "season_without_periods")
        .when((model == "SARIMA") & (num("seasonal_order.m") == 0) & ((num("seasonal_order.P") > 0) | (num("seasonal_order.D") > 0) | (num("seasonal_order.Q") > 0)), "season_without_periods")
        .when((model == "SARIMA") & (num("seasonal_order.m") == 1), "period_of_one")
        .when((model == "Reformer") & (F.try_mod(F.lit(32), num("nhead")) != 0), "heads_do_not_divide")
        .when(model.isin("Autoformer", "Informer", "FEDformer", "PatchTST") & (F.try_mod(num("hidden_size"), num("n_head")) != 0), "heads_do_not_divide")
    )
    crossed = candidates.select("candidate_id", "model", F.lit("").alias("name"), cross.alias("problem")).filter(F.col("problem").isNotNull())
    return broken.unionByName(missing).unionByName(crossed)


def suggestion_grid(runs: DataFrame, model: str, key: str = "run_id") -> DataFrame:
    """Every combination of a model's suggested values for every run: (run, model, hyperparameters)."""
    grid = runs.select(key, F.lit(model).alias("model"))
    for name, values in SUGGESTIONS[model].items():
        grid = grid.withColumn(f"_{name}", F.explode(F.array(*[F.lit(v) for v in values])))
    pairs = [x for name in SUGGESTIONS[model] for x in (F.lit(name), F.col(f"_{name}"))]
    return grid.select(key, "model", F.create_map(*pairs).alias("hyperparameters"))


# ---------------------------------------------------------------- chains

GENERATORS = ["lag_features", "rolling_features", "calendar_features"]
SCALERS = ["standard_scaler", "minmax_scaler"]
# fixed values: models that need scaled features, and models that read only a scaled target sequence
FEATURE_SCALED = ["SVR", "KNN", "ElasticNet", "MLP"]
TARGET_SCALED = ["LSTM", "N-BEATS", "DLinear", "Reformer", "Autoformer", "Informer", "FEDformer", "N-HiTS", "PatchTST", "TimesNet", "TiDE"]


def chain_problem(model: Column, steps: Column) -> Column:
    """First rule a preprocessing chain breaks, or null.

    ``steps``: array of struct(name, scope, method, lags, windows).  Names may be aliases.
    """
    named = F.transform(steps, lambda s: F.coalesce(X.canonical_preprocessing(s["name"]), F.lit("?")))
    count = lambda test: F.size(F.filter(steps, test))
    name = lambda s: X.canonical_preprocessing(s["name"])
    scaler = lambda scope: lambda s: name(s).isin(SCALERS) & (F.coalesce(s["scope"], F.lit("features")) == scope)
    has = lambda *names: F.arrays_overlap(named, F.array(*[F.lit(n) for n in names]))
    first = lambda test: F.array_position(F.transform(steps, test), True)
    features, targets = count(scaler("features")), count(scaler("target"))
    generators = has(*GENERATORS)
    ahead = F.slice(named, F.lit(1), F.greatest(F.lit(0), first(scaler("features")).cast("int") - 1))
    generated_before = F.arrays_overlap(ahead, F.array(*[F.lit(n) for n in GENERATORS]))
    outliers = F.size(F.filter(named, lambda n: n == "replace_outliers"))
    bad_scope = F.exists(steps, lambda s: name(s).isin(SCALERS) & ~F.coalesce(s["scope"], F.lit("features")).isin("features", "target"))
    bad_log = F.exists(steps, lambda s: (name(s) == "log_transform") & ~F.coalesce(s["method"], F.lit("log1p")).isin("log1p", "log"))
    bad_lags = F.exists(steps, lambda s: (name(s) == "lag_features") & ((F.size(F.coalesce(s["lags"], F.array())) == 0) | F.exists(F.coalesce(s["lags"], F.array()), lambda v: v < 1)))
    bad_windows = F.exists(steps, lambda s: (name(s) == "rolling_features") & ((F.size(F.coalesce(s["windows"], F.array())) == 0) | F.exists(F.coalesce(s["windows"], F.array()), lambda v: v < 2)))
    return (
        F.when(F.array_contains(named, "?"), "unknown_transformation")
        .when(bad_scope, "bad_scope")
        .when(bad_log, "bad_log_method")
        .when(bad_lags, "bad_lags")
        .when(bad_windows, "bad_windows")
        .when(outliers > 1, "outliers_repeated")
        .when((outliers == 1) & (F.get(named, F.lit(0)) != "replace_outliers"), "outliers_not_first")
        .when(model.isin("SARIMA", "ARIMA", "ETS") & generators, "features_not_consumed")
        .when(has("log_transform") & has("boxcox_transform"), "target_treatments_exclusive")
        .when(model.isin(TARGET_SCALED) & generators, "features_not_consumed")
        .when(model.isin(TARGET_SCALED) & (features > 0), "feature_scaler_not_allowed")
        .when(model.isin(TARGET_SCALED) & (targets == 0), "target_scaler_required")
        .when((features > 0) & ~generators, "scaler_without_features")
        .when((features > 0) & ~generated_before, "scaler_before_features")
        .when((features > 1) | (targets > 1), "scaler_repeated")
        .when(model.isin(FEATURE_SCALED) & ~generators, "features_required")
        .when(model.isin(FEATURE_SCALED) & (features == 0), "feature_scaler_required")
    )


# ---------------------------------------------------------------- lags and windows


def _distinct_within(values: Column, low: int, high: Column) -> Column:
    return F.array_distinct(F.filter(F.array_compact(values), lambda v: (v >= low) & (v <= high)))


def default_lags(horizon: Column, suggested: Column, season: Column, n_train: Column) -> Column:
    """1, a short horizon, the suggested lag and the season, as far as a third of training allows."""
    longest = F.greatest(F.lit(1), F.floor(n_train / 3)).cast("int")
    wanted = F.array(
        F.lit(1), F.when(horizon > 1, F.least(horizon, F.lit(3))), F.when(suggested > 1, suggested), F.when(season > 1, season)
    ).cast("array<int>")
    out = _distinct_within(wanted, 1, longest)
    return F.when(F.size(out) > 0, out).otherwise(F.array(F.lit(1)))


# fixed values: rolling windows by frequency letter
WINDOWS = {"D": [7, 14, 30], "W": [4, 13, 26], "M": [3, 6, 12], "Q": [2, 4, 8]}


def default_windows(freq: Column, horizon: Column, suggested: Column, season: Column, n_train: Column) -> Column:
    """The first three usable windows: season, suggested lag, horizon, then those of the frequency."""
    letter = F.upper(F.substring(freq, 1, 1))
    usual = F.array(*[F.lit(v) for v in WINDOWS["M"]])
    for key, values in WINDOWS.items():
        usual = F.when(letter == key, F.array(*[F.lit(v) for v in values])).otherwise(usual)
    head = F.array(F.when(season > 1, season), F.when(suggested > 1, suggested), F.when(horizon > 1, F.greatest(F.lit(2), F.least(horizon, F.lit(6)))))
    longest = F.greatest(F.lit(2), F.floor(n_train / 3)).cast("int")
    out = F.slice(_distinct_within(F.concat(head.cast("array<int>"), usual), 2, longest), 1, 3)
    return F.when(F.size(out) > 0, out).otherwise(F.array(F.lit(3)))


def repair_lags(lags: Column, allowed: Column, suggested: Column) -> tuple[Column, Column]:
    """(lags to use, what was done): none given are filled in, 1..suggested is collapsed, others must be allowed."""
    given = F.array_distinct(F.coalesce(lags, F.array().cast("array<int>")))
    foreign = F.size(F.array_except(given, allowed)) > 0
    expanded = (suggested > 1) & F.array_contains(allowed, suggested) & (given == F.sequence(F.lit(1), F.greatest(F.lit(1), suggested)))
    action = F.when(F.size(given) == 0, "filled").when(~foreign, "kept").when(expanded, "collapsed").otherwise("rejected")
    fixed = F.when(action == "filled", allowed).when(action == "kept", given).when(action == "collapsed", F.array_intersect(allowed, given))
    return fixed, action


# ---------------------------------------------------------------- requests


def target_constraints(train: DataFrame, key: str = "series_id") -> DataFrame:
    """What the training target allows: signs, log transform, multiplicative smoothing."""
    y = F.col("target")
    finite = train.filter(y.isNotNull() & ~F.isnan(y) & (F.abs(y) != float("inf")))
    s = finite.groupBy(key).agg(
        F.min(y).alias("minimum"), F.max(y).alias("maximum"), F.bool_or(y < 0).alias("contains_negative"), F.bool_or(y == 0).alias("contains_zero"),
        F.every(y > 0).alias("strictly_positive"),
    )
    return s.withColumn("log1p_supported", F.col("minimum") > -1.0).withColumn(
        "ets_components", F.when(F.col("strictly_positive"), "add,mul,none").otherwise("add,none")
    )


MEMORY = {"N-BEATS": "lookback", "LSTM": "lag", "DLinear": "lag", "Reformer": "lag"}


def request_problem() -> Column:
    """Why a candidate does not answer its request, or null.

    Row: model, signature, hyperparameters, steps (names), requested_model, refine, best_signature,
    required_treatment, n_train, horizon, strictly_positive, log1p_supported.
    """
    memory = F.lit(None).cast("int")
    for model, name in MEMORY.items():
        memory = F.when(F.col("model") == model, F.try_element_at("hyperparameters", F.lit(name)).try_cast("int")).otherwise(memory)
    has = lambda n: F.array_contains("steps", n)
    mul = (F.try_element_at("hyperparameters", F.lit("trend")) == "mul") | (F.try_element_at("hyperparameters", F.lit("seasonal")) == "mul")
    want = F.col("required_treatment")
    return (
        F.when(F.col("model") != F.col("requested_model"), F.when(F.col("refine"), "wrong_model_in_refine").otherwise("wrong_model"))
        .when(memory + F.col("horizon") > F.col("n_train"), "memory_longer_than_training")
        .when((F.col("model") == "ETS") & mul & ~F.col("strictly_positive"), "multiplicative_needs_positive_target")
        .when((want == "log1p") & ~F.col("log1p_supported"), "log_not_supported")
        .when((want == "log1p") & has("boxcox_transform"), "other_treatment")
        .when((want == "log1p") & ~has("log_transform"), "log_missing")
        .when((want == "raw") & (has("log_transform") | has("boxcox_transform")), "raw_target_required")
        .when(F.col("refine") & (F.col("signature") == F.col("best_signature")), "unchanged_configuration")
    )
