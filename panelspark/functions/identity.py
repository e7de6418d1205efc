"""Signatures, seeds, fingerprints and message classes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import normalized_error

# fixed values: parameters that a fit adds to a step, and that do not identify a configuration
FITTED_PARAMETERS = [
    "columns", "stats", "history_tail", "dropped_rows_train", "train_len", "shift", "lambda", "lower_limit", "upper_limit", "limits_source",
    "outlier_positions", "original_values", "replacement_values", "center", "scale", "n_replaced", "detection_scope",
]


def _object(entries: Column) -> Column:
    """JSON object of (key, JSON value) entries, keys in order."""
    parts = F.transform(F.array_sort(entries), lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), e["value"]))
    return F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}"))


def configuration_signature(model: Column, hyperparameters: Column, steps: Column) -> Column:
    """Canonical compact JSON of a configuration.

    ``hyperparameters`` is a map of names to JSON values; ``steps`` an array of (name, parameters).
    Fitted and private parameters are left out, so a refit has the signature of its first fit.  An
    obsolete error mode of exponential smoothing is ignored.
    """
    hp = F.filter(F.map_entries(hyperparameters), lambda e: ~((model == "ETS") & (e["key"] == "error")))

    def step(s: Column) -> Column:
        kept = F.filter(F.map_entries(s["parameters"]), lambda e: ~e["key"].startswith("_") & ~e["key"].isin(FITTED_PARAMETERS))
        return F.concat(F.lit('{"name":"'), s["name"], F.lit('","parameters":'), _object(kept), F.lit("}"))

    return F.concat(
        F.lit('{"hyperparameters":'), _object(hp), F.lit(',"model":"'), model, F.lit('","preprocessing":['), F.array_join(F.transform(steps, step), ","), F.lit("]}")
    )


def failure_fingerprint(signature: Column, error_type: Column, message: Column) -> Column:
    return F.concat_ws("|", signature, error_type, normalized_error(message))


def candidate_seed(dataset: Column, seed: Column, signature: Column) -> Column:
    """First four bytes of the digest of dataset, seed and signature, as a number."""
    digest = F.sha2(F.concat_ws("|", dataset, seed.cast("string"), signature), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def candidate_id(signature: Column, seed: Column, occurrence: Column) -> Column:
    digest = F.sha2(F.concat_ws("|", signature, seed.cast("string"), occurrence.cast("string")), 256)
    return F.concat(F.lit("candidate-"), F.substring(digest, 1, 20))


def row_digest(*columns: Column) -> Column:
    """Number in 0 .. 2^32 of a row's text form; sums of it do not depend on row order."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[c.cast("string") for c in columns])), 1, 8), 16, 10).cast("bigint")


def rejection_code(message: Column) -> Column:
    """Why a candidate was turned down, by the markers in the message (first match wins)."""
    low = F.lower(message)
    has = lambda *words: _any([low.contains(w) for w in words])
    return (
        F.when(has("already tested", "exact failed", "signature", "cannot be retried"), "duplicate_candidate")
        .when(has("preprocessing", "transformation"), "invalid_preprocessing_contract")
        .when(has("invalid model"), "ineligible_model")
        .when(has("refine mode"), "wrong_model_in_refine")
        .when(has("hyperparameter"), "invalid_model_contract")
        .otherwise("no_valid_configuration")
    )


def non_retryable(message: Column) -> Column:
    text = normalized_error(message)
    markers = ["unknown preprocessing transformation", "unsupported preprocessing transformation", "missing runtime implementation", "fatal configuration inconsistency"]
    return _any([text.contains(m) for m in markers])


def safe_run_id(run_id: Column) -> Column:
    """Run id usable as a folder name; null if nothing usable is left."""
    clean = F.regexp_replace(F.regexp_replace(run_id, "[^A-Za-z0-9_.-]+", "_"), r"^[._]+|[._]+$", "")
    return F.nullif(clean, F.lit(""))


# fixed values: fields of the held-out partition, and names of outside regressors
TEST_FIELDS = ["test_df", "raw_test_df", "preprocessed_test_df", "test_metrics", "test_score", "test_predictions", "y_true_test", "selected_model_test_rank", "test_regret"]
OUTSIDE_FIELDS = [
    "d0", "d1", "d2", "d3", "d4", "exog", "exogenous_features", "external_features", "regressors", "regressor_columns", "covariates",
    "past_covariates", "future_covariates", "known_covariates", "feature_columns", "columns", "input_columns", "input_features", "numeric_features",
]
OUTSIDE_VALUES = ["d0", "d1", "d2", "d3", "d4", "exog", "exogenous_features", "regressors", "covariates"]
_STRING = r'"((?:[^"\\]|\\.)*)"'


def json_keys(json: Column) -> Column:
    """All object keys at any depth, lower case."""
    return F.transform(F.regexp_extract_all(json, F.lit(_STRING + r"\s*:"), 1), lambda k: F.lower(F.trim(k)))


def json_strings(json: Column) -> Column:
    """All string values at any depth, lower case."""
    return F.transform(F.regexp_extract_all(json, F.lit(_STRING + r"\s*(?=[,\]}])"), 1), lambda v: F.lower(F.trim(v)))


def test_fields(json: Column) -> Column:
    """Keys that would carry held-out data; the negative audit mark ``test_target_modified: false`` is none."""
    audited = F.regexp_replace(json, r'"test_target_modified"\s*:\s*false', '"audit":false')
    return F.filter(json_keys(audited), lambda k: k.isin("test", *TEST_FIELDS) | k.startswith("test_"))


def outside_inputs(json: Column) -> Column:
    """Keys and values of a candidate that declare numeric inputs from outside the series."""
    marked = lambda k: k.isin(OUTSIDE_FIELDS) | k.contains("covariate") | k.contains("regressor") | k.contains("exogenous")
    return F.concat(F.filter(json_keys(json), marked), F.filter(json_strings(json), lambda v: v.isin(OUTSIDE_VALUES)))


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out
