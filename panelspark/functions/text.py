"""Text normalisation, fact splitting and unsupported-claim detection as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# whitespace, and word characters, of any script; the spelling is valid in every regex engine used here
WS = r"[\s\x0B\x{85}\p{Z}]"
WORD = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{WS}+|{WS}+$", "")


def squeeze(text: Column) -> Column:
    """Whitespace runs become one space, none at the ends."""
    return strip(F.regexp_replace(text, rf"{WS}+", " "))


def normalize_label(text: Column) -> Column:
    """Lower case, ``_`` and ``-`` as spaces, no punctuation, single spaces; empty is ``unknown``."""
    spaced = F.translate(F.lower(text), "_-", "  ")
    bare = squeeze(F.regexp_replace(spaced, r"[^\p{L}\p{N}_\s\x0B\x{85}\p{Z}]", ""))
    return F.when(text.isNull() | (bare == ""), "unknown").otherwise(bare)


def normalize_fact(text: Column) -> Column:
    """Lower case, source tags removed, everything but word characters as single spaces."""
    untagged = F.regexp_replace(F.lower(text), r"\[source(\s*:[^\]]*)?\]", " ")
    return F.trim(F.regexp_replace(untagged, rf"{NOT_WORD}+", " "))


FACT_PREFIX = rf"(?i)^available facts are as follows{WS}*:{WS}*"


def split_facts(text: Column) -> Column:
    """Array of facts: split at ``|``, ``;`` and line ends, boilerplate and edge punctuation removed."""
    clean = strip(F.replace(text, F.lit("\\n"), F.lit("\n")))
    # spaces around a separator go with the edges below
    pieces = F.split(clean, r"\||;|\n")
    edged = F.transform(
        pieces, lambda p: F.regexp_replace(F.regexp_replace(strip(p), FACT_PREFIX, ""), r"^[ \-.;]+|[ \-.;]+$", "")
    )
    return F.filter(edged, lambda p: p != "")


def first_known(*values: Column) -> Column:
    """First value that says something: not empty, unknown, none or null."""
    known = [F.when(~F.lower(v).isin("", "unknown", "none", "null"), v) for v in values]
    return F.coalesce(*known, F.lit("unknown"))


def first_present(*values: Column) -> Column:
    return F.coalesce(*[F.nullif(strip(v), F.lit("")) for v in values])


def join_text(columns: list[str]) -> Column:
    """Non-empty text columns joined by `` | ``; facts and predictions are marked as such."""
    parts = []
    for name in columns:
        value = strip(F.col(name).cast("string"))
        key = name.strip().lower()
        prefix = "FACT: " if key in ("fact", "facts") else "PREDICTION: " if key in ("pred", "prediction") else ""
        usable = value.isNotNull() & (value != "") & (F.lower(value) != "nan")
        parts.append(F.when(usable, F.concat(F.lit(prefix), value)))
    return F.concat_ws(" | ", *parts)


# fixed values: claims about the numbers that text alone cannot support
CLAIMS = {
    "assumed_sample_sufficiency": r"(?i)\b(?:time\s*series|series|dataset|numerical\s+data|data)\b.{0,45}\b(?:short|small|sparse|insufficient\s+observations?|too\s+few)\b",
    "assumed_numerical_missingness": r"(?i)\b(?:time\s*series|series|dataset|numerical\s+data|data)\b.{0,45}\b(?:missing\s+values?|many\s+na|incomplete)\b",
    "assumed_sampling_irregularity": r"(?i)\b(?:time\s*series|series|dataset|sampling|numerical\s+data)\b.{0,45}\b(?:irregular|uneven|non[- ]regular)\b",
    "assumed_stationarity": r"(?i)\b(?:time\s*series|series|numerical\s+data)\b.{0,45}\b(?:stationary|nonstationary|non-stationary|autocorrelat|differenc)",
    "assumed_numerical_dynamics": r"(?i)\b(?:time\s*series|series|numerical\s+data|dataset)\b.{0,45}\b(?:volatile|volatility|strong\s+trend|weak\s+trend|seasonality|seasonal\s+strength)\b",
}


# what every claim above starts with
SUBJECTS = r"(?i)\b(?:time\s*series|series|dataset|sampling|data)\b"


def claim_categories(text: Column) -> Column:
    """Names of the unsupported claims a text makes, in fixed order."""
    flat = squeeze(text)
    return F.array_compact(F.array(*[F.when(flat.rlike(p), F.lit(name)) for name, p in CLAIMS.items()]))


def clauses(text: Column) -> Column:
    parts = F.split(squeeze(text), r"(?i)\s*;\s*|\s+and\s+")
    return F.transform(F.filter(parts, lambda p: F.trim(p) != ""), lambda p: F.regexp_replace(p, r"^[ ,.]+|[ ,.]+$", ""))


def sanitize(text: Column) -> tuple[Column, Column]:
    """(text without the clauses that make unsupported claims, the categories found)."""
    parts = clauses(text)
    found = F.array_distinct(F.flatten(F.transform(parts, claim_categories)))
    return unclaimed(parts), found


def unclaimed(parts: Column) -> Column:
    """The clauses that make no unsupported claim, joined again.

    Clauses have single spaces and no others at their ends, so they are matched as they are; those that
    name no subject of a claim, which are nearly all, are matched once.
    """
    claims = lambda p: reduce(lambda a, b: a | b, [p.rlike(c) for c in CLAIMS.values()])
    return F.array_join(F.filter(parts, lambda p: ~F.when(p.rlike(SUBJECTS), claims(p)).otherwise(False)), "; ")


def capitalize(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substr(text, F.lit(2))))


# fixed values: measure spellings with a shorter equivalent
MEASURES = {"accumulated amount": "accumulated", "total amount": "total", "average value": "average"}


def target_label(entity: Column, measure: Column, granularity: Column) -> Column:
    """``Granularity measure entity`` of the known parts, without repeats; ``unknown`` if none is known."""
    tidy = lambda c: F.when((F.lower(c) != "unknown") & (c != ""), F.trim(F.lower(c)))
    m = tidy(measure)
    for long, short in MEASURES.items():
        m = F.when(m == long, short).otherwise(m)
    parts = F.array_distinct(F.array_compact(F.array(tidy(granularity), m, tidy(entity))))
    return F.when(F.size(parts) == 0, "unknown").otherwise(capitalize(F.array_join(parts, " ")))


# fixed values: canonical transformation and value-type names
TRANSFORMATIONS = {
    "log": "log_transform",
    "log transform": "log_transform",
    "log transformation": "log_transform",
    "seasonal decomposition": "seasonal_decomposition",
    "seasonal differencing": "seasonal_differencing",
    "normalize": "normalization",
    "normalisation": "normalization",
    "normalization": "normalization",
    "difference": "differencing",
    "differencing": "differencing",
    "none": "none",
}
VALUE_TYPES = {
    "continuous": "continuous",
    "continuous value": "continuous",
    "numeric continuous": "continuous",
    "count": "count",
    "integer count": "count",
    "binary": "binary",
    "categorical": "categorical",
    "index": "index",
    "rate": "rate",
}
PREPROCESSING_ALIASES = {
    "standardscaler": "standard_scaler",
    "standard scaler": "standard_scaler",
    "zscore": "standard_scaler",
    "z_score": "standard_scaler",
    "z-score": "standard_scaler",
    "minmaxscaler": "minmax_scaler",
    "minmax scaler": "minmax_scaler",
    "min_max_scaler": "minmax_scaler",
    "min-max scaler": "minmax_scaler",
}
PREPROCESSING = [
    "standard_scaler",
    "minmax_scaler",
    "lag_features",
    "rolling_features",
    "calendar_features",
    "log_transform",
    "boxcox_transform",
    "replace_outliers",
]


def lookup(value: Column, table: dict[str, str], default: Column) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), value), default)


def canonical_transformation(text: Column) -> Column:
    return lookup(normalize_label(text), TRANSFORMATIONS, text)


def canonical_value_type(text: Column) -> Column:
    return lookup(normalize_label(text), VALUE_TYPES, F.lit("unknown"))


def canonical_preprocessing(text: Column) -> Column:
    """Canonical step name, or null where there is none."""
    name = F.lower(F.trim(text))
    name = lookup(name, PREPROCESSING_ALIASES, name)
    return F.when(name.isin(PREPROCESSING), name)


# fixed values: model families in canonical order, models, aliases and fragments (first match wins)
FAMILIES = ["Statistical", "Additive", "Tree-based", "Classical ML", "Neural", "Transformer/Foundation"]
MODEL_FAMILY = {
    "ARIMA": "Statistical",
    "SARIMA": "Statistical",
    "ETS": "Statistical",
    "Prophet": "Additive",
    "XGBoost": "Tree-based",
    "LightGBM": "Tree-based",
    "CatBoost": "Tree-based",
    "RandomForest": "Tree-based",
    "ElasticNet": "Classical ML",
    "KNN": "Classical ML",
    "SVR": "Classical ML",
    "MLP": "Neural",
    "LSTM": "Neural",
    "DLinear": "Neural",
    "N-BEATS": "Neural",
    "N-HiTS": "Neural",
    "TiDE": "Neural",
    "Autoformer": "Transformer/Foundation",
    "Informer": "Transformer/Foundation",
    "FEDformer": "Transformer/Foundation",
    "PatchTST": "Transformer/Foundation",
    "TimesNet": "Neural",
    "Reformer": "Transformer/Foundation",
    "Chronos": "Transformer/Foundation",
}
FAMILY_ALIASES = {
    "transformer": "Transformer/Foundation",
    "foundation": "Transformer/Foundation",
    "transformer/foundation": "Transformer/Foundation",
    "statistical": "Statistical",
    "additive": "Additive",
    "additive/decomposable": "Additive",
    "tree-based": "Tree-based",
    "tree based": "Tree-based",
    "classical ml": "Classical ML",
    "neural": "Neural",
    "statistical time series": "Statistical",
    "linear regression": "Classical ML",
    "linear models": "Classical ML",
    "gradient boosting": "Tree-based",
    "gradient boosting trees": "Tree-based",
    "tree based ensemble": "Tree-based",
    "deep learning sequence": "Neural",
}
FAMILY_FRAGMENTS = [
    (("statistical", "arima"), "Statistical"),
    (("tree", "boosting", "forest"), "Tree-based"),
    (("deep learning", "neural", "sequence"), "Neural"),
    (("transformer", "foundation"), "Transformer/Foundation"),
    (("additive", "prophet"), "Additive"),
    (("classical", "regression"), "Classical ML"),
]


def canonical_family(label: Column) -> Column:
    """Family of a free-text label: alias, else the first fragment it contains, else the label itself."""
    name = strip(F.coalesce(label, F.lit("")))
    low = F.lower(name)
    rest = F.when(low == "", "")
    for words, family in FAMILY_FRAGMENTS:
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        rest = rest.when(hit, family)
    return lookup(low, FAMILY_ALIASES, rest.otherwise(name))


def model_family(model: Column) -> Column:
    name = F.trim(F.coalesce(model, F.lit("")))
    return F.when(name == "", "").otherwise(lookup(name, MODEL_FAMILY, F.lit("Other")))


def known_family(label: Column) -> Column:
    """Canonical family, or null where the label names none of them."""
    name = canonical_family(F.translate(strip(label), "_", " "))
    return F.when(name.isin(FAMILIES), name)


def priority_weight(priority: Column, default: float = 0.0) -> Column:
    p = F.lower(priority)
    return F.when(p == "high", 3.0).when(p == "medium", 2.0).when(p == "low", 1.0).otherwise(default)


def weight_priority(weight: Column) -> Column:
    return F.when(weight >= 2.5, "high").when(weight >= 1.5, "medium").otherwise("low")


def normalized_error(message: Column) -> Column:
    return F.regexp_replace(F.lower(strip(message)), rf"{WS}+", " ")
