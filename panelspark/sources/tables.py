"""Reading series and documents of unknown column layout; the layout is settled while the plan is built."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import tolerant_timestamp, to_number
from ..functions.text import join_text

# fixed values: names a column may have in each role, first match wins
TIME_NAMES = ["end_date", "date", "ds", "timestamp", "time", "datetime", "start_date"]
TARGET_NAMES = ["ot", "target", "value", "measurement", "series_value"]
TEXT_NAMES = ["facts", "fact", "pred", "prediction", "text", "content", "summary", "headline", "title", "description"]
TEMPORAL = ["date", "ds", "timestamp", "time", "datetime", "unique_id", "_is_new"]
CALENDAR = ["month_sin", "month_cos", "quarter_sin", "quarter_cos", "dayofweek_sin", "dayofweek_cos", "time_idx"]


def normalized_names(names: Sequence[str]) -> list[str]:
    """Lower case without edges; repeated names get _1, _2, ..."""
    seen: dict[str, int] = {}
    out = []
    for name in names:
        low = name.strip().lower()
        out.append(f"{low}_{seen[low]}" if low in seen else low)
        seen[low] = seen.get(low, 0) + 1
    return out


def normalize_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*normalized_names(df.columns))


def drop_index_columns(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("unnamed:") or c == "index" or re.fullmatch(r"_c\d+", c)])


def first_present(columns: Sequence[str], wanted: Sequence[str]) -> str | None:
    return next((w for w in wanted if w in columns), None)


def _numeric(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def is_derived_feature(name: str) -> bool:
    """Features a model may read: lags, rolling statistics (two rows or more) and calendar columns."""
    low = name.strip().lower()
    rolling = re.fullmatch(r"rolling_(mean|std|min|max)_([1-9]\d*)", low)
    return bool(re.fullmatch(r"lag_[1-9]\d*", low)) or low in CALENDAR or bool(rolling and int(rolling.group(2)) >= 2)


def require_raw_series(df: DataFrame, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """A raw series has one numeric column, the target."""
    if "target" not in df.columns:
        raise ValueError("a raw series needs a target column")
    extra = [c for c in _numeric(df) if c.strip().lower() not in {*TEMPORAL, "target", *keys}]
    if extra:
        raise ValueError(f"numeric columns from outside the series: {extra}")
    return df


def model_features(df: DataFrame, keys: Sequence[str] = ("series_id", "pos", "n", "n_train", "n_val", "n_test")) -> list[str]:
    """Numeric predictor columns; any that is not derived from target or calendar is an error."""
    found = [c for c in _numeric(df) if c.strip().lower() not in {*TEMPORAL, "target", *keys}]
    foreign = [c for c in found if not is_derived_feature(c)]
    if foreign:
        raise ValueError(f"numeric columns from outside the series: {foreign}")
    return found


def numeric_provenance(features: Sequence[str]) -> dict[str, list[str] | str]:
    """Where the numbers a model reads come from."""
    foreign = [c for c in features if not is_derived_feature(c)]
    if foreign:
        raise ValueError(f"numeric columns from outside the series: {foreign}")
    calendar = [c for c in features if c in CALENDAR]
    return {"features": list(features), "calendar": calendar, "calendar_source": "timestamp_only" if calendar else "not_used"}


def as_series(df: DataFrame, *, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, date, target) of a raw table: roles by name, dates and numbers parsed, unusable rows left out."""
    df = drop_index_columns(normalize_columns(df))
    date, target = first_present(df.columns, TIME_NAMES), first_present(df.columns, TARGET_NAMES)
    if date is None:
        raise ValueError(f"no time column among {df.columns}")
    if target is None:
        raise ValueError(f"no target column among {df.columns}; expected one of {TARGET_NAMES}")
    kind = df.schema[date].dataType
    parsed = F.col(date).cast("timestamp") if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)) else tolerant_timestamp(F.col(date))
    out = df.select(*keys, parsed.alias("date"), to_number(F.col(target)).alias("target"))
    return out.filter(~F.isnan("target")).dropna(subset=["date", "target"])


def excluded_numeric_columns(df: DataFrame) -> list[str]:
    """Numeric columns that are neither time nor target; they are counted and left out."""
    df = drop_index_columns(normalize_columns(df))
    roles = {first_present(df.columns, TIME_NAMES), first_present(df.columns, TARGET_NAMES)}
    return [c for c in _numeric(df) if c not in roles]


def read_series(spark: SparkSession, path: str | Sequence[str], series_id: str | None = None) -> DataFrame:
    """Panel from CSV files of one layout: (series_id, domain, date, target).

    A series is named after its file, its domain after the folder; ``series_id`` (any case) keeps
    one of them.
    """
    raw = spark.read.csv(list(path) if not isinstance(path, str) else path, header=True)
    file = F.input_file_name()
    named = raw.withColumn("series_id", F.regexp_extract(file, r"([^/]+?)(?:\.[^./]*)?$", 1)).withColumn("domain", F.regexp_extract(file, r"([^/]+)/[^/]+$", 1))
    out = as_series(named, keys=["series_id", "domain"])
    return out.filter(F.lower("series_id") == series_id.lower()) if series_id else out


def text_columns(df: DataFrame, *, any_text: bool, predictions: bool = True) -> list[str]:
    """Text columns in three tiers: final_search*, known names, and (CSV only) any other text column."""
    found = [c for c in df.columns if c.startswith("final_search")]
    names = [n for n in TEXT_NAMES if predictions or n not in ("pred", "prediction")]
    found = found or [c for c in df.columns if c in names]
    if not found and any_text:
        skip = {"start_date", "end_date", "date", "source", "series_id", "doc_id", *TARGET_NAMES}
        found = [f.name for f in df.schema.fields if f.name not in skip and isinstance(f.dataType, T.StringType)]
    return found


def as_documents(df: DataFrame, *, source: F.Column, any_text: bool, predictions: bool = True, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, start_date, end_date, source, facts) of a raw table, not yet validated."""
    df = normalize_columns(df)
    columns = text_columns(df, any_text=any_text, predictions=predictions)
    facts = join_text(columns) if columns else F.lit("")
    dates = [F.col(c).cast("string").alias(c) for c in ("start_date", "end_date") if c in df.columns]
    return df.select(*keys, *dates, source.alias("source"), facts.alias("facts"))


def read_documents(spark: SparkSession, csv: Sequence[str] = (), parquet: Sequence[str] = (), *, predictions: bool = True) -> DataFrame:
    """Documents of CSV and Parquet files with differing columns, CSV first (column ``priority``)."""
    stem = F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1)
    frames = [as_documents(spark.read.csv(p, header=True, multiLine=True, escape='"'), source=stem, any_text=True, predictions=predictions).withColumn("priority", F.lit(0)) for p in csv]
    frames += [as_documents(spark.read.parquet(p), source=stem, any_text=False, predictions=predictions).withColumn("priority", F.lit(1)) for p in parquet]
    if not frames:
        raise ValueError("no document files")
    out = frames[0]
    for other in frames[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


def fill_from(first: DataFrame, second: DataFrame, max_docs: int, key: str = "series_id") -> DataFrame:
    """All of ``first`` and as much of ``second`` (newest first) as ``max_docs`` leaves room for; 0 is no limit."""
    both = first.withColumn("priority", F.lit(0)).unionByName(second.withColumn("priority", F.lit(1)), allowMissingColumns=True)
    if max_docs <= 0:
        return both
    from pyspark.sql import Window

    order = Window.partitionBy(key).orderBy("priority", F.desc("date"), F.desc("doc_id"))
    return both.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= max_docs).drop("_r")
