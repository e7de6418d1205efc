"""Writing run results: summaries, histories, traces, predictions and manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import safe_run_id, test_fields
from ..operators.ordered import numbered

# fixed values: the fields of a summary that concern results, in report order
SUMMARY_FIELDS = [
    "series_id", "run_id", "forecast_horizon", "dataset_fingerprint", "rolling_origin_count", "validation_size", "train_size", "test_size", "train_end",
    "validation_start", "validation_end", "test_start", "test_end", "seed", "semantic_reliability", "semantic_discriminability", "cross_modal_conflict",
    "search_breadth", "families_explored", "family_coverage_count", "best_validation_model", "best_validation_mase", "winning_model", "winning_candidate_id",
    "forecast_strategy", "best_hyperparameters", "val_mase", "val_rmse", "val_mse", "val_mae", "val_mape", "val_r2", "test_rmse", "test_mse", "test_mae",
    "stop_reason", "valid_training_count", "early_stop_used", "target_mase_reached", "mase_denominator_value", "mase_denominator_source",
]
EVENT_FIELDS = ["event_id", "event_type", "timestamp", "iteration", "influence_mode"]
MANIFEST_FIELDS = [
    "dataset_fingerprint", "candidate_catalog_fingerprint", "seed", "influence_mode", "maximum_valid_trainings", "forecast_horizon", "semantic_document_filtering",
]


def summary(results: DataFrame) -> DataFrame:
    """Results projected to the report fields; a field nobody computed is null."""
    return results.select(*[F.col(c) if c in results.columns else F.lit(None).cast("string").alias(c) for c in SUMMARY_FIELDS])


def isolated(df: DataFrame) -> DataFrame:
    """The same rows with a run id that is safe as a folder name; a run without any fails the job."""
    clean = safe_run_id(F.col("run_id").cast("string"))
    nothing = F.raise_error(F.lit("run_id has no usable character")).cast("string")
    return df.withColumn("run_id", F.coalesce(clean, nothing))


def write_runs(df: DataFrame, path: str, kind: str = "json", mode: str = "append") -> None:
    """One folder per run, as JSON lines or Parquet."""
    isolated(df).write.mode(mode).partitionBy("run_id").format(kind).save(path)


def events(new: DataFrame, trace: DataFrame | None = None) -> DataFrame:
    """Numbered trace events to append: (run_id, event_id, event_no, ...); held-out fields are refused.

    ``new``: run_id, arrival, event_type, timestamp, iteration, influence_mode, payload (JSON).
    Numbers go on from the last one that ``trace`` has for the run, whether or not it has all before it.
    """
    rows = numbered(new, "run_id", "arrival", pos="event_no", n=None)
    if trace is not None:
        have = trace.groupBy("run_id").agg(F.max("event_no").alias("_have"))
        rows = rows.join(have, "run_id", "left").withColumn("event_no", F.col("event_no") + F.coalesce("_have", F.lit(0))).drop("_have")
    rows = rows.withColumn("event_no", F.col("event_no") + 1).withColumn("event_id", F.concat(F.lit("search-event-"), F.col("event_no").cast("string")))
    refused = F.raise_error(F.lit("held-out field in a trace event")).cast("string")
    rows = rows.withColumn("payload", F.when(F.size(test_fields(F.col("payload"))) > 0, refused).otherwise(F.col("payload")))
    missing = [c for c in EVENT_FIELDS if c not in rows.columns]
    if missing:
        raise ValueError(f"trace events lack {missing}")
    return rows


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The table that earlier appends left at ``path``; None where there is none yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    # a first append that was lost may have left a folder without any result
    if not files.exists(folder) or not any(f.getPath().getName().endswith(".parquet") for f in files.listStatus(folder)):
        return None
    return spark.read.parquet(path)


def unseen(new: DataFrame, have: DataFrame | None, identity: Sequence[str]) -> DataFrame:
    """Rows of ``new`` whose identity ``have`` doesn't hold, one of each: the least by its other columns.  Nulls are equal to each other."""
    rest = [c for c in new.columns if c not in identity]
    # the rows of both tables meet by identity in one shuffle; what is held brings its identity only
    body = F.struct(*[F.col(c) for c in rest], F.lit(0).alias("_new"))
    both = new.select(*identity, body.alias("_rest"))
    if have is not None:
        both = both.unionByName(have.select(*identity, F.lit(None).cast(both.schema["_rest"].dataType).alias("_rest")))
    one = both.groupBy(*identity).agg(F.min("_rest").alias("_rest"), F.bool_or(F.col("_rest").isNull()).alias("_held")).filter(~F.col("_held"))
    return one.select(*[F.col("_rest")[c].alias(c) if c in rest else F.col(c).cast(new.schema[c].dataType) for c in new.columns])


def append_once(new: DataFrame, path: str, identity: Sequence[str]) -> None:
    """Appends rows to a Parquet table at most once each, so that a job that is repeated, in whole or in part, adds only what is missing.

    ``identity`` names the columns that tell rows apart, e.g. run and step of a history, run, origin
    and position of predictions, run of a manifest.  One writer at a time.
    """
    unseen(new, stored(new.sparkSession, path), identity).write.mode("append").parquet(path)


def append_events(new: DataFrame, path: str) -> None:
    """Appends trace events, each (run_id, batch_id, arrival) once, numbered after the last event of its run.

    ``new``: as for ``events``, and batch_id, the same whenever the batch is delivered again.  An
    event without a run fails the job.
    """
    kind = new.schema["run_id"].dataType
    new = new.withColumn("run_id", F.coalesce("run_id", F.raise_error(F.lit("an event without run_id")).cast(kind)))
    have = stored(new.sparkSession, path)
    fresh = unseen(new, have, ["run_id", "batch_id", "arrival"])
    events(fresh, have).write.mode("append").parquet(path)


def manifest(runs: DataFrame) -> DataFrame:
    """One manifest row per run: the allowed fields that are known."""
    return runs.select("run_id", *[c for c in MANIFEST_FIELDS if c in runs.columns])
