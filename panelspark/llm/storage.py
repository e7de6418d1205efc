"""Tables written once to the shared folder and read again, so that their true sizes are known to the planner."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from ..operators.lineage import shared_folder, without_leftovers


def written(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """``df`` as a Parquet table in the cluster's checkpoint folder; the shuffle files that made it are gone afterwards."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    with without_leftovers(spark):
        df.write.option("compression", compression).parquet(path)
    return spark.read.parquet(path)
