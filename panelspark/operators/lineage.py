"""Cutting long lineages."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Takes shuffle files away as soon as their query has ended, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def without_leftovers(spark: SparkSession) -> Iterator[None]:
    """Within, a query that has ended leaves no shuffle files; for writes, whose plans nothing runs again."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the cluster's checkpoint folder and go on from there.

    The folder is the one the session names in ``spark.checkpoint.dir``; only where none is named
    and Spark runs in this process alone (tests) a folder is made.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as a table to the shared folder and read it back.

    For long loops: a checkpointed table keeps the size that was estimated for its plan, and joined with itself round
    after round that estimate grows to a number of millions of digits.
    """
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    with without_leftovers(df.sparkSession):
        df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors reach: the one named in ``spark.checkpoint.dir``, else one made for tests; a cluster must name it."""
    context = spark.sparkContext
    found = context._jsc.sc().getCheckpointDir()
    if found.isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if context.master.split("[")[0] != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all executors reach")
            named = tempfile.mkdtemp(prefix="panelspark-checkpoint-")
        context.setCheckpointDir(named)
        found = context._jsc.sc().getCheckpointDir()
    return found.get()
