"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from docengine.session import cut


def folder(spark) -> str:
    """A new path below the session's checkpoint folder (spark.checkpoint.dir)."""
    if spark.sparkContext.getCheckpointDir() is None:
        cut(spark.range(0))  # sets the folder as the session names it
    return f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The rows of df as a Parquet table, which takes less room than a checkpoint and is read by column."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
