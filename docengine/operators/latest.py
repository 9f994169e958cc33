"""Latest attempt per key and its variants.

All of them rank within a key by a window, so a key's rows meet in one task once; ties must be
broken by the order given.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n).drop("_rank")


def rank_then_filter(df: DataFrame, keys: Sequence[str], order: Sequence[Column], condition: Column) -> DataFrame:
    """The newest row of each key, if it meets the condition."""
    return top_per_key(df, keys, order).filter(condition)


def filter_then_rank(df: DataFrame, keys: Sequence[str], order: Sequence[Column], condition: Column) -> DataFrame:
    """The newest of each key's rows that meet the condition."""
    return top_per_key(df.filter(condition), keys, order)


def latest_with_default(base: DataFrame, attempts: DataFrame, key: str, order: Sequence[Column], column: str, default: str) -> DataFrame:
    """Every base row with the column of its newest attempt, or the default."""
    newest = top_per_key(attempts, [key], order).select(key, column)
    return base.join(newest, key, "left").withColumn(column, F.coalesce(column, F.lit(default)))


def without_newer(df: DataFrame, key: str, version: str) -> DataFrame:
    """Rows of which no row of the same key has a greater version (all of equal greatest ones)."""
    newest = F.max(version).over(Window.partitionBy(key))
    return df.withColumn("_newest", newest).filter(F.col(version) == F.col("_newest")).drop("_newest")


def undone(base: DataFrame, done: DataFrame, keys: Sequence[str], order: Sequence[Column], limit: int) -> DataFrame:
    """Work discovery: base rows without a matching done row, the first ``limit`` in order."""
    return base.join(done.select(*keys).distinct(), list(keys), "left_anti").orderBy(*order).limit(limit)


def append_versions(existing: DataFrame, new: DataFrame, keys: Sequence[str], content: str) -> DataFrame:
    """Rows to append: new contents only, with the key's next version.

    existing and new have the keys and a content hash; existing also has version.
    """
    fresh = new.join(existing.select(*keys, content), [*keys, content], "left_anti")
    last = existing.groupBy(*keys).agg(F.max("version").alias("_last"))
    return fresh.join(last, list(keys), "left").withColumn("version", (F.coalesce("_last", F.lit(0)) + 1).cast("int")).drop("_last")
