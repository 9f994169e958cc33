"""Counting, bucketing, paging and set operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def buckets_with_gaps(events: DataFrame, at: str, unit: str, start: str, stop: str) -> DataFrame:
    """(bucket, n) for every hour or day from start to stop (exclusive), 0 where nothing happened."""
    if unit not in ("hour", "day"):
        raise ValueError("unit must be hour or day")
    spark: SparkSession = events.sparkSession
    span = f"sequence(timestamp'{start}', timestamp'{stop}' - interval 1 {unit}, interval 1 {unit})"
    every = spark.range(1).select(F.explode(F.expr(span)).alias("bucket"))
    inside = events.filter((F.col(at) >= F.expr(f"timestamp'{start}'")) & (F.col(at) < F.expr(f"timestamp'{stop}'")))
    found = inside.groupBy(F.date_trunc(unit, at).alias("bucket")).agg(F.count("*").alias("n"))
    return every.join(found, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def period_change(events: DataFrame, at: str, start: str, middle: str, stop: str) -> DataFrame:
    """Counts of two periods and the change in percent to one decimal, halves towards +infinity; null after an empty period."""
    edge = [F.expr(f"timestamp'{x}'") for x in (start, middle, stop)]
    row = events.agg(
        F.count_if((F.col(at) >= edge[1]) & (F.col(at) < edge[2])).alias("current"), F.count_if((F.col(at) >= edge[0]) & (F.col(at) < edge[1])).alias("previous")
    )
    share = (F.col("current") - F.col("previous")) / F.col("previous")
    return row.withColumn("delta_percent", F.when(F.col("previous") > 0, F.floor(share * 1000 + 0.5) / 10))


def histogram(df: DataFrame, value: str, bounds: Sequence[float], by: str) -> DataFrame:
    """Cumulative counts by upper bound, sum and count of each group; one pass over the rows."""
    counts = [F.count_if(F.col(value) <= b).alias(f"le_{i}") for i, b in enumerate(bounds)]
    wide = df.groupBy(by).agg(*counts, F.count(value).alias("n"), F.sum(value).alias("total"))
    entries = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"le_{i}").alias("cumulative")) for i, b in enumerate(bounds)])
    return wide.select(by, "n", "total", F.explode(entries).alias("e")).select(by, "e.le", "e.cumulative", "n", "total")


def keyset_page(df: DataFrame, order: Sequence[tuple[str, bool]], after: Sequence | None, size: int) -> DataFrame:
    """The next size + 1 rows behind the cursor; order: (column, descending)."""
    if after is not None:
        condition = F.lit(False)
        for i, (name, down) in enumerate(order):
            same = F.lit(True)
            for (earlier, _), value in zip(order[:i], after, strict=False):
                same = same & (F.col(earlier) == F.lit(value))
            beyond = F.col(name) < F.lit(after[i]) if down else F.col(name) > F.lit(after[i])
            condition = condition | (same & beyond)
        df = df.filter(condition)
    return df.orderBy(*[F.col(n).desc() if down else F.col(n).asc() for n, down in order]).limit(size + 1)


def offset_page(df: DataFrame, order: Sequence[Column], skip: int, take: int) -> DataFrame:
    return df.orderBy(*order).offset(skip).limit(take)


def first_by(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column]) -> DataFrame:
    """One row per key expression: the first in order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def interleaved(df: DataFrame, source: str, order: Sequence[Column]) -> DataFrame:
    """Round-robin: the sources' first rows, then their second, ...; adds turn."""
    w = Window.partitionBy(source).orderBy(*order)
    return df.withColumn("turn", F.row_number().over(w)).orderBy("turn", source)


def merged_spans(df: DataFrame, key: str, start: str, stop: str) -> DataFrame:
    """Unions of overlapping or touching [start, stop] spans of each key, with the number merged."""
    w = Window.partitionBy(key).orderBy(start, stop)
    before = F.max(stop).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("_new", F.when(F.col(start) <= before, 0).otherwise(1))
    island = marked.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(key, "_island").agg(F.min(start).alias(start), F.max(stop).alias(stop), F.count("*").alias("n_merged")).drop("_island")


def clusters(df: DataFrame, key: str, value: str, tolerance: float) -> DataFrame:
    """One-dimensional clusters of each key: a gap above the tolerance begins a new one."""
    w = Window.partitionBy(key).orderBy(value)
    gap = F.col(value) - F.lag(value).over(w)
    marked = df.withColumn("_new", F.when(gap <= tolerance, 0).otherwise(1))
    numbered = marked.withColumn("_cluster", F.sum("_new").over(w.rangeBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "_cluster").agg(F.avg(value).alias("center"), F.count("*").alias("n")).withColumnRenamed("_cluster", "cluster")
