"""Line-based sources with contracts: JSON lines and tables with a bar between values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def json_lines(spark: SparkSession, path: str, schema: str, rows: int | None = None) -> DataFrame:
    """One row a line; a line that is no object of the schema fails the job, and so does another number of rows."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if rows is not None and (n := df.count()) != rows:
        raise ValueError(f"{rows} rows expected, {n} found")
    return df


def of_kind(df: DataFrame, kind: str, kind_col: str = "kind") -> DataFrame:
    """The rows of one kind from a file that mixes several."""
    return df.filter(F.col(kind_col) == kind)


def barred_table(spark: SparkSession, path: str, columns: list[str], key: str, keys: DataFrame | None = None, lists: dict[str, list[str]] | None = None) -> DataFrame:
    """A table with the header ``columns``, every value filled in.

    ``lists`` names columns of values between commas, each distinct and one of those allowed; they become
    arrays. With ``keys`` (a column of the name ``key``), each of them must have exactly one row.
    """
    lists = lists or {}
    header = spark.read.text(path).filter("length(trim(value)) > 0").first()
    if header is None or header.value != "|".join(columns):
        raise ValueError("header mismatch")
    df = spark.read.csv(path, schema=", ".join(f"`{c}` string" for c in columns), sep="|", header=True, quote="", mode="FAILFAST", enforceSchema=False)
    blank, wrong = F.lit(False), F.lit(False)
    for c in columns:
        blank = blank | (F.length(F.trim(F.coalesce(c, F.lit("")))) == 0)
    for c, allowed in lists.items():
        parts = F.split(c, ",")
        wrong = wrong | (F.size(F.array_distinct(parts)) < F.size(parts)) | (F.size(F.array_except(parts, F.array(*map(F.lit, allowed)))) > 0)
    if not df.filter(blank).isEmpty():
        raise ValueError("incomplete row")
    if lists and not df.filter(wrong).isEmpty():
        raise ValueError("invalid list")
    if keys is not None:
        n = df.groupBy(key).agg(F.count("*").alias("n")).join(keys.select(key, F.lit(1).alias("want")), key, "full")
        if not n.filter("not (n <=> 1 and want <=> 1)").isEmpty():
            raise ValueError("each key must have exactly one row")
    return df.select(*[F.split(c, ",").alias(c) if c in lists else F.col(c) for c in columns])
