"""A join filter of fixed size: a bitmap of hashed keys, built by an aggregation and broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def whole(df: DataFrame) -> Column:
    """A row of df as one struct, so that helper columns beside it clash with no name of df's."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns])


def _words(keys: DataFrame, name: str, slot: str) -> DataFrame:
    at = keys.select(F.expr(f"{slot.format(f'`{name}`')} div 64").alias("word"), F.expr(f"shiftleft(1L, cast({slot.format(f'`{name}`')} % 64 as int))").alias("bit"))
    return at.groupBy("word").agg(F.bit_or("bit").alias("bits"))


def sieved(df: DataFrame, keys: DataFrame, name: str, bits: int = 22) -> DataFrame:
    """The rows of df whose key may occur in keys; rows with other keys are mostly dropped.

    The bitmap has 2**bits bits whatever the number of keys, so its broadcast has a proven bound;
    with too many keys for it, it only drops fewer rows. An exact join must follow.
    """
    slot = f"pmod(xxhash64({{}}), {1 << bits})"
    marked = df.select(whole(df).alias("row"), F.expr(slot.format(f"`{name}`")).alias("slot")).withColumn("word", F.expr("slot div 64"))
    return marked.join(F.broadcast(_words(keys, name, slot)), "word").filter("(bits & shiftleft(1L, cast(slot % 64 as int))) != 0L").select("row.*")


def _maybe(df: DataFrame, keys: DataFrame, name: str, bits: int) -> DataFrame:
    """(row, key, maybe): whether the bitmap of keys has the row's key."""
    slot = f"pmod(xxhash64({{}}), {1 << bits})"
    marked = df.select(whole(df).alias("row"), F.col(f"`{name}`").alias("key"), F.expr(slot.format(f"`{name}`")).alias("slot")).withColumn("word", F.expr("slot div 64"))
    marked = marked.join(F.broadcast(_words(keys, name, slot)), "word", "left")
    return marked.select("row", "key", F.expr("coalesce((bits & shiftleft(1L, cast(slot % 64 as int))) != 0L, false)").alias("maybe"))


def parted(df: DataFrame, keys: DataFrame, name: str, bits: int = 22) -> tuple[DataFrame, DataFrame]:
    """The rows of df whose key isn't in keys for sure, and all others, which an exact join must tell apart."""
    marked = _maybe(df, keys, name, bits)
    return marked.filter("not maybe").select("row.*"), marked.filter("maybe").select("row.*")


def without(df: DataFrame, keys: DataFrame, name: str, bits: int = 22) -> DataFrame:
    """The rows of df whose key isn't in keys. Only rows that the bitmap can't clear are shuffled."""
    marked = _maybe(df, keys, name, bits)
    gone = keys.select(F.col(f"`{name}`").alias("key"), F.lit(True).alias("gone")).distinct()
    # an outer join: an anti join would be moved below the sieve
    rest = marked.filter("maybe").join(gone, "key", "left").filter("gone is null").select("row.*")
    return marked.filter("not maybe").select("row.*").unionByName(rest)
