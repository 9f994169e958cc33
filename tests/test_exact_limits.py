"""Numbers that can't be held are null, not cut."""

from pyspark.sql import functions as F

from docengine.functions import exact as x


def test_beyond_171_digits(spark):
    df = spark.createDataFrame([("9" * 80,), ("-" + "9" * 80,), ("1",)], "a string").select(x.product(x.number(F.col("a")), "9" * 80).alias("p"))
    got = [tuple(r) for r in df.select(x.text(x.shifted(F.col("p"), F.lit(30))), x.text(x.shifted(F.col("p"), F.lit(11)))).collect()]
    square = str((10**80 - 1) ** 2) + "0" * 11
    assert got == [(None, square), (None, "-" + square), ("9" * 80 + "0" * 30, "9" * 80 + "0" * 11)]
