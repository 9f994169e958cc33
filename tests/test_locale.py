"""Locale order: alphabets, case and accents."""

from pyspark.sql import functions as F

from docengine.functions import text as t


def test_order(spark):
    words = ["a", "A", "á", "ab", "Ab", "b", "B", "z", "Z", "а", "А", "ё", "Ё", "ж", "я", "1", "10", "2", "_", ""]
    df = spark.createDataFrame([(w,) for w in reversed(words)], "x string")
    got = [r.x for r in df.orderBy(t.locale_key(F.col("x"))).collect()]
    assert got == ["", "_", "1", "10", "2", "a", "A", "á", "ab", "Ab", "b", "B", "z", "Z", "а", "А", "ё", "Ё", "ж", "я"]
    pairs = spark.createDataFrame([("a", "B"), ("B", "a"), ("ё", "ж"), ("x", "x"), (None, "x")], "a string, b string")
    assert [r[0] for r in pairs.select(t.locale_compare(F.col("a"), F.col("b"))).collect()] == [-1, 1, -1, 0, None]
