"""Periods listed by plain columns have the nodes that ``nodes`` names, within the days asked for."""

import datetime
import random

from pyspark.sql import functions as F

from docengine.operators import intervals as v


def test_same_nodes(spark):
    rnd, day = random.Random(5), datetime.date(2020, 1, 1)
    at = lambda n: day + datetime.timedelta(n)
    rows = [(i, at(b), at(b + rnd.randrange(-3, 400)) if rnd.random() < 0.8 else None) for i, b in enumerate(rnd.randrange(900) for _ in range(200))] + [(999, None, at(3))]
    df = spark.createDataFrame(rows, "id int, f date, t date")
    want = df.select("id", F.explode(v.nodes(F.col("f"), F.col("t"))).alias("_node"))
    got = v._listed(df, "f", "t", 0, v.LAST).select("id", "_node")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    days = spark.createDataFrame([(k, at(rnd.randrange(-50, 1500))) for k in range(200)], "k int, d date").withColumn("g", F.lit(1))
    met = v.holding(days, "d", df.withColumn("g", F.lit(1)), "f", "t", ["g"]).select("k", "id")
    plain = days.crossJoin(df).filter("f <= d and (t is null or t >= d)").select("k", "id")
    assert sorted(map(tuple, met.collect())) == sorted(map(tuple, plain.collect()))
    assert v.holding(days.limit(0), "d", df.withColumn("g", F.lit(1)), "f", "t", ["g"]).count() == 0
