"""Periods and days are listed a few times each for their join, not once for each length of stretches."""

import datetime
import random

from docengine.operators import intervals as v

DAY = datetime.date(2020, 1, 1)
at = lambda n: DAY + datetime.timedelta(n)


def records(spark):
    gateway = spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_few_rows_are_shuffled(spark):
    rnd = random.Random(4)
    days = spark.createDataFrame([(i, i % 3, at(rnd.randrange(2000))) for i in range(3000)], "i int, k int, d date")
    periods = spark.createDataFrame([(j, j % 3, at(b), at(b + 120)) for j, b in enumerate(rnd.randrange(2000) for _ in range(3000))], "j int, k int, f date, t date")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = records(spark)
        n = v.holding(days, "d", periods, "f", "t", ["k"]).count()
        moved = records(spark) - before
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert n == days.join(periods, "k").filter("d between f and t").count()
    assert moved < 5 * 6000 / 2


def test_lengths_of_every_size(spark):
    rnd = random.Random(5)
    lengths = [0] * 150 + [3] * 20 + [40] * 30 + [900] * 80 + [-2]
    periods = [(j, at(b), None if rnd.random() < 0.1 else at(b + n)) for j, (b, n) in enumerate((rnd.randrange(1500), n) for n in lengths)]
    days = [(i, at(rnd.randrange(-30, 2600))) for i in range(30)] + [(30, None)]
    assert len(set(v._levels(len(days), {0: 150, 2: 20, 5: 30, 9: 80}))) > 1
    got = v.holding(spark.createDataFrame([(*d, 1) for d in days], "i int, d date, k int"), "d", spark.createDataFrame([(*p, 1) for p in periods], "j int, f date, t date, k int"), "f", "t", ["k"])
    assert got.columns == ["k", "i", "d", "j", "f", "t"]
    want = [(i, j) for i, d in days for j, f, t in periods if d and f <= d and (t is None or d <= t)]
    assert sorted((r.i, r.j) for r in got.collect()) == sorted(want)
