"""Period joins, box pairs and the seeded bootstrap against brute force."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from docengine.operators import intervals as v
from docengine.operators import metrics as m

DAY = datetime.date


def day(n):
    return DAY(2020, 1, 1) + datetime.timedelta(days=n)


@pytest.fixture(scope="module")
def periods(spark):
    r = random.Random(1)
    make = lambda: (r.choice("aab"), day(r.randrange(300)), r.choice([None, *[r.randrange(-2, 90)] * 6]))
    rows = [[(i, k, f, None if n is None else f + datetime.timedelta(days=n)) for i, (k, f, n) in enumerate(make() for _ in range(120))] for _ in range(2)]
    rows[0] += [(200, "a", None, day(3)), (201, None, day(3), day(4)), (202, "a", DAY(1, 1, 1), DAY(9999, 12, 31))]
    left = spark.createDataFrame(rows[0], "i int, k string, f date, t date")
    right = spark.createDataFrame(rows[1], "j int, k string, rf date, rt date")
    return rows, left, right


def test_holding_and_overlapping(periods):
    rows, left, right = periods
    proper = lambda f, t: f is not None and (t is None or f <= t)
    hold = {(i, j) for i, k, f, _ in rows[0] for j, k2, rf, rt in rows[1] if k == k2 and k and f and proper(rf, rt) and rf <= f and (rt is None or f <= rt)}
    got = [(r.i, r.j) for r in v.holding(left, "f", right, "rf", "rt", ["k"]).collect()]
    assert sorted(got) == sorted(hold) and len(hold) > 500
    meet = {(i, j) for i, k, f, t in rows[0] for j, k2, rf, rt in rows[1] if k == k2 and k and proper(f, t) and proper(rf, rt) and (t is None or rf <= t) and (rt is None or f <= rt)}
    got = [(r.i, r.j) for r in v.overlapping(left, "f", "t", right, "rf", "rt", ["k"]).collect()]
    assert sorted(got) == sorted(meet)


def test_nodes_are_few_and_exact(spark):
    r = random.Random(2)
    rows = [(day(a), day(a + n)) for a, n in ((r.randrange(2000), r.randrange(700)) for _ in range(60))]
    for f, t, nodes in spark.createDataFrame(rows, "f date, t date").select("f", "t", v.nodes(F.col("f"), F.col("t"))).collect():
        days = sorted(d for x in nodes for d in range((x & 0xFFFFFFFF) << (x >> 32), ((x & 0xFFFFFFFF) + 1) << (x >> 32)))
        zero = DAY(1970, 1, 1).toordinal() - 719_528
        assert days == list(range(f.toordinal() - zero, t.toordinal() - zero + 1)) and len(nodes) <= 2 * math.log2(len(days) + 1) + 1


def test_empty_periods(spark):
    none = spark.createDataFrame([], "j int, k string, rf date, rt date")
    some = spark.createDataFrame([(1, "a", day(1), None)], "i int, k string, f date, t date")
    assert v.holding(some, "f", none, "rf", "rt", ["k"]).count() == 0 and v.overlapping(some, "f", "t", none, "rf", "rt", ["k"]).count() == 0


@pytest.mark.parametrize("least", [0.5, 0.8, 0.3, 1.0])
def test_iou_pairs(spark, least):
    r = random.Random(3)

    def box():
        w, h = 2 ** r.uniform(-4, 3), r.choice([0.2, 2 ** r.uniform(-2, 1)])
        x, y = r.uniform(-2, 2), r.uniform(0, 1)
        return x, y, x + w, y + h

    left = [(i, r.randrange(2), *box()) for i in range(200)]
    right = [(i, r.randrange(2), *box()) for i in range(100)] + [(1000 + i, p, *[z + r.uniform(-0.1, 0.1) * (c - a) for z in (a, b, c, d)]) for i, p, a, b, c, d in left] + [(2000 + x[0], *x[1:]) for x in left[:50]]
    left += [(500, 0, 1.0, 1.0, 1.0, 2.0), (501, 0, None, 0.0, 1.0, 1.0), (502, None, 0.0, 0.0, 1.0, 1.0)]

    def iou(a, b):
        w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        i = max(w, 0) * max(h, 0)
        return i / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - i)

    fine = [x for x in left if None not in x and x[4] > x[2]]
    want = sorted((x[0], y[0]) for x in fine for y in right if y[4] > y[2] and y[5] > y[3] and x[1] == y[1] and iou(x[2:], y[2:]) >= least)
    got = m.iou_pairs(spark.createDataFrame(left, "i int, page int, x0 double, y0 double, x1 double, y1 double"), spark.createDataFrame(right, "j int, page int, ox0 double, oy0 double, ox1 double, oy1 double"), "page", least)
    assert sorted((g.i, g.j) for g in got.collect()) == want and want


def brute(rows, rounds, seed):
    """rows: (object, hits, n); the generator step by step."""
    objects = sorted({o for o, _, _ in rows if o is not None})
    if len(objects) < 2:
        return (len(objects), 0, None, None, "fewer than two independent objects")
    state, values = seed, []
    for _ in range(rounds):
        hits = n = 0
        for _ in objects:
            state = (1664525 * state + 1013904223) % (1 << 32)
            o = objects[math.floor(state / (1 << 32) * len(objects))]
            hits, n = hits + sum(h for p, h, _ in rows if p == o), n + sum(k for p, _, k in rows if p == o)
        if n:
            values.append(hits / n)
    values.sort()
    if len(values) / rounds < 0.95:
        return (len(objects), len(values), None, None, "too many undefined-denominator resamples")
    return (len(objects), len(values), values[math.floor(0.025 * (len(values) - 1))], values[math.ceil(0.975 * (len(values) - 1))], None)


def test_bootstrap_to_the_last_bit(spark):
    r = random.Random(4)
    measure = lambda k: F.try_divide(F.sum(F.col("hits") * k), F.sum(F.col("n") * k))
    cases = [([(f"o{r.randrange(9)}", r.randrange(5), 7) for _ in range(40)] + [(None, 9, 9)], 300, 20260927), ([("a", 1, 2)], 10, 1), ([], 10, 1), ([("a", 1, 0), ("b", 0, 0), ("c", 1, 1)], 60, 5), ([(f"{i:04d}", i % 3, 2) for i in range(1500)], 12, 0xFFFFFFFF)]
    for rows, rounds, seed in cases:
        df = spark.createDataFrame(rows, "object string, hits int, n int").repartition(3)
        assert tuple(m.bootstrap(df, "object", measure, rounds, seed).first()) == brute(rows, rounds, seed)
