"""Distances by diagonals against those by bits, and areas against counted cells."""

import random

from pyspark.sql import functions as F

from docengine.operators import metrics as m


def test_near_distances():
    r = random.Random(1)
    text = lambda: "".join(r.choice("ab") for _ in range(r.choice([0, 1, 2, 5, 9, 40])))
    for _ in range(2000):
        a = text()
        b = r.choice([text(), a[:3] + "c" + a[4:], a[2:]])
        want = m._distance(a, b)
        assert m._near_distance(a, b, 200) == want, (a, b)
        assert m._near_distance(a, b, 3) == (want if want <= 3 else None), (a, b)


def test_equal_pairs_count_each_time(spark):
    long = "мир " * 3000
    df = spark.createDataFrame([("k", long, long[2:-1])] * 3 + [("k", "abc", "xbcd"), ("k", None, "a"), ("k", "a", None)], "g string, e string, x string")
    assert tuple(m.character_errors(df, "e", "x", "g").select("errors", "chars").first()) == (3 * 3 + 2, 3 * len(long) + 4)


def test_union_areas(spark):
    r = random.Random(2)
    rows = []
    for k in range(300):
        for _ in range(r.choice([1, 4, 30])):
            x, y = r.randrange(12), r.randrange(12)
            rows.append((k, float(x), float(y), float(x + r.randrange(4)), float(y + r.randrange(4))))
    odd = [(-1, None, 0.0, 1.0, 1.0), (-2, 0.0, 0.0, 2.0, 1.0), (-2, None, 0.0, 9.0, 9.0), (-2, 1.0, 0.0, float("nan"), 3.0)]
    df = spark.createDataFrame(rows + odd, "k long, x0 double, y0 double, x1 double, y1 double").repartition(3)
    got = {x[0]: x[1] for x in m.union_area(df, "k").collect()}
    want = {k: set() for k in range(300)}
    for k, x0, y0, x1, y1 in rows:
        want[k] |= {(x, y) for x in range(int(x0), int(x1)) for y in range(int(y0), int(y1))}
    assert got == {k: float(len(v)) for k, v in want.items()} | {-1: 0.0, -2: 2.0}
    assert m.union_area(df.filter(F.lit(False)), "k").count() == 0
