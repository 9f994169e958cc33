"""Merged spans of days with many equal ones, against a sweep."""

import random

from docengine.operators.counts import merged_spans


def test_equal_spans(spark):
    r = random.Random(3)
    rows = [(k, x, x + 4) for k in range(40) for x in r.choices(range(60), k=12) for _ in range(r.choice([1, 6]))]
    got = sorted(map(tuple, merged_spans(spark.createDataFrame(rows, "k int, a int, b int").repartition(4), "k", "a", "b").select("k", "a", "b", "n_merged").collect()))
    want = []
    for k, a, b in sorted(rows):
        if want and want[-1][0] == k and a <= want[-1][2]:
            want[-1] = (k, want[-1][1], max(b, want[-1][2]), want[-1][3] + 1)
        else:
            want.append((k, a, b, 1))
    assert got == want
