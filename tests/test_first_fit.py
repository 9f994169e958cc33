"""One-to-one matching against a plain loop."""

import random

from docengine.operators import metrics


def test_first_fit(spark):
    rnd = random.Random(1)
    rows = sorted({(p, rnd.randrange(12), rnd.randrange(12)) for p in range(5) for _ in range(60)})
    used, done, want = set(), set(), []
    for p, n, m in rows:
        if (p, n) not in done and (p, m) not in used:
            done.add((p, n)), used.add((p, m)), want.append((p, n, m))
    rnd.shuffle(rows)
    got = metrics.first_fit(spark.createDataFrame(rows, "page long, n int, m int"), "page")
    assert sorted(map(tuple, got.collect())) == want
    assert "InArrow" in got._jdf.queryExecution().toString()
