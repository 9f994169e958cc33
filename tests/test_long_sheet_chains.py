"""Sheet sets behind more than 32 revisions, and long cycles beside them."""

from docengine.operators import sheets


def test_chains_have_no_limit(spark):
    n = 75
    before = {i: i - 1 if i else None for i in range(n)} | {100 + i: 100 + (i + 1) % 9 for i in range(9)} | {200: 103, 201: 201, 202: 999}
    links = spark.createDataFrame(list(before.items()), "id long, predecessor_id long")
    own = spark.createDataFrame([(i, i % 2) for i in before], "revision_id long, label long")
    replaced = spark.createDataFrame([(50, 0)], "revision_id long, label long")
    got = sorted(map(tuple, sheets.sheet_sets(own, replaced, links).collect()))
    assert got == sorted((i, k % 2, k) for i in range(n) for k in range(i + 1) if i < 50 or k % 2 or k >= 50)
