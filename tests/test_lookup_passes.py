"""A table look-up deals its cells once."""

from docengine.operators import extract


def test_table_lookup_shuffles_once(spark):
    cells = spark.createDataFrame([(t, r, c, x) for t in (1, 2) for r, row in enumerate([("Name", "Price"), ("Line 1", "2,5"), ("Line 1 b", "x 3")]) for c, x in enumerate(row)] + [(2, 0, 5, "unit")], "t int, row int, col int, text string")
    found = extract.table_lookup(cells, "t", ["price"], "line 1", 1, ["unit"], "price")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == [(2, 1, 1, 2.5), (2, 1, 2, 3.0)]
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
