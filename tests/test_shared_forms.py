"""Cells that all pages share; repeated items count once."""

from docengine.operators import layout as y

ITEMS = "page int, id int, x0 double, y0 double, x1 double, y1 double"


def test_cells_without_a_page(spark):
    cells = spark.createDataFrame([(0, 0, 0.0, 0.0, 0.5, 1.0), (1, 0, 0.5, 0.0, 1.0, 1.0)], "cell int, row int, x0 double, y0 double, x1 double, y1 double")
    items = spark.createDataFrame([(1, 1, 0.1, 0.1, 0.3, 0.2)] * 2 + [(1, 2, 0.4, 0.1, 0.6, 0.2), (2, 1, 0.7, 0.1, 0.8, 0.2), (2, 3, 2.0, 2.0, 3.0, 3.0)], ITEMS)
    assert sorted(map(tuple, y.cells_of(items, cells, "page", "id").collect())) == [(1, 1, 0), (1, 2, 1), (2, 1, 1)]
    linked = y.association(items, cells, "page", "id")
    assert sorted(map(tuple, linked.collect())) == [(1, 1, "cell"), (1, 2, "row"), (2, 1, "cell"), (2, 3, "none")]
    each = spark.createDataFrame([(1,), (2,)], "page int").crossJoin(cells)
    assert sorted(map(tuple, y.association(items, each, "page", "id").collect())) == sorted(map(tuple, linked.collect()))
