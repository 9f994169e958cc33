"""Revision tables of pages with more than 200 blocks and of tables with more than 32 marks."""

from docengine.operators import tables

HEAD = [("Разрешение", (0.05, 0.05, 0.25, 0.08)), ("Изм.", (0.05, 0.15, 0.1, 0.17)), ("Лист", (0.12, 0.15, 0.18, 0.17)), ("Содержание изменения", (0.2, 0.15, 0.6, 0.17))]


def test_all_blocks_and_marks(spark):
    rows = [[1, i, w, *b, True] for i, (w, b) in enumerate(HEAD)]
    for k in range(40):  # rows of 0.004, 0.006 apart
        y = 0.175 + 0.006 * k
        rows += [[1, 1000 + k, "Замена листа", 0.65, y, 0.8, y + 0.004, True], [1, 2000 + k, f"{k + 1}", 0.13, y, 0.17, y + 0.004, True], [1, 3000 + k, f"{k + 1}", 0.06, y, 0.09, y + 0.004, True]]
    rows += [[1, 5000 + k, "прочее", 0.3, 0.9, 0.4, 0.92, k % 2 == 0] for k in range(200)]
    got = tables.revision_tables(spark.createDataFrame(rows, "page int, id int, text string, x0 double, y0 double, x1 double, y1 double, usable boolean"))
    want = [("observed_replaced_sheet", 2000 + k) for k in range(40)] + [("revision_label", 3000 + k) for k in range(40)]
    assert sorted((r.field, r.id) for r in got.collect()) == sorted(want)
