"""Pages without a mark leave a search for revision tables early."""

from docengine.operators import tables


def test_pages_without_a_mark_go_no_further(spark, monkeypatch):
    kept = []
    cut = tables.cut
    monkeypatch.setattr(tables, "cut", lambda df: kept.append(cut(df)) or kept[-1])
    words = [("Разрешение", (0.05, 0.05, 0.25, 0.08)), ("Изм.", (0.05, 0.15, 0.1, 0.17)), ("Лист", (0.12, 0.15, 0.18, 0.17)), ("Содержание изменения", (0.2, 0.15, 0.6, 0.17)), ("7", (0.13, 0.2, 0.17, 0.22)), ("Замена листа", (0.65, 0.2, 0.8, 0.22))]
    rows = [(p, i, w, *b, True) for p in (1, 2) for i, (w, b) in enumerate(words[: 7 - p])]
    got = tables.revision_tables(spark.createDataFrame(rows, "page int, id int, text string, x0 double, y0 double, x1 double, y1 double, usable boolean"))
    assert [tuple(r) for r in got.collect()] == [(1, "observed_replaced_sheet", 4)]
    assert {r.page for r in kept[0].collect()} == {1}
