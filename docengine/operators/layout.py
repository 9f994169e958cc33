"""Geometry of pages and table cells: overlaps, owners, captions, spans.

All joins have an equality on the page (or table), so they are hash or merge joins with a
residual condition and never nested loops over all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docengine.session import dealt

CORNERS = ("x0", "y0", "x1", "y1")


def box(prefix: str = "") -> tuple[Column, ...]:
    return tuple(F.col(f"{prefix}{c}") for c in CORNERS)


def area(b: tuple[Column, ...]) -> Column:
    return (b[2] - b[0]) * (b[3] - b[1])


def intersection(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    w, h = F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def _prefixed(df: DataFrame, prefix: str, keep: str) -> DataFrame:
    return df.select(*[F.col(c) if c == keep else F.col(c).alias(f"{prefix}{c}") for c in df.columns])


def same_ink(boxes: DataFrame, page: str, key: str, share: float) -> DataFrame:
    """(page, key, o_key): pairs of one page whose intersection covers that share of the smaller box."""
    other = _prefixed(boxes, "o_", page)
    both = boxes.join(other, page).filter(F.col(key) < F.col(f"o_{key}"))
    part = F.try_divide(intersection(box(), box("o_")), F.least(area(box()), area(box("o_"))))
    return both.filter(part >= share).select(page, key, f"o_{key}")


def conflicting(boxes: DataFrame, page: str, key: str, share: float) -> DataFrame:
    """The boxes that overlap another one: both of a pair abstain."""
    found = same_ink(boxes, page, key, share)
    bad = found.select(page, key).unionByName(found.select(page, F.col(f"o_{key}").alias(key))).distinct()
    return boxes.join(bad, [page, key], "left_semi")


def owners(items: DataFrame, regions: DataFrame, page: str, key: str, share: float) -> DataFrame:
    """Each item with the region that covers most of it (the share at least), abstaining regions first; null without one."""
    both = items.join(_prefixed(regions, "r_", page), page)
    part = F.try_divide(intersection(box(), box("r_")), area(box()))
    w = Window.partitionBy(page, key).orderBy(F.desc("r_abstains"), F.desc("part"), "r_region")
    best = both.withColumn("part", part).filter(F.col("part") >= share).withColumn("_rank", F.row_number().over(w)).filter("_rank = 1")
    return items.join(best.select(page, key, F.col("r_region").alias("region")), [page, key], "left")


def _with_cells(items: DataFrame, cells: DataFrame, page: str) -> DataFrame:
    """Each item with the cells (c_...) of its page; cells without a page are one form, a few rows, that all pages share."""
    cells = _prefixed(cells, "c_", page)
    return items.join(cells, page) if page in cells.columns else items.crossJoin(F.broadcast(cells))


def cells_of(items: DataFrame, cells: DataFrame, page: str, key: str) -> DataFrame:
    """(page, key, cell): the first cell that holds an item's centre; repeated items count once."""
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    both = _with_cells(items, cells, page).filter((x >= F.col("c_x0")) & (x < F.col("c_x1")) & (y >= F.col("c_y0")) & (y < F.col("c_y1")))
    return dealt(both.select(page, key, "c_cell"), page, key).groupBy(page, key).agg(F.min("c_cell").alias("cell"))


def association(items: DataFrame, cells: DataFrame, page: str, key: str) -> DataFrame:
    """How an item's box relates to the cells it touches (a tenth at least): cell, row or ambiguous, else none; repeated items count once."""
    items = dealt(items, page, key).distinct()
    both = _with_cells(items, cells, page).withColumn("part", F.try_divide(intersection(box(), box("c_")), area(box()))).filter("part >= 0.1")
    g = both.groupBy(page, key).agg(F.count("*").alias("n"), F.max("part").alias("best"), F.sum("part").alias("total"), F.min("c_row").alias("first"), F.max("c_row").alias("last"))
    kind = F.when((F.col("n") == 1) & (F.col("best") >= 0.8), "cell").when((F.col("n") > 1) & (F.col("first") == F.col("last")) & (F.col("total") >= 0.8), "row").otherwise("ambiguous")
    return items.select(page, key).join(g.select(page, key, kind.alias("link")), [page, key], "left").fillna("none", ["link"])


def captions(lines: DataFrame, tables: DataFrame, page: str, reach: float = 0.12, slack: float = 0.01, n: int = 3) -> DataFrame:
    """(page, table_id, line): the n nearest lines that end above a table within reach."""
    both = lines.join(_prefixed(tables, "t_", page), page).filter((F.col("y1") <= F.col("t_y0") + slack) & (F.col("y1") >= F.col("t_y0") - reach))
    w = Window.partitionBy(page, "t_table_id").orderBy(F.desc("y0"), "line")
    return both.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n).select(page, F.col("t_table_id").alias("table_id"), "line")


def overlapping_cells(cells: DataFrame, table: str) -> DataFrame:
    """(table, valid): whether no two cells of a table cover one grid position; spots are counted, not paired."""
    rows = F.explode(F.sequence(F.col("row"), F.col("row") + F.col("row_span") - 1)).alias("r")
    spots = cells.select(table, rows, "col", "col_span").select(table, "r", F.explode(F.sequence(F.col("col"), F.col("col") + F.col("col_span") - 1)).alias("c"))
    return spots.groupBy(table, "r", "c").agg(F.count("*").alias("n")).groupBy(table).agg((F.max("n") == 1).alias("valid"))


def rightmost_numeric(cells: DataFrame, table: str) -> DataFrame:
    """The rightmost cell of each row whose text is a number."""
    w = Window.partitionBy(table, "row").orderBy(F.desc("col"))
    numeric = cells.filter(F.col("text").rlike(r"^\s*-?\d+([.,]\d+)?\s*$"))
    return numeric.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def under_header(cells: DataFrame, table: str, header: str) -> DataFrame:
    """The cells below a header cell that contains the text, within its span of columns."""
    head = cells.filter((F.col("row") == 0) & F.lower("text").contains(header.lower())).select(table, F.col("col").alias("h0"), (F.col("col") + F.col("col_span") - 1).alias("h1"))
    return cells.filter("row > 0").join(head, table).filter(F.col("col").between(F.col("h0"), F.col("h1"))).drop("h0", "h1")


def reading_order(items: DataFrame, page: str, rotation: str) -> DataFrame:
    """Adds position: from top to bottom and left to right as seen after the page's rotation."""
    x, y = F.col("x0"), F.col("y0")
    first = F.when(F.col(rotation) == 90, x).when(F.col(rotation) == 180, -y).when(F.col(rotation) == 270, -x).otherwise(y)
    then = F.when(F.col(rotation) == 90, -y).when(F.col(rotation) == 180, -x).when(F.col(rotation) == 270, y).otherwise(x)
    return items.withColumn("position", F.row_number().over(Window.partitionBy(page).orderBy(first, then, "id")))
