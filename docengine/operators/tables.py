"""Tables on a page: valid grids, revision tables, turned boxes, usable native text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docengine.session import cut

BOX = ["x0", "y0", "x1", "y1"]


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def valid_grids(cells: DataFrame, page: str, cell: str, overlap: float = 0.2) -> DataFrame:
    """(page, valid): whether a table's cells can be one grid.

    cells hold row, col, row_span, col_span and a box. No two boxes share over ``overlap`` of the smaller
    one, no two cells share a place, and one of four orientations of the page fits every two
    cells that share rows or columns. A missing box or one without area makes its table invalid.
    """
    named = [page, cell, "row", "col", "row_span", "col_span", *BOX]
    a, b = (cells.select(F.col(page).alias("page"), *[F.col(c).alias(f"{p}_{c}") for c in named[1:]]) for p in "ab")
    pairs = a.join(b, "page").filter(F.col(f"a_{cell}") < F.col(f"b_{cell}"))

    def meet(x: str, n: str) -> Column:
        return (F.col(f"a_{x}") < F.col(f"b_{x}") + F.col(f"b_{n}")) & (F.col(f"b_{x}") < F.col(f"a_{x}") + F.col(f"a_{n}"))

    def side(x: str) -> Column:
        return F.greatest(F.least(f"a_{x}1", f"b_{x}1") - F.greatest(f"a_{x}0", f"b_{x}0"), F.lit(0))

    def area(p: str) -> Column:
        return (F.col(f"{p}_x1") - F.col(f"{p}_x0")) * (F.col(f"{p}_y1") - F.col(f"{p}_y0"))

    rows, cols = meet("row", "row_span"), meet("col", "col_span")
    dx, dy = ((F.col(f"b_{x}0") + F.col(f"b_{x}1") - F.col(f"a_{x}0") - F.col(f"a_{x}1")) / 2 for x in "xy")
    right, down = F.col("b_col") - F.col("a_col"), F.col("b_row") - F.col("a_row")
    clash = (side("x") * side("y") > F.least(area("a"), area("b")) * overlap) | (rows & cols)
    turned = [F.bool_and((~rows | (right * u > 0)) & (~cols | (down * v > 0))) for u, v in ((dx, dy), (dy, -dx), (-dx, -dy), (-dy, dx))]
    fits = turned[0] | turned[1] | turned[2] | turned[3]
    judged = pairs.groupBy("page").agg((~F.bool_or(clash) & fits).alias("fits"))
    whole = (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0"))
    boxes = cells.groupBy(F.col(page).alias("page")).agg(F.bool_and(F.coalesce(whole, F.lit(False))).alias("boxes"))
    return boxes.join(judged, "page", "left").select(F.col("page").alias(page), (F.col("boxes") & F.coalesce("fits", F.lit(True))).alias("valid"))


def same_row(a: str, b: str) -> Column:
    """The centres are at most 0.02 apart in height, or the height of the taller box if that is less."""
    near = F.least(F.lit(0.02), F.greatest(F.col(f"{a}.y1") - F.col(f"{a}.y0"), F.col(f"{b}.y1") - F.col(f"{b}.y0")))
    return F.abs((F.col(f"{a}.y0") + F.col(f"{a}.y1")) / 2 - (F.col(f"{b}.y0") + F.col(f"{b}.y1")) / 2) <= near


def in_rows(left: DataFrame, a: str, right: DataFrame, b: str) -> DataFrame:
    """The pairs of a page's boxes a and b of the same row; only boxes of neighbouring stretches of height meet."""
    stretch = lambda n: F.floor((F.col(f"{n}.y0") + F.col(f"{n}.y1")) / 2 / 0.025)
    near = left.withColumn("_stretch", F.explode(F.array(*[stretch(a) + k for k in (-1, 0, 1)])))
    return near.join(right.withColumn("_stretch", stretch(b)), ["page", "_stretch"]).filter(same_row(b, a)).drop("_stretch")


def in_column(value: str, header: str) -> Column:
    """The value lies under the header, 0.015 more to either side."""
    return (F.col(f"{value}.x0") >= F.col(f"{header}.x0") - 0.015) & (F.col(f"{value}.x1") <= F.col(f"{header}.x1") + 0.015)


#: The headers of a revision table and the mark of a replaced sheet.
HEADERS = {"permission": "разрешение", "change": "изм.", "sheet": "лист", "content": "содержание изменения"}
REPLACED = "замена листа"


def revision_tables(blocks: DataFrame) -> DataFrame:
    """(page, field, id): printed numbers, revisions and replaced sheets of a page's only revision table.

    blocks: page, id, text, box, usable (valid native text). Pages with several tables have none; pages have any
    number of blocks, tables any number of marks.
    """
    middle = {x: (F.col(f"b.{x}0") + F.col(f"b.{x}1")) / 2 for x in "xy"}
    word = F.lower(F.col("b.text"))
    fine = F.col("usable") & F.length(F.trim("text")).between(1, 600)
    # few pages have each header and a mark, the first two once; only they go on
    plain = F.lower(F.trim("text"))
    counts = {k: F.count_if(fine & (plain == w)) for k, w in (HEADERS | {"mark": REPLACED}).items()}
    pages = blocks.groupBy("page").agg(*[c.alias(f"n_{k}") for k, c in counts.items()])
    pages = pages.filter((F.col("n_permission") == 1) & (F.col("n_change") == 1) & (F.col("n_sheet") > 0) & (F.col("n_content") > 0) & (F.col("n_mark") > 0))
    every = cut(blocks.filter(fine).join(pages.select("page"), "page", "left_semi").select("page", F.struct("id", F.trim("text").alias("text"), *BOX).alias("b")))

    def only(source: DataFrame, found: dict[str, Column]) -> DataFrame:
        """The pages where each condition holds for one block, and these blocks."""
        agg = [x for name, c in found.items() for x in (F.count_if(c).alias(f"n_{name}"), F.max(F.when(c, F.col("b"))).alias(name))]
        return source.groupBy("page").agg(*agg).filter(_all([F.col(f"n_{name}") == 1 for name in found])).select("page", *found)

    top = only(every, {k: word == HEADERS[k] for k in ("permission", "change")}).filter("permission.y1 < change.y0")
    centre = (F.col("change.x0") + F.col("change.x1")) / 2
    in_row = same_row("change", "b")
    rest = only(every.join(top, "page"), {"sheet": (word == HEADERS["sheet"]) & in_row & (middle["x"] > centre), "content": (word == HEADERS["content"]) & in_row})
    table = top.join(rest, "page").filter("sheet.x0 + sheet.x1 < content.x0 + content.x1")
    placed = every.join(table, "page")
    body = placed.filter((F.col("b.y0") > F.col("change.y1")) & (F.col("b.y1") <= F.col("change.y1") + 0.25))
    marks = body.filter((word == REPLACED) & (F.col("b.x0") > F.col("content.x1"))).select("page", F.col("b").alias("mark"))
    values = body.filter(word.rlike("^[0-9]{1,4}[а-яa-z]?$") & in_column("b", "sheet")).select("page", F.col("b").alias("value"))
    met = in_rows(marks, "mark", values, "value").groupBy("page", "mark.id").agg(F.count("*").alias("n"), F.max("value").alias("value")).filter("n = 1")
    sheets = met.select("page", F.lit("observed_replaced_sheet").alias("field"), "value")
    labels = body.filter(word.rlike("^[0-9]{1,4}$") & in_column("b", "change")).select("page", F.col("b").alias("label"))
    labels = in_rows(labels, "label", sheets.select("page", "value").distinct(), "value").select("page", F.lit("revision_label").alias("field"), F.col("label").alias("value")).distinct()
    near = (F.col("b.y0") > F.col("permission.y1")) & (F.col("b.y1") < F.col("change.y0")) & (F.col("b.y1") - F.col("permission.y1") <= 0.08)
    numbers = only(placed, {"value": word.rlike("^[0-9]{1,8}-[0-9]{2,4}$") & in_column("b", "permission") & near})
    numbers = numbers.join(sheets.select("page"), "page", "left_semi").select("page", F.lit("number").alias("field"), "value")
    return sheets.unionByName(labels).unionByName(numbers).select("page", "field", "value.id")


def unturned(x0: Column, y0: Column, x1: Column, y1: Column, turns: Column, width: Column, height: Column) -> Column:
    """The box on the upright page, in parts of it from 0 to 1; the scan was turned ``turns`` quarters."""
    forms = [(x0, y0, x1, y1), (width - y1, x0, width - y0, x1), (width - x1, height - y1, width - x0, height - y0), (y0, height - x1, y1, height - x0)]
    out = []
    for k, name in enumerate(BOX):
        c = F.when(turns == 0, forms[0][k]).when(turns == 1, forms[1][k]).when(turns == 2, forms[2][k]).when(turns == 3, forms[3][k])
        out.append(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c / (height if k % 2 else width))).alias(name))
    return F.struct(*out)


def native_valid(text: Column, dx: Column, dy: Column, area: Column) -> Column:
    """Text without control, private or unassigned characters, in a box with area, of a direction of length one."""
    odd = text.rlike(r"[\p{Cs}\p{Co}\p{Cn}\x{FFFD}]|[\p{Cc}&&[^\t\n\r]]")
    finite = ~F.isnan(area) & (area > 0) & (area < float("inf"))
    return F.coalesce(text.rlike(r"(?U)\S") & ~odd & finite & (F.abs(F.hypot(dx, dy) - 1) < 0.02), F.lit(False))
