"""Queries over grids, revision tables, turned boxes, native text and decimal literals."""

from __future__ import annotations

from pyspark.sql import functions as F

from docengine import adapters as a
from docengine.operators import tables as t
from docengine.session import dealt, table

Q: dict = {}
SQL: dict = {}


def add(name: str, sql: str):
    def keep(f):
        Q[name] = f
        SQL[name] = a.with_views(sql)
        return f

    return keep


_CELLS = """c AS (SELECT DISTINCT l_orderkey AS page, l_linenumber AS cell, (l_linenumber - 1) // 3 AS "row", (l_linenumber - 1) % 3 AS col, 1 AS row_span, CASE WHEN l_quantity > 48 THEN 2 ELSE 1 END AS col_span,
  CASE WHEN l_quantity > 1 THEN (l_linenumber - 1) % 3 * 0.25 + l_discount END AS x0, (l_linenumber - 1) // 3 * 0.25 AS y0, (l_linenumber - 1) % 3 * 0.25 + l_discount + 0.2 AS x1, (l_linenumber - 1) // 3 * 0.25 + 0.2 AS y1 FROM lineitem),
  p AS (SELECT l.page, least(l.x1, r.x1) - greatest(l.x0, r.x0) AS w, least(l.y1, r.y1) - greatest(l.y0, r.y0) AS h, least((l.x1 - l.x0) * (l.y1 - l.y0), (r.x1 - r.x0) * (r.y1 - r.y0)) AS small,
    l."row" < r."row" + r.row_span AND r."row" < l."row" + l.row_span AS in_row, l.col < r.col + r.col_span AND r.col < l.col + l.col_span AS in_col, r.col - l.col AS rt, r."row" - l."row" AS dn,
    (r.x0 + r.x1 - l.x0 - l.x1) / 2 AS dx, (r.y0 + r.y1 - l.y0 - l.y1) / 2 AS dy FROM c l JOIN c r ON r.page = l.page AND l.cell < r.cell),
  j AS (SELECT page, NOT bool_or((greatest(w, 0) * greatest(h, 0) > small * 0.2) OR (in_row AND in_col)) AND (bool_and((NOT in_row OR rt * dx > 0) AND (NOT in_col OR dn * dy > 0)) OR bool_and((NOT in_row OR rt * dy > 0) AND (NOT in_col OR dn * -dx > 0))
    OR bool_and((NOT in_row OR rt * -dx > 0) AND (NOT in_col OR dn * -dy > 0)) OR bool_and((NOT in_row OR rt * -dy > 0) AND (NOT in_col OR dn * dx > 0))) AS fits FROM p GROUP BY page)"""


@add("D37_valid_grids", f"WITH {_CELLS} SELECT page, b.boxes AND coalesce(fits, true) AS valid FROM (SELECT page, bool_and(coalesce(x1 > x0 AND y1 > y0, false)) AS boxes FROM c GROUP BY page) b LEFT JOIN j USING (page)")
def d37(s, d):
    k = F.col("l_linenumber") - 1
    x, v = k % 3 * 0.25 + F.col("l_discount"), F.floor(k / 3) * 0.25
    cells = table(s, d, "lineitem").select(
        F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("cell"), F.floor(k / 3).alias("row"), (k % 3).alias("col"), F.lit(1).alias("row_span"), F.when(F.col("l_quantity") > 48, 2).otherwise(1).alias("col_span"),
        F.when(F.col("l_quantity") > 1, x).alias("x0"), v.alias("y0"), (x + 0.2).alias("x1"), (v + 0.2).alias("y1"),
    )
    return t.valid_grids(cells.distinct(), "page", "cell")


_WORDS = {1: "Разрешение", 2: "Изм.", 3: "Лист", 4: "Содержание изменения", 5: "Замена листа"}
_BOXES = {1: (0.05, 0.05, 0.25, 0.08), 2: (0.05, 0.15, 0.1, 0.17), 3: (0.12, 0.15, 0.18, 0.17), 4: (0.2, 0.15, 0.6, 0.17), 5: (0.65, 0.2, 0.8, 0.22), 6: (0.13, 0.2, 0.17, 0.22), 7: (0.06, 0.2, 0.09, 0.22), 8: (0.06, 0.1, 0.2, 0.12)}
_KIND = "CASE WHEN l_linenumber = 7 AND l_quantity >= 25 THEN 8 ELSE l_linenumber END"
_SHIFT = "CASE WHEN l_linenumber = 6 THEN l_discount * 0.3 ELSE 0 END"
_PRINTED = "CASE kind " + " ".join(f"WHEN {k} THEN '{w}'" for k, w in _WORDS.items()) + " WHEN 8 THEN concat(q, '-24') WHEN 6 THEN concat(q, CASE WHEN f = 'A' THEN 'а' ELSE '' END) ELSE q END"


def _corner(k: int) -> str:
    return "CASE kind " + " ".join(f"WHEN {n} THEN CAST({b[k]} AS DOUBLE)" for n, b in _BOXES.items()) + " END" + (" + shift" if k % 2 else "")


#: The blocks of a page, in words that Spark and DuckDB share.
_STAMP = f"""SELECT page, id, {_PRINTED} AS text, {_corner(0)} AS x0, {_corner(1)} AS y0, {_corner(2)} AS x1, {_corner(3)} AS y1, usable FROM (
  SELECT DISTINCT l_orderkey AS page, l_partkey * 100 + l_linenumber AS id, {_KIND} AS kind, {_SHIFT} AS shift, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR(9)) AS q, l_returnflag AS f, l_quantity > 3 AS usable FROM lineitem) AS z"""
_ROW = "abs(({0}.y0 + {0}.y1) / 2 - ({1}.y0 + {1}.y1) / 2) <= least(0.02, greatest({0}.y1 - {0}.y0, {1}.y1 - {1}.y0))"
_COL = "{0}.x0 >= {1}.x0 - 0.015 AND {0}.x1 <= {1}.x1 + 0.015"


@add("D21_revision_tables", f"""WITH b0 AS ({_STAMP}), b AS (SELECT *, lower(text) AS w FROM b0 WHERE usable),
  pe AS (SELECT * FROM b WHERE w = 'разрешение' QUALIFY count(*) OVER (PARTITION BY page) = 1), ch AS (SELECT * FROM b WHERE w = 'изм.' QUALIFY count(*) OVER (PARTITION BY page) = 1),
  sh AS (SELECT b.* FROM b JOIN ch USING (page) WHERE b.w = 'лист' AND {_ROW.format('ch', 'b')} AND b.x0 + b.x1 > ch.x0 + ch.x1 QUALIFY count(*) OVER (PARTITION BY page) = 1),
  co AS (SELECT b.* FROM b JOIN ch USING (page) WHERE b.w = 'содержание изменения' AND {_ROW.format('ch', 'b')} QUALIFY count(*) OVER (PARTITION BY page) = 1),
  g AS (SELECT page FROM pe JOIN ch USING (page) JOIN sh USING (page) JOIN co USING (page) WHERE pe.y1 < ch.y0 AND sh.x0 + sh.x1 < co.x0 + co.x1),
  body AS (SELECT b.* FROM b JOIN g USING (page) JOIN ch USING (page) WHERE b.y0 > ch.y1 AND b.y1 <= ch.y1 + 0.25),
  ma AS (SELECT body.* FROM body JOIN co USING (page) WHERE body.w = 'замена листа' AND body.x0 > co.x1),
  va AS (SELECT body.* FROM body JOIN sh USING (page) WHERE regexp_full_match(body.w, '[0-9]{{1,4}}[а-яa-z]?') AND {_COL.format('body', 'sh')}),
  re AS (SELECT va.* FROM ma JOIN va USING (page) WHERE {_ROW.format('va', 'ma')} QUALIFY count(*) OVER (PARTITION BY page, ma.id) = 1),
  nu AS (SELECT b.* FROM b JOIN g USING (page) JOIN pe USING (page) JOIN ch USING (page) WHERE regexp_full_match(b.w, '[0-9]{{1,8}}-[0-9]{{2,4}}') AND {_COL.format('b', 'pe')} AND b.y0 > pe.y1 AND b.y1 < ch.y0 AND b.y1 - pe.y1 <= 0.08 QUALIFY count(*) OVER (PARTITION BY page) = 1)
  SELECT page, 'observed_replaced_sheet' AS field, id FROM re
  UNION ALL SELECT DISTINCT body.page, 'revision_label', body.id FROM body JOIN ch USING (page) JOIN re USING (page) WHERE regexp_full_match(body.w, '[0-9]{{1,4}}') AND {_COL.format('body', 'ch')} AND {_ROW.format('body', 're')}
  UNION ALL SELECT page, 'number', id FROM nu WHERE page IN (SELECT page FROM re)""")  # fmt: skip
def d21(s, d):
    return t.revision_tables(s.sql(_STAMP.replace("FROM lineitem", "FROM {lines}"), lines=dealt(table(s, d, "lineitem"), "l_orderkey")))


_TURN = {"x0": "CASE k WHEN 0 THEN a WHEN 1 THEN 600.0 - f WHEN 2 THEN 600.0 - e ELSE b END / 600.0", "y0": "CASE k WHEN 0 THEN b WHEN 1 THEN a WHEN 2 THEN 800.0 - f ELSE 800.0 - e END / 800.0",
         "x1": "CASE k WHEN 0 THEN e WHEN 1 THEN 600.0 - b WHEN 2 THEN 600.0 - a ELSE f END / 600.0", "y1": "CASE k WHEN 0 THEN f WHEN 1 THEN e WHEN 2 THEN 800.0 - b ELSE 800.0 - a END / 800.0"}


@add("F22_unturned", "SELECT l_orderkey, l_linenumber, " + ", ".join(f"greatest(0.0, least(1.0, {c})) AS {n}" for n, c in _TURN.items())
     + " FROM (SELECT l_orderkey, l_linenumber, l_linenumber % 4 AS k, l_quantity * 10.0 AS a, l_quantity * 12.0 AS b, l_quantity * 10.0 + 150.0 AS e, l_quantity * 12.0 + 90.0 AS f FROM lineitem)")
def f22(s, d):
    q = F.col("l_quantity")
    box = t.unturned(q * 10.0, q * 12.0, q * 10.0 + 150.0, q * 12.0 + 90.0, F.col("l_linenumber") % 4, F.lit(600.0), F.lit(800.0))
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", box.alias("box")).select("l_orderkey", "l_linenumber", "box.*")


@add("F31_native_valid", r"""SELECT doc_id, block_order, regexp_matches(raw_text, '[^\s\x{A0}\x{3000}]') AND NOT regexp_matches(raw_text, '[\x{00}-\x{08}\x{0B}\x{0C}\x{0E}-\x{1F}\x{7F}-\x{9F}\x{FFFD}\p{Co}]') AND block_order % 7 > 0 AND block_order % 5 > 0 AS valid FROM blocks""")
def f31(s, d):
    n = F.col("block_order")
    turn = F.when(n % 7 > 0, 1.0).otherwise(0.9)
    return a.blocks(s, d).select("doc_id", "block_order", t.native_valid(F.col("raw_text"), turn, F.lit(0.0), (n % 5).cast("double")).alias("valid"))


@add("F17_decimal_literals", "SELECT l_orderkey, l_linenumber, CAST(CAST(concat(CAST(CAST(l_quantity AS INTEGER) AS VARCHAR), '.25e', CAST(l_linenumber - 4 AS VARCHAR)) AS DECIMAL(38, 8)) AS DOUBLE) AS value FROM lineitem")
def f17(s, d):
    literal = F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(".25e"), (F.col("l_linenumber") - 4).cast("string"))
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", literal.cast("decimal(38,8)").cast("double").alias("value"))


@add("F32_byte_sizes", "SELECT doc_id, block_order, strlen(raw_text) AS utf8_bytes FROM blocks")
def f32(s, d):
    return a.blocks(s, d).select("doc_id", "block_order", F.octet_length("raw_text").cast("long").alias("utf8_bytes"))
