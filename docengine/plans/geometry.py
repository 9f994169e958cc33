"""Queries over boxes and cells; pages are orders or suppliers of the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docengine.operators import layout as y
from docengine.operators import readings
from docengine.session import table

Q: dict = {}
SQL: dict = {}

_LINES = "l_orderkey AS page, l_partkey * 100 + l_linenumber AS id, l_discount * 5 AS x0, l_tax * 10 AS y0, l_discount * 5 + 0.3 AS x1, l_tax * 10 + 0.2 AS y1, l_linenumber AS line"
_I = "i AS (SELECT DISTINCT " + _LINES + " FROM lineitem)"
_R = "r AS (SELECT DISTINCT l_orderkey AS page, l_linenumber AS region, l_returnflag = 'A' AS abstains, l_linenumber * 0.1 AS x0, 0.0 AS y0, l_linenumber * 0.1 + 0.3 AS x1, 1.0 AS y1 FROM lineitem WHERE l_quantity > 20)"
_C = "c AS (SELECT p.page, cell, cell // 4 AS \"row\", (cell % 4) * 0.25 AS x0, (cell // 4) * 0.25 AS y0, (cell % 4) * 0.25 + 0.25 AS x1, (cell // 4) * 0.25 + 0.25 AS y1 FROM (SELECT DISTINCT l_orderkey AS page FROM lineitem) p, (SELECT unnest(range(16)) AS cell))"
_X = "(greatest(least({0}.x1, {1}.x1) - greatest({0}.x0, {1}.x0), 0) * greatest(least({0}.y1, {1}.y1) - greatest({0}.y0, {1}.y0), 0))"
_AREA = "(({0}.x1 - {0}.x0) * ({0}.y1 - {0}.y0))"


def lines(s, d):
    """Lines as items of a page for each order, repeated ones too."""
    li = table(s, d, "lineitem")
    x, v = F.col("l_discount") * 5, F.col("l_tax") * 10
    return li.select(F.col("l_orderkey").alias("page"), (F.col("l_partkey") * 100 + F.col("l_linenumber")).alias("id"), x.alias("x0"), v.alias("y0"), (x + 0.3).alias("x1"), (v + 0.2).alias("y1"), F.col("l_linenumber").alias("line"))


def items(s, d):
    return lines(s, d).distinct()


def regions(s, d):
    li = table(s, d, "lineitem").filter("l_quantity > 20")
    x = F.col("l_linenumber") * 0.1
    return li.select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("region"), (F.col("l_returnflag") == "A").alias("abstains"), x.alias("x0"), F.lit(0.0).alias("y0"), (x + 0.3).alias("x1"), F.lit(1.0).alias("y1")).distinct()


def cells(s, d):
    """The form of 16 cells that all pages share."""
    c, r = F.col("cell") % 4 * 0.25, F.expr("cell div 4") * 0.25
    return s.range(16).select(F.col("id").alias("cell"), F.expr("id div 4").alias("row")).select("cell", "row", c.alias("x0"), r.alias("y0"), (c + 0.25).alias("x1"), (r + 0.25).alias("y1"))


def add(name: str, run, sql: str) -> None:
    Q[name] = run
    SQL[name] = sql


add("J24_same_ink", lambda s, d: y.same_ink(items(s, d), "page", "id", 0.51), f"WITH {_I} SELECT i.page, i.id, o.id AS o_id FROM i JOIN i o ON o.page = i.page AND i.id < o.id WHERE {_X.format('i', 'o')} / least({_AREA.format('i')}, {_AREA.format('o')}) >= 0.51")
add("D36_layout_conflicts", lambda s, d: y.conflicting(items(s, d), "page", "id", 0.51).select("page", "id", "line"), f"WITH {_I} SELECT page, id, line FROM i WHERE EXISTS (SELECT 1 FROM i a JOIN i o ON o.page = a.page AND o.id <> a.id WHERE a.page = i.page AND a.id = i.id AND {_X.format('a', 'o')} / least({_AREA.format('a')}, {_AREA.format('o')}) >= 0.51)")
add("J26_owners", lambda s, d: y.owners(items(s, d), regions(s, d), "page", "id", 0.66).select("page", "id", "line", "region"), f"""WITH {_I}, {_R}, b AS (SELECT i.page, i.id, region, row_number() OVER (PARTITION BY i.page, i.id ORDER BY abstains DESC, round({_X.format('i', 'r')} / {_AREA.format('i')}, 9) DESC, region) AS k FROM i JOIN r ON r.page = i.page WHERE {_X.format('i', 'r')} / {_AREA.format('i')} >= 0.66)
  SELECT i.page, i.id, line, region FROM i LEFT JOIN b ON b.page = i.page AND b.id = i.id AND k = 1""")  # fmt: skip
add("J27_cells", lambda s, d: y.cells_of(lines(s, d), cells(s, d), "page", "id"), f"WITH {_I}, {_C} SELECT i.page, id, min(cell) AS cell FROM i JOIN c ON c.page = i.page AND (i.x0 + i.x1) / 2 >= c.x0 AND (i.x0 + i.x1) / 2 < c.x1 AND (i.y0 + i.y1) / 2 >= c.y0 AND (i.y0 + i.y1) / 2 < c.y1 GROUP BY ALL")
add("J25_association", lambda s, d: y.association(lines(s, d), cells(s, d), "page", "id"), f"""WITH {_I}, {_C}, b AS (SELECT i.page, i.id, {_X.format('i', 'c')} / {_AREA.format('i')} AS part, c."row" AS rw FROM i JOIN c ON c.page = i.page), g AS (SELECT page, id, count(*) AS n, max(part) AS best, sum(part) AS total, count(DISTINCT rw) AS nr FROM b WHERE part >= 0.1 GROUP BY ALL)
  SELECT i.page, i.id, coalesce(CASE WHEN n = 1 AND best >= 0.8 THEN 'cell' WHEN n > 1 AND nr = 1 AND total >= 0.8 THEN 'row' WHEN n IS NOT NULL THEN 'ambiguous' END, 'none') AS link FROM i LEFT JOIN g USING (page, id)""")  # fmt: skip


def j20(s, d):
    tables = items(s, d).filter("line = 1").select("page", F.col("id").alias("table_id"), "y0")
    return y.captions(items(s, d).filter("line > 1").select("page", F.col("id").alias("line"), (F.col("y0") - 0.2).alias("y0"), F.col("y0").alias("y1")), tables, "page", 0.25, 0.01)


add("J20_captions", j20, f"""WITH {_I}, p AS (SELECT l.page, t.id AS table_id, l.id AS line, row_number() OVER (PARTITION BY l.page, t.id ORDER BY l.y0 - 0.2 DESC, l.id) AS k FROM i l JOIN i t ON t.page = l.page AND t.line = 1 WHERE l.line > 1 AND l.y0 <= t.y0 + 0.01 AND l.y0 >= t.y0 - 0.25)
  SELECT page, table_id, line FROM p WHERE k <= 3""")  # fmt: skip


def grid(s, d):
    """Cells of a table per order: a row per line, three columns; texts are attributes."""
    li = table(s, d, "lineitem")
    text = lambda c: F.col(c).cast("string")
    wide = li.select(F.col("l_orderkey").alias("table_id"), F.col("l_linenumber").alias("row"), "l_partkey", "l_suppkey", F.explode(F.array(F.struct(F.lit(0).alias("col"), F.col("l_returnflag").alias("text")), F.struct(F.lit(1).alias("col"), text("l_partkey").alias("text")), F.struct(F.lit(2).alias("col"), F.when(F.col("l_suppkey") % 2 == 0, text("l_suppkey")).otherwise("n/a").alias("text")))).alias("c"))
    return wide.select("table_id", "row", F.col("c.col").alias("col"), F.lit(1).alias("row_span"), F.when((F.col("row") == 1) & (F.col("l_partkey") % 3 == 0), 2).otherwise(1).alias("col_span"), F.col("c.text").alias("text"))


_G = """g AS (SELECT l_orderkey AS table_id, l_linenumber AS "row", CAST(col AS INTEGER) AS col, CASE WHEN l_linenumber = 1 AND l_partkey % 3 = 0 THEN 2 ELSE 1 END AS col_span,
  CASE col WHEN 0 THEN l_returnflag WHEN 1 THEN CAST(l_partkey AS VARCHAR) ELSE CASE WHEN l_suppkey % 2 = 0 THEN CAST(l_suppkey AS VARCHAR) ELSE 'n/a' END END AS text FROM lineitem, (SELECT unnest(range(3)) AS col))"""
add("W18_grid_validity", lambda s, d: y.overlapping_cells(grid(s, d), "table_id"), f"WITH {_G}, x AS (SELECT table_id, \"row\", unnest(range(col, col + col_span)) AS c FROM g), n AS (SELECT table_id, count(*) AS n FROM x GROUP BY table_id, \"row\", c) SELECT table_id, max(n) = 1 AS valid FROM n GROUP BY 1")


def t4(s, d):
    cells_ = grid(s, d).groupBy("table_id", "row", "col").agg(F.min("text").alias("text"))
    return y.rightmost_numeric(cells_, "table_id").select("table_id", "row", "col", "text")


add("T4_rightmost_number", t4, f"""WITH {_G}, c AS (SELECT table_id, "row", col, min(text) AS text FROM g GROUP BY ALL) SELECT table_id, "row", col, text FROM (SELECT *, row_number() OVER (PARTITION BY table_id, "row" ORDER BY col DESC) AS k FROM c WHERE regexp_matches(text, '^\\s*-?[0-9]+([.,][0-9]+)?\\s*$')) WHERE k = 1""")


def t7(s, d):
    return y.reading_order(items(s, d).withColumn("rotation", F.col("page") % 4 * 90), "page", "rotation").select("page", "id", "position")


add("T7_reading_order", t7, f"""WITH {_I} SELECT page, id, CAST(row_number() OVER (PARTITION BY page ORDER BY CASE page % 4 WHEN 1 THEN x0 WHEN 2 THEN -y0 WHEN 3 THEN -x0 ELSE y0 END, CASE page % 4 WHEN 1 THEN -y0 WHEN 2 THEN -x0 WHEN 3 THEN y0 ELSE x0 END, id) AS INTEGER) AS position FROM i""")


def t3(s, d):
    g = grid(s, d)
    hits = lambda c: F.max(F.when(F.col("text") == c, 1).otherwise(0))
    score = g.groupBy("table_id").agg((hits("A") + hits("R") + 2 * hits("N")).alias("score"))
    return score.filter("score >= 2").orderBy(F.desc("score"), "table_id")


add("T3_table_scores", t3, f"WITH {_G} SELECT table_id, CAST(max(CASE WHEN text = 'A' THEN 1 ELSE 0 END) + max(CASE WHEN text = 'R' THEN 1 ELSE 0 END) + 2 * max(CASE WHEN text = 'N' THEN 1 ELSE 0 END) AS INTEGER) AS score FROM g GROUP BY 1 HAVING score >= 2 ORDER BY score DESC, table_id")


def a31(s, d):
    b = table(s, d, "documents").filter("text is not null")
    n = b.groupBy("source").agg(F.count("*").alias("pages"), F.count_if(F.col("n_chars") >= 200).alias("readable"))
    return n.withColumn("quality", F.when(F.col("readable") == F.col("pages"), "OK").when(F.col("readable") * 2 >= F.col("pages"), "LOW").otherwise("ABSTAIN"))


add("A31_page_quality", a31, "SELECT source, count(*) AS pages, count(*) FILTER (n_chars >= 200) AS readable, CASE WHEN readable = pages THEN 'OK' WHEN readable * 2 >= pages THEN 'LOW' ELSE 'ABSTAIN' END AS quality FROM documents WHERE text IS NOT NULL GROUP BY 1")


def p1(s, d):
    b = items(s, d).join(regions(s, d).groupBy("page").agg(F.min("region").alias("skipped")), "page", "left")
    keep = (F.col("id") % 7 != 0) & ((F.col("id") % 5 != 0) | (F.col("line") == F.col("skipped")))
    return b.filter(F.coalesce(keep, F.lit(False))).select("page", "id")


add("P1_eligible_blocks", p1, f"WITH {_I}, {_R} SELECT i.page, id FROM i LEFT JOIN (SELECT page, min(region) AS skipped FROM r GROUP BY 1) k ON k.page = i.page WHERE id % 7 <> 0 AND (id % 5 <> 0 OR line = skipped)")


def a18_all(s, d):
    o = table(s, d, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.sort_array(F.collect_set("o_orderpriority")).alias("reasons"), F.sort_array(F.collect_set("o_orderkey")).alias("evidence"))
    return o.select("o_custkey", "o_orderstatus", F.array_join("reasons", ",").alias("reasons"), F.array_join(F.slice("evidence", 1, 6), ",").alias("evidence"))


add("A18_candidate_merge", a18_all, "SELECT o_custkey, o_orderstatus, array_to_string(list_sort(list(DISTINCT o_orderpriority)), ',') AS reasons, array_to_string(list_sort(list(DISTINCT o_orderkey))[1:6], ',') AS evidence FROM orders GROUP BY ALL")


def d41(s, d):
    from docengine.operators.latest import top_per_key

    newest = top_per_key(table(s, d, "orders"), ["o_custkey", "o_orderpriority"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    return newest.groupBy("o_custkey").agg(F.count("*").alias("parts"), F.array_join(F.sort_array(F.collect_set("o_orderstatus")), ",").alias("states"))


add("D41_latest_parts", d41, "SELECT o_custkey, count(*) AS parts, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS states FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1 GROUP BY 1")


def d25(s, d):
    return table(s, d, "orders").groupBy("o_custkey").agg(F.bool_and(F.col("o_orderstatus") == "F").alias("confirmed"), F.count("*").alias("aliases"))


add("D25_review", d25, "SELECT o_custkey, bool_and(o_orderstatus = 'F') AS confirmed, count(*) AS aliases FROM orders GROUP BY 1")


def d45(s, d):
    entries = table(s, d, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("code")).distinct()
    omitted = table(s, d, "part").select(F.col("p_partkey").alias("code")).join(entries, "code", "left_anti")
    return entries.agg(F.count("*").alias("covered")).crossJoin(omitted.agg(F.count("*").alias("omitted")))  # one row each


add("D45_release", d45, "SELECT (SELECT count(DISTINCT l_partkey) FROM lineitem WHERE l_quantity > 45) AS covered, (SELECT count(*) FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)) AS omitted")


def page_readings(s, d):
    """Lines as readings of a page for each order: native ones and recognised ones, some unusable or hidden, boxes in three rows."""
    li = table(s, d, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy(*sorted(li.columns))
    low, row = F.col("l_discount") * 4, F.pmod("l_suppkey", F.lit(3))
    li = li.withColumn("id", F.row_number().over(order).cast("long"))
    return li.select(
        F.col("l_orderkey").alias("page"), F.when(F.pmod("l_partkey", F.lit(2)) == 0, "native").otherwise("ocr").alias("source"), "id",
        low.alias("x0"), (row * 0.25).alias("y0"), (low + F.col("l_quantity") / 50 + 0.1).alias("x1"), (row * 0.25 + 0.2 + F.col("l_tax")).alias("y1"),
        F.concat(F.col("l_returnflag"), F.lit(" "), F.col("l_linestatus")).alias("text"), (F.col("l_tax") < 0.075).alias("valid"), (F.col("l_tax") < 0.005).alias("hidden"),
    )


def d35(s, d):
    return readings.reconciled(page_readings(s, d)).withColumn("reasons", F.array_join("reasons", ","))


Q["D35_readings"] = d35  # the order of choices is no set operation: see tests/test_readings.py
