"""Queries over sheet sets, extractions, row labels, stamps and predicates of readings."""

from __future__ import annotations

from pyspark.sql import functions as F

from docengine import adapters as a
from docengine.operators import sheets as h
from docengine.plans.geometry import _I, items
from docengine.session import cut, table

Q: dict = {}
SQL: dict = {}


def add(name: str, sql: str):
    def keep(f):
        Q[name] = f
        SQL[name] = a.with_views(sql)
        return f

    return keep


@add("J17_sheet_sets", """WITH RECURSIVE n AS (SELECT revision_id AS id, predecessor_id AS p, [{'label': revision_id % 4, 'owner': revision_id}] AS own, CASE WHEN revision_id % 3 = 0 AND predecessor_id IS NOT NULL THEN revision_id % 4 END AS gone FROM revisions),
  r AS (SELECT id, own AS sheets FROM n WHERE p IS NULL UNION ALL
    SELECT n.id, list_concat(list_filter(r.sheets, lambda x: n.gone IS NULL OR x.label <> n.gone), n.own) FROM n JOIN r ON n.p = r.id
    WHERE n.gone IS NULL OR list_contains(list_transform(r.sheets, lambda x: x.label), n.gone))
  SELECT revision_id, s.label AS label, s.owner AS owner FROM (SELECT id AS revision_id, unnest(sheets) AS s FROM r)""")  # fmt: skip
def j17(s, d):
    r = cut(a.revisions(s, d).select("revision_id", "predecessor_id"))
    label = F.col("revision_id") % 4
    gone = r.filter("revision_id % 3 = 0 and predecessor_id is not null").select("revision_id", label.alias("label"))
    return h.sheet_sets(r.select("revision_id", label.alias("label")), gone, r.select(F.col("revision_id").alias("id"), "predecessor_id"))


@add("J18_confirmed_extractions", """WITH c AS (SELECT o_orderkey AS context_id, o_custkey AS artifact_id, CASE WHEN o_orderstatus <> 'F' THEN o_orderpriority END AS selection_key FROM orders),
  e AS (SELECT c_custkey AS artifact_id, CASE WHEN c_custkey % 3 > 0 THEN CASE c_custkey % 3 WHEN 1 THEN '1-URGENT' ELSE '2-HIGH' END END AS selection_key, c_custkey * 10 AS extraction_id FROM customer)
  SELECT context_id, c.artifact_id, c.selection_key, extraction_id, CASE WHEN extraction_id IS NULL THEN 'extraction_missing' END AS blocker FROM c LEFT JOIN e ON c.artifact_id = e.artifact_id AND c.selection_key IS NOT DISTINCT FROM e.selection_key""")  # fmt: skip
def j18(s, d):
    contexts = table(s, d, "orders").select(F.col("o_orderkey").alias("context_id"), F.col("o_custkey").alias("artifact_id"), F.when(F.col("o_orderstatus") != "F", F.col("o_orderpriority")).alias("selection_key"))
    k = F.col("c_custkey")
    made = table(s, d, "customer").select(k.alias("artifact_id"), F.when(k % 3 == 1, "1-URGENT").when(k % 3 == 2, "2-HIGH").alias("selection_key"), (k * 10).alias("extraction_id"))
    return h.confirmed_extractions(contexts, made)


@add("J19_row_labels", """SELECT table_id, g.l_linenumber AS "row", label_id FROM (SELECT o_orderkey AS table_id, o_custkey AS label_id, unnest([CAST(o_custkey % 7 + 1 AS INTEGER), CAST(o_custkey % 7 + 3 AS INTEGER)]) AS r FROM orders) l JOIN lineitem g ON g.l_orderkey = table_id AND g.l_linenumber = r""")
def j19(s, d):
    first = (F.col("o_custkey") % 7 + 1).cast("int")
    labels = table(s, d, "orders").select(F.col("o_orderkey").alias("table_id"), F.col("o_custkey").alias("label_id"), F.array(first, first + 2).alias("rows"))
    return h.row_labels(labels, table(s, d, "lineitem").select(F.col("l_orderkey").alias("table_id"), F.col("l_linenumber").alias("row")))


_STAMPS = _I + """, b AS (SELECT page % 50 AS sheet, page * 100000000 + id AS id, CASE WHEN id % 2 = 0 THEN page % 3 END AS table_id, round(x0, 2) / 3.1 AS x0, round(y0, 2) / 3.1 AS y0, round(x1, 2) / 3.1 AS x1, round(y1, 2) / 3.1 AS y1 FROM i),
  o AS (SELECT *, row_number() OVER (PARTITION BY sheet ORDER BY id, x0, y0) AS position FROM b)"""


@add("J21_stamp_neighbours", f"""WITH {_STAMPS} SELECT l.sheet, l.id AS label_id, v.id AS value_id FROM o l JOIN o v ON v.sheet = l.sheet AND abs(v.position - l.position) <= 32 AND v.id <> l.id
  WHERE l.id % 10 = 1 AND (l.table_id IS NULL OR v.table_id = l.table_id)
  AND ((abs((v.x0 + v.x1 - l.x0 - l.x1) / 2) < 0.05 AND abs((v.y0 + v.y1 - l.y0 - l.y1) / 2) < 0.08 AND v.y0 >= l.y0) OR (abs((v.y0 + v.y1 - l.y0 - l.y1) / 2) < 0.025 AND abs((v.x0 + v.x1 - l.x0 - l.x1) / 2) < 0.12 AND v.x0 >= l.x0))""")  # fmt: skip
def j21(s, d):
    from pyspark.sql import Window

    corner = [(F.round(c, 2) / 3.1).alias(c) for c in ("x0", "y0", "x1", "y1")]
    b = items(s, d).select((F.col("page") % 50).alias("sheet"), (F.col("page") * 100000000 + F.col("id")).alias("id"), F.when(F.col("id") % 2 == 0, F.col("page") % 3).alias("table_id"), *corner)
    placed = b.withColumn("position", F.row_number().over(Window.partitionBy("sheet").orderBy("id", "x0", "y0")))
    return h.stamp_neighbours(placed.filter("id % 10 = 1"), placed, "sheet")


@add("P6_settled_facts", "SELECT sha256, stage, kind_code FROM facts WHERE NOT needs_review AND NOT kind_ambiguous AND kind_code IS NOT NULL")
def p6(s, d):
    return a.facts(s, d).filter(h.settled(F.col("needs_review"), F.col("kind_ambiguous"), F.col("kind_code"))).select("sha256", "stage", "kind_code")


@add("P9_readable", """SELECT l_orderkey, l_linenumber FROM lineitem WHERE coalesce(CASE WHEN l_linenumber > 2 THEN l_linenumber <> 3 END, true)
  AND coalesce(CASE l_returnflag WHEN 'A' THEN 'ambiguous' WHEN 'N' THEN 'selected' END, '') <> 'ambiguous' AND (l_linestatus <> 'O' OR coalesce(CASE WHEN l_quantity > 10 THEN l_quantity < 40 END, false))""")  # fmt: skip
def p9(s, d):
    include = F.when(F.col("l_linenumber") > 2, F.col("l_linenumber") != 3)
    status = F.when(F.col("l_returnflag") == "A", "ambiguous").when(F.col("l_returnflag") == "N", "selected")
    source = F.when(F.col("l_linestatus") == "O", "native").otherwise("ocr")
    fine = h.readable(include, status, source, F.when(F.col("l_quantity") > 10, F.col("l_quantity") < 40))
    return table(s, d, "lineitem").filter(fine).select("l_orderkey", "l_linenumber")
