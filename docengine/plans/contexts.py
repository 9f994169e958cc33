"""D24: comparison contexts over the orders as revisions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docengine.operators import contexts as c
from docengine.session import table

Q: dict = {}
SQL: dict = {}


def revisions(s, d):
    """Orders as revisions of their customers' documents, some without a code, scope, period, approval or readable source."""
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    o = table(s, d, "orders").withColumns({"stage": F.when(F.col("o_orderstatus") == "F", "ID").when(F.col("o_orderstatus") == "O", "RD").otherwise("PD"), "code": F.expr("cast(o_custkey div 10 as string)"), "scope": F.when(k % 17 != 0, F.upper(F.col("o_orderpriority")))})
    order = ("o_orderdate", "o_orderkey")
    return o.select(
        k.alias("revision_id"), F.col("o_custkey").alias("document_id"), "stage", "code", F.when(k % 11 != 0, F.col("code")).alias("reference_code"), "scope",
        F.when(k % 13 != 0, day).alias("works_from"), F.date_add(day, 20).alias("works_to"),
        F.when(k % 19 == 0, F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy(*order))).alias("reference_revision_id"),
        (k % 5 != 0).alias("confirmed"), F.date_sub(day, 200).alias("effective_from"), F.when(k % 7 != 0, F.date_add(day, 260)).alias("effective_to"),
        F.lag("o_orderkey").over(Window.partitionBy("o_custkey", "stage", "scope").orderBy(*order)).alias("replaces_id"),
        F.when(k % 29 == 0, F.array(F.lit("source_unreadable"))).otherwise(F.array().cast("array<string>")).alias("structural"),
    )


def d24(s, d):
    return c.contexts(revisions(s, d)).withColumn("blockers", F.array_join("blockers", ","))


Q["D24_contexts"] = d24
SQL["D24_contexts"] = """WITH RECURSIVE r AS (
    SELECT o_orderkey AS id, o_custkey AS doc, stage, CAST(o_custkey // 10 AS VARCHAR) AS code, CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_custkey // 10 AS VARCHAR) ELSE '' END AS wanted, coalesce(lower(scope), '') AS scope,
      CASE WHEN o_orderkey % 13 <> 0 THEN day END AS wf, day + 20 AS wt, CASE WHEN o_orderkey % 19 = 0 THEN lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) END AS ref, o_orderkey % 5 <> 0 AS ok,
      day - 200 AS ef, CASE WHEN o_orderkey % 7 <> 0 THEN day + 260 END AS et, lag(o_orderkey) OVER (PARTITION BY o_custkey, stage, scope ORDER BY o_orderdate, o_orderkey) AS prev, o_orderkey % 29 = 0 AS fault
    FROM (SELECT *, CAST(o_orderdate AS DATE) AS day, CASE o_orderstatus WHEN 'F' THEN 'ID' WHEN 'O' THEN 'RD' ELSE 'PD' END AS stage, CASE WHEN o_orderkey % 17 <> 0 THEN upper(o_orderpriority) END AS scope FROM orders)),
  e AS (SELECT id, CAST(NULL AS VARCHAR) AS problem FROM r WHERE prev IS NULL UNION ALL
    SELECT r.id, coalesce(CASE WHEN NOT r.ok THEN 'replacement_unconfirmed' WHEN r.ef < p.ef THEN 'replacement_period_invalid' END, e.problem) FROM r JOIN e ON r.prev = e.id JOIN r p ON p.id = e.id),
  a AS (SELECT r.*, e.problem FROM r JOIN e USING (id)),
  x AS (SELECT a.*, CASE WHEN a.ref IS NULL THEN CASE WHEN a.wanted = '' THEN 'reference_link_unconfirmed' END WHEN n.stage NOT IN ('PD', 'RD') THEN 'reference_stage_invalid' WHEN a.scope = '' OR n.scope <> a.scope THEN 'reference_scope_mismatch' END AS unfit,
    coalesce(a.wf <= a.wt, false) AS proper FROM a LEFT JOIN a n ON n.id = a.ref WHERE a.stage <> 'PD'),
  pool AS (SELECT x.id AS actual, m.id AS member, m.doc, m.ok, m.ef, m.et, m.fault OR m.problem IS NOT NULL AS unsound FROM x JOIN a m ON x.ref IS NULL AND x.unfit IS NULL AND x.scope <> '' AND m.stage = CASE x.stage WHEN 'ID' THEN 'RD' ELSE 'PD' END AND m.code = x.wanted AND m.scope = x.scope
    UNION ALL SELECT x.id, m.id, m.doc, m.ok, m.ef, m.et, m.fault OR m.problem IS NOT NULL FROM x JOIN a m ON m.id = x.ref WHERE x.unfit IS NULL),
  rel AS (SELECT x.id AS actual, bool_or(m.stage NOT IN ('PD', 'RD') OR NOT m.ok OR m.scope = '') AS unclear, bool_or(m.fault OR m.problem IS NOT NULL) AS unsound,
    bool_or(m.ok AND m.ef <= x.wt AND coalesce(m.et >= x.wf, true) AND NOT (m.ef <= x.wf AND coalesce(m.et >= x.wt, true))) AS partly
    FROM (SELECT DISTINCT actual, doc FROM pool) p JOIN x ON x.id = p.actual JOIN a m ON m.doc = p.doc AND (m.scope = '' OR m.scope = x.scope) GROUP BY 1),
  newer AS (SELECT prev AS member, min(ef) AS f FROM a WHERE prev IS NOT NULL AND ok AND problem IS NULL GROUP BY 1),
  hit AS (SELECT p.actual, count(*) AS n, count(*) FILTER (ok) AS n_ok, count(*) FILTER (fits) AS n_fit, count(*) FILTER (fits AND coalesce(f > wt, true)) AS n_use, min(member) FILTER (fits AND coalesce(f > wt, true)) AS one
    FROM (SELECT p.*, x.wt, p.ok AND NOT p.unsound AND p.ef <= x.wf AND coalesce(p.et >= x.wt, true) AS fits FROM pool p JOIN x ON x.id = p.actual) p LEFT JOIN newer USING (member) GROUP BY 1),
  z AS (SELECT x.id, x.doc, CASE WHEN x.proper AND n_use = 1 THEN one END AS reference_id, list_sort(list_distinct(list_filter([CASE WHEN x.fault THEN 'source_unreadable' END, x.problem, CASE WHEN x.scope = '' THEN 'scope_unresolved' END, CASE WHEN NOT x.ok THEN 'actual_approval_unconfirmed' END,
      CASE WHEN NOT x.proper THEN 'works_period_unresolved' END, x.unfit, CASE WHEN n IS NULL THEN 'reference_missing' END, CASE WHEN x.proper AND rel.unclear THEN 'reference_applicability_unconfirmed' END, CASE WHEN x.proper AND rel.unsound THEN 'reference_evidence_unresolved' END,
      CASE WHEN x.proper AND rel.partly THEN 'reference_period_overlap' END, CASE WHEN x.proper AND n_ok = 0 THEN 'reference_approval_unconfirmed' END, CASE WHEN x.proper AND n_fit = 0 THEN 'reference_period_or_evidence_unresolved' END, CASE WHEN x.proper AND n_use > 1 THEN 'reference_ambiguous' END,
      CASE WHEN x.proper AND n_fit > 0 AND n_use = 0 THEN 'replacement_period_conflict' END], lambda b: b IS NOT NULL))) AS b
    FROM x LEFT JOIN hit ON hit.actual = x.id LEFT JOIN rel ON rel.actual = x.id)
  SELECT id AS actual_id, doc AS document_id, reference_id, CASE WHEN reference_id IS NOT NULL AND len(b) = 0 THEN 'READY' ELSE 'CLARIFICATION_REQUIRED' END AS status, array_to_string(b, ',') AS blockers FROM z"""
