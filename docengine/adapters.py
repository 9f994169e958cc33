"""The driver's generic tables as relations of the document domain.

Each adapter is a pure function of stored columns. VIEWS holds the same definitions as DuckDB
common table expressions, for the queries' SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docengine.session import table

VIEWS = {
    "tasks": """SELECT o_orderkey AS task_id, o_custkey AS key_id,
      CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS cycle,
      CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'O' THEN 'queued' ELSE 'processing' END AS state,
      CAST(o_orderkey % 4 AS INTEGER) AS attempts, o_orderpriority AS fingerprint, o_orderdate AS created_at FROM orders""",
    "members": """SELECT l_orderkey AS group_id, l_orderkey * 10 + l_linenumber AS extraction_id,
      CASE l_linestatus WHEN 'O' THEN 'actual' ELSE 'expected' END AS role, CASE WHEN l_linenumber = 7 THEN 'ambiguous' ELSE 'extracted' END AS status,
      l_quantity AS value, CASE l_returnflag WHEN 'N' THEN NULL ELSE l_returnflag END AS unit FROM lineitem""",
    "pairs": """SELECT l_orderkey * 10 + l_linenumber AS group_id, l_orderkey * 10 + l_linenumber AS extraction_id, p_retailprice AS expected, l_extendedprice - p_retailprice * (l_quantity - 1) AS actual,
      CASE l_returnflag WHEN 'R' THEN NULL ELSE 'm' END AS expected_unit, CASE l_returnflag WHEN 'A' THEN 'm' WHEN 'R' THEN 'm' ELSE CASE WHEN l_linenumber = 1 THEN 'km' ELSE 'm' END END AS actual_unit
      FROM lineitem JOIN part ON p_partkey = l_partkey""",
    "blocks": """SELECT doc_id, CAST(i AS INTEGER) AS block_order, lines[i] AS raw_text, CAST(i AS DOUBLE) / len(lines) AS y0 FROM (
      SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL))""",
    "revisions": """SELECT o_orderkey AS revision_id, o_custkey AS document_id, CASE o_orderstatus WHEN 'F' THEN 'ID' WHEN 'O' THEN 'RD' ELSE 'PD' END AS stage,
      CAST(o_custkey % 50 AS VARCHAR) AS code, lower(o_orderpriority) AS scope, CAST(o_orderdate AS DATE) AS valid_from, CAST(o_orderdate AS DATE) + 60 AS valid_to,
      lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS predecessor_id FROM orders""",
    "requirements": """SELECT n_nationkey AS requirement_id, n_name AS code, CASE n_regionkey % 3 WHEN 0 THEN 'PD' WHEN 1 THEN 'RD' ELSE 'ID' END AS stage,
      'K' || CAST(n_nationkey % 5 AS VARCHAR) AS kind_code, 'K' || CAST(n_nationkey % 7 AS VARCHAR) AS alternative, CAST(n_nationkey % 4 * 2 AS INTEGER) AS min_qty, n_nationkey % 11 = 3 AS excluded, n_regionkey AS object_id FROM nation""",
    "facts": """SELECT CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE CAST(s_suppkey // 2 AS VARCHAR) END AS document_id, s_name AS sha256, CASE s_nationkey % 3 WHEN 0 THEN 'PD' WHEN 1 THEN 'RD' ELSE 'ID' END AS stage,
      CASE WHEN s_suppkey % 13 = 0 THEN NULL ELSE 'K' || CAST(s_suppkey % 6 AS VARCHAR) END AS kind_code, s_suppkey % 17 = 0 AS kind_ambiguous, s_acctbal < -500 AS needs_review FROM supplier""",
    "truth": """SELECT d.doc_id AS object_id, d.source AS section, l.quality = 0 AS expected_violation, d.n_chars < 600 AS predicted_violation, d.n_chars % 10 = 0 AS abstained FROM labels l JOIN documents d ON d.doc_id = l.doc_id""",
}


def with_views(sql: str) -> str:
    """The SQL with the views that it names in front."""
    import re

    used = [name for name in VIEWS if re.search(rf"\b{name}\b", sql)]
    if not used:
        return sql
    head = ", ".join(f"{name} AS ({VIEWS[name]})" for name in used)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {head}, {body[len('WITH RECURSIVE'):]}"
    return f"WITH {head}, {body[4:]}" if body.upper().startswith("WITH") else f"WITH {head} {body}"


def tasks(spark: SparkSession, d: str) -> DataFrame:
    """Attempts: task_id, key_id, cycle, state, attempts, fingerprint, created_at."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    state = F.when(F.col("o_orderstatus") == "F", "succeeded").when(F.col("o_orderstatus") == "O", "queued").otherwise("processing")
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("task_id"), F.col("o_custkey").alias("key_id"), F.row_number().over(w).alias("cycle"), state.alias("state"),
        (F.col("o_orderkey") % 4).cast("int").alias("attempts"), F.col("o_orderpriority").alias("fingerprint"), F.col("o_orderdate").alias("created_at"),
    )


def members(spark: SparkSession, d: str) -> DataFrame:
    """Group members: group_id, extraction_id, role, status, value, unit."""
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("group_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("extraction_id"),
        F.when(F.col("l_linestatus") == "O", "actual").otherwise("expected").alias("role"), F.when(F.col("l_linenumber") == 7, "ambiguous").otherwise("extracted").alias("status"),
        F.col("l_quantity").alias("value"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("unit"),
    )


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """One expected and one actual value per group, with units."""
    joined = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    flag = F.col("l_returnflag")
    key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return joined.select(
        key.alias("group_id"), key.alias("extraction_id"), F.col("p_retailprice").alias("expected"), (F.col("l_extendedprice") - F.col("p_retailprice") * (F.col("l_quantity") - 1)).alias("actual"),
        F.when(flag != "R", "m").alias("expected_unit"), F.when((flag == "N") & (F.col("l_linenumber") == 1), "km").otherwise("m").alias("actual_unit"),
    )


def blocks(spark: SparkSession, d: str) -> DataFrame:
    """Text blocks: the lines of each document with their order and relative height."""
    lines = table(spark, d, "documents").filter("text is not null").select("doc_id", F.split("text", "\n", -1).alias("lines"))
    return lines.select("doc_id", F.size("lines").alias("n"), F.posexplode("lines").alias("pos", "raw_text")).select("doc_id", (F.col("pos") + 1).alias("block_order"), "raw_text", ((F.col("pos") + 1).cast("double") / F.col("n")).alias("y0"))


def revisions(spark: SparkSession, d: str) -> DataFrame:
    """Document revisions with stage, code, scope, validity and predecessor."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    status = F.col("o_orderstatus")
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("revision_id"), F.col("o_custkey").alias("document_id"), F.when(status == "F", "ID").when(status == "O", "RD").otherwise("PD").alias("stage"),
        (F.col("o_custkey") % 50).cast("string").alias("code"), F.lower("o_orderpriority").alias("scope"), F.to_date("o_orderdate").alias("valid_from"), F.date_add(F.to_date("o_orderdate"), 60).alias("valid_to"),
        F.lag("o_orderkey").over(w).alias("predecessor_id"),
    )


def _stage(n):
    return F.when(n == 0, "PD").when(n == 1, "RD").otherwise("ID")


def requirements(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    return table(spark, d, "nation").select(
        k.alias("requirement_id"), F.col("n_name").alias("code"), _stage(F.col("n_regionkey") % 3).alias("stage"), F.concat(F.lit("K"), (k % 5).cast("string")).alias("kind_code"),
        F.concat(F.lit("K"), (k % 7).cast("string")).alias("alternative"), (k % 4 * 2).cast("int").alias("min_qty"), (k % 11 == 3).alias("excluded"), F.col("n_regionkey").alias("object_id"),
    )


def facts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(
        F.when(k % 3 != 0, F.expr("cast(s_suppkey div 2 as string)")).alias("document_id"), F.col("s_name").alias("sha256"), _stage(F.col("s_nationkey") % 3).alias("stage"),
        F.when(k % 13 != 0, F.concat(F.lit("K"), (k % 6).cast("string"))).alias("kind_code"), (k % 17 == 0).alias("kind_ambiguous"), (F.col("s_acctbal") < -500).alias("needs_review"),
    )


def truth(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    return joined.select(F.col("doc_id").alias("object_id"), F.col("source").alias("section"), (F.col("quality") == 0).alias("expected_violation"), (F.col("n_chars") < 600).alias("predicted_violation"), (F.col("n_chars") % 10 == 0).alias("abstained"))
