"""Queries over receipts, retries, uploads and files."""

from __future__ import annotations

from pyspark.sql import functions as F

from docengine import adapters as a
from docengine.sources import markup
from docengine.session import table
from docengine.streaming import jobs

Q: dict = {}
SQL: dict = {}


def add(name: str, run, sql: str | None = None) -> None:
    Q[name] = run
    if sql:
        SQL[name] = a.with_views(sql)


add("R2_receipt_conflicts", lambda s, d: jobs.receipt_conflicts(table(s, d, "events"), ["user_id"], "event_type").select("user_id", "n"), "SELECT user_id, count(DISTINCT event_type) AS n FROM events GROUP BY 1 HAVING count(DISTINCT event_type) > 1")
add("R4_backoff", lambda s, d: a.tasks(s, d).select("task_id", jobs.backoff(F.col("attempts")).alias("seconds")), "SELECT task_id, CASE WHEN attempts < 3 THEN least(CAST(pow(4, attempts) AS DOUBLE), 60) END AS seconds FROM tasks")


def r5(s, d):
    t = a.tasks(s, d).withColumn("dispatched_at", F.when(F.col("attempts") > 0, F.col("created_at") + F.expr("interval 1 day"))).withColumn("lease_until", F.col("created_at") + F.expr("interval 2 days"))
    return jobs.due(t, "1996-06-01 00:00:00").select("task_id", "state")


add("R5_due_tasks", r5, """SELECT task_id, state FROM tasks WHERE (state = 'queued' AND CASE WHEN attempts > 0 THEN created_at + INTERVAL 1 DAY ELSE created_at END <= TIMESTAMP '1996-05-31 23:59:00') OR (state = 'processing' AND created_at + INTERVAL 2 DAY < TIMESTAMP '1996-06-01')""")
add("R6_superseded", lambda s, d: jobs.superseded(a.tasks(s, d).filter("state <> 'succeeded'"), a.tasks(s, d), "key_id", "cycle").select("task_id", "key_id", "cycle"), "SELECT task_id, key_id, cycle FROM tasks t WHERE state <> 'succeeded' AND cycle < (SELECT max(cycle) FROM tasks n WHERE n.key_id = t.key_id)")
add("R10_upload_counts", lambda s, d: jobs.upload_counts(table(s, d, "events"), "ts", "1 hour", "10 minutes", "event_type"), "SELECT date_trunc('hour', ts) AS bucket, event_type, count(*) AS n FROM events GROUP BY ALL")
add("R8_integrity", lambda s, d: markup.verify_manifest(table(s, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.encode("text", "UTF-8").alias("content")), table(s, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.octet_length("text").alias("size"), F.when(F.col("doc_id") % 10 == 0, F.lit("00")).otherwise(F.sha2("text", 256)).alias("sha256"))), "SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN doc_id % 10 = 0 THEN 'hash' ELSE 'ok' END AS result FROM documents")
add("S18_manifest_check", Q["R8_integrity"], SQL["R8_integrity"])
add("S10_formats", lambda s, d: markup.inspect_files(table(s, d, "pages").select("page_id", F.encode("html", "UTF-8").alias("content"))).select("page_id", "format", "error"))
add("S8_html_tables", lambda s, d: markup.read_tables(table(s, d, "pages"), "page_id", "html"))


def _tables(li):
    row = F.concat(F.lit("<tr><td>"), F.col("l_linenumber").cast("string"), F.lit("</td><td>"), F.col("l_partkey").cast("string"), F.lit("</td></tr>"))
    page = li.groupBy("l_orderkey").agg(F.concat(F.lit("<table>"), F.array_join(F.sort_array(F.collect_list(row)), ""), F.lit("</table>")).alias("html"))
    return markup.read_tables(page, "l_orderkey", "html").filter("col = 1").groupBy("key").agg(F.count("*").alias("n"), F.sum(F.col("text").cast("long")).alias("parts"))


add("S8_generated_tables", lambda s, d: _tables(table(s, d, "lineitem")), "SELECT l_orderkey AS key, count(*) AS n, CAST(sum(l_partkey) AS BIGINT) AS parts FROM lineitem GROUP BY 1")


def s5(s, d):
    p = table(s, d, "part")
    xml = F.concat(F.lit('<part size="'), F.col("p_size").cast("string"), F.lit('"><name>'), F.col("p_name"), F.lit("</name><brand/></part>"))
    return markup.read_xml(p.select("p_partkey", xml.alias("x")), "p_partkey", "x").select("key", "item", "path", "value", "error")


add("S5_xml_items", s5, """SELECT p_partkey AS key, CAST(i AS INTEGER) AS item, (['/part[1]/@size', '/part[1]/name[1]/text()[1]', '/part[1]/brand[1]/text()[1]'])[i + 1] AS path, CASE i WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN p_name ELSE '' END AS value, CAST(NULL AS VARCHAR) AS error
  FROM part, (SELECT unnest([0, 1, 2]) AS i)""")  # fmt: skip


def s4(s, d):
    docs = table(s, d, "documents").filter("text is not null").select(F.col("doc_id").cast("string").alias("name"), F.base64(F.encode("text", "UTF-8")).alias("data"))
    return markup.decoded_package(docs).select("name", "size", "sha256")


add("S4_package_files", s4, "SELECT CAST(doc_id AS VARCHAR) AS name, CAST(strlen(text) AS INTEGER) AS size, sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL")


def s16(s, d):
    n = table(s, d, "nation")
    return n.groupBy("n_regionkey").agg(F.to_json(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name")))).alias("rows"))


add("S16_json_snapshot", s16, """SELECT n_regionkey, '[' || string_agg('{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}', ',' ORDER BY n_nationkey) || ']' AS rows FROM nation GROUP BY 1""")


def s15(s, d):
    from docengine.operators.counts import histogram

    h = histogram(table(s, d, "events"), "value", [5, 25], "event_type")
    return h.select(F.format_string('value_bucket{kind="%s",le="%s"} %d', "event_type", F.col("le").cast("int").cast("string"), "cumulative").alias("line"))


add("S15_metrics_text", s15, """SELECT 'value_bucket{kind="' || event_type || '",le="' || le || '"} ' || count(*) FILTER (value <= le) AS line FROM events, (SELECT unnest([5, 25]) AS le) GROUP BY event_type, le""")
