"""Queries over attempts, uploads and listings: joins J1-J9, aggregates A1-A12, A28, A29, paging T, sets U."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docengine import adapters as a
from docengine.operators import counts as c
from docengine.operators import latest as l
from docengine.session import table

Q: dict = {}
SQL: dict = {}


def add(name: str, sql: str | None = None):
    def keep(f):
        Q[name] = f
        if sql:
            SQL[name] = a.with_views(sql)
        return f

    return keep


def newest():
    return [F.desc("cycle")]


@add("S1_scan", "SELECT o_orderkey, o_totalprice, o_orderdate FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def s1(s, d):
    return table(s, d, "orders").filter("o_orderstatus = 'F' and o_totalprice > 200000").select("o_orderkey", "o_totalprice", "o_orderdate").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50)


@add("J1_current_run", """SELECT c_custkey, o_orderkey, l_linenumber, p_name FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey
  JOIN part ON p_partkey = l_partkey AND p_size = l_linenumber""")  # fmt: skip
def j1(s, d):
    t = lambda n: table(s, d, n)
    found = t("lineitem").join(t("part"), (F.col("p_partkey") == F.col("l_partkey")) & (F.col("p_size") == F.col("l_linenumber")))
    return found.join(t("orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(t("customer"), F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "o_orderkey", "l_linenumber", "p_name")


@add("J2_rank_then_filter", "SELECT key_id, task_id, cycle FROM (SELECT *, row_number() OVER (PARTITION BY key_id ORDER BY cycle DESC) AS r FROM tasks) WHERE r = 1 AND state = 'succeeded'")
def j2(s, d):
    return l.rank_then_filter(a.tasks(s, d), ["key_id"], newest(), F.col("state") == "succeeded").select("key_id", "task_id", "cycle")


@add("J3_filter_then_rank", "SELECT key_id, task_id, cycle FROM (SELECT *, row_number() OVER (PARTITION BY key_id ORDER BY cycle DESC) AS r FROM tasks WHERE state = 'succeeded') WHERE r = 1")
def j3(s, d):
    return l.filter_then_rank(a.tasks(s, d), ["key_id"], newest(), F.col("state") == "succeeded").select("key_id", "task_id", "cycle")


@add("J4_latest_or_none", """SELECT c_custkey AS key_id, coalesce(state, 'none') AS state FROM customer LEFT JOIN
  (SELECT key_id, state, row_number() OVER (PARTITION BY key_id ORDER BY cycle DESC) AS r FROM tasks) t ON t.key_id = c_custkey AND r = 1""")  # fmt: skip
def j4(s, d):
    return l.latest_with_default(table(s, d, "customer").select(F.col("c_custkey").alias("key_id")), a.tasks(s, d), "key_id", newest(), "state", "none").select("key_id", "state")


@add("J5_latest_with_ties", "SELECT key_id, attempts, task_id FROM (SELECT *, row_number() OVER (PARTITION BY key_id ORDER BY attempts DESC, task_id DESC) AS r FROM tasks) WHERE r = 1")
def j5(s, d):
    return l.top_per_key(a.tasks(s, d), ["key_id"], [F.desc("attempts"), F.desc("task_id")]).select("key_id", "attempts", "task_id")


@add("J6_left_join_on_state", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P'")
def j6(s, d):
    done = table(s, d, "orders").filter("o_orderstatus = 'P'")
    return table(s, d, "customer").join(done, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "o_orderkey")


@add("J7_no_newer", "SELECT task_id, key_id, cycle FROM tasks t WHERE NOT EXISTS (SELECT 1 FROM tasks n WHERE n.key_id = t.key_id AND n.cycle > t.cycle)")
def j7(s, d):
    return l.without_newer(a.tasks(s, d), "key_id", "cycle").select("task_id", "key_id", "cycle")


@add("J8_undone_work", """SELECT o_orderkey, o_orderdate FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')
  ORDER BY o_orderdate, o_orderkey LIMIT 25""")  # fmt: skip
def j8(s, d):
    done = table(s, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return l.undone(table(s, d, "orders"), done, ["o_orderkey"], [F.asc("o_orderdate"), F.asc("o_orderkey")], 25).select("o_orderkey", "o_orderdate")


@add("J9_exists", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def j9(s, d):
    large = table(s, d, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return table(s, d, "customer").join(large, "c_custkey", "left_semi").select("c_custkey", "c_name")


@add("D44_fan_out", "SELECT c_custkey AS key_id, 1 AS cycle, 'queued' AS state FROM customer WHERE c_custkey NOT IN (SELECT key_id FROM tasks)")
def d44(s, d):
    every = table(s, d, "customer").select(F.col("c_custkey").alias("key_id"))
    return every.join(a.tasks(s, d).select("key_id").distinct(), "key_id", "left_anti").select("key_id", F.lit(1).alias("cycle"), F.lit("queued").alias("state"))


@add("D39_row_access", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def d39(s, d):
    grants = table(s, d, "customer").filter("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    return table(s, d, "orders").join(grants, "o_custkey", "left_semi").select("o_orderkey")


@add("A1_count_by_state", "SELECT state, count(*) AS n FROM (SELECT state, row_number() OVER (PARTITION BY key_id ORDER BY cycle DESC) AS r FROM tasks) WHERE r = 1 GROUP BY state")
def a1(s, d):
    return l.top_per_key(a.tasks(s, d), ["key_id"], newest()).groupBy("state").agg(F.count("*").alias("n"))


@add("A2_two_key_counts", """SELECT code, string_agg(state || '=' || n, ',' ORDER BY state) AS by_state FROM (SELECT fingerprint AS code, state, count(*) AS n FROM tasks GROUP BY ALL) GROUP BY code""")
def a2(s, d):
    each = a.tasks(s, d).groupBy(F.col("fingerprint").alias("code"), "state").agg(F.count("*").alias("n"))
    return each.groupBy("code").agg(F.array_join(F.sort_array(F.collect_list(F.concat("state", F.lit("="), F.col("n").cast("string")))), ",").alias("by_state"))


_GAPS = """SELECT bucket, coalesce(n, 0) AS n FROM (SELECT unnest(generate_series(TIMESTAMP '{0}', TIMESTAMP '{1}' - INTERVAL 1 {2}, INTERVAL 1 {2})) AS bucket) b
  LEFT JOIN (SELECT date_trunc('{2}', {3}) AS bucket, count(*) AS n FROM {4} WHERE {3} >= TIMESTAMP '{0}' AND {3} < TIMESTAMP '{1}' GROUP BY 1) USING (bucket)"""


@add("A3_hourly_with_gaps", _GAPS.format("2024-01-01 00:00:00", "2024-01-08 00:00:00", "hour", "ts", "events"))
def a3(s, d):
    return c.buckets_with_gaps(table(s, d, "events"), "ts", "hour", "2024-01-01 00:00:00", "2024-01-08 00:00:00")


@add("A3_daily_with_gaps", _GAPS.format("1995-01-01 00:00:00", "1995-04-01 00:00:00", "day", "o_orderdate", "orders"))
def a3d(s, d):
    return c.buckets_with_gaps(table(s, d, "orders"), "o_orderdate", "day", "1995-01-01 00:00:00", "1995-04-01 00:00:00")


@add("A4_period_change", """SELECT current, previous, CASE WHEN previous > 0 THEN floor((current - previous) / previous * 1000 + 0.5) / 10 END AS delta_percent FROM (
  SELECT count(*) FILTER (o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01') AS current, count(*) FILTER (o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01') AS previous FROM orders)""")  # fmt: skip
def a4(s, d):
    return c.period_change(table(s, d, "orders"), "o_orderdate", "1995-01-01", "1996-01-01", "1997-01-01")


@add("A5_pending", "SELECT (SELECT count(*) FROM tasks WHERE state <> 'succeeded') + (SELECT count(*) FROM lineitem WHERE l_returnflag = 'N' AND l_linestatus = 'O') + (SELECT count(*) FROM events WHERE event_type = 'error') AS pending")
def a5(s, d):
    parts = [a.tasks(s, d).filter("state <> 'succeeded'"), table(s, d, "lineitem").filter("l_returnflag = 'N' and l_linestatus = 'O'"), table(s, d, "events").filter("event_type = 'error'")]
    one = [p.agg(F.count("*").alias("n")) for p in parts]
    return one[0].unionByName(one[1]).unionByName(one[2]).agg(F.sum("n").cast("long").alias("pending"))


@add("A6_counts_with_default", """SELECT c_custkey, coalesce(n, 0) AS n, coalesce(n_priorities, 0) AS n_priorities FROM customer LEFT JOIN
  (SELECT o_custkey, count(*) AS n, count(DISTINCT o_orderpriority) AS n_priorities FROM orders GROUP BY 1) ON o_custkey = c_custkey""")  # fmt: skip
def a6(s, d):
    found = table(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.countDistinct("o_orderpriority").alias("n_priorities"))
    return table(s, d, "customer").select("c_custkey").join(found, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_priorities", F.lit(0)).alias("n_priorities"))


@add("A7_latest_per_key", "SELECT DISTINCT ON (l_partkey, l_suppkey) l_partkey, l_suppkey, l_orderkey, l_linenumber FROM lineitem ORDER BY l_partkey, l_suppkey, l_shipdate DESC, l_orderkey DESC, l_linenumber DESC")
def a7(s, d):
    order = [F.desc("l_shipdate"), F.desc("l_orderkey"), F.desc("l_linenumber")]
    return l.top_per_key(table(s, d, "lineitem"), ["l_partkey", "l_suppkey"], order).select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber")


@add("A8_newest_approved_valid", """SELECT fingerprint, task_id FROM (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY created_at DESC, task_id DESC) AS r FROM tasks WHERE state = 'succeeded') WHERE r = 1 AND attempts < 3""")
def a8(s, d):
    approved = a.tasks(s, d).filter("state = 'succeeded'")
    return l.rank_then_filter(approved, ["fingerprint"], [F.desc("created_at"), F.desc("task_id")], F.col("attempts") < 3).select("fingerprint", "task_id")


@add("A12_histogram", """SELECT event_type, le, count(*) FILTER (value <= le) AS cumulative, count(value) AS n, round(sum(value), 4) AS total FROM events, (SELECT unnest([CAST(1 AS DOUBLE), 5, 25, 100, 250]) AS le) GROUP BY ALL""")
def a12(s, d):
    return c.histogram(table(s, d, "events"), "value", [1, 5, 25, 100, 250], "event_type").withColumn("total", F.round("total", 4))


@add("A28_counts_with_null", "SELECT coalesce(k, 'null') AS k, count(*) AS n FROM (SELECT CASE l_returnflag WHEN 'N' THEN NULL ELSE l_returnflag END AS k FROM lineitem) GROUP BY 1")
def a28(s, d):
    return table(s, d, "lineitem").select(F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("k")).groupBy(F.coalesce("k", F.lit("null")).alias("k")).agg(F.count("*").alias("n"))


@add("A29_readiness", "SELECT key_id, bool_and(state IN ('succeeded', 'queued')) AND count(*) > 0 AS ready FROM tasks GROUP BY key_id")
def a29(s, d):
    return a.tasks(s, d).groupBy("key_id").agg((F.bool_and(F.col("state").isin("succeeded", "queued")) & (F.count("*") > 0)).alias("ready"))


@add("R7_settle", "SELECT key_id FROM tasks GROUP BY key_id HAVING count(*) FILTER (state <> 'succeeded') = 0")
def r7(s, d):
    return a.tasks(s, d).groupBy("key_id").agg(F.count_if(F.col("state") != "succeeded").alias("open")).filter("open = 0").select("key_id")


@add("P3_search", """SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
  WHERE contains(lower(c_name), '42') OR contains(lower(n_name), '1') OR contains(lower(o_orderpriority), 'urg')""")  # fmt: skip
def p3(s, d):
    joined = table(s, d, "orders").join(table(s, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(table(s, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    hit = lambda col, q: F.lower(col).contains(q)
    return joined.filter(hit("c_name", "42") | hit("n_name", "1") | hit("o_orderpriority", "urg")).select("o_orderkey")


@add("P10_optional_filter", "SELECT p_partkey FROM part WHERE p_size > 10")
def p10(s, d, brand=None, size=10):
    df = table(s, d, "part")
    for name, value in (("p_brand", brand),):
        df = df if value is None else df.filter(F.col(name) == value)
    return df.filter(F.col("p_size") > size).select("p_partkey")


@add("P12_pinned_parameters", """SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_size > 10 THEN 'PD' END, CASE WHEN p_size % 2 = 0 THEN 'RD' END, CASE WHEN p_retailprice > 950 THEN 'ID' END], lambda x: x IS NOT NULL), ',') AS stages FROM part""")
def p12(s, d):
    stages = F.array(F.when(F.col("p_size") > 10, "PD"), F.when(F.col("p_size") % 2 == 0, "RD"), F.when(F.col("p_retailprice") > 950, "ID"))
    return table(s, d, "part").select("p_partkey", F.array_join(F.array_compact(stages), ",").alias("stages"))


@add("T1_offset_page", "SELECT o_orderkey, o_orderdate, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20 OFFSET 40")
def t1(s, d):
    orders = table(s, d, "orders")
    page = c.offset_page(orders, [F.desc("o_orderdate"), F.desc("o_orderkey")], 40, 20).select("o_orderkey", "o_orderdate")
    return page.crossJoin(orders.agg(F.count("*").alias("total")))  # one row


@add("T2_keyset_page", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate < TIMESTAMP '1996-05-05' OR (o_orderdate = TIMESTAMP '1996-05-05' AND o_orderkey < 100) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 21")
def t2(s, d):
    import datetime

    return c.keyset_page(table(s, d, "orders"), [("o_orderdate", True), ("o_orderkey", True)], [datetime.datetime(1996, 5, 5), 100], 20).select("o_orderkey", "o_orderdate")


@add("T5_staleness_pick", "SELECT c_custkey FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS seen FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) ON o_custkey = c_custkey ORDER BY seen NULLS FIRST, c_custkey LIMIT 30")
def t5(s, d):
    seen = table(s, d, "orders").filter("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("seen"))
    return table(s, d, "customer").join(seen, "c_custkey", "left").orderBy(F.asc_nulls_first("seen"), "c_custkey").limit(30).select("c_custkey")


@add("T6_enum_sort", "SELECT o_orderkey FROM orders ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_totalprice DESC, o_orderkey LIMIT 40")
def t6(s, d):
    rank = F.when(F.col("o_orderstatus") == "P", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return table(s, d, "orders").orderBy(rank, F.desc("o_totalprice"), "o_orderkey").limit(40).select("o_orderkey")


@add("U1_ordered_union", "SELECT l_orderkey, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS reasons FROM lineitem GROUP BY 1")
def u1(s, d):
    return table(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.sort_array(F.collect_set("l_returnflag")), ",").alias("reasons"))


@add("U2_last_writer_wins", """SELECT id, value FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY src DESC) AS r FROM (
  SELECT c_custkey AS id, c_acctbal AS value, 0 AS src FROM customer UNION ALL SELECT s_suppkey, s_acctbal, 1 FROM supplier)) WHERE r = 1""")  # fmt: skip
def u2(s, d):
    one = table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("value"), F.lit(0).alias("src"))
    two = table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("value"), F.lit(1).alias("src"))
    return c.first_by(one.unionByName(two), ["id"], [F.desc("src")]).select("id", "value")


@add("U3_difference", "SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 30")
def u3(s, d):
    used = table(s, d, "lineitem").filter("l_quantity > 30").select(F.col("l_partkey").alias("p_partkey"))
    return table(s, d, "part").select("p_partkey").join(used, "p_partkey", "left_anti")


@add("U4_split_overlap", "SELECT count(*) AS shared FROM (SELECT DISTINCT md5(text) AS h FROM documents WHERE doc_id % 2 = 0 INTERSECT SELECT DISTINCT md5(text) FROM documents WHERE doc_id % 2 = 1)")
def u4(s, d):
    h = table(s, d, "documents").select("doc_id", F.md5("text").alias("h"))
    return h.filter("doc_id % 2 = 0").select("h").intersect(h.filter("doc_id % 2 = 1").select("h")).agg(F.count("*").alias("shared"))


@add("U5_first_source_wins", """SELECT kind, k, src FROM (SELECT *, row_number() OVER (PARTITION BY kind, lower(k) ORDER BY src, k) AS r FROM (
  SELECT 'nation' AS kind, n_name AS k, 0 AS src FROM nation UNION ALL SELECT 'nation', lower(n_name), 1 FROM nation UNION ALL SELECT 'region', r_name, 1 FROM region)) WHERE r = 1""")  # fmt: skip
def u5(s, d):
    n, r = table(s, d, "nation"), table(s, d, "region")
    row = lambda df, kind, k, src: df.select(F.lit(kind).alias("kind"), k.alias("k"), F.lit(src).alias("src"))
    every = row(n, "nation", F.col("n_name"), 0).unionByName(row(n, "nation", F.lower("n_name"), 1)).unionByName(row(r, "region", F.col("r_name"), 1))
    return c.first_by(every, [F.col("kind"), F.lower("k")], [F.asc("src"), F.asc("k")]).select("kind", "k", "src")


@add("U6_logical_dedupe", """SELECT id, min(sha256) AS sha256 FROM (SELECT coalesce('document:' || document_id, 'sha256:' || sha256) AS id, sha256 FROM facts) GROUP BY id""")
def u6(s, d):
    key = F.coalesce(F.concat(F.lit("document:"), "document_id"), F.concat(F.lit("sha256:"), "sha256"))
    return a.facts(s, d).withColumn("id", key).groupBy("id").agg(F.min("sha256").alias("sha256"))


@add("U7_canonical_files", "SELECT source, sha256, doc_id FROM (SELECT source, sha256(text) AS sha256, doc_id, row_number() OVER (PARTITION BY source, sha256(text) ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def u7(s, d):
    docs = table(s, d, "documents").select("source", F.sha2("text", 256).alias("sha256"), "doc_id")
    return docs.groupBy("source", "sha256").agg(F.min("doc_id").alias("doc_id"))


@add("S13_append_versions", """SELECT n.key, n.content, CAST(coalesce(m.last, 0) + 1 AS INTEGER) AS version FROM
  (SELECT DISTINCT o_custkey AS key, o_orderpriority AS content FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderstatus = 'P') n
  LEFT JOIN (SELECT o_custkey AS key, count(*) AS last FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01' GROUP BY 1) m USING (key)
  WHERE NOT EXISTS (SELECT 1 FROM orders e WHERE e.o_orderdate < TIMESTAMP '1997-01-01' AND e.o_custkey = n.key AND e.o_orderpriority = n.content)""")  # fmt: skip
def s13(s, d):
    o = table(s, d, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    old = o.filter("o_orderdate < timestamp'1997-01-01'").select(F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("content"), F.row_number().over(w).alias("version"))
    new = o.filter("o_orderdate >= timestamp'1997-01-01' and o_orderstatus = 'P'").select(F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("content")).distinct()
    return l.append_versions(old, new, ["key"], "content").select("key", "content", "version")


@add("S12_cache_misses", "SELECT DISTINCT md5(text) AS sha FROM documents WHERE md5(text) NOT IN (SELECT md5(text) FROM documents WHERE doc_id % 3 = 0)")
def s12(s, d):
    h = table(s, d, "documents").filter("text is not null").select("doc_id", F.md5("text").alias("sha"))
    return h.join(h.filter("doc_id % 3 = 0").select("sha"), "sha", "left_anti").select("sha").distinct()


@add("S17_catalogue_export", "SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A') ORDER BY p_partkey")
def s17(s, d):
    approved = table(s, d, "lineitem").filter("l_returnflag = 'A'").select(F.col("l_partkey").alias("p_partkey"))
    return table(s, d, "part").join(approved, "p_partkey", "left_semi").select("p_partkey", "p_name").orderBy("p_partkey")


@add("W1_rank_one", "SELECT n_regionkey, n_name FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS r FROM nation) WHERE r = 1")
def w1(s, d):
    return l.top_per_key(table(s, d, "nation"), ["n_regionkey"], [F.asc("n_name")]).select("n_regionkey", "n_name")


@add("W7_merged_spans", """SELECT o_custkey, start, stop, n_merged FROM (SELECT o_custkey, min(f) AS start, max(t) AS stop, count(*) AS n_merged FROM (
  SELECT *, sum(new) OVER (PARTITION BY o_custkey ORDER BY f, t ROWS UNBOUNDED PRECEDING) AS island FROM (
  SELECT *, CASE WHEN f <= max(t) OVER (PARTITION BY o_custkey ORDER BY f, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM (
  SELECT o_custkey, CAST(o_orderdate AS DATE) AS f, CAST(o_orderdate AS DATE) + 45 AS t FROM orders))) GROUP BY o_custkey, island)""")  # fmt: skip
def w7(s, d):
    spans = table(s, d, "orders").select("o_custkey", F.to_date("o_orderdate").alias("start"), F.date_add(F.to_date("o_orderdate"), 45).alias("stop"))
    return c.merged_spans(spans, "o_custkey", "start", "stop")


@add("W14_interleave", "SELECT conv_id, turn AS t, CAST(row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) AS INTEGER) AS turn FROM conversations")
def w14(s, d):
    rows = table(s, d, "conversations").select("conv_id", F.col("turn").alias("t"), "role")
    return c.interleaved(rows, "role", [F.asc("conv_id"), F.asc("t")]).select("conv_id", "t", "turn")


@add("W16_batches", "SELECT conv_id, turn, CAST((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 2 AS BIGINT) AS batch FROM conversations")
def w16(s, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(s, d, "conversations").select("conv_id", "turn", F.floor((F.row_number().over(w) - 1) / 2).alias("batch"))


@add("W17_clusters", """SELECT l_suppkey, cluster, round(avg(x), 6) AS center, count(*) AS n FROM (SELECT l_suppkey, x, CAST(sum(new) OVER (PARTITION BY l_suppkey ORDER BY x) AS BIGINT) AS cluster FROM (
  SELECT l_suppkey, l_extendedprice AS x, CASE WHEN l_extendedprice - lag(l_extendedprice) OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) <= 500 THEN 0 ELSE 1 END AS new FROM lineitem)) GROUP BY ALL""")  # fmt: skip
def w17(s, d):
    return c.clusters(table(s, d, "lineitem"), "l_suppkey", "l_extendedprice", 500.0).select("l_suppkey", "cluster", F.round("center", 6).alias("center"), "n")


@add("W19_ordinals", "SELECT conv_id, turn, 'sec' || (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) AS label FROM conversations")
def w19(s, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(s, d, "conversations").select("conv_id", "turn", F.concat(F.lit("sec"), (F.row_number().over(w) - 1).cast("string")).alias("label"))


@add("F29_json_path", "SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events WHERE props->>'$.k' IS NOT NULL")
def f29(s, d):
    return table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")).filter("k is not null")


@add("F30_bucket_keys", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%dT%H:00') AS bucket, count(*) AS n FROM events GROUP BY 1")
def f30(s, d):
    return table(s, d, "events").groupBy(F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd'T'HH:00").alias("bucket")).agg(F.count("*").alias("n"))


@add("F34_null_handling", "SELECT key_id, task_id FROM tasks WHERE nullif(fingerprint, '5-LOW') IS DISTINCT FROM '1-URGENT'")
def f34(s, d):
    fp = F.when(F.col("fingerprint") != "5-LOW", F.col("fingerprint"))
    return a.tasks(s, d).filter(~fp.eqNullSafe(F.lit("1-URGENT"))).select("key_id", "task_id")
