"""Queries over findings, text blocks and evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docengine import adapters as a
from docengine.operators import classify as k
from docengine.operators import extract
from docengine.operators import metrics as m
from docengine.operators import protocol as p
from docengine.operators import search as x
from docengine.session import table

Q: dict = {}
SQL: dict = {}


def add(name: str, run, sql: str | None = None) -> None:
    Q[name] = run
    if sql:
        SQL[name] = a.with_views(sql)


# findings: parameters are parts; groups and sections come from lineitem
def _parameters(s, d):
    return table(s, d, "part").select(F.col("p_partkey").alias("parameter_code"), (F.col("p_size") % 6 != 0).alias("has_rule"), (F.col("p_partkey") % 5 != 0).alias("applicable"))


def _groups(s, d):
    status = F.when(F.sum("l_quantity") > 60, "discrepancy").when(F.sum("l_quantity") > 30, "match").otherwise("expected_missing")
    return table(s, d, "lineitem").filter("l_returnflag = 'A'").groupBy(F.col("l_partkey").alias("parameter_code"), F.col("l_linestatus").alias("scope_key")).agg(status.alias("verdict"))


def _sections(s, d):
    return table(s, d, "lineitem").filter("l_returnflag <> 'A'").groupBy(F.col("l_partkey").alias("parameter_code"), F.col("l_linestatus").alias("scope_key")).agg((F.max("l_discount") > 0.08).alias("candidate"))


def findings(s, d):
    sc = p.scopes(_parameters(s, d), _groups(s, d), _sections(s, d))
    gate = F.when(F.col("parameter_code") % 7 == 0, "CLARIFICATION_REQUIRED").when(F.col("verdict").isNull() & F.col("candidate").isNull(), "MISSING_EVIDENCE").otherwise("READY")
    status = p.finding_status(F.col("has_rule") | F.col("candidate").isNotNull(), F.col("applicable"), gate, F.col("verdict"), F.col("candidate"))
    return sc.select("parameter_code", "scope_key", status.alias("status"), F.col("verdict").isNotNull().alias("evidence"))


_FIND = """pr AS (SELECT p_partkey AS parameter_code, p_size % 6 <> 0 AS has_rule, p_partkey % 5 <> 0 AS applicable FROM part),
  gr AS (SELECT l_partkey AS parameter_code, l_linestatus AS scope_key, CASE WHEN sum(l_quantity) > 60 THEN 'discrepancy' WHEN sum(l_quantity) > 30 THEN 'match' ELSE 'expected_missing' END AS verdict FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL),
  se AS (SELECT l_partkey AS parameter_code, l_linestatus AS scope_key, max(l_discount) > 0.08 AS candidate FROM lineitem WHERE l_returnflag <> 'A' GROUP BY ALL),
  sc AS (SELECT parameter_code, has_rule, applicable, coalesce(scope_key, '') AS scope_key, verdict, candidate FROM pr LEFT JOIN (SELECT * FROM gr FULL JOIN se USING (parameter_code, scope_key)) USING (parameter_code)),
  fi AS (SELECT parameter_code, scope_key, verdict IS NOT NULL AS evidence, CASE WHEN NOT (has_rule OR candidate IS NOT NULL) THEN 'MISSING_EVIDENCE' WHEN NOT applicable THEN 'NOT_APPLICABLE' WHEN parameter_code % 7 = 0 THEN 'CLARIFICATION_REQUIRED'
    WHEN verdict IS NULL AND candidate IS NULL THEN 'MISSING_EVIDENCE' WHEN verdict = 'match' THEN 'NEGATIVE_VERIFIED' WHEN verdict = 'discrepancy' THEN 'CANDIDATE' WHEN coalesce(candidate, false) THEN 'CANDIDATE' WHEN verdict = 'expected_missing' THEN 'MISSING_EVIDENCE' ELSE 'NOT_COMPARABLE' END AS status FROM sc)"""

add("D33_protocol", findings, f"WITH {_FIND} SELECT * FROM fi")
add("J30_parameter_scopes", lambda s, d: p.scopes(_parameters(s, d), _groups(s, d), _sections(s, d)).select("parameter_code", "scope_key", "verdict", "candidate"), f"WITH {_FIND} SELECT parameter_code, scope_key, verdict, candidate FROM sc")
add("A21_content_counts", lambda s, d: p.content_counts(findings(s, d)), f"""WITH {_FIND}, k AS (SELECT *, status IN ('CANDIDATE', 'NEGATIVE_VERIFIED', 'CONFIRMED') AS c FROM fi), g AS (SELECT parameter_code, bool_or(c) AS any_c, bool_and(c OR status = 'NOT_APPLICABLE') AS only_c, bool_or(evidence) AS evidence, count(*) AS n, count(*) FILTER (status = 'CANDIDATE') AS k FROM k GROUP BY 1)
  SELECT CAST(sum(n) AS BIGINT) AS findings, CAST(sum(k) AS BIGINT) AS candidates, count(*) AS parameters, count(*) FILTER (evidence) AS with_evidence, count(*) FILTER (any_c AND only_c) AS compared FROM g""")  # fmt: skip
add("A22_coverage", lambda s, d: findings(s, d).agg(F.countDistinct(F.when(F.col("evidence"), F.col("parameter_code"))).alias("observed"), F.count("*").alias("points"), F.count_if(F.col("status") == "MISSING_EVIDENCE").alias("unavailable")), f"WITH {_FIND} SELECT count(DISTINCT CASE WHEN evidence THEN parameter_code END) AS observed, count(*) AS points, count(*) FILTER (status = 'MISSING_EVIDENCE') AS unavailable FROM fi")
add("A23_summary", lambda s, d: findings(s, d).groupBy("status").agg(F.count("*").alias("n")), f"WITH {_FIND} SELECT status, count(*) AS n FROM fi GROUP BY 1")
add("A33_violations", lambda s, d: findings(s, d).agg(F.count_if(F.col("status") == "CANDIDATE").alias("open"), F.count_if(F.col("status") == "NEGATIVE_VERIFIED").alias("cleared")), f"WITH {_FIND} SELECT count(*) FILTER (status = 'CANDIDATE') AS open, count(*) FILTER (status = 'NEGATIVE_VERIFIED') AS cleared FROM fi")
add("D46_list_findings", lambda s, d: findings(s, d).filter((F.col("status") == "CANDIDATE") & F.col("parameter_code").cast("string").contains("1")).orderBy("parameter_code", "scope_key").select("parameter_code", "scope_key"), f"WITH {_FIND} SELECT parameter_code, scope_key FROM fi WHERE status = 'CANDIDATE' AND contains(CAST(parameter_code AS VARCHAR), '1') ORDER BY ALL")
add("D47_finalisation", lambda s, d: findings(s, d).groupBy("scope_key").agg(F.bool_and(F.col("status") != "CANDIDATE").alias("may_finish")), f"WITH {_FIND} SELECT scope_key, bool_and(status <> 'CANDIDATE') AS may_finish FROM fi GROUP BY 1")


def j31(s, d):
    new = findings(s, d).withColumn("fingerprint", F.col("parameter_code") % 3)
    old = new.select("parameter_code", "scope_key", (F.col("parameter_code") % 4).alias("fingerprint"), F.lit("CONFIRMED").alias("status"), (F.col("parameter_code") % 2 == 0).alias("decided"))
    return p.carried(new, old, ["parameter_code", "scope_key"]).select("parameter_code", "scope_key", "status", "carried")


add("J31_carried_decisions", j31, f"WITH {_FIND} SELECT parameter_code, scope_key, CASE WHEN parameter_code % 2 = 0 AND parameter_code % 3 = parameter_code % 4 THEN 'CONFIRMED' ELSE status END AS status, parameter_code % 2 = 0 AND parameter_code % 3 = parameter_code % 4 AS carried FROM fi")


def d34(s, d):
    action = F.element_at(F.array(*[F.lit(v) for v in p.TRANSITIONS]), (F.col("parameter_code") % 4 + 1).cast("int"))
    return findings(s, d).select("parameter_code", "scope_key", p.decided(F.col("status"), action).alias("next"))


add("D34_decisions", d34, f"""WITH {_FIND} SELECT parameter_code, scope_key, CASE parameter_code % 4 WHEN 0 THEN CASE WHEN status = 'CANDIDATE' THEN 'CONFIRMED' END WHEN 1 THEN CASE WHEN status = 'CANDIDATE' THEN 'NEGATIVE_VERIFIED' END WHEN 2 THEN CASE WHEN status = 'CANDIDATE' THEN 'CLARIFICATION_REQUIRED' END
  ELSE CASE WHEN status IN ('CONFIRMED', 'NEGATIVE_VERIFIED', 'CLARIFICATION_REQUIRED') THEN 'CANDIDATE' END END AS next FROM fi""")  # fmt: skip


def d48(s, d):
    pinned = table(s, d, "nation").select(F.col("n_regionkey").alias("context"), F.col("n_nationkey").alias("code"))
    got = table(s, d, "customer").select((F.col("c_nationkey") % 5).cast("int").alias("context"), F.col("c_nationkey").alias("code")).groupBy("context", "code").agg(F.count("*").alias("n"))
    both = pinned.withColumn("pinned", F.lit(True)).join(got, ["context", "code"], "full_outer")
    return both.select("context", "code", F.when(F.col("pinned").isNull(), "unknown").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "duplicate").otherwise("ok").alias("result"))


add("D48_reconcile", d48, """SELECT context, code, CASE WHEN p IS NULL THEN 'unknown' WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'duplicate' ELSE 'ok' END AS result FROM (SELECT n_regionkey AS context, n_nationkey AS code, true AS p FROM nation)
  FULL JOIN (SELECT CAST(c_nationkey % 5 AS INTEGER) AS context, c_nationkey AS code, count(*) AS n FROM customer GROUP BY ALL) USING (context, code)""")  # fmt: skip

add("A30_fingerprint", lambda s, d: p.fingerprint(table(s, d, "lineitem"), ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey"]), """SELECT l_suppkey, sha256(string_agg(p || ph, '' ORDER BY p || ph)) AS fingerprint FROM (SELECT l_suppkey, substring(h, 1, 2) AS p, sha256(string_agg(h, '' ORDER BY h)) AS ph FROM (
  SELECT l_suppkey, sha256(concat_ws(chr(31), l_orderkey, l_linenumber, l_partkey)) AS h FROM lineitem) GROUP BY ALL) GROUP BY 1""")  # fmt: skip

# text blocks
_W = "OVER (PARTITION BY doc_id ORDER BY block_order"
add("D1_anchor_hits", lambda s, d: x.anchor_hits(a.blocks(s, d), ["apache license", "password", "the"]).select("doc_id", "block_order", "term"), r"SELECT doc_id, block_order, CAST(CASE WHEN contains(t, 'apache license') THEN 0 WHEN contains(t, 'password') THEN 1 ELSE 2 END AS INTEGER) AS term FROM (SELECT *, regexp_replace(lower(raw_text), '\s+', ' ', 'g') AS t FROM blocks) WHERE contains(t, 'apache license') OR contains(t, 'password') OR contains(t, 'the')")


def w4(s, d):
    b = a.blocks(s, d)
    return x.around(b, x.anchor_hits(b, ["apache license"]), 3).select("doc_id", "hit_order", "block_order")


add("W4_around_hits", w4, "SELECT b.doc_id, h.block_order AS hit_order, b.block_order FROM blocks b JOIN blocks h ON h.doc_id = b.doc_id AND b.block_order BETWEEN h.block_order - 3 AND h.block_order + 3 WHERE contains(lower(h.raw_text), 'apache license')")
add("W2_preceding", lambda s, d: x.preceding(a.blocks(s, d), 2).select("doc_id", "block_order", "context"), f"SELECT doc_id, block_order, coalesce(string_agg(raw_text, ' ') {_W} ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), '') AS context FROM blocks")
add("W3_joined_title", lambda s, d: a.blocks(s, d).select("doc_id", "block_order", F.concat_ws(" ", "raw_text", F.lead("raw_text").over(Window.partitionBy("doc_id").orderBy("block_order"))).alias("joined")), f"SELECT doc_id, block_order, concat_ws(' ', raw_text, lead(raw_text) {_W})) AS joined FROM blocks")
add("W5_following", lambda s, d: x.following(a.blocks(s, d), 2).select("doc_id", "block_order", "window"), f"SELECT doc_id, block_order, string_agg(raw_text, chr(10)) {_W} ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS \"window\" FROM blocks")
add("W8_range_slice", lambda s, d: a.blocks(s, d).filter(F.col("block_order").between(2, 4)).select("doc_id", "block_order"), "SELECT doc_id, block_order FROM blocks WHERE block_order BETWEEN 2 AND 4")
add("W12_look_ahead", lambda s, d: x.section_ends(a.blocks(s, d).select("doc_id", "block_order"), "doc_id", "block_order").select("doc_id", "block_order", "end"), """WITH l AS (SELECT doc_id, max(block_order) AS last FROM blocks GROUP BY 1)
  SELECT b.doc_id, b.block_order, e.block_order AS "end" FROM blocks b JOIN blocks e ON e.doc_id = b.doc_id JOIN l ON l.doc_id = b.doc_id WHERE e.block_order = b.block_order OR e.block_order = last OR (e.block_order > b.block_order AND bit_count(e.block_order - b.block_order) = 1)""")  # fmt: skip
add("W13_recurring_lines", lambda s, d: x.recurring_lines(a.blocks(s, d), 0.2, 2), "SELECT raw_text, count(DISTINCT doc_id) AS n_docs FROM blocks WHERE trim(raw_text) <> '' GROUP BY raw_text HAVING count(DISTINCT doc_id) >= 2 AND NOT bool_or(y0 > 0.2 AND y0 < 0.8)")


def d3(s, d):
    """Orders as tables with a header, one row a line; the quantity of line 3 by its header."""
    li = table(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("quantity"))
    row = lambda n, *texts: [F.struct(n.alias("row"), F.lit(c).alias("col"), t.alias("text")) for c, t in enumerate(texts)]
    lines = li.select("l_orderkey", F.explode(F.array(*row(F.col("l_linenumber").cast("int"), F.format_string("Line %d", F.col("l_linenumber").cast("int")), F.translate(F.col("quantity").cast("string"), ".", ","), F.lit("m2")))).alias("c"))
    heads = li.select("l_orderkey").distinct().select("l_orderkey", F.explode(F.array(*row(F.lit(0), F.lit("Item"), F.lit("Quantity"), F.lit("Unit")))).alias("c"))
    found = extract.table_lookup(lines.unionByName(heads).select("l_orderkey", "c.*"), "l_orderkey", ["quantity", "price"], "line 3", 1, ["unit"], "quantity")
    return found.select("l_orderkey", F.col("score").cast("int").alias("score"), F.col("row").cast("int").alias("row"), "value")


add("D3_table_lookup", d3, "SELECT l_orderkey, 1 AS score, 3 AS row, CAST(max(l_quantity) AS DOUBLE) AS value FROM lineitem WHERE l_linenumber = 3 GROUP BY 1")


def d4(s, d):
    return x.regex_values(a.blocks(s, d), ["license"], r"under (?:the )?([A-Za-z0-9 .-]+)", 1)


add("D4_regex_plan", d4, """SELECT doc_id, block_order, v AS value FROM (SELECT doc_id, block_order, regexp_extract(raw_text || coalesce(chr(10) || lead(raw_text) OVER (PARTITION BY doc_id ORDER BY block_order), ''), 'under (?:the )?([A-Za-z0-9 .-]+)', 1) AS v, raw_text FROM blocks) WHERE contains(lower(raw_text), 'license') AND v <> ''""")


def d5(s, d):
    b = a.blocks(s, d)
    docs = table(s, d, "documents").select("doc_id")
    return x.cascade(docs, [x.regex_values(b, ["password"], r"password=([0-9a-f]+)", 0), x.regex_values(b, ["akia"], r"(AKIA[A-Z0-9]+)", 0)])


add("D5_cascade", d5, """WITH v AS (SELECT doc_id, 0 AS step, regexp_extract(raw_text, 'password=([0-9a-f]+)', 1) AS value FROM blocks UNION ALL SELECT doc_id, 1, regexp_extract(raw_text, '(AKIA[A-Z0-9]+)', 1) FROM blocks),
  g AS (SELECT doc_id, step, CASE WHEN count(DISTINCT value) = 1 THEN min(value) END AS value, row_number() OVER (PARTITION BY doc_id ORDER BY step) AS r FROM v WHERE value <> '' GROUP BY doc_id, step)
  SELECT d.doc_id, CAST(step AS INTEGER) AS step, value FROM documents d LEFT JOIN g ON g.doc_id = d.doc_id AND r = 1""")  # fmt: skip


def j36_whole(s, d):
    """Documents with a whole item, lines and all, from the beginning of a word on."""
    docs, items = table(s, d, "documents").filter("text is not null").select("doc_id", "text"), table(s, d, "benchmark").filter("text <> ''").select("item_id", F.col("text").alias("quote"))
    words = lambda c: F.split(c, "[ \n]", -1)
    four = lambda w, i: F.concat_ws(" ", F.slice(w, i, 4))
    n = F.size(words("quote"))
    keyed = items.filter(n > 4).select("item_id", "quote", four(words("quote"), 1).alias("start"))
    starts = docs.select("doc_id", words("text").alias("w")).filter(F.size("w") > 4).select("doc_id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - 3), lambda i: four(F.col("w"), i)))).alias("start"))
    held = lambda before: F.concat(F.lit(before), "text").contains(F.concat(F.lit(before), "quote"))
    found = starts.join(keyed, "start").drop("start").join(docs, "doc_id").filter(held(" ") | held("\n"))
    short = docs.join(F.broadcast(items.filter(n <= 4)), held(" ") | held("\n"))  # their fourth word may go on in the document
    return found.select("item_id", "doc_id").union(short.select("item_id", "doc_id")).distinct()


add("J36_cited_quotes", j36_whole, "SELECT DISTINCT item_id, doc_id FROM benchmark b JOIN documents d ON b.text <> '' AND (contains(' ' || d.text, ' ' || b.text) OR contains(chr(10) || d.text, chr(10) || b.text))")

# evaluation
_T = "object_id, section, expected_violation AS e, predicted_violation AND NOT abstained AS p, abstained AS ab"


def a26(s, d):
    t = a.truth(s, d).select(F.col("section"), F.col("expected_violation").alias("expected"), F.col("predicted_violation").alias("predicted"), "abstained")
    r = lambda c: F.round(c, 9).alias(c)
    return m.confusion(t, "section").select("section", "tp", "fp", "fn", "tn", "abstained", "n", r("precision"), r("recall"), r("f1"), r("fpr"), r("coverage"))


add("A26_confusion", a26, f"""WITH t AS (SELECT {_T} FROM truth), c AS (SELECT section, count(*) FILTER (e AND p) AS tp, count(*) FILTER (NOT e AND p) AS fp, count(*) FILTER (e AND NOT p) AS fn, count(*) FILTER (NOT e AND NOT p) AS tn, count(*) FILTER (ab) AS abstained, count(*) AS n FROM t GROUP BY 1)
  SELECT *, round(tp / nullif(tp + fp, 0), 9) AS precision, round(tp / nullif(tp + fn, 0), 9) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 9) AS f1, round(fp / nullif(fp + tn, 0), 9) AS fpr, round((n - abstained) / n, 9) AS coverage FROM c""")  # fmt: skip


def _lines(s, d):
    """Every line of every document and what a reader made of it: without its first two characters, and with rn and en misread."""
    e = table(s, d, "documents").filter("text is not null").select("lang", F.explode(F.split("text", "\n", -1)).alias("e"))
    return e.withColumn("x", F.regexp_replace(F.regexp_replace(F.expr("substring(e, 3)"), "rn", "m"), "en", "cn"))


def a24(s, d):
    return m.character_errors(_lines(s, d), "e", "x", "lang").select("lang", "errors", "chars", F.round("cer", 9).alias("cer"))


def a24_words(s, d):
    return m.word_errors(_lines(s, d), "e", "x", "lang").select("lang", "errors", "words", F.round("wer", 9).alias("wer"))


add("A24_character_errors", a24)  # the other engine's distance counts bytes, not characters; see tests/test_operators.py
add("A24_word_errors", a24_words)
add("A25_field_match", lambda s, d: a.truth(s, d).groupBy("section").agg(F.round(F.avg((F.col("expected_violation") == F.col("predicted_violation")).cast("int")), 9).alias("exact"), F.count("*").alias("n")), "SELECT section, round(avg(CASE WHEN expected_violation = predicted_violation THEN 1 ELSE 0 END), 9) AS exact, count(*) AS n FROM truth GROUP BY 1")


def a27(s, d):
    per = a.truth(s, d).select(F.col("section").alias("object_id"), (F.col("expected_violation") == F.col("predicted_violation")).cast("int").alias("hit")).groupBy("object_id").agg(F.sum("hit").alias("hits"), F.count("*").alias("n"))
    return m.bootstrap(per, "object_id", lambda k: F.try_divide(F.sum(F.col("hits") * k), F.sum(F.col("n") * k)))


_A27 = """WITH RECURSIVE per AS MATERIALIZED (SELECT section, count(*) FILTER (expected_violation = predicted_violation) AS hits, count(*) AS n, row_number() OVER (ORDER BY section) - 1 AS place FROM truth GROUP BY 1),
  c AS MATERIALIZED (SELECT count(*) AS objects FROM per),
  g AS (SELECT CAST(0 AS BIGINT) AS i, CAST(20260927 AS BIGINT) AS state UNION ALL SELECT i + 1, (1664525 * state + 1013904223) % 4294967296 FROM g, c WHERE i < 2000 * objects),
  x AS (SELECT (i - 1) // objects AS round, sum(hits) / sum(n) AS x FROM g, c JOIN per ON place = CAST(floor(state / 4294967296.0 * objects) AS BIGINT) WHERE i > 0 GROUP BY 1),
  r AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS r FROM x)
  SELECT max(objects) AS objects, count(*) AS valid, max(x) FILTER (r = 49) AS low, max(x) FILTER (r = 1950) AS high, CAST(NULL AS VARCHAR) AS reason FROM r, c"""
add("A27_bootstrap", a27, _A27)


def j33(s, d):
    t = table(s, d, "labels").select(F.col("doc_id").alias("object_id"), "quality")
    pred = table(s, d, "documents").filter("n_chars < 1000").select(F.col("doc_id").alias("object_id"), "n_chars")
    return t.join(pred, "object_id", "full_outer").select("object_id", F.when(F.col("quality").isNull(), "unmatched_prediction").when(F.col("n_chars").isNull(), "unmatched_truth").otherwise("matched").alias("kind"))


add("J33_truth_predictions", j33, "SELECT object_id, CASE WHEN quality IS NULL THEN 'unmatched_prediction' WHEN n_chars IS NULL THEN 'unmatched_truth' ELSE 'matched' END AS kind FROM (SELECT doc_id AS object_id, quality FROM labels) FULL JOIN (SELECT doc_id AS object_id, n_chars FROM documents WHERE n_chars < 1000) USING (object_id)")


def j34(s, d):
    h = table(s, d, "documents").select(F.md5("text").alias("h"), "source")
    return h.groupBy("h").agg(F.countDistinct("source").alias("n")).filter("n > 1")


add("J34_split_collisions", j34, "SELECT md5(text) AS h, count(DISTINCT source) AS n FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1")


def j35(s, d):
    checks = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    parts = table(s, d, "part").filter("p_size > 3").select(F.col("p_partkey").alias("l_partkey"), F.lit(True).alias("code_known"))
    files = table(s, d, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"), F.lit(True).alias("file_known"))
    both = checks.join(parts, "l_partkey", "left").join(files, "l_suppkey", "left")
    return both.select("l_orderkey", "l_linenumber", F.concat_ws(",", F.when(F.col("code_known").isNull(), "unknown_code"), F.when(F.col("file_known").isNull(), "unknown_file")).alias("errors"))


add("J35_submission_checks", j35, "SELECT l_orderkey, l_linenumber, concat_ws(',', CASE WHEN p_partkey IS NULL THEN 'unknown_code' END, CASE WHEN s_suppkey IS NULL THEN 'unknown_file' END) AS errors FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_size > 3 LEFT JOIN supplier ON s_suppkey = l_suppkey AND s_acctbal > 0")


def j32(s, d):
    e = table(s, d, "events").select("event_id", "user_id", F.get_json_object("props", "$.k").cast("long").alias("request"))
    r = table(s, d, "customer").select(F.col("c_custkey").alias("request"), "c_name")
    return e.join(r, "request", "left").select("event_id", "request", "c_name")


add("J32_receipts", j32, "SELECT event_id, request, c_name FROM (SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS request FROM events) LEFT JOIN customer ON c_custkey = request")


def boxes(s, d):
    li = table(s, d, "lineitem")
    x0, y0 = F.col("l_discount") * 5, F.col("l_tax") * 8
    return li.select(F.col("l_suppkey").alias("page"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").alias("part"), F.col("l_linestatus").alias("status"), x0.alias("x0"), y0.alias("y0"), (x0 + F.col("l_quantity") / 100).alias("x1"), (y0 + 0.2).alias("y1"))


def _near(s, d, numbered: bool = False):
    """Pairs of an expected and an actual box of a page with an IoU of 0.5; numbered ones have their places on the page as n and m."""
    corners = ("x0", "y0", "x1", "y1")
    all_ = boxes(s, d).select("page", "status", "id", *corners)
    if numbered:
        all_ = all_.withColumn("n", F.dense_rank().over(Window.partitionBy("page").orderBy("id", *corners)))
    actual = all_.filter("status = 'O'").select("page", F.col("id").alias("other"), *[F.col(c).alias(f"o{c}") for c in corners], *([F.col("n").alias("m")] if numbered else []))
    return m.iou_pairs(all_.filter("status = 'F'").drop("status"), actual, "page", 0.5)


def j23(s, d):
    return _near(s, d).select("page", "id", "other", F.round("iou", 6).alias("iou"))


def j23_matched(s, d):
    """The pairs of _near, matched one to one."""
    # ids repeat, so boxes are numbered; before they are paired, as there are more pairs
    pairs = _near(s, d, numbered=True)
    return m.first_fit(pairs.select("page", "id", "other", "n", "m", "iou"), "page").select("page", "id", "other", F.round("iou", 6).alias("iou"))


_BOX = "SELECT l_suppkey AS page, l_orderkey * 10 + l_linenumber AS id, l_discount * 5 AS x0, l_tax * 8 AS y0, l_discount * 5 + l_quantity / 100 AS x1, l_tax * 8 + 0.2 AS y1, l_linestatus AS status FROM lineitem"
add("J23_iou_join", j23, f"""WITH b AS ({_BOX}), p AS (SELECT a.page, a.id, o.id AS other, greatest(least(a.x1, o.x1) - greatest(a.x0, o.x0), 0) * greatest(least(a.y1, o.y1) - greatest(a.y0, o.y0), 0) AS i, (a.x1 - a.x0) * (a.y1 - a.y0) + (o.x1 - o.x0) * (o.y1 - o.y0) AS u
  FROM b a JOIN b o USING (page) WHERE a.status = 'F' AND o.status = 'O') SELECT page, id, other, round(i / (u - i), 6) AS iou FROM p WHERE i / (u - i) >= 0.5""")  # fmt: skip
add("J23_one_to_one", j23_matched)
add("A32_union_area", lambda s, d: m.union_area(boxes(s, d).withColumn("order_id", F.expr("id div 10")).select("order_id", "x0", "y0", "x1", "y1"), "order_id"))
add("W9_chunks", lambda s, d: m.packed(a.blocks(s, d).select("doc_id", "block_order", F.octet_length("raw_text").alias("size")), "doc_id", "block_order", "size", 600))
add("W11_admission", lambda s, d: m.admitted(a.blocks(s, d).select("doc_id", "block_order", F.octet_length("raw_text").alias("size")), "doc_id", "block_order", "size", 600))
add("D19_titles", lambda s, d: k.title_candidates(a.blocks(s, d)))
add("F8_fields", lambda s, d: k.fields(a.blocks(s, d)))
add("W6_list_items", lambda s, d: k.list_items(a.blocks(s, d)))
