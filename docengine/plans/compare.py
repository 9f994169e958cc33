"""Queries over compared values: A13-A17, D9-D16, F functions and P predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from docengine import adapters as a
from docengine.functions import text as t
from docengine.operators import compare as c
from docengine.session import table

Q: dict = {}
SQL: dict = {}


def _pair_query(name: str, spec: c.Spec, holds: str, delta: str = "actual - expected") -> None:
    def run(s, d):
        cols = c.pair_columns(spec, F.col("expected"), F.col("actual"), F.col("expected_unit"), F.col("actual_unit"))
        return a.pairs(s, d).select("group_id", cols["result"].alias("result"), F.round(cols["delta"], 4).alias("delta"), F.round(cols["delta_pct"], 4).alias("delta_pct"), cols["detail"].alias("detail"))

    percent = "CAST(NULL AS DOUBLE)" if spec.kind == "equals" else "CASE WHEN open AND abs(expected) > 1e-9 THEN round(abs(actual - expected) / abs(expected) * 100, 4) END"
    Q[name] = run
    SQL[name] = a.with_views(f"""SELECT group_id, CASE WHEN NOT open THEN 'not_comparable' WHEN {holds} THEN 'match' ELSE 'mismatch' END AS result, CASE WHEN open THEN round({delta}, 4) END AS delta, {percent} AS delta_pct,
      CASE WHEN NOT open THEN 'unit_mismatch' WHEN (expected_unit IS NULL) <> (actual_unit IS NULL) THEN 'unit_missing' END AS detail
      FROM (SELECT *, NOT coalesce(expected_unit <> actual_unit, false) AS open FROM pairs)""")


_pair_query("D9_equals", c.Spec("equals"), "abs(actual - expected) <= 1e-9", "abs(actual - expected)")
_pair_query("D10_numeric_delta", c.Spec("numeric_delta", tolerance_abs=100, tolerance_pct=40), "abs(actual - expected) <= greatest(100, 0.4 * abs(expected)) + 1e-9")
_pair_query("D11_no_decrease", c.Spec("no_decrease"), "actual >= expected - 1e-9")
_pair_query("D11_no_increase", c.Spec("no_increase"), "actual <= expected + 1e-9")

_SIDES = """used AS (SELECT * FROM members WHERE status = 'extracted' AND value IS NOT NULL),
  vals AS (SELECT group_id, role, value, greatest(count(DISTINCT unit), 1) AS k, min(extraction_id) AS first, arg_min(unit, extraction_id * 1000 + ascii(unit)) FILTER (unit IS NOT NULL) AS unit FROM used GROUP BY ALL),
  d AS (SELECT group_id, role, CAST(sum(k) AS BIGINT) AS n, arg_min(value, first * 1000 + value) AS value, arg_min_null(unit, first * 1000 + value) AS unit FROM vals GROUP BY ALL),
  s AS (SELECT g.group_id, coalesce(e.n, 0) AS ne, coalesce(x.n, 0) AS na, e.value AS ev, x.value AS av, e.unit AS eu, x.unit AS au FROM (SELECT DISTINCT group_id FROM members) g
    LEFT JOIN d e ON e.group_id = g.group_id AND e.role = 'expected' LEFT JOIN d x ON x.group_id = g.group_id AND x.role = 'actual')"""
_SETTLED = "WHEN ne > 1 THEN 'expected_ambiguous' WHEN ne = 0 THEN 'expected_missing' WHEN na > 1 THEN 'actual_ambiguous' WHEN na = 0 THEN 'actual_missing'"


def a13(s, d):
    return c.distinct_values(a.members(s, d)).select("group_id", "role", "n_buckets", "value", "unit")


Q["A13_unit_adoption"] = a13
SQL["A13_unit_adoption"] = a.with_views(f"WITH {_SIDES} SELECT group_id, role, n AS n_buckets, value, unit FROM d, (SELECT 1 FROM members LIMIT 1)")


def a14(s, d):
    return c.sides(a.members(s, d)).select("group_id", c.outcome(F.col("n_expected")).alias("expected"), c.outcome(F.col("n_actual")).alias("actual"))


Q["A14_outcomes"] = a14
_OUT = "CASE WHEN {0} = 0 THEN 'no_evidence' WHEN {0} = 1 THEN 'extracted' ELSE 'ambiguous' END"
SQL["A14_outcomes"] = a.with_views(f"WITH {_SIDES} SELECT group_id, {_OUT.format('ne')} AS expected, {_OUT.format('na')} AS actual FROM s, (SELECT 1 FROM members LIMIT 1)")


def d15(s, d):
    return c.group_verdict(a.members(s, d), c.Spec("numeric_delta", tolerance_abs=10))


Q["D15_group_verdict"] = d15
SQL["D15_group_verdict"] = a.with_views(f"""WITH {_SIDES} SELECT group_id, CASE {_SETTLED} WHEN coalesce(eu <> au, false) THEN 'not_comparable' WHEN abs(av - ev) <= 10 + 1e-9 THEN 'match' ELSE 'discrepancy' END AS status,
  CASE WHEN ne = 1 AND na = 1 THEN CASE WHEN eu <> au THEN 'unit_mismatch' WHEN (eu IS NULL) <> (au IS NULL) THEN 'unit_missing' END END AS detail FROM s, (SELECT 1 FROM members LIMIT 1)""")


def d12(s, d):
    return c.group_verdict(a.members(s, d), c.Spec("threshold", min=5, max=40))


Q["D12_threshold"] = d12
SQL["D12_threshold"] = a.with_views(f"""WITH {_SIDES} SELECT group_id, CASE {_SETTLED} WHEN ev < 5 - 1e-9 OR av < 5 - 1e-9 OR ev > 40 + 1e-9 OR av > 40 + 1e-9 THEN 'discrepancy' ELSE 'match' END AS status,
  CASE WHEN ne = 1 AND na = 1 THEN CASE WHEN ev < 5 - 1e-9 THEN 'below_min:5' WHEN ev > 40 + 1e-9 THEN 'above_max:40' WHEN av < 5 - 1e-9 THEN 'below_min:5' WHEN av > 40 + 1e-9 THEN 'above_max:40' END END AS detail FROM s, (SELECT 1 FROM members LIMIT 1)""")


def _results(s, d):
    cols = c.pair_columns(c.Spec("numeric_delta", tolerance_pct=60), F.col("expected"), F.col("actual"), F.col("expected_unit"), F.col("actual_unit"))
    return a.pairs(s, d).select(F.expr("group_id div 10").alias("order_id"), "group_id", cols["result"].alias("result"))


_RESULTS = """r AS (SELECT group_id // 10 AS order_id, group_id, CASE WHEN coalesce(expected_unit <> actual_unit, false) THEN 'not_comparable' WHEN abs(actual - expected) <= 0.6 * abs(expected) + 1e-9 THEN 'match' ELSE 'mismatch' END AS result FROM pairs)"""


def a15(s, d):
    return _results(s, d).groupBy("order_id").agg(c.rollup(F.col("result")).alias("status"))


Q["A15_rollup"] = a15
SQL["A15_rollup"] = a.with_views(f"WITH {_RESULTS} SELECT order_id, CASE WHEN bool_or(result = 'mismatch') THEN 'discrepancy' WHEN bool_and(result = 'match') THEN 'match' ELSE 'not_comparable' END AS status FROM r, (SELECT 1 FROM pairs LIMIT 1) GROUP BY order_id")

_TRUTH = "CASE result WHEN 'match' THEN true WHEN 'mismatch' THEN false END"


def a16(s, d):
    v = _results(s, d).withColumn("v", F.when(F.col("result") == "match", True).when(F.col("result") == "mismatch", False))
    return v.groupBy("order_id").agg(c.kleene(F.col("v"), "and").alias("all_of"), c.kleene(F.col("v"), "or").alias("any_of"))


Q["A16_kleene"] = a16
SQL["A16_kleene"] = a.with_views(f"""WITH {_RESULTS}, v AS (SELECT order_id, {_TRUTH} AS v FROM r, (SELECT 1 FROM pairs LIMIT 1)) SELECT order_id,
  CASE WHEN bool_or(NOT v) THEN false WHEN count(*) = count(v) THEN true END AS all_of, CASE WHEN bool_or(v) THEN true WHEN count(*) = count(v) THEN false END AS any_of FROM v GROUP BY order_id""")


def a17(s, d):
    v = _results(s, d).withColumn("v", F.when(F.col("result") == "match", True).when(F.col("result") == "mismatch", False))
    return c.determining(v, "order_id", "v", "and").select("order_id", "group_id", "node")


Q["A17_determining"] = a17
SQL["A17_determining"] = a.with_views(f"""WITH {_RESULTS}, v AS (SELECT order_id, group_id, {_TRUTH} AS v FROM r, (SELECT 1 FROM pairs LIMIT 1)), n AS (SELECT order_id, CASE WHEN bool_or(NOT v) THEN false WHEN count(*) = count(v) THEN true END AS node FROM v GROUP BY 1)
  SELECT order_id, group_id, node FROM v JOIN n USING (order_id) WHERE node IS NOT DISTINCT FROM v""")


def d16(s, d):
    tree = c.Tree("and", children=(c.Tree(leaf="p"), c.Tree("or", children=(c.Tree(leaf="q"), c.Tree(leaf="r")))))
    tree.check()
    li = table(s, d, "lineitem")
    leaves = li.select("l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") != "N", F.col("l_quantity") > 20).alias("p"), F.when(F.col("l_linestatus") == "O", F.col("l_tax") > 0.04).alias("q"), (F.col("l_discount") > 0.05).alias("r"))
    return leaves.select("l_orderkey", "l_linenumber", tree.column().alias("truth"))


Q["D16_tree"] = d16
SQL["D16_tree"] = "SELECT l_orderkey, l_linenumber, (CASE WHEN l_returnflag <> 'N' THEN l_quantity > 20 END) AND ((CASE WHEN l_linestatus = 'O' THEN l_tax > 0.04 END) OR l_discount > 0.05) AS truth FROM lineitem"


def d13(s, d):
    dec = lambda x: x.cast("decimal(18,4)")
    p = a.pairs(s, d)
    e, x = dec(F.col("expected")), dec(F.col("actual"))
    half = F.lit("0.5").cast("decimal(18,4)")
    v = c.exact_interval(e - half, e + half, x - half, x + half, F.lit("150").cast("decimal(18,4)"))
    return p.select("group_id", F.when(v.isNull(), "not_comparable").when(v, "match").otherwise("mismatch").alias("result"))


Q["D13_exact_interval"] = d13
SQL["D13_exact_interval"] = a.with_views("""SELECT group_id, CASE WHEN x - e - 1 >= -150 AND x - e + 1 <= 150 THEN 'match' WHEN x - e - 1 > 150 OR x - e + 1 < -150 THEN 'mismatch' ELSE 'not_comparable' END AS result
  FROM (SELECT group_id, CAST(expected AS DECIMAL(18,4)) AS e, CAST(actual AS DECIMAL(18,4)) AS x FROM pairs)""")


def d14(s, d):
    ranks = {"1-URGENT": 5, "2-HIGH": 4, "3-MEDIUM": 3, "4-NOT SPECIFIED": 2}
    o = table(s, d, "orders")
    return o.select("o_orderkey", c.ordered_category(F.lit("3-MEDIUM"), F.col("o_orderpriority"), ranks).alias("result"))


Q["D14_ordered_category"] = d14
SQL["D14_ordered_category"] = """SELECT o_orderkey, CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED') THEN 'not_comparable' WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 'match' ELSE 'mismatch' END AS result FROM orders"""

_NORM = r"trim(regexp_replace(replace(lower({0}), 'ё', 'е'), '[\s\x{{00A0}}\x{{0085}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}\x{{1680}}]+', ' ', 'g'))"


def _blocks_query(name, columns, sql):
    Q[name] = lambda s, d: columns(a.blocks(s, d))
    SQL[name] = a.with_views(sql)


_blocks_query("F1_normalised", lambda b: b.select("doc_id", "block_order", t.normalised(F.col("raw_text")).alias("norm_text")), f"SELECT doc_id, block_order, {_NORM.format('raw_text')} AS norm_text FROM blocks")
_blocks_query("F4_item_key", lambda b: b.select("doc_id", "block_order", t.item_key(F.col("raw_text")).alias("k")), "SELECT doc_id, block_order, trim(regexp_replace(replace(lower(raw_text), 'ё', 'е'), '[^0-9a-zа-я]+', ' ', 'g')) AS k FROM blocks")
_blocks_query("F5_line_text", lambda b: b.select("doc_id", "block_order", t.line_text(F.col("raw_text")).alias("x")), r"SELECT doc_id, block_order, trim(regexp_replace(raw_text, '[ \t\x{00A0}]+', ' ', 'g')) AS x FROM blocks")
_blocks_query("F10_first_number", lambda b: b.select("doc_id", "block_order", t.first_number(F.col("raw_text")).alias("x")).filter("x is not null"), r"""SELECT doc_id, block_order, x FROM (SELECT doc_id, block_order, TRY_CAST(replace(regexp_replace(regexp_extract(raw_text, '-?[0-9][0-9 \t\n\r\x{00A0}\x{202F}]*(?:[.,][0-9]+)?'), '[ \t\n\r\x{00A0}\x{202F}]', '', 'g'), ',', '.') AS DOUBLE) AS x FROM blocks) WHERE x IS NOT NULL""")
_blocks_query("P2_effective_text", lambda b: b.select("doc_id", "block_order", t.effective_text(F.when(F.col("block_order") % 2 == 0, F.lower("raw_text")).otherwise(""), F.col("raw_text")).alias("x")), "SELECT doc_id, block_order, trim(coalesce(nullif(CASE WHEN block_order % 2 = 0 THEN lower(raw_text) ELSE '' END, ''), raw_text)) AS x FROM blocks")
_blocks_query("P4_term", lambda b: b.filter(t.contains_term(F.col("raw_text"), F.lit("Apache  License"))).select("doc_id", "block_order"), "SELECT doc_id, block_order FROM blocks WHERE contains(regexp_replace(lower(raw_text), '\\s+', ' ', 'g'), 'apache license')")
_blocks_query("F27_excerpt", lambda b: b.select("doc_id", "block_order", t.excerpt(F.col("raw_text"), "License", 20).alias("x")).filter("x is not null"), "SELECT doc_id, block_order, substring(raw_text, greatest(p - 20, 1), p - greatest(p - 20, 1) + 7 + 20) AS x FROM (SELECT *, strpos(lower(raw_text), 'license') AS p FROM blocks) WHERE p > 0")


def t8(s, d):
    b = a.blocks(s, d).withColumn("w", F.split("raw_text", " "))
    return b.select("doc_id", "block_order", t.locale_compare(F.element_at("w", 1), F.element_at("w", -1)).alias("x"))


Q["T8_locale_order"] = t8
SQL["T8_locale_order"] = a.with_views("SELECT doc_id, block_order, CAST(CASE WHEN x COLLATE en < y COLLATE en THEN -1 WHEN x COLLATE en > y COLLATE en THEN 1 ELSE 0 END AS INTEGER) AS x FROM (SELECT doc_id, block_order, string_split(raw_text, ' ')[1] AS x, string_split(raw_text, ' ')[-1] AS y FROM blocks)")


def f9(s, d):
    o = table(s, d, "orders")
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "dd.MM.yyyy")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.concat(F.lit("31.02."), F.date_format("o_orderdate", "yyyy")))
    return o.select("o_orderkey", t.calendar_date(raw).alias("day"))


Q["F9_dates"] = f9
SQL["F9_dates"] = "SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN CAST(o_orderdate AS DATE) END AS day FROM orders"


def f12(s, d):
    p = table(s, d, "part").withColumn("x", F.regexp_replace(F.format_number("p_retailprice", 2), ",", " "))
    raw = F.when(F.col("p_partkey") % 2 == 0, F.regexp_replace("x", r"\.", ",")).otherwise(F.concat("x", F.when(F.col("p_partkey") % 5 == 0, " kg").otherwise("")))
    return p.select("p_partkey", t.decimal_input(raw).alias("x"))


Q["F12_decimal_input"] = f12
SQL["F12_decimal_input"] = "SELECT p_partkey, CASE WHEN p_partkey % 2 = 1 AND p_partkey % 5 = 0 THEN NULL ELSE printf('%.2f', p_retailprice) END AS x FROM part"


def f13(s, d):
    spellings = ["м²", "кв. м", "КМ", "шт.", "пог.м", "кв", "furlong", " "]
    units = F.array(*[F.lit(x) for x in spellings])
    p = table(s, d, "part").select("p_partkey", F.element_at(units, (F.col("p_partkey") % 8 + 1).cast("int")).alias("raw"))
    return p.select("p_partkey", t.unit_name(F.col("raw")).alias("unit"))


Q["F13_units"] = f13
SQL["F13_units"] = "SELECT p_partkey, (['m2', 'm2', 'km', 'pcs', 'm', 'kV', 'furlong', NULL])[p_partkey % 8 + 1] AS unit FROM part"


def f16(s, d):
    x = F.col("l_extendedprice").cast("decimal(18,4)") * F.when(F.col("l_linenumber") % 2 == 0, -1).otherwise(1)
    x = (x / 8).cast("decimal(18,4)")
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", *[t.rounded(x, 2, m).cast("double").alias(m) for m in ("half_up", "half_even", "toward_zero")])


Q["F16_rounding"] = f16  # the other engine rounds the quotient by way of a double


def p7(s, d):
    f = F.col("o_orderpriority")
    group = F.when(f == "1-URGENT", "candidate").when(f == "2-HIGH", "confirmed").when(f == "3-MEDIUM", "rejected").when(f == "4-NOT SPECIFIED", "not_applicable").otherwise("no_evidence")
    return table(s, d, "orders").groupBy(group.alias("status_group")).agg(F.count("*").alias("n"))


Q["P7_status_groups"] = p7
SQL["P7_status_groups"] = "SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'candidate' WHEN '2-HIGH' THEN 'confirmed' WHEN '3-MEDIUM' THEN 'rejected' WHEN '4-NOT SPECIFIED' THEN 'not_applicable' ELSE 'no_evidence' END AS status_group, count(*) AS n FROM orders GROUP BY 1"


def p8(s, d):
    k = F.lower("o_orderpriority")
    return table(s, d, "orders").select("o_orderkey", F.when(k.contains("urgent"), "high").when(k.contains("high") | k.contains("medium"), "medium").otherwise("low").alias("priority"))


Q["P8_priority"] = p8
SQL["P8_priority"] = "SELECT o_orderkey, CASE WHEN contains(lower(o_orderpriority), 'urgent') THEN 'high' WHEN contains(lower(o_orderpriority), 'high') OR contains(lower(o_orderpriority), 'medium') THEN 'medium' ELSE 'low' END AS priority FROM orders"
