"""Queries over exact decimals: F13, F16-F18 and D13."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from docengine.functions import exact as x
from docengine.operators import exact as e
from docengine.session import table

Q: dict = {}
SQL: dict = {}

_SHOWN = "CASE WHEN contains(CAST({0} AS VARCHAR), '.') THEN rtrim(rtrim(CAST({0} AS VARCHAR), '0'), '.') ELSE CAST({0} AS VARCHAR) END"


def _cents(li):
    """Each line's price as a text, negative on even lines."""
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    return li.withColumn("price", F.when(F.col("l_linenumber") % 2 == 0, -price).otherwise(price).cast("string"))


def f16(s, d):
    li = _cents(table(s, d, "lineitem")).select("l_orderkey", "l_linenumber", x.number(F.col("price")).alias("a"), x.number(F.col("l_quantity").cast("decimal(18,2)").cast("string")).alias("b"), (F.col("l_linenumber") - 4).alias("k"))
    out = {"total": x.add(F.col("a"), F.col("b")), "part": x.product(F.col("a"), "0.0625"), "moved": x.shifted(F.col("a"), F.col("k")), "half_even": x.rounded(F.col("a"), 1, "half_even")}
    return li.select("l_orderkey", "l_linenumber", *[x.text(c).alias(n) for n, c in out.items()], (F.col("a") < F.col("b")).alias("less"))


Q["F16_decimal_arithmetic"] = f16
SQL["F16_decimal_arithmetic"] = f"""WITH v AS (SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_linenumber % 2 = 0 THEN -l_extendedprice ELSE l_extendedprice END AS DECIMAL(18,2)) AS a, CAST(l_quantity AS DECIMAL(18,2)) AS b, CAST(l_linenumber AS INTEGER) - 4 AS k FROM lineitem),
  w AS (SELECT *, CAST(a * 100 AS BIGINT) AS c FROM v),
  u AS (SELECT l_orderkey, l_linenumber, a + b AS total, CAST(a AS DECIMAL(18,6)) * CAST(0.0625 AS DECIMAL(5,4)) AS part,
    CASE WHEN k >= 0 THEN CAST(a AS DECIMAL(30,8)) * CAST(power(10, greatest(k, 0)) AS BIGINT) ELSE CAST(c AS DECIMAL(30,0)) * CAST(power(10, 3 + k) AS BIGINT) * CAST(0.00001 AS DECIMAL(6,5)) END AS moved,
    CAST(sign(c) * (abs(c) // 10 + CASE WHEN abs(c) % 10 > 5 OR (abs(c) % 10 = 5 AND (abs(c) // 10) % 2 = 1) THEN 1 ELSE 0 END) AS DECIMAL(18,0)) * CAST(0.1 AS DECIMAL(2,1)) AS half_even, a < b AS less FROM w)
  SELECT l_orderkey, l_linenumber, {", ".join(f"{_SHOWN.format(n)} AS {n}" for n in ("total", "part", "moved", "half_even"))}, less FROM u"""


def f16_wide(s, d):
    """Numbers far beyond 38 digits: price * 10^30 + 10^-30 and its product with 80 digits' worth of a factor."""
    li = _cents(table(s, d, "lineitem")).select("l_orderkey", "l_linenumber", x.number(F.col("price")).alias("a"))
    li = li.withColumn("wide", x.add(x.shifted(F.col("a"), F.lit(30)), x.literal("1e-30")))
    return li.select("l_orderkey", "l_linenumber", x.text(F.col("wide")).alias("wide"), x.text(x.product(F.col("wide"), "98765432109876543210987654321.0123456789")).alias("product"), x.text(x.rounded(F.col("wide"), 29, "half_up")).alias("rounded"))


Q["F16_beyond_38_digits"] = f16_wide  # the other engine's decimals end at 38 digits


def f17(s, d):
    li = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.col("l_quantity").cast("decimal(18,1)").cast("string"), F.when(F.col("l_linenumber") < 7, F.concat(F.lit("e"), (F.col("l_linenumber") - 4).cast("string"))).otherwise("e31")).alias("literal"))
    return li.select("*", x.text(x.scientific(F.col("literal"))).alias("shown"))


Q["F17_exponents"] = f17
SQL["F17_exponents"] = f"""SELECT l_orderkey, l_linenumber, literal, CASE WHEN l_linenumber < 7 THEN {_SHOWN.format("v")} END AS shown FROM (
  SELECT l_orderkey, l_linenumber, CAST(CAST(l_quantity AS DECIMAL(18,1)) AS VARCHAR) || CASE WHEN l_linenumber < 7 THEN 'e' || CAST(l_linenumber - 4 AS VARCHAR) ELSE 'e31' END AS literal,
    CAST(CAST(l_quantity AS BIGINT) * CAST(power(10, least(l_linenumber, 6) - 1) AS BIGINT) AS DECIMAL(30,0)) * CAST(0.001 AS DECIMAL(4,3)) AS v FROM lineitem)"""


def f18(s, d):
    li = _cents(table(s, d, "lineitem")).select("l_orderkey", "l_linenumber", x.number(F.col("price")).alias("a"), x.number(F.col("l_quantity").cast("decimal(18,2)").cast("string")).alias("b"))
    li = li.withColumns({"low": x.subtract(F.col("b"), x.literal("10")), "high": x.add(F.col("b"), x.literal("10"))})
    least, most = e.absolute_range(F.col("low"), F.col("high"))
    delta = x.subtract(F.col("a"), F.col("b"))
    return li.select("l_orderkey", "l_linenumber", x.text(least).alias("least"), x.text(most).alias("most"), x.text(x.shifted(x.absolute(delta), F.lit(2))).alias("numerator"), x.text(x.absolute(F.col("b"))).alias("denominator"))


Q["F18_intervals"] = f18
SQL["F18_intervals"] = f"""WITH v AS (SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_linenumber % 2 = 0 THEN -l_extendedprice ELSE l_extendedprice END AS DECIMAL(18,2)) AS a, CAST(l_quantity AS DECIMAL(18,2)) AS b FROM lineitem),
  u AS (SELECT l_orderkey, l_linenumber, CASE WHEN b <= 10 THEN CAST(0 AS DECIMAL(18,2)) ELSE b - 10 END AS least, greatest(abs(b - 10), b + 10) AS most, abs(a - b) * 100 AS numerator, abs(b) AS denominator FROM v)
  SELECT l_orderkey, l_linenumber, {", ".join(f"{_SHOWN.format(n)} AS {n}" for n in ("least", "most", "numerator", "denominator"))} FROM u"""

_SPELLINGS = ["мм", " См ", "M", "км", "п. м", "кв. м", "cm²", "мм3", "куб м", "г", "кг", "Т", "в", "KV", "шт.", "1", "процентов", "furlong", ""]
_UNITS = [("mm", "length", -3), ("cm", "length", -2), ("m", "length", 0), ("km", "length", 3), ("m", "length", 0), ("m2", "area", 0), ("cm2", "area", -4), ("mm3", "volume", -9), ("m3", "volume", 0), ("g", "mass", -3), ("kg", "mass", 0), ("t", "mass", 3), ("V", "voltage", 0), ("kV", "voltage", 3), ("pcs", "count", 0), ("1", "ratio", 0), ("%", "ratio", -2), None, None]


def f13(s, d):
    spelled = F.element_at(F.array(*map(F.lit, _SPELLINGS)), (F.col("l_partkey") % len(_SPELLINGS) + 1).cast("int"))
    li = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", e.unit(spelled).alias("u"))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "u.canonical", "u.dimension", F.col("u.exponent").cast("int").alias("exponent"))


def _list(at: int) -> str:
    return "([" + ", ".join("NULL" if u is None else repr(u[at]) for u in _UNITS) + f"])[l_partkey % {len(_UNITS)} + 1]"


Q["F13_unit_definitions"] = f13
SQL["F13_unit_definitions"] = f"SELECT l_orderkey, l_linenumber, l_partkey, {_list(0)} AS canonical, {_list(1)} AS dimension, CAST({_list(2)} AS INTEGER) AS exponent FROM lineitem"

_SPEC = e.ExactSpec("numeric_delta", e.Policy("m", rounding=(1, "half_up")), tolerance_abs="10", tolerance_pct="5", inclusive=True)
_NAMES = ("value", "decimal", "source", "raw", "stated", "lower", "upper")


def measured(s, d):
    """Lines and their parts as measured pairs: what the part costs in metres, what the line says in one of four units, some with an uncertainty."""
    joined = table(s, d, "lineitem").join(table(s, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    n = F.col("l_linenumber")
    factor = F.element_at(F.array(*[F.lit(Decimal(f)).cast("decimal(7,3)") for f in ("1000", "100", "1", "0.001")]), (F.pmod(n, F.lit(4)) + 1).cast("int"))
    price = F.col("p_retailprice").cast("decimal(18,2)")
    actual = (F.col("l_extendedprice").cast("decimal(18,2)") - price * (F.col("l_quantity").cast("int") - 1)).cast("decimal(30,2)")
    df = joined.select(F.col("l_orderkey").alias("order_id"), n.alias("line"), price.alias("e"), (actual * factor).alias("a"), (F.col("l_tax") > 0.04).alias("uncertain"))
    none = F.lit(None).cast("string")
    half = F.lit(Decimal("0.5"))
    shown = lambda c: F.regexp_replace(c.cast("string"), r"[.]0+$|([.][0-9]*[1-9])0+$", "$1")
    sides = {"x_decimal": shown(F.col("e")), "x_source": F.lit("value"), "x_raw": F.lit("м"), "x_stated": F.lit("m"), "x_lower": none, "x_upper": none}
    sides |= {"y_decimal": shown(F.col("a")), "y_source": F.when(F.col("line") == 7, "missing").otherwise("row"), "y_raw": F.when(F.col("line") != 7, F.element_at(F.array(*map(F.lit, ("мм", "см", "м", "km"))), (F.pmod("line", F.lit(4)) + 1).cast("int"))), "y_stated": none}
    sides |= {"y_lower": F.when(F.col("uncertain"), shown(F.col("a") - half)), "y_upper": F.when(F.col("uncertain"), shown(F.col("a") + half))}
    return df.select("order_id", "line", *[c.alias(k) for k, c in sides.items()]).withColumns({"x_value": F.col("x_decimal"), "y_value": F.col("y_decimal")})


def d13(s, d):
    expected, actual = (e.Side(**{n: f"{p}_{n}" for n in _NAMES}) for p in "xy")
    out = e.compared(measured(s, d), _SPEC, expected, actual)
    return out.select("order_id", "line", "result", "detail", "delta", "relative_numerator", "relative_denominator", "bound_lower", "bound_upper", "actual_converted")


Q["D13_exact_comparison"] = d13
SQL["D13_exact_comparison"] = f"""WITH v AS (
    SELECT l_orderkey AS order_id, l_linenumber AS line, CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS DECIMAL(22,6)) AS e0, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) - CAST(p_retailprice AS DECIMAL(18,2)) * (CAST(l_quantity AS INTEGER) - 1) AS DECIMAL(22,6)) AS a0,
      CASE WHEN l_tax > 0.04 THEN CAST(([0.0005, 0.005, 0.5, 500])[l_linenumber % 4 + 1] AS DECIMAL(22,6)) ELSE CAST(0 AS DECIMAL(22,6)) END AS h FROM lineitem JOIN part ON p_partkey = l_partkey),
  r AS (SELECT order_id, line, line <> 7 AS known, a0, CAST(round(e0, 1) AS DECIMAL(22,6)) AS e, CAST(round(a0, 1) AS DECIMAL(22,6)) AS a, CAST(round(a0 - h, 1) AS DECIMAL(22,6)) AS al, CAST(round(a0 + h, 1) AS DECIMAL(22,6)) AS au FROM v),
  b AS (SELECT *, a - e AS delta, abs(a - e) * 100 AS rn, abs(e) AS rd, greatest(CAST(10 AS DECIMAL(26,8)), abs(e) * CAST(0.05 AS DECIMAL(3,2))) AS bound,
    CASE WHEN al <= e AND au >= e THEN CAST(0 AS DECIMAL(22,6)) ELSE least(abs(al - e), abs(au - e)) END AS near, greatest(abs(al - e), abs(au - e)) AS far FROM r)
  SELECT order_id, line, CASE WHEN NOT known THEN 'not_comparable' WHEN far <= bound THEN 'match' WHEN near > bound THEN 'mismatch' ELSE 'not_comparable' END AS result,
    CASE WHEN NOT known THEN 'unit_missing' WHEN NOT (far <= bound) AND NOT (near > bound) THEN 'uncertainty_crosses_boundary' END AS detail,
    {", ".join(f"CASE WHEN known THEN {_SHOWN.format(c)} END AS {n}" for c, n in (("delta", "delta"), ("rn", "relative_numerator"), ("rd", "relative_denominator"), ("bound", "bound_lower"), ("bound", "bound_upper"), ("a0", "actual_converted")))} FROM b"""
