"""Exact decimals against Python's integers."""

import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from docengine.functions import exact as x


def shown(v):
    """The shortest text of a fraction with a power of ten below."""
    sign, v = ("-" if v < 0 else ""), abs(v)
    digits = str(int(v * 10**90)).zfill(91)
    whole, rest = digits[:-90], digits[-90:].rstrip("0")
    return sign + whole + ("." + rest if rest else "")


def of(text):
    return Fraction(text)


def texts():
    r = random.Random(4)
    out = ["0", "-0", "+0.0", "1", "-1", "0.5", "-1.25", "1.25", "-1.35", "9007199254740993.1000000001", "9" * 80, "-" + "9" * 80, "0." + "0" * 29 + "1", "-" + "9" * 50 + "." + "9" * 30, "999999999.5", "0.999999999999999999", "00012.3400", "-0.000000005"]
    for _ in range(60):
        whole = "".join(r.choices("0123456789", k=r.choice([1, 3, 9, 10, 18, 27, 40])))
        fraction = "".join(r.choices("059", k=r.choice([0, 1, 2, 8, 9, 10, 18, 30])))
        out.append(r.choice(["", "-", "+"]) + whole + ("." + fraction if fraction else ""))
    return out


@pytest.fixture(scope="module")
def pairs(spark):
    t = texts()
    r = random.Random(5)
    rows = [(i, a, r.choice(t), r.randrange(-30, 31)) for i, a in enumerate(t)] + [(1000 + i, a, a, 0) for i, a in enumerate(t[:9])]
    return rows, spark.createDataFrame(rows, "i int, a string, b string, e int").select("*", x.number(F.col("a")).alias("x"), x.number(F.col("b")).alias("y")).cache()


def test_arithmetic(pairs):
    rows, df = pairs
    got = df.select("i", x.text(F.col("x")).alias("t"), x.text(x.add(F.col("x"), F.col("y"))).alias("sum"), x.text(x.subtract(F.col("x"), F.col("y"))).alias("diff"), x.text(x.absolute(F.col("x"))).alias("abs"), x.text(x.shifted(F.col("x"), F.col("e"))).alias("shift"), (F.col("x") < F.col("y")).alias("less"), F.col("x") == F.col("y"), x.text(F.greatest("x", "y")).alias("most"), x.places(F.col("x")).alias("places"))
    got = {r[0]: r[1:] for r in got.collect()}
    for i, a, b, e in rows:
        p, q = of(a), of(b)
        t = shown(p)
        assert got[i] == (t, shown(p + q), shown(p - q), shown(abs(p)), shown(p * Fraction(10) ** e), p < q, p == q, shown(max(p, q)), len(t.partition(".")[2])), (a, b, e)


@pytest.mark.parametrize("factor", ["0", "1", "-0.05", "5e-3", "123456789012345678901.5", "9" * 80])
def test_product(pairs, factor):
    rows, df = pairs
    got = {r[0]: r[1] for r in df.select("i", x.text(x.product(F.col("x"), factor))).collect()}
    whole, _, exponent = factor.partition("e")
    times = of(whole) * Fraction(10) ** int(exponent or 0)
    for i, a, _, _ in rows:
        assert got[i] == shown(of(a) * times), a


@pytest.mark.parametrize("mode", x.ROUNDINGS)
def test_rounding(pairs, mode):
    rows, df = pairs
    scales = (0, 1, 8, 9, 10, 17, 29, 30)
    got = {r[0]: r[1:] for r in df.select("i", *[x.text(x.rounded(F.col("x"), s, mode)) for s in scales]).collect()}
    for i, a, _, _ in rows:
        for s, t in zip(scales, got[i], strict=True):
            v = abs(of(a)) * 10**s
            n, rest = int(v), v - int(v)
            if mode != "toward_zero" and (rest > Fraction(1, 2) or rest == Fraction(1, 2) and (mode == "half_up" or n % 2)):
                n += 1
            assert t == shown(Fraction(n, 10**s) * (-1 if of(a) < 0 else 1)), (a, s)


def test_what_is_no_number(spark):
    bad = ["", " 1", "1.", ".5", "1e3", "1,5", "--1", "1" * 81, "0." + "1" * 31, "1\n", "٣", None]
    df = spark.createDataFrame([(t,) for t in bad], "a string")
    assert [r[0] for r in df.select(x.number(F.col("a")).isNull()).collect()] == [True] * len(bad)
    assert spark.range(1).select(x.text(x.shifted(x.literal("1"), F.lit(31))), x.text(x.product(x.literal("1e-30"), "0." + "0" * 29 + "1")), x.text(x.add(F.lit(None).cast("array<bigint>"), x.literal("1")))).first() == (None, "0." + "0" * 59 + "1", None)
    for t in ("x", "1" * 81, "1e31", "1.2.3"):
        with pytest.raises(ValueError):
            x.literal(t)
