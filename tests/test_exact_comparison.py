"""Exact comparison: its cases one by one, and random rows against Python's fractions."""

import random
from fractions import Fraction

import pytest

from docengine.operators import exact as e

M = e.Policy("m")
COLUMNS = ("value", "decimal", "source", "raw", "stated", "lower", "upper")
SCHEMA = "i int, " + ", ".join(f"{p}_{c} string" for p in "xy" for c in COLUMNS)
X, Y = (e.Side(**{c: f"{p}_{c}" for c in COLUMNS}) for p in "xy")


def side(point, unit="m", **more):
    if point is None:
        return dict.fromkeys(COLUMNS)
    return {"value": point, "decimal": point, "source": "missing" if unit is None else "value", "raw": unit, "stated": unit, "lower": None, "upper": None} | more


def run(spark, spec, *pairs):
    rows = [(i, *[a[c] for c in COLUMNS], *[b[c] for c in COLUMNS]) for i, (a, b) in enumerate(pairs)]
    return [r.asDict() for r in e.compared(spark.createDataFrame(rows, SCHEMA), spec, X, Y).orderBy("i").collect()]


def results(spark, spec, *pairs):
    return [(r["result"], r["detail"]) for r in run(spark, spec, *pairs)]


def test_digits_beyond_doubles(spark):
    spec = e.ExactSpec("numeric_delta", M, tolerance_abs="0.1", inclusive=True)
    big = "9007199254740993"
    got = run(spark, spec, (side(big), side(big + ".1")), (side(big), side(big + ".1000000001")))
    assert [r["result"] for r in got] == ["match", "mismatch"] and got[1]["delta"] == "0.1000000001"


def test_units(spark):
    spec = e.ExactSpec("equals", M)
    got = results(spark, spec, (side("1"), side("1000", "mm")), (side("1"), side("1", None)), (side("1"), side("1", "kg")), (side("1"), side("1", "unknown")), (side("1"), side("2", value="1")), (side("1"), side("1", stated="km")), (side("1"), side("1", " М ")), (side(None), side("1")))
    assert got == [("match", None), ("not_comparable", "unit_missing"), ("not_comparable", "unit_dimension_mismatch"), ("not_comparable", "numerical_unit_invalid"), ("not_comparable", "numerical_value_evidence_mismatch"), ("not_comparable", "unit_evidence_mismatch"), ("match", None), ("not_comparable", "numerical_pair_missing")]
    cases = {"m2": [("cm2", "10000", "1"), ("кв. м", "3", "3")], "m3": [("mm3", "1000000000", "1"), ("км³", "1", "1000000000")], "kg": [("g", "2500", "2.5"), ("т", "1", "1000")]}
    for to, some in cases.items():
        got = run(spark, e.ExactSpec("equals", e.Policy(to)), *[(side(expected, to), side(given, from_)) for from_, given, expected in some])
        assert [(r["result"], r["actual_converted"]) for r in got] == [("match", expected) for _, _, expected in some]


def test_percent_and_zero(spark):
    pair = (side("25", "%"), side("0.25", "1"))
    assert results(spark, e.ExactSpec("equals", e.Policy("%")), pair) == [("not_comparable", "percent_fraction_not_authorized")]
    assert results(spark, e.ExactSpec("equals", e.Policy("%", percent_fraction=True)), pair, (side("25", "%"), side("0.25", None))) == [("match", None), ("not_comparable", "unit_missing")]
    assert results(spark, e.ExactSpec("equals", e.Policy("1", percent_fraction=True)), (side("25", "%"), side("0.25", None))) == [("match", None)]
    zero = (side("0"), side("0"))
    assert results(spark, e.ExactSpec("numeric_delta", M, tolerance_pct="1", inclusive=True), zero) == [("not_comparable", "zero_expected_not_comparable")]
    only = e.Policy("m", zero_expected="absolute_only")
    assert results(spark, e.ExactSpec("numeric_delta", only, tolerance_pct="1", inclusive=True), zero) == [("not_comparable", "zero_expected_absolute_tolerance_missing")]
    assert results(spark, e.ExactSpec("numeric_delta", only, tolerance_pct="1", tolerance_abs="0", inclusive=True), zero) == [("match", None)]
    assert results(spark, e.ExactSpec("numeric_delta", M, tolerance_abs="1"), zero) == [("not_comparable", "numerical_boundary_missing")]


def test_relative_delta_and_uncertainty(spark):
    spec = e.ExactSpec("numeric_delta", M, tolerance_pct="1", inclusive=True)
    got = run(spark, spec, (side("3"), side("4")), (side("10"), side("10.1", lower="10", upper="10.2")), (side("10"), side("10.1", lower="10.2", upper="10.3")), (side("10"), side("10.1", lower="10")))
    assert (got[0]["result"], got[0]["relative_numerator"], got[0]["relative_denominator"], got[0]["bound_lower"]) == ("mismatch", "100", "3", "0.03")
    assert [(r["result"], r["detail"]) for r in got[1:]] == [("not_comparable", "uncertainty_crosses_boundary"), ("not_comparable", "numerical_uncertainty_invalid"), ("not_comparable", "numerical_uncertainty_invalid")]
    deep = "0." + "0" * 29 + "1"
    assert results(spark, e.ExactSpec("numeric_delta", e.Policy("km"), tolerance_pct="0.0000000000000000000000000001", inclusive=True), (side(deep, "mm"), side(deep, "mm"))) == [("match", None)]


def test_thresholds(spark):
    assert results(spark, e.ExactSpec("threshold", M, max="0.3", max_inclusive=False), (side(None), side("0.3"))) == [("mismatch", None)]
    assert results(spark, e.ExactSpec("threshold", M, max="0.3", max_inclusive=True), (side(None), side("0.3")), (side("0.30000000000000000000000001"), side(None)), (side(None), side(None))) == [("match", None), ("mismatch", None), ("not_comparable", "numerical_value_missing")]
    spec = e.ExactSpec("threshold", M, min="1", min_inclusive=True, max="2", max_inclusive=True)
    assert results(spark, spec, (side(None), side("1.5", lower="0.9", upper="1.6")), (side(None), side("150", "cm", lower="100", upper="200")), (side(None), side("1", "km"))) == [("not_comparable", "uncertainty_crosses_boundary"), ("match", None), ("mismatch", None)]


@pytest.mark.parametrize("kind, value", [("no_increase", "-0.999999999999999999999999999999"), ("no_decrease", "-1.000000000000000000000000000001")])
def test_negative_boundaries(spark, kind, value):
    assert results(spark, e.ExactSpec(kind, M), (side("-1"), side("-1")), (side("-1"), side(value))) == [("match", None), ("mismatch", None)]


def test_specs_that_cannot_be():
    for bad in (lambda: e.Policy("yard"), lambda: e.Policy("m", rounding=(31, "half_up")), lambda: e.ExactSpec("threshold", M), lambda: e.ExactSpec("numeric_delta", M, tolerance_abs="-1"), lambda: e.ExactSpec("about", M)):
        with pytest.raises(ValueError):
            bad()


def brute(spec, a, b):
    """result of two sides without errors."""
    power = {c: p for c, _, p in e.UNITS.values()}

    def ends(s):
        out = []
        for t in (s["lower"] or s["decimal"], s["upper"] or s["decimal"]):
            v = Fraction(t) * Fraction(10) ** (power[s["raw"]] - power[spec.policy.target])
            if spec.policy.rounding:
                scale, mode = spec.policy.rounding
                n = abs(v) * 10**scale
                k, rest = int(n), n - int(n)
                if mode != "toward_zero" and (rest > Fraction(1, 2) or rest == Fraction(1, 2) and (mode == "half_up" or k % 2)):
                    k += 1
                v = Fraction(k, 10**scale) * (-1 if v < 0 else 1)
            out.append(v)
        return out

    (el, eu), (al, au) = ends(a), ends(b)
    span = lambda lo, hi: (Fraction(0) if lo <= 0 <= hi else min(abs(lo), abs(hi)), max(abs(lo), abs(hi)))
    if spec.kind == "equals":
        return "match" if el == eu == al == au else "mismatch" if au < el or al > eu else "not_comparable"
    if spec.kind == "no_decrease":
        return "match" if al >= eu else "mismatch" if au < el else "not_comparable"
    if spec.kind == "no_increase":
        return "match" if au <= el else "mismatch" if al > eu else "not_comparable"
    least, most = span(el, eu)
    if spec.tolerance_pct and least == 0 and spec.policy.zero_expected == "not_comparable":
        return "not_comparable"
    low, high = (max(Fraction(spec.tolerance_abs or 0), v * Fraction(spec.tolerance_pct or 0) / 100) for v in (least, most))
    near, far = span(al - eu, au - el)
    if spec.inclusive:
        return "match" if far <= low else "mismatch" if near > high else "not_comparable"
    return "match" if far < low else "mismatch" if near >= high else "not_comparable"


def test_random_rows_beyond_38_digits(spark):
    r = random.Random(6)

    def one(base, unit):
        k = {"mm": 3, "cm": 2, "m": 0, "km": -3}[unit]
        v = (base + r.choice([-2, -1, 0, 0, 1, 2])) * 10 ** (k + 6)
        text = f"{'-' if v < 0 else ''}{abs(v) // 10**6}" if v % 10**6 == 0 else f"{'-' if v < 0 else ''}{abs(v) // 10**6}.{abs(v) % 10**6:06d}".rstrip("0")
        if r.random() < 0.5:
            return side(text, unit)
        return side(text, unit, lower=str(int(Fraction(text)) - r.randrange(1, 3)), upper=str(int(Fraction(text)) + r.randrange(1, 3)))

    pairs = []
    for _ in range(150):
        base = r.choice([0, 1, -1, 7, 10**45, -(10**50), r.randrange(10**40)])
        pairs.append((one(base, r.choice(["mm", "cm", "m", "km"])), one(base, r.choice(["mm", "cm", "m", "km"]))))
    pairs = [(a, b) for a, b in pairs if all(len(s["decimal"].replace(".", "").replace("-", "")) <= 80 for s in (a, b))]
    specs = [e.ExactSpec("equals", e.Policy("m", rounding=(0, "half_even"))), e.ExactSpec("no_decrease", M), e.ExactSpec("no_increase", e.Policy("km", rounding=(2, "toward_zero")))]
    specs += [e.ExactSpec("numeric_delta", e.Policy("km", rounding=p), tolerance_abs="0.002", tolerance_pct=q, inclusive=i) for p, q, i in ((None, "12.5", True), ((2, "half_up"), None, False))]
    for spec in specs:
        got = [r["result"] for r in run(spark, spec, *pairs)]
        assert got == [brute(spec, a, b) for a, b in pairs], spec
