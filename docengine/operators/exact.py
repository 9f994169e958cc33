"""Exact comparison of measured values: units, rounding, intervals of uncertainty, inclusive bounds.

A side is a set of columns (see Side): a decimal with the unit that was read beside it, and an interval
that holds it, if its uncertainty is known. Sides are converted to the policy's unit by a power of ten,
rounded, and compared as intervals: match if all values in them hold, mismatch if none do, else
not_comparable. Whatever stands against a comparison is named in ``detail``, the expected side's first.
All numbers are exact (functions/exact.py); every row is judged by itself.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, fields
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docengine.functions import exact as x

# Lengths with their powers of ten and Cyrillic names, more spellings of the metre, and the other units.
LENGTHS = (("mm", -3, "мм"), ("cm", -2, "см"), ("m", 0, "м"), ("km", 3, "км"))
METRES = {"m": ["п.м", "пог.м"], "m2": ["кв.м", "квм"], "m3": ["куб.м", "кубм"]}
OTHERS = (
    ("g", "mass", -3, ["г"]),
    ("kg", "mass", 0, ["кг"]),
    ("t", "mass", 3, ["т"]),
    ("V", "voltage", 0, ["в"]),
    ("kV", "voltage", 3, ["кв"]),
    ("pcs", "count", 0, ["шт", "шт.", "ед", "ед."]),
    ("1", "ratio", 0, []),
    ("%", "ratio", -2, ["процент", "процентов", "проц."]),
)


def _units() -> dict[str, tuple[str, str, int]]:
    """Every spelling without white space in lower case: canonical name, dimension, power of ten."""
    out = {}
    for name, power, local in LENGTHS:
        for n, dimension, raised in ((1, "length", ""), (2, "area", "²"), (3, "volume", "³")):
            canonical = name if n == 1 else f"{name}{n}"
            spellings = [canonical, *([local] if n == 1 else [f"{local}{n}", local + raised, name + raised]), *METRES.get(canonical, [])]
            out |= dict.fromkeys(spellings, (canonical, dimension, power * n))
    for canonical, dimension, power, spellings in OTHERS:
        out |= dict.fromkeys([canonical.lower(), *spellings], (canonical, dimension, power))
    return out


UNITS = _units()


def unit(raw: Column) -> Column:
    """struct(canonical, dimension, exponent) of a spelling, null if it is unknown."""
    quoted = lambda values: "array(" + ", ".join(f"'{v}'" for v in values) + ")"
    known = [f"named_struct('canonical', '{c}', 'dimension', '{d}', 'exponent', {e})" for c, d, e in UNITS.values()]
    table = F.expr(f"map_from_arrays({quoted(UNITS)}, array({', '.join(known)}))")
    return F.try_element_at(table, F.regexp_replace(F.lower(raw), r"(?U)\s+", ""))


@dataclass(frozen=True)
class Side:
    """Names of a side's columns: the value as it is stored, its exact decimal, where the unit was read
    (value, row, header or missing) and its spelling, the unit stated beside the value, and the interval."""

    value: str
    decimal: str
    source: str
    raw: str
    stated: str
    lower: str
    upper: str


@dataclass(frozen=True)
class Policy:
    """How values are made comparable: the unit, what an expected zero means for a percentage, whether
    percentages and fractions may be converted into each other, and rounding (places, mode)."""

    target: str
    zero_expected: str = "not_comparable"
    percent_fraction: bool = False
    rounding: tuple[int, str] | None = None

    def __post_init__(self) -> None:
        if self.target not in {c for c, _, _ in UNITS.values()}:
            raise ValueError(f"no canonical unit: {self.target}")
        if self.zero_expected not in ("absolute_only", "not_comparable"):
            raise ValueError(self.zero_expected)
        if self.rounding is not None and (not 0 <= self.rounding[0] <= x.PLACES or self.rounding[1] not in x.ROUNDINGS):
            raise ValueError(f"no rounding: {self.rounding}")


@dataclass(frozen=True)
class ExactSpec:
    """kind: equals, numeric_delta, no_decrease, no_increase or threshold, with bounds as decimal texts.

    A missing ``inclusive`` (or min_inclusive, max_inclusive) leaves the comparison open.
    """

    kind: str
    policy: Policy
    tolerance_abs: str | None = None
    tolerance_pct: str | None = None
    inclusive: bool | None = None
    min: str | None = None
    max: str | None = None
    min_inclusive: bool | None = None
    max_inclusive: bool | None = None

    def __post_init__(self) -> None:
        if self.kind not in ("equals", "numeric_delta", "no_decrease", "no_increase", "threshold"):
            raise ValueError(f"unknown kind {self.kind}")
        for t in (self.tolerance_abs, self.tolerance_pct):
            if t is not None and x.coefficient(t)[0] < 0:
                raise ValueError("tolerances can't be negative")
        if self.kind == "threshold" and self.min is None and self.max is None:
            raise ValueError("a threshold needs a bound")
        for t in (self.min, self.max):
            if t is not None:
                x.coefficient(t)


_SPACES = "\t\n\v\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WRITTEN = re.compile(r"[+-]?(?:[0-9]{1,3}(?: [0-9]{3})+|[0-9]+)(?:[.,][0-9]+)?")


@lru_cache(1 << 12)
def _unit(raw: str | None) -> tuple[str, str, int] | None:
    """``unit`` of one row's spelling."""
    return None if raw is None else UNITS.get(re.sub(f"[{_SPACES}]+", "", raw.lower()))


def _written(value: str) -> str | None:
    """``decimal_input`` of one row's text."""
    plain = value.strip(" ").replace("\xa0", " ").replace("\u202f", " ")
    return plain.replace(" ", "").replace(",", ".").removeprefix("+") if _WRITTEN.fullmatch(plain) else None


def _taken(policy: Policy, value: str | None, decimal: str | None, source: str | None, raw: str | None, stated: str | None, lower: str | None, upper: str | None) -> tuple:
    """(error, point, lower, upper, converted) of one row's side: numbers times 10^90, null where the side is absent or at fault."""

    def fault(name: str | None) -> tuple:
        return name, None, None, None, None

    if value is None:
        return fault(None)
    if decimal is None:
        return fault("numerical_evidence_missing")
    v = x.read(decimal)
    if v is None:
        return fault("decimal_invalid")
    if not x.shortest(decimal):
        return fault("numerical_value_invalid")
    missing = source == "missing"
    if missing and raw is not None:
        return fault("numerical_missing_unit_invalid")
    if not missing and (source not in ("value", "row", "header") or not (raw or "").strip(" ")):
        return fault("numerical_unit_origin_missing")
    found = _unit(raw) if not missing else UNITS["1"] if policy.target == "1" else None
    if not missing and found is None:
        return fault("numerical_unit_invalid")
    if (lower is None) != (upper is None):
        return fault("numerical_uncertainty_invalid")
    low, high = (v, v) if lower is None else (x.read(lower), x.read(upper))
    if low is None or high is None:
        return fault("decimal_invalid")
    if low > v or high < v:
        return fault("numerical_uncertainty_invalid")
    if value != decimal:
        written = _written(value)
        same = None if written is None else x.read(written)
        if same is None or x.shown(same) != decimal:
            return fault("numerical_value_evidence_mismatch")
    if found is None:
        return fault("unit_missing")
    name, dimension, power = found
    _, wanted, base = _unit(policy.target)
    if dimension != wanted:
        return fault("unit_dimension_mismatch")
    if wanted == "ratio" and not policy.percent_fraction and name != policy.target:
        return fault("percent_fraction_not_authorized")
    if stated is not None and (_unit(stated) or (None,))[0] != name:
        return fault("unit_evidence_mismatch")
    ends = [x.moved(n, power - base) for n in ((v,) if lower is None else (v, low, high))]
    converted = ends[0]
    if policy.rounding:
        ends = [None if n is None else x.nearest(n, *policy.rounding) for n in ends]
    return (None, *(ends if len(ends) == 3 else ends * 3), converted)


def absolute_range(low: Column, high: Column) -> tuple[Column, Column]:
    """The least and greatest absolute value in an interval."""
    zero = x.literal("0")
    a, b = x.absolute(low), x.absolute(high)
    return F.when((low <= zero) & (high >= zero), zero).otherwise(F.least(a, b)), F.greatest(a, b)


def _span(low: int, high: int) -> tuple[int, int]:
    """``absolute_range`` of one row's numbers."""
    a, b = abs(low), abs(high)
    return 0 if low <= 0 <= high else min(a, b), max(a, b)


#: What a comparison tells, all of it texts.
_TOLD = ("result", "detail", "delta", "relative_numerator", "relative_denominator", "bound_lower", "bound_upper", "expected_converted", "actual_converted")


def _judge(spec: ExactSpec) -> Callable[[Sequence, Sequence], tuple]:
    """A function of one row's two sides, each with the texts that a Side names, that gives _TOLD."""
    number = lambda t: None if t is None else x.constant(t)
    least_bound, most_bound, absolute = number(spec.min), number(spec.max), number(spec.tolerance_abs or "0")
    unknown = (spec.min is not None and spec.min_inclusive is None) or (spec.max is not None and spec.max_inclusive is None)
    zero_error = factor = None
    if spec.kind == "numeric_delta" and spec.tolerance_pct is not None:
        digits, places = x.coefficient(spec.tolerance_pct)
        if places + 2 > 30:
            raise ValueError("a percentage of at most 28 places")
        factor = x.coefficient(f"{digits}e-{places + 2}")
        zero_error = "zero_expected_not_comparable" if spec.policy.zero_expected == "not_comparable" else "zero_expected_absolute_tolerance_missing" if spec.tolerance_abs is None else None
    shown = lambda v: None if v is None else x.shown(v)

    def threshold(low: int | None, high: int | None) -> tuple[bool, bool]:
        if low is None or high is None:
            return False, False
        holds, fails = True, False
        if least_bound is not None:
            holds, fails = (low >= least_bound, high < least_bound) if spec.min_inclusive else (low > least_bound, high <= least_bound)
        if most_bound is not None:
            always, never = (high <= most_bound, low > most_bound) if spec.max_inclusive else (high < most_bound, low >= most_bound)
            holds, fails = holds and always, fails or never
        return holds, fails

    def judge(expected: Sequence[str | None], actual: Sequence[str | None]) -> tuple:
        there = expected[0] is not None, actual[0] is not None
        e_error, e, e_low, e_high, e_converted = _taken(spec.policy, *expected)
        a_error, a, a_low, a_high, a_converted = _taken(spec.policy, *actual)
        error = e_error or a_error
        delta = numerator = denominator = low = high = None
        holds = fails = False
        if spec.kind == "threshold":
            error = error or ("numerical_value_missing" if not any(there) else "numerical_boundary_missing" if unknown else None)
            holds, fails = threshold(e_low if a_low is None else a_low, e_high if a_high is None else a_high)
        else:
            error = error or (None if all(there) else "numerical_pair_missing")
            if e is not None and a is not None:
                delta = a - e
                if e:
                    numerator, denominator = x.moved(abs(delta), 2), abs(e)
                if spec.kind == "equals":
                    holds, fails = e_low == e_high and a_low == a_high and e == a, a_high < e_low or a_low > e_high
                elif spec.kind == "no_decrease":
                    holds, fails = a_low >= e_high, a_high < e_low
                elif spec.kind == "no_increase":
                    holds, fails = a_high <= e_low, a_low > e_high
                else:
                    near, far = _span(a_low - e_high, a_high - e_low)
                    low = high = absolute
                    if factor is not None:
                        least, most = _span(e_low, e_high)
                        low, high = x.times(least, *factor), x.times(most, *factor)
                        if spec.inclusive is not None:
                            error = error or (zero_error if least == 0 else None) or ("decimal_scale_limit" if low is None or high is None else None)
                        low, high = (None if v is None else max(absolute, v) for v in (low, high))
                    if low is not None and high is not None:
                        holds, fails = (far <= low, near > high) if spec.inclusive else (far < low, near >= high)
            if spec.kind == "numeric_delta" and spec.inclusive is None:
                error = error or "numerical_boundary_missing"
        if error is not None:
            holds = fails = False
            low = high = None
        result = "match" if holds else "mismatch" if fails else "not_comparable"
        detail = (error or "uncertainty_crosses_boundary") if result == "not_comparable" else None
        return result, detail, shown(delta), shown(numerator), shown(denominator), shown(low), shown(high), shown(e_converted), shown(a_converted)

    return judge


def compared(df: DataFrame, spec: ExactSpec, expected: Side, actual: Side) -> DataFrame:
    """df with result (match, mismatch, not_comparable), detail, delta, relative_numerator and _denominator,
    bound_lower and bound_upper, expected_converted and actual_converted, all but the first two as decimal texts.

    A threshold looks at the actual side, or at the expected one where there is no actual value. All rows are judged in one
    pass over Arrow batches.
    """
    judge, names = _judge(spec), [f.name for f in fields(Side)]
    kind = T.StructType([T.StructField(n, T.StringType()) for n in _TOLD])

    @F.arrow_udf(kind)
    def judged(*columns: pa.Array) -> pa.Array:
        rows = zip(*[c.to_pylist() for c in columns], strict=True)
        told = list(zip(*[judge(r[: len(names)], r[len(names) :]) for r in rows], strict=True)) or [[] for _ in _TOLD]
        return pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in told], _TOLD)

    told = df.select(*df.columns, judged(*[F.col(getattr(side, n)).cast("string") for side in (expected, actual) for n in names]).alias("_told"))
    return told.select(*df.columns, "_told.*")
