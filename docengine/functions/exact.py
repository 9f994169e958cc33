"""Exact decimal numbers of up to 171 digits before the point and 90 after it as column expressions.

A number is 112 bytes: the integer number * 10^90 plus 2^895, the highest byte first. Bytes are compared
from the left and unsigned, so they are in the numbers' order: <, least and greatest compare numbers.
Operations are small functions of integers over Arrow batches; conditions on texts and exponents stay
in Spark's own expressions. Nothing is a binary float.

Texts have at most 80 digits, 30 of them after the point; anything else is null. Null goes through all
operations. What has more than 90 places or 171 digits before the point can't be held: ``product`` says
so by null, the others can't reach it from such texts by adding up and shifting by at most 30 places.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Limits of a text, and the names of the rounding modes.
DIGITS, PLACES, WORK_PLACES = 80, 30, 90
ROUNDINGS = ("half_up", "half_even", "toward_zero")
_WHOLE = 171
_BYTES = 112
_ZERO = 1 << (8 * _BYTES - 1)
_LIMIT = 10 ** (_WHOLE + WORK_PLACES)
_TENS = [10**k for k in range(WORK_PLACES + 1)]
_FEW = 8  # places of most numbers
_PLAIN = re.compile(rf"([+-]?)([0-9]+)(?:[.]([0-9]{{1,{PLACES}}}))?")
_SHORTEST = re.compile(r"-?(?:0|[1-9][0-9]*)(?:[.][0-9]*[1-9])?")


def _read(number: bytes) -> int:
    return int.from_bytes(number, "big") - _ZERO


def held(v: int | None) -> int | None:
    """number * 10^90 itself, null if it has more digits than a number can hold."""
    return v if v is not None and -_LIMIT < v < _LIMIT else None


def _held(v: int | None) -> bytes | None:
    v = held(v)
    return None if v is None else (v + _ZERO).to_bytes(_BYTES, "big")


_KINDS = {"binary": (T.BinaryType(), pa.binary()), "string": (T.StringType(), pa.string()), "int": (T.IntegerType(), pa.int32())}


def _each(kind: str, f: Callable) -> Callable:
    """A column function that gives f of each row's value, null for null."""
    spark_type, out = _KINDS[kind]

    @F.arrow_udf(spark_type)
    def run(x: pa.Array) -> pa.Array:
        return pa.array([None if v is None else f(v) for v in x.to_pylist()], out)

    return run


def _both(f: Callable) -> Callable:
    """A column function that gives the number f of each row's two values, null if one is null."""

    @F.arrow_udf(T.BinaryType())
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([None if v is None or w is None else f(v, w) for v, w in zip(x.to_pylist(), y.to_pylist(), strict=True)], pa.binary())

    return run


def literal(text: str) -> Column:
    """A number of the program; raises ValueError if the text is none."""
    return F.lit(_held(constant(text)))


def constant(text: str) -> int:
    """number * 10^90 of a number of the program."""
    digits, places = coefficient(text)
    return digits * _TENS[WORK_PLACES - places]


def coefficient(text: str) -> tuple[int, int]:
    """(digits, places) of a decimal text, or of a number's shortest text with an exponent, without trailing zeros."""
    found = re.fullmatch(r"([+-]?)(\d+)(?:\.(\d+))?(?:[eE]([+-]?\d+))?", text)
    if found is None:
        raise ValueError(f"no decimal: {text}")
    sign, whole, fraction, exponent = found[1], found[2], found[3] or "", int(found[4] or 0)
    if len(whole + fraction) > DIGITS or len(fraction) > PLACES or abs(exponent) > 30:
        raise ValueError(f"a decimal beyond the limits: {text}")
    digits, places = int(whole + fraction), len(fraction) - exponent
    if places < 0:
        digits, places = digits * 10**-places, 0
    while places and digits % 10 == 0:
        digits, places = digits // 10, places - 1
    return (-digits if sign == "-" else digits), places if digits else 0


def parsed(text: str) -> int:
    """number * 10^90 of a text of digits with an optional sign and point."""
    whole, _, fraction = text.partition(".")
    return int(whole + fraction) * _TENS[WORK_PLACES - len(fraction)]


def read(text: str) -> int | None:
    """number * 10^90 of one row's text; null where ``number`` is."""
    found = _PLAIN.fullmatch(text)
    if not found:
        return None
    sign, whole, fraction = found.groups("")
    if len(whole) + len(fraction) > DIGITS:
        return None
    v = int(whole + fraction) * _TENS[WORK_PLACES - len(fraction)]
    return -v if sign == "-" else v


def shortest(text: str) -> bool:
    """Whether a text that can be read is the shortest one of its number."""
    return _SHORTEST.fullmatch(text) is not None and text != "-0"


def shown(v: int) -> str:
    """The shortest text of number * 10^90."""
    few, rest = divmod(abs(v), _TENS[WORK_PLACES - _FEW])
    places = _FEW
    if rest:  # more than a few places
        few, places = abs(v), WORK_PLACES
    whole, rest = divmod(few, _TENS[places])
    digits = f"{whole}.{rest:0{places}d}".rstrip("0") if rest else str(whole)
    return "-" + digits if v < 0 else digits


def moved(v: int, places: int) -> int | None:
    """v times 10^places, for at most 30 places either way."""
    if places >= 0:
        return held(v * _TENS[places])
    less = abs(v) // _TENS[-places]
    return -less if v < 0 else less


def times(v: int, digits: int, point: int) -> int | None:
    """v times digits * 10^-point; null if the result has more than 90 places."""
    whole, rest = divmod(v, _TENS[point])
    return None if rest else held(whole * digits)


def nearest(v: int, scale: int, mode: str) -> int | None:
    """v with at most ``scale`` places, as ``rounded``."""
    unit = _TENS[WORK_PLACES - scale]
    kept, rest = divmod(abs(v), unit)
    if mode != "toward_zero" and (2 * rest > unit or (2 * rest == unit and (mode == "half_up" or kept % 2))):
        kept += 1
    return held(-kept * unit if v < 0 else kept * unit)


_number, _text = _each("binary", lambda t: _held(parsed(t))), _each("string", lambda x: shown(_read(x)))
_negated, _absolute = _each("binary", lambda x: _held(-_read(x))), _each("binary", lambda x: _held(abs(_read(x))))
_sum, _difference, _shift = _both(lambda x, y: _held(_read(x) + _read(y))), _both(lambda x, y: _held(_read(x) - _read(y))), _both(lambda x, places: _held(moved(_read(x), places)))
_places = _each("int", lambda x: len(shown(_read(x)).partition(".")[2]))


def number(text: Column) -> Column:
    """The number of a text of digits with an optional sign and point; null for any other text or one beyond the limits."""
    whole, fraction = F.regexp_extract(text, r"^[+-]?([0-9]+)", 1), F.regexp_extract(text, r"[.]([0-9]+)$", 1)
    fine = text.rlike(r"\A[+-]?[0-9]+(?:[.][0-9]+)?\z") & (F.length(text) <= DIGITS + 3) & (F.length(whole) + F.length(fraction) <= DIGITS) & (F.length(fraction) <= PLACES)
    return _number(F.when(fine, text))


def text(x: Column) -> Column:
    """The shortest text: no leading or trailing zeros, no point without places, no sign of zero."""
    return _text(x)


def negated(x: Column) -> Column:
    return _negated(x)


def add(x: Column, y: Column) -> Column:
    return _sum(x, y)


def subtract(x: Column, y: Column) -> Column:
    return _difference(x, y)


def absolute(x: Column) -> Column:
    return _absolute(x)


def scientific(text: Column) -> Column:
    """The number of a text that may have an exponent of at most 30 either way; null for any other text."""
    exponent = F.regexp_extract(text, r"[eE]([+-]?[0-9]+)$", 1)
    plain = number(F.regexp_replace(text, r"[eE][+-]?[0-9]+$", ""))
    return shifted(plain, F.when(F.length(exponent) <= 3, F.when(exponent == "", 0).otherwise(exponent.try_cast("int"))))


def shifted(x: Column, exponent: Column) -> Column:
    """x times 10^exponent, for exponents from -30 to 30 (others: null) and numbers of at most 60 places."""
    return _shift(x, F.when(F.abs(exponent) <= 30, exponent.cast("int")))


def places(x: Column) -> Column:
    """The number of decimal places without trailing zeros."""
    return _places(x)


def product(x: Column, factor: str) -> Column:
    """x times a number of the program; null if the result has more than 90 places."""
    digits, point = coefficient(factor)
    return _each("binary", lambda x: _held(times(_read(x), digits, point)))(x)


def rounded(x: Column, scale: int, mode: str) -> Column:
    """x with at most ``scale`` places (0 to 30): half_up and half_even by the absolute number, or toward_zero."""
    if mode not in ROUNDINGS or not 0 <= scale <= PLACES:
        raise ValueError(f"rounding to {scale} places, {mode}")
    return _each("binary", lambda x: _held(nearest(_read(x), scale, mode)))(x)
