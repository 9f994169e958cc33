"""Joins of periods by stretches of time.

Days are cut into stretches of 1, 2, 4, ... days, aligned to their length. A period is listed under the stretches of one length
that it touches, a day under the stretch of each length in use that holds it, so an equi-join on (keys, stretch) meets each pair once
at most; the days then decide. Which lengths are in use follows from the periods' lengths (``_levels``): mostly one about as
long as they are, so that a period has about three rows, a day one, and the pairs met are about twice the hits. A hot
key is spread over its stretches.

``nodes`` and ``path`` name a period as a union of a few stretches, at most two of each length, and all stretches of a day:
a day lies in a period exactly if one node of the period is on the day's path, and then only one is.

Days are numbers from 1970-01-01; nodes reach from the year 0 to about 5700 (2^21 days). A period without an end
reaches to the last of these days, a period that ends before it begins or has no begin holds nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = 21
_ZERO = 719_528  # days from the year 0 to 1970-01-01
LAST = (1 << LEVELS) - 1


def _day(date: Column) -> Column:
    """A day's number from the year 0 on, days outside moved to the ends; null for null."""
    return F.when(date.isNotNull(), F.least(F.greatest(F.unix_date(date) + _ZERO, F.lit(0)), F.lit(LAST)))



def nodes(begin: Column, end: Column) -> Column:
    """The nodes of the period from begin to end (both included; no end: for ever), empty for no period."""
    a, b = _day(begin), F.coalesce(_day(end), F.lit(LAST))

    def of_period(p: Column) -> Column:
        low, high = p["a"], p["b"]

        def at(level: Column) -> Column:
            size = F.element_at(F.array(*[F.lit(1 << k) for k in range(LEVELS + 1)]), level + 1)
            first, last = F.floor((low + size - 1) / size), F.floor((high + 1) / size) - 1
            # of the stretches of this length within the period, those whose double one isn't within it
            ends = F.array_distinct(F.array(first, last))
            outside = lambda i: (F.floor(i / 2) * 2 * size < low) | ((F.floor(i / 2) * 2 + 2) * size - 1 > high)
            return F.transform(F.filter(ends, lambda i: (first <= last) & outside(i)), lambda i: F.shiftleft(level.cast("long"), 32) + i)

        longest = F.floor(F.log2(F.greatest(high - low + 1, F.lit(1)) + 0.5)).cast("int")  # no longer stretch lies within
        return F.flatten(F.transform(F.sequence(F.lit(0), longest), at))

    period = F.struct(a.alias("a"), b.alias("b"))
    found = F.transform(F.array(period), of_period)[0]
    return F.when(begin.isNotNull() & (a <= b) & F.coalesce(begin <= end, F.lit(True)), found).otherwise(F.array().cast("array<bigint>"))


def path(day: Column, longest: int = LEVELS) -> Column:
    """The stretches that hold a day, up to the length 2^longest; empty for null."""
    levels = F.sequence(F.lit(0), F.lit(longest))
    powers = F.array(*[F.lit(1 << k) for k in range(LEVELS + 1)])
    found = F.transform(levels, lambda k: F.shiftleft(k.cast("long"), 32) + F.floor(_day(day) / F.element_at(powers, k + 1)))
    return F.when(day.isNotNull(), found).otherwise(F.array().cast("array<bigint>"))


def _listed(periods: DataFrame, begin: str, end: str, low: int, high: int) -> DataFrame:
    """Each period's row once for each of its nodes (_node) as ``nodes`` names them, of the period's part between the days low and high.

    The same as exploding ``nodes``, as plain columns that Spark compiles.
    """
    proper = F.col(begin).isNotNull() & F.coalesce(F.col(begin) <= F.col(end), F.lit(True))
    df = periods.filter(proper).withColumns({"_a": F.greatest(_day(F.col(begin)), F.lit(low)), "_b": F.least(F.coalesce(_day(F.col(end)), F.lit(LAST)), F.lit(high))}).filter("_a <= _b")
    df = df.withColumn("_level", F.explode(F.sequence(F.lit(0), F.floor(F.log2(F.col("_b") - F.col("_a") + 1.5)).cast("int"))))
    df = df.withColumn("_size", F.expr("shiftleft(1, _level)"))
    df = df.withColumns({"_first": F.expr("(_a + _size - 1) div _size"), "_last": F.expr("(_b + 1) div _size - 1")}).filter("_first <= _last")
    df = df.withColumn("_at", F.explode(F.expr("if(_first = _last, array(_first), array(_first, _last))")))
    df = df.filter("_at div 2 * 2 * _size < _a or (_at div 2 * 2 + 2) * _size - 1 > _b")
    return df.withColumn("_node", F.expr("shiftleft(cast(_level as bigint), 32) + _at")).drop("_a", "_b", "_level", "_size", "_first", "_last", "_at")


def _levels(n_days: int, counts: dict[int, int]) -> list[int]:
    """For each class of lengths (2^k to 2^(k+1) - 1 days) the level of stretches (2^level days) that its periods are listed under.

    counts: periods by class. Each level in use costs a row for each day, a period 2^(k - level) rows and one more; longer stretches than
    the period let it meet as many times more days than it holds. Levels are added as long as that becomes less.
    """

    def cost(chosen: list[int]) -> int:
        return n_days * len(chosen) + sum(n * (1 + min(1 << abs(k - level) for level in chosen)) for k, n in counts.items())

    chosen: list[int] = []
    while True:
        best = min((chosen + [level] for level in range(LEVELS + 1) if level not in chosen), key=cost, default=chosen)
        if chosen and cost(best) >= cost(chosen):
            return [min(chosen, key=lambda level: (abs(k - level), level)) for k in range(LEVELS + 1)]
        chosen = best


def holding(days: DataFrame, day: str, periods: DataFrame, begin: str, end: str, keys: list[str]) -> DataFrame:
    """Each row of days with each row of periods of equal keys whose period holds its day.

    Names other than the keys must differ. One aggregate finds the first and the last day that is asked for, outside of which
    periods are cut off, and another one counts the periods by their lengths.
    """
    low, high, n = days.agg(F.min(_day(F.col(day))), F.max(_day(F.col(day))), F.count(day)).first()
    if low is None:
        low, high = 0, -1
    proper = F.col(begin).isNotNull() & F.coalesce(F.col(begin) <= F.col(end), F.lit(True))
    inside = periods.filter(proper).withColumns({"_a": F.greatest(_day(F.col(begin)), F.lit(low)), "_b": F.least(F.coalesce(_day(F.col(end)), F.lit(LAST)), F.lit(high))}).filter("_a <= _b")
    size = F.floor(F.log2(F.col("_b") - F.col("_a") + 1.5)).cast("int")
    levels = _levels(n, {r[0]: r[1] for r in inside.groupBy(size).count().collect()})  # a row for each class at most
    level = F.element_at(F.array(*map(F.lit, levels)), size + 1)
    node = F.shiftleft(F.col("_level").cast("long"), 32) + F.col("_at")
    listed = inside.withColumn("_level", level).withColumn("_at", F.explode(F.expr("sequence(shiftright(_a, _level), shiftright(_b, _level))")))
    listed = listed.withColumn("_node", node).drop("_level", "_at")
    asked = days.filter(F.col(day).isNotNull()).withColumns({"_day": _day(F.col(day)), "_level": F.explode(F.array(*map(F.lit, sorted(set(levels)))))})
    asked = asked.withColumn("_at", F.expr("shiftright(_day, _level)")).withColumn("_node", node).drop("_level", "_at")
    return asked.join(listed, [*keys, "_node"]).filter("_day between _a and _b").drop("_node", "_day", "_a", "_b")


def overlapping(left: DataFrame, begin: str, end: str, right: DataFrame, other_begin: str, other_end: str, keys: list[str]) -> DataFrame:
    """Each row of left with each row of right of equal keys whose period meets its own.

    Either left's first day lies in right's period, or right's first day lies in left's, after its first.
    """
    first = holding(left, begin, right, other_begin, other_end, keys)
    later = holding(right, other_begin, left, begin, end, keys).filter(F.col(other_begin) > F.col(begin))
    proper = F.coalesce(F.col(begin) <= F.col(end), F.lit(True)) & F.coalesce(F.col(other_begin) <= F.col(other_end), F.lit(True))
    return first.filter(proper).unionByName(later.filter(proper))
