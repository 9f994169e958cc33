"""Comparison of expected and actual values: pairs, groups, three-valued trees."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: two numbers this close are equal.
EPSILON = 1e-9


@dataclass(frozen=True)
class Spec:
    """kind: equals, numeric_delta, no_decrease, no_increase or threshold, with its bounds."""

    kind: str
    tolerance_abs: float = 0.0
    tolerance_pct: float = 0.0
    min: float | None = None
    max: float | None = None

    def __post_init__(self) -> None:
        if self.kind not in ("equals", "numeric_delta", "no_decrease", "no_increase", "threshold"):
            raise ValueError(f"unknown kind {self.kind}")
        if self.tolerance_abs < 0 or self.tolerance_pct < 0:
            raise ValueError("tolerances can't be negative")
        if self.kind == "threshold" and self.min is None and self.max is None:
            raise ValueError("a threshold needs a bound")
        if self.min is not None and self.max is not None and self.min > self.max:
            raise ValueError("min lies above max")


def unit_detail(expected: Column, actual: Column) -> Column:
    """unit_mismatch, unit_missing (one side has none) or null."""
    both = expected.isNotNull() & actual.isNotNull()
    return F.when(both & (expected != actual), "unit_mismatch").when(expected.isNull() != actual.isNull(), "unit_missing")


def pair_columns(spec: Spec, expected: Column, actual: Column, expected_unit: Column, actual_unit: Column) -> dict[str, Column]:
    """result, delta, delta_pct and detail of one expected and one actual number."""
    unit = unit_detail(expected_unit, actual_unit)
    blocked = F.coalesce(unit == "unit_mismatch", F.lit(False))
    missing = expected.isNull() | actual.isNull()
    delta = actual - expected
    if spec.kind == "equals":
        delta = F.abs(delta)
        holds = delta <= EPSILON
    elif spec.kind == "numeric_delta":
        holds = F.abs(delta) <= F.greatest(F.lit(float(spec.tolerance_abs)), spec.tolerance_pct / 100 * F.abs(expected)) + EPSILON
    elif spec.kind == "no_decrease":
        holds = actual >= expected - EPSILON
    elif spec.kind == "no_increase":
        holds = actual <= expected + EPSILON
    else:
        raise ValueError("a threshold is no comparison of pairs")
    open_ = ~blocked & ~missing
    percent = F.when(open_ & (F.abs(expected) > EPSILON), F.abs(delta) / F.abs(expected) * 100)
    return {
        "result": F.when(~open_, "not_comparable").when(holds, "match").otherwise("mismatch"),
        "delta": F.when(open_, delta),
        "delta_pct": F.lit(None).cast("double") if spec.kind == "equals" else percent,
        "detail": F.when(blocked, unit).when(missing, "non_numeric").otherwise(unit),
    }


def threshold_columns(spec: Spec, value: Column) -> dict[str, Column]:
    """result and detail of one value against the bounds."""
    below = value < spec.min - EPSILON if spec.min is not None else F.lit(False)
    above = value > spec.max + EPSILON if spec.max is not None else F.lit(False)
    return {
        "result": F.when(value.isNull(), "not_comparable").when(below | above, "mismatch").otherwise("match"),
        "detail": F.when(value.isNull(), "non_numeric").when(below, f"below_min:{spec.min:g}" if spec.min is not None else None).when(above, f"above_max:{spec.max:g}" if spec.max is not None else None),
    }


def rollup(results: Column) -> Column:
    """Aggregate: any mismatch -> discrepancy, all match -> match, else not_comparable."""
    return F.when(F.bool_or(results == "mismatch"), "discrepancy").when(F.bool_and(results == "match"), "match").otherwise("not_comparable")


def distinct_values(members: DataFrame) -> DataFrame:
    """(group_id, role, n_buckets, value, unit): the different extracted values of each role.

    Values differ by value and unit; a member without a unit joins a bucket of its value. So a
    value has as many buckets as it has different units, one at least. value and unit are those
    of the first member by extraction_id, then value. Nothing is collected: sums of per-value counts.
    """
    used = members.filter((F.col("status") == "extracted") & F.col("value").isNotNull() & F.col("role").isin("expected", "actual"))
    each = used.groupBy("group_id", "role", "value").agg(F.greatest(F.countDistinct("unit"), F.lit(1)).alias("k"), F.min("extraction_id").alias("first"), F.min_by("unit", F.when(F.col("unit").isNotNull(), F.struct("extraction_id", "unit"))).alias("unit"))
    return each.groupBy("group_id", "role").agg(F.sum("k").alias("n_buckets"), F.min_by("value", F.struct("first", "value")).alias("value"), F.min_by("unit", F.struct("first", "value")).alias("unit"))


def sides(members: DataFrame) -> DataFrame:
    """One row per group: buckets, value and unit of both roles, whether a role is unknown."""
    d = distinct_values(members)
    base = members.groupBy("group_id").agg(F.bool_or(F.col("role") == "unknown").alias("unclassified"))
    for role in ("expected", "actual"):
        side = d.filter(F.col("role") == role).select("group_id", F.col("n_buckets").alias(f"n_{role}"), F.col("value").alias(role), F.col("unit").alias(f"{role}_unit"))
        base = base.join(side, "group_id", "left")
    return base.fillna(0, ["n_expected", "n_actual"])


def group_verdict(members: DataFrame, spec: Spec) -> DataFrame:
    """(group_id, status, detail) of every group: ambiguous and missing sides come before the comparison."""
    s = sides(members)
    if spec.kind == "threshold":
        one, two = threshold_columns(spec, F.col("expected")), threshold_columns(spec, F.col("actual"))
        bad = (one["result"] == "mismatch") | (two["result"] == "mismatch")
        good = (one["result"] == "match") & (two["result"] == "match")
        compared, detail = F.when(bad, "discrepancy").when(good, "match").otherwise("not_comparable"), F.coalesce(one["detail"], two["detail"])
    else:
        pair = pair_columns(spec, F.col("expected"), F.col("actual"), F.col("expected_unit"), F.col("actual_unit"))
        compared, detail = F.when(pair["result"] == "mismatch", "discrepancy").otherwise(pair["result"]), pair["detail"]
    settled = F.when(F.col("n_expected") > 1, "expected_ambiguous").when(F.col("n_expected") == 0, "expected_missing").when(F.col("n_actual") > 1, "actual_ambiguous").when(F.col("n_actual") == 0, "actual_missing")
    return s.select("group_id", F.coalesce(settled, compared).alias("status"), F.when(settled.isNull(), detail).alias("detail"))


def outcome(n_buckets: Column) -> Column:
    """no_evidence, extracted or ambiguous."""
    return F.when(n_buckets == 0, "no_evidence").when(n_buckets == 1, "extracted").otherwise("ambiguous")


def truth_of(status: Column) -> Column:
    """match -> true, discrepancy -> false, anything else -> unknown (null)."""
    return F.when(status == "match", True).when(status == "discrepancy", False)


def kleene(values: Column, operator: str) -> Column:
    """Aggregate: strong Kleene AND or OR of nullable booleans; unknown for no rows."""
    n, unknown = F.count("*"), F.count_if(values.isNull())
    if operator == "and":
        return F.when(F.bool_or(~values), False).when((unknown == 0) & (n > 0), True)
    if operator == "or":
        return F.when(F.bool_or(values), True).when((unknown == 0) & (n > 0), False)
    raise ValueError(operator)


@dataclass(frozen=True)
class Tree:
    """A comparison tree: a leaf names a boolean column; an inner node has 2 to 8 children."""

    operator: str = ""
    leaf: str = ""
    children: tuple["Tree", ...] = field(default_factory=tuple)

    def check(self, depth: int = 1) -> int:
        """The number of nodes; raises on more than 6 levels, 64 nodes or a bad number of children."""
        if depth > 6:
            raise ValueError("the tree has more than 6 levels")
        if not self.operator:
            return 1
        if self.operator not in ("and", "or") or not 2 <= len(self.children) <= 8:
            raise ValueError("an inner node is and/or with 2 to 8 children")
        total = 1 + sum(c.check(depth + 1) for c in self.children)
        if total > 64:
            raise ValueError("the tree has more than 64 nodes")
        return total

    def column(self) -> Column:
        """Spark's AND and OR are strong Kleene already."""
        if not self.operator:
            return F.col(self.leaf)
        out = self.children[0].column()
        for child in self.children[1:]:
            out = out & child.column() if self.operator == "and" else out | child.column()
        return out


def determining(df: DataFrame, key: str, value: str, operator: str) -> DataFrame:
    """The children that decide their node: those equal to its value (all, where it is unknown)."""
    w = Window.partitionBy(key)
    any_false, any_true = F.max((~F.col(value)).cast("int")).over(w), F.max(F.col(value).cast("int")).over(w)
    unknown = F.max(F.col(value).isNull().cast("int")).over(w)
    if operator == "and":
        node = F.when(any_false == 1, False).when(unknown == 0, True)
    else:
        node = F.when(any_true == 1, True).when(unknown == 0, False)
    return df.withColumn("node", node).filter(F.col("node").eqNullSafe(F.col(value)))


def exact_interval(expected_low: Column, expected_high: Column, actual_low: Column, actual_high: Column, tolerance: Column) -> Column:
    """Interval comparison in decimals: match if all differences are within the tolerance, mismatch if none is, else null."""
    low, high = actual_low - expected_high, actual_high - expected_low
    return F.when((low >= -tolerance) & (high <= tolerance), True).when((low > tolerance) | (high < -tolerance), False)


def ordered_category(expected: Column, actual: Column, ranks: dict[str, int], direction: str = "no_decrease") -> Column:
    """match, mismatch or not_comparable (a category without a rank)."""
    table = F.create_map(*[F.lit(v) for pair in ranks.items() for v in pair])
    e, a = table[F.trim(expected)], table[F.trim(actual)]
    holds = a >= e if direction == "no_decrease" else a <= e
    return F.when(e.isNull() | a.isNull(), "not_comparable").when(holds, "match").otherwise("mismatch")
