"""Selecting reference documents: stage transitions, validity, succession, uniqueness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docengine.session import cut


def reference_stage(stage: Column) -> Column:
    """ID refers to RD, RD to PD."""
    return F.when(stage == "ID", "RD").when(stage == "RD", "PD")


def candidates(revisions: DataFrame, *more: str) -> DataFrame:
    """(actual_id, reference_id): same code and scope, one stage before, another document.

    An equi-join on stage, code and scope; the period decides later. ``more`` names further columns of the reference.
    """
    actual = revisions.select(F.col("revision_id").alias("actual_id"), "document_id", "code", "scope", reference_stage(F.col("stage")).alias("stage"), F.col("valid_from").alias("from_"), F.col("valid_to").alias("to_")).filter("stage is not null")
    other = revisions.select(F.col("revision_id").alias("reference_id"), F.col("document_id").alias("other"), "code", "scope", "stage", "valid_from", "valid_to", "predecessor_id", *more)
    return actual.join(other, ["stage", "code", "scope"]).filter("document_id <> other").drop("other")


def covers(from_: Column, to_: Column, inner_from: Column, inner_to: Column) -> Column:
    """The period holds the inner one; an open end reaches for ever."""
    return (from_ <= inner_from) & (to_.isNull() | (to_ >= inner_to))


def overlaps_only(from_: Column, to_: Column, inner_from: Column, inner_to: Column) -> Column:
    """The periods meet, but the first doesn't hold the second."""
    return (from_ <= inner_to) & (to_.isNull() | (to_ >= inner_from)) & ~covers(from_, to_, inner_from, inner_to)


def not_succeeded(revisions: DataFrame) -> DataFrame:
    """Candidates without a successor in force by the end of the work.

    A reference's first successor is joined before the pairs are made, so that no pair is shuffled for it.
    """
    later = revisions.filter("predecessor_id is not null").groupBy(F.col("predecessor_id").alias("revision_id")).agg(F.min("valid_from").alias("next_from"))
    return candidates(revisions.join(later, "revision_id", "left"), "next_from").filter(~F.coalesce(F.col("next_from") <= F.col("to_"), F.lit(False))).drop("next_from")


def _within(days: DataFrame, asked: DataFrame, keys: list[str], radius: int) -> DataFrame:
    """(keys, day, n, total): for each day asked, days' ids and their sum within ``radius`` days of it; differences of running sums."""
    marks = asked.select(*keys, "day").distinct().select(*keys, "day", F.lit(0).cast("long").alias("n"), F.lit(0).cast("decimal(38,0)").alias("total"))
    each = days.groupBy(*keys, "day").agg(F.count("*").alias("n"), F.sum(F.col("id").cast("decimal(38,0)")).cast("decimal(38,0)").alias("total")).unionByName(marks)
    each = each.groupBy(*keys, "day").agg(F.sum("n").alias("n"), F.sum("total").cast("decimal(38,0)").alias("total"))
    w = Window.partitionBy(*keys).orderBy("day")
    until, before = w.rangeBetween(Window.unboundedPreceding, radius), w.rangeBetween(Window.unboundedPreceding, -radius - 1)
    span = lambda c: (F.sum(c).over(until) - F.coalesce(F.sum(c).over(before), F.lit(0))).alias(c)
    return each.select(*keys, "day", span("n"), span("total"))


def resolved_near(actual: DataFrame, references: DataFrame, keys: list[str], document: str, radius: int) -> DataFrame:
    """``resolved`` for references that begin within ``radius`` days of the work, of equal keys and another document.

    actual and references: id, day (a number), keys, document. No pair is made: references are counted a day, those of the
    work's own document are taken off, and of a single one left the sum of ids is its id.
    """
    keyed = references.dropna(subset=[*keys, document, "day"])
    asked = actual.dropna(subset=[*keys, document, "day"])
    everyone = _within(keyed, asked, keys, radius)
    own = _within(keyed, asked, [*keys, document], radius).withColumnsRenamed({"n": "own", "total": "own_total"})
    both = actual.join(everyone, [*keys, "day"], "left").join(own, [*keys, document, "day"], "left")
    n = F.col("n") - F.col("own")
    status = F.when(n == 1, "selected").when(n > 1, "ambiguous").otherwise("missing")
    return both.select(F.col("id").alias("actual_id"), status.alias("status"), F.when(n == 1, F.col("total") - F.col("own_total")).cast("long").alias("reference_id"))


def resolved(actual: DataFrame, found: DataFrame) -> DataFrame:
    """(actual_id, status, reference_id): one candidate is selected, several are ambiguous."""
    n = found.groupBy("actual_id").agg(F.count("*").alias("n"), F.min("reference_id").alias("only"))
    both = actual.join(n, "actual_id", "left")
    status = F.when(F.col("n") == 1, "selected").when(F.col("n") > 1, "ambiguous").otherwise("missing")
    return both.select("actual_id", status.alias("status"), F.when(F.col("n") == 1, F.col("only")).alias("reference_id"))


def chains(links: DataFrame, limit: int | None = None) -> DataFrame:
    """(id, root, depth, error) for each (id, predecessor_id): error is cycle, too_long or null.

    Pointer jumping: every round doubles the stretch that a row knows, so a chain of n links
    takes log2(n) joins and no row carries its path; rounds end once no row moves. A row that still has a
    predecessor once more than all ids lie behind it is on or behind a cycle, and so is one whose chain
    ends at an unknown id. Chains have any length unless ``limit`` names the most links.
    """
    state = cut(links.select("id", F.col("predecessor_id").alias("jump"), F.when(F.col("predecessor_id").isNull(), 0).otherwise(1).cast("long").alias("depth")))
    total = state.count()
    most = total if limit is None else min(total, 2 * limit)
    reach = 1
    while reach <= most:
        far = state.select(F.col("id").alias("jump"), F.col("jump").alias("next"), F.col("depth").alias("more"))
        joined = state.select("id", "jump", "depth").join(far, "jump", "left")
        known = F.col("more").isNotNull() & F.col("next").isNotNull()
        state = cut(joined.select("id", F.when(known, F.col("next")).otherwise(F.col("jump")).alias("jump"), F.when(known, F.col("depth") + F.col("more")).otherwise(F.col("depth")).alias("depth"), known.alias("moved")))
        if state.filter("moved").isEmpty():
            break
        reach *= 2
    ends = links.filter("predecessor_id is null").select(F.col("id").alias("jump"), F.lit(True).alias("ends"))
    done = state.join(ends, "jump", "left")
    error = F.when(F.col("jump").isNotNull() & F.col("ends").isNull(), "cycle")
    if limit is not None:
        error = F.coalesce(error, F.when(F.col("depth") > limit, "too_long"))
    return done.select("id", F.coalesce("jump", "id").alias("root"), F.when(error.isNull(), F.col("depth")).alias("depth"), error.alias("error"))


def field_values(observed: DataFrame, keys: list[str], name: str, value: str) -> DataFrame:
    """(keys, field, value, conflict): the only distinct value of each field, or a conflict."""
    each = observed.filter(F.col(value).isNotNull()).groupBy(*keys, name).agg(F.countDistinct(value).alias("n"), F.min(value).alias("one"))
    return each.select(*keys, name, F.when(F.col("n") == 1, F.col("one")).alias("value"), F.when(F.col("n") > 1, F.concat(F.lit("field_conflict:"), name)).alias("conflict"))


def folded_overrides(base: DataFrame, patches: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """base with each field's last patch (by order) in place of its value; null patches don't count."""
    newest = patches.groupBy(key).agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), F.struct(*order))).alias(f"_{f}") for f in fields])
    joined = base.join(newest, key, "left")
    for f in fields:
        joined = joined.withColumn(f, F.coalesce(f"_{f}", f)).drop(f"_{f}")
    return joined


def successor_window(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order)
