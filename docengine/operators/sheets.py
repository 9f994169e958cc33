"""Sheet sets, confirmed extractions, row labels and stamp neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docengine.session import cut

SPAN = 32


def _ancestors(links: DataFrame, limit: int | None) -> DataFrame:
    """(id, path): the predecessors of each row, nearest first, where the chain ends at a known id, within ``limit`` rows if it is given.

    Every round joins each open path with that of its last row, so paths double; rows on or behind a cycle (their path comes to its
    last row twice), behind an unknown id or behind more rows are left out.
    """
    p = F.col("predecessor_id")
    state, reach = cut(links.select("id", F.when(p.isNull(), F.array().cast(T.ArrayType(links.schema["id"].dataType))).otherwise(F.array(p)).alias("path"), p.alias("jump"))), 1
    while limit is None or reach < limit:
        far = state.select(F.col("id").alias("jump"), F.col("path").alias("more"), F.col("jump").alias("next"))
        moved = state.filter("jump is not null").join(far, "jump").select("id", F.concat("path", "more").alias("path"), F.col("next").alias("jump"))
        moved = moved.filter(F.col("jump").isNull() | (F.array_position("path", F.col("jump")) == F.size("path")))
        state = cut(state.filter("jump is null").unionByName(moved))
        if state.filter("jump is not null").isEmpty():
            break
        reach *= 2
    return state.filter(F.col("jump").isNull() & (F.lit(True) if limit is None else F.size("path") < limit)).select("id", "path")


def sheet_sets(own: DataFrame, replaced: DataFrame, links: DataFrame, limit: int | None = None) -> DataFrame:
    """(revision_id, label, owner): the sheets of each revision, its own and those it inherits.

    own and replaced hold (revision_id, label); links holds (id, predecessor_id). A revision
    inherits its predecessor's sheets but for the labels it replaces. It has no set without
    sheets of its own, if a label it replaces isn't inherited, if its predecessor has no set, or on
    a cycle. Chains have any length unless ``limit`` names the most revisions.

    No level waits for the one before: each revision meets what all those behind it say of a label. A sheet
    reaches it if no nearer revision replaces the label; a revision has a set if none of its chain is at fault.
    """
    paths = cut(_ancestors(links, limit))
    chain = paths.select(F.col("id").alias("revision_id"), F.posexplode(F.concat(F.array("id"), "path")).alias("distance", "from_id"))
    said = own.select(F.col("revision_id").alias("from_id"), "label", F.lit(True).alias("has")).unionByName(replaced.select(F.col("revision_id").alias("from_id"), "label", F.lit(False).alias("has")).distinct())
    w = Window.partitionBy("revision_id", "label")
    at = F.col("distance")
    met = chain.join(said, "from_id").select("revision_id", "label", "distance", "from_id", "has").withColumns({
        "gone": F.min(F.when(~F.col("has"), at)).over(w),
        "gone_before": F.min(F.when(~F.col("has") & (at > 0), at)).over(w),
        "held_before": F.min(F.when(F.col("has") & (at > 0), at)).over(w),
    })
    met = cut(met)
    inherited = F.col("held_before").isNotNull() & (F.col("gone_before").isNull() | (F.col("held_before") <= F.col("gone_before")))
    unknown = met.filter((F.col("gone") == 0) & ~inherited).select("revision_id").join(paths.filter(F.size("path") > 0).select(F.col("id").alias("revision_id")), "revision_id", "left_semi")
    bare = paths.select(F.col("id").alias("revision_id")).join(own, "revision_id", "left_anti")
    at_fault = cut(unknown.unionByName(bare).distinct().withColumnRenamed("revision_id", "from_id"))
    invalid = chain.join(at_fault, "from_id", "left_semi").select("revision_id").distinct()
    sheets = met.filter(F.col("has") & (F.col("gone").isNull() | (at <= F.col("gone"))))
    return sheets.join(invalid, "revision_id", "left_anti").select("revision_id", "label", F.col("from_id").alias("owner"))


def confirmed_extractions(contexts: DataFrame, extractions: DataFrame) -> DataFrame:
    """Each context's representation with its extraction of the same artifact and selection.

    The selection key may be null on both sides; without an extraction, blocker says so.
    """
    e = extractions.select(F.col("artifact_id").alias("_artifact"), F.col("selection_key").alias("_key"), "extraction_id")
    joined = contexts.join(e, (F.col("artifact_id") == F.col("_artifact")) & F.col("selection_key").eqNullSafe(F.col("_key")), "left")
    return joined.withColumn("blocker", F.when(F.col("extraction_id").isNull(), "extraction_missing")).drop("_artifact", "_key")


def row_labels(labels: DataFrame, rows: DataFrame) -> DataFrame:
    """(table_id, row, label_id): labels (table_id, label_id, rows array) at the rows (table_id, row) that they name."""
    return labels.select("table_id", "label_id", F.explode("rows").alias("row")).join(rows, ["table_id", "row"]).select("table_id", "row", "label_id")


def stamp_neighbours(labels: DataFrame, values: DataFrame, page: str) -> DataFrame:
    """(page, label_id, value_id): values just below or to the right of a label, at most 32 blocks away.

    Both have id, position, table_id and corners. Blocks meet through the stretch of 32 positions
    that they lie in or border on, so a page isn't paired with itself. A label within a table
    takes only values of that table.
    """
    stretch = F.expr(f"position div {SPAN}")
    near = labels.select(page, *[F.col(c).alias(f"l_{c}") for c in ("id", "position", "table_id", "x0", "y0", "x1", "y1")], F.explode(F.sequence(stretch - 1, stretch + 1)).alias("_stretch"))
    both = near.join(values.withColumn("_stretch", stretch), [page, "_stretch"])
    dx = F.abs((F.col("x0") + F.col("x1") - F.col("l_x0") - F.col("l_x1")) / 2)
    dy = F.abs((F.col("y0") + F.col("y1") - F.col("l_y0") - F.col("l_y1")) / 2)
    below = (dx < 0.05) & (dy < 0.08) & (F.col("y0") >= F.col("l_y0"))
    right = (dy < 0.025) & (dx < 0.12) & (F.col("x0") >= F.col("l_x0"))
    same = F.col("l_table_id").isNull() | F.coalesce(F.col("l_table_id") == F.col("table_id"), F.lit(False))
    found = both.filter((F.col("id") != F.col("l_id")) & (F.abs(F.col("position") - F.col("l_position")) <= SPAN) & same & (below | right))
    return found.select(page, F.col("l_id").alias("label_id"), F.col("id").alias("value_id"))


def settled(needs_review: Column, ambiguous: Column, kind: Column) -> Column:
    """Facts that may count: a known, unambiguous kind that needs no review."""
    return ~F.coalesce(needs_review, F.lit(False)) & ~F.coalesce(ambiguous, F.lit(False)) & kind.isNotNull()


def readable(include: Column, status: Column, source: Column, native_valid: Column) -> Column:
    """Readings that may be used: an absent flag or status doesn't exclude, but native text must be valid."""
    return F.coalesce(include, F.lit(True)) & (F.coalesce(status, F.lit("")) != "ambiguous") & ((source != "native") | F.coalesce(native_valid, F.lit(False)))
