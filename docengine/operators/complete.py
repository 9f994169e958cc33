"""Completeness of document packages: applicability, requirements, stages, gates."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STAGES = ("PD", "RD", "ID")


def applicable(condition: Mapping | None, attributes: Mapping[str, Column]) -> Column:
    """A condition tree as a column: all, any, or attr with op eq, nonempty or contains.

    Without a condition true. A node's all wins over its any. Unknown attributes are absent.
    """
    if not condition:
        return F.lit(True)
    for word, start in (("all", True), ("any", False)):
        if condition.get(word) is not None:
            out = F.lit(start)
            for child in condition[word]:
                out = out & applicable(child, attributes) if start else out | applicable(child, attributes)
            return out
    value = attributes.get(condition.get("attr"))
    op = condition.get("op", "eq")
    if value is None:
        return F.lit(False)
    if op == "nonempty":
        return value.isNotNull() & (value.cast("string") != "false")
    if op == "contains":
        return F.coalesce(F.array_contains(value, condition.get("value")), F.lit(False))
    return F.coalesce(value == F.lit(condition.get("value")), F.lit(False))


def document_key() -> Column:
    """Logical identity, or the content hash where there is none."""
    return F.coalesce(F.concat(F.lit("document:"), "document_id"), F.concat(F.lit("sha256:"), "sha256"))


def requirement_results(requirements: DataFrame, facts: DataFrame) -> DataFrame:
    """(requirement columns, matched, outcome, reasons): reasons are joined by commas.

    requirements: requirement_id, stage, kind_code, alternative, min_qty, excluded. Matching is an
    equi-join on stage and accepted kind; facts are counted by stage and kind first, so a kind
    with any share of the facts is added up in parts.
    """
    kinds = requirements.select("requirement_id", "stage", F.explode(F.array_distinct(F.array_compact(F.array("kind_code", "alternative")))).alias("kind_code"))
    sure = facts.filter(~F.col("needs_review") & ~F.col("kind_ambiguous") & F.col("kind_code").isNotNull()).select("stage", "kind_code", document_key().alias("key"))
    # one document may match by several kinds and counts once
    held = kinds.join(sure.distinct(), ["stage", "kind_code"]).groupBy("requirement_id").agg(F.countDistinct("key").alias("matched"))
    stage = facts.groupBy("stage").agg(F.bool_or(F.col("kind_ambiguous") | F.col("needs_review")).alias("ambiguous"), F.bool_or(F.col("kind_code").isNull()).alias("unresolved"))
    both = requirements.join(held, "requirement_id", "left").join(F.broadcast(stage), "stage", "left").fillna(0, ["matched"]).fillna(False, ["ambiguous", "unresolved"])  # a row a stage
    unclear = F.col("ambiguous") | F.col("unresolved")
    outcome = (
        F.when(F.col("excluded"), "not_applicable")
        .when(F.col("matched") >= F.col("min_qty"), "fulfilled")
        .when(F.col("matched") > 0, "missing")
        .when(unclear, "unverifiable")
        .otherwise("missing")
    )
    doubts = F.concat_ws(",", F.when(F.col("ambiguous"), "kind_needs_review"), F.when(F.col("unresolved"), "kind_unresolved"))
    reasons = (
        F.when(F.col("excluded"), "excluded").when(F.col("matched") >= F.col("min_qty"), "").when(F.col("matched") > 0, "quantity_short").when(unclear, doubts).otherwise("document_absent")
    )
    return both.select(*requirements.columns, "matched", outcome.alias("outcome"), reasons.alias("reasons"))


def stage_status(results: DataFrame, *keys: str) -> DataFrame:
    """Per key and stage with applicable requirements: status and counts."""
    count = lambda x: F.count_if(F.col("outcome") == x)
    r = results.filter("outcome <> 'not_applicable'").groupBy(*keys, "stage").agg(F.count("*").alias("applicable"), count("fulfilled").alias("fulfilled"), count("missing").alias("missing"), count("unverifiable").alias("unverifiable"))
    status = F.when(F.col("fulfilled") == F.col("applicable"), "UPLOADED").when((F.col("fulfilled") == 0) & (F.col("unverifiable") == 0), "MISSING").otherwise("PARTIAL")
    return r.withColumn("status", status)


def scenario(stages: DataFrame, *keys: str) -> DataFrame:
    """Which stages of a key are complete."""
    up = F.array_join(F.sort_array(F.collect_set(F.when(F.col("status") == "UPLOADED", F.col("stage")))), "+")
    names = {"ID+PD+RD": "FULL", "PD+RD": "PD_RD_ONLY", "ID+PD": "PD_ID_ONLY", "ID+RD": "RD_ID_ONLY", "ID": "SINGLE_ONLY", "PD": "SINGLE_ONLY", "RD": "SINGLE_ONLY"}
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return stages.groupBy(*keys).agg(up.alias("uploaded")).withColumn("scenario", F.coalesce(table[F.col("uploaded")], F.lit("PARTIALLY_LOADED")))


def reasons_histogram(results: DataFrame) -> DataFrame:
    return results.filter("reasons <> ''").select(F.explode(F.split("reasons", ",")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def gate(applicable_: Column, unresolved: Column, revision_unresolved: Column, missing: Column, evidence: Column) -> tuple[Column, Column]:
    """(gate, reasons): not applicable before unclear before missing before ready."""
    clear = unresolved | revision_unresolved
    absent = missing | ~evidence
    state = F.when(~applicable_, "NOT_APPLICABLE").when(clear, "CLARIFICATION_REQUIRED").when(absent, "MISSING_EVIDENCE").otherwise("READY")
    reasons = (
        F.when(~applicable_, "parameter_not_applicable")
        .when(clear, F.concat_ws(",", F.when(unresolved, "stage_unresolved"), F.when(revision_unresolved, "revision_unresolved")))
        .when(absent, F.concat_ws(",", F.when(missing, "required_document_missing"), F.when(~evidence, "evidence_absent")))
        .otherwise("")
    )
    return state, reasons
