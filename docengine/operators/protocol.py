"""Protocol assembly: findings, fingerprints, decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Status by verdict, and the transitions of decisions.
BY_VERDICT = {"discrepancy": "CANDIDATE", "match": "NEGATIVE_VERIFIED", "expected_missing": "MISSING_EVIDENCE", "actual_missing": "MISSING_EVIDENCE", "expected_ambiguous": "CLARIFICATION_REQUIRED", "actual_ambiguous": "CLARIFICATION_REQUIRED"}
TRANSITIONS = {"confirm": (("CANDIDATE",), "CONFIRMED"), "reject": (("CANDIDATE",), "NEGATIVE_VERIFIED"), "clarify": (("CANDIDATE",), "CLARIFICATION_REQUIRED"), "reopen": (("CONFIRMED", "NEGATIVE_VERIFIED", "CLARIFICATION_REQUIRED"), "CANDIDATE")}


def _mapped(table: dict[str, str], key: Column, default: str) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key], F.lit(default))


def scopes(parameters: DataFrame, groups: DataFrame, sections: DataFrame) -> DataFrame:
    """Every parameter with its scopes (from groups or sections); the empty scope where it has none."""
    both = groups.join(sections, ["parameter_code", "scope_key"], "full_outer")
    return parameters.join(both, "parameter_code", "left").withColumn("scope_key", F.coalesce("scope_key", F.lit("")))


def finding_status(has_rule: Column, applicable: Column, gate: Column, verdict: Column, candidate: Column) -> Column:
    """A missing rule beats inapplicability, the gate beats the verdict, and a conclusive verdict beats a section's candidate."""
    conclusive = F.coalesce(verdict.isin("match", "discrepancy"), F.lit(False))
    gated = F.when(gate != "READY", gate)
    return (
        F.when(~has_rule, "MISSING_EVIDENCE").when(~applicable, "NOT_APPLICABLE").when(gated.isNotNull(), gated).when(conclusive, _mapped(BY_VERDICT, verdict, "NOT_COMPARABLE"))
        .when(F.coalesce(candidate, F.lit(False)), "CANDIDATE").otherwise(_mapped(BY_VERDICT, verdict, "NOT_COMPARABLE"))
    )


def fingerprint(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, fingerprint): a hash of a group's rows that doesn't depend on their order.

    Rows are hashed, dealt into 256 parts by their hash and the parts' sorted hashes hashed again,
    so no list is longer than a part of a group.
    """
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns])
    rows = df.select(*keys, F.sha2(text, 256).alias("h"))
    parts = rows.groupBy(*keys, F.substring("h", 1, 2).alias("p")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("ph"))
    return parts.groupBy(*keys).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat("p", "ph"))), ""), 256).alias("fingerprint"))


def carried(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """New findings with the decided status of the same finding (same keys and fingerprint) before."""
    decided = old.filter(F.col("decided")).select(*keys, "fingerprint", F.col("status").alias("_old"))
    return new.join(decided, [*keys, "fingerprint"], "left").withColumn("carried", F.col("_old").isNotNull()).withColumn("status", F.coalesce("_old", "status")).drop("_old")


def decided(status: Column, action: Column) -> Column:
    """The status after an action, null where the transition isn't allowed."""
    out = F.lit(None).cast("string")
    for name, (sources, target) in TRANSITIONS.items():
        out = F.when((action == name) & status.isin(*sources), target).otherwise(out)
    return out


def content_counts(findings: DataFrame) -> DataFrame:
    """Counts by status and of parameters with evidence and compared ones."""
    compared = F.col("status").isin("CANDIDATE", "NEGATIVE_VERIFIED", "CONFIRMED")
    per = findings.groupBy("parameter_code").agg(F.bool_or(compared).alias("some"), F.bool_and(compared | (F.col("status") == "NOT_APPLICABLE")).alias("only"), F.bool_or(F.col("evidence")).alias("evidence"), F.count("*").alias("n"), F.count_if(F.col("status") == "CANDIDATE").alias("candidates"))
    return per.agg(F.sum("n").alias("findings"), F.sum("candidates").alias("candidates"), F.count("*").alias("parameters"), F.count_if(F.col("evidence")).alias("with_evidence"), F.count_if(F.col("some") & F.col("only")).alias("compared"))
