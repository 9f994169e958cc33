"""Comparison contexts: which reference revision each actual revision is compared with, or why none is.

A revision is a row (see COLUMNS). An actual revision (any but stage PD) gets one context. Its pool of
references is the revision it names, or all revisions of the stage before with its reference code and
scope. The period of works must lie in a reference's approved period; a newer approved revision takes its
predecessor's place from its first day on. What is unclear is never guessed: it is named as a blocker, and a context is
READY only without blockers.

Pools are never paired with actual revisions as such. What holds for a pool as a whole is aggregated once for
each pool; periods meet by an equi-join on pool and stretch of time (operators/intervals.py), so a pool
of any size costs what its periods really meet, and a hot code is spread over time.

Texts are compared without regard to case and runs of white space. Null scopes and codes count as empty, null flags
as false. Ids must be unique (a repeated one gives repeated contexts). An empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docengine.operators.identify import reference_stage
from docengine.operators.intervals import holding, overlapping
from docengine.session import cut

#: The columns of a revision: dates are dates, confirmed is boolean, structural an array of blockers.
COLUMNS = ("revision_id", "document_id", "stage", "code", "reference_code", "scope", "works_from", "works_to", "reference_revision_id", "confirmed", "effective_from", "effective_to", "replaces_id", "structural")


def text_key(x: Column) -> Column:
    """The text in lower case, trimmed, runs of white space as one space; '' for null."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(x.cast("string"), F.lit("")), r"(?U)\s+", " ")))


def replacement_errors(revisions: DataFrame) -> DataFrame:
    """(revision_id, problem) for the revisions whose chain of predecessors has a fault, the first one on the way.

    A link is replacement_target_invalid (no such revision, or one of another document, scope or stage),
    replacement_unconfirmed (the replacing revision has no confirmed valid period) or replacement_period_invalid
    (it begins before its predecessor). Chains that end in a cycle are replacement_cycle. Every round doubles
    the stretch that a revision knows, and rows that are done take no further part.
    """
    own = revisions.select("revision_id", "document_id", "stage", text_key(F.col("scope")).alias("scope"), _approved().alias("approved"), _valid().alias("valid"), "effective_from", "replaces_id")
    other = own.select(F.col("revision_id").alias("replaces_id"), F.struct("document_id", "stage", "scope", "effective_from").alias("p"))
    link = own.filter("replaces_id is not null").join(other, "replaces_id", "left")
    fault = (
        F.when(F.col("p").isNull() | ~(F.col("p.document_id").eqNullSafe(F.col("document_id")) & F.col("p.scope").eqNullSafe(F.col("scope")) & F.col("p.stage").eqNullSafe(F.col("stage"))), "replacement_target_invalid")
        .when(~(F.col("approved") & F.col("valid")), "replacement_unconfirmed")
        .when(F.col("effective_from") < F.col("p.effective_from"), "replacement_period_invalid")
    )
    state = cut(link.select(F.col("revision_id").alias("id"), F.col("replaces_id").alias("jump"), fault.alias("problem")))
    done, total, reach = state.filter("problem is not null"), state.count(), 1
    open_ = state.filter("problem is null")
    while reach <= total:
        # what lies behind a row's stretch: a fault, a further stretch, or nothing (the chain ends there)
        ahead = open_.withColumn("at", F.col("jump")).alias("s").join(done.unionByName(open_).select(F.col("id").alias("at"), F.col("jump").alias("next"), F.col("problem").alias("found")).alias("n"), "at")
        moved = cut(ahead.select("id", F.col("next").alias("jump"), F.col("found").alias("problem")))
        if moved.isEmpty():
            open_ = moved
            break
        done, open_ = cut(done.unionByName(moved.filter("problem is not null"))), moved.filter("problem is null")
        reach *= 2
    return done.select(F.col("id").alias("revision_id"), "problem").unionByName(open_.select(F.col("id").alias("revision_id"), F.lit("replacement_cycle").alias("problem")))


def _approved() -> Column:
    return F.coalesce(F.col("confirmed"), F.lit(False))


def _valid() -> Column:
    return F.col("effective_from").isNotNull() & (F.col("effective_to").isNull() | (F.col("effective_from") <= F.col("effective_to")))


def contexts(revisions: DataFrame) -> DataFrame:
    """(actual_id, document_id, reference_id, status, blockers) for each revision whose stage isn't PD; blockers are sorted."""
    problems = replacement_errors(revisions)
    all_ = revisions.select(*COLUMNS).join(problems, "revision_id", "left")
    all_ = cut(all_.withColumns({
        "scope_key": text_key(F.col("scope")), "code_key": text_key(F.col("code")), "wanted": text_key(F.col("reference_code")), "approved": _approved(), "valid": _valid(),
        "faults": F.coalesce(F.size("structural"), F.lit(0)) > 0,
    }))
    actual = all_.filter(~F.col("stage").eqNullSafe("PD"))

    named = all_.select(F.col("revision_id").alias("reference_revision_id"), F.struct("stage", "scope_key").alias("named"))
    actual = actual.join(named, "reference_revision_id", "left")
    explicit = F.col("reference_revision_id").isNotNull()
    before = reference_stage(F.col("stage"))
    unfit = (
        F.when(~explicit, F.when(F.col("wanted") == "", "reference_link_unconfirmed"))
        .when(F.col("named").isNull() | (F.col("reference_revision_id") == F.col("revision_id")), "reference_not_in_snapshot")
        .when(~F.coalesce(F.col("named.stage").isin("PD", "RD"), F.lit(False)), "reference_stage_invalid")
        .when((F.col("scope_key") == "") | (F.col("named.scope_key") != F.col("scope_key")), "reference_scope_mismatch")
    )
    by_code = F.concat_ws("\x1f", F.lit("code"), before, F.col("wanted"), F.col("scope_key"))
    pool = F.when(unfit.isNotNull(), None).when(explicit, F.concat(F.lit("id\x1f"), F.col("reference_revision_id").cast("string"))).when(before.isNotNull() & (F.col("scope_key") != ""), by_code)
    proper = F.col("works_from").isNotNull() & F.col("works_to").isNotNull() & (F.col("works_from") <= F.col("works_to"))
    actual = cut(actual.select(F.col("revision_id").alias("actual_id"), "document_id", "stage", "scope_key", "approved", "structural", "problem", "works_from", "works_to", "reference_revision_id", unfit.alias("unfit"), pool.alias("pool"), F.coalesce(proper, F.lit(False)).alias("proper")))

    # the members of the pools that are asked for, and all revisions of their documents with their scope or none
    asked = actual.filter("pool is not null").select("pool").distinct()
    listed = all_.filter("stage in ('PD', 'RD')").select(F.explode(F.array(F.concat_ws("\x1f", F.lit("code"), "stage", "code_key", "scope_key"), F.concat(F.lit("id\x1f"), F.col("revision_id").cast("string")))).alias("pool"), "revision_id", "document_id", "scope_key", "approved", "valid", "effective_from", "effective_to", (F.col("faults") | F.col("problem").isNotNull()).alias("unsound"))
    members = cut(listed.join(asked, "pool", "left_semi"))
    whole = members.groupBy("pool").agg(F.count("*").alias("n"), F.bool_or("approved").alias("any_approved"))
    documents = members.select("pool", "document_id", F.col("scope_key").alias("pool_scope")).distinct()
    related = cut(all_.join(documents, "document_id").filter("scope_key = '' or scope_key = pool_scope").select("pool", "stage", "scope_key", "approved", "valid", "effective_from", "effective_to", (F.col("faults") | F.col("problem").isNotNull()).alias("unsound")))
    unclear = ~F.coalesce(F.col("stage").isin("PD", "RD"), F.lit(False)) | ~F.col("approved") | ~F.col("valid") | (F.col("scope_key") == "")
    flags = related.groupBy("pool").agg(F.bool_or(unclear).alias("any_unclear"), F.bool_or("unsound").alias("any_unsound"))

    works = actual.filter("pool is not null and proper").select("actual_id", "pool", "works_from", "works_to")
    covers = (F.col("effective_from") <= F.col("works_from")) & (F.col("effective_to").isNull() | (F.col("effective_to") >= F.col("works_to")))
    meets = overlapping(works, "works_from", "works_to", related.filter("approved and valid").select("pool", "effective_from", "effective_to"), "effective_from", "effective_to", ["pool"])
    partly = meets.filter(~covers).select("actual_id").distinct().withColumn("partly", F.lit(True))
    sound = members.filter("approved and valid and not unsound").select("pool", F.col("revision_id").alias("member"), "effective_from", "effective_to")
    covering = holding(works, "works_from", sound, "effective_from", "effective_to", ["pool"]).filter(covers)
    newer = all_.filter("replaces_id is not null and approved and valid and problem is null").groupBy(F.col("replaces_id").alias("member")).agg(F.min("effective_from").alias("newer_from"))
    judged = covering.join(newer, "member", "left").withColumn("applies", F.coalesce(F.col("newer_from") > F.col("works_to"), F.lit(True)))
    found = judged.groupBy("actual_id").agg(F.count("*").alias("n_covering"), F.count_if("applies").alias("n_applies"), F.min(F.when(F.col("applies"), F.col("member"))).alias("one"))

    df = actual.join(whole, "pool", "left").join(flags, "pool", "left").join(partly, "actual_id", "left").join(found, "actual_id", "left")
    has_pool, n = F.col("n").isNotNull(), F.coalesce("n_covering", F.lit(0))
    applies = F.coalesce("n_applies", F.lit(0))
    there = has_pool & F.col("proper")
    reasons = F.array(
        F.col("problem"),
        F.when(~F.coalesce(F.col("stage").isin("RD", "ID"), F.lit(False)), "stage_unresolved"),
        F.when(F.col("scope_key") == "", "scope_unresolved"),
        F.when(~F.col("approved"), "actual_approval_unconfirmed"),
        F.when(~F.col("proper"), "works_period_unresolved"),
        F.col("unfit"),
        F.when(~has_pool, "reference_missing"),
        F.when(there & F.col("any_unclear"), "reference_applicability_unconfirmed"),
        F.when(there & F.col("any_unsound"), "reference_evidence_unresolved"),
        F.when(there & F.col("partly"), "reference_period_overlap"),
        F.when(there & ~F.col("any_approved"), "reference_approval_unconfirmed"),
        F.when(there & (n == 0), "reference_period_or_evidence_unresolved"),
        F.when(there & (applies > 1), "reference_ambiguous"),
        F.when(there & (n > 0) & (applies == 0), "replacement_period_conflict"),
    )
    blockers = F.array_sort(F.array_distinct(F.array_compact(F.concat(F.coalesce("structural", F.array().cast("array<string>")), reasons))))
    df = df.select("actual_id", "document_id", F.when(there & (applies == 1), F.col("one")).alias("reference_id"), blockers.alias("blockers"))
    status = F.when(F.col("reference_id").isNotNull() & (F.size("blockers") == 0), "READY").otherwise("CLARIFICATION_REQUIRED")
    return df.select("actual_id", "document_id", "reference_id", status.alias("status"), "blockers")
