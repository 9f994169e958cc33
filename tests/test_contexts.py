"""Contexts case by case, and replacement chains."""

import datetime

import pytest

from docengine.operators import contexts as c

SCHEMA = "revision_id string, document_id string, stage string, code string, reference_code string, scope string, works_from date, works_to date, reference_revision_id string, confirmed boolean, effective_from date, effective_to date, replaces_id string, structural array<string>, blockers string"


def on(m, d=1):
    return datetime.date(2025, m, d)


def rd(id_, **more):
    return {"revision_id": id_, "document_id": f"d-{id_}", "stage": "RD", "code": "C-1", "reference_code": None, "scope": "Block A", "works_from": None, "works_to": None, "reference_revision_id": None, "confirmed": True, "effective_from": on(1), "effective_to": None, "replaces_id": None, "structural": [], "blockers": "clash"} | more


def actual(**more):
    return rd("act", stage="ID", code="X", reference_code=" c-1 ", scope="block  a", works_from=on(3), works_to=on(4)) | more


CASES = {
    "ready": ([actual(), rd("r1"), rd("r2", stage="PD"), rd("r3", scope="other")], "r1", ""),
    "explicit": ([actual(reference_revision_id="r1", reference_code=None), rd("r1", stage="PD")], "r1", ""),
    "not there": ([actual(reference_revision_id="zz")], None, "reference_missing,reference_not_in_snapshot"),
    "itself": ([actual(reference_revision_id="act")], None, "reference_missing,reference_not_in_snapshot"),
    "stage": ([actual(reference_revision_id="r1"), rd("r1", stage="ID")], None, "reference_missing,reference_stage_invalid"),
    "scope": ([actual(reference_revision_id="r1"), rd("r1", scope="b")], None, "reference_missing,reference_scope_mismatch"),
    "no code": ([actual(reference_code=" "), rd("r1")], None, "reference_link_unconfirmed,reference_missing"),
    "nothing known": ([actual(stage=None, scope=None, confirmed=None, works_from=None)], None, "actual_approval_unconfirmed,reference_missing,scope_unresolved,stage_unresolved,works_period_unresolved"),
    "two": ([actual(), rd("r1"), rd("r2")], None, "reference_ambiguous"),
    "unconfirmed": ([actual(), rd("r1", confirmed=False)], None, "reference_applicability_unconfirmed,reference_approval_unconfirmed,reference_period_or_evidence_unresolved"),
    "partly": ([actual(), rd("r1", effective_to=on(3, 15))], None, "reference_period_or_evidence_unresolved,reference_period_overlap"),
    "unreadable": ([actual(), rd("r1", structural=["source_unreadable"])], None, "reference_evidence_unresolved,reference_period_or_evidence_unresolved"),
    "own fault": ([actual(structural=["source_unreadable"]), rd("r1")], "r1", "source_unreadable"),
    "replaced later": ([actual(), rd("r1", document_id="d"), rd("r2", document_id="d", replaces_id="r1", effective_from=on(6))], "r1", ""),
    "replaced within": ([actual(), rd("r1", document_id="d"), rd("r2", document_id="d", replaces_id="r1", effective_from=on(3, 10))], None, "reference_period_overlap,replacement_period_conflict"),
    "replaced before": ([actual(), rd("r1", document_id="d"), rd("r2", document_id="d", replaces_id="r1", effective_from=on(2))], "r2", ""),
    "other stage of the document": ([actual(), rd("r1", document_id="d"), rd("r9", document_id="d", stage=None)], "r1", "reference_applicability_unconfirmed"),
    "scope of the document unknown": ([actual(), rd("r1", document_id="d"), rd("r9", document_id="d", scope="")], "r1", "reference_applicability_unconfirmed"),
    "period turned round": ([actual(works_from=on(5)), rd("r1")], None, "works_period_unresolved"),
}


def test_cases(spark):
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    rows = []
    for n, (case, _, _) in enumerate(CASES.values()):
        for r in case:  # ids and scopes of each case are its own, so that all cases go in one table
            own = dict(r)
            for k in ("revision_id", "document_id", "reference_revision_id", "replaces_id"):
                own[k] = own[k] and f"{n}-{own[k]}"
            for k in ("code", "reference_code"):
                own[k] = own[k] and own[k].strip() and f"{n} {own[k].strip()}"
            rows.append(tuple(own[k] for k in names))
    got = {r.actual_id: r for r in c.contexts(spark.createDataFrame(rows, SCHEMA)).collect()}
    for n, (name, (_, reference, blockers)) in enumerate(CASES.items()):
        r = got[f"{n}-act"]
        assert (r.reference_id and r.reference_id.split("-")[1], ",".join(r.blockers)) == (reference, blockers), name
        assert r.status == ("READY" if reference and not blockers else "CLARIFICATION_REQUIRED")
    assert c.contexts(spark.createDataFrame([], SCHEMA)).count() == 0


def test_replacement_chains(spark):
    same = {"document_id": "d"}
    rows = [rd("a0", **same)] + [rd(f"a{i}", replaces_id=f"a{i - 1}", **same) for i in range(1, 20)]
    rows += [rd("b1", replaces_id="none", **same), rd("b2", replaces_id="b1", **same), rd("b3", replaces_id="a3", document_id="other"), rd("b4", replaces_id="a3", scope="x", **same), rd("b5", replaces_id="a3", stage="PD", **same)]
    rows += [rd("c1", replaces_id="a0", confirmed=False, **same), rd("c2", replaces_id="c1", **same), rd("c3", replaces_id="c2", effective_from=on(1), effective_to=datetime.date(2024, 1, 1), **same)]
    rows += [rd("e1", replaces_id="a0", effective_from=datetime.date(2024, 1, 1), **same), rd("e2", replaces_id="e1", **same)]
    rows += [rd(f"z{i}", replaces_id=f"z{(i + 1) % 5}", **same) for i in range(5)] + [rd("y", replaces_id="z0", **same)]
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    df = spark.createDataFrame([tuple(r[k] for k in names) for r in rows], SCHEMA)
    got = {r.revision_id: r.problem for r in c.replacement_errors(df).collect()}
    invalid, unconfirmed = "replacement_target_invalid", "replacement_unconfirmed"
    want = dict.fromkeys(("b1", "b2", "b3", "b4", "b5"), invalid) | dict.fromkeys(("c1", "c2", "c3"), unconfirmed) | dict.fromkeys(("e1", "e2"), "replacement_period_invalid") | dict.fromkeys([*(f"z{i}" for i in range(5)), "y"], "replacement_cycle")
    assert got == want


@pytest.mark.parametrize("text, key", [(" Block \t A ", "block a"), (None, ""), ("", "")])
def test_text_key(spark, text, key):
    from pyspark.sql import functions as F

    assert spark.createDataFrame([(text,)], "x string").select(c.text_key(F.col("x"))).first()[0] == key
