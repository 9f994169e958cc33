"""Exact comparison takes one pass through Python, not one for each step of arithmetic."""

from docengine.operators import exact as e
from docengine.queries import QUERIES


def test_one_python_step(spark):
    plan = QUERIES["D13_exact_comparison"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_texts_as_columns_read_them(spark):
    columns = ("value", "decimal", "source", "raw", "stated", "lower", "upper")
    x, y = (e.Side(**{c: f"{p}_{c}" for c in columns}) for p in "xy")
    one = ("1", "1", "value", "m", None, None, None)
    cases = [
        (("1 000,50", "1000.5", "row", " М ", "м", None, None), None),
        (("+1 000", "1000", "header", "M", None, None, None), None),
        (("1 00", "100", "row", "m", None, None, None), "numerical_value_evidence_mismatch"),
        (("1", "01", "row", "m", None, None, None), "numerical_value_invalid"),
        (("0", "-0", "row", "m", None, None, None), "numerical_value_invalid"),
        (("1", "1\n", "row", "m", None, None, None), "decimal_invalid"),
        (("1", "1", None, "m", None, None, None), "numerical_unit_origin_missing"),
        (("1", "1", "row", "  ", None, None, None), "numerical_unit_origin_missing"),
        (("1", "1", "missing", "m", None, None, None), "numerical_missing_unit_invalid"),
        (("1", "1", "row", "m", None, "1.", "2"), "decimal_invalid"),
        (("9" * 81, "9" * 81, "row", "m", None, None, None), "decimal_invalid"),
        (("1", None, "row", "m", None, None, None), "numerical_evidence_missing"),
    ]
    rows = [(i, *one, *c) for i, (c, _) in enumerate(cases)]
    df = spark.createDataFrame(rows, "i int, " + ", ".join(f"{p}_{c} string" for p in "xy" for c in columns))
    got = [r.detail for r in e.compared(df, e.ExactSpec("no_decrease", e.Policy("m")), x, y).orderBy("i").collect()]
    assert got == [d for _, d in cases]
