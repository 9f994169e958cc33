"""Behaviour that SQL doesn't cover: folds, trees, streams, parsers."""

import datetime
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from docengine.functions import text as t
from docengine.operators import compare as c
from docengine.operators import identify as i
from docengine.operators import metrics as m
from docengine.sources import markup
from docengine.streaming import jobs


def test_text_functions(spark):
    df = spark.createDataFrame([(" Ёлка  и   ДОМ ", "1 234,5 м2", "31.02.2024", "п"), (None, "нет", "2024-02-29", "р")], "a string, b string, c string, d string")
    r = df.select(t.normalised(F.col("a")), t.first_number(F.col("b")), t.calendar_date(F.col("c")), t.stage_code(F.col("d")), t.found_unit(F.col("b"), ["кв. м", "м2"]), t.decimal_input(F.lit("+1 234,50"))).collect()
    assert tuple(r[0]) == ("елка и дом", 1234.5, None, "PD", "m2", "1234.50")
    assert tuple(r[1]) == (None, None, datetime.date(2024, 2, 29), "RD", None, "1234.50")


def test_rounding(spark):
    df = spark.createDataFrame([("0.125",), ("-0.125",), ("0.135",)], "x string").select(F.col("x").cast("decimal(10,4)").alias("x"))
    got = [tuple(float(v) for v in r) for r in df.select(*[t.rounded(F.col("x"), 2, k) for k in ("half_up", "half_even", "toward_zero")]).collect()]
    assert got == [(0.13, 0.12, 0.12), (-0.13, -0.12, -0.12), (0.14, 0.14, 0.13)]


def test_unit_adoption_and_verdicts(spark):
    rows = [(1, 1, "expected", "extracted", 5.0, None), (1, 2, "expected", "extracted", 5.0, "m"), (1, 3, "actual", "extracted", 5.0, "m"), (2, 1, "expected", "extracted", 5.0, "m"), (2, 2, "expected", "extracted", 5.0, "km"), (3, 1, "actual", "extracted", 1.0, None), (4, 1, "expected", "ambiguous", 1.0, None), (4, 2, "unknown", "extracted", 1.0, None)]
    df = spark.createDataFrame(rows, "group_id long, extraction_id long, role string, status string, value double, unit string")
    assert {r.group_id: r.status for r in c.group_verdict(df, c.Spec("equals")).collect()} == {1: "match", 2: "expected_ambiguous", 3: "expected_missing", 4: "expected_missing"}


def test_spec_and_tree_limits():
    for bad in ({"kind": "other"}, {"kind": "threshold"}, {"kind": "numeric_delta", "tolerance_abs": -1}, {"kind": "threshold", "min": 2, "max": 1}):
        with pytest.raises(ValueError):
            c.Spec(**bad)
    leaf = c.Tree(leaf="a")
    with pytest.raises(ValueError):
        c.Tree("and", children=(leaf,)).check()
    deep = leaf
    for _ in range(6):
        deep = c.Tree("or", children=(deep, leaf))
    with pytest.raises(ValueError):
        deep.check()


def test_chains_with_cycle(spark):
    links = [(1, None), (2, 1), (3, 2), (4, 3), (5, 6), (6, 5), (7, 6)]
    got = {r.id: (r.root, r.depth, r.error) for r in i.chains(spark.createDataFrame(links, "id long, predecessor_id long")).collect()}
    assert [got[k] for k in (1, 2, 3, 4)] == [(1, 0, None), (1, 1, None), (1, 2, None), (1, 3, None)]
    assert all(got[k][2] == "cycle" for k in (5, 6, 7))


def test_chunks_admission_area(spark):
    df = spark.createDataFrame([(1, k, n) for k, n in enumerate([4, 5, 20, 3, 7])], "doc long, pos int, size int")
    assert [r.chunk for r in m.packed(df, "doc", "pos", "size", 10).orderBy("pos").collect()] == [0, 0, None, 1, 1]
    assert [r.pos for r in m.admitted(df, "doc", "pos", "size", 10).orderBy("pos").collect()] == [0, 1]
    boxes = spark.createDataFrame([(1, 0.0, 0.0, 2.0, 2.0), (1, 1.0, 1.0, 3.0, 3.0), (1, 1.0, 1.0, 2.0, 2.0)], "k long, x0 double, y0 double, x1 double, y1 double")
    assert m.union_area(boxes, "k").first().area == 7.0


def test_distances(spark):
    df = spark.createDataFrame([("кот", "код", "a b c", "a c d")], "a string, b string, c string, d string")
    assert m.character_errors(df, "a", "b").first().errors == 1
    assert df.select(m.word_distance("c", "d").alias("n")).first().n == 2


def test_xml_and_tables(spark):
    assert list(markup.xml_items('<a y="2" x="1"><b>t</b>tail<b/></a>')) == [("/a[1]/@x", "1"), ("/a[1]/@y", "2"), ("/a[1]/b[1]/text()[1]", "t"), ("/a[1]/b[1]/tail()", "tail"), ("/a[1]/b[2]/text()[1]", "")]
    for bad, why in (("<!DOCTYPE a><a/>", "declaration"), ("<a>", "syntax"), ("<a>" * 200 + "</a>" * 200, "depth")):
        with pytest.raises(ValueError, match=why):
            list(markup.xml_items(bad))
    cells = list(markup.table_cells("<table><tr><td rowspan=2>a<td>b</tr><tr><td>c</table><table><tr><td>x</td></tr><tr><td>y</td><td>z</td></tr></table>"))
    assert cells[:3] == [(0, 0, 0, 2, 1, "a", True), (0, 0, 1, 1, 1, "b", True), (0, 1, 1, 1, 1, "c", True)] and not cells[3][-1]
    df = spark.createDataFrame([(1, "<a>x</a>"), (2, "<a"), (3, None)], "k long, x string")
    assert sorted((r.key, r.value, r.error) for r in markup.read_xml(df, "k", "x").collect() if r.error is None) == [(1, "x", None)]


def _streamed(spark, rows, schema, build):
    with tempfile.TemporaryDirectory() as d:
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{d}/in")
        stream = spark.readStream.schema(schema).parquet(f"{d}/in")
        q = build(stream).writeStream.format("parquet").option("checkpointLocation", f"{d}/c").trigger(availableNow=True).start(f"{d}/out")
        q.awaitTermination()
        return spark.read.parquet(f"{d}/out").collect() if os.listdir(f"{d}/out") else []


def test_receipts_stream(spark):
    at = datetime.datetime(2024, 1, 1)
    rows = [("r1", "x", at), ("r1", "x", at), ("r2", "y", at)]
    got = _streamed(spark, rows, "request string, fp string, ts timestamp", lambda s: jobs.first_receipts(s, ["request"], "ts", "10 minutes"))
    assert sorted(r.request for r in got) == ["r1", "r2"]


def test_lease_stream(spark):
    rows = [(1, "a", "claim", 0, 0.0), (1, "b", "claim", 0, 10.0), (1, "b", "claim", 0, 70.0), (1, "a", "settle", 1, 80.0), (1, "b", "settle", 2, 90.0), (1, "c", "claim", 0, 100.0), (1, "d", "claim", 0, 500.0)]
    got = _streamed(spark, rows, "key_id long, owner string, action string, token long, at_s double", jobs.leases)
    assert [(r.owner, r.event) for r in sorted(got, key=lambda r: r.token)] and sorted((r.owner, r.event) for r in got) == sorted([("a", "granted"), ("b", "busy"), ("b", "granted"), ("a", "fenced"), ("b", "settled"), ("c", "granted"), ("d", "failed")])


def test_classification(spark):
    from docengine.operators import classify as k

    lines = ["Пояснительная  записка.", "x", "y", "z", "Приложение", "Акт испытания труб", "Шифр: АБ-1", "Период работ: 01.02.2024 по 2024-03-01", "Перечень видов скрытых работ", "1. Устройство сетей водоснабжения", "2) Монтаж колонн", "2) монтаж колонн", "текст", "ОБЩИЕ ДАННЫЕ", "3. Засыпка"]
    df = spark.createDataFrame([(1, n, x) for n, x in enumerate(lines)], "doc_id long, block_order int, raw_text string")
    assert [(r.stage, r.kind) for r in k.title_candidates(df).collect()] == [("PD", "Пояснительная записка")]
    assert tuple(k.classified(k.title_candidates(df)).first()) == (1, "PD", "Пояснительная записка", False)
    assert {(r.field, r.value) for r in k.fields(df).collect()} == {("code", "АБ-1"), ("works_from", "01.02.2024"), ("works_to", "2024-03-01")}
    assert [(r.title, r.list_kind) for r in k.list_items(df).orderBy("block_order").collect()] == [("Устройство сетей водоснабжения", "network_sections"), ("Монтаж колонн", "structures")]
    assert k.title_candidates(df.limit(0)).count() == 0


def test_sections(spark):
    from docengine.operators import sections as x

    rows = [(1, "reference", 0, 40), (1, "reference", 1, 40), (1, "actual", 0, 30), (1, "actual", 1, 500), (1, "actual", 2, 10)]
    got = x.packed_requests(spark.createDataFrame(rows, "batch long, role string, chunk int, size int"), 10, 100).collect()
    assert {(r.role, r.chunk): r.request for r in got} == {("reference", 0): 0, ("actual", 0): 0, ("reference", 1): 1, ("actual", 1): None, ("actual", 2): None}
    blocks = spark.createDataFrame([(1, k, "x" * 10, k / 20) for k in range(20)], "doc_id long, block_order int, raw_text string, y0 double")
    anchors = blocks.filter("block_order in (5, 10)")
    assert sorted((r.anchor, r.block_order) for r in x.expansions(blocks, anchors, 2, 30).collect()) == [(5, 3), (5, 4), (5, 5), (10, 8), (10, 9), (10, 10)]
    assert x.context_windows(blocks, anchors, 1).count() == 6
    parts = spark.createDataFrame([(1, "a"), (2, "")], "id long, text string")
    out = {r.id: (r.answer, r.error) for r in x.answered(parts, lambda t: t[0].upper()).collect()}
    assert out == {1: ("A", None), 2: (None, "IndexError")}


def test_extraction(spark):
    from docengine.operators import extract as e

    rows = [(1, 0, 1, "Общая площадь"), (1, 1, 1, "4 850,5 м2"), (2, 0, 1, "общая  ПЛОЩАДЬ 10 м2"), (2, 1, 2, "общая площадь 11 м2"), (3, 0, 1, "нет")]
    blocks = spark.createDataFrame(rows, "doc_id long, block_order int, page_number int, raw_text string")
    plan = e.RegexPlan("area", ("общая площадь",), r"(\d[\d ]*(?:,\d+)? м2)", 1, units=("м2",))
    docs = spark.createDataFrame([(1,), (2,), (3,)], "doc_id long")
    assert {r.doc_id: (r.outcome, r.value) for r in e.run_rules(docs, blocks, [plan]).collect()} == {1: ("extracted", "4850.5"), 2: ("ambiguous", None), 3: ("no_evidence", None)}
    first = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, page_number int")
    assert {r.doc_id: r.value for r in e.run_on_pages(docs, blocks, first, [plan]).collect()} == {1: "4850.5", 2: "10.0", 3: None}
    assert [r.term for r in e.missing_anchors(blocks, ["площадь", "объем"]).collect()] == ["объем"]
    cells = spark.createDataFrame([(1, 0, 0, "Показатель"), (1, 1, 0, "Площадь"), (1, 1, 1, "12,5"), (1, 1, 2, "м2"), (2, 0, 0, "Площадь"), (2, 0, 1, "7")], "t long, row int, col int, text string")
    assert [tuple(r) for r in e.table_lookup(cells, "t", ["показатель", "площадь"], "площадь", 2).collect()] == [(1, 2, 1, 12.5)]
    x = spark.createDataFrame([("1) 5",), ("12 345,6 м",), ("a1 2",), ("3 и 4",)], "x string")
    assert [r[0] for r in x.select(e.strict_number(F.col("x"))).collect()] == [None, "12345.6", "2", "3"]
    assert [r[0] for r in x.select(e.strict_number(F.col("x"), single=True)).collect()][3] is None
    with pytest.raises(ValueError):
        e.RegexPlan("c", (), "x")
