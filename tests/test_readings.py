"""Reconciled readings case by case and against a brute-force version on random pages."""

import random

from docengine.operators import readings as r

SCHEMA = "page int, source string, id long, x0 double, y0 double, x1 double, y1 double, text string, valid boolean, hidden boolean, reasons string"


def row(page, source, id_, box, text, valid=True, hidden=False):
    return (page, source, id_, *box, text, valid, hidden, "clash")


def brute(rows, include_hidden=False):
    """{(page, source, id): (in_main, status, reasons)}, one reading after the other."""
    out, pages = {}, {}
    for x in rows:
        pages.setdefault(x[0], []).append(x)
    for page, own in pages.items():
        items = [{"source": x[1], "id": x[2], "box": x[3:7], "key": x[7], "valid": x[8], "main": not (x[9] and x[1] == "native"), "status": "selected", "why": set()} for x in own]

        def same_ink(a, b):
            (a0, a1, a2, a3), (b0, b1, b2, b3) = a["box"], b["box"]
            common = max(0, min(a2, b2) - max(a0, b0)) * max(0, min(a3, b3) - max(a1, b1))
            return common / min((a2 - a0) * (a3 - a1), (b2 - b0) * (b3 - b1)) >= 0.5

        def greedy(some, conflict, duplicate, retained):
            kept = []
            for item in some:
                met = [o for o in kept if same_ink(item, o)]
                if not met:
                    kept.append(item)
                    continue
                same = all(o["key"] == item["key"] for o in met)
                item["main"] = False
                item["why"] = {duplicate if same else conflict}
                for o in met:
                    o["why"].add(retained if same else conflict)
                if not same:
                    for o in [item, *met]:
                        o["main"], o["status"] = False, "ambiguous"
            return kept

        items.sort(key=lambda x: x["id"])
        for x in items:
            if x["source"] == "native" and not x["valid"]:
                x["main"], x["status"], x["why"] = False, "ambiguous", {"NATIVE_TEXT_UNUSABLE"}
        native = [x for x in items if x["source"] == "native" and x["valid"] and (x["main"] or include_hidden)]
        shown = [x["main"] for x in native]
        for x in native:
            x["main"] = True
        kept = [x for x in greedy(native, "NATIVE_TEXT_CONFLICT", "DUPLICATE_NATIVE_READING", "NATIVE_DUPLICATE_ALTERNATIVE_RETAINED") if x["status"] == "selected"]
        disputed = [x for x in native if "NATIVE_TEXT_CONFLICT" in x["why"]]
        for x, was in zip(native, shown, strict=True):
            x["main"] &= was
        rest = []
        for item in (x for x in items if x["source"] == "ocr"):
            if any(same_ink(item, o) for o in disputed):
                item["main"], item["status"], item["why"] = False, "ambiguous", {"NATIVE_CONFLICT_UNRESOLVED"}
                continue
            met = [o for o in kept if same_ink(item, o)]
            if not met:
                rest.append(item)
                continue
            same = len(met) == 1 and met[0]["key"] == item["key"]
            why = "DUPLICATE_OCR_READING" if same else "NATIVE_OCR_TEXT_CONFLICT"
            item["main"], item["status"], item["why"] = False, "selected" if same else "ambiguous", {why}
            for o in met:
                o["why"].add(why)
        greedy(rest, "OCR_TEXT_CONFLICT", "DUPLICATE_OCR_READING", "DUPLICATE_OCR_READING")
        out |= {(page, x["source"], x["id"]): (x["main"], x["status"], sorted(x["why"])) for x in items}
    return out


def got(spark, rows, **how):
    df = spark.createDataFrame(rows, SCHEMA)
    return {(x.page, x.source, x.id): (x.in_main, x.status, x.reasons) for x in r.reconciled(df, **how).collect()}


def test_cases(spark):
    a, b, wide, far = (0.1, 0.1, 0.3, 0.2), (0.11, 0.1, 0.31, 0.2), (0.1, 0.1, 0.9, 0.2), (0.6, 0.6, 0.7, 0.7)
    rows = [
        row(1, "native", 1, a, "50 m3"), row(1, "ocr", 1, b, "50 m3"), row(1, "ocr", 2, far, "x"),
        row(2, "native", 1, a, "50 m3"), row(2, "ocr", 1, wide, "50 m3 and more"),
        row(3, "native", 1, a, "�", valid=False), row(3, "ocr", 1, b, "50"),
        row(4, "ocr", 1, a, "7"), row(4, "ocr", 2, b, "7"), row(4, "ocr", 3, far, "8"), row(4, "ocr", 4, far, "9"),
        row(5, "native", 1, a, "1"), row(5, "native", 2, b, "2"), row(5, "ocr", 1, a, "1"),
        row(6, "native", 1, a, "1", hidden=True), row(6, "ocr", 1, a, "2"),
        row(7, "native", 1, (0.2, 0.2, 0.2, 0.3), "1"), row(7, "ocr", 1, (None, 0.0, 1.0, 1.0), "2"), row(7, "native", 2, a, ""), row(7, "native", 3, a, None),
    ]
    res = got(spark, rows)
    assert res == brute([x for x in rows if x[0] < 7]) | {(7, "native", 1): (False, None, []), (7, "ocr", 1): (False, None, []), (7, "native", 2): (False, None, []), (7, "native", 3): (False, None, [])}
    assert res[1, "native", 1] == (True, "selected", ["DUPLICATE_OCR_READING"]) and res[1, "ocr", 2][0]
    assert res[5, "ocr", 1] == (False, "ambiguous", ["NATIVE_CONFLICT_UNRESOLVED"]) and res[6, "ocr", 1] == (True, "selected", [])
    assert got(spark, rows[:16], include_hidden=True) == brute(rows[:16], include_hidden=True)
    assert got(spark, []) == {}


def test_random_pages(spark):
    g = random.Random(9)
    rows = []
    for page in range(8):
        for id_ in range(40):
            w, h = 2 ** g.uniform(-5, -1), 2 ** g.uniform(-6, -2)
            x, y = g.randrange(6) / 8 + g.uniform(0, 0.05), g.randrange(6) / 8 + g.uniform(0, 0.05)
            rows.append(row(page, g.choice(["native", "ocr"]), id_, (x, y, x + w, y + h), g.choice("ab"), g.random() < 0.9, g.random() < 0.1))
    want = brute(rows)
    assert got(spark, rows) == want
    assert len({x[0:2] + (tuple(x[2]),) for x in want.values()}) > 8


def test_query_over_the_smallest_table(spark):
    from docengine.plans.geometry import d35, page_readings

    d = "/root/testdata/sf0.001"
    rows = [(x.page, x.source, x.id, x.x0, x.y0, x.x1, x.y1, x.text, x.valid, x.hidden) for x in page_readings(spark, d).collect()]
    found = {(x.page, x.source, x.id): (x.in_main, x.status, x.reasons) for x in d35(spark, d).collect()}
    want = brute([x for x in rows])
    assert found == {k: (m, s, ",".join(w)) for k, (m, s, w) in want.items()}
    assert len({w for _, _, w in found.values()}) > 8
