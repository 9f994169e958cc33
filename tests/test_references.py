"""Reference documents: codes are shared by documents at any distance, and counts by day against all pairs."""

import random

from docengine import adapters
from docengine.operators import identify

DIR = "/root/testdata/sf0.001"
KEYS = ["stage", "code", "scope"]


def test_fifty_codes(spark):
    got = {r[0]: r[1] for r in adapters.revisions(spark, DIR).select("document_id", "code").distinct().collect()}
    assert got and all(code == str(document % 50) for document, code in got.items())


def test_counts_by_day_against_all_pairs(spark):
    r = random.Random(8)
    row = lambda k, stage: (k, r.choice([1, 2, 3, None]), stage, r.choice(["a", "b", None]), r.choice(["s", "t"]), r.choice([None, *range(-5, 60)]))
    works, references = [row(k, "RD") for k in range(150)], [row(1000 + k, r.choice(["RD", "PD"])) for k in range(60)] + [(2**62, 9, "RD", "c", "s", 7)]
    works.append((999, 8, "RD", "c", "s", -3))
    schema = "id long, document_id long, stage string, code string, scope string, day int"
    got = {x[0]: x[1:] for x in identify.resolved_near(spark.createDataFrame(works, schema), spark.createDataFrame(references, schema), KEYS, "document_id", 10).collect()}
    kinds = set()
    for k, document, stage, code, scope, day in works:
        found = [x[0] for x in references if None not in (document, x[1], code, day, x[5]) and x[2:5] == (stage, code, scope) and x[1] != document and abs(x[5] - day) <= 10]
        want = ("selected", found[0]) if len(found) == 1 else ("ambiguous" if found else "missing", None)
        kinds.add(want[0])
        assert got[k] == want, k
    assert kinds == {"selected", "ambiguous", "missing"} and len(got) == len(works)
