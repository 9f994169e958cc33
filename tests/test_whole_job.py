"""Queries that cover all of their input, not a part of it."""

import random
import re
from collections import Counter

from docengine.operators import metrics
from docengine.queries import QUERIES
from docengine.session import table

DIR = "/root/testdata/sf0.001"


def test_tables_of_all_orders(spark):
    got = QUERIES["S8_generated_tables"](spark, DIR).agg({"key": "count", "n": "sum"}).first()
    lines = table(spark, DIR, "lineitem")
    assert tuple(got) == (lines.select("l_orderkey").distinct().count(), lines.count())


def plain_distance(x, y):
    row = list(range(len(y) + 1))
    for i, u in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, v in enumerate(y, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (u != v))
    return row[-1]


def test_distances_of_whole_texts(spark):
    r = random.Random(2)
    texts = [["".join(r.choice("abö ") for _ in range(r.choice((0, 5, 70, 300)))) for _ in range(2)] for _ in range(40)]
    long = "".join(r.choice("abcd ") for _ in range(400))
    texts += [(long, long[:390] + "zzzz"), (long, "x" + long[1:200] + long[210:]), ("", ""), ("", "a b")]
    df = spark.createDataFrame(texts, "a string, b string")
    got = df.select("a", "b", metrics.character_distance("a", "b").alias("c"), metrics.word_distance("a", "b").alias("w")).collect()
    for row in got:
        assert (row.c, row.w) == (plain_distance(row.a, row.b), plain_distance(row.a.split(), row.b.split()))


def test_errors_cover_whole_documents(spark):
    docs = table(spark, DIR, "documents").filter("text is not null").select("text").collect()
    chars = QUERIES["A24_character_errors"](spark, DIR).agg({"chars": "sum"}).first()[0]
    words = QUERIES["A24_word_errors"](spark, DIR).agg({"words": "sum"}).first()[0]
    assert chars == sum(len(r.text) - r.text.count("\n") for r in docs)
    assert words == sum(len(re.findall(r"[^ \t-\r]+", r.text)) for r in docs)


def test_boxes_matched_one_to_one(spark):
    pages = {}
    for r in table(spark, DIR, "lineitem").collect():
        x, y = r.l_discount * 5, r.l_tax * 8
        pages.setdefault(r.l_suppkey, {"F": [], "O": []})[r.l_linestatus].append((r.l_orderkey * 10 + r.l_linenumber, x, y, x + r.l_quantity / 100, y + 0.2))
    want = Counter()
    for page, sides in pages.items():
        actual = sorted(sides["O"])
        for i, *p in sorted(sides["F"]):
            for k, (o, *q) in enumerate(actual):
                both = max(min(p[2], q[2]) - max(p[0], q[0]), 0.0) * max(min(p[3], q[3]) - max(p[1], q[1]), 0.0)
                if both / ((p[2] - p[0]) * (p[3] - p[1]) + (q[2] - q[0]) * (q[3] - q[1]) - both) >= 0.5:
                    want[page, i, o] += 1
                    del actual[k]
                    break
    got = Counter((r.page, r.id, r.other) for r in QUERIES["J23_one_to_one"](spark, DIR).collect())
    assert want and got == want


def test_whole_items_are_cited(spark, tmp_path):
    items = [(1, "one two three four five\nsix seven"), (2, "tiny"), (3, "a b c d e"), (4, "one two three four five\nsix other"), (5, None)]
    docs = [(1, "x\ny one two three four five\nsix sevenfold"), (2, "one two three four five\nsix"), (3, "za b c d e"), (4, "so tinyish"), (5, None), (6, "a b c d e")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {tuple(r) for r in QUERIES["J36_cited_quotes"](spark, str(tmp_path)).collect()} == {(1, 1), (2, 4), (3, 6)}


def test_windows_hold_whole_lines(spark, tmp_path):
    lines = ["a first line of more than twelve characters", "a second line, rather long as well", "the third"]
    spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    column = lambda q, c: [r[c] for r in QUERIES[q](spark, str(tmp_path)).orderBy("block_order").collect()]
    assert column("W2_preceding", "context") == ["", lines[0], " ".join(lines[:2])]
    assert column("W3_joined_title", "joined") == [" ".join(lines[:2]), " ".join(lines[1:]), lines[2]]
    assert column("W5_following", "window") == ["\n".join(lines[k:]) for k in range(3)]


def test_all_reasons_and_ends(spark, tmp_path):
    orders = [(k, 1, "F", f"{k % 5 + 1}-P") for k in range(8)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, "\n".join("abc" for _ in range(71)))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["A18_candidate_merge"](spark, str(tmp_path)).first()
    assert (got.reasons, got.evidence) == ("1-P,2-P,3-P,4-P,5-P", "0,1,2,3,4,5")
    ends = QUERIES["W12_look_ahead"](spark, str(tmp_path)).filter("block_order in (1, 70, 71)").collect()
    assert sorted((r.block_order, r.end) for r in ends) == [*[(1, e) for e in (1, 2, 3, 5, 9, 17, 33, 65, 71)], (70, 70), (70, 71), (71, 71)]
