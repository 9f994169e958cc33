import random

import numpy as np
from pyspark.sql import functions as F

from docengine.llm import secrets, topk, urls


def brute(rows, k):
    good = [(i, [int(np.floor(256 * np.float64(x))) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in good if i % 50 == 0}):
        v = min(w for i, w in good if i == q)
        s = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in good if i != q)
        out += [(q, r + 1, i, -t) for r, (t, i) in enumerate(s[:k])]
    return out


def test_topk(spark):
    r = np.random.default_rng(4)
    rows = [(int(i), [float(np.float32(x)) for x in r.standard_normal(8)]) for i in range(700)]
    rows += [(i, [0.5] * 8) for i in range(700, 1000)]  # equal vectors: ties go to the smaller id
    rows += [(2000, None), (2050, [1.0, None] + [0.0] * 6), (2001, [float("nan")] * 8), (2002, [float("inf")] + [0.0] * 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("cell", F.lit(1))
    for first in (8, 512):
        got = topk.top_k(df, F.col("vec_id") % 50 == 0, k=5, first=first)
        assert sorted(map(tuple, got.collect())) == brute(rows, 5)
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, topk.top_k(few, F.col("vec_id") % 50 == 0).collect())) == brute(rows[:3], 5)
    assert topk.top_k(df.limit(0), F.lit(True)).count() == 0


def test_urls(spark):
    pages = [
        (1, "https://WWW.Example.com/en/1?x#y"), (2, "http://a.example.com/en/2"), (3, "http://example.net/es/"), (4, "http://b.net/de/"), (5, None), (6, "no scheme"), (7, "ftp://bad.org"), (8, "http://good.org/p"),
        (9, "http://x.com"), (10, "http://example.community/"), (11, "http://notexample.com/en/"), (12, "a://b.org/c://d"),
    ]
    df = spark.createDataFrame([(*p, "clash") for p in pages] + [(1, pages[0][1], "")], "page_id long, url string, mean string")
    outcomes = spark.createDataFrame([("bad.org", 0)] * 40 + [("good.org", 1)] * 40 + [("worse.org", 0)] * 3, "host string, good int")
    got = {r.page_id: r for r in urls.judge(df, outcomes).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert (got[2].rule, got[2].verdict) == ("example.com/en/", "block")
    assert (got[3].rule, got[3].verdict) == ("net/es/", "block") and got[4].rule is None
    assert [(got[i].host, got[i].path) for i in (5, 6, 7)] == [("", ""), ("", ""), ("bad.org", "")]
    assert got[7].verdict == "block" and got[8].verdict == "allow" and got[9].rule is None
    assert got[10].rule is None and got[11].rule == "com/" and got[12].host == "b.org" and got[12].path == "/c://d"
    assert urls.judge(df, outcomes.limit(0)).filter("rule is null and verdict = 'block'").count() == 0


def test_secrets_positions_and_links(spark):
    key = "AKIA" + "A1B2C3D4E5F6G7H8"
    token = "Zx9" * 12
    texts = [
        None, "", f"🎉é password = 'secret12' {key}", f"user@host.com then {token}", f"{token}", f"user@host.com {'x ' * 300}{token}", "token=abc", "api-key: x API_KEY=longvalue9", "token=token:abcdefg",
        "deadbeef" * 4, f"https://db.example.com/x {token} {token}", "a" * 3000,
    ]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(3, texts[3], 2), (3, "other", 3)], "doc_id long, text string, h int")
    rows = secrets.scan(df).collect()
    assert len(rows) == len(texts) + 2
    got = {r.doc_id: [(s.start, s.kind, s.end) for s in r.spans] for r in rows if r.doc_id != 3}
    assert got[0] == [] and got[1] == []
    assert got[2] == [(3, 0, 23), (25, 1, 45)]
    assert sorted(len(r.spans) for r in rows if r.doc_id == 3) == [0, 2, 2]
    assert got[4] == [] and got[5] == [] and got[6] == []
    assert got[7] == [(11, 0, 29)] and got[8] == [] and got[9] == [(0, 2, 32)]
    assert [k for _, k, _ in got[10]] == [5, 3, 3]
    clean = {r.doc_id: r.text for r in secrets.redacted(df.filter("doc_id <> 3")).collect()}
    assert clean[2] == "🎉é [SECRET]' [SECRET]" and clean[0] is None and clean[4] == token
    assert secrets.scan(df.limit(0)).count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(1)
    text = lambda n: " ".join("".join(r.choice("aeiorst") for _ in range(5)) for _ in range(n))
    item = text(30)
    rows = [(i, text(60), "en", "s", 1) for i in range(60)]
    rows += [(70, rows[3][1], "en", "s", 1), (71, rows[4][1] + " " + item, "en", "s", 1), (72, rows[5][1] + " password=hunter22 end", "en", "s", 1), (73, None, "en", "s", 1)]
    rows += [(80 + i, text(50) + " vile scumbag rotten", "en", "s", 1) for i in range(20)]
    d = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 0) for i in range(60)] + [(80 + i, 1) for i in range(15)], "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, d)
        kept.append({x.doc_id for x in docs.select("doc_id").collect()})
    every = {x[0] for x in rows}
    assert kept[0] == every - set(range(80, 100))
    assert kept[1] == kept[0] - {70, 72} and kept[2] == kept[1] - {71}  # 72 differs from 5 by two words
    assert kept[3] == kept[2] == kept[4]
    out = docs.collect()
    assert all(x.round_trip and len(x.ids) == x.n_tokens for x in out)
    assert {x.doc_id for x in corpus_pipeline.run(spark, d).collect()} == kept[4]
