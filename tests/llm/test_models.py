import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docengine.llm import html, langid, toxicity


def prose(r, letters, n):
    return " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 7))) for _ in range(n))


def test_toxicity(spark):
    r = random.Random(1)
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        text = prose(r, "aeiorst", r.randint(20, 60))
        if toxic:
            text += " " + " ".join(r.sample(["vile", "scumbag", "rotten"], r.randint(1, 3))) + "."
        rows.append((i, text, 9))
        if i % 3:
            labels.append((i, int(toxic)))
    rows += [(900, None, 9), (901, "", 9), (902, "!!! ...", 9), (0, rows[0][1], 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, y int")
    model = toxicity.fit(docs, spark.createDataFrame([*labels, (5, None)], "doc_id long, toxic int"))
    assert (np.diff(model.thetas) > 0).all()
    out = toxicity.severity(docs, model).collect()
    assert len(out) == len(rows)
    held = [x for x in out if x.doc_id < 400 and x.doc_id % 3 == 0]
    assert np.mean([x.toxic == (x.doc_id % 4 == 0) for x in held]) > 0.95
    assert all(x.severity == 0 and not x.toxic for x in out if x.doc_id >= 900)
    assert all(0 <= x.severity <= 2 and 0 <= x.p_toxic <= 1 for x in out)


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    for labels in ([], [(1, 0)]):
        model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert model is None and not toxicity.severity(docs, model).first().toxic
    clash = docs.withColumn("grade", F.lit(7)).withColumn("Toxic", F.lit("x"))
    assert toxicity.severity(clash, None).first().grade == 0
    assert toxicity.without_toxic(clash, None).first().grade == 7


def test_langid(spark):
    r = random.Random(2)
    letters = {"aa": "abcdefg ", "bb": "hijklmn ", "cc": "opqrstu ", "dd": "éüößñ "}
    rows = [(i, prose(r, letters[k], r.randint(3, 40)), k, "src") for i in range(400) for k in [sorted(letters)[i % 4]]]
    rows += [(1000, None, "aa", ""), (1001, "", "aa", ""), (1002, "123 ... !", "bb", ""), (1003, "日本", None, ""), (1004, rows[2][1] * 400, None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = langid.fit(df, F.col("doc_id") % 3 != 1)
    out = {x.doc_id: x for x in langid.predict(df, model).collect()}
    assert np.mean([out[i].lang_pred == out[i].lang for i in range(1, 400, 3)]) > 0.97
    assert all(out[i].lang_pred == "und" and out[i].score == 0 for i in (1000, 1001, 1002))
    assert out[1003].lang_pred != "und" and out[1004].lang_pred == "cc"
    assert all(0 <= x.score <= 1 for x in out.values())
    assert langid.predict(df, langid.fit(df, F.lit(False))).filter("lang_pred <> 'und'").count() == 0
    assert langid.fit(df, F.col("lang") == "aa") == "aa"


def test_codewords():
    for k in (2, 4, 6, 9):
        w = langid.codewords(k)
        assert len({tuple(x) for x in w.tolist()}) == k
        assert min((w[i] != w[j]).sum() for i in range(k) for j in range(i)) >= max(1, 2 ** max(0, min(k, 6) - 2) // 2)


def test_blocks():
    page = '<body><nav><ul><li>A<li>B &amp; C</ul></nav><script>var t="</p>";</script><article><h1>T</h1><p><b>x  y<br><p>z\n&#233;</p>tail</article><!-- c --><div>end'
    assert [b.text for b in html.blocks(page)] == ["A", "B & C", "T", "x y", "z é", "tail", "end"]
    assert html.blocks("") == [] and html.blocks("<p>") == []
    assert [b.text for b in html.blocks("plain < text")] == ["plain < text"]


def test_gradients():
    own = html.Labeller(hidden=3)
    own.start(1)
    own.weights = {k: v.astype(float) for k, v in own.weights.items()}
    r = np.random.default_rng(0)
    x, mask = r.standard_normal((4, 2, html.DIMS)), np.array([[1, 1], [1, 1], [1, 0], [1, 0.0]])
    y = r.integers(0, 2, (4, 2)).astype(float)

    def loss():
        p = own.forward(x, mask)
        return -(mask * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / mask.sum()

    for name, g in own.gradients(x, mask, y).items():
        w = own.weights[name].reshape(-1)
        i = int(np.abs(g).argmax())
        kept = w[i]
        w[i] = kept + 1e-4
        high = loss()
        w[i] = kept - 1e-4
        low = loss()
        w[i] = kept
        assert abs((high - low) / 2e-4 - g.reshape(-1)[i]) < 1e-4


def test_html(spark):
    pages = [(i, f"http://x/{i}", html._generated(20000 + i)[0]) for i in range(30)] + [(100, None, None), (101, "u", ""), (102, "u", "<div class=ad>buy</div>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    own = html.train(df, sample=10, generated=500)
    good = total = 0
    for seed in range(30000, 30100):
        text, main = html._generated(seed)
        found = html.blocks(text)
        p = own.judge([html.vectors(found)])[0]
        good += sum((x >= 0.5) == (b.text in main) for b, x in zip(found, p, strict=True))
        total += len(found)
    assert good / total > 0.97
    out = {r.page_id: r for r in html.extract(df, own).collect()}
    assert len(out) == 33 and out[100].text == "" and out[101].text == "" and "html" not in out[100].asDict()


def test_html_keeps_clashing_tables(spark):
    own = html.Labeller(hidden=2)
    own.start(1)
    df = spark.createDataFrame([(1, "<p>a</p>", "x", 3), (2, None, "y", 4)], "page_id long, html string, Text string, n_blocks int")
    out = {r.page_id: r for r in html.extract(df, own).collect()}
    assert out[1].n_blocks == 1 and out[2].text == "" and html.extract(df, own).columns == ["page_id", "text", "n_blocks"]
    assert html.extract(df.limit(0), own).count() == 0
