import random

import numpy as np
import pytest

from docengine.llm.substrings import COVER, PERIOD, CoverRanks, brute_force, remove_repeated, sliding


def make(seed):
    r = random.Random(seed)
    alphabet = ["a", "b", "é", " ", "\n"]
    text = lambda n: "".join(r.choice(alphabet) for _ in range(n))
    pieces = [text(r.randint(10, 60)) for _ in range(6)]
    docs = []
    for _ in range(60):
        parts = [text(r.randint(0, 30))]
        for _ in range(r.randint(0, 3)):
            p = r.choice(pieces)
            a = r.randint(0, len(p) // 2)
            parts += [p[a : r.randint(a, len(p))], text(r.randint(0, 20))]
        docs.append("".join(parts))
    return [*docs, docs[0], docs[0], "a" * 200, "ab" * 90, "", None, "é" * 15]


@pytest.mark.parametrize(("hot", "chunk"), [(1 << 14, 1 << 20), (2, 1 << 20), (1 << 14, 60), (2, 200)])
def test_against_brute_force(spark, hot, chunk):
    texts = make(hot + chunk)
    rows = [(i, t, 0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(3)
    got = {r.doc_id: r for r in remove_repeated(df, length=30, block=9, hot=hot, chunk=chunk, bucket_rows=8).collect()}
    data = [(t or "").encode() for t in texts]
    want = brute_force(data, 30)
    assert len(got) == len(rows) and any(want)
    for i, spans in enumerate(want):
        assert [(s.start, s.stop) for s in got[i].removed] == spans, (i, data[i])
        gone = {k for a, b in spans for k in range(a, b)}
        assert bytes(got[i].kept) == bytes(c for k, c in enumerate(data[i]) if k not in gone)


def test_repeated_ids_and_empty(spark):
    t = "x" * 10 + "".join(chr(97 + i % 26) for i in range(40))
    df = spark.createDataFrame([(1, t), (1, t), (1, "other text " * 3), (None, t[5:])], "doc_id long, text string")
    out = remove_repeated(df, length=30, block=9).collect()
    assert len(out) == 4 and sum(r.n_bytes == 50 and len(r.removed) == 1 and r.kept == b"" for r in out) == 2
    assert remove_repeated(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sliding():
    x = np.random.default_rng(0).integers(0, 50, 101).astype(np.uint64)
    for w in (1, 7, 50, 101):
        assert (sliding(x, w, np.minimum) == [x[i : i + w].min() for i in range(102 - w)]).all()
    assert len(sliding(x, 102, np.minimum)) == 0


def test_cover():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))


@pytest.mark.parametrize("length", [26, 60, 200])
def test_cover_ranks_are_exact(length):
    r = np.random.default_rng(length)
    width = -(-(length + 40) // PERIOD) * PERIOD
    slots = r.integers(0, 2, (8, width)).astype(np.uint8)[r.integers(0, 8, 60)]
    slots[np.arange(60), r.integers(0, width, 60)] ^= r.integers(0, 2, 60).astype(np.uint8)
    cover, every = CoverRanks(slots, length), np.arange(60)
    for column in range(width - length + 1):
        names = cover.block(column, length, every)
        texts = [slots[i, column : column + length].tobytes() for i in every]
        assert len(set(zip(names.tolist(), texts, strict=True))) == len(set(texts)) == len(set(names.tolist()))


def test_long_text_in_pieces(spark):
    r = random.Random(5)
    long = "".join(r.choice("abcdefgh ") for _ in range(3000))
    texts = [long + "x" + long[700:1500] + "".join(r.choice("ijk") for _ in range(500)), "z" * 20 + long[40:90]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: [(s.start, s.stop) for s in x.removed] for x in remove_repeated(df, length=40, block=13, chunk=300).collect()}
    assert [got[i] for i in range(2)] == brute_force([t.encode() for t in texts], 40)
