import random
import re

import numpy as np
import pytest

from docengine.llm.graph import components
from docengine.llm.ngram_join import _near, ngram_join, parity_sketch, run_length


def words(text):
    return re.split("[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))


def shingles(text, size):
    w = [x for x in words(text or "") if x]
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < size else frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1))


def brute(docs, size, num, den):
    sets = [(i, shingles(t, size)) for i, t in docs]
    root = {i: i for i, _ in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and den * len(a & b) >= num * len(a | b):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return {i: (len(s), find(i)) for i, s in sets}


def make(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    base = [[r.choice(vocabulary) for _ in range(r.randint(1, 60))] for _ in range(12)]
    line = ["license", "line", "that", "many", "documents", "share", "here"]
    docs = []
    for i in range(150):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        if r.random() < 0.4:
            w += line
        docs.append((i, " ".join(w)))
    return [*docs, (200, None), (201, ""), (202, " \t\n"), (203, "one"), (204, "ONE"), (205, "é \x0b x")]


@pytest.mark.parametrize(("size", "num", "den"), [(4, 85, 100), (5, 4, 5), (2, 9, 10)])
def test_against_brute_force(spark, size, num, den):
    docs = make(size)
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, n int, key int")
    for classes in ({}, {"at_least": 2, "total": 3}):  # with and without frequent tokens
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join(df, size=size, num=num, den=den, **classes).collect()}
        assert got == brute(docs, size, num, den)


def test_repeated_and_empty(spark):
    df = spark.createDataFrame([(3, "a b c d e f"), (3, "a b c d e f"), (1, "a b c d e f")], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in ngram_join(df).collect()) == [(1, 1), (3, 1), (3, 1)]
    assert ngram_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_run_length():
    assert run_length(85, 100) == 3 and run_length(4, 5) == 2


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 50), (50, 100), (7, 7), (60, 61)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, 50: 50, 100: 50, 60: 60, 61: 60}


def test_dense_sketches_are_compared_as_such():
    r = np.random.default_rng(2)
    sketches = [parity_sketch(np.unique(r.integers(0, 1 << 63, n).astype(np.uint64)))[1] for n in r.integers(1, 700, 40)]
    flat, edges = np.concatenate(sketches), np.concatenate([[0], np.cumsum([len(x) for x in sketches])])
    i, k = (x.ravel() for x in np.meshgrid(np.arange(40), np.arange(40)))
    least = r.integers(1, 4000, len(i))

    def folded(x, s):
        return np.bitwise_xor.reduce(x.reshape(-1, s), axis=0)

    want = []
    for at, (a, b) in enumerate(zip(i.tolist(), k.tolist(), strict=True)):
        s = min(len(sketches[a]), len(sketches[b]))
        apart = int(np.bitwise_count(folded(sketches[a], s) ^ folded(sketches[b], s)).sum())
        if apart * 4 <= least[at]:
            want.append(at)
    assert _near(flat, edges, i, k, least, 4, 5).tolist() == want and len(want) > 100


def test_a_group_whose_members_are_far_from_its_smallest_id(spark):
    r = random.Random(8)
    base = [f"v{r.randrange(400)}" for _ in range(200)]
    far = list(base)
    for at in range(0, 200, 25):
        far[at] = "other"
    docs = [(0, " ".join(far))]
    for i in range(1, 1400):  # each with one word changed, linked with most others but not with 0
        w = list(base)
        w[r.randrange(200)] = f"x{i}"
        docs.append((i, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in ngram_join(df, size=5, num=4, den=5).collect()}
    sets = [shingles(t, 5) for _, t in docs[:40]]
    assert all(5 * len(sets[0] & x) < 4 * len(sets[0] | x) for x in sets[1:])
    assert got == {0: 0, **{i: 1 for i in range(1, 1400)}}
