"""Product quantisation against a brute-force version in Python integers."""

import hashlib
import math

import numpy as np
import pytest

from docengine.llm import codes


def brute(rows, parts=8, entries=16, rounds=6, scale=4096):
    """rows: (id, vector) in any order; returns [(id, code, error)] and the codebooks as one list."""
    fine = [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not fine:
        return [], []
    width = -(-max(len(v) for _, v in fine) // parts)
    whole = [(i, [math.floor(scale * x) for x in v] + [0] * (width * parts - len(v))) for i, v in fine]
    whole.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    cut = [[v[p * width : (p + 1) * width] for _, v in whole] for p in range(parts)]
    books = [[list(x) for x in own[:entries]] for own in cut]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
    near = lambda x, book: min(range(len(book)), key=lambda j: (far(x, book[j]), j))
    for _ in range(rounds):
        for own, book in zip(cut, books, strict=True):
            chosen = [near(x, book) for x in own]
            for j in range(len(book)):
                mine = [x for x, c in zip(own, chosen, strict=True) if c == j]
                if mine:
                    book[j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    out = []
    for r, (i, _) in enumerate(whole):
        chosen = [near(own[r], book) for own, book in zip(cut, books, strict=True)]
        out.append((i, "".join(f"{c:02x}" for c in chosen), sum(far(own[r], book[c]) for own, book, c in zip(cut, books, chosen, strict=True))))
    return out, [x for book in books for e in book for x in e]


def check(spark, rows, **how):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, error int, v string").repartition(5)
    plain = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    want, flat = brute(plain, **how)
    books = codes.fit(df, **how)
    if not want:
        assert books is None
        return
    assert books.entries.ravel().tolist() == flat
    assert books.sha256() == hashlib.sha256(",".join(map(str, flat)).encode()).hexdigest()
    got = codes.encode(df, books)
    assert got.columns == ["vec_id", "v", "code", "error"]
    assert sorted(((r.vec_id, r.code, r.error) for r in got.collect()), key=str) == sorted(want, key=str)


def test_same_as_brute_force(spark):
    r = np.random.default_rng(5)
    rows = [(int(i), r.standard_normal(16).tolist()) for i in r.permutation(400)]
    rows += [(1000 + i, [0.25] * 16) for i in range(150)]  # a hot vector
    rows += [(7, rows[3][1]), (None, rows[5][1]), (2000, None), (2001, [1.0, None] + [0.0] * 14), (2002, [math.nan] * 16), (2003, [math.inf] * 16), (2004, [])]
    check(spark, rows)
    check(spark, rows, parts=4, entries=3, rounds=2, scale=10)


def test_ties_and_equal_entries(spark):
    rows = [(i, [float(i % 2)] * 8) for i in range(40)]  # every entry occurs eight times
    check(spark, rows)
    check(spark, [(i, [(i % 3 - 1) / 4096] * 8) for i in range(50)])


def test_few_rows_ragged_rows_and_none(spark):
    check(spark, [(5, [1.5, -2.5]), (3, [0.0] * 9), (4, [])])
    check(spark, [(1, None)])
    check(spark, [])


def test_screening_keeps_near_ties():
    r = np.random.default_rng(1)
    base = r.integers(-(2**24), 2**24, (1, 64))
    entries = base + r.integers(-1, 2, (16, 64))  # float32 can't tell them apart
    x = base + r.integers(-2, 3, (500, 64))
    chosen, best = codes.nearest(x, entries)
    far = ((x[:, None, :] - entries[None]) ** 2).sum(axis=2)
    assert (chosen == far.argmin(axis=1)).all() and (best == far.min(axis=1)).all()


def test_too_large(spark):
    df = spark.createDataFrame([(1, [3e38] * 8), (2, [0.0] * 8)], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="too large"):
        codes.fit(df)
