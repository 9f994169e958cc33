"""Chunks and admission over many keys and sizes, against plain loops."""

import random

from docengine.operators import metrics as m


def test_packing_in_order(spark):
    r = random.Random(6)
    rows = [(k, p, r.choice([0, 1, 3, 5, 9, 12, None])) for k in [*range(300), None] for p in range(r.choice([1, 4, 30]))]
    df = spark.createDataFrame(r.sample(rows, len(rows)), "doc int, pos int, size int").repartition(5)
    chunks, kept = {}, set()
    for k in {x[0] for x in rows}:
        chunk, used, left = 0, 0, 10
        for _, p, n in [x for x in rows if x[0] == k]:
            if n is None or n > 10:
                chunks[k, p] = None
            else:
                if used + n > 10:
                    chunk, used = chunk + 1, 0
                used += n
                chunks[k, p] = chunk
            if n is not None and n <= left:
                left -= n
                kept.add((k, p))
    assert {(x.doc, x.pos): x.chunk for x in m.packed(df, "doc", "pos", "size", 10).collect()} == chunks
    assert {(x.doc, x.pos) for x in m.admitted(df, "doc", "pos", "size", 10).collect()} == kept
