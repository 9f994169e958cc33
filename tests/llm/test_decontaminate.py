import random
from collections import Counter

import pyarrow as pa

from docengine.llm.decontaminate import ItemIndex, contaminated, decontaminated, similarity, size_class
from docengine.llm.words import shingle_hashes, word_hashes


def brute(docs, items, size=5, threshold=0.8):
    """All documents and items for which some item-sized piece is similar enough."""
    out = set()
    sh = lambda t: shingle_hashes(*word_hashes(pa.array([t])), size)[0].tolist()
    for i, t in docs:
        own = sh(t)
        for j, s in items:
            it = sh(s)
            if it and any(similarity(Counter(it), Counter(own[a : a + len(it)])) >= threshold for a in range(max(1, len(own) - len(it) + 1))):
                out.add((i, j))
    return out


def make(seed=1):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(r.randint(6, 60))) for i in range(30)] + [(40, "two words"), (41, ""), (42, None)]
    docs = []
    for d in range(60):
        body = text(r.randint(1, 200)).split()
        if d % 2:
            piece = items[d % 30][1].upper().split()
            if d % 3 == 0 and len(piece) > 40:
                piece[0] = "changed"
            at = r.randint(0, len(body))
            body[at:at] = piece
        docs.append((d, "  ".join(body)))
    return docs + [(100, "Two  Words"), (101, "now two words here and there"), (102, ""), (103, None)], items


def test_against_brute_force(spark):
    docs, items = make()
    d = spark.createDataFrame([(i, t, "clash") for i, t in docs] + [(1, docs[1][1], "again")], "doc_id long, text string, item_id string")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert want and (100, 40) in want and (101, 40) not in want
    for per_pass in (5000, 7):
        got = contaminated(d, b, items_per_pass=per_pass).select("doc_id", "item_id").collect()
        assert {tuple(x) for x in got} == want
    kept = decontaminated(d, b, items_per_pass=10)
    assert kept.columns == d.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in docs} - {i for i, _ in want}


def test_empty(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert contaminated(d, b).count() == 0
    assert decontaminated(spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), b).count() == 1


def test_all_fingerprints_within_radius_are_found():
    r = random.Random(3)
    texts = [" ".join(str(r.randint(0, 50)) for _ in range(40)) for _ in range(20)]
    index = ItemIndex(list(range(20)), texts, 5, 3)
    for (_, _, width), (prints, owners, offsets, _) in index.classes.items():
        values, bounds = shingle_hashes(*word_hashes(pa.array([" ".join(texts)])), 5)
        from docengine.llm.decontaminate import fingerprints
        import numpy as np

        stride = size_class(36)[1]
        starts = np.arange(0, len(values) - width + 1, stride)
        own = fingerprints(values, starts, width)
        far = np.bitwise_count(own[:, None] ^ prints[None, :])
        want = {(0, int(owners[e]), int(starts[w] - offsets[e])) for w, e in zip(*np.nonzero(far <= 3), strict=True)}
        assert want <= {tuple(x) for x in index.candidates(values, bounds).tolist()}
