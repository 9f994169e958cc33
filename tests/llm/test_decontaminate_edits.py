"""Edited passages: words changed, inserted and deleted anywhere in items of 50 to 150 words."""

import random

import pyarrow as pa

from docengine.llm.decontaminate import ItemIndex
from test_decontaminate import brute


def edited(r, word, n):
    """(item, document, edits): a passage with one to three edits inside other words."""
    item = [word() for _ in range(n)]
    piece = list(item)
    for _ in range(r.randint(1, 3)):
        at, kind = r.randrange(len(piece)), r.choice("cid")
        piece[at : at + (kind != "i")] = [] if kind == "d" else [word()]
    around = [[word() for _ in range(r.randint(30, 90))] for _ in range(2)]
    return " ".join(item), " ".join(around[0] + piece + around[1])


def test_edits_anywhere_are_found():
    for seed, words in ((5, 100000), (6, 4)):
        r = random.Random(seed)
        pairs = [edited(r, lambda: f"w{r.randrange(words)}", r.randint(50, 150)) for _ in range(25)]
        items, docs = ([p[k] for p in pairs] for k in (0, 1))
        want = brute(list(enumerate(docs)), list(enumerate(items)))
        assert len(want) > 8
        found = ItemIndex(list(range(25)), items, 5, 3).hits(pa.array(docs), 0.8)
        assert {(d, i) for d, hits in enumerate(found) for i in hits} == want


def test_best_piece_is_the_most_similar():
    from collections import Counter

    from docengine.llm.decontaminate import similarity
    from docengine.llm.words import shingle_hashes, word_hashes

    r = random.Random(7)
    sh = lambda t: shingle_hashes(*word_hashes(pa.array([t])), 5)[0].tolist()
    for _ in range(30):
        item, doc = edited(r, lambda: f"w{r.randrange(3)}", r.randint(50, 150))
        it, own = sh(item), sh(doc)
        best = max(similarity(Counter(it), Counter(own[max(a, 0) : a + len(it)])) for a in range(1 - len(it), len(own)))
        found = ItemIndex([9], [item], 5, 3).hits(pa.array([doc]), 0.8)[0]
        assert (best >= 0.8) == (9 in found)
        if found:
            s, first, n = found[9]
            assert abs(s - best) < 1e-12 and abs(similarity(Counter(it), Counter(own[first : first + n])) - s) < 1e-12
