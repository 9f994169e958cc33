"""Blocks of one leader's members: only dense sketches are moved."""

import numpy as np

from docengine.llm import ngram_join as j


def test_coarse_sketches_follow_from_dense_ones():
    r = np.random.default_rng(5)
    both = [j.parity_sketch(r.integers(0, 1 << 63, n).astype(np.uint64)) for n in (1, 3, 40, 129, 700, 40, 5000)]
    dense = [d for _, d in both]
    flat, edges = j._coarse(np.concatenate(dense), np.concatenate([[0], np.cumsum([len(d) for d in dense])]))
    assert [x.tolist() for x in np.split(flat, edges[1:-1])] == [c.tolist() for c, _ in both]
