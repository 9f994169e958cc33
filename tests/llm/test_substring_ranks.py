"""Ranks of a cover sample are numbered within a column, so their tables stay as small as a block."""

import numpy as np

from docengine.llm.substrings import CoverRanks


def test_ranks_are_numbered_by_column():
    r = np.random.default_rng(1)
    slots = r.integers(97, 100, (300, 26 * 13)).astype(np.uint8)
    slots[150:] = slots[:150]
    cover = CoverRanks(slots, 200)
    assert cover.rank.max() == 149 and (cover.rank[150:] == cover.rank[:150]).all()
