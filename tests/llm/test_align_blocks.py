"""Alignment by blocks: pieces tokenised at once, and what is left to row-by-row functions."""

import numpy as np
import public_tokenizers as P

from docengine.llm import align

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def test_pieces_at_once_are_as_alone():
    own = align.Plain(A)
    for pieces in (["over-night", "naïve", "12345", "don't", "a\nb", "日本語", "=" * 70, "over-night"], [" a", "b", "c\n"], ["a", ""], []):
        ids, sizes = own.encode_pieces(pieces)
        want = [np.frombuffer(x, np.int32).tolist() for x in own.encode_all([f" {x}" for x in pieces])]
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == want or not pieces
        assert sizes.sum() == len(ids)


def test_pieces_that_b_changes_are_found_beside_others():
    both = align.Both(A, B)
    _, _, upto, (na, nb) = both.block(["a fine text", "x▁y and more", "", "a fine text", "<unk> x"])
    assert both.bad == {"x▁y"} and na.tolist()[1:3] == [0, 0] and nb.tolist()[1:3] == [0, 0]
    assert na[0] == na[3] > 0 and nb[4] > 0 and np.diff(upto).tolist() == [3, 0, 0, 3, 2]


def test_only_the_dictionary_goes_through_higher_order_functions(spark):
    plan = align.align(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), A, B)._jdf.queryExecution().executedPlan().toString()
    assert "array_intersect" in plan and "flatten" not in plan and "explode" not in plan
