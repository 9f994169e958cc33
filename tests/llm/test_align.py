"""Alignment against a brute-force version, and the tokens against both libraries."""

import hashlib
import random
from collections import Counter

import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from docengine.llm import align
from docengine.llm.queries import QUERIES
from docengine.llm.stored import stored

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def brute(rows):
    """Per row (in order): n_a, n_b, n_groups, n_links, n_best, count_sum, the groups as text."""
    one = Tokenizer.from_file(A)
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=B)
    letters = align.Plain(A).bytes_of
    out, links = [], []
    for text in rows:
        text = text or ""
        a = one.encode(" " + text, add_special_tokens=False).ids if text else []
        b = two.encode(text) if text else []
        bytes_a = [letters[x] for x in a]
        bytes_b = [bytes([int(two.id_to_piece(x)[3:5], 16)]) if two.is_byte(x) else two.id_to_piece(x).replace("▁", " ").encode() for x in b]
        if b"".join(bytes_a) != b" " + text.encode() or b"".join(bytes_b) != b" " + text.encode():
            a, b = [], []
        ends = [[sum(map(len, x[: i + 1])) for i in range(len(x))] if len(x) < 400 else list(__import__("itertools").accumulate(map(len, x))) for x in (bytes_a, bytes_b)] if a else [[], []]
        common = set(ends[0]) & set(ends[1])
        groups, own, i, j = [], Counter(), 0, 0
        for c in sorted(common):
            x, y = [], []
            while i < len(a) and ends[0][i] <= c:
                x.append(a[i])
                i += 1
            while j < len(b) and ends[1][j] <= c:
                y.append(b[j])
                j += 1
            groups.append((x, y))
            own.update((p, q) for p in x for q in y)
        links.append(own)
        out.append([len(a), len(b), len(groups), sum(own.values()), ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)])
    docs = Counter(p for own in links for p in own)
    most = {}
    for (x, _), n in docs.items():
        most[x] = max(most.get(x, 0), n)
    for row, own in zip(out, links, strict=True):
        row[4:4] = [sum(n for p, n in own.items() if docs[p] == most[p[0]]), sum(n * docs[p] for p, n in own.items())]
    return [tuple(x) for x in out]


def texts():
    r = random.Random(3)
    words = "the over-night naïve 12345 don't ha hahaha xyxy 🎉🎉 ｆｕｌｌ été <|endoftext|> </s> <0x41> ​ x́ 日本語 ==== a".split()
    fine = [None, "", " ", "  ", "a", " a", "a ", "a  b", "a\n b \n", "x▁y", "tab\there", "\x1c a \x1c b", "a \x1cb", "  a　 b", "ha" * 300, "hah" * 200, "=" * 777, "xy" * 500 + " z", "the the the", "\x00 \x00", "é" * 90]
    return fine + [r.choice([" ", " ", "  ", "\n", ""]).join(r.choices(words, k=r.randrange(60))) for _ in range(120)] + ["the same text"] * 5 + [" ".join(r.choices(words, k=30000))]


@pytest.fixture(scope="module")
def rows():
    return texts()


@pytest.mark.parametrize("block, most", [(8 << 20, 1 << 19), (200, 20), (1, 0)])
def test_same_as_brute_force(spark, rows, block, most):
    few = rows if block > 200 else rows[:-1]
    df = spark.createDataFrame([(i, x, "clash", 1) for i, x in enumerate(few)], "doc_id long, text string, groups string, m int")
    kept = stored(align.align(df, A, B, block_bytes=block))
    got = sorted(align.scored(kept, stored(align.pair_counts(kept)), most_broadcast=most).collect())
    assert [(r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in got] == brute(few)


def test_nulls_repeats_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b"), (2, None)], "doc_id long, text string")
    kept = stored(align.align(df, A, B))
    got = align.scored(kept, stored(align.pair_counts(kept))).collect()
    assert sorted((r.doc_id or 0, r.n_a, r.count_sum) for r in got) == [(0, 2, 6), (1, 2, 6), (1, 2, 6), (2, 0, 0)]
    kept = stored(align.align(df.limit(0), A, B))
    assert align.scored(kept, stored(align.pair_counts(kept))).count() == 0


def test_query_over_the_smallest_table(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = QUERIES["op13_align"](spark, d).orderBy("doc_id").collect()
    want = brute([x.text for x in docs])
    assert [x.doc_id for x in got] == [x.doc_id for x in docs]
    assert [(r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got] == [(*w[:6], hashlib.sha256(w[6].encode()).hexdigest() if w[2] else "") for w in want]


def test_all_tokens_by_bytes():
    own = align.Plain(A)
    assert own.by_bytes is not None
    names = [x for i, x in own.bytes_of.items() if i != 50256]
    assert all(own.by_bytes.encode_single_token(x) == i and own.by_bytes._encode_single_piece(x) == [i] for i, x in own.bytes_of.items() if i != 50256) and len(names) == 50256
    plain = [x.decode() for x in names if x.isascii()]
    assert own.encode_all(plain) == own.encode(plain)
