import hashlib

import numpy as np
import pytest

from docengine.llm.bpe import Vocabulary, decode, encode, encode_decode, op3_bpe

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.json")
TEXTS = [
    None, "", " ", "a", "aaaaaaaaaaaaaaaa", "Hello world!  It's   2024\n\n\tend  ", "<|endoftext|>x<|endoftext|>", "I'll we've they'd",
    "é ß ñ\u0085 x​᠎", "日本語 テキスト 🎉🎉 é", "\x1c\x1d\x1e\x1f a\x0b\x0cb", "a" * 5000 + " " * 700 + "b", "١٢٣ ½ Ⅷ x²",
]


def test_same_as_library():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH)
    own = Vocabulary(PATH)
    for text in TEXTS:
        assert np.frombuffer(own.encode([text or ""])[0], np.int32).tolist() == library.encode(text or "", add_special_tokens=False).ids, text


def test_many_words_at_once():
    import random

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH)
    r = random.Random(5)
    texts = [" ".join("".join(r.choice("aaabnést.éüoe  '") for _ in range(r.randint(1, 14))) for _ in range(200)) for _ in range(20)] + TEXTS
    got = Vocabulary(PATH).encode([t or "" for t in texts])
    assert [np.frombuffer(x, np.int32).tolist() for x in got] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_round_trip_on_spark(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(5, TEXTS[5], "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = decode(encode(df, PATH), PATH).collect()
    assert len(out) == len(rows)
    assert all(r.decoded == (TEXTS[r.doc_id] or "") for r in out)
    both = encode_decode(df.withColumn("decoded", df.text), PATH)
    assert both.columns == ["doc_id", "ids", "decoded"]
    assert sorted((r.doc_id, r.ids, r.decoded) for r in both.collect()) == sorted((r.doc_id, r.ids, r.decoded) for r in out)


def test_empty_table(spark):
    assert encode(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
    assert encode_decode(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_query_on_fixture(spark, tmp_path):
    from tokenizers import Tokenizer

    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    library = Tokenizer.from_file(PATH)
    for r in op3_bpe(spark, str(tmp_path)).collect():
        ids = library.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()


def test_runs_of_one_symbol():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own, library = Vocabulary(path), Tokenizer.from_file(path)
    texts = ["Thananan the", "anananan ananan", "eeeeeee lalalala", "thethethe ininin"]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(ids, np.int32).tolist() == library.encode(text, add_special_tokens=False).ids
