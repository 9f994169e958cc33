"""Language identification with error-correcting output codes.

Each language has a codeword; one binary classifier per bit (ridge regression on hashed byte
n-grams, targets +1 and -1, languages weighing the same) predicts that bit. Decoding sums, per
language, the hinge losses of its codeword's bits, each weighted by the bit's accuracy on the
rows that were learned from, and takes the smallest; ``score`` is the softmax share of the
winner, and ``ambiguous`` says that the runner-up's loss is within ``margin`` of it.

Only the text is an input of a prediction. The model is fitted on the driver on at most
``sample`` rows (those with the smallest hashes of their ids; of several rows of one id, the one
with the smallest hash). Letters are lower-cased A-Z and
all non-ASCII bytes; other bytes count as one space each. Null texts and texts without a letter
are 'und' with score 0. With no rows to learn from, every text is 'und'; with one language, that
one. Languages of equal loss: the first by name. Whole texts are read; repeated rows get equal
results; other columns are ignored, and those with the result's names are replaced. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docengine.llm.words import appended, chunks, lean, list_array, raw_bytes

DIMS = 2048
ORDERS = (1, 2, 3, 4)
_MAP = np.full(256, 32, np.uint32)
_MAP[97:123] = np.arange(97, 123)
_MAP[65:91] = np.arange(97, 123)
_MAP[128:] = np.arange(128, 256)
_ASCII_LETTER = (_MAP != 32) & (np.arange(256) < 128)


def vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of square-rooted n-gram frequencies, and whether each row has a letter."""
    data, offsets = raw_bytes(column)
    letters = _MAP[data]
    out = np.zeros((len(column), DIMS), np.float32)
    code = np.zeros(len(letters), np.uint32)
    codes = []
    for order in range(1, max(ORDERS) + 1):
        grown = letters[order - 1 :] if order == 1 else code[: len(letters) - order + 1] * np.uint32(0x01000193) + letters[order - 1 :] * np.uint32(2 * order + 1)
        code = grown.astype(np.uint32) if len(grown) else np.zeros(0, np.uint32)
        if order in ORDERS:
            x = code * np.uint32(0x9E3779B1)
            codes.append((order, (x ^ (x >> np.uint32(15))) * np.uint32(0x85EBCA77) >> np.uint32(21)))
    has = np.zeros(len(column), bool)
    for i in range(len(column)):
        low, high = int(offsets[i]), int(offsets[i + 1])
        if low == high:
            continue
        plain = data[low:high]
        has[i] = _ASCII_LETTER[plain].any() or (plain.max() > 127 and any(c.isalpha() for c in column[i].as_py()))
        for order, x in codes:
            if high - low >= order:
                out[i] += np.bincount(x[low : high - order + 1], minlength=DIMS)
    norm = out.sum(axis=1, keepdims=True)
    return np.sqrt(out / np.maximum(norm, 1)), has


def codewords(k: int) -> np.ndarray:
    """k codewords of +1 and -1: all distinct splits for few languages, else seeded random ones."""
    if k <= 6:
        bits = np.array([[(col >> row) & 1 for col in range(1, 1 << (k - 1))] for row in range(k - 1)] + [[0] * ((1 << (k - 1)) - 1)])
        return bits * 2 - 1
    r = np.random.default_rng(k)
    best = max((r.integers(0, 2, (k, 10 * int(np.ceil(np.log2(k))))) for _ in range(200)), key=lambda m: min((m[i] != m[j]).sum() for i in range(k) for j in range(i)))
    return best * 2 - 1


@dataclass
class Codes:
    """names: languages; words: their codewords; weights: one column a bit, the last row the bias."""

    names: list[str]
    words: np.ndarray
    weights: np.ndarray
    trust: np.ndarray

    def losses(self, x: np.ndarray) -> np.ndarray:
        """The weighted hinge loss of each row and language."""
        f = x @ self.weights[:-1] + self.weights[-1]
        return (np.maximum(0, 1 - f[:, None, :] * self.words[None, :, :]) * self.trust).sum(axis=2) / self.trust.sum()

    def decode(self, x: np.ndarray, sharpness: float = 6.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The winner of each row, its share, and its lead over the runner-up."""
        loss = self.losses(x)
        e = np.exp(-sharpness * (loss - loss.min(axis=1, keepdims=True)))
        ranked = np.sort(loss, axis=1)
        return loss.argmin(axis=1), e.max(axis=1) / e.sum(axis=1), ranked[:, 1] - ranked[:, 0]


def fit(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = 4000, ridge: float = 3e-4) -> Codes | str | None:
    """The codes from at most ``sample`` rows for which ``learn`` holds; a name if there is but one language."""
    usable = docs.filter(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    chosen = usable.select(F.col(id_col).alias("id")).distinct().orderBy(F.xxhash64("id"), "id").limit(sample)

    def list_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                x, has = vectors(part.column("text"))
                keep = np.flatnonzero(has)
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(keep)), part.column("lang").take(pa.array(keep)), list_array(list(x[keep]), pa.float32())], ["id", "lang", "x"])

    source = usable.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    # the sample has a fixed bound, and so has its broadcast
    once = source.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min_by(F.struct("lang", "text"), F.xxhash64("lang", "text")).alias("r")).select("id", "r.lang", "r.text")
    rows = once.mapInArrow(lean(list_vectors), f"id {kind}, lang string, x array<float>").toArrow().sort_by("id")
    if not rows.num_rows:
        return None
    names, y = np.unique(np.array(rows.column("lang").to_pylist()), return_inverse=True)
    if len(names) == 1:
        return str(names[0])
    x = np.concatenate([c.flatten().to_numpy() for c in rows.column("x").chunks]).reshape(rows.num_rows, DIMS)
    words = codewords(len(names))
    weight = np.sqrt(1 / np.bincount(y)[y] / len(names)).astype(np.float32)[:, None]
    full = np.concatenate([x, np.ones((len(x), 1), np.float32)], axis=1)
    a = full * weight
    gram = (a.T @ a).astype(np.float64)
    gram[np.arange(DIMS), np.arange(DIMS)] += ridge
    gram[-1, -1] += 1e-9
    weights = np.linalg.solve(gram, a.T @ (words[y] * weight))
    right = ((full @ weights) * words[y] > 0).mean(axis=0)
    return Codes([str(n) for n in names], words, weights.astype(np.float32), np.maximum(right - 0.5, 1e-3))


def predict(docs: DataFrame, model: Codes | str | None, text_col: str = "text", margin: float = 0.15) -> DataFrame:
    """docs with lang_pred, score and ambiguous."""
    names = ["lang_pred", "score", "ambiguous"]
    kept = appended(docs, *names)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in batches:
            for part in chunks(batch, text_col):
                x, has = vectors(part.column(part.schema.get_field_index(text_col)))
                name, share, close = np.full(len(x), "und", object), np.zeros(len(x)), np.ones(len(x), bool)
                if isinstance(own, Codes):
                    best, top, lead = own.decode(x)
                    name[has] = np.array(own.names, object)[best[has]]
                    share[has], close[has] = top[has], lead[has] < margin
                elif own is not None:
                    name[has], share[has], close[has] = own, 1.0, False
                others = [part.column(part.schema.get_field_index(c)) for c in kept]
                yield pa.RecordBatch.from_arrays([*others, pa.array(name, pa.string()), pa.array(share), pa.array(close)], [*kept, *names])

    return docs.mapInArrow(lean(judge), "".join(f"{x}, " for x in kept.values()) + "lang_pred string, score double, ambiguous boolean")


def op7_langid(spark, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those whose crc32 of the id isn't 2 modulo 4."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("held_out", F.crc32(F.col("doc_id").cast("string")) % 4 == 2)
    model = fit(docs, ~F.col("held_out"))
    return predict(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")
