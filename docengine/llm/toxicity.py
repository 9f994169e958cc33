"""Toxicity by cumulative-link ordinal regression on sparse text features.

Features are the presence of lower-cased words (runs of ASCII letters and digits and of all
other non-ASCII characters) and of words' first five and six bytes, hashed. Severity grades are
0 (clean), 1 (toxic) and 2 (toxic, with at least the median number of distinct toxic terms among
the toxic rows that were learned from; toxic terms are words seen in toxic rows only). One
weight vector is shared by the thresholds: P(grade > k) = 1 / (1 + exp(theta_k - w x)).

The model is fitted on at most ``sample`` labelled rows (those with the smallest hashes of their
ids; of several rows of one id, the text with the smallest hash), on the driver, with the features
that tell the grades apart; all other work covers all rows. With
no labelled rows, labels of one kind only or no telling feature, every severity is 0 and nothing is toxic. Null and
empty texts have no features: their severity is 0. Whole texts are read; repeated rows get
equal results; other columns are ignored, and those with the result's names are replaced. An empty
table gives an empty result. A tie between grades goes to the lower one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docengine.llm.words import appended, chunks, give_back, lean, list_array, prefix_hash, span_hash, word_spans

_LETTER = np.zeros(256, dtype=bool)
for _low, _high in ((48, 57), (65, 90), (97, 122), (128, 255)):
    _LETTER[_low : _high + 1] = True
FEATURE_BITS = 31


def features(column: pa.Array) -> Iterator[np.ndarray]:
    """Each row's distinct features, ascending; whole words are even, word beginnings odd."""
    data, starts, ends, rows = word_spans(column, _LETTER)
    h = prefix_hash(data)
    mask = np.uint64((1 << FEATURE_BITS) - 1)
    word = (span_hash(h, starts, ends) & mask) << np.uint64(1)
    five = (span_hash(h, starts, np.minimum(starts + 5, ends)) & mask) << np.uint64(1) | np.uint64(1)
    six = (span_hash(h, starts, np.minimum(starts + 6, ends)) & mask) << np.uint64(1) | np.uint64(1)
    every = np.stack([word, five, six], axis=1)
    for i in range(len(rows) - 1):
        yield np.unique(every[rows[i] : rows[i + 1]])


@dataclass
class Ordinal:
    """names: ascending features; weights; thetas: ascending thresholds."""

    names: np.ndarray
    weights: np.ndarray
    thetas: np.ndarray

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each score and k."""
        return 1 / (1 + np.exp(np.clip(self.thetas[None, :] - score[:, None], -60, 60)))

    def scores(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """w x and the number of known features of each row."""
        out, known = np.zeros(len(column)), np.zeros(len(column), np.int64)
        for i, x in enumerate(features(column)):
            at = np.searchsorted(self.names, x)
            at[at == len(self.names)] = 0
            at = at[self.names[at] == x]
            out[i], known[i] = self.weights[at].sum(), len(at)
        return out, known


def fit_ordinal(row: np.ndarray, column: np.ndarray, n_columns: int, grade: np.ndarray, steps: int = 400, rate: float = 0.05, l2: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of the cumulative-link model by Adam on the mean likelihood.

    row and column say which binary features are present.
    """
    k = int(grade.max())
    w = np.zeros(n_columns)
    raw = np.concatenate([[1.0], np.zeros(k - 1)])  # theta_0, then logarithms of the gaps
    m, v = np.zeros(len(w) + k), np.zeros(len(w) + k)
    above = (grade[:, None] > np.arange(k)[None, :]).astype(float)
    # rare grades weigh more, within a factor of two
    share = np.bincount(grade, minlength=k + 1) / len(grade)
    weight = np.clip(1 / (k + 1) / np.maximum(share, 1e-9), 0.5, 2)[grade]
    for t in range(1, steps + 1):
        theta = np.cumsum(np.concatenate([raw[:1], np.exp(raw[1:])]))
        s = np.bincount(row, weights=w[column], minlength=len(grade))
        p = np.concatenate([np.ones((len(s), 1)), 1 / (1 + np.exp(np.clip(theta[None, :] - s[:, None], -60, 60))), np.zeros((len(s), 1))], axis=1)
        rows = np.arange(len(s))
        mass = np.maximum(p[rows, grade] - p[rows, grade + 1], 1e-9)
        d = p * (1 - p)
        upper, lower = d[rows, grade] / mass, d[rows, grade + 1] / mass
        gs = -(upper - lower) * weight / len(s)  # derivative of the loss by the score
        gt = np.zeros(k)
        np.add.at(gt, np.maximum(grade - 1, 0), np.where(grade > 0, upper, 0) * weight / len(s))
        np.add.at(gt, np.minimum(grade, k - 1), np.where(grade < k, -lower, 0) * weight / len(s))
        graw = np.concatenate([[gt.sum()], [gt[j:].sum() * np.exp(raw[j]) for j in range(1, k)]])
        g = np.concatenate([np.bincount(column, weights=gs[row], minlength=n_columns) + l2 * w, graw])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        w, raw = w - step[: len(w)], raw - step[len(w) :]
    return w, np.cumsum(np.concatenate([raw[:1], np.exp(raw[1:])]))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = 5000) -> Ordinal | None:
    """The model, from at most ``sample`` labelled rows."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).dropna()
    known = known.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(sample)

    def list_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("y"), list_array([f.astype(np.uint32).view(np.int32) for f in features(part.column("text"))], pa.int32())], ["id", "y", "f"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).dropna()
    kind = source.schema["id"].dataType.simpleString()
    # the sample has a fixed bound, and so has its broadcast
    chosen = source.join(F.broadcast(known), "id").groupBy("id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = chosen.mapInArrow(lean(list_features), f"id {kind}, y int, f array<int>").toArrow()
    rows = rows.sort_by("id")
    y = rows.column("y").to_numpy()
    lists = rows.column("f").combine_chunks()
    del rows
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.chunk(0) if lists.num_chunks else pa.array([], pa.list_(pa.int32()))
    if not 0 < y.sum() < len(y):
        return None
    flat, owner = lists.flatten().to_numpy().view(np.uint32), np.repeat(np.arange(len(y), dtype=np.int32), np.diff(lists.offsets.to_numpy()))
    names, every = np.unique(flat, return_counts=True)
    of_toxic, n_toxic = np.unique(flat[(y > 0)[owner]], return_counts=True)
    bad = np.zeros(len(names))
    bad[np.searchsorted(names, of_toxic)] = n_toxic
    good = every - bad
    n1, n0 = (y > 0).sum(), (y <= 0).sum()
    p1, p0 = (bad + 0.5) / (n1 + 1), (good + 0.5) / (n0 + 1)
    z = (p1 - p0) / np.sqrt(p1 * (1 - p1) / n1 + p0 * (1 - p0) / n0)
    chosen = np.flatnonzero((bad + good >= 3) & (np.abs(z) >= 2.5))
    if not len(chosen):
        return None
    telling, found = names[chosen], []
    for i in range(0, len(flat), 1 << 18):  # in pieces, as few of the features tell
        piece = flat[i : i + (1 << 18)]
        at = np.minimum(np.searchsorted(telling, piece), len(chosen) - 1)
        have = np.flatnonzero(telling[at] == piece)
        found.append((owner[i + have], at[have]))
    owner, column = (np.concatenate(x) for x in zip(*found, strict=True))
    terms = (bad[chosen] > 0) & (good[chosen] == 0) & (names[chosen] % 2 == 0)
    n_terms = np.bincount(owner, weights=terms[column], minlength=len(y))
    toxic = y > 0
    grade = np.where(toxic, 1 + ((n_terms >= max(2, np.median(n_terms[toxic]))).astype(int)), 0)
    grade = np.unique(grade, return_inverse=True)[1]
    weights, thetas = fit_ordinal(owner, column, len(chosen), grade)
    own = Ordinal(names[chosen].astype(np.uint64), weights, thetas)
    del flat, names, lists
    give_back()
    return own


SCORES = "severity double, p_toxic double, grade int, toxic boolean"


def _above(own: Ordinal | None, column: pa.Array) -> np.ndarray:
    """P(grade > k) of each text and k; texts without known features have grade 0."""
    if own is None:
        return np.zeros((len(column), 1))
    scores, known = own.scores(column)
    return own.above(scores) * (known > 0)[:, None]


def severity(docs: DataFrame, model: Ordinal | None, text_col: str = "text") -> DataFrame:
    """docs with severity (expected grade), p_toxic, grade (most likely) and toxic (p_toxic >= 0.5)."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    names = ["severity", "p_toxic", "grade", "toxic"]
    kept = appended(docs, *names)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text_col):
                n = part.num_rows
                above = _above(held.value, part.column(part.schema.get_field_index(text_col)))
                edges = np.concatenate([np.ones((n, 1)), above, np.zeros((n, 1))], axis=1)
                out = [above.sum(axis=1), above[:, 0], (edges[:, :-1] - edges[:, 1:]).argmax(axis=1).astype(np.int32), above[:, 0] >= 0.5]
                others = [part.column(part.schema.get_field_index(c)) for c in kept]
                yield pa.RecordBatch.from_arrays([*others, *map(pa.array, out)], [*kept, *names])

    return docs.mapInArrow(lean(judge), "".join(f"{x}, " for x in kept.values()) + SCORES)


def without_toxic(docs: DataFrame, model: Ordinal | None, text_col: str = "text") -> DataFrame:
    """The rows of docs that aren't toxic (p_toxic under one half), with all their columns whatever their names."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text_col):
                yield part.filter(pa.array(_above(held.value, part.column(part.schema.get_field_index(text_col)))[:, 0] < 0.5))

    return docs.mapInArrow(lean(keep), docs.schema)


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every document with its expected severity, most likely grade and verdict."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return severity(docs.select("doc_id", "text"), model).drop("text")
