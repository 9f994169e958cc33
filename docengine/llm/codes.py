"""Compression of vectors into short codes by exact integer product quantisation.

Components x become floor(scale * x). Vectors are cut into ``parts`` consecutive parts of one width; each
part position has a codebook, which begins as that part of the rows with the smallest ids. A round
assigns every part to its nearest entry and replaces each entry by the rounded-down mean of its parts;
entries without parts stay. Distances are squared Euclidean ones, ties go to the lower index, and all of
it is exact.

The nearest entry is found by screening: |c|^2 - 2 x.c orders the entries c for a part x, and x.c comes
from a float32 matrix product. Whatever order the n terms are added in, its error is at most
g(n + 2) |x| |c| with g(k) = k u / (1 - k u) and u = 2**-24, where 2 stands for the rounding of x and c to
float32 (numbers are integers, so nothing underflows). Each entry so has an interval that holds its
true value. Entries whose interval reaches below the lowest upper end are evaluated anew in int64.

A round is one pass over the vectors, which sends count and sums of each entry from each task: at most
entries * width numbers, whatever the number of rows, or how many of them are equal. The codebooks are on
the driver between rounds; they are of fixed size.

Vectors that are null or hold null or non-finite components take no part. Shorter vectors count as padded
with zeros to the longest one, and that to a multiple of ``parts``. Repeated rows take part each for
itself; rows without an id come last when the first entries are chosen, and of rows with one id, smaller
vectors come first. With fewer rows than entries there are as many entries as rows; an empty table
gives no rows. Components so large that sums of squares leave int64 are an error (ArithmeticError).
Other columns keep their names; those that clash with the new ones give way.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docengine.llm.stored import stored
from docengine.llm.words import appended, lean

_UNIT = 2.0**-24


@dataclass(frozen=True)
class Codebooks:
    """entries: (parts, n, width of a part) in int64; scale and the vectors' width."""

    entries: np.ndarray
    scale: int

    @property
    def width(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The index of the nearest entry (ties: the lowest) and its squared distance for each row of x, in int64."""
    n, width = x.shape
    square = (entries * entries).sum(axis=1)
    product = (x.astype(np.float32) @ entries.astype(np.float32).T).astype(np.float64)
    k = (width + 2) * _UNIT
    lengths = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))[:, None] * np.sqrt(square.astype(np.float64))[None, :]
    value = square.astype(np.float64)[None, :] - 2 * product
    # 2 g |x| |c|, and what the float64 steps here may lose
    error = 2 * (k / (1 - k)) * lengths * (1 + 2.0**-40) + (square.astype(np.float64)[None, :] + 2 * np.abs(product)) * 2.0**-50
    maybe = value - error <= (value + error).min(axis=1, keepdims=True)
    row, entry = np.nonzero(maybe)  # by row, then index; every row has one at least
    apart = x[row] - entries[entry]
    exact = (apart * apart).sum(axis=1)
    first = np.concatenate([[0], np.flatnonzero(row[1:] != row[:-1]) + 1]) if n else np.zeros(0, np.int64)
    best = np.minimum.reduceat(exact, first) if n else np.zeros(0, np.int64)
    hit = np.flatnonzero(exact == best[row])
    chosen = np.full(n, len(entries))
    np.minimum.at(chosen, row[hit], entry[hit])
    return chosen, best


def whole_numbers(column: pa.Array, scale: int, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Which rows take part, and those rows in int64, padded with zeros to ``width``."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten()
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # null becomes NaN
    lengths = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    there = column.is_valid().to_numpy(zero_copy_only=False)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
    ends = np.cumsum(lengths)
    fine = there & (bad[ends] == bad[ends - lengths])
    width = int(lengths[fine].max(initial=0)) if width is None else width
    out = np.zeros((int(fine.sum()), width), np.int64)
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.floor(x * scale)
    if len(x) and np.abs(x[np.repeat(fine, lengths)]).max(initial=0) >= _limit(max(width, 1)):
        raise ArithmeticError("components are too large for sums of squares in int64")
    if (lengths[fine] == width).all():
        out[:] = x[np.repeat(fine, lengths)].reshape(out.shape)
    else:
        out[np.arange(width)[None, :] < lengths[fine][:, None]] = x[np.repeat(fine, lengths)]
    return fine, out


def _limit(width: int) -> int:
    """Differences of numbers below it have squares whose sum over a vector stays in int64."""
    return math.isqrt((1 << 63) // (4 * width)) - 1


def _usable(vec_col: str):
    x = F.col(vec_col)
    return F.coalesce(x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))), F.lit(False))


def fit(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> Codebooks | None:
    """The codebooks after ``rounds`` rounds; None without any vector that takes part."""
    vectors = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    usable = vectors.filter(_usable("v"))
    first = usable.orderBy(F.asc_nulls_last("id"), "v").limit(entries).select("v").toArrow()
    if not first.num_rows:
        return None
    longest = usable.agg(F.max(F.size("v"))).first()[0]
    width = max(1, -(-longest // parts)) * parts
    _, start = whole_numbers(first.column("v"), scale, width)
    books = Codebooks(np.ascontiguousarray(start.reshape(len(start), parts, -1).transpose(1, 0, 2)), scale)
    for _ in range(rounds):
        books = _improved(vectors, books)
    return books


def _improved(vectors: DataFrame, books: Codebooks) -> Codebooks:
    parts, n, part = books.entries.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts, n, part), np.int64), np.zeros((parts, n), np.int64)
        slots, ats = np.repeat(np.arange(parts * n), part), np.tile(np.arange(part), parts * n)

        def said() -> pa.RecordBatch:
            used = np.repeat(count.ravel() > 0, part)
            columns = (slots, ats, total.ravel(), np.repeat(count.ravel(), part))
            return pa.RecordBatch.from_arrays([pa.array(c[used]) for c in columns], ["slot", "at", "total", "n"])

        for batch in batches:
            _, x = whole_numbers(batch.column("v"), books.scale, books.width)
            for p in range(parts):
                own = x[:, p * part : (p + 1) * part]
                chosen, _ = nearest(own, books.entries[p])
                order = np.argsort(chosen, kind="stable")
                some, begin = np.unique(chosen[order], return_index=True)
                if len(some):
                    total[p, some] += np.add.reduceat(own[order], begin, axis=0)
                    count[p] += np.bincount(chosen, minlength=n)
            if np.abs(total).max(initial=0) >= 1 << 61:  # long before int64 ends
                yield said()
                total[:], count[:] = 0, 0
        yield said()

    partial = vectors.select("v").mapInArrow(lean(sums), "slot long, at long, total long, n long")
    whole = partial.groupBy("slot", "at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
    entries = books.entries.copy()
    for r in whole.collect():  # one row a component of a codebook
        entries[r.slot // n, r.slot % n, r.at] = int(r.total) // r.n
    return Codebooks(entries, books.scale)


def encode(vectors: DataFrame, books: Codebooks, vec_col: str = "embedding") -> DataFrame:
    """The rows that take part, without the vectors, with ``code`` (two hex digits a part) and ``error`` (squared distance to the entries)."""
    parts, n, part = books.entries.shape
    if n > 256:
        raise ValueError("an index has two hex digits, so a codebook can have 256 entries at most")
    others = appended(vectors.drop(vec_col), "code", "error")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fine, x = whole_numbers(batch.column(batch.num_columns - 1), books.scale, books.width)
            found = [nearest(x[:, p * part : (p + 1) * part], books.entries[p]) for p in range(parts)]
            indexes = np.stack([c for c, _ in found], axis=1).astype(np.uint8)
            digits = indexes.tobytes().hex()
            codes = pa.array([digits[i : i + 2 * parts] for i in range(0, len(digits), 2 * parts)], pa.string())
            kept = batch.filter(pa.array(fine))
            yield pa.RecordBatch.from_arrays([*kept.columns[:-1], codes, pa.array(sum(e for _, e in found))], [*others, "code", "error"])

    quoted = [F.col("`" + c.replace("`", "``") + "`").alias(f"c{i}") for i, c in enumerate(others)]
    return vectors.select(*quoted, F.col(vec_col).cast("array<double>").alias("v")).mapInArrow(lean(run), ", ".join([*others.values(), "code string", "error long"]))


def op11_codes(spark, sf_dir: str) -> DataFrame:
    """Per vector its code and error, the errors of its label, and the digest of the codebooks."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    books = fit(vectors)
    if books is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    coded = stored(encode(vectors, books))
    per_label = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    own = coded.alias("c").join(per_label.alias("s"), F.expr("c.label <=> s.label"))  # labels may be few and large: both sides can be split
    return own.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def _sql(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    steps = []
    for r in range(rounds + 1):
        steps.append(
            f"""d{r} AS MATERIALIZED (SELECT x.rid, x.part, c.entry, sum((x.x - c.c) * (x.x - c.c)) AS d FROM x JOIN c{r} c USING (part, pos) GROUP BY ALL),
a{r} AS MATERIALIZED (SELECT rid, part, entry, d FROM d{r} QUALIFY row_number() OVER (PARTITION BY rid, part ORDER BY d, entry) = 1)"""
        )
        if r < rounds:
            steps.append(
                f"""m{r} AS (SELECT a.part, a.entry, x.pos, CAST(sum(x.x) AS BIGINT) AS s, count(*) AS n FROM a{r} a JOIN x USING (rid, part) GROUP BY ALL),
c{r + 1} AS MATERIALIZED (SELECT part, entry, pos, coalesce((s - ((s % n) + n) % n) // n, c) AS c FROM c{r} LEFT JOIN m{r} USING (part, entry, pos))"""
            )
    last = rounds
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS rid, vec_id, label, embedding, len(embedding) // {parts} AS width FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), f AS (SELECT rid, width, unnest(embedding) AS e, unnest(range(len(embedding))) AS i FROM v),
x AS MATERIALIZED (SELECT rid, i // width AS part, i % width AS pos, CAST(floor({scale} * CAST(e AS DOUBLE)) AS BIGINT) AS x FROM f),
c0 AS MATERIALIZED (SELECT part, rid AS entry, pos, x AS c FROM x WHERE rid < {entries}),
{", ".join(steps)},
h AS (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM c{last}),
r AS (SELECT rid, string_agg(lpad(lower(hex(entry)), 2, '0'), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{last} GROUP BY rid),
o AS (SELECT vec_id, label, code, error FROM v JOIN r USING (rid)),
l AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM o GROUP BY label)
SELECT vec_id, code, error, label_error, codebooks_sha256 FROM o JOIN l ON o.label IS NOT DISTINCT FROM l.label, h
"""


OP11_SQL = _sql()
