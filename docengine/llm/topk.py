"""Exact top-k inner-product search with a pivot-distance index.

Components x become floor(256 * x). Every vector is keyed by its nearest pivot and by the ring
(a band of distances to that pivot) that it lies in. For a query q and a vector x of a ring,

    2 * (q . x) = |q|^2 + |x|^2 - d(q, x)^2   and   d(q, x) >= |d(q, pivot) - d(x, pivot)|,

so the rings' distance limits and largest norms bound the scores in them. A query first visits
the rings with the highest bounds, as many as hold ``first`` vectors; its k-th score so far then
rules out all rings, and within a visited ring all distances, whose bound lies below it. What is
left is computed in integers, so the result is exact; ties go to the smaller id.

The pivots come from at most ``sample`` vectors (smallest hashes of their ids); every vector is
indexed. There is a pivot for every 16 of the square root of the number of vectors, 16 at least and
``most_pivots`` at most, so at most most_pivots * n_rings rings are described on the driver. Large
rings are dealt out in blocks, and so are the queries that visit a ring, so that neither equal
vectors nor queries in any number meet in one task.

Vectors that are null or hold null or non-finite components take no part, neither as queries nor
as candidates; shorter vectors count as padded with zeros. Repeated rows of one id are
candidates each for themselves; a query id is asked once, with its smallest vector, and no row
of its own id is its candidate. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docengine.llm.words import lean, list_array
from docengine.session import cut


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list<long> column as rows, padded with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    flat, lengths = column.flatten().to_numpy(), np.diff(column.offsets.to_numpy())
    if len(lengths) and (lengths == width).all():
        return flat.reshape(len(column), width)
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width)[None, :] < lengths[:, None]] = flat
    return out


def _far(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of x and y."""
    x, y = x.astype(np.float64), y.astype(np.float64)
    return np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T))


def choose_pivots(vectors: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first choice of up to n different rows."""
    chosen = [0]
    far = _far(vectors, vectors[:1])[:, 0]
    while len(chosen) < n and far.max() > 1e-6:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, _far(vectors, vectors[chosen[-1:]])[:, 0])
    return vectors[chosen]


def scaled(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, v): the vectors that take part, in integers."""
    x = F.col(vec_col)
    fine = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * 256).cast("long"))
    return vectors.filter(F.col(id_col).isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("v"))


class Rings:
    """Pivots and what is known of each ring: rows, limits of the distance, largest norm."""

    def __init__(self, pivots: np.ndarray, width: float, n_rings: int) -> None:
        self.pivots, self.width, self.n_rings = pivots, width, n_rings
        self.cells: list[int] = []

    def key(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ring and the distance to its pivot of each vector."""
        far = _far(v, self.pivots)
        near = far.argmin(axis=1)
        d = far[np.arange(len(v)), near]
        return near * self.n_rings + np.minimum(d / self.width, self.n_rings - 1).astype(np.int64), d

    def describe(self, rows: list, block_rows: int) -> None:
        rows = sorted(rows, key=lambda r: r.cell)
        self.cells = np.array([r.cell for r in rows], np.int64)
        self.count = np.array([r.n for r in rows], np.int64)
        self.low, self.high = (np.array([r[c] for r in rows]) for c in ("low", "high"))
        self.norm = np.array([r.norm for r in rows], np.float64)
        self.blocks = -(-self.count // block_rows)

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """No score of a vector of a ring (columns) for a query (rows) lies above this."""
        to = _far(q, self.pivots)[:, self.cells // self.n_rings]
        apart = np.maximum(0, np.maximum(to - self.high, self.low - to) - 1e-3)
        square = (q.astype(np.float64) ** 2).sum(axis=1)[:, None]
        return np.minimum((square + self.norm - apart**2) / 2, np.sqrt(square * self.norm)) * (1 + 1e-9) + 1


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", most_pivots: int = 512, n_rings: int = 8, sample: int = 4096, first: int = 512, query_rows: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of ``vectors`` for which is_query holds."""
    spark = vectors.sparkSession
    out_type = "query_id long, vec_id long, score long"
    every = scaled(vectors, id_col, vec_col)
    seen = every.select("vec_id", "v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow()  # bounded by sample
    if not seen.num_rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width, total = every.agg(F.max(F.size("v")), F.count("*")).first()
    known = _matrix(seen.column("v"), width)
    pivots = choose_pivots(known, min(most_pivots, max(16, math.isqrt(total) // 16)))
    rings = Rings(pivots, max(1.0, float(np.quantile(_far(known, pivots).min(axis=1), 0.98)) / n_rings), n_rings)
    plain = spark.sparkContext.broadcast(rings)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column("v"), width)
            cell, d = plain.value.key(v)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), list_array(list(v)), pa.array(cell), pa.array(d), pa.array((v.astype(np.float64) ** 2).sum(axis=1))], ["vec_id", "v", "cell", "d", "norm"])

    indexed = cut(every.mapInArrow(lean(index), "vec_id long, v array<long>, cell long, d double, norm double"))
    described = indexed.groupBy("cell").agg(F.count("*").alias("n"), F.min("d").alias("low"), F.max("d").alias("high"), F.max("norm").alias("norm")).collect()  # one row a ring
    rings = Rings(rings.pivots, rings.width, n_rings)
    rings.describe(described, min(max(256, total // 256), 16384))
    full = spark.sparkContext.broadcast(rings)
    sizes = spark.createDataFrame(list(zip(rings.cells.tolist(), rings.blocks.tolist(), strict=True)), "cell long, blocks long")  # one row a ring
    placed = indexed.join(F.broadcast(sizes), "cell").withColumn("blk", F.pmod(F.xxhash64("vec_id"), F.col("blocks"))).drop("blocks")
    queries = scaled(vectors.filter(is_query), id_col, vec_col).groupBy("vec_id").agg(F.min("v").alias("q")).withColumnRenamed("vec_id", "query_id")

    def route(later: bool):
        """The blocks that a query visits: at first those of the best rings, later all others that may hold better vectors."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = full.value
            for batch in batches:
                q = _matrix(batch.column("q"), width)
                bound = own.bounds(q)
                order = np.argsort(-bound, axis=1, kind="stable")
                held = np.cumsum(own.count[order], axis=1) - own.count[order]
                chosen = np.zeros(bound.shape, bool)
                np.put_along_axis(chosen, order, held < first, axis=1)
                tau = np.array([-np.inf if t is None else t for t in batch.column("tau").to_pylist()])
                if later:
                    chosen = ~chosen & (bound >= tau[:, None])
                row, cell = np.nonzero(chosen)
                n = own.blocks[cell]
                row, cell = np.repeat(row, n), np.repeat(cell, n)
                blk = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(own.cells[cell]), pa.array(blk), batch.column("query_id").take(at), list_array([q[i] for i in row]), pa.array(tau[row])], ["cell", "blk", "query_id", "q", "tau"])

        return run

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        own = full.value
        right = right.sort_by("d")
        ids, v, d = right.column("vec_id").to_numpy(), _matrix(right.column("v"), width), right.column("d").to_numpy()
        names, asked, tau = left.column("query_id").to_numpy(), _matrix(left.column("q"), width), left.column("tau").to_numpy()
        found: list[tuple] = []
        if len(ids) and len(names):
            cell = int(left.column("cell")[0].as_py())
            to = _far(asked, own.pivots)[:, cell // own.n_rings]
            norm = right.column("norm").to_numpy().max()
            square = (asked.astype(np.float64) ** 2).sum(axis=1)
            reach = np.where(np.isfinite(tau), np.sqrt(np.maximum(0, square + norm - 2 * np.where(np.isfinite(tau), tau, 0) + 2)) + 1e-2, np.inf)
            lows, highs = np.searchsorted(d, to - reach), np.searchsorted(d, to + reach, side="right")
            for name, x, low, high, least in zip(names.tolist(), asked, lows.tolist(), highs.tolist(), tau.tolist(), strict=True):
                s, near = v[low:high] @ x, ids[low:high]
                fine = (near != name) & (s >= least)
                s, near = s[fine], near[fine]
                if len(s) > k:
                    keep = np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k])
                    s, near = s[keep], near[keep]
                best = np.lexsort((near, -s))[:k]
                found += [(name, int(i), int(t)) for i, t in zip(near[best], s[best], strict=True)]
        return pa.table({n: pa.array([f[j] for f in found], pa.int64()) for j, n in enumerate(("query_id", "vec_id", "score"))})

    def visit(asked: DataFrame, later: bool) -> DataFrame:
        sent = cut(asked.mapInArrow(lean(route(later)), "cell long, blk long, query_id long, q array<long>, tau double"))
        visits = sent.filter("blk = 0").groupBy("cell").count().collect()  # one row a ring
        parts = lambda: F.broadcast(spark.createDataFrame([(r.cell, -(-r[1] // query_rows)) for r in visits], "cell long, parts long"))
        asked = sent.join(parts(), "cell").withColumn("part", F.pmod(F.xxhash64("query_id", F.lit("part")), F.col("parts")))
        found = placed.join(parts(), "cell").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        return asked.groupBy("cell", "blk", "part").cogroup(found.groupBy("cell", "blk", "part")).applyInArrow(search, out_type)

    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    start = cut(visit(queries.withColumn("tau", F.lit(None).cast("double")), False))
    limits = start.withColumn("r", F.row_number().over(ranked)).filter(F.col("r") == k).select("query_id", F.col("score").cast("double").alias("tau"))
    rest = visit(queries.join(limits, "query_id", "left"), True)
    return start.unionByName(rest).withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op9_topk(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
