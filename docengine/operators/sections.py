"""Sections of documents: windows around hits, expansion, packing of requests, coverage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def context_windows(blocks: DataFrame, hits: DataFrame, around: int = 3, most: int = 16, band: float = 0.05) -> DataFrame:
    """(doc_id, hit_order, block_order): the blocks around hits; hits in one band of a page's height count once, and each document keeps its first ``most``.

    The limit is the feature: a window list for a reader.
    """
    w = Window.partitionBy("doc_id", F.floor(F.col("y0") / band)).orderBy("block_order")
    first = hits.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")
    few = first.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy("block_order"))).filter(F.col("_n") <= most)
    near = few.select("doc_id", F.col("block_order").alias("hit_order"), F.explode(F.sequence(F.col("block_order") - around, F.col("block_order") + around)).alias("block_order"))
    return blocks.select("doc_id", "block_order").join(near, ["doc_id", "block_order"])


def expansions(blocks: DataFrame, anchors: DataFrame, around: int, budget: int) -> DataFrame:
    """(doc_id, anchor, block_order): neighbours of each anchor in order while their bytes fit; the first that doesn't ends it."""
    near = anchors.select("doc_id", F.col("block_order").alias("anchor"), F.explode(F.sequence(F.col("block_order") - around, F.col("block_order") + around)).alias("block_order"))
    sized = blocks.select("doc_id", "block_order", F.octet_length("raw_text").alias("size")).join(near, ["doc_id", "block_order"])
    w = Window.partitionBy("doc_id", "anchor").orderBy("block_order").rowsBetween(Window.unboundedPreceding, 0)
    return sized.withColumn("used", F.sum("size").over(w)).filter(F.col("used") <= budget).select("doc_id", "anchor", "block_order")


REQUESTS = "batch long, role string, chunk int, request int"


def packed_requests(chunks: DataFrame, overhead: int, budget: int) -> DataFrame:
    """(batch, role, chunk, request): chunks of both roles packed in turns under a byte budget.

    The roles alternate; where the next of one doesn't fit, the other's is tried, and where
    neither fits a new request begins. A separator counts between parts. What doesn't fit an
    empty request stays unpacked with everything behind it in its role (request null).
    """

    def pack(batch: pd.DataFrame) -> pd.DataFrame:
        waiting = {r: list(g.sort_values("chunk")[["chunk", "size"]].itertuples(index=False)) for r, g in batch.groupby("role")}
        queues = {r: waiting.get(r, []) for r in ("reference", "actual")}
        out, request = [], 0
        while any(queues.values()):
            used, parts = overhead, 0
            turn = "reference" if queues["reference"] else "actual"
            while True:
                rest = "actual" if turn == "reference" else "reference"
                role = next((r for r in (turn, rest) if queues[r] and used + queues[r][0].size + bool(parts) <= budget), None)
                if role is None:
                    break
                chunk = queues[role].pop(0)
                used += chunk.size + bool(parts)
                parts += 1
                out.append((role, chunk.chunk, request))
                turn = "actual" if role == "reference" else "reference"
            if not parts:
                break
            request += 1
        out += [(r, c.chunk, None) for r, q in queues.items() for c in q]
        frame = pd.DataFrame(out, columns=["role", "chunk", "request"]).astype({"request": "Int32", "chunk": "int32"})
        return frame.assign(batch=batch["batch"].iloc[0])[["batch", "role", "chunk", "request"]]

    return chunks.groupBy("batch").applyInPandas(pack, REQUESTS)


def answered(parts: DataFrame, call: Callable[[str], str]) -> DataFrame:
    """The model port: adds answer, the injected function of each row's text, and error for calls that raised."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for x in batch["text"]:
                try:
                    found.append((call(x), None))
                except Exception as e:  # noqa: BLE001  a failed call is a result of its row
                    found.append((None, type(e).__name__))
            yield batch.assign(answer=[f[0] for f in found], error=[f[1] for f in found])

    names = ", ".join(f"`{n}` {t}" for n, t in parts.dtypes)
    return parts.mapInPandas(run, f"{names}, answer string, error string")


def gaps(expected: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Expected rows that no section covered."""
    return expected.join(seen.select(*keys).distinct(), keys, "left_anti")


def grounded(results: DataFrame) -> DataFrame:
    """Adds status: CANDIDATE for complete, quoted and unambiguous results, else why not."""
    status = F.when(F.col("n_quotes") == 0, "NOT_GROUNDED").when(F.col("ambiguous"), "CLARIFICATION_REQUIRED").when(~F.col("complete"), "INCOMPLETE").otherwise("CANDIDATE")
    return results.withColumn("status", status)
