"""Search in text blocks: anchors, windows, patterns, recurring lines."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docengine.functions.text import normalised


def anchor_hits(blocks: DataFrame, terms: Sequence[str]) -> DataFrame:
    """The blocks that contain a term, with the position of the first one that they contain."""
    text = normalised(F.col("raw_text"))
    found = F.coalesce(*[F.when(text.contains(normalised(F.lit(t))), i) for i, t in enumerate(terms)], F.lit(None).cast("int"))
    return blocks.withColumn("term", found).filter("term is not null")


def following(blocks: DataFrame, n: int, text: str = "raw_text") -> DataFrame:
    """Adds window: the block and the next n of its document, as one text."""
    w = Window.partitionBy("doc_id").orderBy("block_order").rowsBetween(0, n)
    return blocks.withColumn("window", F.array_join(F.collect_list(text).over(w), "\n"))


def preceding(blocks: DataFrame, n: int, text: str = "raw_text") -> DataFrame:
    """Adds context: the n blocks before, as one text."""
    w = Window.partitionBy("doc_id").orderBy("block_order").rowsBetween(-n, -1)
    return blocks.withColumn("context", F.array_join(F.collect_list(text).over(w), " "))


def around(blocks: DataFrame, hits: DataFrame, n: int) -> DataFrame:
    """(hit_order, block columns): the blocks within n of each hit; an equi-join on document and order."""
    near = hits.select("doc_id", F.col("block_order").alias("hit_order"), F.explode(F.sequence(F.col("block_order") - n, F.col("block_order") + n)).alias("block_order"))
    return blocks.join(near, ["doc_id", "block_order"])


def regex_values(blocks: DataFrame, anchors: Sequence[str], pattern: str, window: int, group: int = 1) -> DataFrame:
    """(doc_id, block_order, value): the pattern's first match in the window behind each anchor, found in one pass."""
    text = normalised(F.col("raw_text"))
    anchored = reduce(Column.__or__, [text.contains(normalised(F.lit(t))) for t in anchors])
    hits = following(blocks.withColumn("anchored", anchored), window).filter("anchored")
    return hits.withColumn("value", F.regexp_extract("window", pattern, group)).filter("value <> ''").select("doc_id", "block_order", "value")


def cascade(documents: DataFrame, steps: Sequence[DataFrame]) -> DataFrame:
    """(doc_id, step, value): the first step with a value for each document; values of one step must agree, else null."""
    every = None
    for i, s in enumerate(steps):
        one = s.groupBy("doc_id").agg(F.when(F.countDistinct("value") == 1, F.min("value")).alias("value"), F.lit(i).alias("step"))
        every = one if every is None else every.unionByName(one)
    best = every.groupBy("doc_id").agg(F.min_by(F.struct("step", "value"), "step").alias("b"))
    return documents.join(best, "doc_id", "left").select("doc_id", F.col("b.step").alias("step"), F.col("b.value").alias("value"))


def recurring_lines(blocks: DataFrame, margin: float, at_least: int) -> DataFrame:
    """Texts that stand in the top or bottom margin of several documents and never elsewhere."""
    inside = (F.col("y0") > margin) & (F.col("y0") < 1 - margin)
    return blocks.filter("trim(raw_text) <> ''").groupBy("raw_text").agg(F.countDistinct("doc_id").alias("n_docs"), F.bool_or(inside).alias("elsewhere")).filter((F.col("n_docs") >= at_least) & ~F.col("elsewhere")).select("raw_text", "n_docs")


def section_ends(positions: DataFrame, key: str, order: str) -> DataFrame:
    """(key, order, end): each position itself, those 1, 2, 4, ... after it as far as the key goes, and the key's last."""
    last = positions.groupBy(key).agg(F.max(order).alias("_last"))
    steps = F.array(*[F.lit(1 << k) for k in range(31)])
    inside = lambda s: s <= F.col("_last") - F.col(order)
    ends = F.array_union(F.array(F.col(order), F.col("_last")), F.transform(F.filter(steps, inside), lambda s: F.col(order) + s))
    far = positions.join(last, key).select(key, order, F.explode(ends).alias("end"))
    return far.join(positions.select(key, F.col(order).alias("end")), [key, "end"])


def look_ahead(positions: DataFrame, key: str, order: str, most: int = 32) -> DataFrame:
    """(key, order, end): for each position those 1, 2, 4, ... after it that exist."""
    steps = F.array(*[F.lit(1 << k) for k in range(most.bit_length()) if 1 << k <= most])
    far = positions.select(key, order, F.explode(F.transform(steps, lambda s: F.col(order) + s)).alias("end"))
    return far.join(positions.select(key, F.col(order).alias("end")), [key, "end"])
