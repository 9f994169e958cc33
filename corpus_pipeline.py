"""Corpus pipeline: from documents to token ids, one operator of docengine.llm per stage.

Every stage reads all rows that the one before kept. All stages but the last return the columns
of their input, whatever other columns it has. Rows with null or empty texts pass through the
filtering stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docengine.llm import bpe, decontaminate, ngram_join, secrets, toxicity
from docengine.llm.sieve import sieved, whole, without
from docengine.session import cut


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of being toxic is under one half.

    Null and empty texts are never toxic; whole texts are read; repeated rows are judged alike. With
    no usable labels, all rows stay; an empty table stays empty.
    """
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.without_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates (five words, 0.8).

    Rows without words are in no group and stay. Of rows with one id and one text, one stays, the
    first in the order of its other columns; rows with one id and different texts stay or go
    together. Whole texts are compared; an empty table stays empty.
    """
    groups = cut(ngram_join.ngram_join(docs, size=5, num=4, den=5))
    kept = without(docs, cut(groups.filter("doc_id <> component_id").select("doc_id")), "doc_id")
    repeated = cut(groups.filter("doc_id is not null and n_shingles > 0").groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    if repeated.isEmpty():
        return kept
    again = sieved(kept, repeated, "doc_id").select(whole(docs).alias("row"), "doc_id", "text").join(repeated, "doc_id")
    ranked = again.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.to_json("row"))))
    return without(kept, repeated, "doc_id").unionByName(ranked.filter("rank = 1").select("row.*"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark.

    Null and empty texts hold none; whole texts are scanned, and of repeated rows all or none stay.
    An empty table or benchmark leaves all rows.
    """
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark, n_chars being the new text's length.

    Null and empty texts stay as they are; whole texts are scanned; repeated rows change alike;
    overlapping spans get one mark. An empty table stays empty.
    """
    return secrets.redacted(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str, path: str | None = None) -> DataFrame:
    """Token ids of every document, and whether they decode to its text.

    Null and empty texts have no ids; whole texts are encoded; each repeated row has its own result;
    an empty table gives an empty result.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    wanted = docs.select(F.struct("doc_id", "lang", "source", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).alias("key"), "text")
    both = bpe.encode_decode(wanted, path, id_col="key")
    same = F.xxhash64("decoded") == F.col("key.h")
    return both.select("key.doc_id", "key.lang", "key.source", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("tokens", tokenize),
]

#: The first stage is a fitted model, so SQL can't express the pipeline; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table documents; each stage's rows are checkpointed for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs)
    return docs
