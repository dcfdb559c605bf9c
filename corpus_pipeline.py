"""From documents to training shards: toxic documents out, near copies out, benchmark documents out, sources mixed, shards dealt.

Each stage works on all that the one before kept, written as Parquet to the shared folder and read again. Rows that share
a doc_id are one document to the near-copy stage. Nulls are handled as the operators' docstrings say.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import decontam, mixing, neardup, sharding, toxicity
from barloom.llm.common import column, free_name, table
from barloom.session import cut_lineage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, scores below one half."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    score = free_name(docs, "score")
    return docs.withColumn(score, toxicity.score_column(model, F.col("text"))).filter(column(score) < 0.5).drop(score)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shingles of five words link at a similarity of 0.8."""
    gone = neardup.near_duplicates(docs, percent=80).filter("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*[column(c) for c in docs.columns])


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontam.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, those of smaller sources up to twice."""
    return mixing.mix_documents(docs, mixing.Target(repeats=2.0))


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row with its shard and its slot there: one pass of the mixture after the other, in mixing's order."""
    return sharding.training_shards(docs)


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_copies), ("decontamination", drop_benchmark), ("mixing", mix_sources), ("sharding", deal_shards)]
ORACLE_SQL = None   # the fitted classifier has no SQL form; tests/llm compares the stages with plain Python


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
