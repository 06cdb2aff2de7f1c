"""Corpus pipeline: quality, near copies, benchmark leaks, mixing, shards.

Each stage takes (spark, docs, sf_dir) and gives the documents that it keeps, with the columns of
documents; the last adds the shard and the place in it. Null and empty texts, repeated rows and empty
tables pass through as the operators define.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mrloom.llm import decontaminate, jaccard_join, quality_rules, reshard, soft_mixing
from mrloom.llm.common import scratch, stored, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble rejects go."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the least id stays, whatever ids are null or repeat; texts without words all stay."""
    return jaccard_join.one_of_each(docs)


def keep_unleaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


#: Shares of all words that texts without and with toxic language are to have; junk is gone by then.
SHARES = [0.95, 0.05]


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document is taken as often as its fitted rate says: clean ones once or more, toxic ones less often."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("domain"))
    return soft_mixing.mix(docs, labels, SHARES)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Moved from a shard per source to shards of near equal bytes."""
    return reshard.reshard(docs, reshard.by_source(docs), reshard.N_SHARDS, scratch(spark, "shards")).drop("old_shard", "size")


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", keep_one_of_each),
    ("benchmark decontamination", keep_unleaked),
    ("mixing sources to target weights", mix),
    ("sharding", shard),
]

#: Fitted models stand in the first and fourth stage; the tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.split()[0])
    return docs
