"""The corpus pipeline: five stages, each a DataFrame from the documents that the one before kept."""

from pyspark.sql import DataFrame, SparkSession

from standcarbon.llm import decontam, mixing, near_copies, rules, sharding
from standcarbon.session import discard, staged, tune


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the learned decision list reject go."""
    return rules.keep_good(docs, _table(tune(spark), sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    tune(spark)
    return near_copies.keep_representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold the question and the answer of a benchmark item go."""
    return decontam.drop_contaminated(docs, _table(tune(spark), sf_dir, "benchmark"))


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the order, and as often, as the mixture of the sources shows them."""
    tune(spark)
    return mixing.mix_documents(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document goes: shard and slot, sizes of shards near equal, slots in the order of
    the mixture."""
    tune(spark)
    return sharding.shard_documents(docs, ordered=True)


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing to target weights", mixing_to_weights),
    ("sharding", shards),
]

# The stages are learned, iterative or hash-based; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on `documents`, each one's result written as Parquet and read again."""
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        before, docs = docs, staged(stage(spark, docs, sf_dir))
        discard(before)
    return docs
