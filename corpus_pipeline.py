"""The corpus pipeline: quality, near duplicates, benchmark leaks, mixing, shards.

Each stage takes the table that the stage before it has written and returns it with its own decisions carried out; all but
the last return the columns of ``documents``.

Every stage takes null ids, texts and sources, empty and very long texts, and further columns of any name; rows are judged each by itself, whatever ids
they share.  Empty tables stay empty.  A null text is an empty one: it has the score of a text without words, is no near duplicate
of a text with words (one row of each id stays), leaks nothing, costs the mix nothing and stays once, and has 16 bytes in its shard.  Of
rows with equal texts the one of the smallest id stays.  Equal scores fall on the same side; ties of order go by id, then text.
"""

from pyspark.sql import DataFrame, SparkSession

from clicktrail.llm import decontamination, mixing, neighbours, quality, sharding
from clicktrail.llm.common import table
from clicktrail.spark import materialize


def good(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the factorisation machine, fitted on the labelled ones among them, does not reject."""
    machine = quality.train(docs, table(spark, folder, "labels"))
    return quality.score(docs, machine).where("score >= 0.5").select("row.*")


def different(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One row of each group of near duplicate texts: one with the smallest id."""
    return neighbours.different(docs)


def unseen(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontamination.clean(docs, table(spark, folder, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    return mixing.mixed(docs)


def shards(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The shard and slot of every document of the mix."""
    return sharding.shard(docs)


STAGES = [("quality", good), ("near duplicates", different), ("decontamination", unseen), ("mixing", mixture), ("sharding", shards)]

#: The classifier and the groups of near duplicates are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, folder), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, folder)
