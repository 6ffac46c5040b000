"""The corpus pipeline: toxicity, near duplicates, benchmark decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read
again as the docs of the next. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from metaweave.llm import common, decontamination, mixing, near_dedup, sharding, toxicity


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.3 or more go."""
    return toxicity.remove(docs, toxicity.train(docs, common.read_table(spark, sf_dir, "labels")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one document stays."""
    return near_dedup.deduplicate(docs)


def contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more are benchmark windows go."""
    return decontamination.remove(docs, common.read_table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document that the mix takes, its text what is taken, in order of the mix."""
    return mixing.mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and place of every row."""
    return sharding.assign(docs)


STAGES = [("toxicity", toxic), ("near_dedup", near_copies), ("decontamination", contaminated), ("mixing", mix), ("sharding", shard)]

#: Toxicity, near duplicates and mixing can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        last, docs = docs, common.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if name != STAGES[0][0]:
            common.drop(last)
    return STAGES[-1][1](spark, docs, sf_dir)
