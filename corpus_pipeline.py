"""A training corpus from raw documents: STAGES in order, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelloom.llm import decontaminate, mixing, near_dedup, quality_classifier, sharding
from panelloom.llm.common import new_folder, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled documents outside the held-out fold, accepts.

    Null and empty texts have no features and go or stay by the model's bias. Null ids, sources and languages, repeated rows and further columns of any name are carried along; an empty table gives no row.
    """
    model = quality_classifier.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "quality", folds=5, fold=0)
    return quality_classifier.good_documents(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id.

    Null and empty texts are like nothing and stay. Null ids, sources and languages, repeated rows and further columns of any name are carried along; of rows with the same id one stays; an empty table gives no row.
    """
    return near_dedup.first_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words less than one in twenty lie in passages of benchmark items, without these passages.

    Null and empty texts hold no passage and stay; texts are cut until no passage of 13 item words is left. Null ids, sources and languages, repeated rows and further columns of any name are carried along; an empty table gives no row.
    """
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, each copy at its place in the schedule: the rows, and the files in order of their names, are in training order.

    Null and empty texts have no words and are not taken. Null ids, sources and languages, repeated rows and further columns of any name are carried along; a null source is a source of its own; an empty table gives no row.
    """
    return mixing.mixed_documents(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every row of the mix, with its id, size and checksum.

    Null and empty texts have the size of the row bytes; repeated rows (copies of the mix) have slots of their own; null ids stay null; an empty table gives no row.
    """
    return sharding.byte_shards(docs, shards=24)


STAGES = [("quality classifier", quality), ("near-duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixture), ("sharding", shards)]

#: Trained models and tables of hashes decide; see tests/llm for the checks against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), new_folder(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
