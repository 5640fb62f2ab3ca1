"""The corpus pipeline: STAGES applied to documents one after the other.

Each stage takes all that its predecessor kept and returns the columns of documents; the last adds those of the mix.
toxicity: documents that the classifier rejects go. line_dedup: repeated lines go, and documents of which nothing is
left. near_dups: the first document of each class stays. decontamination: documents that hold a benchmark item go.
mixing: documents of which the mix takes nothing go; the others come in training order with how much of them is taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumspark.llm import decontamination, line_dedup, mixing, near_dups, toxicity
from vellumspark.llm.common import DOCUMENT_COLUMNS, table, written


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*DOCUMENT_COLUMNS)
    return toxicity.without_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    deduped = line_dedup.dedup_lines(docs.select(*DOCUMENT_COLUMNS)).where(~line_dedup.left_blank())
    changed = F.col("removed_lines").isNotNull()
    return deduped.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*DOCUMENT_COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dups.without_near_dups(docs.select(*DOCUMENT_COLUMNS))


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminated(docs.select(*DOCUMENT_COLUMNS), table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs.select(*DOCUMENT_COLUMNS))


STAGES = [("toxicity", toxic), ("line_dedup", lines), ("near_dups", near), ("decontamination", leaks), ("mixing", mix)]

#: Fitted models, hash sketches and edit distances can't be expressed in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs
