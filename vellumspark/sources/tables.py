"""Bindings of tables to the package model: which rows are books, documents and blocks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumspark.functions import text as X


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settled(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the folder that spark.checkpoint.dir names, so that what reads it several times computes it once
    and no executor has to remember it; in local mode, where that is unset, in a temporary folder."""
    spark = df.sparkSession
    path = f"{work_folder(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def work_folder(spark: SparkSession) -> str:
    """A new folder that the driver and all executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="vellumspark-")
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def page_docs(pages: DataFrame) -> DataFrame:
    """book_id (host), pos, path, html of web pages."""
    return pages.select(X.host(F.col("url")).alias("book_id"), F.col("page_id").alias("pos"), X.url_path(F.col("url")).alias("path"), "html")


def text_docs(documents: DataFrame) -> DataFrame:
    """book_id (source), pos, text of plain documents, which are visible text already."""
    return documents.select(F.col("source").alias("book_id"), F.col("doc_id").alias("pos"), F.coalesce("text", F.lit("")).alias("text"))


def line_blocks(docs: DataFrame) -> DataFrame:
    """book_id, pos, idx, text of the non-blank lines of text documents."""
    lines = docs.select("book_id", "pos", F.posexplode(F.split("text", "\n", -1)).alias("idx", "text"))
    return lines.withColumn("text", F.trim("text")).where("text <> ''")


def word_blocks(docs: DataFrame, size: int = 30) -> DataFrame:
    """book_id, pos, idx, text: documents cut every `size` words, as a line-wrapping converter leaves them."""
    words = docs.select("book_id", "pos", F.split(F.trim(X.replaced(F.col("text"), "\\s+", " ")), " ").alias("w"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - 1, F.lit(0)), F.lit(size))
    return words.select("book_id", "pos", "w", F.posexplode(starts).alias("idx", "at")).select("book_id", "pos", "idx", F.array_join(F.slice(F.col("w"), F.col("at") + 1, size), " ").alias("text")).where("text <> ''")


def numbered_blocks(docs: DataFrame, width: int = 200) -> DataFrame:
    """book_id, pos, idx, text: documents cut every `width` characters with a running page number between the cuts."""
    pieces = docs.where("length(text) > 0").select("book_id", "pos", "text", F.posexplode(F.sequence(F.lit(0), F.length("text") - 1, F.lit(width))).alias("n", "at"))
    pieces = pieces.select("book_id", "pos", "n", F.trim(X.replaced(F.substring("text", F.col("at") + 1, F.lit(width)), "\\s+", " ")).alias("piece")).where("piece <> ''")
    both = F.array(F.struct((F.col("n") * 2).alias("idx"), F.col("piece").alias("text")), F.struct((F.col("n") * 2 + 1).alias("idx"), (F.col("n") + 1).cast("string").alias("text")))
    return pieces.select("book_id", "pos", F.explode(both).alias("b")).select("book_id", "pos", "b.idx", "b.text")
