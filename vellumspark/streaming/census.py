"""An extension: a census kept up to date from a stream of finding lines. Batches are appended whole or not at all."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumspark.operators import census


def append_new(spark: SparkSession, lines: str, out: str, checkpoint: str):
    """Reads text files of census lines that are new since the last run and appends their rows; returns the finished query."""

    def batch(frame: DataFrame, number: int) -> None:
        census.parsed(frame).withColumn("batch", F.lit(number)).write.mode("append").parquet(out)

    query = spark.readStream.format("text").load(lines).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def daily_counts(events: DataFrame) -> DataFrame:
    """Events by day and type, with an hour's grace for late ones."""
    return events.withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
