"""Session settings that the engine is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Documents are large: small Arrow batches keep a worker's memory flat.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "500",
}


def configured(builder: SparkSession.Builder) -> SparkSession.Builder:
    return builder.config(map=SETTINGS)
