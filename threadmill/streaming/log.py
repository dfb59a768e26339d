"""A run log as a stream: answers appended as JSON lines are counted as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

LOG = "ts timestamp, q string, route string, n_evidence int, refused boolean"


def log_counts(spark: SparkSession, path: str, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    rows = spark.readStream.schema(LOG).json(path).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", window), "route").agg(F.count("*").alias("n"), F.count_if("refused").alias("n_refused"))
