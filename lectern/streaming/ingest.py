"""Optional ingestion of arriving link records as a stream: late records within the watermark are counted, re-delivered ones once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def monthly_links(spark: SparkSession, path: str, schema, watermark: str = "40 days") -> DataFrame:
    """(month, n) of link records by imported_at; a record counts once by id and time."""
    s = spark.readStream.schema(schema).parquet(path)
    s = s.withWatermark("imported_at", watermark).dropDuplicatesWithinWatermark(["id"])
    return s.groupBy(F.window("imported_at", "30 days").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")
