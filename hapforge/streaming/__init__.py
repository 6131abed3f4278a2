"""Counts over arriving variant blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def arriving_counts(spark: SparkSession, folder: str, schema: str = "variant_idx bigint, hap_idx bigint") -> DataFrame:
    """A stream of (variant_idx, stored) over Parquet files of cells as they arrive; update or complete mode."""
    return spark.readStream.schema(schema).parquet(folder).groupBy("variant_idx").agg(F.count(F.lit(1)).alias("stored"))
