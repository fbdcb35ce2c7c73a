"""Files as they arrive: the batch filters and features, unchanged, on a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def arriving(spark: SparkSession, path: str, schema: StructType, files: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def ingest(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], to: str, checkpoint: str):
    """All that has arrived, transformed without state and appended to Parquet."""
    return transform(stream).writeStream.format("parquet").option("path", to).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hourly(stream: DataFrame, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    return stream.withWatermark(ts, late).groupBy(F.window(ts, "1 hour")).agg(F.count("*").alias("n"))
