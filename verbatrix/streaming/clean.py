"""Extension: cleaning of a stream. The cleaner keeps no state, so it needs no watermark and any output mode that appends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

from ..operators.sampling import clean_column


def clean_stream(stream: DataFrame, column: str, **how) -> DataFrame:
    return clean_column(stream, column, **how)


def clean_files(spark: SparkSession, source: str, schema: str, column: str, target: str, checkpoint: str, **how) -> DataStreamWriter:
    """Parquet files as they come, cleaned, to ``target``; start() the result."""
    stream = clean_stream(spark.readStream.schema(schema).parquet(source), column, **how)
    return stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True)
