"""File streams that take up where they stopped. Beyond what batch parity needs, this is only the resume rule as a stream."""

from __future__ import annotations

from pyspark.sql import SparkSession


def run_available(spark: SparkSession, source: str, schema: str, sink: str, state: str) -> None:
    """Process what the source folder has and the state doesn't know yet, then stop."""
    stream = spark.readStream.schema(schema).parquet(source)
    stream.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(sink).awaitTermination()
