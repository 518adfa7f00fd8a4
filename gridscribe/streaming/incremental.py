"""Incremental append with resume by key, as a stream that takes what is there and stops."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.types import StructType

from ..sources.files import append_filtered, append_new


def append_stream(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, key: str) -> None:
    """Files of `source` not yet seen are read once; each batch adds the rows whose key the target lacks, so a repeated batch adds none."""
    stream = spark.readStream.schema(schema).parquet(source)
    query = stream.writeStream.foreachBatch(lambda df, _: append_new(df, target, key) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def append_stream_filtered(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, key: str) -> None:
    """append_stream to a target with a filter for each part: a batch reads those parts only that may hold one of its keys."""
    stream = spark.readStream.schema(schema).parquet(source)
    query = stream.writeStream.foreachBatch(lambda df, _: append_filtered(df, target, key) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
