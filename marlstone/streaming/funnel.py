"""The funnel over arriving messages: it keeps no state, so the batch expressions run unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from marlstone.operators.funnel import funnel


def arriving(spark: SparkSession, path: str, schema, glob: str = "*.parquet", files_per_batch: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).options(pathGlobFilter=glob, maxFilesPerTrigger=str(files_per_batch)).parquet(path)


def flagged(messages: DataFrame, old: bool = False) -> DataFrame:
    return funnel(messages, old)


def append(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Everything that has arrived, once each, also after a restart; then the query ends."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()
