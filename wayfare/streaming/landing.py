"""Streaming intake of a landing folder: each arriving message is parsed once and scored.

An extension of the batch flow. Files are read once (the source's log and the checkpoint see to that);
records that arrive twice by id are dropped within the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.classify import select_kind


def landing(spark: SparkSession, path: str, schema: str = "id string, text string, payload string, arrived timestamp", most: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", most).json(path)


def classified(stream: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Documents with their kind; repeats of an id within the watermark are dropped."""
    return select_kind(stream.withWatermark("arrived", watermark).dropDuplicatesWithinWatermark(["id"]))


def counts(stream: DataFrame, every: str = "10 minutes", watermark: str = "1 hour") -> DataFrame:
    """Arrivals by window and kind."""
    return select_kind(stream.withWatermark("arrived", watermark)).groupBy(F.window("arrived", every), "kind").count()


def write(stream: DataFrame, path: str, checkpoint: str):
    """Everything that has arrived, as Parquet by kind; run again for what arrives later."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("kind").trigger(availableNow=True).start()
