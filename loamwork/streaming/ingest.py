"""Structured Streaming: file ingest, keep-once by key within a watermark, windows over events.

State is bounded by the watermark: a row later than it is not seen again, and duplicates further apart than it are
two rows.  Resuming is the checkpoint's work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def stream(spark: SparkSession, path: str, schema: StructType, kind: str = "json", files_a_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).format(kind).load(path)


def once(events: DataFrame, keys: list[str], time: str, delay: str = "1 hour") -> DataFrame:
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def tumbling(events: DataFrame, time: str, width: str, by: list[str], delay: str | None = None, slide: str | None = None) -> DataFrame:
    rows = events.withWatermark(time, delay) if delay else events
    return rows.groupBy(F.window(time, width, slide) if slide else F.window(time, width), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, time: str, gap: str, by: list[str], delay: str | None = None) -> DataFrame:
    rows = events.withWatermark(time, delay) if delay else events
    return rows.groupBy(F.session_window(time, gap), *by).agg(F.count(F.lit(1)).alias("n"))
