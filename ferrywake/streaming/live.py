"""Logs as a stream: the same parsers over files as they arrive, and windowed counts with bounded state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import logs
from ..operators.summary import present


def read(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Entries of the text files that appear in a folder. Lines of a stream have no numbers; file_index is 0."""
    text = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)
    return logs.entries(text.select(F.lit(0).alias("file_index"), F.lit(None).cast("bigint").alias("line_number"), F.col("value").alias("raw_line")))


def slow_by_window(entries: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Slow queries by time window and namespace; a window is final once the stream is `late` beyond it."""
    rows = present(entries).where(F.col("is_slow") & F.col("duration_ms").isNotNull()).select(F.timestamp_millis("ts_ms").alias("ts"), "namespace", "duration_ms")
    counted = rows.withWatermark("ts", late).groupBy(F.window("ts", width), "namespace")
    return counted.agg(F.count("*").alias("n"), F.sum("duration_ms").alias("total_ms"), F.max("duration_ms").alias("max_ms"))


def severity_by_window(entries: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    rows = present(entries).select(F.timestamp_millis("ts_ms").alias("ts"), "severity")
    return rows.withWatermark("ts", late).groupBy(F.window("ts", width), "severity").agg(F.count("*").alias("n"))
