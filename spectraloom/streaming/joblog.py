"""Job-log lines as a stream: the batch parser applies unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spectraloom.sources.text import parse_log_lines


def stream_log_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Parsed lines of log files as they appear in ``folder``."""
    return parse_log_lines(spark.readStream.text(folder))
