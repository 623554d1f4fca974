"""Responses scored as they arrive: an incremental form of response validation and the response cache."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.operators.responses import json_scores


def fresh_responses(stream: DataFrame, keys: list[str], at: str, delay: str = "1 hour") -> DataFrame:
    """The first response of each key within the delay; later copies and late rows are dropped."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def scored_stream(stream: DataFrame, raw: str, fields: list[str], keys: list[str], at: str, delay: str = "1 hour") -> DataFrame:
    return json_scores(fresh_responses(stream, keys, at, delay), raw, fields)


def error_rates(stream: DataFrame, at: str, window: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """Responses and failed ones per event-time window."""
    timed = stream.withWatermark(at, delay).groupBy(F.window(at, window))
    return timed.agg(F.count(F.lit(1)).alias("n_responses"), F.count_if(F.col("parse_error").isNotNull()).alias("n_failed")).select("window.start", "window.end", "n_responses", "n_failed")
