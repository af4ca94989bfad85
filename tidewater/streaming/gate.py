"""The lexicon gate and event counts over streams; the same operators as in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.operators.classify import flag, gated


def gate_stream(units: DataFrame, text_cols: list[str], late: str = "1 day") -> DataFrame:
    """Hits of a stream of units, each id once within the watermark."""
    return gated(flag(units.withWatermark("date", late).dropDuplicatesWithinWatermark(["doc_id"]), text_cols))


def windowed_counts(events: DataFrame, at: str, by: str, value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    agg = events.withWatermark(at, late).groupBy(F.window(at, width), by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return agg.select(F.col("window.start").alias("start"), by, "n", "total")
