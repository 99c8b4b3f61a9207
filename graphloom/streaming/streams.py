"""The same operators on streams: triples seen once, chunks of arriving pages, windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.chunking import chunks


def new_triples(triples: DataFrame, ts: str = "ts", lateness: str = "1 hour") -> DataFrame:
    """Each triple once within the watermark; the state is bounded by it."""
    return triples.withWatermark(ts, lateness).dropDuplicatesWithinWatermark(["s", "p", "o", "o_kind"])


def stream_chunks(pages: DataFrame, id: str, text: str, size: int = 220, overlap: int = 50) -> DataFrame:
    """Chunks of pages as they arrive; no state."""
    return chunks(pages, id, text, size, overlap)


def windowed_counts(rows: DataFrame, key: str, ts: str = "ts", width: str = "1 hour", lateness: str = "1 hour") -> DataFrame:
    """Counts of a key in tumbling windows of event time."""
    grouped = rows.withWatermark(ts, lateness).groupBy(F.window(ts, width).alias("w"), F.col(key).alias("key")).agg(F.count("*").alias("n"))
    return grouped.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "key", "n")
