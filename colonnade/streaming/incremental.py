"""The engine's stateless operators run on streams unchanged; this adds windowed grouping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import UNSUPPORTED_METHOD, require

_AGG = {"sum": F.sum, "min": F.min, "max": F.max, "avg": F.avg, "count": F.count}


def windowed_group_by(stream: DataFrame, time: str, window: str, keys: list[str], op: str, value: str, late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """One aggregate per key and time window; state is dropped once ``late`` has passed."""
    require(op in _AGG, UNSUPPORTED_METHOD, op)
    frame = F.window(time, window, slide) if slide else F.window(time, window)
    grouped = stream.withWatermark(time, late).groupBy(frame.alias("window"), *keys).agg(_AGG[op](value).alias(f"{op}_{value}"))
    return grouped.select(F.col("window.start").alias("window_start"), *keys, f"{op}_{value}")
