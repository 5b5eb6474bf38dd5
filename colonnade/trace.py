"""Named ranges: Spark jobs started inside carry the name in the UI and in event logs."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

_KEY = "spark.job.description"


@contextmanager
def traced(spark: SparkSession, name: str) -> Iterator[None]:
    """Jobs of this thread are described by ``name``; inner ranges are joined by ' / '."""
    sc = spark.sparkContext
    outer = sc.getLocalProperty(_KEY)
    sc.setLocalProperty(_KEY, f"{outer} / {name}" if outer else name)
    try:
        yield
    finally:
        sc.setLocalProperty(_KEY, outer)
