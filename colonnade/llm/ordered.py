"""Reading a table in the order of a key, together with each row's successor.

A window over the whole table would put every row in one task.  Instead the key's range
is cut at approximate quantiles, each range is sorted by itself, and the first row of the
next range that holds any is sent along as a guest, so that a stream over the range sees
the successor of its last row.  Only one number per range reaches the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_successors(df: DataFrame, key: str, tie: list[str], parts: int) -> DataFrame:
    """``df`` dealt into ranges of ``key`` (long, null first) and sorted by key and ``tie``.

    Columns ``_range`` (int) and ``_role`` are added: 0 a row of the range, 1 a guest, that
    sorts behind all rows of the range: the first row of the next range, or for the last
    range of the first one.
    """
    ids = df.select(F.col(key).cast("double").alias("k")).where("k is not null")
    cuts = np.unique(ids.approxQuantile("k", [i / parts for i in range(1, parts)], 0.2 / parts)) if parts > 1 else np.zeros(0)

    @F.pandas_udf("int")
    def place(k: pd.Series) -> pd.Series:
        return pd.Series(np.where(k.isna(), 0, np.searchsorted(cuts, k.astype("float64"), "right")).astype("int32"))

    ranged = df.withColumn("_range", place(F.col(key).cast("double")))
    firsts = ranged.select("_range", F.col(key).alias("k")).groupBy("_range").agg(F.min(F.struct(F.col("k").isNotNull().alias("filled"), "k")).alias("first")).orderBy("_range").collect()
    before = [r["_range"] for r in firsts]
    visits = [(r["first"]["k"], at) for at, r in zip([*before[-1:], *before[:-1]], firsts, strict=True)]
    guests = F.broadcast(df.sparkSession.createDataFrame(visits, "_first long, _to int"))  # a row per range
    out = ranged.join(guests, F.col(key).eqNullSafe(F.col("_first")), "left")
    roles = F.array(F.struct(F.col("_range").alias("at"), F.lit(0).alias("role")), F.struct(F.col("_to").alias("at"), F.lit(1).alias("role")))
    out = out.withColumn("_visit", F.explode(F.filter(roles, lambda v: v["at"].isNotNull())))
    out = out.withColumn("_range", F.col("_visit.at")).withColumn("_role", F.col("_visit.role")).drop("_visit", "_first", "_to")
    return out.repartitionById(parts, F.col("_range")).sortWithinPartitions("_range", "_role", F.col(key).asc_nulls_first(), *tie)
