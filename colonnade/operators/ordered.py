"""Operators that depend on order: running sums, windows, sorts and order statistics.

Order always comes from named columns; Spark rows have no position of their own.  Global
running operators split the key's range at approximate quantiles, work inside each range,
and add each range's offset, so no task ever holds the whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import INVALID_API_CALL, UNSUPPORTED_METHOD, require
from ..functions.scalar import wrap, wrap_big
from ..types import INTEGERS, NUMBERS, TIMES, expect, type_of

MOST_RANGES = 2048


def _bucket(x: Column, cuts: list[float], low: int = 0) -> Column:
    """The number of cuts at or below x, as a balanced tree of comparisons."""
    if not cuts:
        return F.lit(low)
    mid = len(cuts) // 2
    return F.when(x < cuts[mid], _bucket(x, cuts[:mid], low)).otherwise(_bucket(x, cuts[mid + 1 :], low + mid + 1))


def _as_number(df: DataFrame, key: str) -> Column:
    kind = type_of(df, key)
    x = F.unix_date(key) if isinstance(kind, T.DateType) else F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', `{key}`)") if isinstance(kind, TIMES) else F.col(key)
    return x.cast("double")


def _cuts(df: DataFrame, key: str, parts: int) -> list[float]:
    """Distinct quantiles of a number or time; none for other types."""
    if not isinstance(type_of(df, key), NUMBERS + TIMES):
        return []
    x = df.select(_as_number(df, key).alias("x")).where("x is not null and not isnan(x)")
    return sorted(set(x.approxQuantile("x", [i / parts for i in range(1, parts)], 0.25 / parts)))


def ranged(df: DataFrame, order: list[str], parts: int | None = None) -> DataFrame:
    """``df`` with an int ``_range`` that never decreases in ``order`` and splits the rows about evenly.

    A first key that is a number or a time and has few ties is cut at sketched quantiles;
    for any other Spark's range partitioner takes all of ``order``.
    """
    parts = min(MOST_RANGES, parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    if parts < 2:
        return df.withColumn("_range", F.lit(0))
    cuts = _cuts(df, order[0], parts)
    if 4 * len(cuts) < 3 * (parts - 1):
        return df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id())
    x = _as_number(df, order[0])
    return df.withColumn("_range", F.when(x.isNull(), F.lit(0)).otherwise(_bucket(x, cuts)))


def prefix_sum(df: DataFrame, value: str, order: list[str], inclusive: bool = True, out: str = "prefix", result_type: str = "wide", parts: int | None = None) -> DataFrame:
    """Running sum of ``value`` by ``order`` (add a tie-breaker); null counts as 0."""
    kind = expect(df, value, NUMBERS)
    require(bool(order), INVALID_API_CALL, "no order")
    whole = isinstance(kind, INTEGERS)
    x = F.coalesce(F.col(value), F.lit(0)).cast("decimal(28,0)" if whole else "double")
    split = ranged(df, order, parts).withColumn("_x", x)
    sums = split.groupBy("_range").agg(F.sum("_x").alias("_sum"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    offsets = sums.select("_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    got = split.join(F.broadcast(offsets), "_range")  # at most MOST_RANGES rows
    total = F.coalesce(F.sum("_x").over(inside), F.lit(0)) + F.col("_offset")
    if whole:
        total = wrap_big(total.cast("decimal(38,0)"))
        total = wrap(total, kind) if result_type == "input" else total
    return got.withColumn(out, total).drop("_range", "_x", "_offset")


_WINDOW = {"avg": F.avg, "sum": F.sum, "max": F.max, "min": F.min, "count": F.count, "stddev": F.stddev, "var": F.variance}


def window_aggregate(df: DataFrame, op: str, value: str, partition: list[str], order: list[str], frame: str = "rows", start: int | None = None, end: int | None = 0, descending: bool = False, out: str | None = None) -> DataFrame:
    """avg, sum, max, min, count, stddev or var over a ROWS or RANGE frame; None is unbounded."""
    require(op in _WINDOW, UNSUPPORTED_METHOD, op)
    require(frame in ("rows", "range"), UNSUPPORTED_METHOD, frame)
    require(bool(partition), INVALID_API_CALL, "a window over the whole table would be one task; use prefix_sum")
    by = [F.desc(c) if descending else F.asc(c) for c in order]
    w = Window.partitionBy(*partition).orderBy(*by)
    low, high = Window.unboundedPreceding if start is None else start, Window.unboundedFollowing if end is None else end
    w = w.rowsBetween(low, high) if frame == "rows" else w.rangeBetween(low, high)
    return df.withColumn(out or f"{op}_{value}", _WINDOW[op](value).over(w))


def order_by(df: DataFrame, columns: list[str], permutation: str | None = None) -> DataFrame:
    """Ascending by all columns; with ``permutation`` only that id column, in the new order."""
    out = df.orderBy(*columns)
    return out.select(permutation) if permutation else out


#: About the most rows of a range that ``sorted_ranges`` sorts at once.
RANGE_ROWS = 250_000


def sorted_ranges(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows sorted inside and across partitions of at most about RANGE_ROWS rows, however many there are."""
    return df.repartitionByRange(max(1, -(-df.count() // RANGE_ROWS)), *columns).sortWithinPartitions(*columns)


def radix_sort(df: DataFrame, key: str, payload: str, descending: bool = False, bits: tuple[int, int] | None = None) -> DataFrame:
    """By key, ties by payload ascending (the stable order); ``bits`` sorts by a bit range."""
    k = F.col(key)
    if bits:
        expect(df, key, INTEGERS)
        begin, end = bits
        k = F.shiftright(k.cast("long"), begin).bitwiseAND(F.lit((1 << min(63, end - begin)) - 1).cast("long"))
    else:
        expect(df, key, NUMBERS)
    return df.orderBy(k.desc() if descending else k.asc(), F.asc(payload))


def segmented_sort(df: DataFrame, key: str, position: str, segments: list[tuple[int, int]], descending: bool = False, out: str = "new_position") -> DataFrame:
    """Sorts each segment [begin, end) of positions by itself; other rows stay in place.

    Adds the position a row moves to; segments are disjoint.
    """
    expect(df, key, NUMBERS)
    # a segment is listed once for every stretch of positions it touches, so rows meet it by equality
    span = max(1, sum(b - a for a, b in segments) // max(1, len(segments)))
    listed = [(i, int(a), int(b), t) for i, (a, b) in enumerate(segments) for t in range(a // span, (b - 1) // span + 1) if b > a]
    segs = df.sparkSession.createDataFrame(listed, "_seg int, _begin long, _end long, _at long")
    inside = (F.floor(F.col(position) / span) == F.col("_at")) & (F.col(position) >= F.col("_begin")) & (F.col(position) < F.col("_end"))
    tagged = df.join(segs, inside, "left")
    k = F.desc(key) if descending else F.asc(key)
    seated = Window.partitionBy("_seg").orderBy(k, F.asc(position))
    moved = tagged.where("_seg is not null").withColumn(out, F.col("_begin") + F.row_number().over(seated) - 1)
    still = tagged.where("_seg is null").withColumn(out, F.col(position).cast("long"))
    return moved.union(still).drop("_seg", "_begin", "_end", "_at")


METHODS = ("linear", "lower", "higher", "midpoint", "nearest")


#: Rows of the bracket around the wanted ranks that are sorted in one place.
MOST_SORTED = 1_000_000


def quantile(df: DataFrame, name: str, q: float, method: str = "linear", convention: str = "reference", out: str = "quantile") -> DataFrame:
    """The exact quantile as one row of type double; see ``quantile_values``."""
    require(method in METHODS, UNSUPPORTED_METHOD, method)
    got = quantile_values(df, name, q, convention)
    if got is None:
        return df.sparkSession.createDataFrame([(None,)], f"{out} double")
    y0, y1, share = float(got[0]), float(got[1]), got[2]
    value = {"linear": y0 + share * (y1 - y0) if share else y0, "lower": y0, "higher": y1, "midpoint": (y0 + y1) / 2, "nearest": y0 if share < 0.5 else y1}[method]
    return df.sparkSession.createDataFrame([(value,)], f"{out} double")


def quantile_values(df: DataFrame, name: str, q: float, convention: str = "reference") -> tuple | None:
    """(value, next value, share of the way) around position q*n with k = max(floor(q*n) - 1, 0).

    ``convention='standard'`` takes position q*(n-1) instead.  Values keep the column's type;
    None if there is none.  A sketch brackets the wanted ranks, one pass counts the rows
    below and inside, and a bracket of over MOST_SORTED rows is bracketed again; equal values
    are folded with their number before the rest is sorted.
    """
    require(convention in ("reference", "standard"), UNSUPPORTED_METHOD, convention)
    require(0 <= q <= 1, INVALID_API_CALL, f"q {q}")
    expect(df, name, NUMBERS)
    x = df.select(F.col(name).alias("x")).where("x is not null")
    error = 0.001
    low, high = _bracket(x, q, q, error)
    n, below, inside = _counted(x, low, high)
    if not n:
        return None
    place = q * n if convention == "reference" else q * (n - 1)
    k = int(place)
    share = place - k
    i = max(k - 1, 0) if convention == "reference" else k
    if q >= 1:
        i, share = n - 1, 0.0
    if n < 2:
        i, share = 0, 0.0
    last = min(n - 1, i + 1)
    part, before, rows = x, 0, n
    while True:
        if below <= i - before and last - before < below + inside:
            part, before, narrower = part.where(_within(low, high)), before + below, inside < rows
            rows = inside
        else:
            narrower = False  # the sketch missed: sort what there is
        if rows <= MOST_SORTED or not narrower:
            break
        low, high = _bracket(part, (i - before) / rows, (last - before) / rows, error)
        _, below, inside = _counted(part, low, high)
    folded = part.groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    upto = folded.withColumn("upto", F.sum("n").over(Window.orderBy("x").rowsBetween(Window.unboundedPreceding, 0)))
    got = upto.where((F.col("upto") > i - before) & (F.col("upto") - F.col("n") <= last - before)).orderBy("x").collect()  # two rows at most
    values = [r["x"] for r in got]
    return values[0], values[-1] if q < 1 else values[0], share


def _bracket(x: DataFrame, start: float, stop: float, error: float) -> tuple[float, float]:
    """Values (as double) below and above the ranks from ``start`` to ``stop``."""
    got = x.approxQuantile("x", [max(0.0, start - 2 * error), min(1.0, stop + 2 * error)], error)
    return (got[0], got[1]) if got else (0.0, 0.0)


def _within(low: float, high: float) -> Column:
    return (F.col("x").cast("double") >= low) & (F.col("x").cast("double") <= high)


def _counted(x: DataFrame, low: float, high: float) -> tuple[int, int, int]:
    return tuple(x.agg(F.count("x"), F.count_if(F.col("x").cast("double") < low), F.count_if(_within(low, high))).first())


def order_statistic(df: DataFrame, name: str, q: float, out: str = "quantile") -> DataFrame:
    """The value at the lower rank, in the column's own type."""
    kind = expect(df, name, NUMBERS)
    got = quantile_values(df, name, q)
    return df.sparkSession.createDataFrame([(None if got is None else got[0],)], T.StructType([T.StructField(out, kind)]))
