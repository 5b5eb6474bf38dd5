"""Filters, joins, grouped and whole-column aggregates, and concatenation."""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import COLUMN_SIZE_MISMATCH, DTYPE_MISMATCH, INVALID_API_CALL, JOIN_DTYPE_MISMATCH, UNSUPPORTED_JOIN_TYPE, UNSUPPORTED_METHOD, require
from ..functions.scalar import wrap, wrap_big
from ..types import FLOATS, INTEGERS, NUMBERS, TIMES, byte_width, expect, type_of

# ---- filters


def apply_stencil(df: DataFrame, mask: Column | str) -> DataFrame:
    """Rows whose mask is set and valid; an integer mask counts as set if not 0."""
    if isinstance(mask, str):
        kind = type_of(df, mask)
        return df.filter(F.col(mask) if isinstance(kind, T.BooleanType) else F.col(mask) != 0)
    return df.filter(mask)


def equality_filter(df: DataFrame, values: dict) -> DataFrame:
    """Rows in which every named column equals its constant."""
    require(bool(values), INVALID_API_CALL, "no columns")
    return df.filter(reduce(and_, [F.col(c) == F.lit(v) for c, v in values.items()]))


# ---- joins

_HINTS = {"hash": "shuffle_hash", "sort": "merge", "broadcast": "broadcast", "auto": None}
#: Most bytes of rows, as Spark holds them, that method='broadcast' will ship to every executor.
BROADCAST_BYTES = 32 << 20
#: Largest plan estimate of a side that is measured for a broadcast; a larger one is shuffled at once.
MEASURED_BYTES = 512 << 20


def _estimate(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _fits(df: DataFrame) -> bool:
    """Whether all rows are within BROADCAST_BYTES; never so if a column is nested.

    Plan estimates are of compressed files, so rows are counted and lengths of texts summed:
    one job, which reads text columns only.
    """
    if _estimate(df) > MEASURED_BYTES:
        return False
    flat, extra = df.toDF(*[f"_{i}" for i in range(len(df.columns))]), F.lit(0)
    for f in flat.schema:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            extra = extra + F.coalesce(F.octet_length(f.name), F.lit(0)) + 7
        elif isinstance(f.dataType, T.DecimalType):
            extra = extra + 16
        elif not isinstance(f.dataType, (*NUMBERS, *TIMES, T.BooleanType)):
            return False
    n, more = flat.agg(F.count(F.lit(1)), F.coalesce(F.sum(extra.cast("long")), F.lit(0))).first()
    return n * 8 * (len(df.columns) + -(-len(df.columns) // 64)) + more <= BROADCAST_BYTES


def join(left: DataFrame, right: DataFrame, on: list[tuple[str, str]] | list[str], how: str = "inner", method: str = "auto", output: str = "table", left_id: str | None = None, right_id: str | None = None) -> DataFrame:
    """Equi-join on pairs of columns: inner, left, full (and Spark's right, semi, anti).

    Columns come out as [left others, keys, right others], one copy of each key, named as on
    the left; nulls never match.  ``output='indices'`` gives (left_id, right_id) with -1 for
    no match.  'broadcast' measures the right side first and falls back to a sort-merge join
    if its rows are above BROADCAST_BYTES.
    """
    require(how in ("inner", "left", "full", "right", "left_semi", "left_anti"), UNSUPPORTED_JOIN_TYPE, how)
    require(method in _HINTS, UNSUPPORTED_METHOD, method)
    pairs = [(k, k) if isinstance(k, str) else k for k in on]
    require(bool(pairs), INVALID_API_CALL, "no keys")
    for a, b in pairs:
        x, y = type_of(left, a), type_of(right, b)
        require(x == y, JOIN_DTYPE_MISMATCH, f"{a} {x.simpleString()}, {b} {y.simpleString()}")
    if method == "broadcast" and (how in ("full", "right") or right.isStreaming):
        method = "auto"  # the right side can't be broadcast
    elif method == "broadcast" and not _fits(right):
        method = "sort"
    right_keys = {b: f"_right_{i}" for i, (_, b) in enumerate(pairs)}
    r = right.withColumnsRenamed(right_keys)
    if _HINTS[method]:
        r = r.hint(_HINTS[method])
    keys = [a for a, _ in pairs]
    own = [c for c in left.columns if c not in keys]
    l_, r_ = left.alias("_l"), r.alias("_r")
    condition = reduce(and_, [F.col(f"_l.{a}") == F.col(f"_r.{right_keys[b]}") for a, b in pairs])
    both = l_.join(r_, condition, how)
    if how in ("left_semi", "left_anti"):
        return both.select(*[F.col(f"_l.{c}") for c in own], *[F.col(f"_l.{k}") for k in keys])
    if output == "indices":
        require(bool(left_id and right_id), INVALID_API_CALL, "indices need an id column on each side")
        rid = right_keys.get(right_id, right_id)
        return both.select(F.coalesce(F.col(f"_l.{left_id}"), F.lit(-1)).alias("left_id"), F.coalesce(F.col(f"_r.{rid}"), F.lit(-1)).alias("right_id"))
    theirs = [c for c in right.columns if c not in right_keys]
    merged = [F.coalesce(F.col(f"_l.{a}"), F.col(f"_r.{right_keys[b]}")).alias(a) for a, b in pairs]
    return both.select(*[F.col(f"_l.{c}") for c in own], *merged, *[F.col(f"_r.{c}") for c in theirs])


# ---- whole-column reductions

_LIMITS = {"tinyint": (-(1 << 7), (1 << 7) - 1), "smallint": (-(1 << 15), (1 << 15) - 1), "int": (-(1 << 31), (1 << 31) - 1), "bigint": (-(1 << 63), (1 << 63) - 1), "float": (-3.4028234663852886e38, 3.4028234663852886e38), "double": (-1.7976931348623157e308, 1.7976931348623157e308)}


def reduction(df: DataFrame, op: str, name: str, result_type: str = "wide", identity: bool = True) -> Column:
    """sum, product, sum_squared, min or max as an aggregate expression.

    With ``identity`` an empty or all-null column gives 0, 1, 0, the type's greatest or its
    least value; else null.  ``result_type='input'`` keeps an integer sum or product in the
    column's type, wrapped around; both stay partial aggregates.
    """
    require(op in ("sum", "product", "sum_squared", "min", "max", "count"), UNSUPPORTED_METHOD, op)
    kind = expect(df, name, FLOATS if op == "sum_squared" else NUMBERS)
    x = F.col(name)
    if op == "count":
        return F.count(x)
    if op in ("min", "max"):
        least, most = _LIMITS[kind.simpleString()]
        out = F.min(x) if op == "min" else F.max(x)
        return F.coalesce(out, F.lit(most if op == "min" else least).cast(kind)) if identity else out
    if op == "sum_squared":
        out = F.sum(x.cast("double") * x.cast("double"))
        return F.coalesce(out, F.lit(0.0)) if identity else out
    if op == "product":
        out = F.product(x.cast("double"))
        return F.coalesce(out, F.lit(1.0)) if identity else out
    if isinstance(kind, INTEGERS) and result_type == "input":
        out = F.sum(x.cast("decimal(19,0)")).cast("decimal(38,0)")
        out = wrap_big(out) if isinstance(kind, T.LongType) else wrap(wrap_big(out), kind)
        return F.coalesce(out, F.lit(0).cast(kind)) if identity else out
    else:
        out = F.sum(x)
    return F.coalesce(out, F.lit(0).cast("double" if isinstance(kind, FLOATS) else "long")) if identity else out


def integer_product(df: DataFrame, name: str, out: str = "product") -> DataFrame:
    """One row: the exact product of an integer column, wrapping around in its type.

    Each partition is multiplied by itself, then the partial products, one per partition.
    Nulls are skipped; without values the product is 1.
    """
    kind = expect(df, name, INTEGERS)

    def partial(batches):
        total = np.ones(1, np.int64)
        for batch in batches:
            total *= np.multiply.reduce(batch.column(0).drop_null().to_numpy(zero_copy_only=False), dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(total)], names=["p"])

    parts = df.select(F.col(name).cast("long").alias("p")).mapInArrow(partial, "p long")
    whole = parts.repartition(1).mapInArrow(partial, "p long").agg(F.coalesce(F.max("p"), F.lit(1).cast("long")).alias("p"))
    size = 8 * byte_width(df, name)
    low = F.col("p") if size == 64 else F.pmod(F.col("p"), F.lit(1 << size))
    return whole.select((low if size == 64 else F.when(low >= 1 << (size - 1), low - (1 << size)).otherwise(low)).cast(kind).alias(out))


# ---- group-by

AGGREGATES = ("sum", "min", "max", "avg", "count", "count_distinct", "approx_percentile")


def group_by(df: DataFrame, keys: list[str], op: str, value: str | None = None, method: str = "hash", sort_result: bool = False, result_type: str = "wide", representative: str | None = None, out: str | None = None, q: float = 0.5) -> DataFrame:
    """One aggregate per key tuple; ``q`` is the share of approx_percentile.

    ``method='sort'`` or ``sort_result`` orders by key; ``representative`` adds the least
    value of an id column per group; ``result_type='input'`` keeps an integer sum or average
    in the column's type (the average truncated).  Sums and averages of dates and times are
    of their days or microseconds since 1970.  Null keys form a group.
    """
    require(op in AGGREGATES, UNSUPPORTED_METHOD, op)
    require(method in ("hash", "sort"), UNSUPPORTED_METHOD, method)
    require(bool(keys), INVALID_API_CALL, "no keys")
    name = out or f"{op}_{value}" if value else out or op
    if op == "count":
        agg = F.count(F.lit(1))
    else:
        kind = expect(df, value, (*NUMBERS, *TIMES, T.StringType) if op == "count_distinct" else NUMBERS + (() if op == "approx_percentile" else TIMES))
        x = F.col(value)
        if op in ("sum", "avg") and isinstance(kind, TIMES):
            x = F.unix_date(x) if isinstance(kind, T.DateType) else F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast(kind), x)
        agg = {"sum": F.sum, "min": F.min, "max": F.max, "avg": F.avg, "count_distinct": F.count_distinct, "approx_percentile": lambda c: F.percentile_approx(c, q, 10_000)}[op](x)
        if op == "sum" and result_type == "input" and not isinstance(kind, TIMES):
            agg = reduction(df, "sum", value, "input", identity=False)
        if op == "avg" and isinstance(kind, INTEGERS) and result_type == "input":
            total = F.sum(F.col(value).cast("decimal(19,0)"))
            agg = F.call_function("div", total, F.count(value).cast("decimal(19,0)")).cast(kind)  # exact, toward zero
    extra = [F.min(representative).alias("representative")] if representative else []
    grouped = df.groupBy(*keys).agg(agg.alias(name), *extra)
    return grouped.orderBy(*keys) if method == "sort" or sort_result else grouped


def count_distinct_keys(df: DataFrame, keys: list[str], out: str = "n") -> DataFrame:
    """One row: the number of distinct key tuples of the table."""
    return df.select(*keys).distinct().agg(F.count(F.lit(1)).alias(out))


# ---- concatenation


def concat(frames: list[DataFrame], source: str | None = None, size: int | None = None) -> DataFrame:
    """Frames of one schema below one another; ``source`` adds each row's frame number."""
    require(bool(frames), INVALID_API_CALL, "nothing to concatenate")
    first = [f.dataType for f in frames[0].schema]
    for f in frames[1:]:
        require([x.dataType for x in f.schema] == first, DTYPE_MISMATCH, "columns differ in type")
    require(size is None or size == len(frames), COLUMN_SIZE_MISMATCH, f"{len(frames)} frames, {size} expected")
    numbered = [f.withColumn(source, F.lit(i)) if source else f for i, f in enumerate(frames)]
    return reduce(DataFrame.union, numbered)
