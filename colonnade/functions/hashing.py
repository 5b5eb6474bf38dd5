"""Row hashes and hash partitions.

``row_hash`` is the 32-bit Murmur3 of each column at seed 0, folded column by column with
a golden-ratio combine.  Spark's own ``hash`` starts at seed 42 and chains seeds, and its
hash of the constant SEED_ZERO is 0, so ``hash(SEED_ZERO, x)`` is Murmur3 of x at seed 0.
Bytes and shorts take the algorithm's 1- and 2-byte tail.  Nulls are skipped: a null column
leaves the fold as it is.  ``fnv_hash`` is the 64-bit FNV-1a of a row's bytes, in 32-bit
halves, as no product may leave the range of a bigint under ANSI.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import UNSUPPORTED_METHOD, require
from ..types import NUMBERS, TIMES, byte_width, expect

SEED_ZERO = -1693959553
_U32 = 0xFFFFFFFF
# The multipliers of 32-bit Murmur3; offset basis and prime of 64-bit FNV.
MURMUR = (0xCC9E2D51, 0x1B873593, 0x85EBCA6B, 0xC2B2AE35)
FNV_BASIS, FNV_PRIME = 14695981039346656037, 1099511628211


def _low(x: Column) -> Column:
    return x.bitwiseAND(F.lit(_U32).cast("long"))


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), with x evaluated once however often f uses it."""
    return F.element_at(F.transform(F.array(x), lambda v: f(v)), 1)


def _times(x: Column, c: int) -> Column:
    """Low 32 bits of the product of two unsigned 32-bit numbers."""
    high = F.shiftleft((F.shiftright(x, 16) * F.lit(c)).bitwiseAND(F.lit(0xFFFF).cast("long")), 16)
    return _low(high + x.bitwiseAND(F.lit(0xFFFF).cast("long")) * F.lit(c))


def _murmur_tail(x: Column, width: int) -> Column:
    """Murmur3 at seed 0 of a value of 1 or 2 bytes, given as unsigned bigint."""
    mixed = _let(_low(x * F.lit(MURMUR[0])), lambda v: _low(F.shiftleft(v, 15)).bitwiseOR(F.shiftright(v, 17)))
    h = _low(mixed * F.lit(MURMUR[1])).bitwiseXOR(F.lit(width).cast("long"))
    for shift, factor in ((16, MURMUR[2]), (13, MURMUR[3]), (16, None)):
        h = _let(h, lambda v, shift=shift: v.bitwiseXOR(F.shiftright(v, shift)))
        h = _let(h, lambda v, factor=factor: _times(v, factor)) if factor else h
    return h


def murmur(df: DataFrame, name: str) -> Column:
    """Unsigned 32-bit Murmur3 at seed 0 of a column, as bigint."""
    kind = expect(df, name, (*NUMBERS, *TIMES, T.StringType))
    x = F.col(name)
    if isinstance(kind, (T.ByteType, T.ShortType)):
        width = 1 if isinstance(kind, T.ByteType) else 2
        return _murmur_tail(x.cast("long").bitwiseAND(F.lit((1 << 8 * width) - 1).cast("long")), width)
    return _low(F.hash(F.lit(SEED_ZERO), x).cast("long"))


def identity(df: DataFrame, name: str) -> Column:
    """The value's low 32 bits; 0 for a number that no bigint holds (NaN, infinities, 1e300)."""
    expect(df, name, NUMBERS)
    return _low(F.when(F.col(name).isNotNull(), F.coalesce(F.col(name).try_cast("long"), F.lit(0))))


def row_hash(df: DataFrame, names: list[str], method: str = "murmur3", out: str = "hash") -> DataFrame:
    """``df`` with the row hash as an int column ``out``."""
    require(method in ("murmur3", "identity"), UNSUPPORTED_METHOD, method)
    one = murmur if method == "murmur3" else identity
    df = df.withColumn("_h", F.lit(None).cast("long"))
    for n in names:
        g = one(df, n)
        h = F.col("_h")
        folded = h.bitwiseXOR(_low(g + F.lit(2654435769) + _low(F.shiftleft(h, 6)) + F.shiftright(h, 2)))
        df = df.withColumn("_h", F.when(F.col(n).isNull(), h).when(h.isNull(), g).otherwise(folded))
    signed = F.col("_h").bitwiseXOR(F.lit(0x80000000).cast("long")) - F.lit(0x80000000).cast("long")
    return df.withColumn(out, F.coalesce(signed, F.lit(0)).cast("int")).drop("_h")


@F.pandas_udf(T.LongType())
def _bits64(x: pd.Series) -> pd.Series:
    return pd.Series(x.to_numpy("float64").view("int64"))


@F.pandas_udf(T.IntegerType())
def _bits32(x: pd.Series) -> pd.Series:
    return pd.Series(x.to_numpy("float32").view("int32"))


def _raw(df: DataFrame, name: str) -> Column:
    """A fixed-width value's bits as bigint: days of a date, microseconds of a timestamp."""
    kind, x = expect(df, name, (*NUMBERS, *TIMES)), F.col(name)
    if isinstance(kind, T.FloatType):
        x = _bits32(x)
    elif isinstance(kind, T.DoubleType):
        x = _bits64(x)
    elif isinstance(kind, T.DateType):
        x = F.unix_date(x)
    elif isinstance(kind, T.TimestampType):
        x = F.unix_micros(x)
    elif isinstance(kind, T.TimestampNTZType):
        x = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), x)
    return x.cast("long")


def fnv_hash(df: DataFrame, names: list[str], out: str = "hash") -> Column:
    """64-bit FNV-1a over the bytes of fixed-width columns, least byte first, as bigint.

    Bytes are sign-extended before they are folded in; null if any column is null.
    """
    basis, rest = FNV_BASIS, FNV_PRIME - (1 << 40)  # the rest of the prime is 435
    data, missing = [], F.lit(False)
    for n in names:
        bits = _raw(df, n)
        data += [F.shiftright(bits, 8 * k).bitwiseAND(F.lit(255).cast("long")) for k in range(byte_width(df, n))]
        missing = missing | F.col(n).isNull()
    start = F.struct(F.lit(basis >> 32).cast("long").alias("hi"), F.lit(basis & _U32).cast("long").alias("lo"))
    ones = F.lit(_U32).cast("long")

    def fold(state: Column, byte: Column) -> Column:
        negative = byte > 127
        lo = state["lo"].bitwiseXOR(F.when(negative, byte + F.lit(_U32 - 255)).otherwise(byte))
        hi = F.when(negative, state["hi"].bitwiseXOR(ones)).otherwise(state["hi"])
        low = lo * F.lit(rest)
        return F.struct(_low(hi * F.lit(rest) + F.shiftright(low, 32) + F.shiftleft(lo, 8)).alias("hi"), _low(low).alias("lo"))

    whole = F.aggregate(F.array(*data), start, fold, lambda s: F.shiftleft(s["hi"], 32).bitwiseOR(s["lo"]))
    return F.when(~missing, whole).alias(out)


def column_hash(names: list[str], out: str = "hash") -> Column:
    """A 64-bit hash of a row, null if any column is."""
    missing = F.lit(False)
    for n in names:
        missing = missing | F.col(n).isNull()
    return F.when(~missing, F.xxhash64(*names)).alias(out)


def partition_id(df: DataFrame, names: list[str], parts: int, method: str = "murmur3", out: str = "part") -> DataFrame:
    hashed = row_hash(df, names, method, "_row_hash")
    return hashed.withColumn(out, F.pmod(_low(F.col("_row_hash").cast("long")), F.lit(parts)).cast("int")).drop("_row_hash")


def hash_partition(df: DataFrame, names: list[str], parts: int, method: str = "murmur3") -> DataFrame:
    """``df`` dealt so that a row of hash h lies in Spark partition h mod ``parts``."""
    return partition_id(df, names, parts, method).repartitionById(parts, F.col("part"))


def partition_offsets(df: DataFrame, names: list[str], parts: int, method: str = "murmur3") -> DataFrame:
    """(part, rows, start) of every partition, empty ones included."""
    counts = partition_id(df, names, parts, method).groupBy("part").agg(F.count(F.lit(1)).alias("rows"))
    every = df.sparkSession.range(parts).select(F.col("id").cast("int").alias("part"))
    full = every.join(counts, "part", "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    return full.withColumn("start", F.coalesce(F.sum("rows").over(before), F.lit(0)))
