"""Column types: names, widths and the checks that operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .errors import UNKNOWN_COLUMN, UNSUPPORTED_DTYPE, EngineError, require

#: Type names and their Spark types.
NAMES = {
    "int8": T.ByteType(),
    "int16": T.ShortType(),
    "int32": T.IntegerType(),
    "int64": T.LongType(),
    "float32": T.FloatType(),
    "float64": T.DoubleType(),
    "date32": T.DateType(),
    "date64": T.TimestampNTZType(),
    "timestamp": T.TimestampNTZType(),
    "category": T.StringType(),
    "string": T.StringType(),
}
WIDTHS = {T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.LongType: 8, T.FloatType: 4, T.DoubleType: 8, T.DateType: 4, T.TimestampNTZType: 8, T.TimestampType: 8, T.BooleanType: 1}
INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATS = (T.FloatType, T.DoubleType)
NUMBERS = INTEGERS + FLOATS
TIMES = (T.DateType, T.TimestampNTZType, T.TimestampType)


def type_of(df: DataFrame, name: str) -> T.DataType:
    require(name in df.columns, UNKNOWN_COLUMN, name)
    return df.schema[name].dataType


def byte_width(df: DataFrame, name: str) -> int:
    """Bytes of a value of a fixed-width column."""
    kind = type_of(df, name)
    for k, width in WIDTHS.items():
        if isinstance(kind, k):
            return width
    raise EngineError(UNSUPPORTED_DTYPE, f"{name} has no fixed width")


def expect(df: DataFrame, name: str, kinds: tuple) -> T.DataType:
    kind = type_of(df, name)
    require(isinstance(kind, kinds), UNSUPPORTED_DTYPE, f"{name}: {kind.simpleString()}")
    return kind
