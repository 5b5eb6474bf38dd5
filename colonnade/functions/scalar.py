"""Element-wise functions as Column expressions, all inside whole-stage codegen.

Each takes the DataFrame for its schema and column names, and returns a Column.  Types are
kept: float in, float out; integer arithmetic widens unless ``result_type='input'``, which
wraps around as machine integers do.  Nulls propagate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DTYPE_MISMATCH, UNSUPPORTED_DTYPE, UNSUPPORTED_METHOD, require
from ..types import FLOATS, INTEGERS, NUMBERS, TIMES, expect, type_of

_BITS = {"tinyint": 8, "smallint": 16, "int": 32}
_HALF = "9223372036854775808"
_FULL = "18446744073709551616"


def wrap(x: Column, kind: T.DataType) -> Column:
    """A bigint wrapped around into a narrower integer."""
    name = kind.simpleString()
    if name not in _BITS:
        return x.cast(kind)
    bits = _BITS[name]
    low, sign = F.lit((1 << bits) - 1).cast("long"), F.lit(1 << (bits - 1)).cast("long")
    return (x.cast("long").bitwiseAND(low).bitwiseXOR(sign) - sign).cast(kind)


def wrap_big(x: Column) -> Column:
    """A decimal(38,0) wrapped around into a bigint."""
    half, full = F.lit(_HALF).cast("decimal(38,0)"), F.lit(_FULL).cast("decimal(38,0)")
    return (F.pmod(x + half, full) - half).cast("long")


def ieee_divide(left: Column, right: Column) -> Column:
    inf, nan = F.lit(float("inf")), F.lit(float("nan"))
    by_zero = F.when((left == 0) | F.isnan(left), nan).when(left > 0, inf).when(left < 0, -inf)
    return F.when(right != 0, F.try_divide(left.cast("double"), right.cast("double"))).when(right.isNull(), F.lit(None)).otherwise(by_zero)


def _log(x: Column) -> Column:
    return F.when(x > 0, F.ln(x)).when(x == 0, F.lit(float("-inf"))).when(x.isNull(), F.lit(None)).otherwise(F.lit(float("nan")))


def _whole(f):
    # beyond 2^52 every double is whole, and bigint would saturate
    return lambda x: F.when(F.abs(x) < F.lit(4503599627370496.0), f(x).cast("double")).otherwise(x.cast("double"))


UNARY = {"sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan, "exp": F.exp, "log": _log, "sqrt": F.sqrt, "ceil": _whole(F.ceil), "floor": _whole(F.floor)}


def unary(df: DataFrame, op: str, name: str) -> Column:
    """One of UNARY over a float column, in that column's type."""
    require(op in UNARY, UNSUPPORTED_METHOD, op)
    kind = expect(df, name, FLOATS)
    return UNARY[op](F.col(name)).cast(kind)


def _same(df: DataFrame, left: str, right: str, kinds: tuple) -> T.DataType:
    kind = expect(df, left, kinds)
    other = expect(df, right, kinds)
    require(kind == other, DTYPE_MISMATCH, f"{left} {kind.simpleString()}, {right} {other.simpleString()}")
    return kind


def arithmetic(df: DataFrame, op: str, left: str, right: str, result_type: str = "input") -> Column:
    """add, sub, mul, floordiv, or div (floats only), of two columns of one type."""
    require(op in ("add", "sub", "mul", "floordiv", "div"), UNSUPPORTED_METHOD, op)
    kind = _same(df, left, right, FLOATS if op == "div" else NUMBERS)
    x, y = F.col(left), F.col(right)
    if op == "div":
        return ieee_divide(x, y).cast(kind)
    if op == "floordiv":
        q = _whole(F.floor)(ieee_divide(x.cast("double"), y.cast("double")))
        return q.cast(kind) if isinstance(kind, FLOATS) else F.when(y != 0, wrap(q.try_cast("long"), kind))
    if isinstance(kind, FLOATS):
        return {"add": x + y, "sub": x - y, "mul": x * y}[op].cast(kind)
    if isinstance(kind, T.LongType):
        if result_type != "input":
            return {"add": F.try_add, "sub": F.try_subtract, "mul": F.try_multiply}[op](x, y)
        a, b = x.cast("decimal(19,0)"), y.cast("decimal(19,0)")
        return wrap_big({"add": a + b, "sub": a - b, "mul": a * b}[op].cast("decimal(38,0)"))
    a, b = x.cast("long"), y.cast("long")
    wide = {"add": a + b, "sub": a - b, "mul": a * b}[op]
    return wrap(wide, kind) if result_type == "input" else wide


_COMPARE = {"gt": lambda x, y: x > y, "ge": lambda x, y: x >= y, "lt": lambda x, y: x < y, "le": lambda x, y: x <= y, "eq": lambda x, y: x == y, "ne": lambda x, y: x != y}


def compare(df: DataFrame, op: str, left: str, right: str, as_int8: bool = False, mixed: bool = False) -> Column:
    """A predicate over two columns of one type, or of any two numeric types if ``mixed``."""
    require(op in _COMPARE, UNSUPPORTED_METHOD, op)
    if mixed:
        expect(df, left, NUMBERS)
        expect(df, right, NUMBERS)
    else:
        _same(df, left, right, NUMBERS + TIMES)
    out = _COMPARE[op](F.col(left), F.col(right))
    return out.cast("tinyint") if as_int8 else out


def compare_scalar(df: DataFrame, op: str, name: str, value, as_int8: bool = False) -> Column:
    require(op in _COMPARE, UNSUPPORTED_METHOD, op)
    expect(df, name, NUMBERS + TIMES)
    out = _COMPARE[op](F.col(name), F.lit(value))
    return out.cast("tinyint") if as_int8 else out


def bitwise(df: DataFrame, op: str, left: str, right: str) -> Column:
    require(op in ("and", "or", "xor"), UNSUPPORTED_METHOD, op)
    _same(df, left, right, INTEGERS)
    x, y = F.col(left), F.col(right)
    return {"and": x.bitwiseAND, "or": x.bitwiseOR, "xor": x.bitwiseXOR}[op](y)


def validity_and(*names: str) -> Column:
    """Whether all of the columns are valid in a row."""
    out = F.col(names[0]).isNotNull()
    for n in names[1:]:
        out = out & F.col(n).isNotNull()
    return out


#: Ticks per day and the unit of a time column's ticks.
UNITS = {"s": ("SECOND", 1), "ms": ("MILLISECOND", 1_000), "us": ("MICROSECOND", 1_000_000), "ns": ("NANOSECOND", 1_000_000_000)}
_EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def cast(df: DataFrame, name: str, to: str, unit: str = "ms") -> Column:
    """A column in another type: int8 to float64, date32, date64 or timestamp.

    Integers wrap, floats are truncated toward zero (out of range: null), times become or
    come from ticks of ``unit`` (days for dates), and finer times are floored.  Spark's
    timestamps hold microseconds: nanosecond ticks are floored to these on their way in, and
    come out as a bigint whose metadata names the unit.
    """
    kind, x = type_of(df, name), F.col(name)
    quoted = f"`{name}`"
    require(isinstance(kind, NUMBERS + TIMES), UNSUPPORTED_DTYPE, kind.simpleString())
    require(unit in UNITS, UNSUPPORTED_METHOD, unit)
    if to in ("date32", "date64", "timestamp"):
        if isinstance(kind, T.DateType):
            return x if to == "date32" else x.cast("timestamp_ntz")
        if isinstance(kind, TIMES):
            if to == "date32":
                return x.cast("date")
            return F.date_trunc("MILLISECOND" if to == "date64" else UNITS["us" if unit == "ns" else unit][0], x).cast("timestamp_ntz")
        whole = F.expr(f"try_cast({quoted} as bigint)")
        if to == "date32":
            return F.date_from_unix_date(wrap(whole, T.IntegerType()))
        if to == "timestamp" and unit == "ns":
            ticks = f"try_cast({quoted} as bigint)"
            return F.expr(f"timestampadd(MICROSECOND, ({ticks} - pmod({ticks}, 1000L)) div 1000L, {_EPOCH})")
        step = "MILLISECOND" if to == "date64" else UNITS[unit][0]
        return F.expr(f"timestampadd({step}, try_cast({quoted} as bigint), {_EPOCH})")
    target = {"int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int64": T.LongType(), "float32": T.FloatType(), "float64": T.DoubleType()}.get(to)
    require(target is not None, UNSUPPORTED_DTYPE, to)
    if isinstance(kind, T.DateType):
        number = F.unix_date(x).cast("long")
    elif isinstance(kind, TIMES):
        micros = F.expr(f"timestampdiff(MICROSECOND, {_EPOCH}, {quoted})")
        if unit == "ns":
            ticks = wrap(micros * 1000, target) if isinstance(target, INTEGERS) else (micros * 1000).cast(target)
            return ticks.alias(name, metadata={"unit": "ns"})
        scale = 1_000_000 // UNITS[unit][1]
        number = F.expr(f"(timestampdiff(MICROSECOND, {_EPOCH}, {quoted}) - pmod(timestampdiff(MICROSECOND, {_EPOCH}, {quoted}), {scale}L)) div {scale}L") if scale > 1 else micros
    elif isinstance(target, FLOATS):
        return x.cast(target)
    else:
        number = F.expr(f"try_cast({quoted} as bigint)")
    return wrap(number, target) if isinstance(target, INTEGERS) else number.cast(target)


_PARTS = {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second}


def extract(df: DataFrame, part: str, name: str) -> Column:
    """year, month, day, hour, minute or second as smallint; the last three need a time."""
    require(part in _PARTS, UNSUPPORTED_METHOD, part)
    expect(df, name, TIMES if part in ("year", "month", "day") else TIMES[1:])
    return _PARTS[part](F.col(name)).cast("smallint")
