"""CSV, Arrow and sparse-matrix exchange."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import INVALID_API_CALL, UNSUPPORTED_DTYPE, require
from ..types import NUMBERS, expect

#: CSV type names.
CSV_TYPES = {"str": "string", "category": "string", "date": "date64", "date64": "date64", "date32": "date32", "timestamp": "ticks", "float": "float", "float32": "float", "float64": "double", "double": "double", "short": "smallint", "int": "int", "int32": "int", "int64": "bigint", "long": "bigint"}


def _date(text: Column, dayfirst: bool) -> Column:
    day = F.replace(F.regexp_extract(text, r"^([0-9]+[-/][0-9]+(?:[-/][0-9]+)?)", 1), F.lit("-"), F.lit("/"))
    full = "d/M/yyyy" if dayfirst else "M/d/yyyy"
    return F.coalesce(*[F.try_to_date(day, p) for p in ("yyyy/M/d", full, "yyyy/M", "M/yyyy")])


def _time(text: Column, dayfirst: bool) -> Column:
    part = lambda k: F.coalesce(F.regexp_extract(text, r"[T ]\s*([0-9]{1,2}):([0-9]{1,2})(?::([0-9]{1,2}))?\s*([AaPp][Mm])?", k).try_cast("int"), F.lit(0))
    half = F.upper(F.regexp_extract(text, r"([AaPp][Mm])\s*$", 1))
    hour = F.when(half == "PM", F.pmod(part(1), F.lit(12)) + 12).when(half == "AM", F.pmod(part(1), F.lit(12))).otherwise(part(1))
    return _date(text, dayfirst).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), hour, part(2), part(3).cast("decimal(18,6)"))


def _parsed(text: Column, kind: str, dayfirst: bool) -> Column:
    if kind == "string":
        return F.nullif(text, F.lit(""))
    text = F.nullif(F.trim(text), F.lit(""))
    if kind == "date32":
        return _date(text, dayfirst)
    if kind == "date64":
        return _time(text, dayfirst)
    return F.regexp_replace(text, ",", "").try_cast("bigint" if kind == "ticks" else kind)


def _numbered_lines(spark: SparkSession, path: str, lineterminator: str | None) -> DataFrame:
    """(value, number, total): each line of a file, its number in the file and the file's lines.

    Lines are counted per block of a file; only one count per block is put in order.
    """
    text = spark.read.text(path, lineSep=lineterminator) if lineterminator else spark.read.text(path)
    at = text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    blocks = at.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    file = Window.partitionBy("file")
    before = F.coalesce(F.sum("n").over(file.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("file", "block", "first", before.alias("before"), F.sum("n").over(file).alias("total"))
    return at.join(F.broadcast(blocks), ["file", "block"]).select("value", (F.col("id") - F.col("first") + F.col("before")).alias("number"), "total")  # a row per block


def read_csv(spark: SparkSession, path: str, names: list[str], dtypes: list[str], delimiter: str = ",", lineterminator: str | None = None, delim_whitespace: bool = False, skipinitialspace: bool = False, skiprows: int = 0, skipfooter: int = 0, dayfirst: bool = False) -> DataFrame:
    """Headerless, unquoted text files with caller-given names and types.

    Empty and missing fields are null, blanks around non-text values are trimmed, numbers
    may hold thousands commas, a last line without terminator is kept.  Rows are skipped
    per file, by counts of its blocks' lines.
    """
    require(len(names) == len(dtypes), INVALID_API_CALL, "names and dtypes differ in number")
    for d in dtypes:
        require(d in CSV_TYPES, UNSUPPORTED_DTYPE, d)
    sep = " " if delim_whitespace else delimiter
    raw = T.StructType([T.StructField(f"_{i}", T.StringType()) for i in range(len(names))])
    options = {"sep": sep, "quote": "", "escape": "", "mode": "PERMISSIVE", "nullValue": "", "header": "false"} | ({"lineSep": lineterminator} if lineterminator else {})
    if skiprows or skipfooter:
        lines = _numbered_lines(spark, path, lineterminator)
        kept = lines.where((F.col("number") >= skiprows) & (F.col("number") < F.col("total") - skipfooter))
        fields = F.from_csv("value", ", ".join(f"_{i} string" for i in range(len(names))), options | {"mode": "PERMISSIVE"})
        df = kept.select(fields.alias("f")).select("f.*")
    else:
        df = spark.read.schema(raw).options(**options).csv(path)
    return df.select(*[_parsed(F.col(f"_{i}"), CSV_TYPES[d], dayfirst).alias(n) for i, (n, d) in enumerate(zip(names, dtypes, strict=True))])


def write_csv(df: DataFrame, path: str, delimiter: str = ",") -> None:
    df.write.mode("overwrite").options(sep=delimiter, quote="", escape="", emptyValue="", nullValue="").csv(path)


def write_csv_file(df: DataFrame, path: str, delimiter: str = ",") -> None:
    """One text file: the rows of the first partition, of the second, and so on.

    Tasks write a part for each partition beside it; the driver appends the parts' bytes to one
    another through a small buffer, removing each, and renames the whole at the end.
    """
    spark, beside = df.sparkSession, f"{path.rstrip('/')}.parts"
    write_csv(df, beside, delimiter)
    hadoop, conf = spark._jvm.org.apache.hadoop, spark._jsparkSession.sessionState().newHadoopConf()
    to, folder, whole = (hadoop.fs.Path(p) for p in (path, beside, f"{beside}/_whole"))
    fs = to.getFileSystem(conf)
    parts = [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-")]
    out = fs.create(whole, True)
    try:
        for part in sorted(parts, key=lambda p: (int(p.getName().split("-")[1]), p.getName())):
            text = fs.open(part)
            try:
                hadoop.io.IOUtils.copyBytes(text, out, conf, False)
            finally:
                text.close()
            fs.delete(part, False)
    finally:
        out.close()
    fs.delete(to, True)
    if not fs.rename(whole, to):
        raise OSError(f"{whole} can't be renamed to {to}")
    fs.delete(folder, True)


# ---- Arrow


def from_arrow_stream(spark: SparkSession, data: bytes) -> DataFrame:
    """An Arrow IPC stream (schema and record batches) as a DataFrame; dictionaries are decoded."""
    import pyarrow as pa

    table = pa.ipc.open_stream(pa.BufferReader(data)).read_all()
    plain = [c.cast(c.type.value_type) if pa.types.is_dictionary(c.type) else c for c in table.columns]
    return spark.createDataFrame(pa.Table.from_arrays(plain, names=table.column_names))


def from_arrow_parts(spark: SparkSession, schema: bytes, batches: list[bytes]) -> DataFrame:
    """A schema message and record batch messages, given apart, as a DataFrame."""
    import pyarrow as pa

    kind = pa.ipc.read_schema(pa.py_buffer(schema))
    return spark.createDataFrame(pa.Table.from_batches([pa.ipc.read_record_batch(pa.py_buffer(b), kind) for b in batches], kind))


def to_arrow_parts(df: DataFrame) -> tuple[bytes, list[bytes]]:
    """The schema message and the record batch messages of a DataFrame small enough for one process."""
    table = df.toArrow()
    return table.schema.serialize().to_pybytes(), [b.serialize().to_pybytes() for b in table.to_batches()]


def arrow_layout(schema: bytes, batch: bytes) -> list[dict]:
    """Name, type, rows, nulls and buffer sizes of each column of a record batch message."""
    import pyarrow as pa

    kind = pa.ipc.read_schema(pa.py_buffer(schema))
    got = pa.ipc.read_record_batch(pa.py_buffer(batch), kind)
    return [{"name": f.name, "type": str(f.type), "rows": len(c), "nulls": c.null_count, "buffers": [b.size if b else 0 for b in c.buffers()]} for f, c in zip(kind, got.columns, strict=True)]


def category_codes(df: DataFrame, name: str, out: str = "code") -> Column:
    """The 32-bit code of a text category: its Murmur3 hash at seed 0; null for null."""
    from ..functions.hashing import murmur

    signed = murmur(df, name).bitwiseXOR(F.lit(0x80000000).cast("long")) - F.lit(0x80000000).cast("long")
    return F.when(F.col(name).isNotNull(), signed.cast("int")).alias(out)


def to_arrow_stream(df: DataFrame) -> bytes:
    """A DataFrame, small enough for one process, as an Arrow IPC stream."""
    import pyarrow as pa

    table, sink = df.toArrow(), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def schema_json(df: DataFrame) -> str:
    return df.schema.json()


# ---- sparse rows


def to_csr(df: DataFrame, row: str, columns: list[str]) -> DataFrame:
    """(row, col, value) of the valid cells of numeric columns; zeros are kept.

    The value type is the widest of the columns.
    """
    order = [T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType(), T.FloatType(), T.DoubleType()]
    widest = max((expect(df, c, NUMBERS) for c in columns), key=order.index)
    cells = F.array(*[F.struct(F.lit(i).alias("col"), F.col(c).cast(widest).alias("value")) for i, c in enumerate(columns)])
    return df.select(F.col(row).alias("row"), F.explode(F.filter(cells, lambda c: c["value"].isNotNull())).alias("cell")).select("row", "cell.col", "cell.value")


def csr_row_offsets(df: DataFrame, row: str, columns: list[str]) -> DataFrame:
    """(row, start, cells): where each row's cells begin in row order."""
    from ..operators.ordered import prefix_sum

    cells = F.lit(0)
    for c in columns:
        cells = cells + F.col(c).isNotNull().cast("int")
    counted = df.select(F.col(row).alias("row"), cells.cast("long").alias("cells"))
    return prefix_sum(counted, "cells", ["row"], inclusive=False, out="start")


def dense_from_csr(cells: DataFrame, columns: list[str]) -> DataFrame:
    """Back to one column per name: the inverse of ``to_csr`` for rows with a valid cell."""
    return cells.groupBy("row").agg(*[F.max(F.when(F.col("col") == i, F.col("value"))).alias(c) for i, c in enumerate(columns)])
