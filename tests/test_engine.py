"""Golden values, edge cases and errors of the engine's operators."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from colonnade.errors import EngineError
from colonnade.functions import hashing, scalar
from colonnade.operators import ordered, relational
from colonnade.sources import files
from colonnade.types import byte_width


def values(df):
    return [tuple(r) for r in df.collect()]


QUANTILES = {  # q: (order statistic, linear, lower, higher, midpoint, nearest) of doubles, then of ints
    0.0: ((-1.01, -1.01, -1.01, 0.15, -0.43, -1.01), (-1, -1, -1, 0, -0.5, -1)),
    0.25: ((0.15, 0.3125, 0.15, 0.8, 0.475, 0.15), (0, 0.25, 0, 1, 0.5, 0)),
    0.33: ((0.15, 0.7805, 0.15, 0.8, 0.475, 0.8), (0, 0.97, 0, 1, 0.5, 1)),
    0.5: ((1.11, 1.62, 1.11, 2.13, 1.62, 2.13), (1, 1.5, 1, 2, 1.5, 2)),
    1.0: ((6.8,) * 6, (7,) * 6),
}


@pytest.mark.parametrize("q", QUANTILES)
def test_quantile_goldens(spark, q):
    doubles = spark.createDataFrame([(x,) for x in (6.8, 0.15, 3.4, 4.17, 2.13, 1.11, -1.01, 0.8, 5.7)], "x double")
    ints = spark.createDataFrame([(x,) for x in (7, 0, 3, 4, 2, 1, -1, 1, 6)], "x int")
    for df, want in zip((doubles, ints), QUANTILES[q], strict=True):
        got = [ordered.order_statistic(df, "x", q).first()[0]] + [ordered.quantile(df, "x", q, m).first()[0] for m in ordered.METHODS]
        assert got == pytest.approx(want, abs=1e-8)


def test_quantile_large_and_empty(spark):
    df = spark.range(50_000).select(((F.col("id") * 7919) % 50_000).cast("double").alias("x"))
    assert ordered.quantile(df, "x", 0.37, "standard" and "lower", convention="standard").first()[0] == math.floor(0.37 * 49_999)
    assert ordered.quantile(df.limit(0), "x", 0.5).first()[0] is None


def test_order_group_filter_goldens(spark):
    df = spark.createDataFrame([(0, 1, 1, 12.0), (1, 1, 1, 11.0), (2, 1, 0, 17.0)], "id int, c1 int, c2 int, c3 double")
    assert [r[0] for r in values(ordered.order_by(df, ["c1", "c2", "c3"], "id"))] == [2, 1, 0]
    rows = list(zip(range(6), (1,) * 6, (1, 3, 3, 5, 5, 0), (12.0, 13.0, 13.0, 17.0, 17.0, 17.0), (2, 4, 5, 7, 11, 3), strict=True))
    g = spark.createDataFrame(rows, "id int, c1 int, c2 int, c3 double, v int")
    keys = ["c1", "c2", "c3"]
    for op, col, want in (("count", None, [1, 1, 2, 2]), ("sum", "c3", [17, 12, 26, 34]), ("avg", "c3", [17, 12, 13, 17]), ("min", "v", [3, 2, 4, 7]), ("max", "v", [3, 2, 5, 11])):
        for method in ("hash", "sort"):
            assert [r["y"] for r in relational.group_by(g, keys, op, col, method, sort_result=True, out="y").collect()] == want
    assert [r["representative"] for r in relational.group_by(g, keys, "count", method="sort", representative="id").collect()] == [5, 0, 1, 3]
    assert relational.count_distinct_keys(g, keys).first()[0] == 4
    f = spark.createDataFrame([(i, 1, b, c) for i, (b, c) in enumerate(zip((1, 3, 3, 5, 5, 5), (12.0, 13.0, 13.0, 17.0, 17.0, 17.0), strict=True))], "id int, c1 int, c2 int, c3 double")
    assert [r[0] for r in values(relational.equality_filter(f, {"c1": 1, "c2": 3, "c3": 13.0}).select("id").orderBy("id"))] == [1, 2]


def test_dates_and_casts(spark):
    times = [dt.datetime(1965, 10, 26, 14, 1, 12, 762000), dt.datetime(2018, 7, 4, 12), dt.datetime(2023, 1, 25, 7, 32, 12), dt.datetime(1969, 12, 31)]
    df = spark.createDataFrame([(t, t.date()) for t in times], "t timestamp_ntz, d date")
    got = values(df.select(*[scalar.extract(df, p, "t") for p in ("year", "month", "day", "hour", "minute", "second")]))
    assert got == [(1965, 10, 26, 14, 1, 12), (2018, 7, 4, 12, 0, 0), (2023, 1, 25, 7, 32, 12), (1969, 12, 31, 0, 0, 0)]
    with pytest.raises(EngineError):
        scalar.extract(df, "hour", "d")
    ticks = spark.createDataFrame([(1528935590000,), (1528935599999,), (-1577923201000,), (None,)], "x bigint")
    timed = ticks.select(scalar.cast(ticks, "x", "date64").alias("t"))
    dated = timed.select(scalar.cast(timed, "t", "date32").alias("d"), scalar.cast(timed, "t", "int64", "s").alias("s"))
    assert [r[0] for r in values(dated.select(scalar.cast(dated, "d", "int32")))] == [17696, 17696, -18264, None]
    assert [r[1] for r in values(dated)] == [1528935590, 1528935599, -1577923201, None]
    f = spark.createDataFrame([(-1528.6,), (1.3,), (19382.9,), (1e30,)], "x double")
    assert [r[0] for r in values(f.select(scalar.cast(f, "x", "int32")))] == [-1528, 1, 19382, None]
    n = spark.createDataFrame([(200,), (-129,), (1 << 31,)], "x bigint")
    assert values(n.select(scalar.cast(n, "x", "int8"), scalar.cast(n, "x", "int32"))) == [(-56, 200), (127, -129), (0, -(1 << 31))]


def test_arithmetic_rules(spark):
    df = spark.createDataFrame([(7, -2, 1.0, 0.0), (2**31 - 1, 1, 0.0, 0.0), (5, 0, -1.0, 0.0), (None, 1, 2.0, None)], "a int, b int, x double, y double")
    assert [r[0] for r in values(df.select(scalar.arithmetic(df, "floordiv", "a", "b")))] == [-4, 2**31 - 1, None, None]
    assert [r[0] for r in values(df.select(scalar.arithmetic(df, "add", "a", "b")))] == [5, -(2**31), 5, None]
    div = [r[0] for r in values(df.select(scalar.arithmetic(df, "div", "x", "y")))]
    assert div[0] == math.inf and math.isnan(div[1]) and div[2] == -math.inf and div[3] is None
    big = spark.createDataFrame([(2**63 - 1, 1), (2**63 - 1, 2**63 - 1)], "a bigint, b bigint")
    assert [r[0] for r in values(big.select(scalar.arithmetic(big, "add", "a", "b")))] == [-(2**63), -2]
    assert [r[0] for r in values(big.select(scalar.arithmetic(big, "mul", "a", "b")))] == [2**63 - 1, 1]
    with pytest.raises(EngineError, match="DTYPE_MISMATCH"):
        scalar.arithmetic(df, "add", "a", "x")
    logs = spark.createDataFrame([(0.0,), (-1.0,), (1.0,), (None,), (-2.5,), (1e300,)], "x double")
    got = [r[0] for r in values(logs.select(scalar.unary(logs, "log", "x")))]
    assert got[0] == -math.inf and math.isnan(got[1]) and got[2] == 0 and got[3] is None
    assert [r[0] for r in values(logs.select(scalar.unary(logs, "floor", "x")))][4:] == [-3.0, 1e300]


@pytest.mark.parametrize("how", ["inner", "left", "full"])
@pytest.mark.parametrize("method", ["hash", "sort", "broadcast"])
def test_joins_against_loops(spark, how, method):
    r = random.Random(3)
    left = [(i, r.choice([None, 1, 2, 3, 4])) for i in range(12)]
    right = [(i, r.choice([None, 2, 3, 5])) for i in range(9)]
    a, b = spark.createDataFrame(left, "lid long, k int"), spark.createDataFrame(right, "rid long, k int")
    want = [(x, y) for x, k in left for y, j in right if k is not None and k == j]
    if how != "inner":
        want += [(x, -1) for x, k in left if not any(k is not None and k == j for _, j in right)]
    if how == "full":
        want += [(-1, y) for y, j in right if not any(j is not None and k == j for _, k in left)]
    got = values(relational.join(a, b, ["k"], how, method, "indices", "lid", "rid"))
    assert sorted(got) == sorted(want)
    assert relational.join(a, b, ["k"], how, method).columns == ["lid", "k", "rid"]
    assert relational.join(a.limit(0), b.limit(0), ["k"], how, method).count() == 0


@pytest.mark.parametrize("how", ["inner", "left"])
def test_broadcast_is_for_rows_that_fit(spark, tmp_path, how):
    spark.range(1_200_000).selectExpr("id % 7 as k", "id % 3 as a", "'' as s").write.parquet(f"{tmp_path}/many")  # a few KB of file, 38 MB of rows
    spark.range(5).selectExpr("id as k", "id % 3 as a", f"repeat('x', {8 << 20}) as s").coalesce(1).write.parquet(f"{tmp_path}/long")
    many, long = (spark.read.parquet(f"{tmp_path}/{x}") for x in ("many", "long"))
    left, few = spark.createDataFrame([(6, 1), (9, 2)], "k long, lid int"), many.where("k = 6").limit(100)
    for right, fits, rows in ((many, False, 171_428), (long, False, 0), (few, True, 100), (long.drop("s"), True, 0)):
        got = relational.join(left, right, ["k"], how, "broadcast")
        assert ("BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()) == fits
        assert got.where("a is not null").count() == rows
        assert got.where("a is null").count() == (how == "left") * (2 - (rows > 0))
    assert relational.join(left, few.selectExpr("k", "array(a) as a"), ["k"], how, "broadcast").where("a is not null").count() == 100


def test_join_errors(spark):
    a, b = spark.createDataFrame([(1,)], "k int"), spark.createDataFrame([(1,)], "k long")
    for bad in (dict(on=["k"]), dict(on=[("k", "k")], how="cross")):
        with pytest.raises(EngineError):
            relational.join(a, b, **bad)


def test_reductions(spark):
    df = spark.createDataFrame([(100, 2.0), (100, None), (None, 3.0)], "a tinyint, x double")
    assert df.agg(relational.reduction(df, "sum", "a", "input")).first()[0] == -56
    assert df.agg(relational.reduction(df, "sum", "a")).first()[0] == 200
    assert df.agg(relational.reduction(df, "product", "x"), relational.reduction(df, "sum_squared", "x")).first()[:] == (6.0, 13.0)
    none = df.where("a > 127")
    assert none.agg(relational.reduction(none, "min", "a"), relational.reduction(none, "max", "a"), relational.reduction(none, "sum", "a")).first()[:] == (127, -128, 0)


@pytest.mark.parametrize("n", [0, 1, 2, 13, 1000])
def test_prefix_sum(spark, n):
    r = random.Random(n)
    rows = [(i, r.choice([None, *range(-3, 4)])) for i in range(n)]
    df = spark.createDataFrame(rows, "k long, v tinyint")
    for inclusive in (True, False):
        run, want = 0, []
        for _, v in rows:
            want.append(run + (v or 0) * inclusive)
            run += v or 0
        got = [x["prefix"] for x in ordered.prefix_sum(df, "v", ["k"], inclusive).orderBy("k").collect()]
        assert got == want
        wrapped = [x["prefix"] for x in ordered.prefix_sum(df, "v", ["k"], inclusive, result_type="input").orderBy("k").collect()]
        assert wrapped == [(w + 128) % 256 - 128 for w in want]


def test_sorts(spark):
    r = random.Random(1)
    rows = [(i, r.randint(-5, 5)) for i in range(40)]
    df = spark.createDataFrame(rows, "p long, v int")
    assert [x["p"] for x in ordered.radix_sort(df, "v", "p", descending=True).collect()] == [p for p, v in sorted(rows, key=lambda x: (-x[1], x[0]))]
    moved = {x["p"]: x["new_position"] for x in ordered.segmented_sort(df, "v", "p", [(3, 10), (20, 33)]).collect()}
    for a, b in ((3, 10), (20, 33)):
        want = sorted(rows[a:b], key=lambda x: (x[1], x[0]))
        assert [moved[p] for p, _ in want] == list(range(a, b))
    assert all(moved[p] == p for p in (0, 1, 2, 10, 15, 33, 39))
    with pytest.raises(EngineError):
        ordered.window_aggregate(df, "sum", "v", [], ["p"])


def _murmur3(data, seed=0):
    def rot(x, k):
        return ((x << k) | (x >> (32 - k))) & 0xFFFFFFFF

    h = seed
    for i in range(0, len(data), 4):
        k = int.from_bytes(data[i : i + 4], "little") * 0xCC9E2D51 & 0xFFFFFFFF
        h ^= rot(k, 15) * 0x1B873593 & 0xFFFFFFFF
        if len(data) - i >= 4:
            h = (rot(h, 13) * 5 + 0xE6546B64) & 0xFFFFFFFF
    h ^= len(data)
    for shift, m in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
        h = (h ^ (h >> shift)) * m & 0xFFFFFFFF
    return h


def test_hashing(spark):
    rows = [(1, 2, 1.5, 2.5), (-7, 2**40, -1.0, 1e9), (1, 2, 1.5, 2.5)]
    df = spark.createDataFrame(rows, "a int, b long, c float, d double")
    for name, kind in (("a", "<i4"), ("b", "<i8"), ("c", "<f4"), ("d", "<f8")):
        got = [r[0] for r in values(df.select(hashing.murmur(df, name)))]
        assert got == [_murmur3(np.array([r["abcd".index(name)]], kind).tobytes()) for r in rows]
    hashed = [r["hash"] for r in hashing.row_hash(df, ["a", "b", "c", "d"]).collect()]
    assert hashed[0] == hashed[2] != hashed[1]
    big = spark.range(1000).withColumn("n", F.when(F.col("id") % 5 != 0, F.col("id")))
    for parts in (1, 5, 8, 10, 257):
        offsets = values(hashing.partition_offsets(big, ["id", "n"], parts))
        assert [o[0] for o in offsets] == list(range(parts)) and sum(o[1] for o in offsets) == 1000
        dealt = hashing.hash_partition(big, ["id", "n"], parts).withColumn("at", F.spark_partition_id())
        assert dealt.where("at <> part").count() == 0


def test_hash_of_bytes_and_shorts(spark):
    shorts = [*range(-128, 128), -32768, 32767, 256, -257, None]
    df = spark.createDataFrame([(v if v is not None and -128 <= v < 128 else None, v) for v in shorts], "a byte, b short")
    for name, kind in (("a", "<i1"), ("b", "<i2")):
        for r in df.select(name, hashing.murmur(df, name).alias("h")).collect():
            assert r.h == (None if r[0] is None else _murmur3(np.array([r[0]], kind).tobytes()))


def test_fnv_hash(spark):
    rows = [(1, -2, 3, -4, 1.5, -2.5), (-128, 32767, -(2**31), 2**63 - 1, -0.0, 1e300), (5, 6, 7, -(2**63), 0.1, 0.2), (1, None, 3, 4, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "a byte, b short, c int, d long, e float, f double")
    got = values(df.select(hashing.fnv_hash(df, df.columns)))
    for (h,), row in zip(got, rows, strict=True):
        if None in row:
            assert h is None
            continue
        want = 14695981039346656037
        for v, kind in zip(row, ("<i1", "<i2", "<i4", "<i8", "<f4", "<f8"), strict=True):
            for byte in np.array([v], kind).view("i1").tolist():
                want = (want ^ (byte % 2**64)) * 1099511628211 % 2**64
        assert h % 2**64 == want
    times = spark.createDataFrame([(dt.date(1969, 12, 30), dt.datetime(1969, 12, 31, 23, 59, 59))], "d date, t timestamp_ntz").withColumns({"days": F.lit(-2), "micros": F.lit(-1_000_000).cast("long")})
    assert values(times.select(hashing.fnv_hash(times, ["d", "t"]))) == values(times.select(hashing.fnv_hash(times, ["days", "micros"])))


@pytest.mark.parametrize("kind, bits", [("byte", 8), ("short", 16), ("int", 32), ("long", 64)])
def test_integer_product(spark, kind, bits):
    numbers = [3, -5, 7, 11, 13, -17, 19, 23, None, 29, 31, 37, 41, 43, 47, 53, 59, 61]
    df = spark.createDataFrame([(v,) for v in numbers], f"x {kind}")
    want = 1
    for v in numbers:
        want *= v or 1
    want = (want + (1 << bits - 1)) % (1 << bits) - (1 << bits - 1)
    assert values(relational.integer_product(df, "x")) == [(want,)]
    assert values(relational.integer_product(df.where("x is null"), "x")) == values(relational.integer_product(df.limit(0), "x")) == [(1,)]


def test_csv(spark, tmp_path):
    text = "skip me\n1/2/2018,-1,234,x y,\"q\"\n2018-3-4T5:06 PM, 7 ,,,a\n,1e3\nlast,9,8,7,6\nfoot"
    (tmp_path / "a.csv").write_text(text)
    df = files.read_csv(spark, str(tmp_path / "a.csv"), ["d", "n", "f", "s", "t"], ["date", "int32", "float64", "str", "category"], skiprows=1, skipfooter=1)
    assert values(df) == [
        (dt.datetime(2018, 1, 2), -1, 234.0, "x y", '"q"'),
        (dt.datetime(2018, 3, 4, 17, 6), 7, None, None, "a"),
        (None, None, None, None, None),
        (None, 9, 8.0, "7", "6"),
    ]
    (tmp_path / "b.csv").write_text("13/2/2001|1,234.5\r\n02-2001|+2\r\n")
    b = files.read_csv(spark, str(tmp_path / "b.csv"), ["d", "x"], ["date32", "double"], delimiter="|", dayfirst=True)
    assert values(b) == [(dt.date(2001, 2, 13), 1234.5), (dt.date(2001, 2, 1), 2.0)]
    with pytest.raises(EngineError):
        files.read_csv(spark, "x", ["a"], ["int8"])


def test_arrow_and_csr(spark):
    df = spark.createDataFrame([(1, "a", 0.5), (2, None, None)], "idx int, name string, weight double")
    back = files.from_arrow_stream(spark, files.to_arrow_stream(df))
    assert values(back) == values(df)
    d = spark.createDataFrame([(0, 1, None), (1, None, None), (2, 0, 2.5)], "r long, a int, b double")
    assert sorted(values(files.to_csr(d, "r", ["a", "b"]))) == [(0, 0, 1.0), (2, 0, 0.0), (2, 1, 2.5)]
    assert sorted(r["start"] for r in files.csr_row_offsets(d, "r", ["a", "b"]).collect()) == [0, 1, 1]
    assert byte_width(d, "b") == 8


def test_concat(spark):
    a, b = spark.createDataFrame([(1,), (None,)], "x int"), spark.createDataFrame([(2,)], "x int")
    assert sorted(values(relational.concat([a, b], source="s")), key=str) == [(1, 0), (2, 1), (None, 0)]
    with pytest.raises(EngineError):
        relational.concat([a, b.select(F.col("x").cast("long"))])


def test_streaming_group_by(spark, tmp_path):
    from colonnade.streaming.incremental import windowed_group_by

    src = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, m), "k", m) for m in range(10)], "ts timestamp, k string, v int")
    src.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    q = windowed_group_by(stream, "ts", "5 minutes", ["k"], "sum", "v").writeStream.format("memory").queryName("wgb").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["sum_v"] for r in spark.sql("select * from wgb").collect()) == [10, 35]


# ---- exactness at the edges of types, and order without one task


def test_average_in_the_input_type_truncates(spark):
    d = spark.range(10_000).select((F.lit(0)).alias("g"), F.when(F.col("id") == 0, -2).otherwise(-3).cast("int").alias("x"))
    assert relational.group_by(d, ["g"], "avg", "x", result_type="input", out="y").first().y == -2
    d = spark.range(9, numPartitions=2).select(F.lit(0).alias("g"), F.lit((1 << 62) + 1).cast("long").alias("x"))
    assert relational.group_by(d, ["g"], "avg", "x", result_type="input", out="y").first().y == (1 << 62) + 1


def test_order_statistic_keeps_large_integers(spark):
    d = spark.createDataFrame([((1 << 53) + k,) for k in (1, 3, 5)], "x long")
    assert [ordered.order_statistic(d, "x", q).first()[0] - (1 << 53) for q in (0.0, 0.7, 1.0)] == [1, 3, 5]
    assert ordered.order_statistic(d.limit(0), "x", 0.5).first()[0] is None


def test_quantile_narrows_its_bracket(spark, monkeypatch):
    monkeypatch.setattr(ordered, "MOST_SORTED", 5)
    for values in ([k * 37 % 1009 for k in range(1009)], [k % 3 for k in range(900)], [7] * 500, [None, 1, 2, None]):
        d = spark.createDataFrame([(v,) for v in values], "x int").repartition(3)
        plain = sorted(v for v in values if v is not None)
        for q in (0.0, 0.2, 0.5, 0.77, 1.0):
            at = len(plain) - 1 if q == 1 else max(int(q * len(plain)) - 1, 0)
            assert ordered.quantile(d, "x", q, "lower").first()[0] == plain[at]
            assert ordered.quantile(d, "x", q, "higher").first()[0] == plain[at if q == 1 else min(at + 1, len(plain) - 1)]


def test_identity_hash_of_any_number(spark):
    d = spark.createDataFrame([(float("nan"),), (1e300,), (float("-inf"),), (-1.0,), (None,), (5.9,)], "x double")
    assert [r[0] for r in hashing.row_hash(d, ["x"], "identity").select("hash").collect()] == [0, 0, 0, -1, 0, 5]


def test_csv_skips_rows_by_its_terminator(spark, tmp_path):
    (tmp_path / "a.csv").write_text("head;1,2020-01-02;2,2021-03-04;3,;foot")
    got = files.read_csv(spark, f"{tmp_path}/a.csv", ["a", "d"], ["int32", "date32"], lineterminator=";", skiprows=1, skipfooter=1).collect()
    assert [(r.a, str(r.d)) for r in got] == [(1, "2020-01-02"), (2, "2021-03-04"), (3, "None")]
    (tmp_path / "b.csv").write_text("".join(f"{k},x{k}\n" for k in range(60_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        got = files.read_csv(spark, f"{tmp_path}/b.csv", ["a", "b"], ["int64", "str"], skiprows=7, skipfooter=3)
        assert got.rdd.getNumPartitions() > 3
        assert [r.a for r in got.orderBy("a").collect()] == list(range(7, 59_997))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_csv_file_is_written_by_many_tasks(spark, tmp_path, monkeypatch):
    from colonnade.plans import catalog

    monkeypatch.setattr(ordered, "RANGE_ROWS", 400, raising=False)
    monkeypatch.setattr(catalog, "_shared_folder", lambda spark: f"{tmp_path}/out")
    write, parts = files.write_csv, []
    monkeypatch.setattr(files, "write_csv", lambda df, *a: parts.append(df.select(F.spark_partition_id().alias("p")).groupBy("p").count().agg(F.max("count")).first()[0]) or write(df, *a))
    times = [dt.datetime(2024, 1, 1) + dt.timedelta(seconds=977 * k, microseconds=k) for k in range(5000)]
    rows = [(7 * k % 5000, times[7 * k % 5000]) for k in range(5000)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    got = catalog.QUERIES["csv_dates_skip"](spark, str(tmp_path))
    assert sorted(values(got)) == [(k, t.date(), t.replace(microsecond=0)) for k, t in enumerate(times)][2:-2]
    assert len(parts) == 1 and parts[0] < 1000  # rows of the largest task
    files.write_csv_file(ordered.sorted_ranges(spark.range(5000).selectExpr("4999 - id as a", "nullif(id % 2, 0) as b"), ["a"]), f"{tmp_path}/out", ",")  # overwrites
    assert (tmp_path / "out").read_text() == "".join(f"{a},{'' if a % 2 else 1}\n" for a in range(5000))
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["events.parquet", "out"]
    files.write_csv_file(ordered.sorted_ranges(spark.range(0), ["id"]), f"{tmp_path}/none")
    assert (tmp_path / "none").read_text() == "" and files.read_csv(spark, f"{tmp_path}/none", ["a"], ["int64"], skiprows=2, skipfooter=2).collect() == []


@pytest.mark.parametrize("key", ["cast(id % 3 as string)", "0", "cast(id as string)", "nullif(id % 5, 0)"])
def test_prefix_sum_splits_any_keys(spark, key):
    d = spark.range(400).selectExpr(f"{key} as k", "id", "id * id as v").repartition(5)
    assert ordered.ranged(d, ["k", "id"], 4).select("_range").distinct().count() >= 3
    rows = sorted(((r.k is not None, r.k, r.id, r.v) for r in d.collect()), key=lambda r: (r[0], r[1] if r[0] else 0, r[2]))
    total, want = 0, {}
    for _, _, i, v in rows:
        total += v
        want[i] = total
    assert {r.id: r.prefix for r in ordered.prefix_sum(d, "v", ["k", "id"], parts=4).collect()} == want


def test_segments_that_overlap_no_stretch_evenly(spark):
    d = spark.range(100).selectExpr("id", "cast((id * 37) % 101 as int) as v")
    got = {r.id: r.new_position for r in ordered.segmented_sort(d, "v", "id", [(0, 3), (3, 3), (5, 60), (90, 200)]).collect()}
    for a, b in ((0, 3), (5, 60), (90, 100)):
        order = sorted(range(a, b), key=lambda i: ((i * 37) % 101, i))
        assert [got[i] for i in order] == list(range(a, b))
    assert all(got[i] == i for i in [3, 4, *range(60, 90)]) and len(got) == 100


def test_named_ranges_reach_the_jobs(spark):
    from colonnade.trace import traced

    sc = spark.sparkContext
    with traced(spark, "outer"):
        with traced(spark, "inner"):
            assert sc.getLocalProperty("spark.job.description") == "outer / inner"
        assert sc.getLocalProperty("spark.job.description") == "outer"
    assert sc.getLocalProperty("spark.job.description") is None


def test_arrow_parts_and_layout(spark):
    d = spark.createDataFrame([(1, "a"), (2, None), (None, "c")], "x int, s string").coalesce(1)
    schema, batches = files.to_arrow_parts(d)
    assert files.from_arrow_parts(spark, schema, batches).collect() == d.collect()
    layout = [files.arrow_layout(schema, b) for b in batches]
    assert [[(c["name"], sum(b[k]["rows"] for b in layout), sum(b[k]["nulls"] for b in layout)) for k, c in enumerate(layout[0])]] == [[("x", 3, 1), ("s", 3, 1)]]
    assert files.from_arrow_parts(spark, schema, []).collect() == []
    codes = [r[0] for r in d.select(files.category_codes(d, "s")).collect()]
    assert codes[1] is None and len(set(codes)) == 3


def test_nanosecond_ticks(spark):
    d = spark.sql("select timestamp_ntz'1970-01-01 00:00:01.000002' as t, -1L as n")
    out = d.select(scalar.cast(d, "t", "int64", "ns"), scalar.cast(d, "n", "timestamp", "ns").alias("back"))
    assert out.first()[0] == 1_000_002_000 and str(out.first().back) == "1969-12-31 23:59:59.999999"
    assert out.schema[0].metadata == {"unit": "ns"}
