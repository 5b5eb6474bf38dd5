"""Registered queries over the test tables and their DuckDB forms.

Every query runs over its whole tables; float results are rounded on both sides where
summation order matters.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import hashing as H
from ..functions import scalar as S
from ..operators import ordered as O
from ..operators import relational as R
from ..sources import files

QUERIES: dict = {}
ORACLES: dict = {}


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None, *tables: str):
    """Registers f(*tables) under ``name`` with its oracle."""

    def put(f):
        QUERIES[name] = lambda spark, sf_dir: f(*[table(spark, sf_dir, t) for t in tables])
        if sql:
            ORACLES[name] = sql
        return f

    return put


def flagship(spark, sf_dir):
    items, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    recent = R.apply_stencil(items, F.col("l_shipdate") > F.lit("1996-01-01").cast("timestamp_ntz"))
    priced = recent.select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    joined = R.join(priced, orders.select("o_orderkey", "o_orderpriority"), [("l_orderkey", "o_orderkey")])
    return R.group_by(joined, ["o_orderpriority"], "sum", "revenue", method="sort", out="revenue").withColumn("revenue", F.round("revenue", 2))


QUERIES["flagship"] = flagship
ORACLES["flagship"] = "select o_orderpriority, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from lineitem join orders on l_orderkey = o_orderkey where l_shipdate > timestamp '1996-01-01' group by 1"

# ---- scalar functions

_KEYS = "l_orderkey, l_linenumber"
_DOMAIN = {"asin": "l_discount", "acos": "l_discount", "exp": "l_tax", "ceil": "l_extendedprice", "floor": "l_extendedprice"}
for _op in S.UNARY:
    _c = _DOMAIN.get(_op, "l_quantity")

    def _unary(df, op=_op, c=_c):
        return df.select("l_orderkey", "l_linenumber", F.round(S.unary(df, op, c), 9).alias("y"))

    _fn = "ln" if _op == "log" else _op
    query(f"unary_{_op}", f"select {_KEYS}, round({_fn}({_c}), 9) as y from lineitem", "lineitem")(_unary)


@query("cast_numeric", f"select {_KEYS}, trunc(l_extendedprice)::integer as i32, trunc(l_extendedprice)::bigint as i64, l_extendedprice::float as f32, l_linenumber::double as f64 from lineitem", "lineitem")
def _cast_numeric(df):
    return df.select("l_orderkey", "l_linenumber", S.cast(df, "l_extendedprice", "int32").alias("i32"), S.cast(df, "l_extendedprice", "int64").alias("i64"), S.cast(df, "l_extendedprice", "float32").alias("f32"), S.cast(df, "l_linenumber", "float64").alias("f64"))


@query("cast_wrap_i8", "select o_orderkey, (((o_orderkey & 255) + 128) % 256 - 128)::tinyint as i8, (((o_orderkey & 65535) + 32768) % 65536 - 32768)::smallint as i16 from orders", "orders")
def _cast_wrap(df):
    return df.select("o_orderkey", S.cast(df, "o_orderkey", "int8").alias("i8"), S.cast(df, "o_orderkey", "int16").alias("i16"))


@query("cast_datetime", "select event_id, ts::date as d32, (epoch_us(ts) // 1000)::bigint as ms, (ts::date - date '1970-01-01')::integer as days, date_trunc('second', ts) as s, (date '1970-01-01' + user_id::integer) as from_days from events", "events")
def _cast_datetime(df):
    d = df.withColumn("d", S.cast(df, "ts", "date32"))
    return d.select("event_id", F.col("d").alias("d32"), S.cast(df, "ts", "int64", "ms").alias("ms"), S.cast(d, "d", "int32").alias("days"), S.cast(df, "ts", "timestamp", "s").alias("s"), S.cast(df, "user_id", "date32").alias("from_days"))


@query("cast_date64", "select event_id, date_trunc('millisecond', ts)::timestamp as d64, ts::date::timestamp as midnight, (epoch_us(ts) * 1000)::bigint as ns, make_timestamp((user_id::bigint * 1000000007) // 1000) as from_ns, epoch_ms(user_id::bigint)::timestamp as from_ms from events", "events")
def _cast_date64(df):
    d = df.select("event_id", "ts", F.col("user_id").cast("long").alias("ms"), (F.col("user_id").cast("long") * 1000000007).alias("ns")).withColumn("day", S.cast(df, "ts", "date32"))
    return d.select("event_id", S.cast(d, "ts", "date64").alias("d64"), S.cast(d, "day", "date64").alias("midnight"), S.cast(d, "ts", "int64", "ns").alias("ns"), S.cast(d, "ns", "timestamp", "ns").alias("from_ns"), S.cast(d, "ms", "date64").alias("from_ms"))


for _p in ("year", "month", "day", "hour", "minute", "second"):

    def _extract(df, p=_p):
        return df.select("event_id", S.extract(df, p, "ts").alias("part"))

    query(f"extract_{_p}", f"select event_id, {_p}(ts)::smallint as part from events", "events")(_extract)

for _op, _sql in {"add": "l_quantity + l_extendedprice", "sub": "l_quantity - l_extendedprice", "mul": "l_quantity * l_extendedprice", "div": "l_extendedprice / l_quantity", "floordiv": "floor(l_extendedprice / l_quantity)"}.items():

    def _arith(df, op=_op):
        a, b = ("l_extendedprice", "l_quantity") if "div" in op else ("l_quantity", "l_extendedprice")
        return df.select("l_orderkey", "l_linenumber", S.arithmetic(df, op, a, b).alias("y"))

    query(f"arith_{_op}", f"select {_KEYS}, {_sql} as y from lineitem", "lineitem")(_arith)


@query("arith_int_wrap", "select o_orderkey, ((o_orderkey * 40503 + 2147483648) % 4294967296 - 2147483648)::integer as m, (floor(o_custkey::double / -7.0))::integer as f from orders", "orders")
def _arith_int(df):
    d = df.select("o_orderkey", F.col("o_orderkey").cast("int").alias("a"), F.lit(40503).alias("b"), F.col("o_custkey").cast("int").alias("c"), F.lit(-7).alias("d"))
    return d.select("o_orderkey", S.arithmetic(d, "mul", "a", "b").alias("m"), S.arithmetic(d, "floordiv", "c", "d").alias("f"))


_SMALL = ", ".join(f"((({x}) & {m}) + {h}) % {m + 1} - {h} as {n}" for n, x, m, h in (("i8", "l_linenumber * l_suppkey", 255, 128), ("i16", "l_linenumber * l_suppkey * 31", 65535, 32768)))


@query("arith_small_types", f"select {_KEYS}, i8::tinyint as i8, i16::smallint as i16, f32 from (select *, {_SMALL}, (l_quantity::float * l_tax::float) as f32 from lineitem)", "lineitem")
def _arith_small(df):
    one, two = F.col("l_linenumber").cast("long"), F.col("l_suppkey").cast("long")
    wrapped = lambda x, kind: S.wrap(x, kind)
    d = df.select("l_orderkey", "l_linenumber", *[wrapped(x, k()).alias(f"{n}{k.__name__[0]}") for k in (T.ByteType, T.ShortType) for n, x in (("a", one), ("b", two * (1 if k is T.ByteType else 31)))], F.col("l_quantity").cast("float").alias("q"), F.col("l_tax").cast("float").alias("t"))
    return d.select("l_orderkey", "l_linenumber", S.arithmetic(d, "mul", "aB", "bB").alias("i8"), S.arithmetic(d, "mul", "aS", "bS").alias("i16"), S.arithmetic(d, "mul", "q", "t").alias("f32"))


@query("unary_float32", f"select {_KEYS}, round(sqrt(l_quantity::float)::double, 3) as y, floor(l_extendedprice::float) as z from lineitem", "lineitem")
def _unary_float(df):
    d = df.select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("float").alias("q"), F.col("l_extendedprice").cast("float").alias("p"))
    return d.select("l_orderkey", "l_linenumber", F.round(S.unary(d, "sqrt", "q").cast("double"), 3).alias("y"), S.unary(d, "floor", "p").alias("z"))


for _op, _sign in {"gt": ">", "ge": ">=", "lt": "<", "le": "<=", "eq": "=", "ne": "<>"}.items():

    def _cmp(df, op=_op):
        return df.select("l_orderkey", "l_linenumber", S.compare(df, op, "l_discount", "l_tax", as_int8=True).alias("y"))

    query(f"cmp_{_op}", f"select {_KEYS}, (l_discount {_sign} l_tax)::tinyint as y from lineitem", "lineitem")(_cmp)

    def _scalar(df, op=_op):
        return R.apply_stencil(df, S.compare_scalar(df, op, "l_quantity", 25.0)).select("l_orderkey", "l_linenumber")

    query(f"cmp_scalar_{_op}", f"select {_KEYS} from lineitem where l_quantity {_sign} 25.0", "lineitem")(_scalar)


@query("cmp_mixed_types", f"select {_KEYS}, (l_linenumber < l_quantity)::tinyint as y from lineitem", "lineitem")
def _mixed(df):
    return df.select("l_orderkey", "l_linenumber", S.compare(df, "lt", "l_linenumber", "l_quantity", as_int8=True, mixed=True).alias("y"))


for _op, _sql in {"and": "o_orderkey & o_custkey", "or": "o_orderkey | o_custkey", "xor": "xor(o_orderkey, o_custkey)"}.items():

    def _bits(df, op=_op):
        return df.select("o_orderkey", S.bitwise(df, op, "o_orderkey", "o_custkey").alias("y"))

    query(f"bitwise_{_op}", f"select o_orderkey, {_sql} as y from orders", "orders")(_bits)

# ---- validity and filters

_NULLED = "select *, nullif(l_linenumber, 1) as a, nullif(l_returnflag, 'N') as b from lineitem"


def _nulled(df):
    return df.withColumn("a", F.nullif("l_linenumber", F.lit(1))).withColumn("b", F.nullif("l_returnflag", F.lit("N")))


@query("validity_and", f"select {_KEYS} from ({_NULLED}) where a is not null and b is not null", "lineitem")
def _validity(df):
    return R.apply_stencil(_nulled(df), S.validity_and("a", "b")).select("l_orderkey", "l_linenumber")


@query("count_valid", f"select count(a) as valid, count(*) - count(b) as nulls from ({_NULLED})", "lineitem")
def _count_valid(df):
    d = _nulled(df)
    return d.agg(R.reduction(d, "count", "a").alias("valid"), F.count_if(F.col("b").isNull()).alias("nulls"))


@query("filter_stencil", f"select {_KEYS}, a from ({_NULLED}) where a > 3", "lineitem")
def _stencil(df):
    d = _nulled(df)
    return R.apply_stencil(d.withColumn("m", S.compare_scalar(d, "gt", "a", 3, as_int8=True)), "m").select("l_orderkey", "l_linenumber", "a")


@query("filter_equality", f"select {_KEYS} from lineitem where l_returnflag = 'R' and l_linenumber = 2", "lineitem")
def _equality(df):
    return R.equality_filter(df, {"l_returnflag": "R", "l_linenumber": 2}).select("l_orderkey", "l_linenumber")


# ---- joins

for _how, _sql_how in {"inner": "join", "left": "left join", "full": "full join"}.items():
    for _m in ("hash", "sort", "broadcast"):

        def _join(c, o, how=_how, m=_m):
            o = o.withColumn("o_custkey", F.col("o_custkey") + 50)  # either side keeps rows without a match
            return R.join(c.select("c_name", "c_custkey"), o.select("o_custkey", "o_orderkey", "o_totalprice"), [("c_custkey", "o_custkey")], how, m)

        query(f"join_{_how}_{_m}", f"select c_name, coalesce(c_custkey, k) as c_custkey, o_orderkey, o_totalprice from customer {_sql_how} (select o_custkey + 50 as k, o_orderkey, o_totalprice from orders) on c_custkey = k", "customer", "orders")(_join)


@query("join_multi_key", "select a.l_linenumber as n1, a.l_orderkey, a.l_suppkey, b.l_linenumber as n2 from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_suppkey = b.l_suppkey", "lineitem")
def _multi(df):
    a = df.select(F.col("l_linenumber").alias("n1"), "l_orderkey", "l_suppkey")
    b = df.select("l_orderkey", "l_suppkey", F.col("l_linenumber").alias("n2"))
    return R.join(a, b, ["l_orderkey", "l_suppkey"])


@query("join_null_keys", "select s_name, s_suppkey, nullif(s_nationkey, 3) as k, n_name from supplier left join nation on nullif(s_nationkey, 3) = n_nationkey", "supplier", "nation")
def _null_keys(s, n):
    s = s.select("s_name", "s_suppkey", F.nullif("s_nationkey", F.lit(3)).alias("k"))
    return R.join(s, n.select("n_nationkey", "n_name"), [("k", "n_nationkey")], "left")


@query("join_indices", "select coalesce(s_suppkey, -1) as left_id, coalesce(n_nationkey, -1)::bigint as right_id from supplier full join (select n_nationkey + 5 as n_nationkey from nation) on s_nationkey = n_nationkey", "supplier", "nation")
def _indices(s, n):
    n = n.withColumn("n_nationkey", F.col("n_nationkey") + 5).withColumn("rid", F.col("n_nationkey").cast("long"))
    return R.join(s, n, [("s_nationkey", "n_nationkey")], "full", output="indices", left_id="s_suppkey", right_id="rid")


# ---- reductions

for _op, _sql in {"sum": "round(sum(l_quantity), 2)", "sum_squared": "round(sum(l_quantity * l_quantity), 2)", "min": "min(l_quantity)", "max": "max(l_quantity)"}.items():

    def _reduce(df, op=_op):
        return df.agg(F.round(R.reduction(df, op, "l_quantity"), 2).alias("y"))

    query(f"reduce_{_op}", f"select {_sql} as y from lineitem", "lineitem")(_reduce)


@query("reduce_product", "select round(product(1 + n_regionkey), 0)::double as y from nation", "nation")
def _product(df):
    d = df.select((F.col("n_regionkey") + 1).alias("x"))
    return d.agg(F.round(R.reduction(d, "product", "x"), 0).alias("y"))


@query("reduce_product_wrap", f"select (case when p >= 9223372036854775808 then p - {1 << 64}::hugeint else p end)::bigint as y from (select list_reduce(list((2 * l_partkey + 1)::hugeint), lambda a, b: (a * b) % {1 << 64}::hugeint) as p from lineitem)", "lineitem")
def _product_wrap(df):
    return R.integer_product(df.select((2 * F.col("l_partkey") + 1).cast("long").alias("x")), "x", "y")


@query("reduce_empty_identity", "select 0::bigint as s, 1.0::double as p, 2147483647::integer as lo, (-2147483648)::integer as hi", "nation")
def _identity(df):
    d = df.where("n_nationkey < 0")
    return d.agg(R.reduction(d, "sum", "n_regionkey").alias("s"), R.reduction(d, "product", "n_regionkey").alias("p"), R.reduction(d, "min", "n_regionkey").alias("lo"), R.reduction(d, "max", "n_regionkey").alias("hi"))


@query("reduce_sum_wrap", "select (((sum(l_partkey) + 2147483648) % 4294967296) - 2147483648)::integer as y from lineitem", "lineitem")
def _sum_wrap(df):
    d = df.select(F.col("l_partkey").cast("int").alias("x"))
    return d.agg(R.reduction(d, "sum", "x", "input").alias("y"))


# ---- group-by

for _op in ("sum", "min", "max", "avg", "count"):
    for _m in ("hash", "sort"):

        def _group(df, op=_op, m=_m):
            return R.group_by(df, ["l_returnflag", "l_linestatus"], op, "l_linenumber", m, out="y")

        _a = {"count": "count(*)", "sum": "sum(l_linenumber)::bigint", "avg": "avg(l_linenumber)"}.get(_op, f"{_op}(l_linenumber)")
        query(f"groupby_{_op}_{_m}", f"select l_returnflag, l_linestatus, {_a} as y from lineitem group by all", "lineitem")(_group)


@query("groupby_multi_key", "select l_suppkey, l_returnflag, l_linenumber, round(sum(l_quantity), 2) as y, min(l_orderkey) as representative from lineitem group by all", "lineitem")
def _group_multi(df):
    return R.group_by(df, ["l_suppkey", "l_returnflag", "l_linenumber"], "sum", "l_quantity", representative="l_orderkey", out="y").withColumn("y", F.round("y", 2))


@query("groupby_count_distinct", "select l_returnflag, l_linestatus, count(distinct l_suppkey) as y from lineitem group by all", "lineitem")
def _group_distinct(df):
    return R.group_by(df, ["l_returnflag", "l_linestatus"], "count_distinct", "l_suppkey", out="y")


@query("groupby_date_avg", "select event_type, sum(ts::date - date '1970-01-01')::bigint as days, round(avg(ts::date - date '1970-01-01'), 6) as y from events group by all", "events")
def _group_dates(df):
    d = df.withColumn("d", S.cast(df, "ts", "date32"))
    both = R.join(R.group_by(d, ["event_type"], "sum", "d", out="days"), R.group_by(d, ["event_type"], "avg", "d", out="y"), ["event_type"])
    return both.select("event_type", "days", F.round("y", 6).alias("y"))


@query("groupby_approx_percentile", "select l_linenumber, min(l_quantity) filter (where r >= n * 0.5) as y from (select l_linenumber, l_quantity, row_number() over w as r, count(*) over (partition by l_linenumber) as n from lineitem window w as (partition by l_linenumber order by l_quantity)) group by 1", "lineitem")
def _group_percentile(df):
    return R.group_by(df, ["l_linenumber"], "approx_percentile", "l_quantity", out="y")


@query("groupby_int_avg_trunc", "select l_suppkey, trunc(avg(l_linenumber))::integer as y from lineitem group by all", "lineitem")
def _group_trunc(df):
    return R.group_by(df, ["l_suppkey"], "avg", "l_linenumber", result_type="input", out="y")


@query("count_distinct_keys", "select count(*) as n from (select distinct l_suppkey, l_returnflag from lineitem)", "lineitem")
def _distinct(df):
    return R.count_distinct_keys(df, ["l_suppkey", "l_returnflag"])


# ---- running sums and windows

for _name, _end in {"inclusive": "current row", "exclusive": "1 preceding"}.items():

    def _prefix(df, name=_name):
        return O.prefix_sum(df.select("o_orderkey", "o_custkey"), "o_custkey", ["o_orderkey"], name == "inclusive")

    query(f"prefix_sum_{_name}", f"select o_orderkey, o_custkey, coalesce(sum(o_custkey) over (order by o_orderkey rows between unbounded preceding and {_end}), 0)::bigint as prefix from orders", "orders")(_prefix)

for _op in O._WINDOW:

    def _window(df, op=_op):
        d = O.window_aggregate(df.select("event_id", "user_id", "ts", "value"), op, "value", ["user_id"], ["ts", "event_id"], "rows", -3, 0, out="y")
        return d.select("event_id", (F.round("y", 6) if op != "count" else F.col("y")).alias("y"))

    _f = {"stddev": "stddev_samp", "var": "var_samp"}.get(_op, _op)
    _y = f"{_f}(value) over (partition by user_id order by ts, event_id rows between 3 preceding and current row)"
    query(f"window_rows_{_op}", f"select event_id, {_y if _op == 'count' else f'round({_y}, 6)'} as y from events", "events")(_window)


@query("window_descending", "select event_id, round(sum(value) over (partition by user_id order by ts desc, event_id desc rows between 2 preceding and current row), 6) as y from events", "events")
def _descending(df):
    d = O.window_aggregate(df.select("event_id", "user_id", "ts", "value"), "sum", "value", ["user_id"], ["ts", "event_id"], "rows", -2, 0, descending=True, out="y")
    return d.select("event_id", F.round("y", 6).alias("y"))


@query("prefix_sum_text_key", "select c_name, (sum(c_nationkey) over (order by c_name, c_custkey))::bigint as prefix from customer", "customer")
def _prefix_text(df):
    return O.prefix_sum(df.select("c_name", "c_custkey", "c_nationkey"), "c_nationkey", ["c_name", "c_custkey"]).select("c_name", "prefix")


@query("window_range_sum", "select event_id, (sum(user_id) over (partition by event_type order by event_id range between 500 preceding and current row))::bigint as y from events", "events")
def _range(df):
    return O.window_aggregate(df, "sum", "user_id", ["event_type"], ["event_id"], "range", -500, 0, out="y").select("event_id", "y")


# ---- sorts and order statistics: order becomes data by numbering


@query("order_by_multi", "select o_orderkey, o_orderpriority, o_custkey from orders order by o_orderpriority, o_custkey, o_orderkey", "orders")
def _order(df):
    return O.order_by(df.select("o_orderkey", "o_orderpriority", "o_custkey"), ["o_orderpriority", "o_custkey", "o_orderkey"])


@query("order_by_permutation", "select o_orderkey from orders order by o_custkey, o_orderkey", "orders")
def _permutation(df):
    return O.order_by(df, ["o_custkey", "o_orderkey"], permutation="o_orderkey")


@query("radix_sort_desc", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey", "orders")
def _radix(df):
    return O.radix_sort(df.select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", descending=True)


@query("radix_sort_bits", "select o_orderkey, o_custkey from orders order by (o_custkey >> 2) & 63, o_orderkey", "orders")
def _radix_bits(df):
    return O.radix_sort(df.select("o_orderkey", "o_custkey"), "o_custkey", "o_orderkey", bits=(2, 8))


@query("segmented_sort", "select event_id, value, (event_id // 1000 * 1000 + row_number() over (partition by event_id // 1000 order by value, event_id) - 1)::bigint as new_position from events", "events")
def _segmented(df):
    d = df.select("event_id", "value")
    end = d.agg(F.max("event_id")).first()[0] or 0
    return O.segmented_sort(d, "value", "event_id", [(a, a + 1000) for a in range(0, end + 1, 1000)])


_QUANTILE = "with s as (select l_extendedprice as x, row_number() over (order by l_extendedprice) - 1 as r, count(*) over () as n from lineitem), p as (select max(n) as n, floor(0.33::double * max(n))::bigint as k, 0.33::double * max(n) - floor(0.33::double * max(n)) as f from s), y as (select f, (select x from s where r = greatest(k - 1, 0)) as y0, (select x from s where r = greatest(k - 1, 0) + 1) as y1 from p) select {} as quantile from y"
for _m, _e in {"linear": "y0 + f * (y1 - y0)", "lower": "y0", "higher": "y1", "midpoint": "(y0 + y1) / 2", "nearest": "case when f < 0.5 then y0 else y1 end"}.items():

    def _quantile(df, m=_m):
        return O.quantile(df, "l_extendedprice", 0.33, m)

    query(f"quantile_{_m}", _QUANTILE.format(_e), "lineitem")(_quantile)


@query("quantile_order_stat", _QUANTILE.format("y0"), "lineitem")
def _order_stat(df):
    return O.order_statistic(df, "l_extendedprice", 0.33)


# ---- concatenation, hashing, sparse rows, CSV


@query("concat_columns", "select c_acctbal as x, 0 as source from customer union all select s_acctbal, 1 from supplier", "customer", "supplier")
def _concat(c, s):
    return R.concat([c.select(F.col("c_acctbal").alias("x")), s.select(F.col("s_acctbal").alias("x"))], source="source")


def _murmur_sql(x: str, n: int) -> str:
    """DuckDB steps that hash the bigint x (as ubigint) at seed 0 into m{n}."""
    u, steps, h = "4294967295::ubigint", [], "0::ubigint"
    mul = lambda a, c: f"((((({a}) >> 16) * {c}::ubigint & 65535::ubigint) << 16) + (({a}) & 65535::ubigint) * {c}::ubigint) & {u}"
    for i, part in enumerate((f"(({x}) & {u})", f"(({x}) >> 32)")):
        k = f"k{n}{i}"
        steps += [f"{mul(part, 3432918353)} as {k}a", f"{mul(f'((({k}a << 15) | ({k}a >> 17)) & {u})', 461845907)} as {k}b", f"xor({h}, {k}b) as {k}c", f"((((({k}c << 13) | ({k}c >> 19)) & {u}) * 5 + 3864292196) & {u}) as {k}d"]
        h = f"{k}d"
    f = f"f{n}"
    steps += [f"xor({h}, 8::ubigint) as {f}a", f"xor({f}a, {f}a >> 16) as {f}b", f"{mul(f'{f}b', 2246822507)} as {f}c", f"xor({f}c, {f}c >> 13) as {f}d", f"{mul(f'{f}d', 3266489909)} as {f}e", f"xor({f}e, {f}e >> 16) as m{n}"]
    return ", ".join(steps)


_ROW_HASH = f"(select o_orderkey, o_custkey, {_murmur_sql('o_orderkey::ubigint', 1)}, {_murmur_sql('o_custkey::ubigint', 2)}, xor(m1, (m2 + 2654435769::ubigint + ((m1 << 6) & 4294967295::ubigint) + (m1 >> 2)) & 4294967295::ubigint) as h from orders)"


@query("hash_rows", f"select o_orderkey, (xor(h, 2147483648::ubigint)::bigint - 2147483648)::integer as hash from {_ROW_HASH}", "orders")
def _hash_rows(df):
    return H.row_hash(df.select("o_orderkey", "o_custkey"), ["o_orderkey", "o_custkey"]).select("o_orderkey", "hash")


@query("hash_identity", "select o_orderkey, o_orderkey::integer as hash from orders", "orders")
def _hash_identity(df):
    return H.row_hash(df.select("o_orderkey"), ["o_orderkey"], "identity")


_FNV_BYTES = "[" + ", ".join(f"(({c} >> {8 * k}) & 255)::hugeint" for c in ("o_orderkey::bigint", "o_custkey::bigint") for k in range(8)) + "]"
_FNV = f"list_reduce(list_prepend(14695981039346656037::hugeint, list_transform({_FNV_BYTES}, lambda b: case when b > 127 then b + {(1 << 64) - 256}::hugeint else b end)), lambda h, b: (xor(h, b) * 1099511628211::hugeint) % {1 << 64}::hugeint)"


@query("hash_fnv", f"select o_orderkey, (case when h >= 9223372036854775808 then h - {1 << 64}::hugeint else h end)::bigint as hash from (select o_orderkey, {_FNV} as h from orders)", "orders")
def _hash_fnv(df):
    d = df.select(F.col("o_orderkey"), F.col("o_orderkey").cast("long").alias("a"), F.col("o_custkey").cast("long").alias("b"))
    return d.select("o_orderkey", H.fnv_hash(d, ["a", "b"]))


@query("hash_columns", f"select o_custkey, o_orderkey, (case when h >= 9223372036854775808 then h - {1 << 64}::hugeint else h end)::bigint as hash from (select o_custkey, o_orderkey, {_FNV} as h from orders)", "orders")
def _hash_columns(df):
    d = df.select("o_custkey", "o_orderkey", F.col("o_orderkey").cast("long").alias("a"), F.col("o_custkey").cast("long").alias("b"))
    return d.select("o_custkey", "o_orderkey", H.fnv_hash(d, ["a", "b"]))


@query("hash_partition_ids", f"select o_orderkey, (h % 10)::integer as part from {_ROW_HASH}", "orders")
def _partition_ids(df):
    return H.hash_partition(df.select("o_orderkey", "o_custkey"), ["o_orderkey", "o_custkey"], 10).select("o_orderkey", "part")


@query("hash_partition_offsets", f"with c as (select (h % 10)::integer as part, count(*) as n from {_ROW_HASH} group by 1), e as (select range::integer as part from range(10)) select part, coalesce(n, 0) as rows, coalesce(sum(n) over (order by part rows between unbounded preceding and 1 preceding), 0)::bigint as start from e left join c using (part)", "orders")
def _partition_offsets(df):
    return H.partition_offsets(df, ["o_orderkey", "o_custkey"], 10)


_CSR = "(select p_partkey, nullif(p_size, 7) as a, nullif(p_retailprice, 0) as b, nullif(p_size % 5, 0) as c from part)"


def _csr_part(df):
    return df.select("p_partkey", F.nullif("p_size", F.lit(7)).alias("a"), F.nullif("p_retailprice", F.lit(0.0)).alias("b"), F.nullif(F.col("p_size") % 5, F.lit(0)).alias("c"))


@query("to_csr", f"select p_partkey as row, 0 as col, a::double as value from {_CSR} where a is not null union all select p_partkey, 1, b from {_CSR} where b is not null union all select p_partkey, 2, c from {_CSR} where c is not null", "part")
def _to_csr(df):
    return files.to_csr(_csr_part(df), "p_partkey", ["a", "b", "c"])


@query("csr_row_offsets", f"with n as (select p_partkey as row, ((a is not null)::int + (b is not null)::int + (c is not null)::int)::bigint as cells from {_CSR}) select row, cells, coalesce(sum(cells) over (order by row rows between unbounded preceding and 1 preceding), 0)::bigint as start from n", "part")
def _csr_offsets(df):
    return files.csr_row_offsets(_csr_part(df), "p_partkey", ["a", "b", "c"])


def _shared_folder(spark) -> str:
    """A new path under the folder that the driver and all executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="colonnade-")  # one machine: nothing else to share with
    return f"{root.rstrip('/')}/csv-{uuid.uuid4().hex}"


def _csv_round_trip(spark, sf_dir):
    """Writes supplier as text under the shared checkpoint folder and reads it back."""
    path = _shared_folder(spark)
    files.write_csv(table(spark, sf_dir, "supplier"), path)
    return files.read_csv(spark, path, ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"], ["int64", "str", "int32", "float64"])


QUERIES["csv_round_trip"] = _csv_round_trip
ORACLES["csv_round_trip"] = "select s_suppkey, s_name, s_nationkey, s_acctbal from supplier"


def _csv_dates(spark, sf_dir):
    """Writes days and clock times of events as one text file and reads all but two lines at either end."""
    path = _shared_folder(spark)
    events = O.sorted_ranges(table(spark, sf_dir, "events").select("event_id", "ts"), ["event_id"])
    files.write_csv_file(events.select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("d"), F.date_format("ts", "MM/dd/yyyy HH:mm:ss").alias("t")), path, "|")
    return files.read_csv(spark, path, ["event_id", "d", "t"], ["int64", "date32", "date64"], delimiter="|", skiprows=2, skipfooter=2)


QUERIES["csv_dates_skip"] = _csv_dates
ORACLES["csv_dates_skip"] = "select event_id::bigint as event_id, ts::date as d, date_trunc('second', ts)::timestamp as t from (select *, row_number() over (order by event_id) as r, count(*) over () as n from events) where r > 2 and r <= n - 2"


@query("arrow_round_trip", "select n_nationkey, n_name, n_regionkey from nation", "nation")
def _arrow(df):
    schema, batches = files.to_arrow_parts(df.select("n_nationkey", "n_name", "n_regionkey"))
    return files.from_arrow_parts(df.sparkSession, schema, batches)
