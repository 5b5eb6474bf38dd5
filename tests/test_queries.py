"""Registered queries against their DuckDB forms, at sf0.001."""

import duckdb
import pytest

import __spark_entry__
from colonnade.plans import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def views():
    for t in TABLES:
        duckdb.sql(f"create or replace view {t} as from '{DIR}/{t}.parquet'")


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query(spark, views, name):
    got = catalog.QUERIES[name](spark, DIR).toPandas()
    want = duckdb.sql(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    plain = lambda df: sorted(tuple("" if str(v) in ("nan", "None", "<NA>", "NaT") else str(v).removesuffix(" 00:00:00") if not isinstance(v, (int, float)) else f"{float(v):.9g}" for v in r) for r in df[columns].astype(object).itertuples(index=False))
    assert plain(got) == plain(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
