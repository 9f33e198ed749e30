"""Every query with SQL gives the rows that DuckDB gives on the driver's smallest tables."""

from __future__ import annotations

import os

import pytest

from marketlens.plans.library import ORACLES, QUERIES
from tests.oracle import connection, oracle_rows, rows_of

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="driver tables are not here")


@pytest.fixture(scope="module")
def con():
    return connection(SMALL)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, con, name):
    assert rows_of(spark, QUERIES[name], SMALL) == oracle_rows(con, ORACLES[name])


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries())


def test_latest_is_limited_before_the_shuffle(spark):
    plan = QUERIES["latest_observation"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string>" in plan


def test_filter_reaches_the_scan(spark):
    plan = QUERIES["price_band_rollup"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(l_returnflag,R)" in plan


def test_large_groups_are_neither_paired_nor_collected(spark, tmp_path):
    """3000 suppliers of one nation and 3000 parts of one brand; the joins and aggregates give few rows for each."""
    spark.range(3000).selectExpr("id as s_suppkey", "1L as s_nationkey", "cast(id * 37 % 1000 as double) as s_acctbal").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(3000).selectExpr("id * 7 as l_suppkey", "0.1D as l_discount", "50D as l_quantity").where("l_suppkey % 2 = 0").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(3000).selectExpr("id as p_partkey", "'b' as p_brand", "cast(id % 50 as int) as p_size", "if(id = 1046, 'SMALL', 'LARGE') as p_type", "1D as p_retailprice").write.parquet(f"{tmp_path}/part.parquet")
    small = connection(str(tmp_path))
    for name in ("ranked_spec_affinity", "staged_narrowing"):
        df = QUERIES[name](spark, str(tmp_path))
        assert rows_of(spark, QUERIES[name], str(tmp_path)) == oracle_rows(small, ORACLES[name])
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "collect_list" not in plan and ("WindowGroupLimit" in df._jdf.queryExecution().executedPlan().toString() or name != "ranked_spec_affinity")
