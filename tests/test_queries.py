"""Queries against their SQL in DuckDB on the smallest given tables, where those are present."""

import glob
import os

import duckdb
import pytest

from mercadia import queries as core

DIR = "/root/testdata/sf0.001"
NAMES = sorted(core.oracle_sql())
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no given tables")


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    cur = con.execute(core.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    expected = sorted(repr([dict(zip(names, r))[n] for n in sorted(names)]) for r in cur.fetchall())
    df = core.queries()[name](spark, DIR)
    assert sorted(df.columns) == sorted(names)
    assert sorted(repr(list(r)) for r in df.select(*sorted(names)).collect()) == expected


def test_every_query_but_the_learned_ones_has_sql():
    assert set(core.queries()) - set(core.oracle_sql()) == {"regressor_forecast", "poisson_forecast", "hurdle_forecast", "experiment_metrics", "all_future_forecasts"}


def test_entry_registers_all():
    import __spark_entry__ as e

    assert set(core.queries()) <= set(e.queries())


def test_no_row_a_product_or_order_is_broadcast(spark, capsys):
    from mercadia import queries_demand as q
    from mercadia.operators import demand
    from mercadia.sources import canonical as c

    sold = q.written_series(spark, DIR)
    grid = demand.dense_grid(sold.selectExpr("*", "0D AS revenue"), c.products(spark, DIR).select("product_id", "category"))
    for df in (q.series(spark, DIR), q.official(spark, DIR, sold), q.official_risk(spark, DIR, sold), grid):
        capsys.readouterr()
        df.explain()
        plan = capsys.readouterr().out
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
