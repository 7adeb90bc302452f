"""The backtest by product rows against the backtest by day, on a small fixture."""

from datetime import date, timedelta

import numpy as np
from pyspark.sql import functions as F

from mercadia.operators import backtest, demand, gates, metrics
from mercadia.plans import forecast

START = date(2024, 1, 1)


def _sales(spark):
    rng = np.random.default_rng(3)
    rows = [(p, START + timedelta(days=int(t)), float(rng.integers(1, 9))) for p in range(1, 7) for t in sorted(rng.choice(200, 10 * p, replace=False))]
    rows += [(7, START + timedelta(days=199), 5.0), (8, START, 2.0), (8, START + timedelta(days=7), 2.0)]
    return spark.createDataFrame(rows, "product_id long, date date, quantity_sold double"), spark.range(1, 10).withColumnRenamed("id", "product_id")


def test_error_sums_by_product_are_those_of_the_days(spark):
    sales, products = _sales(spark)  # product 9 never sells
    folds = demand.folds(sales)
    sums = backtest.product_errors(sales, products, folds, forecast.HORIZONS)
    found = metrics.cube_of_sums(sums)
    expected = metrics.with_mase(metrics.metric_cube(forecast.compare(sales, products, folds), forecast.horizon_table(spark)), forecast.seasonal_steps(sales, products, folds))
    rows = lambda df: {(r.level, r.split, r.model_name, r.horizon, r.demand_pattern, r.product_id): r for r in df.collect()}
    mine, theirs = rows(found), rows(expected)
    assert set(mine) == set(theirs) and {k[0] for k in mine} == {"aggregate", "segment", "product"}
    for k, r in mine.items():
        assert r.product_count == theirs[k].product_count
        for n in ("wape", "mae", "rmse", "smape", "bias", "mase", "actual_quantity_sum", "predicted_quantity_sum"):
            a, b = r[n], theirs[k][n]
            assert (a is None) == (b is None) and (a is None or abs(a - b) < 1e-9), (k, n, a, b)
    assert {r.model_name: r.passed for r in forecast.forecast_quality(sums).collect()} == dict.fromkeys(demand.MODELS, True)
    twice = forecast.forecast_quality(sums.unionByName(sums.where("model_name = 'tsb' AND product_id = 1"))).collect()
    assert [r.model_name for r in twice if not r.passed] == ["tsb"]


def test_levels_shuffle_no_row_a_day(spark, capsys):
    sales, products = _sales(spark)
    metrics.cube_of_sums(backtest.product_errors(sales, products, demand.folds(sales), forecast.HORIZONS)).where(F.col("level") == "aggregate").explain()
    plan = capsys.readouterr().out
    assert "horizon_day" not in plan and "product" not in "".join(x for x in plan.split("\n") if "Exchange" in x and "model_name" in x)


def test_grid_shuffles_no_cell_and_its_checks_keep_none(spark, capsys):
    rows = [(1, START, 2.0, 4.0), (1, START + timedelta(days=3), 1.0, 2.0), (2, START + timedelta(days=150), 5.0, 5.0), (9, START, 7.0, 7.0)]
    sales = spark.createDataFrame(rows, "product_id long, date date, quantity_sold double, revenue double")
    products = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "product_id long, category string")
    grid = demand.dense_grid(sales, products)
    found = {(r.product_id, r.date, r.category): (r.quantity_sold, r.revenue) for r in grid.collect()}
    assert len(found) == grid.count() == 3 * 151 and {k[0] for k in found} == {1, 2, 3}
    assert {k: v for k, v in found.items() if v != (0.0, 0.0)} == {(p, d, products.where(F.col("product_id") == p).first().category): (q, r) for p, d, q, r in rows if p != 9}
    demand.dense_grid(sales, products).explain()
    plan = capsys.readouterr().out
    assert plan.index("explode(sequence") < plan.index("Exchange") and plan.count("explode(sequence") == 1
    lost = grid.where("NOT (product_id = 2 AND day(date) = 3)").unionByName(grid.where("product_id = 1 AND date_diff(date, first_day) IN (5, 70)")).unionByName(grid.where("product_id = 1 AND date_diff(date, first_day) = 5"))
    checks = gates.grid_checks(lost, products.unionByName(spark.createDataFrame([(4, "d")], "product_id long, category string")))
    assert {r.rule: r.violations for r in checks.collect()} == {"lost_category": 0, "negative": 0, "unknown_product": 0, "repeated_cell": 2, "incomplete_days": 1, "absent_product": 1}


def test_missing_forecasts_broadcast_no_forecast(spark, capsys):
    actual = spark.range(10).selectExpr("id AS product_id", "1 AS horizon_day")
    predicted = spark.range(5).select(F.col("id").alias("product_id"), F.explode(F.sequence(F.lit(1), F.lit(30))).alias("horizon_day"), F.lit(1.0).alias("predicted_quantity"))
    found = forecast.missing_forecasts(actual, predicted, ("product_id", "horizon_day"))
    found.explain()
    assert "SortMergeJoin" in (plan := capsys.readouterr().out) and "BroadcastExchange" not in plan
    assert sorted(r.product_id for r in found.collect()) == [5, 6, 7, 8, 9]


def test_cells_that_are_there_twice_or_more_often(spark, capsys):
    day = lambda k: None if k is None else START + timedelta(days=k)
    products = spark.createDataFrame([(k, "a") for k in range(8)], "product_id long, category string")
    kind = "product_id long, date date, quantity_sold double, category string"
    # once, twice, thrice, four times, twice beside thrice, without a date
    times = {0: {0: 1, 1: 1}, 1: {0: 2, 61: 2, 130: 1}, 2: {3: 3}, 3: {4: 4, 5: 1}, 4: {6: 2, 7: 3, 200: 2}, 5: {None: 2, 8: 1}, 6: {None: 1, 9: 2}}
    cells = lambda of: spark.createDataFrame([(p, day(k), 1.0, "a") for p in of for k, n in times[p].items() for _ in range(n)], kind)
    repeated = lambda df: {r.rule: r.violations for r in df.collect()}["repeated_cell"]
    assert repeated(gates.grid_checks(cells(times), products)) == sum(n > 1 for x in times.values() for n in x.values()) == 9
    found = gates.grid_checks(cells([0, 1]), products)
    assert repeated(found) == 2
    capsys.readouterr()
    found.explain()
    # cells that are there twice are known from the sums: nothing is looked at again
    assert "quantity_sold" not in (plan := capsys.readouterr().out) and "LeftSemi" not in plan and "BroadcastHashJoin" not in plan
