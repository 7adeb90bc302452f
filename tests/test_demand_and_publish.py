"""Golden values and brute-force loops for the demand operators, risk classes and publication."""

import math
import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from mercadia.operators import demand, inventory, learned, metrics, publish
from mercadia.plans import forecast

START = date(2026, 1, 1)


def series(spark, values, split="all"):
    """values: product -> list of daily demand."""
    n = len(next(iter(values.values())))
    last = START + timedelta(days=n - 1)
    rows = [(split, p, START + timedelta(days=i), float(q), START, last) for p, v in values.items() for i, q in enumerate(v) if q > 0]
    schema = "split string, product_id long, date date, quantity_sold double, first_day date, last_day date"
    ends = spark.createDataFrame([(split, p, START, last) for p in values], "split string, product_id long, first_day date, last_day date")
    return spark.createDataFrame(rows, schema), ends


def test_segments(spark):
    sold, ends = series(spark, {1: [0, 2, 0, 4, 0, 0], 2: [0] * 6, 3: [0, 5, 0, 0, 0, 0], 4: [3] * 6})
    found = {r.product_id: r for r in demand.segment(sold, ends).collect()}
    assert (found[1].non_zero_demand_days, found[1].adi, found[1].demand_pattern) == (2, 3.0, "intermittent") and found[1].cv_squared == pytest.approx(1 / 9)
    assert (found[2].adi, found[2].cv_squared, found[2].demand_pattern) == (math.inf, 0.0, "intermittent")
    assert (found[3].adi, found[3].cv_squared, found[4].demand_pattern) == (6.0, 0.0, "smooth")


def loops(y, horizon, a=0.1, b=0.1):
    """Day-by-day definitions."""
    size = gap = None
    chance, since = 0.0, 0
    for q in y:
        since += 1
        if q > 0:
            size, gap = (q, since) if size is None else (size + a * (q - size), gap + a * (since - gap))
            since = 0
    first = next((i for i, q in enumerate(y) if q > 0), None)
    if first is not None:
        chance = 1 / (first + 1)
        for q in y[first + 1 :]:
            chance += b * ((q > 0) - chance)
    level = size / gap if size else 0.0
    out = {"last_observation": [y[-1]] * horizon, "croston": [level] * horizon, "croston_sba": [level * 0.95] * horizon, "tsb": [chance * size if size else 0.0] * horizon}
    h7, h28 = list(y), list(y)
    for _ in range(horizon):
        h7.append(h7[-7] if len(h7) >= 7 else 0)
        h28.append(sum(h28[-28:]) / len(h28[-28:]))
    return out | {"seasonal_lag_7": h7[len(y) :], "moving_average_28": h28[len(y) :]}


@pytest.mark.parametrize("days", [9, 70])
def test_closed_forms_equal_loops(spark, days):
    r = random.Random(days)
    values = {p: [r.choice((0, 0, 0, 1, 2, 5)) for _ in range(days)] for p in range(5)} | {9: [0] * days}
    sold, ends = series(spark, values)
    found = {}
    for x in demand.forecasts(sold.select("split", "product_id", "date", "quantity_sold"), ends, 30, history=days).collect():
        found[x.product_id, x.model_name, x.horizon_day] = x.predicted_quantity
    assert len(found) == 6 * 6 * 30
    for p, y in values.items():
        for m, v in loops(y, 30).items():
            assert [found[p, m, h] for h in range(1, 31)] == pytest.approx(v, abs=1e-9), (p, m)


def test_croston_golden(spark):
    sold, ends = series(spark, {1: [0, 0, 2, 0, 0]})
    found = {x.model_name: x.predicted_quantity for x in demand.forecasts(sold.select("split", "product_id", "date", "quantity_sold"), ends, 1, history=5).collect()}
    assert found["croston"] == pytest.approx(2 / 3) and found["croston_sba"] == pytest.approx(2 / 3 * 0.95)


def features(spark, y):
    sold = spark.createDataFrame([(1, START + timedelta(days=i), float(q), float(q)) for i, q in enumerate(y) if q > 0], "product_id long, date date, quantity_sold double, revenue double")
    grid = demand.dense_grid(sold, spark.createDataFrame([(1, "c", "b")], "product_id long, category string, brand string"), START, START + timedelta(days=len(y) - 1))
    return grid, demand.add_features(grid)


def test_features_see_only_the_past(spark):
    r = random.Random(1)
    y = [r.choice((0, 0, 1, 3)) for _ in range(50)]
    names = [n for n in learned.NUMERIC]
    before = features(spark, y)[1].orderBy("date").collect()
    changed = y[:40] + [99] + y[41:]
    after = features(spark, changed)[1].orderBy("date").collect()
    assert len(before) == 50
    assert all(before[i][n] == after[i][n] for i in range(41) for n in names)
    assert any(before[41][n] != after[41][n] for n in names)
    third = features(spark, [2, 0, 0, 0])[1].orderBy("date").collect()[2]
    assert (third.days_since_last_sale, third.current_zero_streak, third.historical_sale_probability, third.mean_positive_demand, third.causal_adi) == (2, 1, 0.5, 2, 2)


def test_metrics_golden(spark):
    df = spark.createDataFrame([(0.0, 0.0), (2.0, 1.0), (0.0, 1.0), (2.0, 2.0)], "a double, p double")
    m = df.agg(*(c.alias(n) for n, c in metrics.forecast_metrics(F.col("a"), F.col("p")).items())).first()
    assert (m.wape, m.mae, m.bias) == (0.5, 0.5, 0.0)
    assert m.rmse == pytest.approx(math.sqrt(2) / 2) and m.smape == pytest.approx((2 / 3 + 2) / 4)
    none = df.where("a = 0").agg(metrics.forecast_metrics(F.col("a"), F.col("p"))["wape"].alias("w")).first()
    assert none.w is None


def test_occurrence_golden(spark):
    scored = spark.createDataFrame([(0, 0.1), (0, 0.2), (1, 0.8), (1, 0.4)], "actual int, score double").withColumn("g", F.lit(1))
    m = metrics.occurrence_metrics(scored, ["g"], F.lit(0.5)).first()
    assert (m.precision, m.recall) == (1.0, 0.5) and m.f1 == pytest.approx(2 / 3)
    assert metrics.average_precision(scored, ["g"]).first().pr_auc == 1.0
    t = spark.createDataFrame([(0, 0.05), (0, 0.15), (1, 0.25), (1, 0.9)], "actual int, score double")
    best = metrics.best_threshold(t, [0.1, 0.2, 0.3, 0.5]).first()
    assert (best.threshold, best.f1) == (0.2, 1.0)


def test_seasonal_scale_equals_a_loop(spark):
    r = random.Random(2)
    values = {p: [r.choice((0, 0, 1, 4)) for _ in range(40)] for p in range(4)}
    sold, _ = series(spark, values)
    ends = spark.createDataFrame([("all", 4, START, START + timedelta(days=39))], "split string, products long, first_day date, last_day date")
    expected = [abs(v[i] - v[i - 7]) for v in values.values() for i in range(7, 40)]
    assert metrics.seasonal_scale(sold, ends, ["split"]).first().scale == pytest.approx(sum(expected) / len(expected))


def test_risk_classes(spark):
    cases = {1: (0, 5, 10, "critical"), 2: (14, 5, 10, "high_risk"), 3: (20, 5, 12, "attention"), 4: (30, 5, 12, "adequate"), 5: (100, 5, 10, "potential_overstock"), 6: (50, 5, 0, "potential_overstock")}
    products = spark.createDataFrame([(p, s, m, True) for p, (s, m, _, _) in cases.items()] + [(7, 9, 9, False)], "product_id long, stock_quantity long, minimum_stock long, is_active boolean")
    rows = [(p, h, d / 14) for p, (_, _, d, _) in cases.items() for h in range(1, 31)] + [(7, h, 1.0) for h in range(1, 31)]
    found = {r.product_id: r for r in inventory.classify_risk(spark.createDataFrame(rows, "product_id long, horizon_day int, predicted_quantity double"), products).collect()}
    assert {p: r.risk_class for p, r in found.items()} == {p: c[3] for p, c in cases.items()}
    assert found[6].coverage_days == math.inf
    short = inventory.classify_risk(spark.createDataFrame([(1, 1, 1.0)], "product_id long, horizon_day int, predicted_quantity double"), products).first()
    assert not short.complete and short.risk_class is None


def promotion_row(spark, challenger_final=0.8, bias=0.1, segments=((0.8, 1.0), (1.0, 1.0))):
    rows = [(f"validation_fold_{i}", m, 14, w, 0.0) for i in (1, 2, 3) for m, w in (("x", 0.9), ("moving_average_28", 1.0))]
    rows += [("final_test", "x", 14, challenger_final, bias), ("final_test", "moving_average_28", 14, 1.0, 0.0)]
    agg = spark.createDataFrame(rows, "split string, model_name string, horizon int, wape double, bias double")
    seg = spark.createDataFrame([("final_test", m, 14, f"s{i}", w) for i, s in enumerate(segments) for m, w in zip(("x", "moving_average_28"), s)], "split string, model_name string, horizon int, demand_pattern string, wape double")
    good = spark.createDataFrame([("x", True)], "model_name string, passed boolean")
    return forecast.promotion(agg, seg, good, forecast.challenger(agg)).first()


def test_promotion_gate(spark):
    assert promotion_row(spark).decision == "promoted" and promotion_row(spark).final_champion == "x"
    assert promotion_row(spark, bias=-0.5).decision == "rejected"
    assert promotion_row(spark, challenger_final=1.2).final_champion == "moving_average_28"
    assert promotion_row(spark, challenger_final=None).decision == "inconclusive"


def test_upsert_keeps_history_and_first_registration(spark, tmp_path):
    schema = "model_name string, model_version string, status string, registered_at date"
    first = spark.createDataFrame([("a", "1", "x", date(2026, 1, 1)), ("b", "1", "x", date(2026, 1, 1))], schema)
    second = spark.createDataFrame([("a", "1", "y", date(2026, 2, 2)), ("c", "1", "y", date(2026, 2, 2))], schema)
    root = str(tmp_path)
    publish.upsert(spark, first, root, "model_registry", ["registered_at"])
    for _ in range(2):  # twice the same changes nothing
        assert publish.upsert(spark, second, root, "model_registry", ["registered_at"]) == 3
    found = {r.model_name: (r.status, r.registered_at.month) for r in publish.read_history(spark, root, "model_registry").collect()}
    assert found == {"a": ("y", 1), "b": ("x", 1), "c": ("y", 2)}
    for bad in (first.limit(0), first.union(first)):
        with pytest.raises(ValueError):
            publish.upsert(spark, bad, root, "model_registry")


def test_publication_records_its_end(spark, tmp_path):
    run = {"run_id": publish.run_id("m", "1", "2026-01-01", "2026-01-01T00:00:00"), "started_at": datetime(2026, 1, 1), "champion_model": "m", "champion_version": "1", "forecast_rows": 1, "risk_rows": 1}
    assert run["run_id"] == publish.run_id("m", " 1", "2026-01-01", "2026-01-01T01:00:00+01:00") != publish.run_id("m", "1", "2026-01-01", "2026-01-01T01:00:00")
    table = spark.createDataFrame([("r", 1, 14)], "run_id string, product_id long, horizon_days int")

    def fails():
        raise RuntimeError("wrong")

    with pytest.raises(RuntimeError, match="wrong"):
        publish.publish(spark, str(tmp_path), run, {"inventory_risk": table}, fails)
    row = publish.read_history(spark, str(tmp_path), "pipeline_runs").first()
    assert (row.status, row.error_message) == ("failed", "wrong")
    publish.publish(spark, str(tmp_path), run, {"inventory_risk": table}, lambda: None)
    rows = publish.read_history(spark, str(tmp_path), "pipeline_runs").collect()
    assert len(rows) == 1 and rows[0].status == "success" and rows[0].finished_at is not None and rows[0].duration_seconds > 0 and rows[0].error_message is None
    with pytest.raises(ValueError, match="negative counts: risk_rows"):
        publish.publish(spark, str(tmp_path), run | {"risk_rows": -1}, {}, lambda: None)
    with pytest.raises(ValueError, match="an id"):
        publish.publish(spark, str(tmp_path), run | {"run_id": " "}, {}, lambda: None)


def test_times_and_ends_of_runs():
    assert publish.utc_timestamp("2026-03-01T02:00:00+02:00") == publish.utc_timestamp(datetime(2026, 3, 1)) == publish.utc_timestamp(" 2026-03-01 ")
    assert publish.utc_timestamp().tzinfo is not None
    for bad in ("", "  "):
        with pytest.raises(ValueError, match="blank"):
            publish.utc_timestamp(bad)
    with pytest.raises(ValueError, match="blank"):
        publish.run_id("m", " ", "2026-01-01", "2026-01-01")
    run = {"run_id": "r", "started_at": "2026-03-01T00:00:00"}
    assert publish.finished(run, "failed", "e", "2026-03-01T00:01:30")["duration_seconds"] == 90.0
    assert publish.finished(run, "success", "e", "2026-03-01T00:01:30")["error_message"] is None
    for status, at in (("running", "2026-03-02"), ("success", "2026-02-01")):
        with pytest.raises(ValueError):
            publish.finished(run, status, at=at)


def test_history_is_written_by_run(spark, tmp_path):
    """A batch reads and writes its own runs only; one run is read from its own folder."""
    root = str(tmp_path)
    risk = lambda *rows: spark.createDataFrame(rows, "run_id string, product_id long, horizon_days int, forecast_demand double")
    assert publish.upsert(spark, risk(("r1", 1, 14, 1.0), ("r2", 1, 14, 2.0)), root, "inventory_risk") == 2
    before = {p.name for p in (tmp_path / "inventory_risk").glob("v-*")}
    assert publish.upsert(spark, risk(("r2", 1, 14, 3.0), ("r2", 2, 14, 4.0)), root, "inventory_risk") == 3
    assert len({p.name for p in (tmp_path / "inventory_risk").glob("v-*")} - before) == 1
    assert {(r.product_id, r.forecast_demand) for r in publish.read_history(spark, root, "inventory_risk", "r2").collect()} == {(1, 3.0), (2, 4.0)}
    assert len(publish.read_history(spark, root, "inventory_risk", "r1").inputFiles()) < len(publish.read_history(spark, root, "inventory_risk").inputFiles())
    for run, match in (("r9", "run r9"), (None, "null run")):
        with pytest.raises(ValueError, match=match):
            publish.read_history(spark, root, "inventory_risk", run) if run else publish.upsert(spark, risk((None, 1, 14, 1.0)), root, "inventory_risk")
    row = publish.run_audit(spark, root, "r2").first()
    assert (row.missing_tables, row.inventory_risk_rows, row.consistent) == (4, 2, False)


def test_forecasts_of_all_models_keep_components_and_active_products(spark):
    plain = spark.sql("SELECT * FROM VALUES (1, 1, 2.0D), (2, 1, 3.0D), (3, 1, 4.0D) AS v(product_id, horizon_day, predicted_quantity)")
    parts = plain.withColumns({"sale_probability": F.lit(0.5), "conditional_quantity": F.lit(4.0)})
    active = spark.sql("SELECT * FROM VALUES (1), (2), (2) AS v(product_id)")
    rows = forecast.all_forecasts({"ma": plain, "hurdle": parts}, active).collect()
    assert sorted((r.model_name, r.product_id, r.sale_probability) for r in rows) == [("hurdle", 1, 0.5), ("hurdle", 2, 0.5), ("ma", 1, None), ("ma", 2, None)]
    with_date = plain.withColumn("forecast_date", F.lit("2026-03-02").cast("date"))
    assert forecast.forecast_origin(with_date).first().origin == date(2026, 3, 1)


def test_unknown_models_raise(spark):
    with pytest.raises(ValueError):
        demand.forecasts(None, None, models=["no_such"])
