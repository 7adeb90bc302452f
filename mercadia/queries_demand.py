"""Registered queries of the demand, forecast, selection and inventory operators."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from mercadia.operators import backtest, demand, inventory, metrics
from mercadia.operators.demand import moving_average_weights
from mercadia.plans import forecast, sales
from mercadia.queries_sales import _MODELS
from mercadia.sources import canonical as c
from mercadia.sources import layers

GRID = [i / 100 for i in range(1, 51)]


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles of a result to some decimals: sums depend on the order of rows."""
    return df.select(*(F.round(f.name, digits).alias(f.name) if isinstance(f.dataType, DoubleType) else f.name for f in df.schema))


def series(s: SparkSession, d: str) -> DataFrame:
    # a row a product or an order: never a broadcast, however small the files and the columns that are left
    items = sales.enriched_items(c.items(s, d), c.products(s, d).hint("merge"))
    return demand.product_day_sales(sales.fct_sales(items, c.orders(s, d).hint("merge"), c.CANCELLED))


def _ends(sold: DataFrame, products: DataFrame, split: str = "all") -> DataFrame:
    return products.select("product_id").crossJoin(F.broadcast(demand.bounds(sold))).withColumn("split", F.lit(split))


def _labelled(sold: DataFrame, split: str = "all") -> DataFrame:
    return sold.crossJoin(F.broadcast(demand.bounds(sold))).withColumn("split", F.lit(split))


def sales_table(s: SparkSession, d: str) -> DataFrame:
    return series(s, d).withColumn("revenue", F.col("revenue").cast("double"))


def grid_summary(s: SparkSession, d: str) -> DataFrame:
    """The dense grid, summed by product."""
    grid = demand.dense_grid(layers.written(series(s, d)), c.products(s, d).select("product_id"))
    return grid.groupBy("product_id").agg(F.count("*").alias("n_days"), F.count_if(F.col("quantity_sold") == 0).alias("zero_days"), F.sum("quantity_sold").alias("quantity"))


LAG_NAMES = [f"lag_{k}" for k in demand.LAGS]
ROLLING_NAMES = [f"rolling_mean_{k}" for k in demand.WINDOWS] + [f"rolling_std_{k}" for k in demand.WINDOWS] + [f"sales_last_{k}_days" for k in (7, 14, 30)]
CUMULATIVE_NAMES = [f"sale_days_last_{k}" for k in demand.WINDOWS] + ["historical_sale_probability", "mean_positive_demand", "causal_adi", "days_since_last_sale", "current_zero_streak"]


def _marked(s: SparkSession, d: str, names: list[str]) -> DataFrame:
    """By product and year, each feature's average and a mark of its values day by day: millionths, each times a number of
    its day, added up in whole numbers. A value at another day, or another value, gives another mark."""
    epoch = (date(1992, 1, 1) - date(1970, 1, 1)).days
    number = lambda day: np.fmod((day - epoch) * 7919, 10007)
    return rounded(demand.feature_sums(layers.written(series(s, d)), c.products(s, d), names, number))


def lag_and_rolling(s: SparkSession, d: str) -> DataFrame:
    """Lags and rolling features of every product and day."""
    return _marked(s, d, LAG_NAMES + ROLLING_NAMES)


def cumulative_and_recency(s: SparkSession, d: str) -> DataFrame:
    """The cumulative and recency features of every product and day."""
    return _marked(s, d, CUMULATIVE_NAMES)


def calendar(s: SparkSession, d: str) -> DataFrame:
    days = series(s, d).select("date").distinct()
    first = days.agg(F.min("date").alias("first"))
    return days.crossJoin(F.broadcast(first)).select("date", *(x.alias(n) for n, x in demand.calendar_features(F.col("date"), F.col("first")).items()))


def segmentation(s: SparkSession, d: str) -> DataFrame:
    sold = series(s, d)
    found = demand.segment(_labelled(sold), _ends(sold, c.products(s, d)), ("product_id",))
    return rounded(found)


def _forecast(model: str):
    def query(s: SparkSession, d: str) -> DataFrame:
        sold = series(s, d)
        found = demand.forecasts(_labelled(sold).select("split", "product_id", "date", "quantity_sold"), _ends(sold, c.products(s, d)), models=[model])
        return rounded(found.select("product_id", "horizon_day", "predicted_quantity"))

    return query


def written_series(s: SparkSession, d: str) -> DataFrame:
    return layers.written(series(s, d).select("product_id", "date", "quantity_sold"))


def product_errors(s: SparkSession, d: str, sold: DataFrame | None = None) -> DataFrame:
    """Error sums by product, from sales that are written once."""
    sold = written_series(s, d) if sold is None else sold
    return backtest.product_errors(sold, c.products(s, d), demand.folds(sold), forecast.HORIZONS)


def cube(s: SparkSession, d: str, sold: DataFrame | None = None) -> DataFrame:
    return metrics.cube_of_sums(product_errors(s, d, sold))


_AGGREGATE = ["split", "model_name", "horizon", "wape", "mae", "rmse", "smape", "bias", "mase", "actual_quantity_sum", "predicted_quantity_sum"]


def aggregate(s: SparkSession, d: str, sold: DataFrame | None = None) -> DataFrame:
    return cube(s, d, sold).where("level = 'aggregate'").select(*_AGGREGATE)


def scales(s: SparkSession, d: str) -> DataFrame:
    """A11 at fold level."""
    sold = series(s, d)
    f = demand.folds(sold)
    n = c.products(s, d).agg(F.count("*").alias("products"))
    ends = f.select("split", "first_day", F.col("train_end").alias("last_day")).crossJoin(F.broadcast(n))
    return rounded(metrics.seasonal_scale(forecast.training(sold, f), ends, ["split"]))


def scored(s: SparkSession, d: str) -> DataFrame:
    """Occurrence per product and day of the final test; the score is the share of sale days in the training period."""
    sold = series(s, d)
    f = demand.folds(sold).where("split = 'final_test'")
    seen = forecast.training(sold, f).groupBy("product_id").agg(F.count("*").alias("n"))
    rows = c.products(s, d).select("product_id").crossJoin(F.broadcast(f)).join(seen, "product_id", "left")
    rows = rows.withColumn("score", F.coalesce("n", F.lit(0)) / (F.date_diff("train_end", "first_day") + 1)).withColumn("date", F.explode(F.sequence("val_start", "val_end", F.expr("interval 1 day"))))
    actual = sold.select("product_id", "date", F.lit(1).alias("actual_"))
    return rows.join(actual, ["product_id", "date"], "left").select("product_id", "date", "score", F.coalesce("actual_", F.lit(0)).alias("actual"), F.date_diff("date", "train_end").alias("horizon_day"))


def occurrence(s: SparkSession, d: str) -> DataFrame:
    horizons = F.broadcast(forecast.horizon_table(s))
    by = scored(s, d).join(horizons, F.col("horizon_day") <= F.col("horizon"))
    return rounded(metrics.occurrence_metrics(by, ["horizon"], F.lit(0.009)))


def win_counts(s: SparkSession, d: str) -> DataFrame:
    return forecast.product_wins(cube(s, d).where("level = 'product'"))


def decision(s: SparkSession, d: str) -> DataFrame:
    sums = product_errors(s, d)
    found = layers.written(metrics.cube_of_sums(sums).where("level <> 'product'"))
    agg, seg = found.where("level = 'aggregate'"), found.where("level = 'segment'")
    out = forecast.promotion(agg, seg, forecast.forecast_quality(sums), forecast.challenger(agg))
    return rounded(out.withColumnRenamed("candidate", "challenger"))


def base_forecast(s: SparkSession, d: str, models: Sequence[str] = demand.MODELS, sold: DataFrame | None = None, active: bool = False) -> DataFrame:
    sold, p = series(s, d) if sold is None else sold, c.products(s, d)
    p = p.where("is_active") if active else p
    return demand.forecasts(_labelled(sold).select("split", "product_id", "date", "quantity_sold"), _ends(sold, p), models=models)


def future_forecasts(s: SparkSession, d: str) -> DataFrame:
    """The closed-form models for active products, with the day before the first forecast. Learned models join
    through the same function; SQL cannot express those."""
    origin = F.broadcast(demand.bounds(series(s, d)).select(F.col("last_day").alias("origin")))  # one row
    found = forecast.all_forecasts({"closed": base_forecast(s, d).drop("split")}, c.products(s, d).where("is_active")).crossJoin(origin)
    return rounded(found.withColumn("forecast_date", F.date_add("origin", F.col("horizon_day"))))


def official(s: SparkSession, d: str, sold: DataFrame | None = None) -> DataFrame:
    """The champion's forecast of active products, one copy a horizon, with dates; from sales that are written once."""
    sold = written_series(s, d) if sold is None else sold
    last = demand.bounds(sold).select("last_day")
    base = base_forecast(s, d, [forecast.CHAMPION], sold, active=True)
    out = base.join(F.broadcast(forecast.horizon_table(s)), F.col("horizon_day") <= F.col("horizon")).crossJoin(F.broadcast(last))
    return rounded(out.select("product_id", F.date_add("last_day", F.col("horizon_day")).alias("forecast_date"), "horizon_day", F.col("horizon").alias("horizon_days"), "predicted_quantity", F.col("last_day").alias("data_max_date")))


def official_risk(s: SparkSession, d: str, sold: DataFrame | None = None) -> DataFrame:
    base = base_forecast(s, d, [forecast.CHAMPION], sold, active=True)
    return inventory.official_risk(inventory.classify_risk(base, c.products(s, d)), c.products(s, d))


def risk(s: SparkSession, d: str) -> DataFrame:
    found = official_risk(s, d)
    return rounded(found.select("product_id", "product_name", "category", "stock_quantity", "minimum_stock", "forecast_demand", "projected_stock", "average_daily_demand", "estimated_coverage_days", "risk_level", "horizon_days"))


def scenarios(s: SparkSession, d: str) -> DataFrame:
    """Risk changes against the champion, by model."""
    by_model = inventory.classify_risk(base_forecast(s, d), c.products(s, d), by=("model_name",))
    return inventory.risk_scenarios(by_model, forecast.CHAMPION).groupBy("model_name").agg(F.count("*").alias("products"), F.count_if("changed").alias("changed"))


def unpivoted(s: SparkSession, d: str, sold: DataFrame | None = None) -> DataFrame:
    """Metrics in long form, nulls left out."""
    names = ["wape", "mae", "rmse", "smape", "bias", "mase"]
    return rounded(aggregate(s, d, sold).unpivot(["split", "model_name", "horizon"], names, "metric_name", "metric_value").where("metric_value is not null"))


def pivoted(s: SparkSession, d: str) -> DataFrame:
    """WAPE at 14 days, a column a model."""
    return rounded(aggregate(s, d).where("horizon = 14").groupBy("split").pivot("model_name", list(MODELS)).agg(F.first("wape")))


MODELS = demand.MODELS

QUERIES = {
    "product_day_sales": sales_table,
    "product_day_grid": grid_summary,
    "calendar_features": calendar,
    "lag_rolling_features": lag_and_rolling,
    "cumulative_recency_features": cumulative_and_recency,
    "demand_segmentation": segmentation,
    "forecast_last_observation": _forecast("last_observation"),
    "forecast_lag7": _forecast("seasonal_lag_7"),
    "forecast_ma28": _forecast("moving_average_28"),
    "forecast_croston": _forecast("croston"),
    "forecast_croston_sba": _forecast("croston_sba"),
    "forecast_tsb": _forecast("tsb"),
    "fold_bounds": lambda s, d: demand.folds(series(s, d)),
    "seasonal_naive_scale": scales,
    "backtest_metrics": lambda s, d: rounded(aggregate(s, d)),
    "backtest_segment_metrics": lambda s, d: rounded(cube(s, d).where("level = 'segment'").select(*_AGGREGATE, "demand_pattern", "product_count")),
    "backtest_product_metrics": lambda s, d: rounded(cube(s, d).where("level = 'product'").select(*_AGGREGATE, "product_id", "demand_pattern")),
    "product_win_counts": win_counts,
    "select_challenger": lambda s, d: rounded(forecast.challenger(aggregate(s, d))),
    "promotion_decision": decision,
    "occurrence_metrics": occurrence,
    "average_precision": lambda s, d: rounded(metrics.average_precision(scored(s, d), ["horizon_day"])),
    "occurrence_threshold": lambda s, d: rounded(metrics.best_threshold(scored(s, d), GRID)),
    "inventory_risk": risk,
    "risk_scenarios": scenarios,
    "official_forecast_expansion": official,
    "future_forecasts": future_forecasts,
    "metrics_unpivot": unpivoted,
    "wape_pivot": pivoted,
}


# ---- the same for DuckDB ----

_SERIES = f"""{_MODELS},
series AS (SELECT product_id, order_date AS date, CAST(sum(quantity) AS DOUBLE) AS q, CAST(sum(item_total) AS DOUBLE) AS revenue FROM fact WHERE is_realized_sale GROUP BY product_id, order_date),
span AS (SELECT min(date) AS first_day, max(date) AS last_day FROM series)"""
_GRID = f"""{_SERIES},
grid AS (SELECT p.product_id, g.date, coalesce(s.q, 0) AS q FROM products p CROSS JOIN (SELECT CAST(unnest(range(first_day, last_day + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS date FROM span) g
  LEFT JOIN series s ON s.product_id = p.product_id AND s.date = g.date)"""
_LAST = "OVER (PARTITION BY product_id ORDER BY date ROWS BETWEEN {0} PRECEDING AND 1 PRECEDING)"
_W = "OVER (PARTITION BY product_id ORDER BY date)"
_FEATURES = ", ".join(
    [f"lag(q, {k}) {_W} AS lag_{k}" for k in demand.LAGS]
    + [f"avg(q) {_LAST.format(k)} AS rolling_mean_{k}, stddev_pop(q) {_LAST.format(k)} AS rolling_std_{k}, sum(CAST(q > 0 AS INT)) {_LAST.format(k)} AS sale_days_last_{k}" for k in demand.WINDOWS]
    + [f"sum(q) {_LAST.format(k)} AS sales_last_{k}_days" for k in (7, 14, 30)]
)
_FEATURED = f"""{_GRID},
marked AS (SELECT *, row_number() {_W} - 1 AS at_, {_FEATURES}, coalesce(sum(CAST(q > 0 AS INT)) {_LAST.format('UNBOUNDED')}, 0) AS pos, coalesce(sum(q) {_LAST.format('UNBOUNDED')}, 0) AS qty FROM grid),
featured AS (SELECT *, max(CASE WHEN q > 0 THEN at_ END) {_LAST.format('UNBOUNDED')} AS last_sale,
  CASE WHEN at_ > 0 THEN CAST(pos AS DOUBLE) / at_ ELSE 0 END AS historical_sale_probability, CASE WHEN pos > 0 THEN qty / pos ELSE 0 END AS mean_positive_demand,
  CASE WHEN pos > 0 THEN CAST(at_ AS DOUBLE) / pos END AS causal_adi FROM marked),
recent AS (SELECT *, CAST(at_ - last_sale AS DOUBLE) AS days_since_last_sale, at_ - coalesce(last_sale, -1) - 1 AS current_zero_streak FROM featured)"""


def _marks(names: list[str], source: str) -> str:
    number = "((date - DATE '1992-01-01') * 7919 % 10007)"
    found = ", ".join(f"round(avg({n}), 6) AS {n}, CAST(sum(CAST(floor(coalesce(CAST({n} AS DOUBLE), -1) * 1e6 + 0.5) AS BIGINT) * {number}) AS BIGINT) AS {n}_mark" for n in names)
    return f"{_FEATURED} SELECT product_id, CAST(year(date) AS INTEGER) AS year, count(*) AS days, {found} FROM {source} GROUP BY ALL"


def _forecast_sql(train: str, keys: str) -> str:
    """Common table expressions from rows (keys, product_id, date, q, first_day, last_day) called train and ends (keys, product_id)."""
    weights = ", ".join(f"({h}, {k}, {w!r}::DOUBLE)" for h, k, w in moving_average_weights(28, 30))
    key = f"{keys}, product_id"
    on = " AND ".join(f"e.{k} = x.{k}" for k in key.split(", "))
    return f"""
weights(h, k, w) AS (VALUES {weights}),
ranked AS (SELECT *, last_day - date AS back, date - first_day AS idx, row_number() OVER (PARTITION BY {key} ORDER BY date) - 1 AS r, count(*) OVER (PARTITION BY {key}) - row_number() OVER (PARTITION BY {key} ORDER BY date) AS after,
  coalesce((date - lag(date) OVER (PARTITION BY {key} ORDER BY date)), date - first_day + 1) AS gap FROM {train}),
weighed AS (SELECT *, CASE WHEN r = 0 THEN power(0.9::DOUBLE, after) ELSE 0.1::DOUBLE * power(0.9::DOUBLE, after) END AS wt,
  CASE WHEN r = 0 THEN power(0.9::DOUBLE, back) / (idx + 1) ELSE 0.1::DOUBLE * power(0.9::DOUBLE, back) END AS chance FROM ranked),
levels AS (SELECT {key}, sum(wt * q) / sum(wt * gap) AS croston, sum(chance) * sum(wt * q) AS tsb FROM weighed GROUP BY {key}),
days(h) AS (SELECT unnest(range(1, 31))),
near AS (SELECT {key}, back, q FROM ranked WHERE back < 28),
forecasts AS (
  SELECT {', '.join('e.' + k for k in key.split(', '))}, 'croston' AS model_name, h AS horizon_day, coalesce(x.croston, 0) AS p FROM ends e CROSS JOIN days LEFT JOIN levels x ON {on}
  UNION ALL SELECT {', '.join('e.' + k for k in key.split(', '))}, 'croston_sba', h, coalesce(x.croston, 0) * 0.95::DOUBLE FROM ends e CROSS JOIN days LEFT JOIN levels x ON {on}
  UNION ALL SELECT {', '.join('e.' + k for k in key.split(', '))}, 'tsb', h, coalesce(x.tsb, 0) FROM ends e CROSS JOIN days LEFT JOIN levels x ON {on}
  UNION ALL SELECT {', '.join('e.' + k for k in key.split(', '))}, 'last_observation', h, coalesce(x.q, 0) FROM ends e CROSS JOIN days LEFT JOIN near x ON {on} AND x.back = 0
  UNION ALL SELECT {', '.join('e.' + k for k in key.split(', '))}, 'seasonal_lag_7', h, coalesce(x.q, 0) FROM ends e CROSS JOIN days LEFT JOIN near x ON {on} AND x.back = 6 - (h - 1) % 7
  UNION ALL SELECT {', '.join('e.' + k for k in key.split(', '))}, 'moving_average_28', days.h, coalesce(x.m, 0) FROM ends e CROSS JOIN days
    LEFT JOIN (SELECT {key}, h, sum(q * w) AS m FROM near JOIN weights ON back = k GROUP BY {key}, h) x ON {on} AND x.h = days.h)"""


_ALL = f"""{_SERIES},
train AS (SELECT 'all' AS split, product_id, date, q, first_day, last_day FROM series, span), ends AS (SELECT 'all' AS split, product_id FROM products), {_forecast_sql('train', 'split')}"""


def _model_sql(model: str) -> str:
    return f"{_ALL} SELECT product_id, CAST(horizon_day AS INTEGER) AS horizon_day, round(p, 6) AS predicted_quantity FROM forecasts WHERE model_name = '{model}'"


_FOLDS = f"""{_SERIES},
folds AS (SELECT split, first_day, last_day - shift AS train_end, last_day - shift + 1 AS val_start, last_day - shift + 30 AS val_end
  FROM span, (VALUES ('validation_fold_1', 120), ('validation_fold_2', 90), ('validation_fold_3', 60), ('final_test', 30)) v(split, shift)),
train AS (SELECT split, product_id, date, q, first_day, train_end AS last_day FROM series JOIN folds ON date <= train_end)"""
_PATTERN = "CASE WHEN adi >= 1.32 AND cv2 >= 0.49 THEN 'lumpy' WHEN adi >= 1.32 THEN 'intermittent' WHEN cv2 >= 0.49 THEN 'erratic' ELSE 'smooth' END"
_COMPARED = f"""{_FOLDS}, ends AS (SELECT split, product_id, first_day, train_end FROM products, folds), {_forecast_sql('train', 'split')},
segments AS (SELECT split, product_id, {_PATTERN} AS demand_pattern FROM (
  SELECT e.split, e.product_id, CASE WHEN n > 0 THEN CAST(train_end - first_day + 1 AS DOUBLE) / n ELSE 'infinity'::DOUBLE END AS adi, CASE WHEN n > 0 THEN (n * sq - sm * sm) / (sm * sm) ELSE 0 END AS cv2
  FROM ends e LEFT JOIN (SELECT split, product_id, count(*) AS n, sum(q) AS sm, sum(q * q) AS sq FROM train GROUP BY ALL) x ON e.split = x.split AND e.product_id = x.product_id)),
compared AS (SELECT f.*, coalesce(s.q, 0) AS a, g.demand_pattern FROM forecasts f JOIN folds o ON f.split = o.split
  LEFT JOIN series s ON s.product_id = f.product_id AND s.date = o.train_end + CAST(horizon_day AS INTEGER) JOIN segments g ON g.split = f.split AND g.product_id = f.product_id),
by_horizon AS (SELECT c.*, h.horizon FROM compared c JOIN (VALUES (7), (14), (30)) h(horizon) ON horizon_day <= horizon)"""
_RAW_METRICS = """CASE WHEN sum(a) > 0 THEN sum(abs(p - a)) / sum(a) END AS wape, avg(abs(p - a)) AS mae, sqrt(avg((p - a) * (p - a))) AS rmse,
  avg(CASE WHEN abs(a) + abs(p) <> 0 THEN 2 * abs(p - a) / (abs(a) + abs(p)) ELSE 0 END) AS smape, CASE WHEN sum(a) > 0 THEN sum(p - a) / sum(a) END AS bias,
  sum(a) AS actual_quantity_sum, sum(p) AS predicted_quantity_sum"""
_ROUNDED = ", ".join(f"round({n}, 6) AS {n}" for n in _AGGREGATE[3:])
_MASE = "m.*, mae / (SELECT CASE WHEN sum(x) > 0 AND sum(n) > 0 THEN sum(x) / sum(n) END FROM steps s WHERE s.split = m.split"
_CUBES = f"""{_COMPARED},
moved AS (SELECT split, product_id, sum(abs(v)) AS x FROM (SELECT split, product_id, d, sum(v) AS v FROM (
  SELECT split, product_id, date AS d, q AS v FROM train WHERE date - first_day >= 7 UNION ALL SELECT split, product_id, date + 7, -q FROM train WHERE date + 7 <= last_day) GROUP BY ALL) GROUP BY ALL),
steps AS (SELECT g.split, g.product_id, g.demand_pattern, coalesce(x, 0) AS x, f.train_end - f.first_day - 6 AS n FROM segments g JOIN folds f ON f.split = g.split LEFT JOIN moved m ON m.split = g.split AND m.product_id = g.product_id),
agg AS (SELECT {_MASE}) AS mase FROM (SELECT split, model_name, horizon, {_RAW_METRICS} FROM by_horizon GROUP BY ALL) m),
seg AS (SELECT {_MASE} AND s.demand_pattern = m.demand_pattern) AS mase FROM (SELECT split, model_name, horizon, demand_pattern, count(DISTINCT product_id) AS product_count, {_RAW_METRICS} FROM by_horizon GROUP BY split, model_name, horizon, demand_pattern) m),
prod AS (SELECT m.*, mae / CASE WHEN x > 0 AND n > 0 THEN x / n END AS mase FROM (SELECT split, model_name, horizon, demand_pattern, product_id, {_RAW_METRICS} FROM by_horizon GROUP BY split, model_name, horizon, demand_pattern, product_id) m
  JOIN steps s ON s.split = m.split AND s.product_id = m.product_id)"""
_CHALLENGER = "SELECT model_name, avg(wape) AS mean_wape FROM agg WHERE split LIKE 'validation_fold_%' AND horizon = 14 AND wape IS NOT NULL AND model_name <> 'moving_average_28' GROUP BY model_name ORDER BY mean_wape, model_name LIMIT 1"
_SCORED = f"""{_FOLDS},
scored AS (SELECT p.product_id, g.date, coalesce(n, 0) / CAST(f.train_end - f.first_day + 1 AS DOUBLE) AS score, CASE WHEN s.product_id IS NULL THEN 0 ELSE 1 END AS actual, g.date - f.train_end AS horizon_day
  FROM products p CROSS JOIN (SELECT * FROM folds WHERE split = 'final_test') f CROSS JOIN (SELECT CAST(unnest(range(val_start, val_end + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS date FROM folds WHERE split = 'final_test') g
  LEFT JOIN (SELECT product_id, count(*) AS n FROM train WHERE split = 'final_test' GROUP BY product_id) t ON t.product_id = p.product_id
  LEFT JOIN series s ON s.product_id = p.product_id AND s.date = g.date)"""
_RATIOS = """CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0 END AS recall,
  CASE WHEN 2 * tp + fp + fn > 0 THEN CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) ELSE 0 END AS f1"""
_RISK = f"""{_ALL},
need AS (SELECT model_name, product_id, sum(p) AS d FROM forecasts WHERE horizon_day <= 14 GROUP BY ALL),
risk AS (SELECT n.model_name, p.*, d, stock_quantity - d AS remaining, CASE WHEN d > 0 THEN 14 * stock_quantity / d END AS cover FROM products p JOIN need n ON p.product_id = n.product_id WHERE is_active),
classed AS (SELECT *, CASE WHEN stock_quantity <= 0 OR remaining <= 0 THEN 'critical' WHEN remaining <= minimum_stock THEN 'high_risk' WHEN cover < 28 THEN 'attention'
  WHEN d = 0 OR cover > 42 THEN 'potential_overstock' ELSE 'adequate' END AS risk_level FROM risk)"""

SQL = {
    "product_day_sales": f"{_SERIES} SELECT product_id, date, q AS quantity_sold, revenue FROM series",
    "product_day_grid": f"{_GRID} SELECT product_id, count(*) AS n_days, count(*) FILTER (q = 0) AS zero_days, sum(q) AS quantity FROM grid GROUP BY product_id",
    "calendar_features": f"""{_SERIES} SELECT DISTINCT date, CAST(isodow(date) - 1 AS INTEGER) AS day_of_week, CAST(day(date) AS INTEGER) AS day_of_month, CAST(month(date) AS INTEGER) AS month,
      CAST(quarter(date) AS INTEGER) AS quarter, CAST(isodow(date) >= 6 AS INTEGER) AS is_weekend, CAST(date - first_day AS INTEGER) AS time_index FROM series, span""",
    "lag_rolling_features": _marks(LAG_NAMES + ROLLING_NAMES, "marked"),
    "cumulative_recency_features": _marks(CUMULATIVE_NAMES, "recent"),
    "demand_segmentation": f"""{_SERIES} SELECT product_id, non_zero_demand_days, round(adi, 6) AS adi, round(cv2, 6) AS cv_squared, {_PATTERN} AS demand_pattern FROM (
      SELECT p.product_id, coalesce(n, 0) AS non_zero_demand_days, CASE WHEN n > 0 THEN CAST(last_day - first_day + 1 AS DOUBLE) / n ELSE 'infinity'::DOUBLE END AS adi, CASE WHEN n > 0 THEN (n * sq - sm * sm) / (sm * sm) ELSE 0 END AS cv2
      FROM products p CROSS JOIN span LEFT JOIN (SELECT product_id, count(*) AS n, sum(q) AS sm, sum(q * q) AS sq FROM series GROUP BY product_id) s ON p.product_id = s.product_id)""",
    "forecast_last_observation": _model_sql("last_observation"),
    "forecast_lag7": _model_sql("seasonal_lag_7"),
    "forecast_ma28": _model_sql("moving_average_28"),
    "forecast_croston": _model_sql("croston"),
    "forecast_croston_sba": _model_sql("croston_sba"),
    "forecast_tsb": _model_sql("tsb"),
    "fold_bounds": f"{_FOLDS} SELECT * FROM folds",
    "seasonal_naive_scale": f"""{_FOLDS}, apart AS (SELECT split, abs(sum(v)) AS x FROM (
        SELECT split, product_id, date AS d, q AS v FROM train WHERE date - first_day >= 7 UNION ALL SELECT split, product_id, date + 7, -q FROM train WHERE date + 7 <= last_day) GROUP BY split, product_id, d)
      SELECT split, round(s / n, 6) AS scale FROM (SELECT f.split, sum(x) AS s, any_value((SELECT count(*) FROM products) * (train_end - first_day + 1 - 7)) AS n FROM folds f JOIN apart a ON f.split = a.split GROUP BY f.split)""",
    "backtest_metrics": f"{_CUBES} SELECT split, model_name, horizon, {_ROUNDED} FROM agg",
    "backtest_segment_metrics": f"{_CUBES} SELECT split, model_name, horizon, demand_pattern, product_count, {_ROUNDED} FROM seg",
    "backtest_product_metrics": f"{_CUBES} SELECT split, model_name, horizon, demand_pattern, product_id, {_ROUNDED} FROM prod",
    "product_win_counts": f"""{_CUBES}, means AS (SELECT product_id, model_name, avg(wape) AS w FROM prod WHERE split LIKE 'validation_fold_%' AND horizon = 14 AND wape IS NOT NULL GROUP BY ALL)
      SELECT model_name, count(*) FILTER (abs(w - least) <= 1e-8 + 1e-5 * abs(least)) AS wins FROM (SELECT *, min(w) OVER (PARTITION BY product_id) AS least FROM means) GROUP BY model_name""",
    "select_challenger": f"{_CUBES} SELECT model_name, round(mean_wape, 6) AS mean_wape FROM ({_CHALLENGER})",
    "promotion_decision": f"""{_CUBES}, ch AS ({_CHALLENGER}),
      splits AS (SELECT split, max(CASE WHEN a.model_name = ch.model_name THEN wape END) AS x, max(CASE WHEN a.model_name = 'moving_average_28' THEN wape END) AS y, max(CASE WHEN a.model_name = ch.model_name THEN bias END) AS b
        FROM agg a, ch WHERE horizon = 14 GROUP BY split),
      segs AS (SELECT demand_pattern, max(CASE WHEN s.model_name = ch.model_name THEN wape END) AS x, max(CASE WHEN s.model_name = 'moving_average_28' THEN wape END) AS y FROM seg s, ch WHERE horizon = 14 AND split = 'final_test' GROUP BY demand_pattern),
      crit AS (SELECT count(*) FILTER (split LIKE 'validation%' AND x < y) AS validation_fold_wins, count(*) FILTER (split LIKE 'validation%' AND x IS NOT NULL AND y IS NOT NULL) AS validation_fold_count,
        max(CASE WHEN split LIKE 'validation%' THEN (x - y) / y END) AS deg, bool_and(CASE WHEN split = 'final_test' THEN x <= y END) AS not_worse_on_final_test,
        bool_and(CASE WHEN split = 'final_test' THEN abs(b) <= 0.25 END) AS acceptable_aggregate_bias,
        (SELECT avg(CAST((x - y) / y > 0.10 AS INT)) FROM segs WHERE x IS NOT NULL AND y IS NOT NULL) AS worse_segment_share FROM splits),
      rules AS (SELECT *, validation_fold_wins >= 2 AS wins_at_least_two_validation_folds, coalesce(deg <= 0.10, true) AS no_material_validation_degradation, worse_segment_share <= 0.5 AS does_not_worsen_most_segments, true AS forecast_quality_passed FROM crit)
      SELECT ch.model_name AS challenger, validation_fold_wins, validation_fold_count, round(deg, 6) AS maximum_relative_fold_degradation, not_worse_on_final_test, acceptable_aggregate_bias, round(worse_segment_share, 6) AS worse_segment_share,
        wins_at_least_two_validation_folds, no_material_validation_degradation, does_not_worsen_most_segments, forecast_quality_passed,
        CASE WHEN not_worse_on_final_test IS NULL OR acceptable_aggregate_bias IS NULL OR does_not_worsen_most_segments IS NULL THEN 'inconclusive'
          WHEN wins_at_least_two_validation_folds AND no_material_validation_degradation AND not_worse_on_final_test AND acceptable_aggregate_bias AND does_not_worsen_most_segments THEN 'promoted' ELSE 'rejected' END AS decision,
        CASE WHEN wins_at_least_two_validation_folds AND no_material_validation_degradation AND not_worse_on_final_test AND acceptable_aggregate_bias AND does_not_worsen_most_segments THEN ch.model_name ELSE 'moving_average_28' END AS final_champion
      FROM rules, ch""",
    "occurrence_metrics": f"""{_SCORED} SELECT horizon, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(predicted, 6) AS predicted_sale_day_rate, round(seen, 6) AS actual_sale_day_rate, positive_day_count, row_count
      FROM (SELECT *, {_RATIOS} FROM (SELECT horizon, count(*) FILTER (score >= 0.009 AND actual = 1) AS tp, count(*) FILTER (score >= 0.009 AND actual = 0) AS fp, count(*) FILTER (score < 0.009 AND actual = 1) AS fn,
        avg(CAST(score >= 0.009 AS INT)) AS predicted, avg(actual) AS seen, count(*) FILTER (actual = 1) AS positive_day_count, count(*) AS row_count
        FROM scored JOIN (VALUES (7), (14), (30)) h(horizon) ON horizon_day <= horizon GROUP BY horizon))""",
    "average_precision": f"""{_SCORED}, steps AS (SELECT horizon_day, score, sum(actual) AS tp, count(*) AS n FROM scored GROUP BY ALL),
      cum AS (SELECT *, CAST(sum(tp) OVER w AS DOUBLE) / sum(n) OVER w AS precision FROM steps WINDOW w AS (PARTITION BY horizon_day ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
      SELECT CAST(horizon_day AS INTEGER) AS horizon_day, CASE WHEN sum(tp) > 0 THEN round(sum(tp * precision) / sum(tp), 6) END AS pr_auc FROM cum GROUP BY horizon_day""",
    "occurrence_threshold": f"""{_SCORED}, found AS (SELECT t AS threshold, count(*) FILTER (score >= t AND actual = 1) AS tp, count(*) FILTER (score >= t AND actual = 0) AS fp, count(*) FILTER (score < t AND actual = 1) AS fn
        FROM scored CROSS JOIN (SELECT CAST(unnest(range(1, 51)) AS DOUBLE) / 100 AS t) GROUP BY t)
      SELECT threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM (SELECT threshold, {_RATIOS} FROM found) ORDER BY f1 DESC, recall DESC, threshold LIMIT 1""",
    "inventory_risk": f"""{_RISK} SELECT product_id, product_name, category, stock_quantity, minimum_stock, round(d, 6) AS forecast_demand, round(remaining, 6) AS projected_stock, round(d / 14, 6) AS average_daily_demand,
      round(cover, 6) AS estimated_coverage_days, risk_level, 14 AS horizon_days FROM classed WHERE model_name = 'moving_average_28'""",
    "risk_scenarios": f"""{_RISK} SELECT x.model_name, count(*) AS products, count(*) FILTER (x.risk_level <> y.risk_level) AS changed
      FROM classed x JOIN classed y ON x.product_id = y.product_id AND y.model_name = 'moving_average_28' GROUP BY x.model_name""",
    "future_forecasts": f"""{_ALL} SELECT f.product_id, model_name, CAST(horizon_day AS INTEGER) AS horizon_day, round(p, 6) AS predicted_quantity, last_day AS origin, last_day + CAST(horizon_day AS INTEGER) AS forecast_date
      FROM forecasts f, span, products a WHERE a.product_id = f.product_id AND is_active""",
    "official_forecast_expansion": f"""{_ALL} SELECT f.product_id, last_day + CAST(horizon_day AS INTEGER) AS forecast_date, CAST(horizon_day AS INTEGER) AS horizon_day, horizon AS horizon_days, round(p, 6) AS predicted_quantity, last_day AS data_max_date
      FROM forecasts f JOIN products p USING (product_id) JOIN (VALUES (7), (14), (30)) h(horizon) ON horizon_day <= horizon CROSS JOIN span WHERE model_name = 'moving_average_28' AND is_active""",
    "metrics_unpivot": f"""{_CUBES}, wide AS (SELECT split, model_name, horizon, wape, mae, rmse, smape, bias, mase FROM agg)
      SELECT split, model_name, horizon, metric_name, round(metric_value, 6) AS metric_value FROM (UNPIVOT wide ON wape, mae, rmse, smape, bias, mase INTO NAME metric_name VALUE metric_value)""",
    "wape_pivot": f"""{_CUBES} SELECT split, {', '.join(f"round(max(CASE WHEN model_name = '{m}' THEN wape END), 6) AS {m}" for m in MODELS)} FROM agg WHERE horizon = 14 GROUP BY split""",
}
