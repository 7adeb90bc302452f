"""Registered queries of the learned models; SQL cannot express them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercadia.operators import demand, learned, metrics
from mercadia.plans import experiment, forecast
from mercadia.queries_demand import rounded, series
from mercadia.sources import canonical as c
from mercadia.sources import layers

#: Rounds of boosting in the forecasts and in the experiment's 16 models, and the share of a leaf that a round takes.
ROUNDS, EXPERIMENT_ROUNDS, RATE = 8, 4, 0.2


def _inputs(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Daily sales, written once, and products."""
    path = f"{layers.scratch(s)}/series-{uuid.uuid4().hex}"
    series(s, d).write.parquet(path)
    return s.read.parquet(path), c.products(s, d).select("product_id", *learned.CATEGORIES)


def _forecast(s: SparkSession, d: str, train, horizon: int = 30) -> DataFrame:
    """A model's forecast of every product from the last day on, learned from all days that have all lags."""
    sold, products = _inputs(s, d)
    span = demand.bounds(sold)
    model = train(learned.Days(sold, products, span))
    state = learned.states(sold, products, span.withColumn("split", F.lit("all")))
    return rounded(learned.recursive_forecast(state, {"all": {"model": model}}, horizon).drop("split", "model_name"), 4)


def regressor_forecast(s: SparkSession, d: str) -> DataFrame:
    return _forecast(s, d, lambda f: learned.train_regressor(f, "squared_error", ROUNDS, RATE)).drop("sale_probability", "conditional_quantity")


def poisson_forecast(s: SparkSession, d: str) -> DataFrame:
    return _forecast(s, d, lambda f: learned.train_regressor(f, "poisson", ROUNDS, RATE)).drop("sale_probability", "conditional_quantity")


def hurdle_forecast(s: SparkSession, d: str) -> DataFrame:
    """With the chance of a sale and the quantity given one."""
    return _forecast(s, d, lambda f: learned.train_hurdle(f, "poisson", ROUNDS, RATE))


def experiment_metrics(s: SparkSession, d: str) -> DataFrame:
    """Metrics of nine models on four folds by horizon, with the occurrence threshold that the validation folds
    chose."""
    sold, products = _inputs(s, d)
    found, threshold = experiment.run(sold, products, demand.folds(sold), EXPERIMENT_ROUNDS, RATE)
    cube = metrics.metric_cube(found, forecast.horizon_table(s)).where("level = 'aggregate'")
    out = cube.select("split", "model_name", "horizon", "wape", "mae", "rmse", "smape", "bias", "actual_quantity_sum", "predicted_quantity_sum")
    return rounded(out.withColumn("occurrence_threshold", F.lit(threshold)), 4)


def all_future_forecasts(s: SparkSession, d: str) -> DataFrame:
    """Nine models for the active products, learned ones on all days."""
    sold, products = _inputs(s, d)
    active = c.products(s, d).where("is_active").select("product_id")
    return rounded(experiment.future(sold, products, active, EXPERIMENT_ROUNDS, RATE), 4)


QUERIES = {"all_future_forecasts": all_future_forecasts, "regressor_forecast": regressor_forecast, "poisson_forecast": poisson_forecast, "hurdle_forecast": hurdle_forecast, "experiment_metrics": experiment_metrics}
SQL: dict[str, str] = {}
