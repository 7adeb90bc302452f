"""Backtest, selection and promotion of forecast models."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mercadia.operators import demand

CHAMPION = "moving_average_28"
HORIZONS = (7, 14, 30)
#: Limits of the promotion gate.
MAX_DEGRADATION, MAX_BIAS, MAX_WORSE_SEGMENTS = 0.10, 0.25, 0.50


def horizon_table(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT explode(array" + str(HORIZONS) + ") AS horizon")


def training(sales: DataFrame, folds: DataFrame) -> DataFrame:
    """Each fold's sales up to its train_end: all folds in one job."""
    return sales.join(F.broadcast(folds), F.col("date") <= F.col("train_end")).select("split", "product_id", "date", "quantity_sold", "first_day", F.col("train_end").alias("last_day"))


def compare(sales: DataFrame, products: DataFrame, folds: DataFrame, history: int = 28) -> DataFrame:
    """(split, product_id, model_name, horizon_day, predicted_quantity, actual_quantity, demand_pattern) for the
    closed-form models on every fold; a day without a sale is an actual of zero."""
    train = training(sales, folds)
    ends = products.select("product_id").crossJoin(F.broadcast(folds)).select("split", "product_id", "first_day", F.col("train_end").alias("last_day"))
    predicted = demand.forecasts(train, ends, history=history)
    segments = demand.segment(train, ends, ("split", "product_id")).select("split", "product_id", "demand_pattern")
    held = sales.join(F.broadcast(folds), F.col("date").between(F.col("val_start"), F.col("val_end")))
    actual = held.select("split", "product_id", (F.date_diff("date", "train_end")).alias("horizon_day"), F.col("quantity_sold").alias("actual_"))
    both = predicted.join(actual, ["split", "product_id", "horizon_day"], "left").join(segments, ["split", "product_id"])
    return both.withColumn("actual_quantity", F.coalesce("actual_", F.lit(0.0))).drop("actual_")


def seasonal_steps(sales: DataFrame, products: DataFrame, folds: DataFrame, lag: int = 7) -> DataFrame:
    """(split, demand_pattern, product_id, apart, days): each product's sum of absolute steps to the day ``lag`` before in
    each fold's training days, and how many there are; from the sparse rows."""
    train = training(sales, folds)
    ends = products.select("product_id").crossJoin(F.broadcast(folds)).select("split", "product_id", "first_day", F.col("train_end").alias("last_day"))
    segments = demand.segment(train, ends, ("split", "product_id")).select("split", "product_id", "demand_pattern")
    now = train.where(F.date_diff("date", "first_day") >= lag).select("split", "product_id", F.col("date").alias("d"), F.col("quantity_sold").alias("q"))
    then = train.where(F.date_add("date", lag) <= F.col("last_day")).select("split", "product_id", F.date_add("date", lag).alias("d"), (-F.col("quantity_sold")).alias("q"))
    apart = now.unionByName(then).groupBy("split", "product_id", "d").agg(F.abs(F.sum("q")).alias("apart")).groupBy("split", "product_id").agg(F.sum("apart").alias("apart"))
    days = ends.select("split", "product_id", (F.date_diff("last_day", "first_day") + 1 - lag).alias("days"))
    both = days.join(segments, ["split", "product_id"]).join(apart, ["split", "product_id"], "left")
    return both.withColumn("apart", F.coalesce("apart", F.lit(0.0)))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """How often each value occurs, nulls too."""
    return df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))


def all_forecasts(parts: Mapping[str, DataFrame], active: DataFrame) -> DataFrame:
    """Forecasts of all models for active products under one set of columns. parts: forecasts by model; a part with
    a model_name column keeps it. Components that a model lacks are null."""
    named = [df if "model_name" in df.columns else df.withColumn("model_name", F.lit(name)) for name, df in parts.items()]
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)
    return union.join(active.select("product_id").distinct(), "product_id", "left_semi")


def forecast_origin(forecast: DataFrame) -> DataFrame:
    """One row: the day before the first forecast day."""
    return forecast.agg(F.date_sub(F.min("forecast_date"), 1).alias("origin"))


def missing_forecasts(actuals: DataFrame, predicted: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Actual rows without a forecast, or with a null one."""
    given = predicted.where(F.col("predicted_quantity").isNotNull()).select(*keys)
    # a row a product and day: never a broadcast, whatever the size of what they are made from
    return actuals.join(given.hint("merge"), list(keys), "left_anti")


def require_forecasts(actuals: DataFrame, predicted: DataFrame, keys: tuple[str, ...]) -> None:
    """Raises where an actual has no forecast."""
    n = missing_forecasts(actuals, predicted, keys).count()
    if n:
        raise ValueError(f"{n} actual rows have no forecast")


def product_wins(product_metrics: DataFrame, horizon: int = 14) -> DataFrame:
    """Per model the products on which its mean validation WAPE is the least, ties included."""
    chosen = product_metrics.where(F.col("split").startswith("validation_fold_") & (F.col("horizon") == horizon) & F.col("wape").isNotNull())
    mean = chosen.groupBy("product_id", "model_name").agg(F.avg("wape").alias("wape"))
    least = mean.withColumn("least", F.min("wape").over(Window.partitionBy("product_id")))  # a row a model
    close = F.abs(F.col("wape") - F.col("least")) <= 1e-8 + 1e-5 * F.abs("least")
    return least.groupBy("model_name").agg(F.count_if(close).alias("wins"))


def challenger(aggregate: DataFrame, champion: str = CHAMPION, horizon: int = 14) -> DataFrame:
    """The other model of least mean validation WAPE, by name on ties."""
    chosen = aggregate.where(F.col("split").startswith("validation_fold_") & (F.col("horizon") == horizon) & F.col("wape").isNotNull() & (F.col("model_name") != champion))
    return chosen.groupBy("model_name").agg(F.avg("wape").alias("mean_wape")).orderBy("mean_wape", "model_name").limit(1)


def promotion(aggregate: DataFrame, segments: DataFrame, quality: DataFrame, candidate: DataFrame, champion: str = CHAMPION, horizon: int = 14) -> DataFrame:
    """One row with the six criteria and the decision: promoted if all hold, inconclusive if one is unknown, else
    rejected. quality: model_name, passed; candidate: one row with model_name."""
    name = candidate.select(F.col("model_name").alias("candidate"))
    at = aggregate.where(F.col("horizon") == horizon).crossJoin(F.broadcast(name)).where(F.col("model_name").isin(champion) | (F.col("model_name") == F.col("candidate")))
    mine, theirs = F.col("model_name") == F.col("candidate"), F.col("model_name") == champion
    pick = lambda c, who: F.max(F.when(who, F.col(c)))
    per_split = at.groupBy("candidate", "split").agg(pick("wape", mine).alias("a"), pick("wape", theirs).alias("b"), pick("bias", mine).alias("bias"))
    validation = F.col("split").startswith("validation_fold_") & F.col("a").isNotNull() & F.col("b").isNotNull()
    final = F.col("split") == "final_test"
    worse = (F.col("a") - F.col("b")) / F.col("b")
    splits = per_split.groupBy("candidate").agg(
        F.count_if(validation & (F.col("a") < F.col("b"))).alias("validation_fold_wins"), F.count_if(validation).alias("validation_fold_count"),
        F.max(F.when(validation, worse)).alias("maximum_relative_fold_degradation"),
        F.bool_and(F.when(final, F.col("a") <= F.col("b"))).alias("not_worse_on_final_test"),
        F.bool_and(F.when(final, F.abs("bias") <= MAX_BIAS)).alias("acceptable_aggregate_bias"),
    )
    seg = segments.where((F.col("horizon") == horizon) & (F.col("split") == "final_test")).crossJoin(F.broadcast(name)).groupBy("candidate", "demand_pattern")
    seg = seg.agg(pick("wape", mine).alias("a"), pick("wape", theirs).alias("b")).where("a is not null and b is not null")
    share = seg.groupBy("candidate").agg(F.avg((worse > MAX_DEGRADATION).cast("double")).alias("worse_segment_share"))
    good = quality.select(F.col("model_name").alias("candidate"), F.col("passed").alias("forecast_quality_passed"))
    row = splits.join(share, "candidate", "left").join(good, "candidate", "left").withColumns({
        "wins_at_least_two_validation_folds": F.col("validation_fold_wins") >= 2,
        "no_material_validation_degradation": F.coalesce(F.col("maximum_relative_fold_degradation") <= MAX_DEGRADATION, F.lit(True)),
        "does_not_worsen_most_segments": F.col("worse_segment_share") <= MAX_WORSE_SEGMENTS,
    })
    criteria = [
        "wins_at_least_two_validation_folds", "no_material_validation_degradation", "not_worse_on_final_test", "acceptable_aggregate_bias",
        "does_not_worsen_most_segments", "forecast_quality_passed",
    ]
    unknown, all_ = F.lit(False), F.lit(True)
    for c in criteria:
        unknown, all_ = unknown | F.col(c).isNull(), all_ & F.col(c)
    decision = F.when(unknown, "inconclusive").when(all_, "promoted").otherwise("rejected")
    return row.withColumn("decision", decision).withColumn("final_champion", F.when(F.col("decision") == "promoted", F.col("candidate")).otherwise(champion))


def forecast_quality(sums: DataFrame) -> DataFrame:
    """Whether a model's forecasts are finite, not negative and unique, from the rows of backtest.product_errors; those hold
    all days of their horizon, so a key twice is a forecast twice."""
    longest = sums.where(F.col("horizon") == max(HORIZONS))
    per_key = longest.groupBy("model_name", "split", "product_id").agg(F.count("*").alias("n"), F.sum("bad_").alias("bad"))
    return per_key.groupBy("model_name").agg(((F.max("n") == 1) & (F.sum("bad") == 0)).alias("passed"))
