"""Forecast and occurrence metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def error_sums(actual: Column, predicted: Column) -> dict[str, Column]:
    """What the metrics of any group of rows are made of; sums of sums are those of the larger group."""
    error = predicted - actual
    both = F.abs(actual) + F.abs(predicted)
    return {
        "rows_": F.count(error), "absolute_": F.sum(F.abs(error)), "squared_": F.sum(error * error), "error_": F.sum(error),
        "relative_": F.sum(F.when(both != 0, 2 * F.abs(error) / both).otherwise(0.0)), "actual_": F.sum(actual), "predicted_": F.sum(predicted),
    }


def metrics_of_sums(sums: dict[str, Column]) -> dict[str, Column]:
    """A12 from the sums of error_sums: WAPE, MAE, RMSE, sMAPE (0/0 counts 0) and signed bias; shares of the actual sum are
    null where that is 0."""
    total, n = sums["actual_"], sums["rows_"]
    part = lambda x: F.when(total > 0, sums[x] / total)
    mean = lambda x: F.when(n > 0, sums[x] / n)
    return {
        "wape": part("absolute_"), "mae": mean("absolute_"), "rmse": F.sqrt(mean("squared_")), "smape": mean("relative_"), "bias": part("error_"),
        "actual_quantity_sum": total, "predicted_quantity_sum": sums["predicted_"],
    }


def forecast_metrics(actual: Column, predicted: Column) -> dict[str, Column]:
    """A12 over rows."""
    return metrics_of_sums(error_sums(actual, predicted))


def metric_cube(compared: DataFrame, horizons: DataFrame) -> DataFrame:
    """Metrics by (split, model, horizon), and the same by demand pattern and by product. Days are summed once, by
    product; the levels are sums of these rows."""
    by_horizon = compared.join(F.broadcast(horizons), F.col("horizon_day") <= F.col("horizon"))  # one row a horizon
    sums = error_sums(F.col("actual_quantity"), F.col("predicted_quantity"))
    return cube_of_sums(by_horizon.groupBy("split", "model_name", "horizon", "demand_pattern", "product_id").agg(*(x.alias(n) for n, x in sums.items())))


def cube_of_sums(products: DataFrame) -> DataFrame:
    """A14 from a row a split, model, horizon, demand pattern and product with the sums of error_sums; level is aggregate,
    segment or product, and a query that wants one level computes that alone. With apart and days (a product's seasonal
    steps and how many) there is mase: MAE over the mean step of the level's products in training; null where that is 0."""
    keys, names = ["split", "model_name", "horizon"], [n for n in (*error_sums(F.lit(0), F.lit(0)), "apart", "days") if n in products.columns]
    found = metrics_of_sums({n: F.col(n) for n in names})
    if "apart" in names:
        found["mase"] = found["mae"] / F.when((F.col("days") > 0) & (F.col("apart") > 0), F.col("apart") / F.col("days"))
    summed = lambda df, *by: df.groupBy(*keys, *by).agg(F.sum("product_count").alias("product_count"), *(F.sum(n).alias(n) for n in names))
    own = products.withColumn("product_count", F.lit(1).cast("long"))
    segments = summed(own, "demand_pattern")

    def level(df: DataFrame, name: str) -> DataFrame:
        none = {c: F.lit(None).cast(products.schema[c].dataType) for c in ("demand_pattern", "product_id") if c not in df.columns}
        return df.withColumns(none).select(*keys, "demand_pattern", "product_id", "product_count", *(x.alias(n) for n, x in found.items()), F.lit(name).alias("level"))

    return level(summed(segments), "aggregate").unionByName(level(segments, "segment")).unionByName(level(own, "product"))


def seasonal_scale(train: DataFrame, ends: DataFrame, by: list[str], lag: int = 7) -> DataFrame:
    """Mean absolute difference to the day ``lag`` before over the dense grid, from sparse rows; null if 0.

    train: the by columns, product_id, first_day, last_day, date, quantity_sold; ends: the by columns, products (how
    many), first_day, last_day. Days on which neither value is positive add nothing."""
    now = train.where(F.date_diff("date", "first_day") >= lag).select(*by, "product_id", F.col("date").alias("d"), F.col("quantity_sold").alias("q"))
    then = train.where(F.date_add("date", lag) <= F.col("last_day")).select(*by, "product_id", F.date_add("date", lag).alias("d"), (-F.col("quantity_sold")).alias("q"))
    keys = list(dict.fromkeys([*by, "product_id", "d"]))
    apart = now.unionByName(then).groupBy(*keys).agg(F.abs(F.sum("q")).alias("apart")).groupBy(*by).agg(F.sum("apart").alias("apart"))
    n = F.col("products") * (F.date_diff("last_day", "first_day") + 1 - lag)
    return ends.join(apart, by, "left").select(*by, F.when((n > 0) & (F.col("apart") > 0), F.col("apart") / n).alias("scale"))


def with_mase(cube: DataFrame, steps: DataFrame) -> DataFrame:
    """Add mase at every level of a cube: MAE over the mean absolute step of the level's products in training; null
    where that is 0 or unknown. steps: split, demand_pattern, product_id, apart (the sum of steps), days (how many)."""
    keys = ["split", "demand_pattern", "product_id"]
    sets = [[F.col(k) for k in keys[:n]] for n in (1, 2, 3)]
    scales = steps.groupingSets(sets, *keys).agg(F.sum("apart").alias("apart"), F.sum("days").alias("days"))
    scales = scales.select(*(F.col(k).alias(f"{k}_") for k in keys), F.when((F.col("days") > 0) & (F.col("apart") > 0), F.col("apart") / F.col("days")).alias("scale"))
    same = (F.col("split") == F.col("split_")) & F.col("demand_pattern").eqNullSafe(F.col("demand_pattern_")) & F.col("product_id").eqNullSafe(F.col("product_id_"))
    return cube.join(scales, same, "left").withColumn("mase", F.col("mae") / F.col("scale")).drop(*(f"{k}_" for k in keys), "scale")


def occurrence_metrics(scored: DataFrame, by: list[str], threshold: Column) -> DataFrame:
    """Precision, recall, F1 (0 where undefined), rates and counts of ``score >= threshold``.

    scored: the by columns, actual (0 or 1), score."""
    hit = F.col("score") >= threshold
    yes = F.col("actual") == 1
    tp, fp, fn = F.count_if(hit & yes), F.count_if(hit & ~yes), F.count_if(~hit & yes)
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return scored.groupBy(*by).agg(
        ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        F.avg(hit.cast("double")).alias("predicted_sale_day_rate"), F.avg(yes.cast("double")).alias("actual_sale_day_rate"),
        F.count_if(yes).alias("positive_day_count"), F.count("*").alias("row_count"),
    )


def average_precision(scored: DataFrame, by: list[str]) -> DataFrame:
    """Step-wise area under precision and recall; equal scores are one step. Rows are counted by score first, so
    the ordered window has a row a score; null without positives."""
    steps = scored.groupBy(*by, "score").agg(F.sum("actual").alias("tp"), F.count("*").alias("n"))
    down = Window.partitionBy(*by).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.withColumn("precision", F.sum("tp").over(down) / F.sum("n").over(down))
    total = F.sum("tp")
    return steps.groupBy(*by).agg(F.when(total > 0, F.sum(F.col("tp") * F.col("precision")) / total).alias("pr_auc"))


def best_threshold(scored: DataFrame, thresholds: list[float]) -> DataFrame:
    """The threshold of the best F1, then recall, then the lowest.

    Rows are counted by how many thresholds their score reaches, so the thresholds meet a few counts, not all rows."""
    grid = sorted(thresholds)
    reached = F.size(F.filter(F.array(*map(F.lit, grid)), lambda t: t <= F.col("score")))
    counts = scored.groupBy(reached.alias("reached")).agg(F.sum("actual").alias("yes"), F.count("*").alias("n"))
    every = F.posexplode(F.array(*map(F.lit, grid))).alias("at", "threshold")
    each = counts.select("reached", "yes", "n", every).withColumn("hit", F.col("reached") > F.col("at"))
    tp, hits, yes = F.sum(F.when(F.col("hit"), F.col("yes")).otherwise(0)), F.sum(F.when(F.col("hit"), F.col("n")).otherwise(0)), F.sum("yes")
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    found = each.groupBy("threshold").agg(ratio(tp, hits).alias("precision"), ratio(tp, yes).alias("recall"), ratio(2 * tp, hits + yes).alias("f1"))
    return found.orderBy(F.desc("f1"), F.desc("recall"), "threshold").limit(1)
