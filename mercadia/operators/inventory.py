"""Stock risk from forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: From the most to the least urgent.
RISK_ORDER = ("critical", "high_risk", "attention", "adequate", "potential_overstock")


def classify_risk(forecast: DataFrame, products: DataFrame, horizon: int = 14, by: tuple[str, ...] = ()) -> DataFrame:
    """Projected stock, coverage and risk class of active products over a horizon, by the given columns too.

    Coverage is infinite without demand. A product whose forecast lacks a day of the horizon has complete = false and
    no class; products without any forecast are left out."""
    demand = forecast.where(F.col("horizon_day") <= horizon).groupBy(*by, "product_id").agg(
        F.sum("predicted_quantity").alias("forecast_demand"), (F.count_distinct("horizon_day") == horizon).alias("complete")
    )
    active = products.where("is_active").select("product_id", "stock_quantity", "minimum_stock")
    stock, least, d = F.col("stock_quantity"), F.col("minimum_stock"), F.col("forecast_demand")
    left, cover = stock - d, F.when(d > 0, horizon * stock / d).otherwise(float("inf"))
    risk = (
        F.when((stock <= 0) | (left <= 0), "critical").when(left <= least, "high_risk").when(cover < 2 * horizon, "attention")
        .when((d == 0) | (cover > 3 * horizon), "potential_overstock").otherwise("adequate")
    )
    out = active.join(demand.hint("merge"), "product_id").withColumns({"projected_stock": left, "coverage_days": cover, "risk_class": F.when(F.col("complete"), risk)})
    rank = F.array_position(F.array(*map(F.lit, RISK_ORDER)), F.col("risk_class")).cast("int")
    return out.withColumn("risk_rank", rank)


def risk_scenarios(risk: DataFrame, champion: str) -> DataFrame:
    """R2: each model's class beside the champion's."""
    base = risk.where(F.col("model_name") == champion).select("product_id", F.col("risk_class").alias("champion_risk_class"))
    return risk.join(base, "product_id", "left").withColumn("changed", ~F.col("risk_class").eqNullSafe(F.col("champion_risk_class")))


def official_risk(risk: DataFrame, products: DataFrame, horizon: int = 14) -> DataFrame:
    """With product names, average daily demand, and coverage null where it is infinite."""
    cover = F.when(F.col("coverage_days") != float("inf"), F.col("coverage_days"))
    named = risk.join(products.select("product_id", "product_name", "category").hint("merge"), "product_id", "left")
    return named.withColumns({"average_daily_demand": F.col("forecast_demand") / horizon, "estimated_coverage_days": cover, "risk_level": F.col("risk_class"), "horizon_days": F.lit(horizon)})
