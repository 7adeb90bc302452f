"""Profiles of the sales series (E1 to E12). All take product-day sales (product_id, date, quantity_sold, revenue)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mercadia.operators import quality
from mercadia.operators.demand import bounds


def _days(sales: DataFrame) -> DataFrame:
    """Units of every calendar day between the bounds, zero where nothing was sold."""
    day = F.explode(F.sequence("first_day", "last_day", F.expr("interval 1 day"))).alias("date")
    sold = sales.groupBy("date").agg(F.sum("quantity_sold").alias("q"))
    return bounds(sales).select("first_day", day).join(sold, "date", "left").select("date", "first_day", F.coalesce("q", F.lit(0.0)).alias("q"))


def coverage(sales: DataFrame) -> DataFrame:
    """E1."""
    n = F.date_diff("last_day", "first_day") + 1
    found = sales.agg(F.min("date").alias("first_day"), F.max("date").alias("last_day"), F.count_distinct("date").alias("sale_days"))
    return found.select("first_day", "last_day", n.alias("calendar_days"), "sale_days", (n - F.col("sale_days")).alias("empty_days"))


def gaps(sales: DataFrame) -> DataFrame:
    """Runs of days without a sale between a product's sales, and the longest."""
    before = F.lag("date").over(Window.partitionBy("product_id").orderBy("date"))
    each = sales.select("product_id", (F.date_diff("date", before) - 1).alias("gap"))
    return each.groupBy("product_id").agg(F.count_if(F.col("gap") > 0).alias("gaps"), F.max("gap").alias("longest_gap"))


def daily_distribution(sales: DataFrame) -> DataFrame:
    """Of all days and of days with a sale."""
    days = _days(sales)
    parts = days.select(F.lit("all_days").alias("part"), "q").unionByName(days.where("q > 0").select(F.lit("sale_days").alias("part"), "q"))
    p = lambda x: F.percentile("q", F.lit(x))
    return parts.groupBy("part").agg(F.avg("q").alias("mean"), p(0.5).alias("median"), p(0.9).alias("p90"), p(0.99).alias("p99"), F.max("q").alias("most"))


def product_sale_days(sales: DataFrame) -> DataFrame:
    """E4."""
    n = sales.groupBy("product_id").agg(F.count("*").alias("n"))
    p = lambda x: F.percentile("n", F.lit(x))
    return n.agg(
        F.min("n").alias("least"), p(0.25).alias("q1"), p(0.5).alias("median"), p(0.75).alias("q3"), p(0.9).alias("p90"), F.max("n").alias("most"),
        F.count_if(F.col("n") < 28).alias("under_28"), F.count_if(F.col("n") < 52).alias("under_52"),
    )


def concentration(sales: DataFrame, tops: tuple[int, ...] = (1, 5, 10, 20)) -> DataFrame:
    """E5: share of units of the top products. Only the largest top is put in order."""
    n = sales.groupBy("product_id").agg(F.sum("quantity_sold").alias("q"))
    top = n.orderBy(F.desc("q"), "product_id").limit(max(tops)).withColumn("r", F.row_number().over(Window.orderBy(F.desc("q"), "product_id")))
    total = n.agg(F.sum("q").alias("total"))
    ks = F.explode(F.array(*map(F.lit, tops))).alias("k")
    return top.select("q", "r", ks).where("r <= k").groupBy("k").agg(F.sum("q").alias("q")).crossJoin(F.broadcast(total)).select("k", (F.col("q") / F.col("total")).alias("share"))


def weekday_index(sales: DataFrame) -> DataFrame:
    """Mean day = 100; Monday is 0."""
    days = _days(sales)
    mean = days.agg(F.avg("q").alias("mean"))
    return days.groupBy(F.weekday("date").alias("weekday")).agg(F.avg("q").alias("q")).crossJoin(F.broadcast(mean)).select("weekday", (100 * F.col("q") / F.col("mean")).alias("weekday_index"))


def monthly_index(sales: DataFrame) -> DataFrame:
    """Months against the mean month of their year, over complete months, averaged by month."""
    whole = (F.trunc("date", "month") >= F.col("first_day")) & (F.last_day("date") <= F.col("last_day"))
    months = sales.crossJoin(F.broadcast(bounds(sales))).where(whole).groupBy(F.year("date").alias("y"), F.month("date").alias("month")).agg(F.sum("quantity_sold").alias("q"))
    return months.withColumn("mean", F.avg("q").over(Window.partitionBy("y"))).groupBy("month").agg(F.avg(100 * F.col("q") / F.col("mean")).alias("month_index"))


def trend(sales: DataFrame) -> DataFrame:
    """E8."""
    days = _days(sales).select(F.date_diff("date", "first_day").cast("double").alias("t"), "q")
    return days.agg(F.regr_slope("q", "t").alias("slope_per_day"), F.corr("q", "t").alias("correlation"))


def outliers(sales: DataFrame) -> DataFrame:
    """Days over the upper quartile by more than 1.5 quartile distances."""
    days = sales.groupBy("date").agg(F.sum("quantity_sold").alias("units"), F.sum("revenue").cast("double").alias("revenue")).unpivot("date", ["units", "revenue"], "measure", "x")
    q = days.groupBy("measure").agg(F.percentile("x", F.lit(0.25)).alias("q1"), F.percentile("x", F.lit(0.75)).alias("q3"))
    limit = F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    return days.join(F.broadcast(q.select("measure", limit.alias("upper_limit"))), "measure").groupBy("measure").agg(F.max("upper_limit").alias("upper_limit"), F.count_if(F.col("x") > F.col("upper_limit")).alias("outlier_days"))


def recent_demand(sales: DataFrame, products: DataFrame, spans: tuple[int, ...] = (7, 14, 30)) -> DataFrame:
    """Units of the last days, products without a sale in them, and products that sold their stock or more."""
    last = F.broadcast(bounds(sales).select("last_day"))
    near = lambda k: F.coalesce(F.sum(F.when(F.col("date") > F.date_sub("last_day", k), F.col("quantity_sold"))), F.lit(0.0)).alias(str(k))
    sold = sales.crossJoin(last).groupBy("product_id").agg(*map(near, spans))
    all_ = products.select("product_id", "stock_quantity").join(sold, "product_id", "left").fillna(0.0, [str(k) for k in spans])
    each = all_.unpivot(["product_id", "stock_quantity"], [str(k) for k in spans], "days", "d")
    return each.groupBy(F.col("days").cast("int").alias("days")).agg(F.sum("d").alias("units"), F.count_if(F.col("d") == 0).alias("without_sale"), F.count_if(F.col("d") >= F.col("stock_quantity")).alias("at_or_over_stock"))


def fold_summary(realised: DataFrame, folds: DataFrame) -> DataFrame:
    """What each evaluation window holds."""
    inside = realised.join(F.broadcast(folds), F.col("order_date").between(F.col("val_start"), F.col("val_end")))  # a row a fold
    return inside.groupBy("split").agg(
        F.count_distinct("order_date").alias("sale_days"), F.count_distinct("order_id").alias("orders"), F.sum("quantity").alias("units"), F.count_distinct("product_id").alias("products")
    )


def zero_rate(sales: DataFrame, products: DataFrame) -> DataFrame:
    """One row: days, products, cells of the dense grid, those without a sale and their share. Sales are one row a
    product and day, so cells are counted from them and the grid is not made. Without sales there are no days; the share
    is null without cells."""
    sold = sales.join(products.select("product_id"), "product_id", "left_semi").where("quantity_sold <> 0").agg(F.count("*").alias("sold"))
    days = bounds(sales).select(F.coalesce(F.date_diff("last_day", "first_day") + 1, F.lit(0)).cast("long").alias("days"))
    every = products.agg(F.count_distinct("product_id").alias("products"))
    one = days.crossJoin(every).crossJoin(sold)  # one row each
    cells = F.col("days") * F.col("products")
    return one.select("days", "products", cells.alias("cells"), (cells - F.col("sold")).alias("zero_cells"), F.try_divide((cells - F.col("sold")).cast("double"), cells.cast("double")).alias("zero_rate"))


def audit(fact: DataFrame, daily: DataFrame, products: DataFrame, orders: DataFrame, required: Sequence[str], ranges: Sequence[quality.Rule]) -> DataFrame:
    """What keeps the fact from being trusted, a row a check with the rows it looked at: repeated keys of the fact, the
    daily mart and the products; required values that are missing, of the fact's columns and of all of the products';
    values out of range; items of unknown products and orders; units in which fact and daily mart differ; items sold
    before their product was made, and realised items of inactive products.

    fact: order_item_id, order_id, product_id, order_date, is_realized_sale, quantity; products: product_id, created_at,
    is_active. A product or order that is repeated counts an item once; a null key is missing, not unknown."""
    flags = products.groupBy("product_id").agg(F.min("created_at").alias("_made"), F.bool_or("is_active").alias("_active"), F.lit(True).alias("_known"))
    realised = F.coalesce(F.col("is_realized_sale"), F.lit(False))
    count = lambda x: F.count_if(F.coalesce(x, F.lit(False))).alias("violations")
    any_null = lambda columns: F.expr(" OR ".join(f"{x} IS NULL" for x in columns))
    out_of_range = F.lit(False)
    for rule in ranges:
        out_of_range = out_of_range | F.coalesce(rule.breaks, F.lit(False))
    # only what a check needs goes to its join: a product's checks see keys and days, an order's the counts of its id
    sold = fact.select("product_id", "order_date", realised.alias("_realised")).join(flags, "product_id", "left")
    placed = fact.groupBy("order_id").agg(F.count("*").alias("_items")).join(orders.select("order_id", F.lit(True).alias("_ordered")).distinct(), "order_id", "left")
    passes = [
        (fact, {"null_in_fact": any_null(required), "out_of_range": out_of_range}),
        (sold, {"unknown_product": F.col("product_id").isNotNull() & F.col("_known").isNull(), "sold_before_creation": F.col("order_date") < F.col("_made"), "inactive_realised": F.col("_realised") & ~F.col("_active")}),
    ]
    own, of_product = (df.agg(*(count(x).alias(n) for n, x in found.items()), *more) for (df, found), more in zip(
        passes, ([F.count("*").alias("n"), F.count_if(realised).alias("realised"), F.sum(F.when(realised, F.col("quantity"))).alias("units")], []), strict=True))
    unknown = F.when(F.col("order_id").isNotNull() & F.col("_ordered").isNull(), F.col("_items"))
    sums = own.crossJoin(of_product).crossJoin(placed.agg(F.coalesce(F.sum(unknown), F.lit(0)).alias("unknown_order")))  # one row each
    checks = ("null_in_fact", "out_of_range", "unknown_product", "unknown_order", "sold_before_creation", "inactive_realised")
    mart = daily.agg(F.sum("total_items_sold").alias("mart_units"), F.count("*").alias("mart_days"))
    row = lambda name, violations, rows: F.struct(F.lit(name).alias("check"), violations.cast("long").alias("violations"), rows.cast("long").alias("rows_checked"))
    zero = F.lit(0)
    each = [row(n, F.col(n), F.col("realised" if n == "inactive_realised" else "n")) for n in checks]
    each.append(row("units_fact_to_daily", F.abs(F.coalesce("units", zero) - F.coalesce("mart_units", zero)), F.col("mart_days")))
    parts = [sums.crossJoin(mart).select(F.inline(F.array(*each)))]  # one row each
    for df, name, key in ((fact, "repeated_in_fact", "order_item_id"), (daily, "repeated_in_daily", "sales_date"), (products, "repeated_in_products", "product_id")):
        keys = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
        parts.append(keys.agg(F.lit(name).alias("check"), F.count_if(F.col("n") > 1).alias("violations"), F.coalesce(F.sum("n"), zero).cast("long").alias("rows_checked")))
    parts.append(products.agg(F.lit("null_in_products").alias("check"), count(any_null(products.columns)), F.count("*").alias("rows_checked")))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found
