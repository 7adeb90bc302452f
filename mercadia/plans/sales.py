"""Sales models: staging, enriched items and orders, dimensions, the fact and three marts (M1 to M8).

Every builder takes canonical DataFrames and returns one, so a chain of them is a single plan. Order items and
orders meet once, on order_id; marts aggregate before they join, so no join multiplies rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercadia.functions.columns import MONEY, average_money, money


def enriched_items(items: DataFrame, products: DataFrame) -> DataFrame:
    """M2: items with their product and line amounts."""
    p = products.select("product_id", "product_name", "category", "unit_price", "unit_cost")
    cost = (F.col("quantity") * F.col("unit_cost")).cast(MONEY)
    return items.join(p, "product_id").select(
        "order_item_id", "order_id", "product_id", "product_name", "category", "quantity", "unit_price", "unit_cost", "discount_percentage",
        money("gross").alias("line_gross_amount"), money(F.col("gross") - F.col("line_total")).alias("line_discount_amount"), "line_total",
        cost.alias("line_cost_amount"), money(F.col("line_total") - cost).alias("line_margin_before_order_discount"),
    )


def enriched_orders(orders: DataFrame, customers: DataFrame, enriched: DataFrame) -> DataFrame:
    """M3: orders with their customer and sums over their items; orders without items are left out."""
    # dealt by order once: a distinct count would deal every item by order and product, and again by order, with all its sums
    narrow = enriched.select("order_id", "product_id", "quantity", "line_gross_amount", "line_discount_amount", "line_total", "line_cost_amount")
    per_order = narrow.repartition("order_id").groupBy("order_id").agg(
        F.count("*").alias("order_item_count"), F.sum("quantity").alias("item_quantity"), F.count_distinct("product_id").alias("distinct_products"),
        money(F.sum("line_gross_amount")).alias("gross_amount"), money(F.sum("line_discount_amount")).alias("item_discount_amount"),
        money(F.sum("line_total")).alias("items_net_amount"), money(F.sum("line_cost_amount")).alias("item_cost_amount"),
    )
    who = customers.select("customer_id", F.col("full_name").alias("customer_name"), F.col("state").alias("customer_state"), F.col("region").alias("customer_region"))
    both = orders.join(who, "customer_id").join(per_order, "order_id")
    return both.select(
        "order_id", "customer_id", "customer_name", "customer_state", "customer_region", "order_date", "order_status", "sales_channel",
        "order_item_count", "item_quantity", "distinct_products", "gross_amount", "item_discount_amount", "items_net_amount", "item_cost_amount",
        "shipping_cost", F.col("discount_amount").alias("order_discount_amount"),
        money(F.col("item_discount_amount") + F.col("discount_amount")).alias("total_discount_amount"), "order_total",
    )


def dim_products(products: DataFrame) -> DataFrame:
    """M4: products with a two-way stock status."""
    low = F.col("stock_quantity") <= F.col("minimum_stock")
    return products.withColumn("stock_status", F.when(low, "below_minimum").otherwise("adequate"))


def fct_sales(enriched: DataFrame, orders: DataFrame, cancelled: str) -> DataFrame:
    """M5: one row an item with its order's columns; cancelled ones stay, flagged. Order amounts repeat on every item
    of an order and must not be summed here (J3, P16)."""
    o = orders.select(
        "order_id", "customer_id", "order_date", "order_status", F.col("shipping_cost").alias("order_shipping_cost"),
        F.col("discount_amount").alias("order_discount_amount"), "order_total",
    )
    return enriched.join(o, "order_id").select(
        "order_item_id", "order_id", "customer_id", "product_id", "order_date", "order_status", (F.col("order_status") != cancelled).alias("is_realized_sale"),
        "quantity", "unit_price", "unit_cost", "discount_percentage", "line_gross_amount", "line_discount_amount", F.col("line_total").alias("item_total"),
        "line_cost_amount", "line_margin_before_order_discount", "order_shipping_cost", "order_discount_amount", "order_total",
    )


def mart_daily_sales(fact: DataFrame, enriched_orders_: DataFrame, cancelled: str) -> DataFrame:
    """M6: a row a day with a sale; item money from items, order money from orders."""
    by_item = fact.where("is_realized_sale").groupBy(F.col("order_date").alias("sales_date")).agg(
        F.sum("quantity").alias("total_items_sold"), F.count_distinct("product_id").alias("distinct_products"),
        money(F.sum("line_gross_amount")).alias("gross_revenue"), money(F.sum("line_discount_amount")).alias("item_discount_amount"),
        money(F.sum("item_total")).alias("item_revenue_before_order_discount"),
    )
    n, total = F.count("*"), F.sum("order_total")
    by_order = enriched_orders_.where(F.col("order_status") != cancelled).groupBy(F.col("order_date").alias("sales_date")).agg(
        n.alias("total_orders"), F.count_distinct("customer_id").alias("unique_customers"), money(F.sum("shipping_cost")).alias("shipping_amount"),
        money(F.sum("order_discount_amount")).alias("order_discount_amount"), money(total).alias("total_revenue"), average_money(total, n).alias("average_order_value"),
    )
    return by_order.join(by_item, "sales_date").select(
        "sales_date", "total_orders", "unique_customers", "total_items_sold", "distinct_products", "gross_revenue", "item_discount_amount", "order_discount_amount",
        money(F.col("item_discount_amount") + F.col("order_discount_amount")).alias("total_discount_amount"), "item_revenue_before_order_discount",
        "shipping_amount", "total_revenue", "average_order_value",
    )


def reference_date(sales: DataFrame, realised) -> DataFrame:
    """One row with the last day of a realised sale."""
    return sales.where(realised).agg(F.max("order_date").alias("sales_reference_date"))


def mart_product_performance(products: DataFrame, fact: DataFrame) -> DataFrame:
    """M7: lifetime and last 30 days a product, and a three-way stock risk.

    Both sums come from one pass over the fact: the day bound is a one-row broadcast."""
    ref = reference_date(fact, F.col("is_realized_sale"))
    recent = F.col("order_date").between(F.date_sub("sales_reference_date", 29), F.col("sales_reference_date"))
    sold = fact.where("is_realized_sale").crossJoin(F.broadcast(ref)).groupBy("product_id").agg(
        F.count_distinct("order_id").alias("total_orders"), F.sum("quantity").alias("total_items_sold"), F.count_distinct("customer_id").alias("unique_customers"),
        money(F.sum("item_total")).alias("item_revenue_before_order_discount"), money(F.sum("line_cost_amount")).alias("item_cost_amount"),
        money(F.sum("line_margin_before_order_discount")).alias("margin_before_order_discount"),
        F.coalesce(F.sum(F.when(recent, F.col("quantity"))), F.lit(0)).alias("items_sold_last_30_days"),
    )
    zero = {c: 0 for c in ("total_orders", "total_items_sold", "unique_customers", "items_sold_last_30_days")}
    moneys = ("item_revenue_before_order_discount", "item_cost_amount", "margin_before_order_discount")
    joined = products.join(sold, "product_id", "left").crossJoin(F.broadcast(ref)).fillna(zero)
    last = F.col("items_sold_last_30_days")
    risk = F.when(F.col("stock_quantity") <= F.col("minimum_stock"), "below_minimum").when((last >= F.col("stock_quantity")) & (last > 0), "at_risk").otherwise("adequate")
    return joined.select(
        "product_id", "product_name", "category", "total_orders", "total_items_sold", "unique_customers",
        *(F.coalesce(c, F.lit(0).cast(MONEY)).alias(c) for c in moneys), F.col("stock_quantity").alias("current_stock_quantity"), "minimum_stock",
        "items_sold_last_30_days", "sales_reference_date", "is_active", risk.alias("stock_risk_status"),
    )


def mart_customer_metrics(customers: DataFrame, enriched_orders_: DataFrame, cancelled: str) -> DataFrame:
    """M8: purchases a customer; recency counts to the last sale day, not to today."""
    realised = F.col("order_status") != cancelled
    ref = reference_date(enriched_orders_, realised)
    n, total = F.count("*"), F.sum("order_total")
    bought = enriched_orders_.where(realised).groupBy("customer_id").agg(
        n.alias("total_orders"), F.sum("item_quantity").alias("total_items_purchased"), money(total).alias("total_spend"),
        average_money(total, n).alias("average_order_value"), F.min("order_date").alias("first_purchase_date"), F.max("order_date").alias("last_purchase_date"),
    )
    return customers.crossJoin(F.broadcast(ref)).join(bought, "customer_id", "left").select(
        "customer_id", "full_name", "state", "region", "customer_segment", "is_active",
        *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total_orders", "total_items_purchased")), F.coalesce("total_spend", F.lit(0).cast(MONEY)).alias("total_spend"),
        F.coalesce("average_order_value", F.lit(0.0)).alias("average_order_value"), "first_purchase_date", "last_purchase_date",
        F.date_diff("sales_reference_date", "last_purchase_date").alias("days_since_last_purchase"), "sales_reference_date",
    )


#: The models for DuckDB; they follow the canonical tables.
SQL = """
enriched_items AS (
  SELECT order_item_id, order_id, i.product_id, product_name, category, quantity, unit_price, unit_cost, discount_percentage, gross AS line_gross_amount,
    CAST(gross - line_total AS DECIMAL(18,2)) AS line_discount_amount, line_total, CAST(quantity * unit_cost AS DECIMAL(18,2)) AS line_cost_amount,
    CAST(line_total - CAST(quantity * unit_cost AS DECIMAL(18,2)) AS DECIMAL(18,2)) AS line_margin_before_order_discount
  FROM items i JOIN products p ON i.product_id = p.product_id),
enriched_orders AS (
  SELECT o.order_id, o.customer_id, full_name AS customer_name, state AS customer_state, region AS customer_region, order_date, order_status, sales_channel,
    order_item_count, item_quantity, distinct_products, gross_amount, item_discount_amount, items_net_amount, item_cost_amount, shipping_cost,
    discount_amount AS order_discount_amount, CAST(item_discount_amount + discount_amount AS DECIMAL(18,2)) AS total_discount_amount, order_total
  FROM sales_orders o JOIN customers c ON o.customer_id = c.customer_id
  JOIN (SELECT order_id, count(*) AS order_item_count, CAST(sum(quantity) AS BIGINT) AS item_quantity, count(DISTINCT product_id) AS distinct_products,
      CAST(sum(line_gross_amount) AS DECIMAL(18,2)) AS gross_amount, CAST(sum(line_discount_amount) AS DECIMAL(18,2)) AS item_discount_amount,
      CAST(sum(line_total) AS DECIMAL(18,2)) AS items_net_amount, CAST(sum(line_cost_amount) AS DECIMAL(18,2)) AS item_cost_amount
    FROM enriched_items GROUP BY order_id) m ON o.order_id = m.order_id),
fact AS (
  SELECT order_item_id, i.order_id, customer_id, product_id, order_date, order_status, order_status <> 'P' AS is_realized_sale, quantity, unit_price, unit_cost,
    discount_percentage, line_gross_amount, line_discount_amount, line_total AS item_total, line_cost_amount, line_margin_before_order_discount,
    shipping_cost AS order_shipping_cost, discount_amount AS order_discount_amount, order_total
  FROM enriched_items i JOIN sales_orders o ON i.order_id = o.order_id)"""
