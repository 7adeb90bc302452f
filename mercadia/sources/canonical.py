"""The canonical retail tables, adapted from the given ones. Derived columns are invented here, alike for plans and SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercadia.functions.columns import MONEY, money

#: The status that plays the cancelled one.
CANCELLED = "P"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = money("p_retailprice")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("product_id"), F.col("p_name").alias("product_name"), F.col("p_type").alias("category"), F.col("p_brand").alias("brand"),
        price.alias("unit_price"), (price * F.lit("0.60").cast("decimal(3,2)")).cast(MONEY).alias("unit_cost"),
        ((F.col("p_partkey") * 37) % 501).alias("stock_quantity"), (5 + F.col("p_size") % 46).cast("bigint").alias("minimum_stock"),
        (F.col("p_partkey") % 5 != 0).alias("is_active"),
    )


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    place = nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", F.col("n_name").alias("state"), F.col("r_name").alias("region"))
    c = table(spark, sf_dir, "customer")
    return c.join(place, c.c_nationkey == place.n_nationkey).select(
        F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("full_name"), "state", "region", F.col("c_mktsegment").alias("customer_segment"),
        (F.col("c_acctbal") > 0).alias("is_active"),
    )


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"), F.to_date("o_orderdate").alias("order_date"),
        F.col("o_orderstatus").alias("order_status"), F.col("o_orderpriority").alias("sales_channel"),
        F.lit(0).cast(MONEY).alias("shipping_cost"), F.lit(0).cast(MONEY).alias("discount_amount"), money("o_totalprice").alias("order_total"),
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    gross = money("l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("order_item_id"), F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("product_id"), F.col("l_quantity").cast("bigint").alias("quantity"), gross.alias("gross"),
        (F.col("l_discount").cast("decimal(4,2)") * 100).cast("decimal(6,2)").alias("discount_percentage"),
        (gross * (1 - F.col("l_discount").cast("decimal(4,2)"))).cast(MONEY).alias("line_total"), F.to_date("l_shipdate").alias("ship_date"),
    )


#: The same tables for DuckDB, as common table expressions.
SQL = """
products AS (
  SELECT p_partkey AS product_id, p_name AS product_name, p_type AS category, p_brand AS brand, CAST(p_retailprice AS DECIMAL(18,2)) AS unit_price,
    CAST(CAST(p_retailprice AS DECIMAL(18,2)) * 0.60 AS DECIMAL(18,2)) AS unit_cost, (p_partkey * 37) % 501 AS stock_quantity,
    CAST(5 + p_size % 46 AS BIGINT) AS minimum_stock, p_partkey % 5 <> 0 AS is_active FROM part),
customers AS (
  SELECT c_custkey AS customer_id, c_name AS full_name, n_name AS state, r_name AS region, c_mktsegment AS customer_segment, c_acctbal > 0 AS is_active
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
sales_orders AS (
  SELECT o_orderkey AS order_id, o_custkey AS customer_id, CAST(o_orderdate AS DATE) AS order_date, o_orderstatus AS order_status, o_orderpriority AS sales_channel,
    CAST(0 AS DECIMAL(18,2)) AS shipping_cost, CAST(0 AS DECIMAL(18,2)) AS discount_amount, CAST(o_totalprice AS DECIMAL(18,2)) AS order_total FROM orders),
items AS (
  SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS order_item_id, l_orderkey AS order_id, l_partkey AS product_id,
    CAST(l_quantity AS BIGINT) AS quantity, CAST(l_extendedprice AS DECIMAL(18,2)) AS gross, CAST(CAST(l_discount AS DECIMAL(4,2)) * 100 AS DECIMAL(6,2)) AS discount_percentage,
    CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(18,2)) AS line_total, CAST(l_shipdate AS DATE) AS ship_date FROM lineitem)"""
