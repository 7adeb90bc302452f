"""Registered queries of the quality rules, the clean-up functions, publication and profiles."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercadia.functions import columns as fn
from mercadia.operators import demand, publish, quality
from mercadia.operators.inventory import RISK_ORDER
from mercadia.operators.quality import Rule, ShareRule
from mercadia.plans import profile, sales, schema_tests
from mercadia.queries_demand import _CUBES, _FOLDS, _RISK, _SERIES, aggregate, official_risk, rounded, series
from mercadia.queries_sales import _MODELS, _WITH, DAILY_SQL, customer_mart, daily_mart, doubled, enriched_items, enriched_orders, fact, product_mart
from mercadia.queries_sales import SQL as SALES_SQL
from mercadia.sources import canonical as c
from mercadia.sources import layers
from mercadia.sources.layers import scratch

STATUSES = ("F", "O")
CATEGORIES = ("ECONOMY", "STANDARD", "PROMO")


def text_normalize(s: SparkSession, d: str) -> DataFrame:
    """P3, P4 on names padded with white space."""
    dirty = F.concat(F.lit(" \t"), F.regexp_replace("c_name", "#", "   # "), F.lit("  "))
    clean = fn.clean_text(dirty)
    return c.table(s, d, "customer").select("c_custkey", clean.alias("name"), F.lower(clean).alias("lower_name"), F.upper(fn.clean_text(F.col("c_mktsegment"))).alias("segment"), fn.clean_text(F.lit(" \n ")).alias("nothing"))


def boolean_parse(s: SparkSession, d: str) -> DataFrame:
    raw = F.element_at(F.array(*map(F.lit, ("TRUE ", " false", "1", "0", "yes"))), (F.col("c_custkey") % 5 + 1).cast("int"))
    return c.table(s, d, "customer").select("c_custkey", fn.parse_boolean(raw).alias("strict"), fn.parse_boolean(raw, digits=True).alias("with_digits"))


def snake_case_columns(s: SparkSession, d: str) -> DataFrame:
    """Renamed, expected columns first."""
    part = c.table(s, d, "part").withColumnsRenamed({"p_partkey": "Part Key", "p_name": "PartName", "p_size": "SIZE--of part"})
    named = part.toDF(*(fn.snake_case(n) for n in part.columns))
    return named.select("part_key", "part_name", "size_of_part", "p_brand", "p_type", "p_retailprice")


def ages(s: SparkSession, d: str) -> DataFrame:
    """P22, P23 over order days: completed years on a fixed day, and the same day 18 years on."""
    day = F.to_date("o_orderdate")
    return c.table(s, d, "orders").select("o_orderkey", fn.age_on(day, F.lit("2026-02-28").cast("date")).alias("years"), fn.shift_years(day, 18).alias("shifted"))


def row_rules(s: SparkSession, d: str) -> DataFrame:
    """Q5, Q13, Q17, Q18, Q19, Q22: every table in one pass."""
    p, i, o = c.products(s, d), c.items(s, d), c.orders(s, d)
    dated = i.join(o.select("order_id", "order_date", "order_status"), "order_id")
    exact = (F.col("gross") * (100 - F.col("discount_percentage")) / 100).cast(fn.MONEY)
    return quality.report(
        quality.row_rules(p, "products", [
            Rule("price_positive", F.col("unit_price") <= 0), Rule("cost_below_price", F.col("unit_cost") >= F.col("unit_price")),
            Rule("stock_range", ~F.col("stock_quantity").between(0, 500)), Rule("minimum_stock_range", ~F.col("minimum_stock").between(5, 50)),
        ], [ShareRule("active_share", F.col("is_active"), 0.5)]),
        quality.row_rules(i, "order_items", [
            Rule("quantity_range", ~F.col("quantity").between(1, 5)), Rule("discount_range", ~F.col("discount_percentage").between(0, 30)), Rule("line_total_exact", F.col("line_total") != exact),
        ]),
        quality.row_rules(o, "orders", [Rule("money_not_negative", (F.col("shipping_cost") < 0) | (F.col("discount_amount") < 0)), Rule("total_positive", (F.col("order_total") <= 0) & (F.col("order_status") != c.CANCELLED))],
                          [ShareRule("delivered_share", F.col("order_status") == "F", 0.5)]),
        quality.row_rules(dated, "deliveries", [Rule("not_before_order", F.col("ship_date") < F.col("order_date")), Rule("cancelled_has_none", (F.col("order_status") == c.CANCELLED) & F.col("ship_date").isNotNull())]),
    )


def required_nulls(s: SparkSession, d: str) -> DataFrame:
    tables = {"products": c.products(s, d), "customers": c.customers(s, d), "orders": c.orders(s, d), "order_items": c.items(s, d)}
    return quality.report(*(quality.row_rules(t, n, quality.not_null(t.columns)) for n, t in tables.items()))


def duplicate_keys(s: SparkSession, d: str) -> DataFrame:
    """Q3, Q27: repeated item keys, with counts."""
    return quality.duplicates(c.items(s, d).withColumn("line", F.substring_index("order_item_id", "-", -1)), ["order_id", "line"])


def foreign_keys(s: SparkSession, d: str) -> DataFrame:
    p, i, o, cu = c.products(s, d), c.items(s, d), c.orders(s, d), c.customers(s, d)
    none = quality.orphans(o, "order_id", i, "order_id")
    return quality.report(
        quality.as_rule(quality.orphans(o, "customer_id", cu, "customer_id"), "orders", "customer_id"),
        quality.as_rule(quality.orphans(i, "order_id", o, "order_id"), "order_items", "order_id"),
        quality.as_rule(quality.orphans(i, "product_id", p, "product_id"), "order_items", "product_id"),
        quality.as_rule(none, "orders", "has_items"),
    )


def accepted_values(s: SparkSession, d: str) -> DataFrame:
    return quality.report(
        quality.row_rules(c.orders(s, d), "orders", [quality.accepted("order_status", STATUSES)]),
        quality.row_rules(c.products(s, d), "products", [quality.accepted("category", CATEGORIES)]),
    )


def regex_rules(s: SparkSession, d: str) -> DataFrame:
    """F6, Q3, Q8."""
    names = [Rule("name_pattern", ~fn.full_match(F.col("full_name"), r"Customer#\d{9}")), Rule("lower_case", F.col("full_name") != F.lower("full_name"))]
    brands = [Rule("brand_pattern", ~fn.full_match(F.col("brand"), r"Brand#1\d?"))]
    return quality.report(quality.row_rules(c.customers(s, d), "customers", names), quality.row_rules(c.products(s, d), "products", brands))


def place_coherence(s: SparkSession, d: str) -> DataFrame:
    """Q11: customers whose region is not that of their state in the table of places; some regions are spoilt first."""
    nation, region = c.table(s, d, "nation"), c.table(s, d, "region")
    places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("state"), F.col("r_name").alias("expected_region"))
    spoilt = F.when(F.col("customer_id") % 11 == 0, F.lit("ASIA")).otherwise(F.col("region"))
    return c.customers(s, d).withColumn("region", spoilt).join(F.broadcast(places), "state").where("region <> expected_region").groupBy("state", "region", "expected_region").agg(F.count("*").alias("customers"))


def daily_reconcile(s: SparkSession, d: str) -> DataFrame:
    """Q28: the daily mart against a computation of its own from the fact and the orders, in eleven columns; one side is
    spoilt so that it finds something: item revenue on 31sts gets a cent more than allowed."""
    sold, bought = fact(s, d).where("is_realized_sale"), enriched_orders(s, d).where(F.col("order_status") != c.CANCELLED)
    off = F.when(F.dayofmonth("sales_date") == 31, F.lit("0.02").cast(fn.MONEY)).otherwise(F.lit(0).cast(fn.MONEY))
    by_item = sold.groupBy(F.col("order_date").alias("sales_date")).agg(
        F.sum("quantity").alias("total_items_sold"), F.count_distinct("product_id").alias("distinct_products"), F.sum("line_gross_amount").alias("gross_revenue"),
        F.sum("line_discount_amount").alias("item_discount_amount"), F.sum("item_total").alias("item_revenue_before_order_discount"),
    ).withColumn("item_revenue_before_order_discount", F.col("item_revenue_before_order_discount") + off)
    by_order = bought.groupBy(F.col("order_date").alias("sales_date")).agg(
        F.count("*").alias("total_orders"), F.count_distinct("customer_id").alias("unique_customers"), F.sum("shipping_cost").alias("shipping_amount"),
        F.sum("order_discount_amount").alias("order_discount_amount"), F.sum("order_total").alias("total_revenue"), F.round(F.avg("order_total"), 2).alias("average_order_value"),
    )
    columns = [x for x in (*by_order.columns, *by_item.columns) if x != "sales_date"]
    return quality.reconcile(daily_mart(s, d), by_order.join(by_item, "sales_date"), ["sales_date"], columns).select("sales_date")


def order_total_reconcile(s: SparkSession, d: str) -> DataFrame:
    """Orders whose total is not that of their items, or that have none."""
    sums = c.items(s, d).groupBy("order_id").agg(fn.money(F.sum("line_total")).alias("items_total"))
    expected = F.col("items_total") + F.col("shipping_cost") - F.col("discount_amount")
    bad = c.orders(s, d).join(sums, "order_id", "left").where(F.col("items_total").isNull() | (F.abs(F.col("order_total") - expected) > 0.01))
    return doubled(bad.select("order_id", "order_total", "items_total"))


def non_negative_money(s: SparkSession, d: str) -> DataFrame:
    """One pass a table."""
    def rules(*names: str) -> list[Rule]:
        return [Rule(f"non_negative:{n}", F.col(n) < 0) for n in names]

    e = enriched_items(s, d)
    return quality.report(
        quality.row_rules(c.orders(s, d), "orders", rules("shipping_cost", "discount_amount", "order_total")),
        quality.row_rules(c.products(s, d), "products", rules("unit_price", "unit_cost")),
        quality.row_rules(e, "items", rules("line_gross_amount", "line_total", "line_margin_before_order_discount")),
    )


def row_counts(s: SparkSession, d: str) -> DataFrame:
    """Rows of each source and of the model over it."""
    pairs = {"orders": (c.table(s, d, "orders"), c.orders(s, d)), "order_items": (c.table(s, d, "lineitem"), enriched_items(s, d)), "customers": (c.table(s, d, "customer"), c.customers(s, d)), "products": (c.table(s, d, "part"), c.products(s, d))}
    return quality.report(*(a.agg(F.count("*").alias("source_rows")).crossJoin(b.agg(F.count("*").alias("model_rows"))).select(F.lit(n).alias("dataset"), "source_rows", "model_rows") for n, (a, b) in pairs.items()))


def items_per_order(s: SparkSession, d: str) -> DataFrame:
    """Q23: orders without one to five items."""
    n = c.items(s, d).groupBy("order_id").agg(F.count("*").alias("n"))
    return c.orders(s, d).join(n, "order_id", "left").select("order_id", F.coalesce("n", F.lit(0)).alias("n_items")).where(~F.col("n_items").between(1, 5))


def schema_test_report(s: SparkSession, d: str) -> DataFrame:
    """Q26: all declared column tests of the models (not null, unique, accepted values, relations)."""
    customers, products, orders, items = c.customers(s, d), c.products(s, d), c.orders(s, d), c.items(s, d)
    # a joined model meets many tests and later models: it is made once, from models that are written
    enriched = layers.written(sales.enriched_items(items, products))
    bought = layers.written(sales.enriched_orders(orders, customers, enriched))
    sold = layers.written(sales.fct_sales(enriched, orders, c.CANCELLED))
    models = {
        "stg_customers": customers, "stg_orders": orders, "stg_order_items": items, "stg_products": products, "int_order_items_enriched": enriched, "int_orders_enriched": bought,
        "dim_customers": customers, "dim_products": sales.dim_products(products), "fct_sales": sold, "mart_daily_sales": layers.written(sales.mart_daily_sales(sold, bought, c.CANCELLED)),
        "mart_product_performance": layers.written(sales.mart_product_performance(products, sold)), "mart_customer_metrics": layers.written(sales.mart_customer_metrics(customers, bought, c.CANCELLED)),
    }
    return quality.schema_tests(models, schema_tests.DECLARED)


def keyed_upsert(s: SparkSession, d: str) -> DataFrame:
    """K7, K8: a later load of orders over an earlier history; the first registration stays."""
    o = c.orders(s, d).select("order_id", "order_status", "order_total", F.col("order_date").alias("registered_at"))
    history = o.where(F.month("registered_at") <= 8)
    batch = o.where(F.month("registered_at") >= 6).withColumns({"order_status": F.lit("done"), "registered_at": F.date_add("registered_at", 100)})
    return doubled(publish.merged(history, batch, ["order_id"], immutable=["registered_at"]))


def registry(s: SparkSession, d: str) -> DataFrame:
    """Models with version and status from the final test."""
    versions = {"moving_average_28": "1.0.0", "croston_sba": "2.0.0", "tsb": "2.0.0"}
    return rounded(publish.model_registry(aggregate(s, d), versions, "moving_average_28").drop("metadata_json", "registered_at", "rejection_reason", "training_data_min_date", "training_data_max_date", "code_version"))


def publication_audit(s: SparkSession, d: str) -> DataFrame:
    """One audit row over a published table; here the fact."""
    return publish.audit(fact(s, d), ["order_item_id"], "quantity", "order_status")


def incomplete_horizons(s: SparkSession, d: str) -> DataFrame:
    """Groups that lack a step: orders whose line numbers are not 1 to n."""
    lines = c.table(s, d, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("step"))
    return publish.incomplete_groups(lines, ["order_id"], "step")


def latest_run(s: SparkSession, d: str) -> DataFrame:
    """O3: the latest finished order, by delivery day or else order day."""
    done = c.orders(s, d).where("order_status = 'F'").select("order_id", F.col("order_date").alias("started_at"), F.lit(None).cast("date").alias("finished_at"))
    return publish.latest(done, ["finished_at", "started_at"], "order_id").select("order_id", "started_at")


def _raw_orders(s: SparkSession, d: str) -> DataFrame:
    """Orders as they would come raw: all text, untidy."""
    o = c.table(s, d, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    return o.select(
        F.format_string("ORD-%08d", "o_orderkey").alias("order_id"), F.format_string("CUST-%06d", "o_custkey").alias("customer_id"), day.alias("order_date"),
        F.concat(F.lit("  "), "o_orderstatus", F.lit(" ")).alias("order_status"), F.regexp_replace("o_orderpriority", "-", "   ").alias("payment_method"), F.lit(" web ").alias("sales_channel"),
        F.lit("0").alias("shipping_cost"), F.lit(" 0.0").alias("discount_amount"), F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("order_total"),
        F.when(F.col("o_orderstatus") == "F", day).alias("delivery_date"),
    )


def layered_orders(s: SparkSession, d: str) -> DataFrame:
    """Raw text to a Bronze day, read back and to Silver."""
    root = f"{scratch(s)}/layers-{uuid.uuid4().hex}"
    day = datetime(2026, 7, 3)
    layers.write_day(layers.to_bronze(_raw_orders(s, d), "orders"), root, "bronze", "orders", day)
    return layers.to_silver(layers.read_day(s, root, "bronze", "orders", day), "orders").withColumns({x: F.to_date(x) for x in ("order_date", "delivery_date")})


def raw_bad_values(s: SparkSession, d: str) -> DataFrame:
    """Q4 on orders of which some totals and days are spoilt."""
    third = F.substring("order_id", -1, 1)
    spoilt = _raw_orders(s, d).withColumns({"order_total": F.when(third == "3", "n/a").otherwise(F.col("order_total")), "order_date": F.when(third == "7", "31/12").otherwise(F.col("order_date"))})
    return layers.bad_values(spoilt, "orders")


def risk_check(s: SparkSession, d: str) -> DataFrame:
    """Q38 on the official risk table, of which some rows are spoilt."""
    bad = F.when(F.col("product_id") % 7 == 0, F.col("projected_stock") + 1).otherwise(F.col("projected_stock"))
    return publish.risk_violations(official_risk(s, d).withColumn("projected_stock", bad), 14, RISK_ORDER).select("product_id", "risk_level")


def audit_counts(s: SparkSession, d: str) -> DataFrame:
    """Realised items of inactive products, and the units on them."""
    inactive = c.products(s, d).where(~F.col("is_active")).select("product_id")
    sold = fact(s, d).where("is_realized_sale").join(inactive, "product_id", "left_semi")
    return sold.agg(F.count("*").alias("items"), F.coalesce(F.sum("quantity"), F.lit(0)).alias("units"), F.count_distinct("product_id").alias("products"))


REQUIRED = ("order_item_id", "order_id", "customer_id", "product_id", "order_date", "order_status", "quantity", "unit_price", "unit_cost", "item_total")

def audit_report(s: SparkSession, d: str) -> DataFrame:
    """E10 in full, over a fact of which some rows are spoilt: repeated, of no product or order, without a status, without
    units. Products were made on days that are derived from their ids; the daily mart is that of the sound fact."""
    products = c.products(s, d).withColumn("created_at", F.date_add(F.lit("1992-01-01").cast("date"), (F.col("product_id") * 13 % 2400).cast("int")))
    kind = F.col("order_id") % 100
    # the joins of the fact are made once, for the columns that are looked at; the mart is two columns, of which orders give the days
    columns = dict.fromkeys((*REQUIRED, "is_realized_sale", "line_gross_amount", "line_discount_amount"))
    sound = layers.written(fact(s, d).select(*columns))
    daily = layers.written(sales.mart_daily_sales(sound, enriched_orders(s, d), c.CANCELLED).select("sales_date", "total_items_sold"))
    spoilt = sound.withColumns({
        "product_id": F.when(kind == 3, -F.col("product_id")).otherwise(F.col("product_id")), "order_status": F.when(kind != 4, F.col("order_status")), "quantity": F.when(kind == 5, 0).otherwise(F.col("quantity")),
    })
    twice = spoilt.unionByName(spoilt.where("order_id % 100 = 6"))
    ranges = [Rule("quantity", ~F.col("quantity").between(1, 50)), Rule("price", F.col("unit_price") <= 0), Rule("cost", (F.col("unit_cost") < 0) | (F.col("unit_cost") >= F.col("unit_price")))]
    return profile.audit(twice, daily, products, c.orders(s, d).where("order_id % 100 <> 7"), REQUIRED, ranges)


def zero_rate(s: SparkSession, d: str) -> DataFrame:
    return profile.zero_rate(series(s, d), c.products(s, d)).withColumn("zero_rate", F.round("zero_rate", 9))


QUERIES = {
    "profile_audit_report": audit_report, "zero_quantity_rate": zero_rate,
    "layered_orders": layered_orders, "raw_bad_values": raw_bad_values, "publication_risk_check": risk_check, "profile_audit": audit_counts,
    "text_normalize": text_normalize, "boolean_parse": boolean_parse, "snake_case_columns": snake_case_columns, "date_shift_and_age": ages,
    "dq_row_rules": row_rules, "dq_required_nulls": required_nulls, "dq_duplicate_keys": duplicate_keys, "dq_foreign_keys": foreign_keys,
    "dq_accepted_values": accepted_values, "dq_regex": regex_rules, "dq_place_coherence": place_coherence, "dq_daily_reconcile": daily_reconcile,
    "dq_order_total_reconcile": order_total_reconcile, "dq_non_negative_money": non_negative_money, "dq_row_counts": row_counts,
    "dq_repeated_product": lambda s, d: quality.duplicates(c.items(s, d), ["order_id", "product_id"]), "dq_items_per_order": items_per_order, "dq_schema_tests": schema_test_report,
    "keyed_upsert": keyed_upsert, "registry_table": registry, "publication_audit": publication_audit, "incomplete_horizons": incomplete_horizons, "latest_success_run": latest_run,
    "profile_coverage": lambda s, d: profile.coverage(series(s, d)),
    "profile_gaps": lambda s, d: profile.gaps(series(s, d)),
    "profile_daily_distribution": lambda s, d: rounded(profile.daily_distribution(series(s, d))),
    "profile_product_sale_days": lambda s, d: rounded(profile.product_sale_days(series(s, d))),
    "profile_concentration": lambda s, d: rounded(profile.concentration(series(s, d))),
    "profile_weekday_index": lambda s, d: rounded(profile.weekday_index(series(s, d))),
    "profile_monthly_index": lambda s, d: rounded(profile.monthly_index(series(s, d))),
    "profile_trend": lambda s, d: rounded(profile.trend(series(s, d))),
    "profile_outliers": lambda s, d: rounded(profile.outliers(series(s, d))),
    "profile_recent_demand": lambda s, d: rounded(profile.recent_demand(series(s, d), c.products(s, d))),
    "fold_summary": lambda s, d: profile.fold_summary(fact(s, d).where("is_realized_sale"), demand.folds(series(s, d))),
}

_RULE = "SELECT '{0}' AS dataset, '{1}' AS rule, '{2}' AS severity, CAST({3} AS BIGINT) AS violations FROM {4}"


def _rules(*rows: tuple[str, str, str, str, str]) -> str:
    return " UNION ALL ".join(_RULE.format(*r) for r in rows)


def _count(dataset: str, rule: str, condition: str, table: str | None = None, severity: str = "error") -> tuple[str, str, str, str, str]:
    return dataset, rule, severity, f"count(*) FILTER ({condition})", table or dataset


_NULLS = {
    "products": ("products", "product_id product_name category brand unit_price unit_cost stock_quantity minimum_stock is_active"),
    "customers": ("customers", "customer_id full_name state region customer_segment is_active"),
    "orders": ("sales_orders", "order_id customer_id order_date order_status sales_channel shipping_cost discount_amount order_total"),
    "order_items": ("items", "order_item_id order_id product_id quantity gross discount_percentage line_total ship_date"),
}
_DIRTY = "' ' || chr(9) || replace(c_name, '#', ' ' || chr(160) || ' # ') || '  '"
_CLEAN = r"nullif(trim(regexp_replace({0}, '[\s\x{{00A0}}]+', ' ', 'g')), '')"

def _checked(name: str, violations: str, table: str, rows: str = "count(*)") -> str:
    return f"SELECT '{name}' AS check, CAST({violations} AS BIGINT) AS violations, CAST({rows} AS BIGINT) AS rows_checked FROM {table}"


def _repeated(name: str, table: str, key: str) -> str:
    return _checked(name, "count(*) FILTER (n > 1)", f"(SELECT count(*) AS n FROM {table} GROUP BY {key})", "sum(n)")


SQL = {
    "zero_quantity_rate": f"""{_SERIES}, cells AS (SELECT g.date, p.product_id, coalesce(s.q, 0) AS q FROM (SELECT CAST(unnest(range(first_day, last_day + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS date FROM span) g CROSS JOIN products p LEFT JOIN series s ON s.date = g.date AND s.product_id = p.product_id)
      SELECT count(DISTINCT date) AS days, count(DISTINCT product_id) AS products, count(*) AS cells, count(*) FILTER (q = 0) AS zero_cells, round(avg(CASE WHEN q = 0 THEN 1.0 ELSE 0.0 END), 9) AS zero_rate FROM cells""",
    "profile_audit_report": f"""{_MODELS}, {DAILY_SQL}, made AS (SELECT *, CAST(DATE '1992-01-01' + CAST(product_id * 13 % 2400 AS INTEGER) AS DATE) AS created_at FROM products),
      once AS (SELECT * REPLACE (CASE WHEN order_id % 100 = 3 THEN -product_id ELSE product_id END AS product_id, CASE WHEN order_id % 100 <> 4 THEN order_status END AS order_status, CASE WHEN order_id % 100 = 5 THEN 0 ELSE quantity END AS quantity) FROM fact),
      bad AS (SELECT * FROM once UNION ALL SELECT * FROM once WHERE order_id % 100 = 6), linked AS (SELECT b.*, p.created_at, p.is_active FROM bad b LEFT JOIN made p ON p.product_id = b.product_id) """
    + " UNION ALL ".join((
        _checked("null_in_fact", f"count(*) FILTER ({' OR '.join(f'{x} IS NULL' for x in REQUIRED)})", "bad"),
        _checked("out_of_range", "count(*) FILTER (quantity < 1 OR quantity > 50 OR unit_price <= 0 OR unit_cost < 0 OR unit_cost >= unit_price)", "bad"),
        _checked("unknown_product", "count(*) FILTER (product_id NOT IN (SELECT product_id FROM products))", "bad"),
        _checked("unknown_order", "count(*) FILTER (order_id NOT IN (SELECT order_id FROM sales_orders WHERE order_id % 100 <> 7))", "bad"),
        _checked("sold_before_creation", "count(*) FILTER (order_date < created_at)", "linked"),
        _checked("inactive_realised", "count(*) FILTER (is_realized_sale AND NOT is_active)", "linked", "count(*) FILTER (is_realized_sale)"),
        _checked("units_fact_to_daily", "abs((SELECT sum(quantity) FROM bad WHERE is_realized_sale) - sum(total_items_sold))", "daily"),
        _repeated("repeated_in_fact", "bad", "order_item_id"), _repeated("repeated_in_daily", "daily", "sales_date"), _repeated("repeated_in_products", "made", "product_id"),
        _checked("null_in_products", "count(*) FILTER (product_name IS NULL OR category IS NULL OR brand IS NULL OR unit_price IS NULL OR is_active IS NULL)", "made"),
    )),
    "layered_orders": """SELECT printf('ORD-%08d', o_orderkey) AS order_id, printf('CUST-%06d', o_custkey) AS customer_id, CAST(o_orderdate AS DATE) AS order_date, o_orderstatus AS order_status,
      replace(o_orderpriority, '-', ' ') AS payment_method, 'web' AS sales_channel, CAST(0 AS DOUBLE) AS shipping_cost, CAST(0 AS DOUBLE) AS discount_amount, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS order_total,
      CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) END AS delivery_date FROM orders""",
    "raw_bad_values": """SELECT 'order_total' AS column, count(*) AS violations FROM orders WHERE o_orderkey % 10 = 3 UNION ALL SELECT 'order_date', count(*) FROM orders WHERE o_orderkey % 10 = 7""",
    "publication_risk_check": f"{_RISK} SELECT product_id, risk_level FROM classed WHERE model_name = 'moving_average_28' AND product_id % 7 = 0",
    "profile_audit": f"{_MODELS} SELECT count(*) AS items, CAST(coalesce(sum(quantity), 0) AS BIGINT) AS units, count(DISTINCT f.product_id) AS products FROM fact f JOIN products p ON p.product_id = f.product_id WHERE is_realized_sale AND NOT is_active",
    "text_normalize": f"SELECT c_custkey, {_CLEAN.format(_DIRTY)} AS name, lower({_CLEAN.format(_DIRTY)}) AS lower_name, upper(c_mktsegment) AS segment, CAST(NULL AS VARCHAR) AS nothing FROM customer",
    "boolean_parse": """SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN true WHEN 1 THEN false END AS strict, CASE c_custkey % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false END AS with_digits FROM customer""",
    "snake_case_columns": "SELECT p_partkey AS part_key, p_name AS part_name, p_size AS size_of_part, p_brand, p_type, p_retailprice FROM part",
    "date_shift_and_age": """SELECT o_orderkey, CAST(2026 - year(o_orderdate) - CAST(228 < month(o_orderdate) * 100 + day(o_orderdate) AS INT) AS INTEGER) AS years, CAST(CAST(o_orderdate AS DATE) + INTERVAL 18 YEAR AS DATE) AS shifted FROM orders""",
    "dq_row_rules": f"{_WITH}, dated AS (SELECT i.*, order_date, order_status FROM items i JOIN sales_orders o ON i.order_id = o.order_id) " + _rules(
        _count("products", "price_positive", "unit_price <= 0"), _count("products", "cost_below_price", "unit_cost >= unit_price"), _count("products", "stock_range", "stock_quantity NOT BETWEEN 0 AND 500"),
        _count("products", "minimum_stock_range", "minimum_stock NOT BETWEEN 5 AND 50"), ("products", "active_share", "warning", "avg(CAST(is_active AS INT)) <= 0.5", "products"),
        _count("order_items", "quantity_range", "quantity NOT BETWEEN 1 AND 5", "items"), _count("order_items", "discount_range", "discount_percentage NOT BETWEEN 0 AND 30", "items"),
        ("order_items", "line_total_exact", "error", "count(*) FILTER (line_total <> CAST(gross * CAST((100 - discount_percentage) / 100 AS DECIMAL(4,2)) AS DECIMAL(18,2)))", "items"),
        _count("orders", "money_not_negative", "shipping_cost < 0 OR discount_amount < 0", "sales_orders"), _count("orders", "total_positive", "order_total <= 0 AND order_status <> 'P'", "sales_orders"),
        ("orders", "delivered_share", "warning", "avg(CAST(order_status = 'F' AS INT)) <= 0.5", "sales_orders"),
        _count("deliveries", "not_before_order", "ship_date < order_date", "dated"), _count("deliveries", "cancelled_has_none", "order_status = 'P' AND ship_date IS NOT NULL", "dated")),
    "dq_required_nulls": f"{_WITH} " + _rules(*(_count(n, f"not_null:{x}", f"{x} IS NULL", t) for n, (t, names) in _NULLS.items() for x in names.split())),
    "dq_duplicate_keys": f"{_WITH} SELECT order_id, split_part(order_item_id, '-', 4) AS line, count(*) AS n FROM items GROUP BY ALL HAVING count(*) > 1",
    "dq_foreign_keys": f"{_WITH} " + _rules(
        ("orders", "customer_id", "error", "count(*)", "sales_orders o WHERE customer_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM customers c WHERE c.customer_id = o.customer_id)"),
        ("order_items", "order_id", "error", "count(*)", "items i WHERE NOT EXISTS (SELECT 1 FROM sales_orders o WHERE o.order_id = i.order_id)"),
        ("order_items", "product_id", "error", "count(*)", "items i WHERE NOT EXISTS (SELECT 1 FROM products p WHERE p.product_id = i.product_id)"),
        ("orders", "has_items", "error", "count(*)", "sales_orders o WHERE NOT EXISTS (SELECT 1 FROM items i WHERE o.order_id = i.order_id)")),
    "dq_accepted_values": f"{_WITH} " + _rules(_count("orders", "accepted:order_status", "order_status NOT IN ('F', 'O')", "sales_orders"), _count("products", "accepted:category", "category NOT IN ('ECONOMY', 'STANDARD', 'PROMO')")),
    "dq_regex": f"{_WITH} " + _rules(_count("customers", "name_pattern", r"NOT regexp_full_match(full_name, 'Customer#\d{9}')"), _count("customers", "lower_case", "full_name <> lower(full_name)"),
        _count("products", "brand_pattern", r"NOT regexp_full_match(brand, 'Brand#1\d?')")),
    "dq_place_coherence": f"{_WITH}, expected AS (SELECT n_name AS state, r_name AS expected_region FROM nation JOIN region ON n_regionkey = r_regionkey) SELECT c.state, region, expected_region, count(*) AS customers FROM (SELECT * REPLACE (CASE WHEN customer_id % 11 = 0 THEN 'ASIA' ELSE region END AS region) FROM customers) c JOIN expected e ON c.state = e.state WHERE region <> expected_region GROUP BY ALL",
    "dq_daily_reconcile": f"{_MODELS}, {DAILY_SQL} SELECT sales_date FROM daily WHERE day(sales_date) = 31",
    "dq_order_total_reconcile": f"""{_WITH}, sums AS (SELECT order_id, sum(line_total) AS items_total FROM items GROUP BY order_id) SELECT o.order_id, CAST(order_total AS DOUBLE) AS order_total, CAST(items_total AS DOUBLE) AS items_total
      FROM sales_orders o LEFT JOIN sums s ON o.order_id = s.order_id WHERE items_total IS NULL OR abs(order_total - (items_total + shipping_cost - discount_amount)) > 0.01""",
    "dq_non_negative_money": f"{_MODELS} " + _rules(*(_count("orders", f"non_negative:{n}", f"{n} < 0", "sales_orders") for n in ("shipping_cost", "discount_amount", "order_total")),
        *(_count("products", f"non_negative:{n}", f"{n} < 0") for n in ("unit_price", "unit_cost")),
        *(_count("items", f"non_negative:{n}", f"{n} < 0", "enriched_items") for n in ("line_gross_amount", "line_total", "line_margin_before_order_discount"))),
    "dq_row_counts": f"{_MODELS} " + " UNION ALL ".join(f"SELECT '{n}' AS dataset, (SELECT count(*) FROM {a}) AS source_rows, (SELECT count(*) FROM {b}) AS model_rows" for n, a, b in (("orders", "orders", "sales_orders"), ("order_items", "lineitem", "enriched_items"), ("customers", "customer", "customers"), ("products", "part", "products"))),
    "dq_repeated_product": f"{_WITH} SELECT order_id, product_id, count(*) AS n FROM items GROUP BY ALL HAVING count(*) > 1",
    "dq_items_per_order": f"{_WITH} SELECT o.order_id, coalesce(n, 0) AS n_items FROM sales_orders o LEFT JOIN (SELECT order_id, count(*) AS n FROM items GROUP BY order_id) i ON o.order_id = i.order_id WHERE coalesce(n, 0) NOT BETWEEN 1 AND 5",
    "dq_schema_tests": f"{_MODELS}, {DAILY_SQL}, dim AS ({SALES_SQL['dim_products_stock_status']}), product_mart AS ({SALES_SQL['mart_product_performance']}), customer_mart AS ({SALES_SQL['mart_customer_metrics']}) " + _rules(*schema_tests.sql_rules({
        "stg_customers": "customers", "stg_orders": "sales_orders", "stg_order_items": "items", "stg_products": "products", "int_order_items_enriched": "enriched_items", "int_orders_enriched": "enriched_orders",
        "dim_customers": "customers", "dim_products": "dim", "fct_sales": "fact", "mart_daily_sales": "daily", "mart_product_performance": "product_mart", "mart_customer_metrics": "customer_mart"})),
    "keyed_upsert": f"""{_WITH}, o AS (SELECT order_id, order_status, CAST(order_total AS DOUBLE) AS order_total, order_date AS registered_at FROM sales_orders)
      SELECT order_id, CASE WHEN month(registered_at) >= 6 THEN 'done' ELSE order_status END AS order_status, order_total, CASE WHEN month(registered_at) <= 8 THEN registered_at ELSE registered_at + 100 END AS registered_at FROM o""",
    "registry_table": f"""{_CUBES} SELECT model_name, CASE model_name WHEN 'moving_average_28' THEN '1.0.0' ELSE '2.0.0' END AS model_version, CASE model_name WHEN 'moving_average_28' THEN 'champion' ELSE 'rejected' END AS status,
      model_name = 'moving_average_28' AS is_champion, CASE model_name WHEN 'moving_average_28' THEN 'retained' ELSE 'rejected' END AS promotion_decision, 'wape' AS primary_metric, round(wape, 6) AS primary_metric_value, round(bias, 6) AS bias
      FROM agg WHERE split = 'final_test' AND horizon = 14 AND model_name IN ('moving_average_28', 'croston_sba', 'tsb')""",
    "publication_audit": f"""{_MODELS} SELECT count(*) AS row_count, count(DISTINCT order_item_id) AS distinct_keys, count(*) - count(DISTINCT order_item_id) AS duplicate_rows, count(*) FILTER (quantity < 0) AS negative_values,
      array_to_string(list_sort(list(DISTINCT order_status)), ',') AS states FROM fact""",
    "incomplete_horizons": "SELECT l_orderkey AS order_id, count(*) AS n, count(DISTINCT l_linenumber) AS steps, min(l_linenumber) AS first_step, max(l_linenumber) AS last_step FROM lineitem GROUP BY l_orderkey HAVING count(*) <> max(l_linenumber) OR count(DISTINCT l_linenumber) <> count(*) OR min(l_linenumber) <> 1",
    "latest_success_run": f"{_WITH} SELECT order_id, order_date AS started_at FROM sales_orders WHERE order_status = 'F' ORDER BY order_date DESC, order_id DESC LIMIT 1",
    "profile_coverage": f"{_SERIES} SELECT first_day, last_day, CAST(last_day - first_day + 1 AS INTEGER) AS calendar_days, count(DISTINCT date) AS sale_days, CAST(last_day - first_day + 1 - count(DISTINCT date) AS BIGINT) AS empty_days FROM series, span GROUP BY first_day, last_day",
    "profile_gaps": f"""{_SERIES} SELECT product_id, count(*) FILTER (gap > 0) AS gaps, CAST(max(gap) AS INTEGER) AS longest_gap FROM (
      SELECT product_id, date - lag(date) OVER (PARTITION BY product_id ORDER BY date) - 1 AS gap FROM series) GROUP BY product_id""",
    "profile_daily_distribution": f"""{_SERIES}, days AS (SELECT g.date, coalesce(s.q, 0) AS q FROM (SELECT CAST(unnest(range(first_day, last_day + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS date FROM span) g LEFT JOIN (SELECT date, sum(q) AS q FROM series GROUP BY date) s ON s.date = g.date),
      parts AS (SELECT 'all_days' AS part, q FROM days UNION ALL SELECT 'sale_days', q FROM days WHERE q > 0)
      SELECT part, round(avg(q), 6) AS mean, round(quantile_cont(q, 0.5), 6) AS median, round(quantile_cont(q, 0.9), 6) AS p90, round(quantile_cont(q, 0.99), 6) AS p99, max(q) AS most FROM parts GROUP BY part""",
    "profile_product_sale_days": f"""{_SERIES}, n AS (SELECT product_id, count(*) AS n FROM series GROUP BY product_id) SELECT min(n) AS least, round(quantile_cont(n, 0.25), 6) AS q1, round(quantile_cont(n, 0.5), 6) AS median, round(quantile_cont(n, 0.75), 6) AS q3,
      round(quantile_cont(n, 0.9), 6) AS p90, max(n) AS most, count(*) FILTER (n < 28) AS under_28, count(*) FILTER (n < 52) AS under_52 FROM n""",
    "profile_concentration": f"""{_SERIES}, n AS (SELECT product_id, sum(q) AS q, row_number() OVER (ORDER BY sum(q) DESC, product_id) AS r FROM series GROUP BY product_id)
      SELECT k, round(sum(CASE WHEN r <= k THEN q ELSE 0 END) / sum(q), 6) AS share FROM n, (VALUES (1), (5), (10), (20)) t(k) GROUP BY k""",
    "profile_weekday_index": f"""{_SERIES}, days AS (SELECT g.date, coalesce(s.q, 0) AS q FROM (SELECT CAST(unnest(range(first_day, last_day + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS date FROM span) g LEFT JOIN (SELECT date, sum(q) AS q FROM series GROUP BY date) s ON s.date = g.date)
      SELECT CAST(isodow(date) - 1 AS INTEGER) AS weekday, round(100 * avg(q) / any_value((SELECT avg(q) FROM days)), 6) AS weekday_index FROM days GROUP BY isodow(date)""",
    "profile_monthly_index": f"""{_SERIES}, months AS (SELECT year(date) AS y, month(date) AS m, sum(q) AS q FROM series, span WHERE date_trunc('month', date) >= CASE WHEN day(first_day) = 1 THEN first_day ELSE date_trunc('month', first_day) + INTERVAL 1 MONTH END
        AND last_day(date) <= span.last_day GROUP BY ALL) SELECT CAST(m AS INTEGER) AS month, round(avg(100 * q / mean), 6) AS month_index FROM (SELECT *, avg(q) OVER (PARTITION BY y) AS mean FROM months) GROUP BY m""",
    "profile_trend": f"""{_SERIES}, days AS (SELECT g.date - first_day AS t, coalesce(s.q, 0) AS q FROM (SELECT first_day, CAST(unnest(range(first_day, last_day + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS date FROM span) g LEFT JOIN (SELECT date, sum(q) AS q FROM series GROUP BY date) s ON s.date = g.date)
      SELECT round(regr_slope(q, t), 6) AS slope_per_day, round(corr(q, t), 6) AS correlation FROM days""",
    "profile_outliers": f"""{_SERIES}, days AS (SELECT date, sum(q) AS units, sum(revenue) AS revenue FROM series GROUP BY date),
      flat AS (SELECT 'units' AS measure, units AS x FROM days UNION ALL SELECT 'revenue', revenue FROM days), lim AS (SELECT measure, quantile_cont(x, 0.75) + 1.5 * (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) AS lim FROM flat GROUP BY measure)
      SELECT f.measure, round(any_value(lim), 6) AS upper_limit, count(*) FILTER (x > lim) AS outlier_days FROM flat f JOIN lim l ON f.measure = l.measure GROUP BY f.measure""",
    "profile_recent_demand": f"""{_SERIES}, n AS (SELECT product_id, {', '.join(f"sum(CASE WHEN date > last_day - {k} THEN q ELSE 0 END) AS d{k}" for k in (7, 14, 30))} FROM series, span GROUP BY product_id),
      p AS (SELECT x.product_id, stock_quantity, coalesce(d7, 0) AS d7, coalesce(d14, 0) AS d14, coalesce(d30, 0) AS d30 FROM products x LEFT JOIN n ON n.product_id = x.product_id)
      SELECT days, sum(d) AS units, count(*) FILTER (d = 0) AS without_sale, count(*) FILTER (d >= stock_quantity) AS at_or_over_stock FROM (SELECT 7 AS days, d7 AS d, stock_quantity FROM p UNION ALL SELECT 14, d14, stock_quantity FROM p UNION ALL SELECT 30, d30, stock_quantity FROM p) GROUP BY days""",
    "fold_summary": f"""{_FOLDS} SELECT split, count(DISTINCT order_date) AS sale_days, count(DISTINCT order_id) AS orders, CAST(sum(quantity) AS BIGINT) AS units, count(DISTINCT product_id) AS products
      FROM fact JOIN folds ON order_date BETWEEN val_start AND val_end WHERE is_realized_sale GROUP BY split""",
}
