"""The declared column tests of the models (Q26) as data, and the same as SQL."""

from __future__ import annotations

from mercadia.operators.quality import Declared

# The states, channels, regions and segments of the given tables.
STATUSES = ("F", "O", "P")
CHANNELS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
CATEGORIES = ("ECONOMY", "STANDARD", "PROMO")

_CUSTOMER = "customer_id full_name state region customer_segment is_active"
_PRODUCT = "product_id product_name category unit_price unit_cost stock_quantity minimum_stock is_active"
_LINE = "quantity line_gross_amount line_discount_amount line_cost_amount line_margin_before_order_discount"
_OF_ORDER, _OF_PRODUCT, _OF_CUSTOMER = ("stg_orders", "order_id"), ("stg_products", "product_id"), ("stg_customers", "customer_id")

DECLARED = {
    "stg_customers": Declared(_CUSTOMER.split(), ["customer_id"], {"region": REGIONS, "customer_segment": SEGMENTS}),
    "stg_orders": Declared(
        "order_id customer_id order_date order_status sales_channel shipping_cost discount_amount order_total".split(), ["order_id"],
        {"order_status": STATUSES, "sales_channel": CHANNELS}, {"customer_id": _OF_CUSTOMER},
    ),
    "stg_order_items": Declared(
        "order_item_id order_id product_id quantity gross discount_percentage line_total".split(), ["order_item_id"],
        relations={"order_id": _OF_ORDER, "product_id": _OF_PRODUCT},
    ),
    "stg_products": Declared([*_PRODUCT.split(), "brand"], ["product_id"], {"category": CATEGORIES}),
    "int_order_items_enriched": Declared(
        f"order_item_id order_id product_id product_name category line_total {_LINE}".split(), ["order_item_id"],
        relations={"order_id": _OF_ORDER, "product_id": _OF_PRODUCT},
    ),
    "int_orders_enriched": Declared(
        "order_id customer_id order_date order_status item_quantity distinct_products gross_amount item_discount_amount shipping_cost order_discount_amount total_discount_amount order_total".split(),
        ["order_id"], {"order_status": STATUSES}, {"customer_id": _OF_CUSTOMER},
    ),
    "dim_customers": Declared(_CUSTOMER.split(), ["customer_id"]),
    "dim_products": Declared([*_PRODUCT.split(), "stock_status"], ["product_id"], {"stock_status": ("adequate", "below_minimum")}),
    "fct_sales": Declared(
        f"order_item_id order_id customer_id product_id order_date order_status is_realized_sale item_total order_shipping_cost order_discount_amount order_total {_LINE}".split(),
        ["order_item_id"], {"order_status": STATUSES, "is_realized_sale": (True, False)},
        {"order_id": _OF_ORDER, "customer_id": ("dim_customers", "customer_id"), "product_id": ("dim_products", "product_id")},
    ),
    "mart_daily_sales": Declared(
        ("sales_date total_orders unique_customers total_items_sold distinct_products gross_revenue item_discount_amount order_discount_amount total_discount_amount "
         "item_revenue_before_order_discount shipping_amount total_revenue average_order_value").split(), ["sales_date"],
    ),
    "mart_product_performance": Declared(
        ("product_id product_name category total_orders total_items_sold unique_customers item_revenue_before_order_discount current_stock_quantity items_sold_last_30_days "
         "sales_reference_date stock_risk_status").split(), ["product_id"], {"stock_risk_status": ("adequate", "at_risk", "below_minimum")}, {"product_id": _OF_PRODUCT},
    ),
    "mart_customer_metrics": Declared(
        "customer_id full_name state region total_orders total_items_purchased total_spend average_order_value sales_reference_date".split(), ["customer_id"],
        relations={"customer_id": _OF_CUSTOMER},
    ),
}


def sql_rules(tables: dict[str, str]) -> list[tuple[str, str, str, str, str]]:
    """(dataset, rule, severity, count, table) of each declared test; tables: the SQL table of each model."""
    out = []
    for name, tests in DECLARED.items():
        t = tables[name]
        out += [(name, f"not_null:{x}", "error", f"count(*) FILTER ({x} IS NULL)", t) for x in tests.not_null]
        for x, values in tests.accepted.items():
            listed = ", ".join(repr(v) for v in values)
            out.append((name, f"accepted:{x}", "error", f"count(*) FILTER ({x} NOT IN ({listed}))", t))
        out += [(name, f"unique:{x}", "error", "count(*)", f"(SELECT {x} FROM {t} WHERE {x} IS NOT NULL GROUP BY {x} HAVING count(*) > 1) x") for x in tests.unique]
        for x, (parent, key) in tests.relations.items():
            out.append((name, f"relation:{x}", "error", "count(*)", f"{t} c WHERE {x} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {tables[parent]} p WHERE p.{key} = c.{x})"))
    return out
