"""Gates of the layers: the rules that a day's four datasets must keep before they are written on (Q2 to Q24, Q35, Q36, J10,
P13). Row rules are SQL predicates, true where a row breaks the rule; all of a dataset run in one pass. A null breaks no
rule but that it must not be there.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercadia.functions.columns import full_match
from mercadia.operators import quality
from mercadia.operators.quality import Rule

DATASETS = ("customers", "orders", "order_items", "products")
KEYS = {"customers": "customer_id", "orders": "order_id", "order_items": "order_item_id", "products": "product_id"}
# fixed values of the source system
FIRST_DAY = "2022-01-01"
GENDERS = ("Feminino", "Masculino", "Não informado")
SEGMENTS = ("Novo", "Recorrente", "Premium", "Inativo")
STATUSES = ("Entregue", "Enviado", "Processando", "Cancelado")
CHANNELS = ("Busca orgânica", "Anúncios pagos", "Redes sociais", "Indicação", "E-mail marketing", "Marketplace")
PAYMENTS = ("Cartão de crédito", "Pix", "Boleto", "Carteira digital")
SALES_CHANNELS = ("Site", "Aplicativo", "Marketplace")
ID_PATTERNS = {"customers": "CUST-[0-9]{6}", "orders": "ORD-[0-9]{8}", "order_items": "ITEM-[0-9]{8}", "products": "PROD-[0-9]{6}"}
EMAIL = r"[^@\s]+@[^@\s]+\.[^@\s]+"
#: Columns that must have a value. Only a delivery date may be missing.
REQUIRED = {
    "customers": ("customer_id", "full_name", "email", "birth_date", "gender", "city", "state", "region", "registration_date", "acquisition_channel", "customer_segment", "is_active"),
    "orders": ("order_id", "customer_id", "order_date", "order_status", "payment_method", "sales_channel", "shipping_cost", "discount_amount", "order_total"),
    "order_items": ("order_item_id", "order_id", "product_id", "quantity", "unit_price", "unit_cost", "discount_percentage", "line_total"),
    "products": ("product_id", "product_name", "category", "brand", "supplier", "unit_price", "unit_cost", "stock_quantity", "minimum_stock", "created_at", "is_active"),
}


def _among(column: str, values: Sequence[str]) -> str:
    return f"{column} NOT IN ({', '.join(repr(v) for v in values)})"


def age(birth: str, day: str) -> str:
    """P23 as SQL: completed years."""
    return f"(year({day}) - year({birth}) - CASE WHEN month({day}) * 100 + day({day}) < month({birth}) * 100 + day({birth}) THEN 1 ELSE 0 END)"


def row_rules(day: str, places: bool = False) -> dict[str, dict[str, str]]:
    """The predicates by dataset and rule, at the reference day, but for nulls and patterns. Orders carry registered_on,
    n_items and items_total, items catalogue_price and catalogue_cost, customers the place of their state (see looked_up)."""
    now = f"DATE '{day}'"
    span = f"BETWEEN DATE '{FIRST_DAY}' AND {now}"
    cents = lambda x: f"CAST({x} AS DECIMAL(18,2))"
    rules = {
        "products": {
            "price_positive": "unit_price <= 0", "cost_positive": "unit_cost <= 0", "cost_below_price": "unit_cost >= unit_price",
            "stock_range": "stock_quantity NOT BETWEEN 0 AND 500", "minimum_stock_range": "minimum_stock NOT BETWEEN 5 AND 50", "created_in_range": f"NOT (created_at {span})",
        },
        "customers": {
            "email_lower_case": "email <> lower(email)", "gender": _among("gender", GENDERS), "segment": _among("customer_segment", SEGMENTS), "channel": _among("acquisition_channel", CHANNELS),
            "age_18_to_80": f"NOT ({age('birth_date', now)} BETWEEN 18 AND 80)", "state_upper_case": "state <> upper(state)", "inactive_segment": "customer_segment = 'Inativo' AND is_active",
            "registered_in_range": f"NOT (registration_date {span})", "registered_as_adult": "registration_date < birth_date + INTERVAL '18' YEAR",
        },
        "orders": {
            "status": _among("order_status", STATUSES), "payment": _among("payment_method", PAYMENTS), "channel": _among("sales_channel", SALES_CHANNELS),
            "ordered_in_range": f"NOT (order_date {span})", "not_before_registration": "order_date < registered_on",
            "money_not_negative": "shipping_cost < 0 OR discount_amount < 0", "total_positive": "order_total <= 0 AND order_status <> 'Cancelado'",
            "delivered_has_date": "order_status = 'Entregue' AND delivery_date IS NULL", "delivery_not_before_order": "order_status IN ('Entregue', 'Enviado') AND delivery_date < order_date",
            "open_has_no_date": "order_status IN ('Processando', 'Cancelado') AND delivery_date IS NOT NULL",
            "has_items": "n_items IS NULL", "one_to_five_items": "n_items NOT BETWEEN 1 AND 5",
            "total_of_items": f"{cents('order_total')} <> items_total + {cents('shipping_cost')} - {cents('discount_amount')}",
        },
        "order_items": {
            "quantity_range": "quantity NOT BETWEEN 1 AND 5", "discount_range": "discount_percentage NOT BETWEEN 0 AND 30",
            "price_of_catalogue": "abs(unit_price - catalogue_price) > 0.001", "cost_of_catalogue": "abs(unit_cost - catalogue_cost) > 0.001",
            "line_total_exact": f"{cents('line_total')} <> CAST(CAST(quantity AS DECIMAL(10,0)) * {cents('unit_price')} * (100 - CAST(discount_percentage AS DECIMAL(5,2))) / 100 AS DECIMAL(18,2))",
        },
    }
    if places:
        rules["customers"] |= {"known_state": "state IS NOT NULL AND expected_region IS NULL", "region_of_state": "region <> expected_region", "city_of_state": "NOT array_contains(cities, city)"}
    return rules


def lookup(parent: DataFrame, key: str, columns: Mapping[str, str]) -> DataFrame:
    """One row a key with the columns under new names; of repeated keys the least values, whatever the order of rows."""
    least = parent.groupBy(key).agg(F.min(F.struct(*columns)).alias("_least"))
    return least.select(key, *(F.col(f"_least.{c}").alias(n) for c, n in columns.items()))


def looked_up(tables: Mapping[str, DataFrame], places: DataFrame | None = None) -> dict[str, DataFrame]:
    """Q11, Q16, Q21, Q24: the tables, orders with their customer's registration and their items' number and total, items
    with their product's price and cost, customers with the region and cities of their state.

    places: state, region, cities (an array), a row a state."""
    registered = lookup(tables["customers"], "customer_id", {"registration_date": "registered_on"})
    catalogue = lookup(tables["products"], "product_id", {"unit_price": "catalogue_price", "unit_cost": "catalogue_cost"})
    totals = tables["order_items"].groupBy("order_id").agg(F.count("*").alias("n_items"), F.sum(F.col("line_total").cast("decimal(18,2)")).alias("items_total"))
    out = dict(tables) | {"orders": tables["orders"].join(registered, "customer_id", "left").join(totals, "order_id", "left"), "order_items": tables["order_items"].join(catalogue, "product_id", "left")}
    if places is not None:
        out["customers"] = tables["customers"].join(places.select("state", F.col("region").alias("expected_region"), "cities"), "state", "left")
    return out


def gate(tables: Mapping[str, DataFrame], day: str, places: DataFrame | None = None, patterns: Mapping[str, str] = ID_PATTERNS) -> DataFrame:
    """The report over all four datasets: values that must be there, id patterns and row rules in one pass a dataset, then
    keys, e-mails, relations and repeated products.

    Raises where a dataset is missing or unknown (P13), or a column is missing."""
    if set(tables) != set(DATASETS):
        raise ValueError(f"datasets missing: {sorted(set(DATASETS) - set(tables))}, unknown: {sorted(set(tables) - set(DATASETS))}")
    lost = [f"{n}.{c}" for n in DATASETS for c in (*REQUIRED[n], *(("delivery_date",) if n == "orders" else ())) if c not in tables[n].columns]
    if lost:
        raise ValueError(f"columns missing: {', '.join(lost)}")
    every, rules, parts = looked_up(tables, places), row_rules(day, places is not None), []
    for n in DATASETS:
        found = quality.not_null(REQUIRED[n]) + [Rule("id_pattern", ~full_match(F.col(KEYS[n]).cast("string"), patterns[n]))]
        if n == "customers":
            found.append(Rule("email_pattern", ~full_match(F.col("email"), EMAIL)))
        parts.append(quality.row_rules(every[n], n, found + [Rule(r, F.expr(p)) for r, p in rules[n].items()]))
        parts.append(quality.as_rule(quality.duplicates(tables[n].where(F.col(KEYS[n]).isNotNull()), [KEYS[n]]), n, "unique_key"))
    items, orders = tables["order_items"], tables["orders"]
    parts += [
        quality.as_rule(quality.duplicates(tables["customers"].where("email is not null"), ["email"]), "customers", "unique_email"),
        quality.as_rule(quality.orphans(orders, "customer_id", tables["customers"], "customer_id"), "orders", "customer_exists"),
        quality.as_rule(quality.orphans(items, "order_id", orders, "order_id"), "order_items", "order_exists"),
        quality.as_rule(quality.orphans(items, "product_id", tables["products"], "product_id"), "order_items", "product_exists"),
        quality.as_rule(quality.duplicates(items.where("order_id is not null and product_id is not null"), ["order_id", "product_id"]), "order_items", "product_once_an_order"),
    ]
    return quality.report(*parts)


def require(report: DataFrame) -> None:
    """Raises with the broken rules and their counts, at most one row a rule."""
    broken = report.where("severity = 'error' AND violations > 0").orderBy("dataset", "rule").collect()
    if broken:
        raise ValueError("; ".join(f"{r.dataset}.{r.rule}: {r.violations}" for r in broken))


#: Words of a key's days that are sent to all tasks at most.
FEW = 200_000


def grid_checks(grid: DataFrame, products: DataFrame, key: str = "product_id") -> DataFrame:
    """Cells of unknown products, repeated cells, lost attributes, negative demand, and products without a cell on
    every day between the grid's first and last."""
    from mercadia.sources import layers  # which imports this module

    word, bit = F.coalesce(F.floor(F.unix_date("date") / 62), F.lit(-1_000_000)), F.expr("shiftleft(1L, CAST(pmod(unix_date(date), 62) AS INT))")
    rules = [Rule(f"lost_{c}", F.col(c).isNull()) for c in products.columns if c != key and c in grid.columns] + [Rule("negative", F.col("quantity_sold") < 0)]
    counts = [f"c{i}_" for i in range(len(rules))]
    dated, days, odd = F.col("word_") != -1_000_000, F.coalesce(F.bit_count(F.bit_or(bit)), F.lit(0)), F.coalesce(F.bit_count(F.bit_xor(bit)), F.lit(0))
    # days are bits, 62 a word, so that no row a cell is kept. A day that is there an even number of times is missing from the
    # exclusive or; if there are as many of these as cells too many, each is there twice. Only words where they differ, which
    # have a day three times or more, are looked at cell by cell
    words = grid.groupBy(key, word.alias("word_")).agg(
        F.count("*").alias("n_"), days.alias("days_"), (days - odd).alias("even_"), F.min("date").alias("first_"), F.max("date").alias("last_"),
        *(F.count_if(F.coalesce(r.breaks, F.lit(False))).alias(c) for r, c in zip(rules, counts, strict=True)),
    )
    sure = F.col("n_") - F.col("days_") == F.col("even_")
    twice = F.sum(F.when(~dated, (F.col("n_") > 1).cast("int")).when(sure, F.col("even_")).otherwise(0)).cast("long").alias("twice_")
    again = F.collect_list(F.when(dated & ~sure, F.col("word_"))).alias("again_")
    keys = layers.written(words.groupBy(key).agg(*(F.sum(c).alias(c) for c in ("n_", "days_", *counts)), F.min("first_").alias("first_"), F.max("last_").alias("last_"), twice, again))
    span = keys.agg((F.date_diff(F.max("last_"), F.min("first_")) + 1).alias("span_"))
    doubt = keys.where(F.size("again_") > 0).select(F.col(key).alias("key_"), F.explode("again_").alias("word_"))
    repeated, n = keys.select("twice_"), doubt.count()
    if n:
        near = grid.select(key, "date").join(F.broadcast(doubt) if n <= FEW else doubt.hint("merge"), F.col(key).eqNullSafe(F.col("key_")) & (word == F.col("word_")), "left_semi")
        repeated = repeated.unionByName(quality.duplicates(near, [key, "date"]).select(F.lit(1).cast("long").alias("twice_")))
    total = lambda df, rule, c: df.agg(F.coalesce(F.sum(c), F.lit(0)).alias("violations")).select(F.lit("grid").alias("dataset"), F.lit(rule).alias("rule"), F.lit("error").alias("severity"), "violations")
    return quality.report(
        *(total(keys, r.name, c) for r, c in zip(rules, counts, strict=True)), total(quality.orphans(keys, key, products.hint("merge"), key), "unknown_product", "n_"),
        total(repeated, "repeated_cell", "twice_"),
        quality.as_rule(keys.crossJoin(F.broadcast(span)).where("days_ <> span_"), "grid", "incomplete_days"),
        quality.as_rule(products.select(key).join(keys.select(key).hint("merge"), key, "left_anti"), "grid", "absent_product"),
    )


def input_checks(sales: DataFrame, products: DataFrame) -> DataFrame:
    """Q35: the inputs of the models: rows there, no nulls, nothing negative, products unique."""
    empty = lambda df, name: df.agg((F.count("*") == 0).cast("bigint").alias("violations")).select(F.lit(name).alias("dataset"), F.lit("not_empty").alias("rule"), F.lit("error").alias("severity"), "violations")
    return quality.report(
        empty(sales, "sales"), empty(products, "products"),
        quality.row_rules(sales, "sales", [*quality.not_null(["product_id", "date", "quantity_sold"]), Rule("negative", (F.col("quantity_sold") < 0) | (F.col("revenue") < 0))]),
        quality.row_rules(products, "products", [*quality.not_null(["product_id", "unit_price", "stock_quantity"]), Rule("negative", (F.col("unit_price") < 0) | (F.col("stock_quantity") < 0))]),
        quality.as_rule(quality.duplicates(products, ["product_id"]), "products", "unique_key"),
        quality.as_rule(quality.duplicates(sales, ["product_id", "date"]), "sales", "unique_key"),
    )
