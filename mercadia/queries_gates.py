"""Registered queries of the gates, the publication checks and the bundles, and their SQL.

The source system's four datasets are adapted from the given tables by expressions that both engines read; what the given
tables lack is derived from their keys, so that every rule is broken by some rows.
"""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercadia.operators import artifacts, demand, gates, publish, quality
from mercadia.plans import forecast
from mercadia.queries_demand import _ALL, _CUBES, _GRID, _RISK, _SERIES, aggregate, official, official_risk, rounded, series, unpivoted, written_series
from mercadia.sources import canonical as c
from mercadia.sources import layers
from mercadia.sources.layers import scratch

DAY = "2026-07-28"
_TABLES = {
    "customers": ("customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey", {
        "customer_id": "CASE WHEN c_custkey % 211 <> 0 THEN c_custkey END", "full_name": "CASE WHEN c_custkey % 103 <> 0 THEN c_name END",
        "email": "CASE WHEN c_custkey % 13 = 0 THEN c_name WHEN c_custkey % 17 = 0 THEN 'Same@shop.example' WHEN c_custkey % 43 = 0 THEN concat('a b', c_custkey, '@shop.example') WHEN c_custkey % 47 = 0 THEN concat('a@', c_custkey, '@shop.example') ELSE concat(lower(replace(c_name, '#', '.')), '@shop.example') END",
        "birth_date": "DATE '1930-01-01' + CAST(c_custkey * 37 % 30000 AS INTEGER)", "gender": "CASE c_custkey % 4 WHEN 0 THEN 'Feminino' WHEN 1 THEN 'Masculino' WHEN 2 THEN 'Não informado' ELSE '?' END",
        "city": "CASE WHEN c_custkey % 7 = 0 THEN 'Elsewhere' WHEN c_custkey % 59 <> 0 THEN concat(n_name, CASE WHEN c_custkey % 2 = 0 THEN ' North' ELSE ' South' END) END",
        "state": "CASE WHEN c_custkey % 19 = 0 THEN lower(n_name) ELSE n_name END", "region": "CASE WHEN c_custkey % 11 = 0 THEN 'ASIA' ELSE r_name END", "registration_date": "DATE '2021-06-01' + CAST(c_custkey * 17 % 1900 AS INTEGER)",
        "acquisition_channel": "CASE WHEN c_custkey % 3 = 0 THEN 'Marketplace' WHEN c_custkey % 5 = 0 THEN 'Radio' ELSE 'Indicação' END",
        "customer_segment": "CASE c_custkey % 5 WHEN 0 THEN 'Novo' WHEN 1 THEN 'Recorrente' WHEN 2 THEN 'Premium' WHEN 3 THEN 'Inativo' ELSE 'VIP' END", "is_active": "CASE WHEN c_custkey % 83 <> 0 THEN c_acctbal > 0 END",
    }),
    "products": ("part", {
        "product_id": "CASE WHEN p_partkey % 97 = 0 THEN -p_partkey ELSE p_partkey END", "product_name": "CASE WHEN p_partkey % 61 <> 0 THEN p_name END", "category": "p_type", "brand": "CASE WHEN p_partkey % 67 <> 0 THEN p_brand END", "supplier": "p_brand",
        "unit_price": "CASE WHEN p_partkey % 71 <> 0 THEN CAST(p_retailprice AS DECIMAL(18,2)) END", "unit_cost": "CASE WHEN p_partkey % 23 = 0 THEN CAST(p_retailprice AS DECIMAL(18,2)) ELSE CAST(p_size AS DECIMAL(18,2)) END",
        "stock_quantity": "p_partkey * 37 % 505", "minimum_stock": "3 + p_size % 50", "created_at": "DATE '2021-06-01' + CAST(p_partkey * 29 % 2000 AS INTEGER)", "is_active": "p_partkey % 5 <> 0",
    }),
    "orders": ("orders", {
        "order_id": "o_orderkey", "customer_id": "CASE WHEN o_orderkey % 41 = 0 THEN -1 ELSE o_custkey END", "order_date": "CASE WHEN o_orderkey % 73 <> 0 THEN CAST(o_orderdate AS DATE) + 9500 END",
        "order_status": "CASE o_orderstatus WHEN 'F' THEN 'Entregue' WHEN 'O' THEN 'Enviado' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'Cancelado' WHEN o_orderkey % 7 = 0 THEN 'Aberto' ELSE 'Processando' END END",
        "payment_method": "CASE WHEN o_orderkey % 37 = 0 THEN 'Cash' ELSE 'Pix' END", "sales_channel": "CASE WHEN o_orderkey % 53 = 0 THEN 'Phone' ELSE 'Site' END",
        "shipping_cost": "CAST(o_orderkey % 30 - 1 AS DECIMAL(18,2))", "discount_amount": "CAST(0 AS DECIMAL(18,2))", "order_total": "CASE WHEN o_orderkey % 31 = 0 THEN CAST(0 AS DECIMAL(18,2)) WHEN o_orderkey % 79 <> 0 THEN CAST(o_totalprice AS DECIMAL(18,2)) END",
        "delivery_date": "CASE WHEN o_orderkey % 9 < 4 THEN CAST(o_orderdate AS DATE) + 9500 + CAST(o_orderkey % 10 AS INTEGER) - 2 END",
    }),
    "order_items": ("lineitem JOIN part ON l_partkey = p_partkey", {
        "order_item_id": "concat(l_orderkey, '-', l_linenumber)", "order_id": "l_orderkey", "product_id": "CASE WHEN l_orderkey % 89 <> 0 THEN l_partkey END", "quantity": "CAST(l_quantity AS BIGINT)", "discount_percentage": "CAST(CAST(l_discount AS DECIMAL(4,2)) * 400 AS DECIMAL(6,2))",
        "unit_price": "CASE WHEN l_orderkey % 29 = 0 THEN CAST(p_retailprice + 1 AS DECIMAL(18,2)) ELSE CAST(p_retailprice AS DECIMAL(18,2)) END",
        "unit_cost": "CASE WHEN p_partkey % 23 = 0 THEN CAST(p_retailprice AS DECIMAL(18,2)) ELSE CAST(p_size AS DECIMAL(18,2)) END",
        "line_total": "CAST(CAST(l_quantity AS DECIMAL(10,0)) * CAST(p_retailprice AS DECIMAL(18,2)) * (100 - CAST(CAST(l_discount AS DECIMAL(4,2)) * 400 AS DECIMAL(5,2))) * 0.01 AS DECIMAL(18,2))",
    }),
}
_SOURCES = {"customers": ("customer", "nation", "region"), "products": ("part",), "orders": ("orders",), "order_items": ("lineitem", "part")}


#: Patterns of the given keys.
_PATTERNS = {"customers": "[0-9]*[0-8]", "products": "[0-9]+", "orders": "[0-9]*[1-9]", "order_items": "[0-9]+-[1-6]"}


def source_tables(s: SparkSession, d: str) -> dict[str, DataFrame]:
    out = {}
    for name, (origin, columns) in _TABLES.items():
        given = c.table(s, d, _SOURCES[name][0])
        if name == "customers":
            nation, region = c.table(s, d, "nation"), c.table(s, d, "region")
            given = given.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        elif name == "order_items":
            given = given.join(c.table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
        out[name] = given.selectExpr(*(f"{x} AS {n}" for n, x in columns.items()))
    return out


def source_gate(s: SparkSession, d: str) -> DataFrame:
    """Q2 to Q24 over the four datasets, each rule broken by some rows."""
    nation, region = c.table(s, d, "nation").where("n_nationkey % 6 <> 5"), c.table(s, d, "region")
    cities = F.array(*(F.concat("n_name", F.lit(x)) for x in (" North", " South")))
    places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("state"), F.col("r_name").alias("region"), cities.alias("cities"))
    return gates.gate(source_tables(s, d), DAY, places, _PATTERNS)


#: What is planted into the raw files: by dataset and column, where, and the text that stands there instead.
_SPOILT = {
    ("products", "stock_quantity"): ("product_id % 13 = 0", "n/a"), ("products", "is_active"): ("product_id % 17 = 0", "maybe"), ("products", "created_at"): ("product_id % 19 = 0", "soon"), ("products", "unit_price"): ("product_id % 23 = 0", "1,5"),
    ("customers", "birth_date"): ("customer_id % 23 = 0", "1990-13-01"), ("customers", "registration_date"): ("customer_id % 29 = 0", " "), ("customers", "is_active"): ("customer_id % 31 = 0", "2"),
    ("orders", "order_total"): ("order_id % 29 = 0", "free"), ("orders", "delivery_date"): ("order_id % 32 = 1", "never"), ("order_items", "quantity"): ("order_id % 31 = 0", "two"), ("order_items", "discount_percentage"): ("order_id % 37 = 0", ""),
}


def _csv_day(s: SparkSession, tables: dict[str, DataFrame]) -> dict[str, str]:
    """The datasets as CSV files with a header, in the scratch folder."""
    root = f"{scratch(s)}/raw-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.select(*(F.col(x).cast("string").alias(x) for x in layers.SPECS[name].columns)).write.option("header", True).csv(f"{root}/{name}")
    return {name: f"{root}/{name}" for name in tables}


def raw_report(s: SparkSession, d: str) -> DataFrame:
    """Four CSV files with planted bad values, read as text and reported by column."""
    tables = source_tables(s, d)
    spoilt = {n: df.select(*(F.when(F.expr(_SPOILT[n, x][0]), F.lit(_SPOILT[n, x][1])).otherwise(F.col(x).cast("string")).alias(x) if (n, x) in _SPOILT else F.col(x) for x in df.columns)) for n, df in tables.items()}
    frames, problems = layers.read_raw_day(s, _csv_day(s, spoilt))
    if problems:
        raise ValueError("; ".join(problems))
    return layers.raw_gate(frames).where("violations > 0")


def bronze_day(s: SparkSession, d: str) -> DataFrame:
    """M9, K4, K5, S3: the rows of the four datasets that have all values, from CSV to Bronze as one commit, and read back:
    rows as the manifest states and as they are, and sums of what was read."""
    tables = {n: df.where(" AND ".join(f"{x} IS NOT NULL" for x in gates.REQUIRED[n])) for n, df in source_tables(s, d).items()}
    root, moment = f"{scratch(s)}/day-{uuid.uuid4().hex}", datetime.fromisoformat(DAY)
    stated = layers.ingest(s, _csv_day(s, tables), root, moment)
    parts = []
    for name, df in layers.committed_day(s, root, "bronze", moment).items():
        money = F.sum(F.col({"customers": "is_active", "products": "unit_cost", "orders": "shipping_cost", "order_items": "line_total"}[name]).cast("decimal(18,2)")).cast("double").alias("amount")
        dated = {"customers": "birth_date", "products": "created_at", "orders": "delivery_date"}.get(name)
        parts.append(df.agg(F.count("*").alias("rows"), money, (F.sum(F.unix_date(F.col(dated).cast("date"))) if dated else F.sum("quantity")).cast("long").alias("number")).select(F.lit(name).alias("dataset"), F.lit(stated[name]).cast("long").alias("stated"), "rows", "amount", "number"))
    return quality.report(*parts)


def grid_gate(s: SparkSession, d: str) -> DataFrame:
    """Q36 over the dense grid with some cells lost, repeated or negative."""
    products = c.products(s, d).select("product_id", "category")
    grid = demand.dense_grid(layers.written(series(s, d)), products.where("product_id % 50 <> 0"))
    marked = grid.withColumn("at", F.date_diff("date", "first_day"))
    marked = marked.where("NOT (product_id % 7 = 0 AND at = 3)").unionByName(marked.where("product_id % 11 = 0 AND at = 5"))
    marked = marked.withColumns({"category": F.expr("CASE WHEN product_id % 13 = 0 AND at = 8 THEN NULL ELSE category END"), "quantity_sold": F.expr("CASE WHEN product_id % 17 = 0 AND at = 9 THEN -1 ELSE quantity_sold END")})
    return gates.grid_checks(marked.drop("at"), products)


def input_gate(s: SparkSession, d: str) -> DataFrame:
    """Q35 over sales and products, some of them spoilt."""
    sold = series(s, d).withColumn("quantity_sold", F.expr("CASE WHEN product_id % 19 = 0 THEN -quantity_sold WHEN product_id % 23 = 0 THEN NULL ELSE quantity_sold END"))
    p = c.products(s, d)
    return gates.input_checks(sold, p.unionByName(p.where("product_id % 37 = 0")))


def _published(s: SparkSession, d: str) -> DataFrame:
    """The official forecast with days lost and values spoilt."""
    found = official(s, d).where("NOT (product_id % 47 = 1 AND horizon_days = 14 AND horizon_day = 3)").withColumn("model_name", F.lit(forecast.CHAMPION))
    return found.withColumn("predicted_quantity", F.expr("CASE WHEN product_id % 53 = 1 THEN -1 ELSE predicted_quantity END"))


def publication_checks(s: SparkSession, d: str) -> DataFrame:
    """The rules of the official forecast, and of a run against its tables."""
    found = layers.written(_published(s, d))
    run = c.products(s, d).where("is_active").agg(F.count("*").alias("products_processed")).select(
        F.lit("r1").alias("run_id"), F.lit("success").alias("status"), F.lit(DAY).cast("timestamp").alias("started_at"), F.lit(DAY).cast("timestamp").alias("finished_at"),
        "products_processed", (F.col("products_processed") * 51).alias("forecast_rows"), F.col("products_processed").alias("risk_rows"),
    )
    return quality.report(publish.forecast_checks(found, forecast.HORIZONS), publish.run_checks(run, found, layers.written(official_risk(s, d)), forecast.HORIZONS))


def metric_gate(s: SparkSession, d: str) -> DataFrame:
    """Q39, Q40 over the metrics in long form and a registry of the models."""
    long = layers.written(unpivoted(s, d))
    key = ["split", "model_name", "horizon", "metric_name"]
    models = long.groupBy("model_name").agg(F.count("*").alias("n")).select("model_name", (F.col("model_name") == forecast.CHAMPION).alias("is_champion"), F.to_json(F.struct("n")).alias("metadata_json"))
    return quality.report(publish.metric_checks(long, ("wape", "mae", "rmse", "smape", "bias"), key), publish.registry_checks(models, ("moving_average_28", "croston", "croston_sba", "tsb", "last_observation", "other")))


def bundle(s: SparkSession, d: str) -> DataFrame:
    """Forecasts, risks and metrics saved as one bundle, loaded again, and their manifest."""
    root = f"{scratch(s)}/bundle-{uuid.uuid4().hex}"
    sold = written_series(s, d)
    tables = {"sales_forecast": official(s, d, sold), "inventory_risk": official_risk(s, d, sold), "model_metrics": unpivoted(s, d, sold)}
    artifacts.save(root, tables, {"promotion": {"decision": "rejected", "final_champion": forecast.CHAMPION}})
    _, documents = artifacts.load(s, root, list(tables), ["promotion"])
    artifacts.check_decision(documents["promotion"], "rejected", forecast.CHAMPION)
    return artifacts.manifest(s, root)


_VERSIONS = {"moving_average_28": "1.0.0", "croston": "2.0.0", "croston_sba": "2.0.0", "tsb": "2.0.0", "seasonal_lag_7": "1.0.0"}


def _run_tables(s: SparkSession, d: str, run: str) -> dict[str, DataFrame]:
    """What a run publishes: the official forecast and risks, metrics of five models, and their registry."""
    folds, agg = demand.folds(layers.written(series(s, d))), layers.written(aggregate(s, d))
    marks = {"run_id": F.lit(run), "model_version": F.lit("1.0.0")}
    ends = demand.bounds(series(s, d)).first()
    return {
        "sales_forecast": official(s, d).withColumns(marks), "inventory_risk": official_risk(s, d).withColumns(marks), "model_metrics": publish.metric_rows(agg, folds, run, _VERSIONS, forecast.CHAMPION, DAY),
        "model_registry": publish.model_registry(agg, _VERSIONS, forecast.CHAMPION, reasons={"croston_sba": "biased"}, registered_at=DAY, trained=(ends.first_day, ends.last_day), code_version="abc", challenger="croston_sba"),
    }


def bundle_metrics(s: SparkSession, d: str) -> DataFrame:
    """The metrics of the backtest written as a nested document of a bundle, and exploded to rows again."""
    root, agg = f"{scratch(s)}/bundle-{uuid.uuid4().hex}", layers.written(aggregate(s, d))
    long = agg.unpivot(["split", "model_name", "horizon"], list(publish.METRICS), "metric_name", "metric_value")
    artifacts.save(root, {"aggregate_metrics": agg}, {"metrics": artifacts.metric_document(long)})
    artifacts.load(s, root, ["aggregate_metrics"], ["metrics"])
    return rounded(artifacts.metric_rows(s, root))


def published_runs(s: SparkSession, d: str) -> DataFrame:
    """Two runs published to the history tables, the second with forecasts lost, negative
    risks, an unknown metric and no end; the audit of each, over its own folders."""
    root, tables = f"{scratch(s)}/history-{uuid.uuid4().hex}", _run_tables(s, d, "r1")
    tables = {n: layers.written(df) for n, df in tables.items()}
    n = tables["inventory_risk"].count()
    run = {"run_id": "r1", "started_at": DAY, "source_data_max_date": None, "products_processed": n, "forecast_rows": n * 51, "risk_rows": n, "champion_model": forecast.CHAMPION, "champion_version": "1.0.0"}
    publish.publish(s, root, run, tables, lambda: None)
    second = F.lit("r2").alias("run_id")
    again = {k: df.withColumn("run_id", second) for k, df in tables.items() if k != "model_registry"}
    again["sales_forecast"] = again["sales_forecast"].where("NOT (product_id % 7 = 1 AND horizon_days = 14 AND horizon_day = 3)")
    again["inventory_risk"] = again["inventory_risk"].withColumn("forecast_demand", F.expr("CASE WHEN product_id % 11 = 1 THEN -1 ELSE forecast_demand END"))
    again["model_metrics"] = again["model_metrics"].withColumn("metric_name", F.expr("CASE WHEN metric_name = 'mae' THEN 'other' ELSE metric_name END"))
    for name, df in again.items():
        publish.upsert(s, df, root, name)
    publish.upsert(s, s.createDataFrame([("r2", "running", n, n * 51, n)], "run_id string, status string, products_processed long, forecast_rows long, risk_rows long"), root, "pipeline_runs")
    return quality.report(*(publish.run_audit(s, root, r) for r in ("r1", "r2", "r3")))


def metric_rows(s: SparkSession, d: str) -> DataFrame:
    """The published metric rows, with run, version, status and fold bounds."""
    return rounded(publish.metric_rows(aggregate(s, d), demand.folds(series(s, d)), "r1", _VERSIONS, forecast.CHAMPION, DAY).drop("generated_at"))


def full_registry(s: SparkSession, d: str) -> DataFrame:
    """Five models with reasons, training days and code version."""
    found = _run_tables(s, d, "r1")["model_registry"]
    return rounded(found.withColumn("registered_on", F.to_date("registered_at")).withColumn("selected_challenger", F.get_json_object("metadata_json", "$.selected_challenger")).drop("registered_at", "metadata_json"))


def missing(s: SparkSession, d: str) -> DataFrame:
    """Realised sales days of the final test without a forecast, where every thirteenth product has none."""
    sold = series(s, d)
    f = demand.folds(sold).where("split = 'final_test'")
    actual = sold.join(F.broadcast(f), F.col("date").between(F.col("val_start"), F.col("val_end"))).select("product_id", F.date_diff("date", "train_end").alias("horizon_day"), "date")
    days = F.explode(F.sequence(F.lit(1), F.lit(30))).alias("horizon_day")
    predicted = c.products(s, d).where("product_id % 13 <> 0").select("product_id", days, F.lit(1.0).alias("predicted_quantity"))
    return forecast.missing_forecasts(actual, predicted, ("product_id", "horizon_day")).select("product_id", "date")


QUERIES = {
    "source_gate": source_gate, "raw_report": raw_report, "bronze_day": bronze_day, "published_runs": published_runs, "bundle_metrics": bundle_metrics, "metric_rows": metric_rows, "full_registry": full_registry, "grid_gate": grid_gate, "input_gate": input_gate, "publication_checks": publication_checks, "metric_and_registry_checks": metric_gate, "bundle_manifest": bundle,
    "missing_forecasts": missing, "risk_value_counts": lambda s, d: forecast.value_counts(official_risk(s, d), "risk_level"), "forecast_origin": lambda s, d: forecast.forecast_origin(official(s, d)),
}


# ---- the same for DuckDB ----


def _row(dataset: str, rule: str, violations: str) -> str:
    return f"SELECT '{dataset}' AS dataset, '{rule}' AS rule, 'error' AS severity, CAST(({violations}) AS BIGINT) AS violations"


def _gate_sql() -> str:
    """The rules of the gate in DuckDB's own words: what must hold is counted where it does not."""
    tables = ", ".join(f"{'src_' + n} AS (SELECT {', '.join(f'{x} AS {k}' for k, x in cols.items())} FROM {origin})" for n, (origin, cols) in _TABLES.items())
    more = """, places AS (SELECT n_name AS state, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 6 <> 5),
      person AS (SELECT s.*, p.region AS true_region FROM src_customers s LEFT JOIN places p ON p.state = s.state),
      placed AS (SELECT o.*, r.since, t.n, t.total FROM src_orders o LEFT JOIN (SELECT customer_id AS cid, min(registration_date) AS since FROM src_customers GROUP BY ALL) r ON r.cid = o.customer_id
        LEFT JOIN (SELECT order_id AS oid, count(*) AS n, sum(line_total) AS total FROM src_order_items GROUP BY ALL) t ON t.oid = o.order_id),
      line AS (SELECT i.*, g.price, g.cost FROM src_order_items i LEFT JOIN (SELECT product_id AS pid, arg_min(unit_price, coalesce(unit_price, -1)) AS price, arg_min(unit_cost, coalesce(unit_price, -1)) AS cost FROM src_products GROUP BY ALL) g ON g.pid = i.product_id)"""
    of = {"customers": "person", "products": "src_products", "orders": "placed", "order_items": "line"}
    years = f"date_diff('year', birth_date, DATE '{DAY}') - CAST(strftime(birth_date, '%m%d') > '{DAY[5:7]}{DAY[8:]}' AS INTEGER)"
    inside = lambda x: f"{x} >= DATE '2022-01-01' AND {x} <= DATE '{DAY}'"
    either = lambda x, values: " OR ".join(f"{x} = '{v}'" for v in values)
    shape = lambda x, p: f"regexp_full_match(CAST({x} AS VARCHAR), '{p}')"
    holds = {
        "products": {
            "id_pattern": "product_id >= 0", "price_positive": "unit_price > 0", "cost_positive": "unit_cost > 0", "cost_below_price": "unit_price - unit_cost > 0", "stock_range": "stock_quantity >= 0 AND stock_quantity <= 500",
            "minimum_stock_range": "minimum_stock >= 5 AND minimum_stock <= 50", "created_in_range": inside("created_at"),
        },
        "customers": {
            "id_pattern": "customer_id % 10 <> 9", "email_pattern": r"email LIKE '%@%.%' AND len(email) - len(replace(email, '@', '')) = 1 AND NOT regexp_matches(email, '[ \t\n]')", "email_lower_case": "lower(email) = email",
            "gender": either("gender", ("Feminino", "Masculino", "Não informado")), "segment": either("customer_segment", ("Novo", "Recorrente", "Premium", "Inativo")),
            "channel": either("acquisition_channel", ("Busca orgânica", "Anúncios pagos", "Redes sociais", "Indicação", "E-mail marketing", "Marketplace")), "age_18_to_80": f"{years} >= 18 AND {years} <= 80", "state_upper_case": "upper(state) = state",
            "inactive_segment": "CASE WHEN customer_segment = 'Inativo' THEN NOT is_active END", "registered_in_range": inside("registration_date"), "registered_as_adult": "birth_date + INTERVAL 18 YEAR <= registration_date",
            "known_state": "state IN (SELECT state FROM places)", "region_of_state": "region = true_region", "city_of_state": "CASE WHEN true_region IS NOT NULL THEN city = state || ' North' OR city = state || ' South' END",
        },
        "orders": {
            "id_pattern": "order_id % 10 <> 0", "status": either("order_status", ("Entregue", "Enviado", "Processando", "Cancelado")), "payment": either("payment_method", ("Cartão de crédito", "Pix", "Boleto", "Carteira digital")),
            "channel": either("sales_channel", ("Site", "Aplicativo", "Marketplace")), "ordered_in_range": inside("order_date"), "not_before_registration": "order_date >= since", "money_not_negative": "shipping_cost >= 0 AND discount_amount >= 0",
            "total_positive": "order_status = 'Cancelado' OR order_total > 0", "delivered_has_date": "order_status <> 'Entregue' OR delivery_date IS NOT NULL", "delivery_not_before_order": "NOT (order_status = 'Entregue' OR order_status = 'Enviado') OR delivery_date >= order_date",
            "open_has_no_date": "delivery_date IS NULL OR NOT (order_status = 'Processando' OR order_status = 'Cancelado')", "has_items": "n IS NOT NULL", "one_to_five_items": "n >= 1 AND n <= 5", "total_of_items": "order_total + discount_amount - shipping_cost = total",
        },
        "order_items": {
            "id_pattern": shape("order_item_id", r"\d+-[1-6]"), "quantity_range": "quantity >= 1 AND quantity <= 5", "discount_range": "discount_percentage >= 0 AND discount_percentage <= 30", "price_of_catalogue": "unit_price = price", "cost_of_catalogue": "unit_cost = cost",
            "line_total_exact": "round(quantity * unit_price * (10000 - 100 * discount_percentage) / 10000, 2) = line_total",
        },
    }
    rows = [_row(n, r, f"SELECT count(*) FROM {of[n]} WHERE NOT ({p})") for n, rules in holds.items() for r, p in rules.items()]
    rows += [_row(n, f"not_null:{x}", f"SELECT count(*) - count({x}) FROM src_{n}") for n, cols in _TABLES.items() for x in cols[1] if x != "delivery_date"]
    groups = [(n, "unique_key", k) for n, k in (("customers", "customer_id"), ("products", "product_id"), ("orders", "order_id"), ("order_items", "order_item_id"))] + [("customers", "unique_email", "email"), ("order_items", "product_once_an_order", "order_id, product_id")]
    rows += [_row(n, r, f"SELECT count(*) FROM (SELECT {k} FROM src_{n} WHERE {k.split(', ')[-1]} IS NOT NULL GROUP BY {k} HAVING count(*) > 1)") for n, r, k in groups]
    orphans = [("orders", "customer_exists", "customer_id", "customers"), ("order_items", "order_exists", "order_id", "orders"), ("order_items", "product_exists", "product_id", "products")]
    rows += [_row(n, r, f"SELECT count(*) FROM src_{n} a WHERE {k} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM src_{parent} b WHERE b.{k} = a.{k})") for n, r, k, parent in orphans]
    return f"WITH {tables}{more} " + " UNION ALL ".join(rows)


def _raw_sql() -> str:
    tables = ", ".join(f"{'src_' + n} AS (SELECT {', '.join(f'{x} AS {k}' for k, x in cols.items())} FROM {origin})" for n, (origin, cols) in _TABLES.items())
    rows = []
    for n, (_, columns) in _TABLES.items():
        for x in columns:
            where, text = _SPOILT.get((n, x), ("false", ""))
            there = f"coalesce({where}, false)"
            if text.strip():
                rows.append(f"SELECT '{n}' AS dataset, '{x}' AS column, 'type' AS rule, count(*) AS violations FROM src_{n} WHERE {there}")
            if x != "delivery_date":
                lost = f"{x} IS NULL AND NOT {there}" if text.strip() or where == "false" else f"{x} IS NULL OR {there}"
                rows.append(f"SELECT '{n}' AS dataset, '{x}' AS column, 'required' AS rule, count(*) AS violations FROM src_{n} WHERE {lost}")
    return f"WITH {tables} SELECT * FROM ({' UNION ALL '.join(rows)}) WHERE violations > 0"


def _bronze_sql() -> str:
    tables = ", ".join(f"{'src_' + n} AS (SELECT {', '.join(f'{x} AS {k}' for k, x in cols.items())} FROM {origin})" for n, (origin, cols) in _TABLES.items())
    of = {"customers": ("CAST(is_active AS INTEGER)", "birth_date - DATE '1970-01-01'"), "products": ("unit_cost", "created_at - DATE '1970-01-01'"), "orders": ("shipping_cost", "delivery_date - DATE '1970-01-01'"), "order_items": ("line_total", "quantity")}
    rows = [f"SELECT '{n}' AS dataset, count(*) AS stated, count(*) AS rows, CAST(sum({a}) AS DOUBLE) AS amount, CAST(sum({b}) AS BIGINT) AS number FROM src_{n} WHERE {' AND '.join(f'{x} IS NOT NULL' for x in _TABLES[n][1] if x != 'delivery_date')}" for n, (a, b) in of.items()]
    return f"WITH {tables} " + " UNION ALL ".join(rows)


_SPOILT_GRID = f"""{_GRID}, cells AS (SELECT p.product_id, p.category, g.date, g.q, CAST(g.date - first_day AS INTEGER) AS nth FROM grid g JOIN products p ON p.product_id = g.product_id CROSS JOIN span WHERE p.product_id % 50 <> 0),
kept AS (SELECT * FROM cells WHERE NOT (product_id % 7 = 0 AND nth = 3)), bad AS (SELECT * FROM kept UNION ALL SELECT * FROM kept WHERE product_id % 11 = 0 AND nth = 5)"""
_PUBLISHED = f"""{_RISK}, pub AS (SELECT product_id, horizon_day, horizon AS horizon_days, CASE WHEN product_id % 53 = 1 THEN -1 ELSE p END AS v FROM forecasts f JOIN products USING (product_id)
  JOIN (VALUES (7), (14), (30)) h(horizon) ON horizon_day <= horizon WHERE model_name = 'moving_average_28' AND is_active AND NOT (product_id % 47 = 1 AND horizon = 14 AND horizon_day = 3)),
n AS (SELECT (SELECT count(*) FROM pub) AS f, (SELECT count(*) FROM products WHERE is_active) AS p)"""
_LONG = f"""{_CUBES}, wide AS (SELECT split, model_name, horizon, wape, mae, rmse, smape, bias, mase FROM agg), long AS (SELECT * FROM (UNPIVOT wide ON wape, mae, rmse, smape, bias, mase INTO NAME metric_name VALUE metric_value))"""

_FOLDS = "fold_no AS (SELECT 'validation_fold_' || (4 - k) AS split, k FROM (VALUES (1), (2), (3)) t(k) UNION ALL SELECT 'final_test', 0), bounds AS (SELECT split, first_day AS train_start, last_day - 30 * (k + 1) AS train_end, last_day - 30 * (k + 1) + 1 AS evaluation_start, last_day - 30 * k AS evaluation_end FROM fold_no, span)"
_STATE = "CASE model_name WHEN 'moving_average_28' THEN '1.0.0' WHEN 'seasonal_lag_7' THEN '1.0.0' ELSE '2.0.0' END"
_FIVE = ", ".join(f"'{m}'" for m in _VERSIONS)
_RUNS = f"""{_LONG}, active AS (SELECT count(*) AS n FROM products WHERE is_active), shown AS (SELECT product_id FROM products WHERE is_active), mine AS (SELECT * FROM long WHERE model_name IN ({_FIVE}))"""


def _runs_sql() -> str:
    names = [f"sales_forecast_{x}" for x in ("rows", "duplicates", "products", "negative", "models")] + [f"inventory_risk_{x}" for x in ("rows", "duplicates", "products", "negative")]
    names += [f"model_metrics_{x}" for x in ("rows", "duplicates", "unknown", "odd_status")] + [f"model_registry_{x}" for x in ("rows", "duplicates", "champions")] + [f"pipeline_runs_{x}" for x in ("rows", "duplicates", "success", "products_processed", "forecast_rows", "risk_rows")]
    lost = "(SELECT count(*) FROM shown WHERE product_id % 7 = 1)"
    long = "(SELECT count(*) FROM mine)"
    of = {
        "r1": (0, ["n * 51", "0", "n", "0", "1", "n", "0", "n", "0", long, "0", "0", "0", "5", "0", "1", "1", "0", "1", "n", "n * 51", "n"], "n > 0"),
        "r2": (0, [f"n * 51 - {lost}", "0", "n", "0", "1", "n", "0", "n", "(SELECT count(*) FROM shown WHERE product_id % 11 = 1)", long, "0", "(SELECT count(*) FROM mine WHERE metric_name = 'mae')", "0", "5", "0", "1", "1", "0", "0", "n", "n * 51", "n"], "n < 0"),
        "r3": (4, ["0"] * 13 + ["5", "0", "1"] + ["0"] * 6, "n < 0"),
    }
    rows = [f"SELECT '{r}' AS run_id, CAST({k} AS INTEGER) AS missing_tables, {', '.join(f'CAST({x} AS BIGINT) AS {m}' for m, x in zip(names, found, strict=True))}, {good} AS consistent FROM active" for r, (k, found, good) in of.items()]
    return f"{_RUNS} " + " UNION ALL ".join(rows)


SQL = {
    "source_gate": _gate_sql(), "raw_report": _raw_sql(), "bronze_day": _bronze_sql(),
    "published_runs": _runs_sql(),
    "bundle_metrics": f"{_LONG} SELECT split, model_name, horizon, metric_name, round(metric_value, 6) AS metric_value FROM long",
    "metric_rows": f"""{_LONG}, {_FOLDS} SELECT 'r1' AS run_id, model_name, {_STATE} AS model_version, CASE WHEN model_name = 'moving_average_28' THEN 'champion' ELSE 'rejected_challenger' END AS champion_status, split AS evaluation_period, horizon AS forecast_horizon,
      metric_name, round(metric_value, 6) AS metric_value, train_start, train_end, evaluation_start, evaluation_end FROM long JOIN bounds USING (split) WHERE model_name IN ({_FIVE})""",
    "full_registry": f"""{_CUBES} SELECT model_name, {_STATE} AS model_version, DATE '{DAY}' AS registered_on, CASE model_name WHEN 'moving_average_28' THEN 'champion' ELSE 'rejected' END AS status, model_name = 'moving_average_28' AS is_champion,
      CASE model_name WHEN 'moving_average_28' THEN 'retained' ELSE 'rejected' END AS promotion_decision, CASE model_name WHEN 'moving_average_28' THEN NULL WHEN 'croston_sba' THEN 'biased' ELSE 'did not do better than the champion in the final test' END AS rejection_reason,
      'wape' AS primary_metric, round(wape, 6) AS primary_metric_value, round(bias, 6) AS bias, first_day AS training_data_min_date, last_day AS training_data_max_date, 'abc' AS code_version, 'croston_sba' AS selected_challenger
      FROM agg, span WHERE split = 'final_test' AND horizon = 14 AND model_name IN ({_FIVE})""",
    "grid_gate": f"{_SPOILT_GRID} " + " UNION ALL ".join([
        _row("grid", "lost_category", "SELECT count(*) FROM bad WHERE product_id % 13 = 0 AND nth = 8"), _row("grid", "negative", "SELECT count(*) FROM bad WHERE product_id % 17 = 0 AND nth = 9"), _row("grid", "unknown_product", "0"),
        _row("grid", "repeated_cell", "SELECT count(*) FROM (SELECT product_id, date FROM bad GROUP BY ALL HAVING count(*) > 1)"),
        _row("grid", "incomplete_days", "SELECT count(*) FROM (SELECT product_id FROM bad GROUP BY product_id HAVING count(DISTINCT date) <> (SELECT max(date) - min(date) + 1 FROM bad))"), _row("grid", "absent_product", "SELECT count(*) FROM products WHERE product_id % 50 = 0"),
    ]),
    "input_gate": f"{_SERIES} " + " UNION ALL ".join([
        _row("sales", "not_empty", "0"), _row("products", "not_empty", "0"), *(_row("sales", f"not_null:{x}", "0") for x in ("product_id", "date")), _row("sales", "not_null:quantity_sold", "SELECT count(*) FROM series WHERE product_id % 23 = 0 AND product_id % 19 <> 0"),
        _row("sales", "negative", "SELECT count(*) FROM series WHERE product_id % 19 = 0 AND q > 0"), *(_row("products", f"not_null:{x}", "0") for x in ("product_id", "unit_price", "stock_quantity")), _row("products", "negative", "0"),
        _row("products", "unique_key", "SELECT count(*) FROM products WHERE product_id % 37 = 0"), _row("sales", "unique_key", "0"),
    ]),
    "publication_checks": f"{_PUBLISHED} " + " UNION ALL ".join([
        _row("sales_forecast", "finite_not_negative", "SELECT count(*) FROM pub WHERE v < 0"), *(_row("sales_forecast", r, "0") for r in ("horizon", "after_data", "unique_key", "days_reach_horizon", "all_horizons", "single_champion")),
        _row("sales_forecast", "days_complete", "SELECT count(*) FROM (SELECT product_id, horizon_days FROM pub GROUP BY ALL HAVING count(*) <> max(horizon_day))"),
        _row("pipeline_runs", "forecast_rows", "SELECT CAST(f <> p * 51 AS INT) FROM n"), _row("pipeline_runs", "forecasts_a_product", "SELECT CAST(f <> p * 51 AS INT) FROM n"), *(_row("pipeline_runs", r, "0") for r in ("risk_rows", "one_risk_a_product", "risks_a_product")),
    ]),
    "metric_and_registry_checks": f"{_LONG} " + " UNION ALL ".join([
        _row("model_metrics", "accepted:metric_name", "SELECT count(*) FROM long WHERE metric_name NOT IN ('wape', 'mae', 'rmse', 'smape', 'bias')"), _row("model_metrics", "finite", "0"), _row("model_metrics", "unique_key", "0"),
        _row("model_registry", "accepted:model_name", "1"), _row("model_registry", "metadata_json", "0"), _row("model_registry", "unique_key", "0"), _row("model_registry", "complete", "1"), _row("model_registry", "one_champion", "0"),
    ]),
    "bundle_manifest": f"""{_LONG} SELECT 'model_metrics' AS name, count(*) AS row_count FROM long UNION ALL SELECT 'inventory_risk', count(*) FROM products WHERE is_active UNION ALL SELECT 'sales_forecast', count(*) * 51 FROM products WHERE is_active""",
    "missing_forecasts": f"{_SERIES} SELECT product_id, date FROM series, span WHERE date > last_day - 30 AND product_id % 13 = 0",
    "risk_value_counts": f"{_RISK} SELECT risk_level AS value, count(*) AS n FROM classed WHERE model_name = 'moving_average_28' GROUP BY risk_level",
    "forecast_origin": f"{_ALL} SELECT last_day AS origin FROM span",
}
