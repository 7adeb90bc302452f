"""Column functions, layers and quality rules on literal rows."""

from datetime import date, datetime, timezone, timedelta

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from mercadia.plans import profile
from mercadia import queries_quality
from mercadia.functions import columns as fn
from mercadia.operators import quality
from mercadia.sources import layers


def one(spark, value, kind, f):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v"))).first()[0]


@pytest.mark.parametrize("text,clean", [("  Bruno   Souza ", "Bruno Souza"), ("\t \n", None), (None, None), ("a  b", "a b")])
def test_clean_text(spark, text, clean):
    assert one(spark, text, "string", fn.clean_text) == clean


@pytest.mark.parametrize("text,strict,digits", [("TRUE ", True, True), (" false", False, False), ("1", None, True), ("0", None, False), ("yes", None, None), (None, None, None)])
def test_booleans(spark, text, strict, digits):
    assert one(spark, text, "string", fn.parse_boolean) is strict
    assert one(spark, text, "string", lambda c: fn.parse_boolean(c, True)) is digits


def test_money_rounds_half_up(spark):
    assert str(one(spark, "1.005", "string", lambda c: fn.money(c.cast("decimal(10,3)")))) == "1.01"
    n = spark.createDataFrame([(10, 3)], "t long, n long").select(fn.average_money(F.col("t").cast("decimal(18,2)"), F.col("n"))).first()[0]
    assert n == 3.33


def test_dates(spark):
    assert one(spark, date(2004, 2, 29), "date", lambda c: fn.shift_years(c, 18)) == date(2022, 2, 28)
    assert one(spark, date(2004, 2, 29), "date", lambda c: fn.age_on(c, F.lit("2022-02-28").cast("date"))) == 17
    assert one(spark, date(2004, 2, 28), "date", lambda c: fn.age_on(c, F.lit("2022-02-28").cast("date"))) == 18
    assert layers.day_of(datetime(2026, 7, 3, 1, tzinfo=timezone(timedelta(hours=3)))) == {"year": "2026", "month": "07", "day": "02"}
    assert layers.day_of(datetime(2026, 7, 3))["day"] == "03"


@pytest.mark.parametrize("name,snake", [("CustomerID", "customer_id"), (" Order Date ", "order_date"), ("a--b", "a_b"), ("x", "x")])
def test_snake_case(name, snake):
    assert fn.snake_case(name) == snake


RAW = [("CUST-000001", "  Bruno   Souza ", " BRUNO@example.com ", "1990-01-02", "Masculino", "Recife", "pe", "Nordeste", "2024-01-02", "Site", "Novo", "1")]


def test_layers_end_to_end(spark, tmp_path):
    spec = layers.SPECS["customers"]
    spark.createDataFrame(RAW, spec.raw).write.option("header", True).csv(f"{tmp_path}/raw")
    raw, problems = layers.read_raw(spark, f"{tmp_path}/raw", "customers")
    assert problems == [] and layers.bad_values(raw, "customers").count() == 0
    day = datetime(2026, 7, 3)
    path = layers.write_day(layers.to_bronze(raw, "customers"), str(tmp_path), "bronze", "customers", day)
    assert path.endswith("bronze/customers/year=2026/month=07/day=03")
    layers.write_day(layers.to_bronze(raw, "customers"), str(tmp_path), "bronze", "customers", day + timedelta(days=1))
    layers.write_day(layers.to_bronze(raw, "customers"), str(tmp_path), "bronze", "customers", day)  # a rerun replaces its day
    silver = layers.to_silver(layers.read_day(spark, str(tmp_path), "bronze", "customers", day), "customers").collect()
    assert len(silver) == 1
    row = silver[0]
    assert (row.full_name, row.email, row.state, row.is_active, row.birth_date) == ("Bruno Souza", "bruno@example.com", "PE", True, datetime(1990, 1, 2))
    with pytest.raises(ValueError):
        layers.read_day(spark, str(tmp_path), "bronze", "customers", day + timedelta(days=9))


def test_raw_problems_are_listed(spark, tmp_path):
    assert "cannot be read" in layers.read_raw(spark, f"{tmp_path}/none", "orders")[1][0]
    spark.createDataFrame([("1",)], "order_id string").write.option("header", True).csv(f"{tmp_path}/o")
    assert "missing columns" in layers.read_raw(spark, f"{tmp_path}/o", "orders")[1][0]
    raw = spark.createDataFrame([("P1", "n", "c", "b", "s", "x9", "2.0", "1", "1", "2024-01-01", "maybe")], layers.SPECS["products"].raw)
    assert {r.column: r.violations for r in layers.bad_values(raw, "products").collect()} == {"unit_price": 1, "is_active": 1}
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|bad boolean"):
        layers.to_bronze(raw, "products").collect()


def test_warehouse_load_confirms_rows(spark):
    assert layers.load_table(spark.range(7).withColumnRenamed("id", "order_id"), "loaded_orders") == 7
    assert layers.load_table(spark.range(3).withColumnRenamed("id", "order_id"), "loaded_orders") == 3


def test_each_rule_fires_alone(spark):
    good = [(1, 5.0, "a"), (2, 6.0, "b"), (3, None, None)]
    rules = [quality.Rule("positive", F.col("v") <= 0), quality.accepted("k", ["a", "b"]), *quality.not_null(["id"])]
    count = lambda rows: {r.rule: r.violations for r in quality.row_rules(spark.createDataFrame(rows, "id int, v double, k string"), "t", rules).collect()}
    assert count(good) == {"positive": 0, "accepted:k": 0, "not_null:id": 0}
    assert count([*good, (4, -1.0, "a")])["positive"] == 1
    assert count([*good, (4, 1.0, "z")])["accepted:k"] == 1
    assert count([*good, (None, 1.0, "a")])["not_null:id"] == 1
    assert count([]) == {"positive": 0, "accepted:k": 0, "not_null:id": 0}


def test_relational_rules(spark):
    child = spark.createDataFrame([(1, 1), (2, 9), (3, None)], "id int, p int")
    parent = spark.createDataFrame([(1,)], "pid int")
    assert [r.id for r in quality.orphans(child, "p", parent, "pid").collect()] == [2]
    assert quality.duplicates(child.union(child.limit(1)), ["id"]).count() == 1
    a, b = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0)], "k int, v double"), spark.createDataFrame([(1, 1.005), (2, 2.5), (4, 1.0)], "k int, v double")
    assert sorted(r.k for r in quality.reconcile(a, b, ["k"], ["v"]).collect()) == [2, 3, 4]
    report = quality.report(quality.as_rule(child.limit(0), "t", "x"), quality.as_rule(child, "t", "w", "warning"))
    assert quality.is_valid(report) and not quality.is_valid(quality.as_rule(child, "t", "y"))
    assert quality.schema_violations(child.schema, parent.schema) == ["missing:pid", "unexpected:id", "unexpected:p"]


def test_declared_schema_tests_count_planted_violations(spark):
    parents = spark.sql("SELECT * FROM VALUES (1), (2), (NULL) AS p(id)")
    children = spark.sql("SELECT * FROM VALUES (1, 1, 'a'), (1, 2, 'b'), (2, 9, 'x'), (3, NULL, NULL), (NULL, 2, 'a'), (NULL, NULL, 'x') AS c(key, parent, state)")
    tests = {"children": quality.Declared(["key", "state"], ["key"], {"state": ("a", "b")}, {"parent": ("parents", "id")})}
    found = {r.rule: r.violations for r in quality.schema_tests({"parents": parents, "children": children}, tests).collect()}
    assert found == {"not_null:key": 2, "not_null:state": 1, "accepted:state": 2, "unique:key": 1, "relation:parent": 1}
    none = quality.schema_tests({"parents": parents, "children": children.limit(0)}, tests).collect()
    assert len(none) == 5 and not any(r.violations for r in none)


def test_a_declared_model_or_column_that_is_missing_raises(spark):
    one = spark.range(1)
    with pytest.raises(KeyError):
        quality.schema_tests({}, {"a": quality.Declared(["id"])})
    with pytest.raises(AnalysisException):
        quality.schema_tests({"a": one}, {"a": quality.Declared(["other"])})


def test_audit_counts_every_planted_fault_once(spark):
    from mercadia.operators.quality import Rule
    from mercadia.plans import profile

    day = date(2024, 3, 1)
    good = ("i1", 1, 1, day, "F", True, 2)
    planted = [good, good, ("i2", 9, 1, day, "F", True, 1), ("i3", 1, 9, day, "F", True, 1), ("i4", 1, 1, day, None, False, 1), ("i5", 1, 1, day, "F", None, 99), ("i6", 1, 2, day, "F", True, 1), ("i7", 1, 3, day, "F", True, 1), (None, None, None, None, None, None, None)]
    schema = "order_item_id string, order_id long, product_id long, order_date date, order_status string, is_realized_sale boolean, quantity long"
    products = spark.createDataFrame([(1, date(2024, 1, 1), True), (1, date(2024, 2, 1), True), (2, date(2024, 1, 1), False), (3, date(2024, 4, 1), True), (4, None, True)], "product_id long, created_at date, is_active boolean")
    daily = spark.createDataFrame([(day, 5), (day, 2)], "sales_date date, total_items_sold long")
    orders = spark.createDataFrame([(1,), (1,)], "order_id long")
    ranges = [Rule("quantity", F.col("quantity") > 50)]
    run = lambda fact, mart, made, o: {r.check: (r.violations, r.rows_checked) for r in profile.audit(fact, mart, made, o, ("order_item_id", "order_status"), ranges).collect()}
    fact = spark.createDataFrame(planted, schema)
    assert run(fact, daily, products, orders) == {
        "repeated_in_fact": (1, 8), "repeated_in_daily": (1, 2), "repeated_in_products": (1, 5), "null_in_fact": (2, 9), "null_in_products": (1, 5), "out_of_range": (1, 9), "unknown_product": (1, 9),
        "unknown_order": (1, 9), "sold_before_creation": (1, 9), "inactive_realised": (1, 6), "units_fact_to_daily": (1, 2),
    }
    empty = run(fact.limit(0), daily.limit(0), products.limit(0), orders.limit(0))
    assert len(empty) == 11 and set(empty.values()) == {(0, 0)}


def test_zero_rate_without_a_grid(spark):
    from mercadia.plans import profile

    sold = spark.createDataFrame([(1, date(2024, 1, 1), 2.0, 1.0), (1, date(2024, 1, 4), 1.0, 1.0), (2, date(2024, 1, 2), 0.0, 0.0), (9, date(2024, 1, 2), 5.0, 1.0)], "product_id long, date date, quantity_sold double, revenue double")
    products = spark.createDataFrame([(1,), (2,), (3,)], "product_id long")
    assert tuple(profile.zero_rate(sold, products).first()) == (4, 3, 12, 10, 10 / 12)
    assert tuple(profile.zero_rate(sold.limit(0), products).first()) == (0, 3, 0, 0, None)


def test_audit_joins_keys_alone(spark):
    fact = spark.sql("SELECT 'a' AS order_item_id, 1 AS order_id, 2 AS product_id, DATE '2020-01-01' AS order_date, true AS is_realized_sale, 3 AS quantity, 'wide' AS note")
    fact = fact.unionByName(fact.withColumn("order_id", F.lit(9))).unionByName(fact.withColumn("order_id", F.lit(None).cast("int")))
    daily = spark.sql("SELECT DATE '2020-01-01' AS sales_date, 9 AS total_items_sold")
    products = spark.sql("SELECT 2 AS product_id, DATE '2020-01-02' AS created_at, false AS is_active")
    found = profile.audit(fact, daily, products, spark.sql("SELECT 1 AS order_id"), ["order_item_id", "order_id", "note"], [])
    got = {r.check: (r.violations, r.rows_checked) for r in found.collect()}
    assert got["null_in_fact"] == (1, 3) and got["unknown_order"] == (1, 3) and got["unknown_product"] == (0, 3) and got["units_fact_to_daily"] == (0, 1)
    assert got["sold_before_creation"] == (3, 3) and got["inactive_realised"] == (3, 3) and got["repeated_in_fact"] == (1, 3)

    def nodes(plan):
        yield plan
        for k in range(plan.children().size()):
            yield from nodes(plan.children().apply(k))

    wide = spark.createDataFrame(fact.rdd, fact.schema)
    plan = profile.audit(wide, daily, products, spark.createDataFrame([(1,)], "order_id int"), ["order_item_id", "note"], [])._jdf.queryExecution().optimizedPlan()
    joins = [n.output().toString() for n in nodes(plan) if n.nodeName() == "Join"]
    assert joins and not any("order_item_id" in x or "note" in x for x in joins)


def test_schema_tests_join_the_items_once(spark, monkeypatch):
    read = []
    monkeypatch.setattr(queries_quality.layers, "written", lambda df, _of=layers.written: (read.append(any("lineitem" in x for x in df.inputFiles())), _of(df))[1])
    found = queries_quality.schema_test_report(spark, "/root/testdata/sf0.001")
    assert "dataset" in found.columns and sum(read) == 1


def test_items_are_dealt_by_order_once(spark, capsys):
    from mercadia.plans import sales

    items = spark.createDataFrame([(1, 7, 2), (1, 7, 1), (1, 8, 3), (2, 7, 1)], "order_id long, product_id long, quantity int")
    enriched = items.selectExpr("*", *(f"CAST(quantity AS DECIMAL(18,2)) AS {x}" for x in ("line_gross_amount", "line_discount_amount", "line_total", "line_cost_amount")))
    orders = spark.createDataFrame([(1, 5), (2, 5)], "order_id long, customer_id long").selectExpr("*", "current_date() AS order_date", "'F' AS order_status", "'x' AS sales_channel", "1 AS shipping_cost", "0 AS discount_amount", "1 AS order_total")
    customers = spark.createDataFrame([(5, "a", "b", "c")], "customer_id long, full_name string, state string, region string")
    found = sales.enriched_orders(orders, customers, enriched)
    found.explain()
    plan = capsys.readouterr().out
    assert plan.count("REPARTITION_BY_COL") == 1 and not any("Exchange" in x and "product_id" in x for x in plan.splitlines())
    assert sorted((r.order_id, r.order_item_count, r.item_quantity, r.distinct_products) for r in found.collect()) == [(1, 3, 6, 2), (2, 1, 1, 1)]
