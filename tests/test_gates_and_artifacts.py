"""Gates, Silver promotion, publication checks, bundles and concurrent upserts on small fixtures."""

from collections import Counter
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from mercadia.functions.columns import snake_case
from mercadia.operators import artifacts, gates, metrics, publish
from mercadia.plans import forecast
from mercadia.sources import commits, layers


DAY = date(2024, 5, 1)
SCHEMAS = {
    "customers": "customer_id string, full_name string, email string, birth_date date, gender string, city string, state string, region string, registration_date date, acquisition_channel string, customer_segment string, is_active boolean",
    "products": "product_id string, product_name string, category string, brand string, supplier string, unit_price double, unit_cost double, stock_quantity long, minimum_stock long, created_at date, is_active boolean",
    "orders": "order_id string, customer_id string, order_date date, order_status string, payment_method string, sales_channel string, shipping_cost double, discount_amount double, order_total double, delivery_date date",
    "order_items": "order_item_id string, order_id string, product_id string, quantity long, unit_price double, unit_cost double, discount_percentage double, line_total double",
}
ROWS = {
    "customers": [("CUST-000001", "A", "a@b.example", date(1990, 2, 28), "Feminino", "Santos", "SP", "Sudeste", DAY, "Indicação", "Novo", True), ("CUST-000002", "B", "c@d.example", date(1960, 1, 1), "Masculino", "Niterói", "RJ", "Sudeste", DAY, "Marketplace", "Inativo", False)],
    "products": [("PROD-000001", "p", "c", "b", "s", 10.0, 6.0, 5, 5, DAY, True), ("PROD-000002", "q", "c", "b", "s", 20.0, 6.0, 0, 50, DAY, False)],
    "orders": [("ORD-00000001", "CUST-000001", date(2024, 6, 1), "Entregue", "Pix", "Site", 5.0, 1.0, 24.0, date(2024, 6, 3)), ("ORD-00000002", "CUST-000002", date(2024, 6, 1), "Cancelado", "Boleto", "Site", 0.0, 0.0, 14.0, None)],
    "order_items": [("ITEM-00000001", "ORD-00000001", "PROD-000001", 2, 10.0, 6.0, 0.0, 20.0), ("ITEM-00000002", "ORD-00000002", "PROD-000002", 1, 20.0, 6.0, 30.0, 14.0)],
}


def source(spark):
    return {n: spark.createDataFrame(ROWS[n], SCHEMAS[n]) for n in SCHEMAS}


def places(spark):
    return spark.createDataFrame([("SP", "Sudeste", ["Santos", "Campinas"]), ("RJ", "Sudeste", ["Niterói"]), ("BA", "Nordeste", ["Ilhéus"])], "state string, region string, cities array<string>")


def broken(tables, where=None):
    return {(r.dataset, r.rule): r.violations for r in gates.gate(tables, "2026-07-28", where).where("violations > 0").collect()}


def test_a_clean_day_passes(spark):
    tables = source(spark)
    assert broken(tables, places(spark)) == {}
    gates.require(gates.gate(tables, "2026-07-28"))
    with pytest.raises(ValueError, match="missing: \\['products'\\]"):
        gates.gate({k: v for k, v in tables.items() if k != "products"}, "2026-07-28")
    with pytest.raises(ValueError, match="columns missing: orders.delivery_date, products.brand"):
        gates.gate(tables | {"orders": tables["orders"].drop("delivery_date"), "products": tables["products"].drop("brand")}, "2026-07-28")


#: By dataset: the row to copy, a column, the value that stands in it, and what breaks in (dataset, rule).
PLANTED = {
    "customers": [
        (0, "email", "X@b.example", {"email_lower_case": 1}), (0, "email", "X@b.example", {"email_lower_case": 1, "unique_email": 1}), (0, "email", "a b@c.example", {"email_pattern": 1}), (0, "email", "a@b@c.example", {"email_pattern": 1}), (0, "email", "a@b", {"email_pattern": 1}),
        (0, "birth_date", date(2010, 3, 1), {"age_18_to_80": 1, "registered_as_adult": 1}), (0, "gender", "?", {"gender": 1}), (0, "city", "Ilhéus", {"city_of_state": 1}), (1, "region", "Nordeste", {"region_of_state": 1}), (0, "acquisition_channel", "Radio", {"channel": 1}),
        (0, "state", "ba", {"state_upper_case": 1, "known_state": 1}), (0, "state", "BA", {"region_of_state": 1, "city_of_state": 1}), (0, "registration_date", date(2021, 1, 1), {"registered_in_range": 1}), (0, "customer_segment", "VIP", {"segment": 1}),
        (0, "customer_segment", "Inativo", {"inactive_segment": 1}), (0, "customer_id", "CUST-1", {"id_pattern": 1}), (0, "customer_id", "CUST-000001", {"unique_key": 1}),
    ],
    "products": [
        (0, "unit_price", 0.0, {"price_positive": 1, "cost_below_price": 1}), (0, "unit_cost", 0.0, {"cost_positive": 1}), (0, "stock_quantity", 501, {"stock_range": 1}), (0, "minimum_stock", 4, {"minimum_stock_range": 1}),
        (0, "created_at", date(2027, 1, 1), {"created_in_range": 1}), (0, "product_id", "PROD-01", {"id_pattern": 1}),
    ],
    "orders": [
        (1, "order_status", "Aberto", {"status": 1}), (0, "payment_method", "Cash", {"payment": 1}), (0, "sales_channel", "Phone", {"channel": 1}), (0, "order_date", date(2024, 4, 1), {"not_before_registration": 1}), (1, "order_date", date(2030, 4, 1), {"ordered_in_range": 1}),
        (0, "shipping_cost", -5.0, {"money_not_negative": 1, "total_of_items": 1}), (0, "order_total", 0.0, {"total_positive": 1, "total_of_items": 1}), (0, "order_total", 999999.0, {"total_of_items": 1}), (0, "delivery_date", None, {"delivered_has_date": 1}),
        (0, "delivery_date", date(2024, 5, 20), {"delivery_not_before_order": 1}), (1, "delivery_date", date(2024, 7, 1), {"open_has_no_date": 1}), (0, "customer_id", "CUST-000009", {"customer_exists": 1}), (0, "order_id", "ORD-1", {"id_pattern": 1, "has_items": 1, ("order_items", "order_exists"): 1}),
    ],
    "order_items": [
        (1, "quantity", 6, {"quantity_range": 1, "line_total_exact": 1}), (0, "discount_percentage", 31.0, {"discount_range": 1, "line_total_exact": 1}), (0, "unit_price", 10.002, {"price_of_catalogue": 1}), (0, "unit_cost", 6.5, {"cost_of_catalogue": 1}),
        (0, "line_total", 12345.0, {"line_total_exact": 1, ("orders", "total_of_items"): 1}), (0, "order_id", "ORD-09999999", {"order_exists": 1, ("orders", "has_items"): 1}), (0, "product_id", "PROD-000009", {"product_exists": 1}), (0, "order_item_id", "I", {"id_pattern": 1}),
    ],
}


def test_each_rule_finds_its_rows(spark):
    """One planted row a case, all in one day: each rule counts just its own."""
    rows, expected, n = {k: list(v) for k, v in ROWS.items()}, Counter(), 100

    def put(dataset, copied, **values):
        names = [c.split()[0] for c in SCHEMAS[dataset].split(", ")]
        rows[dataset].append(tuple((dict(zip(names, ROWS[dataset][copied], strict=True)) | values).values()))

    for dataset, cases in PLANTED.items():
        for copied, column, value, rules in cases:
            n += 1
            own = {"customers": {"customer_id": f"CUST-{n:06d}", "email": f"k{n}@b.example"}, "products": {"product_id": f"PROD-{n:06d}"}, "orders": {"order_id": f"ORD-{n:08d}"}, "order_items": {"order_item_id": f"ITEM-{n:08d}", "order_id": f"ORD-{n:08d}"}}
            put(dataset, copied, **own[dataset] | {column: value})
            if dataset == "orders":
                put("order_items", copied, **own["order_items"])
            if dataset == "order_items":
                put("orders", copied, **own["orders"])
            for rule, k in rules.items():
                expected[rule if isinstance(rule, tuple) else (dataset, rule)] += k
    assert broken({n: spark.createDataFrame(rows[n], SCHEMAS[n]) for n in SCHEMAS}, places(spark)) == expected


def test_every_required_value_must_be_there(spark):
    """A null breaks no other rule, but that it must not be there; relations of a null are no orphans."""
    t = source(spark)
    nothing = {n: df.select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema)).limit(1) for n, df in t.items()}
    found = broken({n: t[n].unionByName(nothing[n]) for n in t}, places(spark))
    assert found == {(n, f"not_null:{c}"): 1 for n in t for c in gates.REQUIRED[n]} | {("orders", "has_items"): 1}


def test_five_items_an_order_and_each_product_once(spark):
    t = source(spark)
    six = spark.createDataFrame([(f"ITEM-{k:08d}", "ORD-00000001", "PROD-000001", 1, 10.0, 6.0, 0.0, 10.0) for k in range(10, 15)], SCHEMAS["order_items"])
    assert broken(t | {"order_items": t["order_items"].unionByName(six)}) == {("orders", "one_to_five_items"): 1, ("orders", "total_of_items"): 1, ("order_items", "product_once_an_order"): 1}
    assert broken(t | {"order_items": t["order_items"].limit(0)}) == {("orders", "has_items"): 2}


def test_lookup_does_not_hang_on_the_order_of_rows(spark):
    rows = [("P1", 3.0), ("P1", 2.0), ("P2", None)]
    for part in (rows, rows[::-1]):
        got = gates.lookup(spark.createDataFrame(part, "product_id string, unit_price double"), "product_id", {"unit_price": "catalogue_price"}).collect()
        assert {r.product_id: r.catalogue_price for r in got} == {"P1": 2.0, "P2": None}


MOMENT = datetime(2026, 7, 28)


def write_csv(folder, rows=ROWS, tail=""):
    """The four datasets as CSV files; tail: lines more for the orders."""
    paths = {}
    for n, schema in SCHEMAS.items():
        names = [c.split()[0] for c in schema.split(", ")]
        lines = [",".join(names)] + [",".join("" if x is None else str(x).lower() if isinstance(x, bool) else f'"{x}"' if isinstance(x, str) else str(x) for x in r) for r in rows[n]]
        (folder / f"{n}.csv").write_text("\n".join(lines) + "\n" + (tail if n == "orders" else ""), encoding="utf-8")
        paths[n] = str(folder / f"{n}.csv")
    return paths


def test_raw_to_bronze_to_silver_to_tables(spark, tmp_path):
    rows = dict(ROWS, customers=[*ROWS["customers"], ("CUST-000003", "Name, \n with  break", "E@F.example", date(1980, 1, 1), "Feminino", "Santos", "sp", "Sudeste", DAY, "Indicação", "Novo", True)])
    root, paths = str(tmp_path / "lake"), write_csv(tmp_path, rows)
    stated = {"customers": 3, "products": 2, "orders": 2, "order_items": 2}
    assert layers.ingest(spark, paths, root, MOMENT) == stated
    bronze = layers.committed_day(spark, root, "bronze", MOMENT)
    assert bronze["orders"].schema["order_total"].dataType.simpleString() == "double" and bronze["customers"].where("email = 'E@F.example'").count() == 1
    assert layers.promote(spark, root, MOMENT, places(spark)) == stated
    silver = layers.committed_day(spark, root, "silver", MOMENT)["customers"].where("customer_id = 'CUST-000003'").first()
    assert (silver.full_name, silver.email, silver.state) == ("Name, with break", "e@f.example", "SP")
    assert layers.manifest_violations(spark, root, "silver", MOMENT) == []
    assert layers.load_day(spark, root, "silver", MOMENT, "test_load_") == stated
    assert spark.table("test_load_orders").count() == 2


def test_raw_gate_names_bad_values_by_column(spark, tmp_path):
    rows = dict(ROWS, products=[("PROD-000001", "p", " ", "b", "s", "ten", 6.0, 1.5, 5, "2024-02-30", "yes"), ROWS["products"][1]])
    paths = write_csv(tmp_path, rows, 'ORD-00000003,"one, two",3\nORD-00000004,CUST-000001,2024-06-01,Enviado,Pix,Site,1,1,1,,extra\n')
    frames, problems = layers.read_raw_day(spark, paths)
    assert problems == [] and {(r.dataset, r.line) for r in layers.bad_lines(frames).collect()} == {("orders", 'ORD-00000003,"one, two",3'), ("orders", "ORD-00000004,CUST-000001,2024-06-01,Enviado,Pix,Site,1,1,1,,extra")}
    found = {(r.dataset, r.column, r.rule): r.violations for r in layers.raw_gate(frames).where("violations > 0").collect()}
    assert found == {("orders", "_corrupt", "record"): 2, ("products", "category", "required"): 1} | {("products", c, "type"): 1 for c in ("unit_price", "stock_quantity", "created_at", "is_active")}
    with pytest.raises(ValueError, match="orders._corrupt record: 2; products.category required: 1; products.created_at type: 1"):
        layers.ingest(spark, paths, str(tmp_path / "lake"), MOMENT)
    assert not (tmp_path / "lake").exists()
    (tmp_path / "none.csv").write_text("order_id\n")
    frames, problems = layers.read_raw_day(spark, {"orders": str(tmp_path / "none.csv"), "products": str(tmp_path / "absent.csv"), "more": "x"})
    assert frames == {} and len(problems) == 5 and any(p.startswith("orders: missing columns customer_id") for p in problems)


def test_the_gate_stops_silver(spark, tmp_path):
    rows = dict(ROWS, orders=[(*ROWS["orders"][0][:8], 999999.0, ROWS["orders"][0][9]), ROWS["orders"][1]])
    root = str(tmp_path / "lake")
    layers.ingest(spark, write_csv(tmp_path, rows), root, MOMENT)
    with pytest.raises(ValueError, match="orders.total_of_items: 1"):
        layers.promote(spark, root, MOMENT)
    assert not (tmp_path / "lake/silver").exists()
    with pytest.raises(ValueError, match="no commit for 2026-07-29"):
        layers.promote(spark, root, datetime(2026, 7, 29))


def test_a_run_that_breaks_off_leaves_the_old_day(spark, tmp_path):
    root = str(tmp_path / "lake")
    layers.ingest(spark, write_csv(tmp_path), root, MOMENT)
    before = {n: df.collect() for n, df in layers.committed_day(spark, root, "bronze", MOMENT).items()}
    frames = layers.committed_day(spark, root, "bronze", MOMENT)
    changed = {n: df.limit(1) for n, df in frames.items()}
    changed["order_items"] = frames["order_items"].withColumn("quantity", F.raise_error(F.lit("crash")).cast("long"))
    with pytest.raises(Exception, match="crash"):
        layers.commit_day(changed, root, "bronze", MOMENT)
    assert {n: df.collect() for n, df in layers.committed_day(spark, root, "bronze", MOMENT).items()} == before
    again = {n: df.limit(1) for n, df in frames.items()}
    assert layers.commit_day(again, root, "bronze", MOMENT) == dict.fromkeys(SCHEMAS, 1)
    assert all(df.count() == 1 for df in layers.committed_day(spark, root, "bronze", MOMENT).values())


def test_a_day_that_is_not_what_its_manifest_says_is_not_loaded(spark, tmp_path):
    root = str(tmp_path / "lake")
    assert layers.manifest_violations(spark, root, "bronze", MOMENT) == ["bronze: no commit for 2026-07-28"]
    layers.ingest(spark, write_csv(tmp_path), root, MOMENT)
    days = f"{root}/bronze/_days/2026-07-28"
    version, says = commits.current(spark, days)
    run = next((tmp_path / "lake/bronze/orders/year=2026/month=07/day=28").iterdir())
    spark.read.parquet(str(run)).limit(1).withColumn("order_total", F.lit("x")).drop("sales_channel").write.mode("overwrite").parquet(f"{run}-new")
    run.rename(f"{run}-old")
    (run.parent / f"{run.name}-new").rename(run)
    commits.commit(spark, days, version, says | {"day": "2026-07-27", "rows": {n: 2 for n in ("customers", "products", "orders", "more")}})
    assert set(layers.manifest_violations(spark, root, "bronze", MOMENT)) == {"manifest of day 2026-07-27, not 2026-07-28", "order_items: not in the manifest", "more: unknown", "orders: column sales_channel missing", "orders: column order_total is string", "orders: 1 rows, 2 stated"}
    with pytest.raises(ValueError, match="orders: 1 rows, 2 stated"):
        layers.load_day(spark, root, "bronze", MOMENT, "test_bad_")


def test_grid_and_input_checks(spark):
    cells = [("P1", date(2026, 1, d), 1.0, "a") for d in (1, 2, 3)] + [("P2", date(2026, 1, 1), -1.0, None), ("P2", date(2026, 1, 1), 0.0, "a"), ("P9", date(2026, 1, 3), 0.0, "a")]
    grid = spark.createDataFrame(cells, "product_id string, date date, quantity_sold double, category string")
    products = spark.createDataFrame([("P1", "a"), ("P2", "a"), ("P3", "a")], "product_id string, category string")
    assert {r.rule: r.violations for r in gates.grid_checks(grid, products).collect()} == {"lost_category": 1, "negative": 1, "unknown_product": 1, "repeated_cell": 1, "incomplete_days": 2, "absent_product": 1}


def test_publication_checks(spark):
    rows = [("P1", date(2026, 1, k), k, h, 1.0, "m", date(2025, 12, 31)) for h in (7, 14, 30) for k in range(1, h + 1)]
    names = "product_id string, forecast_date date, horizon_day int, horizon_days int, predicted_quantity double, model_name string, data_max_date date"
    good = spark.createDataFrame(rows, names)
    assert publish.forecast_checks(good, (7, 14, 30)).where("violations > 0").isEmpty()
    bad = spark.createDataFrame([*rows[:6], *rows[7:], ("P1", date(2026, 1, 1), 1, 7, float("nan"), "n", date(2026, 1, 1))], names)
    found = {r.rule: r.violations for r in publish.forecast_checks(bad, (7, 14, 30)).where("violations > 0").collect()}
    assert found == {"finite_not_negative": 1, "after_data": 1, "unique_key": 1, "days_complete": 1, "days_reach_horizon": 1, "single_champion": 1}
    registry = spark.createDataFrame([("m", True, "{}"), ("n", True, "{"), ("n", False, "{}")], "model_name string, is_champion boolean, metadata_json string")
    assert {r.rule: r.violations for r in publish.registry_checks(registry, ("m", "o")).collect()} == {"accepted:model_name": 2, "metadata_json": 1, "unique_key": 1, "complete": 1, "one_champion": 1}
    runs = spark.createDataFrame([("r", "success", datetime(2026, 1, 1), datetime(2026, 1, 1), 1, 51, 2), ("s", "failed", datetime(2026, 1, 2), None, 9, 9, 9)], "run_id string, status string, started_at timestamp, finished_at timestamp, products_processed long, forecast_rows long, risk_rows long")
    risk = spark.createDataFrame([("P1",)], "product_id string")
    assert {r.rule for r in publish.run_checks(runs, good, risk, (7, 14, 30)).where("violations > 0").collect()} == {"risk_rows"}


def test_bundle_is_read_whole_or_not_at_all(spark, tmp_path):
    root, t = str(tmp_path / "b"), {"inventory_risk": spark.range(3), "sales_forecast": spark.range(5)}
    artifacts.save(root, t, {"promotion": {"decision": "rejected", "final_champion": "m"}})
    found, documents = artifacts.load(spark, root, list(t), ["promotion"])
    assert found["sales_forecast"].count() == 5 and {r.name: r.row_count for r in artifacts.manifest(spark, root).collect()} == {"inventory_risk": 3, "sales_forecast": 5}
    artifacts.check_decision(documents["promotion"], "rejected", "m")
    with pytest.raises(ValueError, match="not promoted"):
        artifacts.check_decision(documents["promotion"], "promoted", "m")
    with pytest.raises(ValueError, match="model_metrics.*comparison"):
        artifacts.load(spark, root, [*t, "model_metrics"], ["comparison"])
    spark.range(4).write.mode("overwrite").parquet(f"{root}/sales_forecast")
    with pytest.raises(ValueError, match="5"):
        artifacts.load(spark, root, list(t))


@pytest.mark.parametrize("first", ["a", "b"])
def test_of_two_writers_the_second_is_told_and_no_row_is_lost(spark, tmp_path, monkeypatch, first):
    """Both have read version 0; whichever commits first counts, and the other raises and can try again."""
    root = str(tmp_path)
    row = lambda n: spark.createDataFrame([(n, n)], "run_id string, status string")
    publish.upsert(spark, row("r0"), root, "pipeline_runs")
    second = "b" if first == "a" else "a"
    real, busy = commits.commit, []

    def late(session, folder, after, what):
        if not busy:  # the other writer comes in between, from read to commit
            busy.append(1)
            publish.upsert(spark, row(first), root, "pipeline_runs")
        return real(session, folder, after, what)

    monkeypatch.setattr(commits, "commit", late)
    with pytest.raises(commits.Conflict, match="version 1"):
        publish.upsert(spark, row(second), root, "pipeline_runs")
    ids = lambda: {r.run_id for r in publish.read_history(spark, root, "pipeline_runs").collect()}
    assert ids() == {"r0", first}
    publish.upsert(spark, row(second), root, "pipeline_runs")
    assert ids() == {"r0", "a", "b"}


def test_old_versions_expire(spark, tmp_path):
    row = spark.createDataFrame([("r0", "x")], "run_id string, status string")
    for _ in range(5):
        assert publish.upsert(spark, row, str(tmp_path), "pipeline_runs", keep=2) == 1
    folder = tmp_path / "pipeline_runs"
    assert commits.current(spark, f"{folder}/commits")[0] == 4
    assert len(list(folder.glob("v-*"))) == 2 and sorted(p.name for p in (folder / "commits").iterdir() if not p.name.startswith(".")) == ["00000003", "00000004"]


def test_only_one_of_many_creates_a_file(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda k: commits.create_once(spark, f"file://{tmp_path}/c/00000000", f"text {k}"), range(16)))
    assert sum(won) == 1 and (tmp_path / "c/00000000").read_text() == f"text {won.index(True)}"
    assert commits.current(spark, f"{tmp_path}/none") is None


def test_mase_is_null_without_a_scale(spark):
    cube = spark.createDataFrame([("s", None, None, 2.0), ("s", "smooth", None, 2.0), ("s", "smooth", "P1", 2.0), ("s", "smooth", "P2", 2.0)], "split string, demand_pattern string, product_id string, mae double")
    steps = spark.createDataFrame([("s", "smooth", "P1", 8.0, 4), ("s", "smooth", "P2", 0.0, 4)], "split string, demand_pattern string, product_id string, apart double, days int")
    assert {(r.demand_pattern, r.product_id): r.mase for r in metrics.with_mase(cube, steps).collect()} == {(None, None): 2.0, ("smooth", None): 2.0, ("smooth", "P1"): 1.0, ("smooth", "P2"): None}


def test_missing_forecast_is_an_error(spark):
    actual = spark.createDataFrame([("P1", 1), ("P2", 1)], "product_id string, horizon_day int")
    predicted = spark.createDataFrame([("P1", 1, 0.0), ("P2", 1, None)], "product_id string, horizon_day int, predicted_quantity double")
    with pytest.raises(ValueError, match="1 actual"):
        forecast.require_forecasts(actual, predicted, ("product_id", "horizon_day"))


def test_snake_case():
    assert [snake_case(x) for x in ("Part Key", "PartName", "SIZE--of part", " already_snake ", "partID2Name", "HTTPServer", "a__b")] == ["part_key", "part_name", "size_of_part", "already_snake", "part_id2_name", "httpserver", "a_b"]
