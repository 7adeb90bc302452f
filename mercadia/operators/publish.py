"""Publication: keyed upserts, registry, run rows and audits."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from mercadia.operators import quality
from mercadia.operators.quality import Rule
from mercadia.sources import commits

# fixed values of the history tables: their keys
MERGE_KEYS = {
    "sales_forecast": ("run_id", "product_id", "forecast_date", "horizon_days", "model_version"),
    "inventory_risk": ("run_id", "product_id", "horizon_days"),
    "model_metrics": ("run_id", "model_name", "model_version", "evaluation_period", "forecast_horizon", "metric_name"),
    "model_registry": ("model_name", "model_version"),
    "pipeline_runs": ("run_id",),
}
_SPACE = uuid.UUID("6ba7b810-9dad-11d1-80b4-00c04fd430c8")  # the DNS name space


def check_batch(batch: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> None:
    """K9: a batch must have rows, all columns and no repeated key."""
    missing = [c for c in columns if c not in batch.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    if batch.isEmpty():
        raise ValueError("the batch has no rows")
    if not batch.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError("the batch repeats a key")


def merged(history: DataFrame, batch: DataFrame, keys: Sequence[str], immutable: Sequence[str] = ()) -> DataFrame:
    """K7, K8: history after the batch: its rows replace those of equal key, but for immutable columns, whose first
    value stays; others are added. History rows without a new version stay as they are."""
    first = history.select(*keys, *(F.col(c).alias(f"{c}_first") for c in immutable))
    new = batch.join(first, list(keys), "left")
    for c in immutable:
        new = new.withColumn(c, F.coalesce(f"{c}_first", c))
    kept = history.join(batch.select(*keys), list(keys), "left_anti")
    return kept.unionByName(new.select(*history.columns))


#: Most runs that one batch may hold.
MAX_RUNS = 100


def upsert(spark: SparkSession, batch: DataFrame, root: str, name: str, immutable: Sequence[str] = (), keep: int = 3) -> int:
    """Merge a batch into a history table; returns the table's rows.

    A table that is keyed by run has a folder a run, and only the batch's runs are read and written again; a commit names
    the folders that count, with their rows. Only one writer can make a commit: of two that have read the same version the
    second raises commits.Conflict, and nothing is lost. The last ``keep`` versions stay, for readers that have begun;
    folders that only older ones name are removed. A batch of more than MAX_RUNS runs, or with a null run, raises."""
    keys = MERGE_KEYS[name]
    check_batch(batch, keys, batch.columns)
    now = commits.current(spark, f"{root}/{name}/commits")
    parts = {} if now is None else dict(now[1]["parts"])
    new, written = {"": batch}, []
    if "run_id" in keys:
        runs = [r.run_id for r in batch.select("run_id").distinct().limit(MAX_RUNS + 1).collect()]
        if len(runs) > MAX_RUNS or None in runs:
            raise ValueError("the batch has a null run" if None in runs else f"the batch has over {MAX_RUNS} runs")
        new = {r: batch.where(F.col("run_id") == r) for r in runs}
    for run, rows in new.items():
        folder = f"v-{uuid.uuid4().hex}"
        out = merged(spark.read.parquet(f"{root}/{name}/{parts[run]['folder']}"), rows, keys, immutable) if run in parts else rows
        seen = Observation(f"rows-{folder}")
        out.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(f"{root}/{name}/{folder}")
        parts[run] = {"folder": folder, "rows": seen.get["n"]}
        written.append(folder)
    try:
        commits.commit(spark, f"{root}/{name}/commits", None if now is None else now[0], {"parts": parts})
    except commits.Conflict:
        for folder in written:
            commits.remove(spark, f"{root}/{name}/{folder}")
        raise
    old = commits.expire(spark, f"{root}/{name}/commits", keep)
    if old:
        kept = {p["folder"] for says in commits.history(spark, f"{root}/{name}/commits") for p in says["parts"].values()}
        for folder in {p["folder"] for says in old for p in says["parts"].values()} - kept:
            commits.remove(spark, f"{root}/{name}/{folder}")
    return sum(p["rows"] for p in parts.values())


def read_history(spark: SparkSession, root: str, name: str, run: str | None = None) -> DataFrame:
    """A history table, or one run of it: only that run's folder is read. Raises if there is none."""
    now = commits.current(spark, f"{root}/{name}/commits")
    folders = [p["folder"] for r, p in (now[1]["parts"].items() if now else ()) if run is None or r == run]
    if not folders:
        raise ValueError(f"{name} has no rows" + (f" of run {run}" if run is not None else ""))
    return spark.read.parquet(*(f"{root}/{name}/{f}" for f in folders))


def utc_timestamp(value: datetime | str | None = None) -> datetime:
    """A moment in UTC; none is now, a naive one or a text without a zone is taken as UTC. Raises for a blank."""
    if value is None:
        return datetime.now(timezone.utc)
    if isinstance(value, str):
        if not value.strip():
            raise ValueError("a time must not be blank")
        value = datetime.fromisoformat(value.strip())
    return value.replace(tzinfo=timezone.utc) if value.tzinfo is None else value.astimezone(timezone.utc)


def run_id(model: str, version: str, data_max_date: str, generated_at: datetime | str) -> str:
    """P25: the same inputs give the same id; times are compared in UTC, blanks raise."""
    parts = [str(x).strip() for x in (model, version, data_max_date)]
    if not all(parts):
        raise ValueError("model, version and date must not be blank")
    return str(uuid.uuid5(_SPACE, "|".join([*parts, utc_timestamp(generated_at).isoformat()])))


RUN_SCHEMA = (
    "run_id string, started_at timestamp, finished_at timestamp, status string, source_data_min_date date, source_data_max_date date, products_processed long, forecast_rows long, risk_rows long, "
    "champion_model string, champion_version string, error_message string, duration_seconds double"
)


def finished(run: Mapping, status: str, error: str | None = None, at: datetime | str | None = None) -> dict:
    """The run row at its end, with its duration. Raises for an end before the start, and for another status."""
    if status not in ("success", "failed"):
        raise ValueError(f"a run ends in success or failed, not {status}")
    begun, end = utc_timestamp(run["started_at"]), utc_timestamp(at)
    if end < begun:
        raise ValueError("a run cannot end before it began")
    return dict(run) | {"started_at": begun, "finished_at": end, "status": status, "error_message": error if status == "failed" else None, "duration_seconds": (end - begun).total_seconds()}


def publish(spark: SparkSession, root: str, run: dict, tables: dict[str, DataFrame], check) -> dict:
    """The run row goes from running to success, or to failed with the first error, which is raised again.

    run: run_id, started_at and what else RUN_SCHEMA names; counts may not be negative. check: called with nothing after
    the tables are written; raises if what was published is wrong."""
    if not str(run.get("run_id") or "").strip():
        raise ValueError("a run must have an id")
    wrong = [n for n in ("products_processed", "forecast_rows", "risk_rows") if (run.get(n) or 0) < 0]
    if wrong:
        raise ValueError(f"negative counts: {', '.join(wrong)}")

    def record(row: Mapping) -> dict:
        names = [c.split()[0] for c in RUN_SCHEMA.split(", ")]
        upsert(spark, spark.createDataFrame([tuple(row.get(n) for n in names)], RUN_SCHEMA), root, "pipeline_runs")
        return dict(row)

    record(run | {"started_at": utc_timestamp(run["started_at"]), "status": "running"})
    try:
        for name, df in tables.items():
            upsert(spark, df, root, name, ("registered_at",) if name == "model_registry" else ())
        check()
    except Exception as error:
        record(finished(run, "failed", str(error)[:1000]))
        raise
    return record(finished(run, "success"))


METRICS = ("wape", "mae", "rmse", "smape", "mase", "bias")


def metric_rows(aggregate: DataFrame, folds: DataFrame, run: str, versions: Mapping[str, str], champion: str, generated_at: datetime | str) -> DataFrame:
    """The registered models' metrics in long form, with run, version, status and the bounds of the fold; unknown
    values are left out.

    aggregate: split, model_name, horizon and METRICS; folds: split, first_day, train_end, val_start, val_end."""
    lost = [c for c in ("split", "model_name", "horizon", *METRICS) if c not in aggregate.columns]
    if lost:
        raise ValueError(f"metrics without columns: {', '.join(lost)}")
    version = F.coalesce(*(F.when(F.col("model_name") == m, v) for m, v in versions.items()))
    long = aggregate.where(F.col("model_name").isin(*versions)).unpivot(["split", "model_name", "horizon"], list(METRICS), "metric_name", "metric_value").where("metric_value is not null and not isnan(metric_value)")
    bounds = F.broadcast(folds.select("split", "first_day", "train_end", "val_start", "val_end"))  # a row a fold
    return long.join(bounds, "split").select(
        F.lit(run).alias("run_id"), "model_name", version.alias("model_version"), F.when(F.col("model_name") == champion, "champion").otherwise("rejected_challenger").alias("champion_status"),
        F.col("split").alias("evaluation_period"), F.col("horizon").alias("forecast_horizon"), "metric_name", "metric_value",
        F.col("first_day").alias("train_start"), "train_end", F.col("val_start").alias("evaluation_start"), F.col("val_end").alias("evaluation_end"), F.lit(utc_timestamp(generated_at)).alias("generated_at"),
    )


def model_registry(aggregate: DataFrame, versions: Mapping[str, str], champion: str, horizon: int = 14, reasons: Mapping[str, str] | None = None, registered_at: datetime | str | None = None,
                   trained: tuple | None = None, code_version: str | None = None, challenger: str | None = None) -> DataFrame:
    """Registered models with the final test's metrics, why they were rejected, the days they were trained on and the
    code's version; exactly one champion. A model without a final metric is not in the result."""
    if champion not in versions:
        raise ValueError("the champion is not registered")
    version = F.coalesce(*(F.when(F.col("model_name") == m, v) for m, v in versions.items()))
    best = F.col("model_name") == champion
    reason = F.coalesce(*(F.when(F.col("model_name") == m, r) for m, r in (reasons or {}).items()), F.lit("did not do better than the champion in the final test"))
    first, last = trained or (None, None)
    rows = aggregate.where((F.col("split") == "final_test") & (F.col("horizon") == horizon) & F.col("model_name").isin(*versions))
    facts = F.struct(F.lit("final_test").alias("evaluation_period"), F.lit(horizon).alias("forecast_horizon"), F.lit(champion).alias("official_champion"), F.lit(challenger).cast("string").alias("selected_challenger"))
    return rows.select(
        "model_name", version.alias("model_version"), F.lit(utc_timestamp(registered_at)).alias("registered_at"), F.when(best, "champion").otherwise("rejected").alias("status"), best.alias("is_champion"),
        F.when(best, "retained").otherwise("rejected").alias("promotion_decision"), F.when(~best, reason).alias("rejection_reason"), F.lit("wape").alias("primary_metric"), F.col("wape").alias("primary_metric_value"), "bias",
        F.lit(first).cast("date").alias("training_data_min_date"), F.lit(last).cast("date").alias("training_data_max_date"), F.lit(code_version).cast("string").alias("code_version"), F.to_json(facts).alias("metadata_json"),
    )


def run_audit(spark: SparkSession, root: str, run: str, horizons: Sequence[int] = (7, 14, 30)) -> DataFrame:
    """One row over the five history tables as a run has left them; only that run's folders are
    read. Tables that are missing, or lack the run, count in missing_tables.

    consistent: nothing is missing, the run has ended in success, its counts are those of its tables, keys are unique,
    every processed product has a forecast a day of each horizon and one risk, nothing is negative, and there is one champion."""
    found, lost = {}, 0
    for name in MERGE_KEYS:
        try:
            found[name] = read_history(spark, root, name, None if name == "model_registry" else run)
        except ValueError:
            lost += 1
    bad = lambda c: F.count_if(F.coalesce((F.col(c) < 0) | F.isnan(c), F.lit(True)))
    kinds: dict[str, dict] = {
        "sales_forecast": {"products": F.count_distinct("product_id"), "negative": bad("predicted_quantity"), "models": F.count_distinct("model_version")},
        "inventory_risk": {"products": F.count_distinct("product_id"), "negative": bad("forecast_demand")},
        "model_metrics": {"unknown": F.count_if(~F.col("metric_name").isin(*METRICS)), "odd_status": F.count_if(~F.col("champion_status").isin("champion", "rejected_challenger"))},
        "model_registry": {"champions": F.count_if("is_champion")},
        "pipeline_runs": {"success": F.count_if(F.col("status") == "success")} | {n: F.max(n) for n in ("products_processed", "forecast_rows", "risk_rows")},
    }
    one = spark.range(1).select(F.lit(run).alias("run_id"), F.lit(lost).alias("missing_tables"))
    for name, own in kinds.items():
        own = {"rows": F.count("*"), "duplicates": F.count("*") - F.count_distinct(F.struct(*MERGE_KEYS[name]))} | own
        part = found[name].agg(*(x.alias(f"{name}_{n}") for n, x in own.items())) if name in found else spark.range(1).select(*(F.lit(0).cast("long").alias(f"{name}_{n}") for n in own))
        one = one.crossJoin(part)  # one row each
    same = (
        ("missing_tables", 0), ("pipeline_runs_success", 1), ("pipeline_runs_rows", 1), ("pipeline_runs_forecast_rows", "sales_forecast_rows"), ("pipeline_runs_risk_rows", "inventory_risk_rows"),
        ("inventory_risk_rows", "pipeline_runs_products_processed"), ("sales_forecast_products", "inventory_risk_products"), ("sales_forecast_models", 1), ("model_registry_champions", 1),
        ("sales_forecast_negative", 0), ("inventory_risk_negative", 0), ("model_metrics_unknown", 0), ("model_metrics_odd_status", 0), *((f"{t}_duplicates", 0) for t in MERGE_KEYS),
    )
    good = F.col("sales_forecast_rows") == F.col("pipeline_runs_products_processed") * sum(horizons)
    for a, b in same:
        good = good & (F.col(a) == (F.col(b) if isinstance(b, str) else F.lit(b)))
    return one.withColumn("consistent", F.coalesce(good, F.lit(False)))


def audit(df: DataFrame, keys: Sequence[str], value: str, state: str) -> DataFrame:
    """One row: rows, distinct keys, repeated rows, negative values, and the states in order."""
    n, distinct = F.count("*"), F.count_distinct(F.struct(*keys))
    states = F.array_join(F.sort_array(F.collect_set(state)), ",")
    return df.agg(n.alias("row_count"), distinct.alias("distinct_keys"), (n - distinct).alias("duplicate_rows"), F.count_if(F.col(value) < 0).alias("negative_values"), states.alias("states"))


def incomplete_groups(df: DataFrame, keys: Sequence[str], step: str) -> DataFrame:
    """Groups whose steps are not 1 to n, each once."""
    found = df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct(step).alias("steps"), F.min(step).alias("first_step"), F.max(step).alias("last_step"))
    return found.where("n <> last_step or steps <> n or first_step <> 1")


def latest(runs: DataFrame, order: Sequence[str], key: str) -> DataFrame:
    """O3: the row of the latest first non-null time; of the greatest key on ties."""
    return runs.orderBy(F.coalesce(*order).desc(), F.desc(key)).limit(1)


def risk_violations(risk: DataFrame, horizon: int, classes: Sequence[str]) -> DataFrame:
    """Q38: rows of a risk table that contradict themselves (relative 1e-5, absolute 1e-8)."""
    near = lambda a, b: F.abs(a - b) <= 1e-8 + 1e-5 * F.abs(b)
    d, stock = F.col("forecast_demand"), F.col("stock_quantity")
    good = (
        (F.col("horizon_days") == horizon) & F.col("risk_level").isin(*classes) & (d >= 0) & near(F.col("projected_stock"), stock - d)
        & near(F.col("average_daily_demand"), d / horizon) & (F.col("estimated_coverage_days").isNull() == (d == 0)) & (stock >= 0)
        & (F.col("estimated_coverage_days").isNull() | near(F.col("estimated_coverage_days"), horizon * stock / d))
    )
    return risk.where(~F.coalesce(good, F.lit(False)))


def forecast_checks(forecast: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """The rules of a forecast table, a row each. forecast: product_id, forecast_date, horizon_day,
    horizon_days, predicted_quantity, model_name, data_max_date."""
    p = F.col("predicted_quantity")
    finite = p.isNotNull() & ~F.isnan(p) & (F.abs(p) < float("inf"))
    key = ["product_id", "horizon_days", "forecast_date"]
    groups = incomplete_groups(forecast, ["product_id", "horizon_days"], "horizon_day")
    whole = forecast.groupBy("product_id", "horizon_days").agg(F.max("horizon_day").alias("last")).where("last <> horizon_days")
    present = forecast.select("product_id").distinct().agg(F.count("*").alias("n")).crossJoin(forecast.select("product_id", "horizon_days").distinct().agg(F.count("*").alias("pairs")))
    return quality.report(
        quality.row_rules(forecast, "sales_forecast", [
            Rule("finite_not_negative", ~finite | (p < 0)), Rule("horizon", ~F.col("horizon_days").isin(*horizons)), Rule("after_data", F.col("forecast_date") <= F.col("data_max_date")),
        ]),
        quality.as_rule(quality.duplicates(forecast, key), "sales_forecast", "unique_key"),
        quality.as_rule(groups, "sales_forecast", "days_complete"), quality.as_rule(whole, "sales_forecast", "days_reach_horizon"),
        quality.as_rule(present.where(F.col("pairs") != F.col("n") * len(horizons)), "sales_forecast", "all_horizons"),
        quality.as_rule(forecast.agg(F.count_distinct("model_name").alias("n")).where("n <> 1"), "sales_forecast", "single_champion"),
    )


def metric_checks(metrics: DataFrame, names: Sequence[str], key: Sequence[str]) -> DataFrame:
    """Q39: known names, finite values, unique keys. metrics: metric_name, metric_value and the key."""
    v = F.col("metric_value")
    return quality.report(
        quality.row_rules(metrics, "model_metrics", [quality.accepted("metric_name", names), Rule("finite", v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))]),
        quality.as_rule(quality.duplicates(metrics, key), "model_metrics", "unique_key"),
    )


def registry_checks(registry: DataFrame, models: Sequence[str]) -> DataFrame:
    """Q40: unique models, all of them and no others, one champion, JSON that parses."""
    known = registry.where(F.col("model_name").isin(*models)).agg(F.count_distinct("model_name").alias("n")).where(F.col("n") != len(models))
    return quality.report(
        quality.row_rules(registry, "model_registry", [quality.accepted("model_name", models), Rule("metadata_json", F.try_parse_json("metadata_json").isNull())]),
        quality.as_rule(quality.duplicates(registry, ["model_name"]), "model_registry", "unique_key"), quality.as_rule(known, "model_registry", "complete"),
        quality.as_rule(registry.agg(F.count_if("is_champion").alias("n")).where("n <> 1"), "model_registry", "one_champion"),
    )


def run_checks(runs: DataFrame, forecast: DataFrame, risk: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """Q41, Q42: the latest successful run against its tables: counts as the run states them, and one forecast a product and
    day of each horizon, one risk row a product. runs: run_id, status, started_at, finished_at, products_processed,
    forecast_rows, risk_rows."""
    run = latest(runs.where("status = 'success'"), ["finished_at", "started_at"], "run_id")
    counted = run.crossJoin(forecast.agg(F.count("*").alias("forecasts"))).crossJoin(risk.agg(F.count("*").alias("risks"), F.count_distinct("product_id").alias("products")))
    return quality.row_rules(counted, "pipeline_runs", [
        Rule("forecast_rows", F.col("forecast_rows") != F.col("forecasts")), Rule("risk_rows", F.col("risk_rows") != F.col("risks")), Rule("one_risk_a_product", F.col("risks") != F.col("products")),
        Rule("forecasts_a_product", F.col("forecasts") != F.col("products_processed") * sum(horizons)), Rule("risks_a_product", F.col("risks") != F.col("products_processed")),
    ])
