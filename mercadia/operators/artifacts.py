"""Bundles of result tables and documents (K12 to K14, S2, S7, S9, S10, R8, R9): written together, read back whole or not at all."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Split, model, horizon, metric and its value, as the metric document nests them.
METRICS_SCHEMA = "map<string,map<string,map<string,map<string,double>>>>"


def save(root: str, tables: Mapping[str, DataFrame], documents: Mapping[str, dict]) -> None:
    """Each table as Parquet and each document as one JSON line, under root. Models are documents too
    (learned.document). The manifest, with the rows of each table, is written last: a bundle without one is
    not whole."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}")
    for name, x in documents.items():
        spark.createDataFrame([(json.dumps(x, sort_keys=True, separators=(",", ":")),)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/{name}.json")
    counts = [spark.read.parquet(f"{root}/{n}").agg(F.lit(n).alias("name"), F.count("*").alias("row_count")) for n in tables]
    reduce(DataFrame.unionByName, counts).coalesce(1).write.mode("overwrite").json(f"{root}/manifest")


def read_table(spark: SparkSession, path: str) -> tuple[DataFrame | None, list[str]]:
    """A Parquet table, or why it cannot be read."""
    try:
        return spark.read.parquet(path), []
    except AnalysisException as e:
        return None, [f"{path}: cannot be read ({e.getCondition()})"]


def load(spark: SparkSession, root: str, tables: Sequence[str], documents: Sequence[str] = ()) -> tuple[dict[str, DataFrame], dict[str, dict]]:
    """All tables and documents of a bundle; raises with every part that is missing, and where a table has not
    the rows that the manifest gives."""
    found, problems = {}, []
    for name in tables:
        found[name], why = read_table(spark, f"{root}/{name}")
        problems += why
    texts = {}
    for name in documents:
        try:
            texts[name] = json.loads(spark.read.text(f"{root}/{name}.json").first()[0])
        except AnalysisException as e:
            problems.append(f"{root}/{name}.json: cannot be read ({e.getCondition()})")
    if problems:
        raise ValueError("; ".join(problems))
    given = {r.name: r.row_count for r in manifest(spark, root).collect()}  # a row a table
    for name, df in found.items():
        n = df.count()
        if name in given and n != given[name]:
            raise ValueError(f"{name}: {n} rows, the manifest has {given[name]}")
    return found, texts


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """Name and rows of each table of a bundle."""
    return spark.read.schema("name string, row_count long").json(f"{root}/manifest")


def metric_document(rows: DataFrame) -> dict:
    """Metrics as a nested document: split, model, horizon, metric. rows: split, model_name, horizon, metric_name,
    metric_value, as many as these have values together; nulls are left out."""
    out: dict = {}
    for r in rows.where("metric_value is not null and not isnan(metric_value)").toLocalIterator():
        out.setdefault(r.split, {}).setdefault(r.model_name, {}).setdefault(str(r.horizon), {})[r.metric_name] = r.metric_value
    return out


def metric_rows(spark: SparkSession, root: str, name: str = "metrics") -> DataFrame:
    """The rows of a nested metric document of a bundle, read by its schema. A document that is none raises."""
    found = spark.read.text(f"{root}/{name}.json").select(F.from_json("value", METRICS_SCHEMA, {"mode": "FAILFAST"}).alias("x"))
    for key, inner in (("split", "x"), ("model_name", "x"), ("horizon", "x"), ("metric_name", "x")):
        kept = [c for c in found.columns if c != inner]
        found = found.select(*kept, F.explode(inner).alias(key, "x"))
    return found.select("split", "model_name", F.col("horizon").cast("int").alias("horizon"), "metric_name", F.col("x").alias("metric_value"))


def check_decision(document: Mapping, decision: str, champion: str) -> None:
    """Raises unless the experiment came to the configured decision and champion."""
    if document.get("decision") != decision or document.get("final_champion") != champion:
        raise ValueError(f"the experiment has {document.get('decision')} and {document.get('final_champion')}, not {decision} and {champion}")
