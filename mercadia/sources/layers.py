"""Raw, Bronze and Silver layers (S1 to S4, K1 to K6, M9, M10): typed reads, day partitions, gated writes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, DecimalType, DoubleType, LongType, StringType, StructField, StructType, TimestampNTZType

from mercadia.functions import columns as fn
from mercadia.operators import gates
from mercadia.sources import commits


@dataclass(frozen=True)
class TableSpec:
    """Columns in order with their Silver types, key, money columns, nullable columns, lower- and upper-case columns."""

    columns: Mapping[str, DataType]
    key: str
    money: Sequence[str] = ()
    nullable: Sequence[str] = ()
    lower: Sequence[str] = ()
    upper: Sequence[str] = ()

    @property
    def raw(self) -> StructType:
        """Everything as text, so that bad values can be reported."""
        return StructType([StructField(c, StringType()) for c in self.columns])


_S, _D, _L, _B, _T = StringType(), DoubleType(), LongType(), BooleanType(), TimestampNTZType()
SPECS = {
    "customers": TableSpec(
        {"customer_id": _S, "full_name": _S, "email": _S, "birth_date": _T, "gender": _S, "city": _S, "state": _S, "region": _S, "registration_date": _T, "acquisition_channel": _S, "customer_segment": _S, "is_active": _B},
        "customer_id", lower=("email",), upper=("state",),
    ),
    "orders": TableSpec(
        {"order_id": _S, "customer_id": _S, "order_date": _T, "order_status": _S, "payment_method": _S, "sales_channel": _S, "shipping_cost": _D, "discount_amount": _D, "order_total": _D, "delivery_date": _T},
        "order_id", money=("shipping_cost", "discount_amount", "order_total"), nullable=("delivery_date",),
    ),
    "order_items": TableSpec(
        {"order_item_id": _S, "order_id": _S, "product_id": _S, "quantity": _L, "unit_price": _D, "unit_cost": _D, "discount_percentage": _D, "line_total": _D},
        "order_item_id", money=("unit_price", "unit_cost", "line_total"),
    ),
    "products": TableSpec(
        {"product_id": _S, "product_name": _S, "category": _S, "brand": _S, "supplier": _S, "unit_price": _D, "unit_cost": _D, "stock_quantity": _L, "minimum_stock": _L, "created_at": _T, "is_active": _B},
        "product_id", money=("unit_price", "unit_cost"),
    ),
}


def read_raw(spark: SparkSession, path: str, dataset: str) -> tuple[DataFrame | None, list[str]]:
    """A CSV with a header, all columns as text; problems are listed, not raised: unreadable, without rows, or
    without required columns."""
    spec = SPECS[dataset]
    try:
        found = spark.read.option("header", True).csv(path)
    except AnalysisException as e:
        return None, [f"{dataset}: cannot be read ({e.getCondition()})"]
    missing = [c for c in spec.columns if c not in found.columns]
    if missing:
        return None, [f"{dataset}: missing columns {', '.join(missing)}"]
    if found.isEmpty():
        return None, [f"{dataset}: no rows"]
    return found, []


def cast_column(c: str, kind: DataType, strict: bool) -> F.Column:
    """Strict casts raise on a bad value (ANSI); lenient ones give null."""
    text = F.trim(F.col(c))
    if isinstance(kind, BooleanType):
        value = fn.parse_boolean(F.col(c), digits=True)
        return F.when(value.isNull() & F.col(c).isNotNull(), F.raise_error(F.concat(F.lit(f"bad boolean in {c}: "), F.col(c)))).otherwise(value).cast("boolean") if strict else value
    if isinstance(kind, StringType):
        return F.col(c)
    name = kind.simpleString()
    return text.cast(name) if strict else F.expr(f"try_cast(trim(`{c}`) AS {name})")


def to_bronze(raw: DataFrame, dataset: str) -> DataFrame:
    """M9: typed columns in order, bad values raise; extra columns come last."""
    spec = SPECS[dataset]
    typed = [cast_column(c, k, True).alias(c) for c, k in spec.columns.items()]
    return raw.select(*typed, *(c for c in raw.columns if c not in spec.columns))


def bad_values(raw: DataFrame, dataset: str) -> DataFrame:
    """Q4: how many values of each typed column cannot be read, in one pass."""
    spec = SPECS[dataset]
    typed = {c: k for c, k in spec.columns.items() if not isinstance(k, StringType)}
    counts = raw.agg(*(F.count_if(F.col(c).isNotNull() & cast_column(c, k, False).isNull()).alias(c) for c, k in typed.items()))
    return counts.unpivot([], list(typed), "column", "violations").where("violations > 0")


def to_silver(bronze: DataFrame, dataset: str) -> DataFrame:
    """Snake-case names, clean text, case, cents, expected order; extra columns last. Rows are sorted by key within
    each partition (O1)."""
    spec = SPECS[dataset]
    names = [fn.snake_case(c) for c in bronze.columns]
    if len(set(names)) < len(names):
        raise ValueError(f"{dataset}: two columns have the same name in snake case")
    df = bronze.toDF(*names)
    missing = [c for c in spec.columns if c not in names]
    if missing:
        raise ValueError(f"{dataset}: missing columns {', '.join(missing)}")

    def column(c: str, kind: DataType) -> F.Column:
        value = F.col(c)
        if isinstance(kind, StringType):
            value = fn.clean_text(value.cast("string"))
            return F.lower(value) if c in spec.lower else F.upper(value) if c in spec.upper else value
        if not isinstance(df.schema[c].dataType, type(kind)):
            value = cast_column(c, kind, True)
        return value.cast(DecimalType(18, 2)).cast("double") if c in spec.money else value

    out = df.select(*(column(c, k).alias(c) for c, k in spec.columns.items()), *(c for c in names if c not in spec.columns))
    return out.sortWithinPartitions(F.col(spec.key).asc_nulls_last())


def day_of(moment: datetime) -> dict[str, str]:
    """Partition values of a day in UTC, zero-padded; a naive time is taken as UTC."""
    t = moment.replace(tzinfo=timezone.utc) if moment.tzinfo is None else moment.astimezone(timezone.utc)
    return {"year": f"{t.year:04d}", "month": f"{t.month:02d}", "day": f"{t.day:02d}"}


def write_day(df: DataFrame, root: str, layer: str, dataset: str, moment: datetime) -> str:
    """K1 to K5: one dataset's day, Snappy Parquet; a rerun replaces just that day."""
    path = f"{root}/{layer}/{dataset}"
    day = day_of(moment)
    (
        df.withColumns({k: F.lit(v) for k, v in day.items()})
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "snappy").partitionBy(*day).parquet(path)
    )
    return "/".join([path, *(f"{k}={v}" for k, v in day.items())])


def read_day(spark: SparkSession, root: str, layer: str, dataset: str, moment: datetime) -> DataFrame:
    """Exactly one day; the filter prunes partitions. Raises if the day is not there."""
    df = spark.read.parquet(f"{root}/{layer}/{dataset}")
    day = day_of(moment)
    for k, v in day.items():
        df = df.where(F.col(k).cast("int") == int(v))
    if df.isEmpty():
        raise ValueError(f"{layer}/{dataset} has no rows for {'-'.join(day.values())}")
    return df.drop(*day)


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a local run makes one of its
    own, and a cluster raises."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("spark.checkpoint.dir is unset: name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df written to the scratch folder and read from there: a plan that uses it often computes it once."""
    path = f"{scratch(df.sparkSession)}/written-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def load_table(df: DataFrame, name: str) -> int:
    """K6: full refresh of a warehouse table; raises if it does not hold the rows given."""
    given = df.count()
    df.write.mode("overwrite").saveAsTable(name)
    there = df.sparkSession.table(name).count()
    if given != there:
        raise RuntimeError(f"{name}: {given} rows given, {there} there")
    return there


def commit_day(frames: Mapping[str, DataFrame], root: str, layer: str, moment: datetime) -> dict[str, int]:
    """K1 to K5: a day of all datasets as one commit; returns their rows, counted while they are written.

    Each run writes folders of its own under the day's partition; what readers see changes with the day's manifest alone,
    which is written last and which only one writer can make. A run that breaks off leaves the day as it was. The runs
    before the last two are removed."""
    if set(frames) != set(SPECS):
        raise ValueError(f"datasets missing: {sorted(set(SPECS) - set(frames))}, unknown: {sorted(set(frames) - set(SPECS))}")
    spark = next(iter(frames.values())).sparkSession
    day, run, rows = day_of(moment), uuid.uuid4().hex, {}
    manifests = _manifests(root, layer, day)
    now = commits.current(spark, manifests)
    for name, df in frames.items():
        seen = Observation(f"{name}-{run}")
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.option("compression", "snappy").parquet(_folder(root, layer, name, day, run))
        rows[name] = seen.get["n"]
    commits.commit(spark, manifests, None if now is None else now[0], {"run": run, "rows": rows, "layer": layer, "day": "-".join(day.values())})
    for old in commits.expire(spark, manifests, 2):
        for name in SPECS:
            commits.remove(spark, _folder(root, layer, name, day, old["run"]))
    return rows


def _manifests(root: str, layer: str, day: Mapping[str, str]) -> str:
    return f"{root}/{layer}/_days/{'-'.join(day.values())}"


def _folder(root: str, layer: str, dataset: str, day: Mapping[str, str], run: str) -> str:
    return "/".join([f"{root}/{layer}/{dataset}", *(f"{k}={v}" for k, v in day.items()), f"run={run}"])


def committed_day(spark: SparkSession, root: str, layer: str, moment: datetime) -> dict[str, DataFrame]:
    """The day's datasets as its manifest names them. Raises if the day has none."""
    day = day_of(moment)
    found = commits.current(spark, _manifests(root, layer, day))
    if found is None:
        raise ValueError(f"{layer} has no commit for {'-'.join(day.values())}")
    return {name: spark.read.parquet(_folder(root, layer, name, day, found[1]["run"])) for name in SPECS}


def manifest_violations(spark: SparkSession, root: str, layer: str, moment: datetime) -> list[str]:
    """Q33: what keeps a day from being loaded: no manifest, one of another layer or day, datasets missing or unknown,
    datasets without rows, unreadable, with other columns or types than their spec, or with other rows than stated."""
    day = day_of(moment)
    found = commits.current(spark, _manifests(root, layer, day))
    if found is None:
        return [f"{layer}: no commit for {'-'.join(day.values())}"]
    says, out = found[1], []
    for what, given in (("layer", layer), ("day", "-".join(day.values()))):
        if says.get(what) != given:
            out.append(f"manifest of {what} {says.get(what)}, not {given}")
    rows = says.get("rows", {})
    out += [f"{n}: not in the manifest" for n in sorted(set(SPECS) - set(rows))] + [f"{n}: unknown" for n in sorted(set(rows) - set(SPECS))]
    for name in sorted(set(SPECS) & set(rows)):
        try:
            df = spark.read.parquet(_folder(root, layer, name, day, says["run"]))
            n = df.count()
        except AnalysisException as e:
            out.append(f"{name}: cannot be read ({e.getCondition()})")
            continue
        spec = SPECS[name].columns
        types = {f.name: f.dataType for f in df.schema}
        out += [f"{name}: column {c} missing" for c in spec if c not in types] + [f"{name}: column {c} is {types[c].simpleString()}" for c, k in spec.items() if c in types and types[c] != k]
        if n != rows[name]:
            out.append(f"{name}: {n} rows, {rows[name]} stated")
        if not n:
            out.append(f"{name}: no rows")
    return out


def load_day(spark: SparkSession, root: str, layer: str, moment: datetime, prefix: str) -> dict[str, int]:
    """K6, Q33, Q34: refresh the four warehouse tables from a day's commit, which is checked before anything is loaded; the
    rows of each table are compared with the manifest afterwards."""
    bad = manifest_violations(spark, root, layer, moment)
    if bad:
        raise ValueError("; ".join(bad))
    loaded = {name: load_table(df, f"{prefix}{name}") for name, df in committed_day(spark, root, layer, moment).items()}
    stated = commits.current(spark, _manifests(root, layer, day_of(moment)))[1]["rows"]
    wrong = {n: (stated[n], k) for n, k in loaded.items() if stated[n] != k}
    if wrong:
        raise RuntimeError(f"rows stated and loaded differ: {wrong}")
    return loaded


# ---- raw files ----


def read_raw_day(spark: SparkSession, paths: Mapping[str, str]) -> tuple[dict[str, DataFrame], list[str]]:
    """The four CSV files with a header, all columns as text, and what is wrong with them as files: unknown datasets,
    unreadable, without rows, or without required columns. Lines that are no records are kept apart by bad_lines."""
    frames, problems = {}, [f"{n}: missing" for n in SPECS if n not in paths] + [f"{n}: unknown" for n in sorted(set(paths) - set(SPECS))]
    for name in SPECS:
        if name in paths:
            found, wrong = read_raw(spark, paths[name], name)
            problems += wrong
            if found is not None:
                frames[name] = _with_corrupt(spark, paths[name], found.columns)
    return frames, problems


def _with_corrupt(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """The records of a CSV file by its header, and the text of a line with more or fewer values in _corrupt."""
    schema = StructType([*(StructField(c, StringType()) for c in columns), StructField("_corrupt", StringType())])
    return spark.read.schema(schema).csv(path, header=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt", enforceSchema=True, multiLine=True, escape='"')


def bad_lines(frames: Mapping[str, DataFrame]) -> DataFrame:
    """(dataset, line, first): the lines that are no records, and what was read as their first value."""
    parts = [df.where("_corrupt is not null").select(F.lit(n).alias("dataset"), F.col("_corrupt").alias("line"), F.col(df.columns[0]).alias("first")) for n, df in frames.items()]
    return reduce(DataFrame.unionByName, parts)


def raw_gate(frames: Mapping[str, DataFrame]) -> DataFrame:
    """Q2, Q4 over raw text, a pass a dataset: lines that are no records, values that cannot be read as their type, by
    column, and required values that are missing (dataset, column, rule, violations)."""
    parts = []
    for name, df in frames.items():
        spec = SPECS[name]
        good = F.col("_corrupt").isNull()
        blank = lambda c: F.coalesce(F.trim(F.col(c)) == "", F.lit(True))
        counts = {("_corrupt", "record"): ~good}
        for c, kind in spec.columns.items():
            if not isinstance(kind, StringType):
                counts[c, "type"] = good & ~blank(c) & cast_column(c, kind, False).isNull()
            if c not in spec.nullable:
                counts[c, "required"] = good & blank(c)
        sums = df.agg(*(F.count_if(x).alias(f"n{k}") for k, x in enumerate(counts.values())))
        rows = F.array(*(F.struct(F.lit(c).alias("column"), F.lit(rule).alias("rule"), F.col(f"n{k}").alias("violations")) for k, (c, rule) in enumerate(counts)))
        parts.append(sums.select(F.lit(name).alias("dataset"), F.inline(rows)))
    return reduce(DataFrame.unionByName, parts)


def ingest(spark: SparkSession, paths: Mapping[str, str], root: str, moment: datetime) -> dict[str, int]:
    """M9, K4: the day's four CSV files to Bronze as one commit, if the raw gate lets all of them pass; returns their rows.
    Raises with every problem of the files, or every broken rule, before anything is written."""
    frames, problems = read_raw_day(spark, paths)
    if problems:
        raise ValueError("; ".join(problems))
    broken = raw_gate(frames).where("violations > 0").orderBy("dataset", "column", "rule").collect()
    if broken:
        raise ValueError("; ".join(f"{r.dataset}.{r.column} {r.rule}: {r.violations}" for r in broken))
    return commit_day({n: to_bronze(df.select(*(_no_blank(c).alias(c) for c in df.columns if c != "_corrupt")), n) for n, df in frames.items()}, root, "bronze", moment)


def _no_blank(c: str) -> F.Column:
    """Blank text is no value."""
    return F.when(F.trim(F.col(c)) != "", F.col(c))


def promote(spark: SparkSession, root: str, moment: datetime, places: DataFrame | None = None, patterns: Mapping[str, str] = gates.ID_PATTERNS) -> dict[str, int]:
    """A day's Bronze commit to Silver as one commit, if the gate of all datasets lets it pass; returns the
    rows. The gate always runs, at the day itself; raises with the broken rules, and where Silver would lose rows."""
    bronze = committed_day(spark, root, "bronze", moment)
    silver = {name: to_silver(df, name) for name, df in bronze.items()}
    gates.require(gates.gate(silver, "-".join(day_of(moment).values()), places, patterns))
    rows = commit_day(silver, root, "silver", moment)
    stated = commits.current(spark, _manifests(root, "bronze", day_of(moment)))[1]["rows"]
    wrong = {n: (stated[n], k) for n, k in rows.items() if stated[n] != k}
    if wrong:
        raise RuntimeError(f"rows in Bronze and Silver differ: {wrong}")
    return rows
