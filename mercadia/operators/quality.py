"""Declarative quality rules (Q1 to Q32). Row rules of a table run in one aggregate pass; rules across rows or tables are
aggregations, semi and anti joins. Every rule gives one row: dataset, rule, severity, violations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class Rule:
    """A row breaks the rule where ``breaks`` is true; null means that it does not."""

    name: str
    breaks: Column
    severity: str = "error"


@dataclass(frozen=True)
class ShareRule:
    """Q13: a warning if at most the given share of rows has the flag."""

    name: str
    flag: Column
    at_most: float


def _rows(df: DataFrame, dataset: str, found: Sequence[tuple[str, str, Column]]) -> DataFrame:
    """One aggregate over df, a row a rule."""
    sums = df.agg(*(x.alias(f"c{i}") for i, (_, _, x) in enumerate(found)))
    each = F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(s).alias("severity"), F.col(f"c{i}").cast("bigint").alias("violations")) for i, (n, s, _) in enumerate(found)))
    return sums.select(F.lit(dataset).alias("dataset"), F.inline(each))


def row_rules(df: DataFrame, dataset: str, rules: Sequence[Rule], shares: Sequence[ShareRule] = ()) -> DataFrame:
    """All row and share rules of a table in one pass."""
    found = [(r.name, r.severity, F.count_if(F.coalesce(r.breaks, F.lit(False)))) for r in rules]
    found += [(s.name, "warning", (F.coalesce(F.avg(s.flag.cast("double")), F.lit(1.0)) <= s.at_most).cast("int")) for s in shares]
    return _rows(df, dataset, found)


def not_null(columns: Sequence[str]) -> list[Rule]:
    """Q2."""
    return [Rule(f"not_null:{c}", F.col(c).isNull()) for c in columns]


def accepted(column: str, values: Sequence) -> Rule:
    """Nulls are another rule's concern."""
    return Rule(f"accepted:{column}", F.col(column).isNotNull() & ~F.col(column).isin(*values))


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their counts; nulls are a key too."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child rows whose key, if any, has no parent."""
    return child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")


def as_rule(broken: DataFrame, dataset: str, rule: str, severity: str = "error") -> DataFrame:
    """Rows that break a rule across rows or tables, as one row of the report."""
    return broken.agg(F.count("*").alias("violations")).select(F.lit(dataset).alias("dataset"), F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), "violations")


def report(*parts: DataFrame) -> DataFrame:
    """All rules' rows; a table passes if no error has violations."""
    return reduce(DataFrame.unionByName, parts)


def is_valid(found: DataFrame) -> bool:
    return found.where("severity = 'error' and violations > 0").isEmpty()


@dataclass(frozen=True)
class Declared:
    """Q26: the declared column tests of one model. relations: column to (parent model, its key)."""

    not_null: Sequence[str] = ()
    unique: Sequence[str] = ()
    accepted: Mapping[str, Sequence] = field(default_factory=dict)
    relations: Mapping[str, tuple[str, str]] = field(default_factory=dict)


def schema_tests(models: Mapping[str, DataFrame], declared: Mapping[str, Declared]) -> DataFrame:
    """Q26: a row a declared test: nulls and values of a model in one pass, repeated keys and orphans beside it. Nulls are
    the concern of not_null alone. A declared model or column that is missing raises."""
    parts = []
    for name, tests in declared.items():
        df = models[name]
        rules = not_null(tests.not_null) + [accepted(x, values) for x, values in tests.accepted.items()]
        if rules:
            parts.append(row_rules(df, name, rules))
        parts += [as_rule(duplicates(df.where(F.col(x).isNotNull()), [x]), name, f"unique:{x}") for x in tests.unique]
        parts += [as_rule(orphans(df, x, models[parent], key), name, f"relation:{x}") for x, (parent, key) in tests.relations.items()]
    return report(*parts)


def schema_violations(actual: StructType, expected: StructType) -> list[str]:
    """Q1: missing, unexpected and retyped columns."""
    have, want = {f.name: f.dataType for f in actual}, {f.name: f.dataType for f in expected}
    out = [f"missing:{n}" for n in want if n not in have] + [f"unexpected:{n}" for n in have if n not in want]
    return out + [f"type:{n}" for n in want if n in have and have[n] != want[n]]


def reconcile(a: DataFrame, b: DataFrame, keys: Sequence[str], columns: Sequence[str], tolerance: float = 0.01) -> DataFrame:
    """Keys of which one side is missing or some column differs by more than the tolerance."""
    left = a.select(*keys, *(F.col(c).alias(f"{c}_a") for c in columns), F.lit(True).alias("in_a"))
    right = b.select(*keys, *(F.col(c).alias(f"{c}_b") for c in columns), F.lit(True).alias("in_b"))
    far = [F.coalesce(F.abs(F.col(f"{c}_a") - F.col(f"{c}_b")) > tolerance, F.lit(False)) for c in columns]
    bad = reduce(lambda x, y: x | y, far, F.col("in_a").isNull() | F.col("in_b").isNull())
    return left.join(right, list(keys), "full_outer").where(bad)
