"""Column functions. Money is decimal(18,2) inside a plan and becomes double in its result."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def money(c: Column | str) -> Column:
    """Cents, rounded half up."""
    return (F.col(c) if isinstance(c, str) else c).cast(MONEY)


def as_double(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def average_money(total: Column, n: Column) -> Column:
    """Exact decimal quotient, rounded half up to cents; null for no rows."""
    return F.round(total.cast("decimal(24,6)") / F.nullif(n.cast("decimal(12,0)"), F.lit(0).cast("decimal(12,0)")), 2).cast("double")


def clean_text(c: Column) -> Column:
    """White-space runs (Unicode) to one space, trimmed; empty is null."""
    return F.nullif(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")), F.lit(""))


def parse_boolean(c: Column, digits: bool = False) -> Column:
    """True and false in any case and padding; with digits also 1 and 0; anything else is null."""
    v = F.lower(F.trim(c))
    yes, no = (["true", "1"], ["false", "0"]) if digits else (["true"], ["false"])
    return F.when(v.isin(yes), True).when(v.isin(no), False)


def full_match(c: Column, pattern: str) -> Column:
    """the whole value matches."""
    return c.rlike(rf"\A(?:{pattern})\z")


def snake_case(name: str) -> str:
    """The words of a column name in lower case, joined by underscores. A word is capitals and what follows them."""
    return "_".join(re.findall("[A-Z]*[a-z0-9]+|[A-Z]+", name)).lower()


def shift_years(c: Column, years: int) -> Column:
    """The same day some years on; February 29 becomes 28 where it must."""
    return F.add_months(c, 12 * years)


def age_on(birth: Column, day: Column) -> Column:
    """Completed years, by month and day."""
    before = (F.month(day) * 100 + F.dayofmonth(day)) < (F.month(birth) * 100 + F.dayofmonth(birth))
    return F.year(day) - F.year(birth) - before.cast("int")
