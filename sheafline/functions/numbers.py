"""Number helpers that keep ANSI mode quiet and rounding stable."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(num: Column, den: Column) -> Column:
    """``num / den`` with 0 where the quotient is undefined."""
    return F.coalesce(num / F.nullif(den.cast("double"), F.lit(0.0)), F.lit(0.0))


def number(c: Column, default: float = 0.0) -> Column:
    """Text to double; what does not parse becomes ``default``."""
    return F.coalesce(c.try_cast("double"), F.lit(float(default)))


def flag(c: Column) -> Column:
    return F.coalesce(c.cast("int"), F.lit(0))


def r6(c: Column) -> Column:
    """Six decimals, and never a negative zero."""
    return F.round(c, 6) + F.lit(0.0)
