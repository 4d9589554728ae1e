"""Scalar and aggregate expressions whose meaning must not depend on the session."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ieee_div(a: Column, b: Column) -> Column:
    """a / b by IEEE rules: x/0 is an infinity, 0/0 is NaN, also where ANSI mode would throw."""
    a, b = a.cast("double"), b.cast("double")
    at_zero = (
        F.when(F.isnan(a) | (a == 0), F.lit(float("nan")))
        .when(a > 0, F.lit(float("inf")))
        .when(a < 0, F.lit(float("-inf")))
    )
    return F.when(b == 0, at_zero).otherwise(a / F.when(b != 0, b))


def exact_sum(x: Column, scale: int = 2) -> Column:
    """A sum of money that does not depend on how rows are partitioned."""
    return F.sum(x.cast(f"decimal(18,{scale})")).cast("double")


def exact_avg(x: Column, scale: int = 2) -> Column:
    """Mean from an exact sum: equal on every partitioning."""
    return F.sum(x.cast(f"decimal(18,{scale})")).cast("double") / F.count(x)
