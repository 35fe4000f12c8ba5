"""Column expressions that several operators share.  Missing values are NULL, never NaN."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(over: Column, under: Column) -> Column:
    """NULL where the divisor is zero or missing."""
    return F.try_divide(over.cast("double"), under.cast("double"))


def at_least_zero(col: Column) -> Column:
    """``greatest`` would turn a missing value into zero."""
    return F.when(col.isNotNull(), F.greatest(col, F.lit(0.0)))


def wape(actual: Column, forecast: Column) -> Column:
    """Sum of absolute errors over sum of absolute actuals: an aggregate."""
    return ratio(F.sum(F.abs(actual - forecast)), F.sum(F.abs(actual)))


def round_up(quantity: Column, least: Column, multiple: Column) -> Column:
    """The smallest multiple that is at least the quantity and the least order."""
    return F.ceil(F.greatest(quantity, least) / multiple).cast("double") * multiple


def demand_value(columns: list[str], basis: str = "gross_margin") -> Column:
    """Demand at margin (never negative), cost or price."""
    worth = {"gross_margin": ("unit_price", "unit_cost"), "cost": ("unit_cost",), "revenue": ("unit_price",)}
    if basis not in worth or not set(worth[basis]) <= set(columns):
        raise ValueError(f"no economic value by {basis!r} from {columns}")
    unit = at_least_zero(F.col("unit_price") - F.col("unit_cost")) if basis == "gross_margin" else F.col(worth[basis][0])
    return F.col("demand") * unit


def percent_change(new: Column, old: Column) -> Column:
    return (ratio(new, old) - 1) * 100


def cyclic(col: Column, period: int) -> tuple[Column, Column]:
    angle = F.lit(2 * math.pi) * col / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def valid_number(col: Column) -> Column:
    """A cast that gives NULL for what is no finite number."""
    number = col.try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) < math.inf), number)
