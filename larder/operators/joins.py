"""Joins that check how many rows may match, and joins with small dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A dimension of at most so many rows may be broadcast.
BROADCAST_ROWS = 200_000


def once(df: DataFrame, on: list[str], side: str) -> DataFrame:
    """``df``, whose rows fail where a key occurs more often than once.

    The check is part of the rows and deals them by the key, as the join does next.
    """
    says = F.concat(F.lit(f"{on} is not unique on the {side} side: "), F.concat_ws(" ", *on))
    many = F.count("*").over(Window.partitionBy(*on)) > 1
    kind = dict(df.dtypes)[on[0]]
    return df.withColumn(on[0], F.when(many, F.raise_error(says).cast(kind)).otherwise(F.col(on[0])))


def checked_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", validate: str = "many_to_one") -> DataFrame:
    """A join whose rows fail unless it is what ``validate`` says: one_to_one, one_to_many or many_to_one."""
    if validate in ("one_to_one", "one_to_many"):
        left = once(left, on, "left")
    if validate in ("one_to_one", "many_to_one"):
        right = once(right, on, "right")
    return left.join(right, on, how)


def with_dimension(facts: DataFrame, dimension: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join a dimension: broadcast if counted and small, otherwise as Spark chooses."""
    small = dimension.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return facts.join(F.broadcast(dimension) if small else dimension, on, how)
