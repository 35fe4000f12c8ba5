"""Running totals, row numbers and exact quantiles over a whole table in one order.

A window without partitions would put all rows into one task.  Here the rows are
dealt to ranges of the order, each range is worked on by itself, and what comes
before it is added from a table with one row a range.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.stored import settled


def running_total(df: DataFrame, value: Column, order: list[Column], name: str, total: str | None = None) -> DataFrame:
    """``df`` with the sum of ``value`` up to and with each row, and the sum of all rows as ``total``.

    ``order`` must tell any two rows apart.  Missing values count as nothing.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # two readers see the ranges, whose bounds come from a sample: they must be the same for both
    rows = settled(df.withColumn("_value", value).repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()))
    own = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.orderBy("_range")
    sums = rows.groupBy("_range").agg(F.coalesce(F.sum("_value"), F.lit(0)).alias("_sum"))
    sums = sums.withColumns({"_before": F.coalesce(F.sum("_sum").over(every.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_all": F.sum("_sum").over(Window.partitionBy())})  # one row a range
    out = rows.join(F.broadcast(sums), "_range").withColumn(name, F.col("_before") + F.coalesce(F.sum("_value").over(own), F.lit(0)))
    return (out.withColumn(total, F.col("_all")) if total else out).drop("_range", "_value", "_sum", "_before", "_all")


def numbered(df: DataFrame, order: list[Column], name: str, total: str | None = None) -> DataFrame:
    """``df`` with row numbers from 1, and the number of rows as ``total``."""
    return running_total(df, F.lit(1).cast("long"), order, name, total)


def quantiles(df: DataFrame, column: str, key: str, wanted: dict[str, float]) -> DataFrame:
    """One row: for each name the linear quantile of ``column``; ``key`` orders equal values.  NULL without rows."""
    rows = numbered(df.select(column, key).filter(F.col(column).isNotNull()), [F.col(column), F.col(key)], "_at", "_n")
    parts = []
    for name, q in wanted.items():
        place = F.lit(q) * (F.col("_n") - 1) + 1
        low, high = (F.max(F.when(F.col("_at") == edge, F.col(column))) for edge in (F.floor(place), F.ceil(place)))
        parts.append((low + (high - low) * F.max(place - F.floor(place))).alias(name))
    return rows.agg(*parts)


def grouped_quantiles(df: DataFrame, keys: list[str], column: str, wanted: dict[str, float]) -> DataFrame:
    """(keys, names): for each group and name the linear quantile of ``column``.  Groups without a value have no row.

    Equal values are counted first.  The different ones are dealt to ranges of
    (keys, value), so a group of any size lies in as many ranges as it needs; a group
    in several ranges has what lies before added from a table of two rows a range.
    Null keys are a group.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = df.filter(F.col(column).isNotNull()).groupBy(*keys, F.col(column).alias("_value")).agg(F.count("*").alias("_c"))
    rows = settled(values.repartitionByRange(ranges, *keys, "_value").withColumn("_range", F.spark_partition_id()))
    group = Window.partitionBy(*keys)
    held = rows.groupBy("_range", *keys).agg(F.sum("_c").alias("_own"))
    earlier = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumns({"_parts": F.count("*").over(group), "_all": F.sum("_own").over(group), "_before": F.coalesce(F.sum("_own").over(earlier), F.lit(0))})
    spread = held.filter("_parts > 1").select(F.col("_range").alias("_at"), *[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], "_all", "_before")
    same = F.col("_range") == F.col("_at")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_key{i}"))
    own = Window.partitionBy("_range", *keys)
    upto = own.orderBy("_value").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"_upto": F.sum("_c").over(upto), "_own": F.sum("_c").over(own)}).join(F.broadcast(spread), same, "left")
    rows = rows.select(*keys, "_value", "_c", (F.col("_upto") + F.coalesce("_before", F.lit(0))).alias("_upto"), F.coalesce("_all", "_own").alias("_n"))
    edges, picked = [], {}
    for name, q in wanted.items():
        place = F.lit(float(q)) * (F.col("_n") - 1)
        inside = [(F.col("_upto") > edge) & (F.col("_upto") - F.col("_c") <= edge) for edge in (F.floor(place), F.ceil(place))]
        low, high = (F.max(F.when(hit, F.col("_value"))) for hit in inside)
        picked[name] = low + (high - low) * F.max(place - F.floor(place))
        edges += inside
    return rows.filter(reduce(lambda a, b: a | b, edges)).groupBy(*keys).agg(*[c.alias(name) for name, c in picked.items()])
