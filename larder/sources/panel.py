"""The daily panel: its schema, readers and writers, and the panel of the standard tables."""

from __future__ import annotations

from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.config import STANDARD, Settings
from larder.functions.stored import settled
from larder.sources.series import panel_of, standard_series

#: The 13 columns that a panel must have, by type.
PANEL = T.StructType(
    [T.StructField("sku_id", T.StringType()), T.StructField("date", T.DateType())]
    + [T.StructField(c, T.LongType()) for c in ("demand", "sales_quantity", "inventory_level", "order_received")]
    + [T.StructField("category", T.StringType())]
    + [T.StructField(c, T.LongType()) for c in ("lead_time", "safety_stock", "reorder_point", "order_quantity")]
    + [T.StructField(c, T.DoubleType()) for c in ("unit_cost", "unit_price")]
)


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def _typed(spark: SparkSession, path: str, schema: T.StructType) -> T.StructType:
    """The columns of a CSV's header: those of ``schema`` by their types, others as text."""
    known = {f.name: f for f in schema}
    return T.StructType([known.get(c, T.StructField(c, T.StringType())) for c in spark.read.option("header", True).csv(path).columns])


def read_panel(spark: SparkSession, path: str, kind: str = "csv", schema: T.StructType = PANEL) -> DataFrame:
    """A strict scan: malformed rows fail, and so do missing columns.  Further columns stay."""
    if kind == "parquet":
        df = spark.read.parquet(path)
    else:
        df = spark.read.schema(_typed(spark, path, schema)).option("header", True).option("mode", "FAILFAST").csv(path)
    if missing := missing_columns(df, schema.fieldNames()):
        raise ValueError(f"missing columns: {missing}")
    return df


class Tolerant(NamedTuple):
    """Rows that could be read, those that couldn't (as text), and what was wrong, if anything."""

    rows: DataFrame
    quarantine: DataFrame
    fault: str | None


def read_tolerant(spark: SparkSession, path: str, schema: T.StructType, kind: str = "csv") -> Tolerant:
    """A scan that never fails: malformed rows go to quarantine, and the rest is a table of ``schema``.

    What is missing, unreadable or lacks columns gives an empty table and a fault that
    names it.  The scan runs once, into a table in the shared folder, where both parts
    are read from; rows keep their further columns out.
    """
    bad = "_malformed"
    lines = T.StructType([T.StructField("line", T.StringType())])
    try:
        if kind == "parquet":
            df = spark.read.parquet(path).withColumn(bad, F.lit(None).cast("string"))
        else:
            typed = _typed(spark, path, schema).add(bad, T.StringType())
            df = spark.read.schema(typed).option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", bad).csv(path)
        if missing := missing_columns(df, schema.fieldNames()):
            return Tolerant(spark.createDataFrame([], schema), spark.createDataFrame([], lines), f"{path}: missing columns {missing}")
        scanned = settled(df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema], bad))
    except (PySparkException, Py4JJavaError) as error:
        said = str(error).strip().splitlines() or [type(error).__name__]
        return Tolerant(spark.createDataFrame([], schema), spark.createDataFrame([], lines), f"{path}: {said[0][:200]}")
    quarantine = scanned.filter(F.col(bad).isNotNull()).select(F.col(bad).alias("line"))
    n = quarantine.count()
    return Tolerant(scanned.filter(F.col(bad).isNull()).drop(bad), quarantine, f"{path}: {n} malformed rows" if n else None)


def read_artifact(spark: SparkSession, path: str, schema: T.StructType, kind: str = "csv") -> DataFrame:
    """The readable rows of a tolerant scan for reports; what is missing or unreadable is an empty table."""
    return read_tolerant(spark, path, schema, kind).rows


def export_panel(panel: DataFrame, table: str, buckets: int = 64) -> DataFrame:
    """A table bucketed and sorted by (sku_id, date), and read back: windows by SKU need no exchange or sort on it.

    Each task writes whole buckets, so a bucket is one file that is in order.
    """
    dealt = panel.repartition(buckets, "sku_id").sortWithinPartitions("sku_id", "date")
    dealt.write.mode("overwrite").bucketBy(buckets, "sku_id").sortBy("sku_id", "date").format("parquet").saveAsTable(table)
    return panel.sparkSession.table(table)


def write_table(df: DataFrame, path: str, kind: str = "parquet", partition_by: str | None = None) -> None:
    """Overwrite a table; ``csv`` is one file with a header, for small results only."""
    if kind == "csv":
        df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
        return
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def data_contract(panel: DataFrame) -> dict:
    """What a written panel promises: columns and types, dates, and counts."""
    found = panel.agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count("*").alias("rows"), F.countDistinct("sku_id").alias("skus")).first()
    return {"primary_key": ["sku_id", "date"], "columns": dict(panel.dtypes), "date_min": str(found["first"]), "date_max": str(found["last"]), "rows": found["rows"], "skus": found["skus"]}


def standard_panel(spark: SparkSession, sf_dir: str, settings: Settings = STANDARD, by: str = "brand") -> DataFrame:
    """A panel of brands by day for 1999 and 2000, from lineitem and part; ``by`` "part" has a SKU for each part instead.

    The number of parts grows with the tables, that of brands doesn't.  Days without sales are filled with zeros.  Each Monday receives what the
    seven days before sold, and the inventory never falls below zero.
    """
    return panel_of(standard_series(spark, sf_dir, by), settings)
