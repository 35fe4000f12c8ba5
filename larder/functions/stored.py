"""Steps that are written to the shared folder and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str | None:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``; a new one only on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and spark.sparkContext.master.startswith("local"):
        found = f"file://{tempfile.mkdtemp(prefix='larder-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/") if found else None


class CheckError(ValueError):
    """Rows of a step break its checks."""


def settled(df: DataFrame, checks: dict[str, Column] | None = None) -> DataFrame:
    """The same rows as a table of their own: its lineage is short, and readers scan only the columns they need.

    ``checks`` are counted while the table is written; any row for which one holds is an error.
    """
    spark = df.sparkSession
    folder = shared_dir(spark)
    if folder is None:
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    path, seen = f"{folder}/step-{uuid.uuid4().hex}", Observation()
    counted = {f"c{i}": F.count_if(F.coalesce(c, F.lit(False))) for i, c in enumerate((checks or {}).values())}
    (df.observe(seen, *[c.alias(k) for k, c in counted.items()]) if counted else df).write.parquet(path)
    if counted and (broken := {name: seen.get[k] for name, k in zip(checks, counted, strict=True) if seen.get[k]}):
        raise CheckError(f"rows that may not be: {broken}")
    return spark.read.schema(df.schema).parquet(path)
