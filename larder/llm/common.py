"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of all operators here: [\x20\x09-\x0D].
WHITE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where the setting is missing (tests on one machine) a new one is made.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='larder-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage: lost executors cost no recomputation of ``df``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_of(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """``doc_id`` and ``text`` alone (a null text is empty), so no other column can clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *more)


def lower_ascii(col: Column) -> Column:
    """A-Z in lower case; all other characters stay."""
    return F.translate(col, UPPER, LOWER)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def least_by_hash(df: DataFrame, bound: int, *columns: str) -> DataFrame:
    """The ``bound`` rows with the smallest hash of ``columns``, which tell rows apart.

    Of many rows only those below a hash that some twice as many are expected to have
    are put in order, so what tasks send on doesn't grow with their number.
    """
    h, n, near = F.xxhash64(*columns), df.count(), max(2 * bound, bound + 1000)
    if n > near:
        df = df.filter(h < F.lit(-(2**63) + 2**64 * near // n))
    return df.orderBy(h, *columns).limit(bound)
