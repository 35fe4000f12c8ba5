"""Sharding by jump consistent hashing: a stable key alone decides the shard."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import stored

#: Rows that one task numbers at a time.
CHUNK_ROWS = 4096


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Jump consistent hash of each unsigned 64-bit key over ``shards`` shards."""
    keys = keys.astype(np.uint64).copy()
    shard = np.zeros(len(keys), np.int64)
    active = np.arange(len(keys))
    while len(active):
        k = keys[active] * np.uint64(2862933555777941757) + np.uint64(1)
        keys[active] = k
        jump = ((shard[active] + 1) * (float(1 << 31) / ((k >> np.uint64(33)).astype(np.float64) + 1))).astype(np.int64)
        moved = jump < shards
        active = active[moved]
        shard[active] = jump[moved]
    return shard


def shard_of(key: Column, shards: int) -> Column:
    """The shard of each key; keys of any type are hashed to 64 bits first."""

    @F.pandas_udf("int")
    def jump(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(jump_hash(batch.to_numpy(np.int64).view(np.uint64), shards), dtype="int32")

    return jump(F.xxhash64(key))


def shard_documents(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Each row's shard, its slot there, and its shard if one more is appended.

    The law is ``key``: id and shard count decide, so equal texts may part, and
    a further shard takes rows only into itself.  Slots are gapless from 0 in
    each shard.  They are numbered in chunks of about ``chunk_rows`` rows, dealt by
    a hash of the row and of its place in a stored table, so no task holds a shard
    or all rows that repeat each other.  A null id is a key like any other; a null
    text has no bytes; repeated rows get slots of their own; texts of any length
    cost one pass; no rows for an empty table; other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = stored(rows.withColumns({"shard": shard_of(F.col("doc_id"), shards), "grown_shard": shard_of(F.col("doc_id"), shards + 1), "place": F.monotonically_increasing_id()}), "shard-rows")
    chunks = max(1, math.ceil(rows.count() / shards / chunk_rows))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64(F.lit("chunk"), "doc_id", "text_crc32", "place"), F.lit(chunks)))
    before = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "chunk").agg(F.count("*").alias("n")).select("shard", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("shard", "chunk").orderBy("doc_id", "text_crc32", "size", "place"))
    placed = rows.withColumn("nth", within).join(starts, ["shard", "chunk"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("nth") - 1).cast("long").alias("slot"), "grown_shard")
