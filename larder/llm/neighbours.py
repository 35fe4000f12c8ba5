"""Approximate nearest neighbours by inner product, over graph shards.

Equal vectors are one node with the ids of its copies, so a vector that a third of
the rows share is one node too.  Nodes are dealt to shards of bounded size; a task
builds each shard's graph and stores it as one row of flat arrays.  Blocks of
queries meet every shard's row; what the shards find is scored on the original
vectors in double precision and merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import stored
from larder.llm.small_world import LINKS, LOW_LINKS, Graph, on_sphere, spread

#: Nodes of a shard, and bytes of their vectors, at most.
SHARD_VECTORS, SHARD_BYTES = 16_384, 128 << 20
#: Queries that meet a shard in one task.
QUERY_BLOCK = 1024
#: Nodes that a search keeps; more of them find more of the true neighbours.
BEAM = 200
#: Rows of a table that is sent to all tasks at most; a dimension has some 2,100 powers of two at most.
BROADCAST_ROWS = 100_000
#: Of those, how many times the wanted number are scored exactly.
SCORED = 3


def usable(vec: Column) -> Column:
    """Vectors that are null, empty or zero, or hold a null or no finite number, take no part."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vec.isNotNull() & finite & F.exists(vec, lambda x: x != 0), F.lit(False))


def _scale(vec: Column) -> Column:
    """The power of two nearest the vector's length, without overflow."""
    most = F.aggregate(vec, F.lit(0.0), lambda m, x: F.greatest(m, F.abs(x.cast("double"))))
    squares = F.aggregate(vec, F.lit(0.0), lambda s, x: s + F.pow(x.cast("double") / most, F.lit(2.0)))
    return F.round(F.log2(most) + F.log2(squares) / 2).cast("int")


def distinct_vectors(vectors: DataFrame, ids: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec, ids): each usable vector once, with the ``ids`` smallest ids that have it.

    Rows that repeat each other count once.  Tasks keep the smallest ids of each
    vector before they send rows on, so copies of one vector don't meet in one task.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("vec")).filter(F.col("vec_id").isNotNull() & usable(F.col("vec")))
    nth = F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))
    few = rows.groupBy("vec", "vec_id").agg(F.count("*").alias("rows")).drop("rows").withColumn("nth", nth).filter(F.col("nth") <= ids)
    return few.groupBy("vec").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))


def _with(df: DataFrame, kinds: DataFrame, on: list[str]) -> DataFrame:
    """``df`` with the columns of a stored table that has few rows for each dimension; it is sent to all tasks if it is small."""
    return df.join(F.broadcast(kinds) if kinds.count() <= BROADCAST_ROWS else kinds, on)


_INDEX = "dim int, scale int, part long, n int, vectors binary, id_values binary, id_ends binary, layers array<binary>"


def build_index(vectors: DataFrame, most_results: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", shard_vectors: int = SHARD_VECTORS) -> DataFrame:
    """One row a shard: (dim, scale, part, n, vectors, id_values, id_ends, layers), stored in the shared folder.

    A shard holds vectors of one dimension and of about one length, as the detour that
    makes the largest product the nearest point is short only among such.  Levels
    and order of insertion come from ids, so a lost task builds the same graph again.
    ``most_results`` bounds the ids kept of equal vectors (one more for the query's own).

    Null ids and unusable vectors (``usable``) are left out; no rows for an empty table;
    other columns are not read.
    """
    nodes = distinct_vectors(vectors, most_results + 1, id_col, vec_col)
    nodes = stored(nodes.withColumns({"dim": F.size("vec"), "scale": _scale(F.col("vec"))}), "neighbour-nodes")
    most = F.greatest(F.lit(1.0), F.least(F.lit(float(shard_vectors)), F.lit(float(SHARD_BYTES)) / (8 * F.col("dim"))))
    kinds = stored(nodes.groupBy("dim", "scale").count().withColumn("shards", F.ceil(F.col("count") / most)).drop("count"), "neighbour-kinds")
    dealt = _with(nodes, kinds, ["dim", "scale"]).withColumn("part", F.pmod(F.xxhash64("vec"), F.col("shards")))
    wide = dict(nodes.dtypes)["vec"] == "array<double>"

    def build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        own = _square(table["vec"], np.float64 if wide else np.float32)
        lists = table["ids"].combine_chunks()
        lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
        ends = lists.offsets.to_numpy()
        flat = lists.values.to_numpy()
        first = flat[ends[:-1]]
        draws = spread(first)
        order = Graph.order(draws, first, *own.T[:2])
        values = np.concatenate([flat[ends[i] : ends[i + 1]] for i in order])
        scale = int(table["scale"][0].as_py())
        graph = Graph.build(on_sphere(np.ldexp(own[order].astype(float), -scale).astype(np.float32)), draws[order])
        row = {"dim": own.shape[1], "scale": scale, "part": key[2].as_py(), "n": len(own), "vectors": own[order].tobytes(), "id_values": values.astype(np.int64).tobytes(), "id_ends": np.cumsum(np.diff(ends)[order]).astype(np.int64).tobytes(), "layers": [x.tobytes() for x in graph.layers]}
        return pa.table({k: pa.array([v], t) for (k, v), t in zip(row.items(), _INDEX_TYPES, strict=True)})

    return stored(dealt.groupBy("dim", "scale", "part").applyInArrow(build, _INDEX), "neighbour-index")


_INDEX_TYPES = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.binary()))


def _square(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    lists = pa.concat_arrays(column.chunks)
    return lists.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(lists), -1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows in double precision, added from the first component to the last."""
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        out += a[:, i].astype(float) * b[:, i]
    return out


_FOUND = "query long, query_id long, vec_id long, score double"


def nearest(index: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", beam: int = BEAM, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows with the largest inner product found for each query, best first.

    The query's own id is left out; ties go to the smaller id.  All candidates come
    where there are fewer than ``k`` in a shard's reach; those of another dimension
    aren't comparable.  ``k`` must not exceed the index's ``most_results``.

    Queries without id or with unusable vectors get no rows; equal rows count once,
    and an id with several vectors is answered for each; other columns are not read.
    """
    asked = queries.select(F.col(id_col).cast("long").alias("query_id"), F.col(vec_col).alias("vec")).filter(F.col("query_id").isNotNull() & usable(F.col("vec")))
    asked = stored(asked.groupBy("query_id", "vec").agg(F.xxhash64("query_id", "vec").alias("query")).withColumn("dim", F.size("vec")), "neighbour-queries")
    blocks = stored(asked.groupBy("dim").agg(F.ceil(F.count("*") / query_block).alias("blocks")), "neighbour-blocks")
    kinds = stored(index.groupBy("dim", "scale").agg((F.max("part") + 1).alias("parts")), "neighbour-kinds")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    held = _with(index, blocks, ["dim"]).withColumn("block", each("blocks")).drop("blocks")
    sent = _with(asked, blocks, ["dim"]).withColumn("block", F.pmod("query", "blocks")).drop("blocks")
    sent = _with(sent, kinds, ["dim"]).withColumn("part", each("parts")).drop("parts")
    cell = ["dim", "scale", "part", "block"]

    def search(key: tuple[pa.Scalar, ...], found: pa.Table, wanted: pa.Table) -> pa.Table:
        if not len(found) or not len(wanted):
            return _FOUND_TYPES.empty_table()
        row = found.to_pylist()[0]
        kind = np.float32 if len(row["vectors"]) == 4 * row["n"] * row["dim"] else np.float64
        own = np.frombuffer(row["vectors"], kind).reshape(row["n"], row["dim"])
        ids, ends = np.frombuffer(row["id_values"], np.int64), np.frombuffer(row["id_ends"], np.int64)
        layers = [np.frombuffer(x, np.int32).reshape(-1, LINKS if k else LOW_LINKS) for k, x in enumerate(row["layers"])]
        graph = Graph(on_sphere(np.ldexp(own.astype(float), -row["scale"]).astype(np.float32)), layers)
        asked = _square(wanted["vec"], np.float64)
        unit = asked / np.abs(asked).max(axis=1, keepdims=True)
        near = graph.search(unit.astype(np.float32), max(beam, SCORED * (k + 1)))[:, : SCORED * (k + 1)]
        who, nth = np.nonzero(near >= 0)
        node = near[who, nth]
        score = products(asked[who], own[node])
        starts = np.r_[0, ends[:-1]]
        copies = (ends - starts)[node]
        at = np.repeat(starts[node], copies) + np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
        who, score, vec_id = np.repeat(who, copies), np.repeat(score, copies), ids[at]
        query, query_id = wanted["query"].to_numpy(), wanted["query_id"].to_numpy()
        other = vec_id != query_id[who]
        who, score, vec_id = who[other], score[other], vec_id[other]
        order = np.lexsort((vec_id, -score, who))
        who, score, vec_id = who[order], score[order], vec_id[order]
        first = np.r_[True, who[1:] != who[:-1]] if len(who) else np.empty(0, bool)
        best = np.arange(len(who)) - np.maximum.accumulate(np.where(first, np.arange(len(who)), 0)) < k
        who = who[best]
        return pa.Table.from_arrays([pa.array(query[who]), pa.array(query_id[who]), pa.array(vec_id[best]), pa.array(score[best])], schema=_FOUND_TYPES)

    met = held.groupBy(*cell).cogroup(sent.groupBy(*cell)).applyInArrow(search, _FOUND)
    rank = F.row_number().over(Window.partitionBy("query", "query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


_FOUND_TYPES = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

