"""Line dedup with exact reference counts and sharded cuckoo filters.

The reference counts say for each line how many documents hold it, and the
postings say which; both are stored tables that take insertions and deletions,
so dedup can be undone.  A line's key is a cryptographic digest of the line, so
no two lines share a count.  The lines that enough documents hold are in cuckoo
filters, one for each shard of the keys; a line enters or leaves its filter when
its count crosses the bound.  The lines of documents go to the tasks that own
their shards, and only those that the filter may hold meet the exact counts.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import WHITE, stored, text_of

MIN_CHARS = 40
MIN_DOCS = 5
#: Lines of a shard when it is made; its filter has room for twice as many.
SHARD_LINES = 100_000
#: Lines that one task holds against a shard's filter; a shard's other lines go to further tasks.
ASKED_LINES = 100_000
SLOTS = 4


class CuckooFilter:
    """16-bit fingerprints in buckets of four, for 64-bit keys; deletions allowed."""

    def __init__(self, buckets: int, table: np.ndarray | None = None):
        self.buckets = buckets  # a power of two
        self.table = np.zeros((buckets, SLOTS), np.uint16) if table is None else table

    @classmethod
    def for_keys(cls, n: int, load: float = 0.8) -> CuckooFilter:
        """An empty filter with room for ``n`` keys."""
        return cls(1 << max(1, math.ceil(math.log2(max(1, n) / SLOTS / load))))

    def insert_all(self, keys: np.ndarray) -> bool:
        """Insert distinct keys; false if they don't fit, and then the filter is spoilt."""
        return all(self.insert(int(k)) for k in self._first_round(keys))

    def _mark(self, keys: np.ndarray) -> np.ndarray:
        mark = (keys >> np.uint64(48)).astype(np.uint16)
        return np.where(mark == 0, np.uint16(1), mark)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys & np.uint64(self.buckets - 1)).astype(np.int64)

    def _other(self, bucket, mark):
        """The other bucket of a mark: an involution."""
        return bucket ^ ((np.asarray(mark, np.int64) * 0x5BD1E995) & (self.buckets - 1))

    def _first_round(self, keys: np.ndarray) -> np.ndarray:
        """Put keys into free slots of their first bucket, all at once; return those left."""
        home, mark = self._home(keys), self._mark(keys)
        order = np.argsort(home, kind="stable")
        ranked = home[order]
        # slots fill up from the first, but a deletion may leave a gap: then keys go in one by one
        used = (self.table[ranked] != 0).sum(axis=1)
        nth = np.arange(len(keys)) - np.searchsorted(ranked, ranked) + used
        fit = (nth < SLOTS) & (self.table[ranked, np.minimum(nth, SLOTS - 1)] == 0)
        self.table[ranked[fit], nth[fit]] = mark[order][fit]
        return keys[order][~fit]

    def insert(self, key: int) -> bool:
        one = np.array([key], np.uint64)
        bucket, mark = int(self._home(one)[0]), int(self._mark(one)[0])
        for turn in range(500):
            for b in (bucket, int(self._other(bucket, mark))):
                free = np.flatnonzero(self.table[b] == 0)
                if len(free):
                    self.table[b, free[0]] = mark
                    return True
            bucket = int(self._other(bucket, mark))
            slot = turn % SLOTS
            self.table[bucket, slot], mark = mark, int(self.table[bucket, slot])
        return False

    def delete(self, key: int) -> bool:
        one = np.array([key], np.uint64)
        bucket, mark = int(self._home(one)[0]), int(self._mark(one)[0])
        for b in (bucket, int(self._other(bucket, mark))):
            at = np.flatnonzero(self.table[b] == mark)
            if len(at):
                self.table[b, at[0]] = 0
                return True
        return False

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        home, mark = self._home(keys), self._mark(keys)
        return (self.table[home] == mark[:, None]).any(axis=1) | (self.table[self._other(home, mark)] == mark[:, None]).any(axis=1)


def line_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, row, line, d1, d2, first): each line of at least ``min_chars`` code points, by its key's two halves.

    The key is of the line without outer white space and with A-Z in lower case.
    ``row`` is a hash of the text, which tells rows of one id apart; ``first`` is
    true where the text hasn't had the key before.
    """
    kinds = pa.struct([("line", pa.int32()), ("d1", pa.int64()), ("d2", pa.int64()), ("first", pa.bool_())])
    white = WHITE.encode()

    def keyed(text: bytes) -> list[tuple[int, bytes]]:
        out = []
        for at, line in enumerate(text.split(b"\n")):
            if len(line) >= min_chars and len(line := line.strip(white).lower()) >= min_chars and (line.isascii() or len(line.decode(errors="replace")) >= min_chars):
                out.append((at, hashlib.blake2b(line, digest_size=16).digest()))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [keyed(text.as_py()) for text in batch.column(2)]
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            halves = np.frombuffer(b"".join(d for own in found for _, d in own), np.int64).reshape(-1, 2)
            first = [new for own in found for new in _first(d for _, d in own)]
            lines = pa.StructArray.from_arrays([pa.array([at for own in found for at, _ in own], pa.int32()), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(first, pa.bool_())], fields=list(kinds))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(ends), lines)], ["doc_id", "row", "lines"])

    rows = text_of(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("row"), F.col("text").cast("binary").alias("body"))
    return rows.mapInArrow(run, "doc_id long, row long, lines array<struct<line:int,d1:long,d2:long,first:boolean>>").select("doc_id", "row", F.explode("lines").alias("k")).select("doc_id", "row", "k.*")


def _first(digests: Iterator[bytes]) -> Iterator[bool]:
    seen: set[bytes] = set()
    for d in digests:
        yield d not in seen
        seen.add(d)


@dataclass(frozen=True)
class LineIndex:
    """Stored tables over the lines of a set of documents.

    ``postings`` (d1, d2, doc_id): once for each document that holds a line;
    ``counts`` (d1, d2, n_docs, last): exact, with the largest id; ``filters``
    (shard, buckets, body): the lines that ``min_docs`` or more documents hold.
    """

    postings: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int
    min_docs: int

    @property
    def repeated(self) -> DataFrame:
        return self.counts.filter(F.col("n_docs") >= self.min_docs)


def _shard(shards: int):
    return F.pmod("d2", F.lit(shards)).cast("int")


def _refilled(filters: DataFrame, crossing: DataFrame, shards: int) -> DataFrame:
    """The filters after the lines of ``crossing`` (d1, d2, up) came in or went out.

    A filter that its lines don't fit has no buckets any more: it lets all lines
    pass until the filters are made anew.
    """
    room = 2 * SHARD_LINES

    def change(key: tuple, old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        held = CuckooFilter.for_keys(room) if not len(old) else CuckooFilter(int(old["buckets"][0]), np.frombuffer(old["body"][0], np.uint16).reshape(-1, SLOTS).copy())
        up = new["up"].to_numpy(bool)
        keys = new["d1"].to_numpy(np.int64).view(np.uint64)
        fits = held.buckets > 0 and all(held.delete(int(k)) for k in keys[~up]) and held.insert_all(keys[up])
        return pd.DataFrame({"shard": [key[0]], "buckets": [held.buckets if fits else 0], "body": [held.table.tobytes() if fits else b""]})

    moved = crossing.select("d1", "up", _shard(shards).alias("shard"))
    return filters.groupBy("shard").cogroup(moved.groupBy("shard")).applyInPandas(change, "shard int, buckets long, body binary")


def _fresh_filters(counts: DataFrame, min_docs: int) -> tuple[DataFrame, int]:
    repeated = counts.filter(F.col("n_docs") >= min_docs)
    shards = max(1, math.ceil(repeated.count() / SHARD_LINES))
    none = counts.sparkSession.createDataFrame([], "shard int, buckets long, body binary")
    return stored(_refilled(none, repeated.select("d1", "d2", F.lit(True).alias("up")), shards), "line-filters"), shards


def _index(lines: DataFrame, min_docs: int) -> LineIndex:
    postings = lines.filter("first").select("d1", "d2", "doc_id")
    counts = stored(postings.groupBy("d1", "d2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last")), "line-counts")
    return LineIndex(postings, counts, *_fresh_filters(counts, min_docs), min_docs)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> LineIndex:
    """The index of a set of documents; each row counts as a document."""
    return _index(stored(line_keys(docs, id_col, text_col, min_chars), "line-keys"), min_docs)


def _updated(index: LineIndex, postings: DataFrame, change: DataFrame, stale: DataFrame | None) -> LineIndex:
    """``change`` (d1, d2, n, newest): documents more or fewer for each line; ``stale``: lines whose largest id may be gone."""
    key = ["d1", "d2"]
    was = F.coalesce("n_docs", F.lit(0))
    touched = change.join(index.counts, key, "left").select(*key, was.alias("was"), (was + F.col("n")).alias("n_docs"), F.greatest("last", "newest").alias("last"))
    if stale is not None:
        left = postings.join(stale, key, "left_semi").groupBy(*key).agg(F.max("doc_id").alias("largest"))
        touched = touched.drop("last").join(left.withColumnRenamed("largest", "last"), key, "left")
    touched = stored(touched, "line-touched")
    counts = index.counts.join(touched.select(*key), key, "left_anti").union(touched.filter("n_docs > 0").select(*key, "n_docs", "last"))
    counts = stored(counts, "line-counts")
    least = F.lit(index.min_docs)
    crossing = touched.withColumn("up", F.col("n_docs") >= least).filter((F.col("was") >= least) != F.col("up"))
    filters = stored(_refilled(index.filters, crossing, index.shards), "line-filters")
    made = LineIndex(postings, counts, filters, index.shards, index.min_docs)
    if made.repeated.count() > 2 * SHARD_LINES * index.shards or not filters.filter("buckets = 0").isEmpty():
        return LineIndex(postings, counts, *_fresh_filters(counts, index.min_docs), index.min_docs)
    return made


def insert_documents(index: LineIndex, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> LineIndex:
    """The index after documents came; each row counts as one more document, whatever its id."""
    came = stored(line_keys(docs, id_col, text_col, min_chars).filter("first").select("d1", "d2", "doc_id"), "line-came")
    change = came.groupBy("d1", "d2").agg(F.count("*").alias("n"), F.max("doc_id").alias("newest"))
    return _updated(index, index.postings.union(came), change, None)


def delete_documents(index: LineIndex, gone: DataFrame, id_col: str = "doc_id") -> LineIndex:
    """The index after all rows of the documents with these ids went; ids that it doesn't have change nothing."""
    ids = gone.select(F.col(id_col).cast("long").alias("id2")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("id2"))
    went = stored(index.postings.join(ids, same, "left_semi"), "line-went")
    left = stored(index.postings.join(ids, same, "left_anti"), "line-postings")
    change = went.groupBy("d1", "d2").agg((-F.count("*")).alias("n"), F.lit(None).cast("long").alias("newest"))
    return _updated(index, left, change, went.select("d1", "d2").distinct())


def _hits(lines: DataFrame, index: LineIndex) -> DataFrame:
    """The lines (doc_id, row, line, d1, d2) that the filters may hold, found by the tasks that own the shards.

    A shard with many lines, as one line may be in every document, has several
    tasks; each gets the filter, whose size is set, and a share of the lines.
    """
    asked = lines.select("doc_id", "row", "line", "d1", "d2", _shard(index.shards).alias("shard"))
    tasks = asked.groupBy("shard").agg(F.ceil(F.count("*") / ASKED_LINES).cast("int").alias("tasks"))
    asked = asked.join(tasks, "shard").withColumn("task", F.pmod(F.xxhash64("row", "line"), F.col("tasks")).cast("int"))
    held = index.filters.join(tasks, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"), "buckets", "body")
    none = {"doc_id": "long", "row": "long", "line": "int", "d1": "long", "d2": "long"}
    columns = ["shard", "task", *none, "buckets", "body"]
    held = held.withColumns({k: F.lit(None).cast(v) for k, v in none.items()}).select(*columns)
    asked = asked.withColumns({"buckets": F.lit(None).cast("long"), "body": F.lit(None).cast("binary")}).select(*columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, table = None, None
        for batch in batches:  # sorted by shard and task, the filter before the lines
            shard, task = (batch.column(i).to_numpy() for i in (0, 1))
            is_filter = batch.column(7).is_valid().to_numpy(zero_copy_only=False)
            d1 = batch.column(5).fill_null(0).to_numpy()
            hit = np.zeros(batch.num_rows, bool)
            cuts = np.flatnonzero(np.r_[True, (shard[1:] != shard[:-1]) | (task[1:] != task[:-1])])
            for low, high in zip(cuts, np.r_[cuts[1:], batch.num_rows], strict=False):
                if is_filter[low]:
                    buckets, body = batch.column(7)[int(low)].as_py(), batch.column(8)[int(low)].as_py()
                    owner, table = (shard[low], task[low]), CuckooFilter(buckets, np.frombuffer(body, np.uint16).reshape(-1, SLOTS))
                    low += 1
                if owner == (shard[high - 1], task[high - 1]):
                    hit[low:high] = table.may_hold(d1[low:high].view(np.uint64)) if table.buckets else True
            yield batch.select(list(none)).filter(pa.array(hit))

    dealt = held.union(asked).repartition("shard", "task").sortWithinPartitions("shard", "task", F.col("buckets").isNull())
    return dealt.mapInArrow(run, ", ".join(f"{k} {v}" for k, v in none.items()))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, index: LineIndex | None = None, with_text: bool = False) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 (and kept, the text that is left).

    Lines are split at \\n; a null or empty text is one empty line.  Lines of at
    least ``min_chars`` code points (key) that at least ``min_docs`` documents
    hold go, except from the largest id that holds them; a null id never is the
    largest unless alone.  Each row counts as a document; rows that share an id
    keep the line together.  ``index`` is one kept from earlier (build_index,
    insert_documents, delete_documents), with its own ``min_docs``; otherwise it
    is made from ``docs``.  Texts of any length are read whole, line by line; an
    empty table gives no rows; other columns are not read, whatever their names.
    """
    lines = stored(line_keys(docs, id_col, text_col, min_chars), "line-keys")
    index = _index(lines, min_docs) if index is None else index
    gone = _hits(lines, index).join(index.repeated.select("d1", "d2", "last"), ["d1", "d2"]).filter(~F.col("doc_id").eqNullSafe(F.col("last")))
    gone = stored(gone.groupBy(F.col("doc_id").alias("id2"), F.col("row").alias("row2")).agg(F.collect_set("line").alias("dropped")), "line-gone")
    rows = text_of(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("row"), F.col("text").cast("binary").alias("body"))
    # texts are dealt out at every size, so that the plan is the same whatever the number of dropped lines
    rows = rows.join(gone.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("id2")) & (F.col("row") == F.col("row2")), "left")
    schema = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_sha256", pa.string()), *([("kept", pa.string())] if with_text else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, body, dropped in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                text, n = body.as_py(), set(dropped or ())
                parts = text.split(b"\n")
                kept = b"\n".join([x for i, x in enumerate(parts) if i not in n]) if n else text
                out.append((doc_id, len(parts), len(n), hashlib.sha256(kept).hexdigest(), *([kept.decode(errors="replace")] if with_text else [])))
            columns = list(zip(*out, strict=True)) if out else [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)

    ddl = "doc_id long, n_lines long, n_dropped long, kept_sha256 string" + ", kept string" * with_text
    return rows.select("doc_id", "body", "dropped").mapInArrow(run, ddl)
