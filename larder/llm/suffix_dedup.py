"""Suffix-array dedup: bytes of long strings that occur elsewhere are removed.

Each window of ``WINDOW`` bytes is owned by its anchor, the gram of ``GRAM``
bytes in it whose hash is least; equal windows have equal anchors at the same
offset.  So only suffixes at repeated anchors need sorting.  Anchors whose whole
stretch of windows is the same are one class and repeat as they stand.  For the
classes that differ, the suffixes to the right of the anchor and the reversed
prefixes to its left are put in order by deep-shallow sorting: multikey quicksort
to a shallow depth, then a blind trie for each group that is still equal.  With
the common prefixes of neighbours, a window at offset o repeats if another shares
o bytes to the left and WINDOW - o to the right.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.common import partitions, stored, text_of

WINDOW = 400
GRAM = 200
#: Symbols that multikey quicksort compares before blind tries take over.
SHALLOW = 64
#: Different stretches at one anchor beyond which windows are counted one by one.
LARGE_GROUP = 16_384
#: Stretches that are sorted together.
TOGETHER = 8_192
#: Bits of a filter that goes to all tasks: 32 MB at any size of the input.
FILTER_BITS = 1 << 28
_SEGMENT_BITS = 6
_SEGMENT = FILTER_BITS >> _SEGMENT_BITS
#: Windows that are hashed together.
_CHUNK = 1 << 17
_MASK = np.uint64((1 << 18) - 1)

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


_BYTES = _mixed(_mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE)))
_UP = _powers(_BASE, _CHUNK + WINDOW)
_DOWN = _powers(_INVERSE, _CHUNK + WINDOW)


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram hash, anchor, first, last): for each anchor in turn, the window starts that it owns."""
    found = []
    for at in range(0, max(0, len(data) - WINDOW + 1), _CHUNK):
        part = data[at : at + _CHUNK + WINDOW - 1]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTES[part] * _UP[: len(part)], out=sums[1:])
        grams = len(part) - GRAM + 1
        hashes = _mixed((sums[GRAM:] - sums[:grams]) * _DOWN[:grams])
        packed = (hashes & ~_MASK) | np.arange(grams, dtype=np.uint64)
        span, windows = WINDOW - GRAM + 1, len(part) - WINDOW + 1
        padded = np.full(-(-grams // span) * span, ~np.uint64(0))
        padded[:grams] = packed
        blocks = padded.reshape(-1, span)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        own = (np.minimum(back[:windows], ahead[span - 1 : span - 1 + windows]) & _MASK).astype(np.int64)
        first = np.r_[0, np.flatnonzero(own[1:] != own[:-1]) + 1]
        last = np.r_[first[1:] - 1, windows - 1]
        place = own[first]
        found.append((hashes[place].view(np.int64), place + at, first + at, last + at))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else tuple(np.empty(0, np.int64) for _ in range(4))


# -- deep-shallow sorting ------------------------------------------------------


def shallow_sort(words: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort of all groups at once: (order, tie).

    ``words`` has a row of sort words for each string.  Each turn splits every
    open segment by a pivot into less, equal and greater; only the equal part
    goes on to the next word.  Strings with equal ``tie`` agree in all words.
    """
    n, depth_end = words.shape
    order = np.argsort(group, kind="stable")
    segment = np.cumsum(np.r_[0, np.diff(group[order]) != 0]) if n else np.empty(0, np.int64)
    depth = np.zeros(n, np.int64)
    while True:
        size = np.bincount(segment, minlength=segment[-1] + 1 if n else 0)
        open_ = np.flatnonzero((size[segment] > 1) & (depth < depth_end)) if n else np.empty(0, np.int64)
        if not len(open_):
            return order, segment
        start = np.r_[0, np.cumsum(size)[:-1]]
        seg = segment[open_]
        word = words[order[open_], depth[open_]]
        middle = start[seg] + size[seg] // 2
        pivot = words[order[middle], depth[middle]]
        side = (word > pivot).astype(np.int64) + (word >= pivot)  # 0 less, 1 equal, 2 greater
        to = np.argsort(seg * 3 + side, kind="stable")
        order[open_] = order[open_][to]
        side = side[to]
        depth[open_] = depth[open_] + (side == 1)
        key = segment * 3
        key[open_] += side
        segment = np.cumsum(np.r_[0, np.diff(key) != 0])


class BlindTrie:
    """A trie that keeps only branching symbols; one comparison with a leaf places a string."""

    def __init__(self, symbols: np.ndarray):
        self.symbols = symbols
        self.root = None

    def insert(self, i: int) -> None:
        row = self.symbols[i]
        if self.root is None:
            self.root = [i]
            return
        node = self.root
        while type(node) is tuple:  # down to some leaf, looking at branching symbols only
            depth, to = node
            node = to.get(row[depth]) or next(iter(to.values()))
        differ = row != self.symbols[node[0]]
        at = int(differ.argmax())
        if not differ[at]:
            node.append(i)
            return
        above, edge, here = None, None, self.root
        while type(here) is tuple and here[0] < at:
            above, edge = here, row[here[0]]
            here = here[1][edge]
        if type(here) is tuple and here[0] == at:
            here[1][row[at]] = [i]
            return
        split = (at, {self.symbols[node[0]][at]: here, row[at]: [i]})
        if above is None:
            self.root = split
        else:
            above[1][edge] = split

    def in_order(self) -> list[int]:
        out, todo = [], [self.root]
        while todo:
            node = todo.pop()
            if type(node) is list:
                out += node
            elif node is not None:
                todo += [node[1][c] for c in sorted(node[1], reverse=True)]
        return out


def deep_shallow(symbols: np.ndarray, sizes: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp): rows by group, then content; lcp with the row before, -1 for a group's first.

    A row holds its string as symbols from 1, then zeros.
    """
    width = -(-symbols.shape[1] // 4) * 4
    padded = np.zeros((len(symbols), width), ">u2")
    padded[:, : symbols.shape[1]] = symbols
    words = padded.view(">u8").astype(np.uint64)[:, : SHALLOW // 4]
    order, tie = shallow_sort(words, group)
    size = np.bincount(tie) if len(tie) else np.empty(0, np.int64)
    at = 0
    for n in size:
        if n > 1:
            trie = BlindTrie(symbols)
            for i in order[at : at + n]:
                trie.insert(int(i))
            order[at : at + n] = trie.in_order()
        at += n
    lcp = np.full(len(order), -1, np.int64)
    for a in range(1, len(order), 4096):
        x, y = order[a - 1 : a + 4095], order[a : a + 4096]
        x = x[: len(y)]
        differ = symbols[x] != symbols[y]
        where = differ.argmax(axis=1)
        same = ~differ[np.arange(len(y)), where]
        lcp[a : a + len(y)] = np.where(group[x] != group[y], -1, np.where(same, sizes[y], where))
    return order, lcp


def _symbols(strings: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    out = np.zeros((len(strings), width), np.uint16)
    flat = np.frombuffer(b"".join(strings), np.uint8).astype(np.uint16) + np.uint16(1)
    out[np.arange(width) < sizes[:, None]] = flat
    return out, sizes


def repeated_offsets(group: np.ndarray, left: list[bytes], right: list[bytes]) -> np.ndarray:
    """(string, offset) is true if the window at that offset is in another string of the group.

    String i has windows at offsets WINDOW - len(right) to len(left) from its anchor.
    """
    n, most = len(group), WINDOW - GRAM
    low = WINDOW - np.fromiter(map(len, right), np.int64, n)
    high = np.fromiter(map(len, left), np.int64, n)
    order_r, lcp_r = deep_shallow(*_symbols(right, WINDOW), group)
    order_l, lcp_l = deep_shallow(*_symbols([x[::-1] for x in left], max(1, most)), group)
    out = np.zeros((n, most + 1), bool)
    class_r, class_l = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(most + 1):
        own = np.flatnonzero((low <= o) & (o <= high))
        if len(own) < 2:
            continue
        class_r[order_r] = np.cumsum(lcp_r < WINDOW - o)
        class_l[order_l] = np.cumsum(lcp_l < o)
        _, which, count = np.unique(class_r[own] * (n + 1) + class_l[own], return_inverse=True, return_counts=True)
        out[own[count[which] > 1], o] = True
    return out


def _runs(repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last) of the runs of true values in each row."""
    edge = np.diff(np.pad(repeated.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, first = np.nonzero(edge == 1)
    return row, first, np.nonzero(edge == -1)[1] - 1


# -- the Spark side ------------------------------------------------------------

_RANGES = "doc_id long, row long, start int, end int"


def _bodies(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    rows = text_of(docs, id_col, text_col)
    return rows.select("doc_id", F.xxhash64("text").alias("row"), F.col("text").cast("binary").alias("body"), *more)


class _Filter:
    """A Bloom filter of 64-bit hashes, of the same size for any input, so it may be broadcast.

    The more keys it has, the more others it lets pass: an exact join follows wherever it is used.
    """

    def __init__(self, keys: DataFrame):
        """``keys``: longs in a column ``key``, whose bits are those of a hash."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits: dict[int, np.ndarray] = {}
            for batch in batches:
                places = _Filter.places(batch.column(0).to_numpy())
                for s in np.unique(places[0] // _SEGMENT).tolist():
                    own = places[:, places[0] // _SEGMENT == s] - s * _SEGMENT
                    bits.setdefault(s, np.zeros(_SEGMENT, bool))[own.ravel()] = True
            for s, own in bits.items():
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([zlib.compress(np.packbits(own).tobytes(), 1)])], ["segment", "body"])

        segments = keys.select("key").repartition(F.col("key").bitwiseAND((1 << _SEGMENT_BITS) - 1)).mapInArrow(run, "segment int, body binary")
        self.shipped = keys.sparkSession.sparkContext.broadcast([(r.segment, bytes(r.body)) for r in segments.collect()])  # FILTER_BITS at most

    @staticmethod
    def places(keys: np.ndarray) -> np.ndarray:
        """Two bits for each key, both in the segment that its last bits name (an anchor's first bits are low)."""
        keys = keys.view(np.uint64)
        within = np.stack([keys >> np.uint64(_SEGMENT_BITS), keys >> np.uint64(28)]) & np.uint64(_SEGMENT - 1)
        return ((keys & np.uint64((1 << _SEGMENT_BITS) - 1)) * np.uint64(_SEGMENT) + within).astype(np.int64)

    def tester(self):
        """On an executor: a function that says which keys may be among those of the filter."""
        bits = np.zeros(FILTER_BITS // 8, np.uint8)
        for s, body in self.shipped.value:
            bits[s * _SEGMENT // 8 : (s + 1) * _SEGMENT // 8] = np.frombuffer(zlib.decompress(body), np.uint8)

        def test(keys: np.ndarray) -> np.ndarray:
            at = _Filter.places(keys)
            return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).all(axis=0)

        return test

    def column(self, key: str) -> Column:
        @F.pandas_udf("boolean")
        def held(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            test = self.tester()
            for keys in batches:
                yield pd.Series(test(keys.to_numpy(np.int64)), dtype=bool)

        return held(F.col(key))


def _arrays(batch: pa.RecordBatch, column: str) -> Iterator[np.ndarray]:
    values = batch.column(batch.schema.names.index(column))
    for x in values:
        yield np.frombuffer(x.as_buffer(), np.uint8)


def _repeated_grams(bodies: DataFrame) -> DataFrame:
    """(key): hashes of the anchors' grams that occur more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [anchors(x)[0] for x in _arrays(batch, "body")]
            key, n = np.unique(np.concatenate(found) if found else np.empty(0, np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n.astype(np.int64))], ["key", "n"])

    seen = bodies.select("body").mapInArrow(run, "key long, n long")
    return stored(seen.groupBy("key").agg(F.sum("n").alias("n")).filter("n > 1").select("key"), "suffix-grams")


def _stretches(bodies: DataFrame, grams: _Filter) -> DataFrame:
    """Repeated anchors with the digest of the bytes that their windows cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = grams.tester()
        for batch in batches:
            out = []
            for k, data in enumerate(_arrays(batch, "body")):
                found = anchors(data)
                held = np.flatnonzero(test(found[0])) if len(found[0]) else []
                h, place, first, last = (x[held] for x in found)
                raw = data.tobytes() if len(h) else b""
                digest = b"".join(hashlib.blake2b(raw[a : b + WINDOW], digest_size=16).digest() for a, b in zip(first.tolist(), last.tolist(), strict=True))
                d = np.frombuffer(digest, np.int64).reshape(-1, 2)
                out.append((h, d[:, 0], d[:, 1], np.full(len(h), k), place, first, last))
            h, d1, d2, k, place, first, last = (np.concatenate(x) if out else np.empty(0, np.int64) for x in zip(*out, strict=True))
            at = pa.array(k)
            columns = [pa.array(h), pa.array(d1), pa.array(d2), batch.column(0).take(at), batch.column(1).take(at), *(pa.array(x.astype(np.int32)) for x in (place, first, last))]
            yield pa.RecordBatch.from_arrays(columns, ["h", "d1", "d2", "doc_id", "row", "place", "first", "last"])

    return stored(bodies.mapInArrow(run, "h long, d1 long, d2 long, doc_id long, row long, place int, first int, last int"), "suffix-stretches")


def _cut(classes: DataFrame, bodies: DataFrame) -> DataFrame:
    """Each class's bytes to the left and right of its anchor, taken from one document that has it."""
    wanted = classes.groupBy(F.col("doc_id").alias("id2"), F.col("row").alias("row2")).agg(F.collect_list(F.struct("h", "place", "first", "last", "alone")).alias("asked"))
    wanted = stored(wanted, "suffix-asked")
    near = bodies.filter(_Filter(wanted.select(F.col("row2").alias("key")).distinct()).column("row"))
    held = near.join(wanted, F.col("doc_id").eqNullSafe(F.col("id2")) & (F.col("row") == F.col("row2")))
    schema = pa.schema([("h", pa.int64()), ("doc_id", pa.int64()), ("row", pa.int64()), ("place", pa.int32()), ("alone", pa.bool_()), ("left", pa.binary()), ("right", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, row, body, asked in zip(*(batch.column(i) for i in range(4)), strict=True):
                raw = body.as_py()
                for x in asked.as_py():
                    rows.append((x["h"], doc_id.as_py(), row.as_py(), x["place"], x["alone"], raw[x["first"] : x["place"]], raw[x["place"] : x["last"] + WINDOW]))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)

    return held.select("doc_id", "row", "body", "asked").mapInArrow(run, "h long, doc_id long, row long, place int, alone boolean, left binary, right binary")


def _sorted_ranges(cut: DataFrame) -> DataFrame:
    """Ranges of classes whose windows repeat in another class of their anchor."""

    def solve(pdf: pd.DataFrame) -> pa.RecordBatch:
        repeated = repeated_offsets(pdf["h"].to_numpy(np.int64), pdf["left"].tolist(), pdf["right"].tolist())
        repeated &= pdf["alone"].to_numpy(bool)[:, None]
        row, low, high = _runs(repeated)
        place = pdf["place"].to_numpy(np.int64)[row]
        ids = pa.array(pdf["doc_id"].astype("Int64").iloc[row], pa.int64())
        return pa.RecordBatch.from_arrays([ids, pa.array(pdf["row"].to_numpy(np.int64)[row]), pa.array((place - high).astype(np.int32)), pa.array((place - low + WINDOW).astype(np.int32))], ["doc_id", "row", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pd.DataFrame] = []
        size = 0
        for batch in batches:  # sorted by h: a group ends where h changes
            pdf = batch.to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)
            held.append(pdf)
            size += len(pdf)
            if size < TOGETHER or not len(pdf):
                continue
            every = pd.concat(held, ignore_index=True)
            going = every["h"] == every["h"].iloc[-1]
            held, size = [every[going]], int(going.sum())
            if not going.all():
                yield solve(every[~going])
        if size:
            yield solve(pd.concat(held, ignore_index=True))

    spark = cut.sparkSession
    return cut.repartition(partitions(spark), "h").sortWithinPartitions("h").mapInArrow(run, _RANGES)


def _counted_ranges(cut: DataFrame) -> DataFrame:
    """The same for anchors with very many classes: each window is counted by its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                data = x["left"] + x["right"]
                starts = range(len(data) - WINDOW + 1)
                digests = np.frombuffer(b"".join(hashlib.blake2b(data[s : s + WINDOW], digest_size=16).digest() for s in starts), np.int64).reshape(-1, 2)
                n, at = len(starts), x["place"] - len(x["left"])
                same = [pa.array([x[c]] * n, t) for c, t in (("doc_id", pa.int64()), ("row", pa.int64()), ("alone", pa.bool_()))]
                yield pa.RecordBatch.from_arrays([pa.array(digests[:, 0]), pa.array(digests[:, 1]), *same, pa.array(np.arange(at, at + n, dtype=np.int32))], ["w1", "w2", "doc_id", "row", "alone", "start"])

    windows = stored(cut.select("left", "right", "place", "doc_id", "row", "alone").mapInArrow(run, "w1 long, w2 long, doc_id long, row long, alone boolean, start int"), "suffix-windows")
    often = windows.groupBy("w1", "w2").agg(F.count("*").alias("n")).filter("n > 1").select("w1", "w2")
    return windows.filter("alone").join(often, ["w1", "w2"]).select("doc_id", "row", "start", (F.col("start") + WINDOW).alias("end"))


def repeated_ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", large_group: int = LARGE_GROUP) -> DataFrame:
    """(doc_id, row, start, end): byte ranges that strings of WINDOW bytes that also start elsewhere cover.

    Ranges may overlap.  ``row`` is the hash of the text, which tells rows of one id apart.
    """
    bodies = _bodies(docs, id_col, text_col)
    stretches = _stretches(bodies, _Filter(_repeated_grams(bodies)))
    of = ["h", "d1", "d2"]
    some = [F.first(c).alias(c) for c in ("doc_id", "row", "place", "first", "last")]
    classes = stored(stretches.groupBy(*of).agg(F.count("*").alias("n"), *some), "suffix-classes")
    whole = stretches.join(classes.filter("n > 1").select(*of), of).select("doc_id", "row", F.col("first").alias("start"), (F.col("last") + WINDOW).alias("end"))
    mixed = classes.groupBy("h").agg(F.count("*").alias("classes"), F.min("n").alias("least")).filter("classes > 1 and least = 1")
    asked = classes.withColumn("alone", F.col("n") == 1).join(mixed.select("h", "classes"), "h")
    # a stage of its own: Spark can split a key that a third of the stretches share
    ranges = stored(whole, "suffix-whole")
    for part, solve in ((F.col("classes") <= large_group, _sorted_ranges), (F.col("classes") > large_group, _counted_ranges)):
        own = asked.filter(part)
        if not own.isEmpty():
            ranges = ranges.union(solve(_cut(own, bodies)))
    return stored(ranges, "suffix-ranges")


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_body: bool = False, large_group: int = LARGE_GROUP) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every whole text (and body, the bytes left).

    Each byte goes that a string of WINDOW bytes covers which also starts
    elsewhere, in the same document or another; overlaps count, and strings are
    judged on the input.  A null text is empty; texts below WINDOW bytes stay.
    Repeated rows are documents like others, so they remove each other's bytes.
    Texts of any length are read whole, in pieces that overlap; no rows for an empty
    table; other columns are not read, whatever their names.
    """
    ranges = repeated_ranges(docs, id_col, text_col, large_group)
    gone = stored(ranges.groupBy(F.col("doc_id").alias("id2"), F.col("row").alias("row2")).agg(F.collect_list(F.struct("start", "end")).alias("gone")), "suffix-gone")
    rows = text_of(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("row"), F.col("text").cast("binary").alias("body"))
    rows = rows.withColumn("touched", _Filter(gone.select(F.col("row2").alias("key")).distinct()).column("row"))
    zero = F.lit(0).cast("long")
    body = [F.col("body")] if with_body else []
    clean = rows.filter("not touched").select("doc_id", F.octet_length("body").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2("body", 256).alias("kept_sha256"), *body)
    held = rows.filter("touched").select("doc_id", "row", "body").join(gone, F.col("doc_id").eqNullSafe(F.col("id2")) & (F.col("row") == F.col("row2")), "left")
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), *([("body", pa.binary())] if with_body else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, gone in zip(*(batch.column(i) for i in range(3)), strict=True):
                raw, spans = text.as_py(), []
                for x in sorted(gone.as_py() or [], key=lambda x: x["start"]):
                    if spans and x["start"] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], x["end"])
                    else:
                        spans.append([x["start"], x["end"]])
                edges = [0, *(e for s in spans for e in s), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                out.append((doc_id.as_py(), len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), *([kept] if with_body else [])))
            columns = list(zip(*out, strict=True)) if out else [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)

    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", body binary" * with_body
    return clean.union(held.select("doc_id", "body", "gone").mapInArrow(run, ddl))
