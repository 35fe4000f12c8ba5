"""SimHash near-dedup with BK-trees.

Fingerprints within ``radius`` bits agree in at least one of radius + 1 bands,
so each distinct fingerprint enters one shard for each band.  A task that owns a
shard builds its BK-tree (children keyed by the Hamming distance to the parent)
and follows, for each query, only edges within the radius.  An overfull shard is
cut again by bands of the bits that are left, so no task holds more than a set
number of values; nothing that grows with the corpus is broadcast to all.  Tasks
return spanning links, never all pairs.

``near_groups`` links texts by the exact Jaccard similarity of their shingles.
There shards are keyed by bands of MinHashes and hold the sets themselves; trees
are asked at a wide radius, and each proposed link is checked where it arises.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.common import stored, text_of
from larder.llm.components import components

SHINGLE_WORDS = 3
RADIUS = 3
#: Values of a shard beyond which it is cut again by bands of its other bits.
SHARD_VALUES = 50_000
#: Queries that go down trees together, which bounds the frontier.
TOGETHER = 2048
#: Values whose shards' trees are built together (a larger shard has a forest of its own).
FOREST_VALUES = 32_768

#: Shingles and Jaccard similarity of near-duplicates.
NEAR_WORDS = 5
NEAR_SIMILARITY = 0.8
#: MinHashes of a band, and bands: of pairs at 0.8, by computation 26 in a million share no band.
BAND_HASHES = 4
BANDS = 20
#: Pairs at 0.8 differ, by computation, in 9.7 bits on average with a deviation of 2.9; in sf0.1 in 14 at most.
NEAR_RADIUS = 22
#: Pairs of a query and a value that a task holds at once.
PAIRS_TOGETHER = 1 << 22
#: Shingles that are looked up at once.
GRAMS_TOGETHER = 1 << 22
#: Shingles of the sets that one part of a shard holds; larger shards have several parts.
PART_GRAMS = 2_000_000
#: Bands that are worked off together: what they join is left out of later ones.
BAND_ROUNDS = ((0, 4), (4, 10), (10, BANDS))
#: Rows of a shard that ask in a task's first turn, and the growth of that number by turn.
FIRST_ASKING = 1
MORE_ASKING = 8


def shingle_hashes(text: bytes, words: int = SHINGLE_WORDS) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of a UTF-8 text, repeats included.

    Bytes know ASCII alone, so A-Z are lowered and words are parted as stated.
    Fewer words than ``words`` make one shingle; no words make none.
    """
    w = text.lower().split()
    runs = zip(*(w[i:] for i in range(words)), strict=False) if len(w) > words else [w] * bool(w)
    return np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, runs), repeat(42)), np.uint64)


def majority_bits(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half of the hashes."""
    count = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 32768):
        part = hashes[at : at + 32768].astype(">u8").view(np.uint8).reshape(-1, 8)
        count += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id and fp (long) of every whole text; texts without words have fp 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [majority_bits(shingle_hashes(text.as_py(), words)) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.int64())], ["doc_id", "fp"])

    rows = text_of(docs, id_col, text_col)
    return rows.select("doc_id", F.col("text").cast("binary").alias("body")).mapInArrow(run, "doc_id long, fp long")


class BKTree:
    """BK-trees over distinct 64-bit values under Hamming distance, held in arrays.

    ``root`` has for each value the number of its tree's root; without it, all
    values are one tree.  All values descend together: at each node the first
    one left for an edge becomes that edge's child, the others go on below it.
    """

    def __init__(self, values: np.ndarray, root: np.ndarray | None = None):
        self.values = values
        node = np.zeros(len(values), np.int64) if root is None else root.copy()
        left = np.flatnonzero(node != np.arange(len(values)))
        parents, edges, children = [], [], []
        while len(left):
            d = np.bitwise_count(values[left] ^ values[node[left]]).astype(np.int64)
            key = node[left] * 65 + d
            order = np.argsort(key, kind="stable")
            key, left = key[order], left[order]
            first = np.r_[True, key[1:] != key[:-1]]
            child = left[first][np.cumsum(first) - 1]
            parents.append(key[first] // 65)
            edges.append(key[first] % 65)
            children.append(left[first])
            node[left] = child
            left = left[~first]
        self.key = np.concatenate(parents) * 65 + np.concatenate(edges) if parents else np.empty(0, np.int64)
        self.child = np.concatenate(children) if children else np.empty(0, np.int64)
        order = np.argsort(self.key)
        self.key, self.child = self.key[order], self.child[order]

    def within(self, queries: np.ndarray, radius: int, root: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query number, node) for all nodes within ``radius``, level by level; ``root`` names each query's tree."""
        q, node = np.arange(len(queries)), np.zeros(len(queries), np.int64) if root is None else root
        while len(q):
            d = np.bitwise_count(queries[q] ^ self.values[node]).astype(np.int64)
            near = d <= radius
            if near.any():
                yield q[near], node[near]
            low = np.searchsorted(self.key, node * 65 + np.maximum(d - radius, 0))
            high = np.searchsorted(self.key, node * 65 + np.minimum(d + radius, 64), "right")
            width = high - low
            q = np.repeat(q, width)
            at = np.arange(len(q)) - np.repeat(np.cumsum(width) - width, width) + np.repeat(low, width)
            node = self.child[at]


def _roots(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the ends of each link in ``label``, a forest that points at least members."""
    while True:
        ra, rb = label[a], label[b]
        apart = ra != rb
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
        while (up := label[label]).tobytes() != label.tobytes():
            label[:] = up


def spanning_links(values: np.ndarray, root: np.ndarray, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the components which the queries' neighbours make of ``values``.

    ``queries`` are numbers of values; each asks the tree of its own shard, whose
    first value ``root`` names.  At most one link for each value.
    """
    tree, label = BKTree(values, root), np.arange(len(values))
    for at in range(0, len(queries), TOGETHER):
        part = queries[at : at + TOGETHER]
        for q, node in tree.within(values[part], radius, root[part]):
            _roots(label, part[q], node)
    moved = np.flatnonzero(label != np.arange(len(values)))
    return moved, label[moved]


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest id reachable).

    Fingerprints link at ``radius`` or fewer differing bits; equal ones are one
    node, so copies cost nothing.  A null or empty text has fingerprint zero and
    links like any other.  Repeated rows repeat their result.  A null id never
    names a component unless all its members are null.  Texts of any length are
    read whole; no rows for an empty table; other columns are not read.
    """
    prints = stored(fingerprints(docs, id_col, text_col, words), "simhash-prints")
    classes = _named(prints, "fp", components(_links(prints.select("fp").distinct(), radius)))
    return prints.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _named(prints: DataFrame, key: str, found: DataFrame) -> DataFrame:
    """(key, component_id) of each ``key`` of ``prints``, by the components ``found`` of linked keys."""
    nodes = prints.groupBy(key).agg(F.min("doc_id").alias("first"))
    # components are named by keys; what they are called must be an id
    named = nodes.join(found.withColumnRenamed("node", key), key, "left").withColumn("component", F.coalesce("component", key))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    return named.join(least, "component").select(key, "component_id")


def _cut_shards(rows: DataFrame, bits: int, radius: int) -> tuple[DataFrame, int]:
    """Each row (fp, shard, rest) once for each of radius + 1 bands of the low ``bits`` bits of ``rest``.

    ``shard`` names the bands cut so far by a hash; ``rest`` closes up over the
    band, so it keeps the bits not used yet, whose number is returned too.
    """
    cuts = [bits * i // (radius + 1) for i in range(radius + 2)]

    def piece(i: int, low: int, high: int) -> Column:
        value = F.shiftright(F.shiftleft("rest", 64 - high), 64 - high + low) if high > low else F.lit(0).cast("long")
        below = F.col("rest").bitwiseAND(F.lit((1 << low) - 1))
        above = F.shiftleft(F.shiftrightunsigned("rest", high), low) if high < 64 else F.lit(0).cast("long")
        return F.struct(F.xxhash64("shard", F.lit(i), value).alias("shard"), above.bitwiseOR(below).alias("rest"))

    every = F.array(*[piece(i, *x) for i, x in enumerate(zip(cuts, cuts[1:], strict=False))])
    return rows.select("fp", F.explode(every).alias("s")).select("fp", "s.shard", "s.rest"), bits - bits // (radius + 1)


def _links(nodes: DataFrame, radius: int) -> DataFrame:
    """Spanning links (a, b) between distinct fingerprints, from all shards."""

    def solve(rows: np.ndarray) -> pa.RecordBatch:
        """``rows``: whole shards; columns fp, shard."""
        new = np.r_[True, rows[1, 1:] != rows[1, :-1]]
        root = np.maximum.accumulate(np.where(new, np.arange(rows.shape[1]), 0))
        a, b = spanning_links(rows[0].view(np.uint64), root, np.arange(rows.shape[1]), radius)
        return pa.RecordBatch.from_arrays([pa.array(rows[0, a]), pa.array(rows[0, b])], ["a", "b"])

    links, bits = None, 64
    rows = nodes.select("fp", F.lit(0).cast("long").alias("shard"), F.col("fp").alias("rest"))
    while True:
        cut, bits = _cut_shards(rows, bits, radius)
        held = cut.groupBy("shard").agg(F.count("*").alias("n")).filter("n > 1")
        owned = stored(cut.join(held, "shard"), "simhash-shards")
        # as many values as the bits left can tell apart are no more than a task may hold
        last = 1 << bits <= SHARD_VALUES or bits <= radius
        fit = owned if last else owned.filter(F.col("n") <= SHARD_VALUES)
        dealt = fit.select("fp", "shard").repartition("shard").sortWithinPartitions("shard", "fp")
        found = dealt.mapInArrow(partial(_whole_shards, solve), "a long, b long")
        links = found if links is None else links.union(found)
        rows = owned.filter(F.col("n") > SHARD_VALUES).select("fp", "shard", "rest")
        if last or rows.isEmpty():
            return links


def _whole_shards(solve: Callable[[np.ndarray], pa.RecordBatch], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``solve`` of columns fp, shard, as long columns of whole shards."""
    held, size = [], 0
    for batch in batches:  # sorted by shard: one ends where its key changes
        held.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]))
        size += batch.num_rows
        if size < FOREST_VALUES:
            continue
        rows = np.concatenate(held, axis=1)
        last = np.flatnonzero(rows[1] != rows[1, -1])
        whole = last[-1] + 1 if len(last) else 0
        held, size = [rows[:, whole:]], rows.shape[1] - whole
        if whole:
            yield solve(np.ascontiguousarray(rows[:, :whole]))
    if size:
        yield solve(np.ascontiguousarray(np.concatenate(held, axis=1)))


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    g = np.random.default_rng(42)
    return g.integers(0, 2**64, BANDS * BAND_HASHES, np.uint64), g.integers(0, 2**64, BANDS * BAND_HASHES, np.uint64) | np.uint64(1)


def band_keys(grams: np.ndarray) -> list[int]:
    """A key (long) for each band of MinHashes of a set of shingle hashes; none for an empty set."""
    if not len(grams):
        return []
    mask, factor = _multipliers()
    least = np.full(BANDS * BAND_HASHES, np.iinfo(np.uint64).max)
    for at in range(0, len(grams), 1024):
        least = np.minimum(least, ((grams[None, at : at + 1024] ^ mask[:, None]) * factor[:, None]).min(axis=1))
    return [xxhash.xxh64_intdigest(band.tobytes(), 42) - 2**63 for band in least.reshape(BANDS, BAND_HASHES)]


def near_prints(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """doc_id, body (a hash of the text), node (a hash of its set of shingles), fp and size of that set, and keys by band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(text.as_py(), words)) for text in batch.column(2)]
            nodes = [xxhash.xxh64_intdigest(grams.tobytes(), 42) - 2**63 for grams in sets]
            out = [pa.array(nodes, pa.int64()), pa.array(map(majority_bits, sets), pa.int64()), pa.array(map(len, sets), pa.int64()), pa.array(map(band_keys, sets), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *out], ["doc_id", "body", "node", "fp", "size", "keys"])

    rows = text_of(docs, id_col, text_col)
    return rows.select("doc_id", F.xxhash64("text").alias("body"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, body long, node long, fp long, size long, keys array<long>")


def near_links(new: np.ndarray, fp: np.ndarray, label: np.ndarray, offsets: np.ndarray, grams: np.ndarray, radius: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links (label, label) that join all rows of a shard whose sets are similar.

    Rows are whole shards, each begun by ``new``, in the order of ``fp``; row i's set is the sorted
    ``grams[offsets[i]:offsets[i + 1]]``.  Rows of one label are joined already.
    Only rows outside their shard's largest component ask: every pair of rows of
    different components has one of them.  Few ask at first, so that components
    grow before the rest asks, and near misses cost look-ups but no output.
    """
    n, shard = len(fp), np.cumsum(new) - 1
    names, at = np.unique(label, return_inverse=True)
    forest = np.arange(len(names))
    # rows of one shard with equal fingerprints are one value of the tree
    head = np.flatnonzero(new | np.r_[True, fp[1:] != fp[:-1]])
    length, value = np.diff(np.r_[head, n]), np.cumsum(np.isin(np.arange(n), head)) - 1
    values, root = fp[head].view(np.uint64), np.maximum.accumulate(np.where(new[head], np.arange(len(head)), 0))
    tree = BKTree(values, root)
    size = np.diff(offsets)
    known, gram = np.unique(grams, return_inverse=True)
    place = np.repeat(np.arange(n), size) * len(known) + gram  # sorted, as each row's grams are
    together = max(1, min(TOGETHER, PAIRS_TOGETHER // int(np.bincount(shard).max())))

    def similar(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the sets of rows a and b have that Jaccard similarity."""
        common = np.zeros(len(a), np.int64)
        cuts = np.flatnonzero(np.diff(np.cumsum(size[a]) // GRAMS_TOGETHER, prepend=-1))
        for low, high in zip(cuts, np.r_[cuts[1:], len(a)], strict=True):
            x, y = a[low:high], b[low:high]
            pair = np.repeat(np.arange(len(x)), size[x])
            asked = np.arange(len(pair)) - np.repeat(np.cumsum(size[x]) - size[x], size[x]) + np.repeat(offsets[x], size[x])
            wanted = y[pair] * len(known) + gram[asked]
            found = place[np.minimum(np.searchsorted(place, wanted), len(place) - 1)] == wanted
            common[low:high] = np.bincount(pair[found], minlength=len(x))
        return common / np.maximum(1, size[a] + size[b] - common) >= similarity

    asked, most = np.zeros(n, bool), FIRST_ASKING
    while True:
        now = forest[at]
        _, which, count = np.unique(shard * len(names) + now, return_inverse=True, return_counts=True)
        order = np.lexsort((-count[which], shard))  # each shard's row of the largest component comes first
        main = now[order[np.flatnonzero(np.r_[True, np.diff(shard[order]) != 0])]]
        ask = np.flatnonzero(~asked & (now != main[shard]))
        ask = ask[np.arange(len(ask)) - np.searchsorted(shard[ask], shard[ask]) < most]
        if not len(ask):
            moved = np.flatnonzero(forest != np.arange(len(names)))
            return names[moved], names[forest[moved]]
        for low in range(0, len(ask), together):
            part = ask[low : low + together]
            for q, node in tree.within(values[value[part]], radius, root[value[part]]):
                width = length[node]
                x = np.repeat(part[q], width)
                y = np.arange(len(x)) - np.repeat(np.cumsum(width) - width, width) + np.repeat(head[node], width)
                small, large = np.minimum(size[x], size[y]), np.maximum(size[x], size[y])
                apart = (forest[at[x]] != forest[at[y]]) & (small >= similarity * large)
                x, y = x[apart], y[apart]
                if len(x):
                    near = similar(x, y)
                    _roots(forest, at[x[near]], at[y[near]])
        asked[ask] = True
        most *= MORE_ASKING


_PART = ["band", "value", "part", "chunk"]


def _checked_links(rows: DataFrame, sets: DataFrame, radius: int, similarity: float) -> DataFrame:
    """Links (a, b) of labels from shard parts: rows (band, value, part, chunk, node, fp, label)."""

    def solve(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        fp, label, *key = (table.column(c).to_numpy() for c in ("fp", "label", *_PART))
        lists = table.column("grams").combine_chunks()
        offsets = lists.offsets.to_numpy().astype(np.int64)
        grams = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
        new = np.r_[True, np.any([k[1:] != k[:-1] for k in key], axis=0)]
        a, b = near_links(new, fp, label, offsets - offsets[0], grams, radius, similarity)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, grams = [], 0, 0
        for batch in batches:  # sorted by part: one ends where its key changes
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(batch.schema.names.index(c)).to_numpy() for c in _PART])
            last = np.flatnonzero((key != key[:, -1:]).any(axis=0))
            begins = int(last[-1]) + 1 if len(last) else 0
            if begins or (held and (key[:, -1] != going).any()):
                held.append(batch.slice(0, begins))
                rows, grams = rows + begins, grams + len(batch.column(batch.schema.names.index("grams")).slice(0, begins).flatten())
                if rows >= FOREST_VALUES or grams >= PART_GRAMS:
                    yield solve(held)
                    held, rows, grams = [], 0, 0
            going = key[:, -1]
            held.append(batch.slice(begins))
            rows, grams = rows + batch.num_rows - begins, grams + len(batch.column(batch.schema.names.index("grams")).slice(begins).flatten())
        if rows:
            yield solve(held)

    dealt = rows.join(sets, "node").repartition(*_PART).sortWithinPartitions(*_PART, "fp", "node")
    return dealt.select(*_PART, "fp", "label", "grams").mapInArrow(run, "a long, b long")


def _sets_of(wanted: DataFrame, docs: DataFrame, text_col: str, words: int) -> DataFrame:
    """(node, grams): the sorted sets of the nodes in ``wanted`` (node, body), each from one text that has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):  # sets of long texts leave one by one
                grams = np.unique(shingle_hashes(batch.column(1)[row].as_py(), words).view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, 1), pa.array([grams], pa.list_(pa.int64()))], ["node", "grams"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.xxhash64(text).alias("body"), text.cast("binary").alias("text")).join(wanted, "body").select("node", "text").dropDuplicates(["node"])
    return stored(texts.mapInArrow(run, "node long, grams array<long>"), "near-sets")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = NEAR_WORDS, similarity: float = NEAR_SIMILARITY, radius: int = NEAR_RADIUS) -> DataFrame:
    """doc_id and component_id (smallest id reachable) by the exact similarity of sets of shingles.

    Equal sets are one node; a null or empty text has the empty set.  Nodes that
    share a band of MinHashes meet in a shard, where a BK-tree proposes links and
    the sets decide.  Shards with the same nodes are one; those whose nodes an
    earlier round has joined are left out.  A shard beyond ``PART_GRAMS`` is dealt
    in parts at random; then all its nodes outside the largest component meet
    every part, so no pair goes unchecked and no task holds more than a part and
    a chunk of the others.  Repeated rows repeat their result, and a null id never
    names a component unless all its members are null; no rows for an empty table.
    """
    prints = stored(near_prints(docs, id_col, text_col, words), "near-prints")
    nodes = stored(prints.groupBy("node").agg(F.min("body").alias("body"), F.first("fp").alias("fp"), F.first("size").alias("size"), F.first("keys").alias("keys")), "near-nodes")
    sharded = nodes.select("node", "fp", "size", F.posexplode("keys").alias("band", "value"))
    held = sharded.groupBy("band", "value").agg(F.count("*").alias("n"), F.sum("size").alias("grams"), *[F.bit_xor(F.xxhash64(F.lit(k), "node")).alias(f"same{k}") for k in (1, 2)]).filter("n > 1")
    # of shards with the same nodes the one of the first band stays
    held = held.groupBy("n", "same1", "same2").agg(F.min(F.struct("band", "value", "grams")).alias("s")).select("s.band", "s.value", F.ceil(F.col("s.grams") / PART_GRAMS).cast("int").alias("parts"))
    members = sharded.join(held, ["band", "value"]).withColumn("part", F.pmod(F.xxhash64("node", "band"), F.col("parts")).cast("int"))
    members = stored(members.select("band", "value", "parts", "part", "node", "fp", "size"), "near-shards")
    sets = _sets_of(members.select("node").distinct().join(nodes.select("node", "body"), "node"), docs, text_col, words)
    links, labels = prints.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0), None
    for low, high in BAND_ROUNDS:
        rows = _open_shards(members.filter(F.col("band").between(low, high - 1)), labels)
        found = _checked_links(rows.withColumn("chunk", F.lit(0)), sets, radius, similarity)
        links = links.union(stored(found, "near-links"))
        labels = components(links)
    large = members.filter("parts > 1")
    if not large.isEmpty():
        rows = stored(_open_shards(large, labels), "near-open")
        found = _checked_links(_rest_with_parts(rows), sets, radius, similarity)
        labels = components(links.union(stored(found, "near-links")))
    return prints.join(_named(prints, "node", labels), "node").select("doc_id", "component_id")


def _open_shards(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The rows, with ``label`` (their component so far), of shards that aren't one component yet."""
    if labels is None:
        return members.withColumn("label", F.col("node"))
    labelled = members.join(labels, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
    apart = labelled.groupBy("band", "value").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high")
    return labelled.join(apart.select("band", "value"), ["band", "value"], "left_semi")


def _rest_with_parts(rows: DataFrame) -> DataFrame:
    """Each part of a shard with each chunk of the shard's nodes outside its largest component."""
    key = ["band", "value"]
    sizes = rows.groupBy(*key, "label").agg(F.count("*").alias("n"))
    main = sizes.groupBy(*key).agg(F.max(F.struct("n", "label")).alias("m")).select(*key, F.col("m.label").alias("main"))
    rest = rows.join(main, key).filter("label <> main")
    chunks = rest.groupBy(*key).agg(F.ceil(F.sum("size") / PART_GRAMS).cast("int").alias("chunks"))
    rest = rest.join(chunks, key).withColumn("chunk", F.pmod(F.xxhash64("node", F.lit("rest")), F.col("chunks")).cast("int"))
    rest = rest.select(*key, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "chunk", "node", "fp", "label")
    held = rows.join(chunks, key).select(*key, "part", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "node", "fp", "label")
    return held.union(rest).distinct()


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups: Callable[..., DataFrame] = simhash_groups) -> DataFrame:
    """The rows of ``docs``, all columns whatever their names, whose id names their component; rows of one id stay or go together."""
    groups = groups(docs, id_col, text_col)
    gone = groups.groupBy("doc_id").agg(F.max(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("names")).filter("not names")
    return docs.join(gone, docs[id_col].cast("long").eqNullSafe(gone["doc_id"]), "left_anti")
