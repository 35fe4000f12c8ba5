"""Byte-level BPE encoding and decoding with two tiers.

A minimal perfect hash over the vocabulary resolves every pre-token that is
itself a token; the others are merged by a heap over linked bytes.  Work is
done in Arrow batches inside Spark tasks; the vocabulary (about 1 MB, a file of
fixed size) is read once on the driver and broadcast.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import text_of

#: Bytes, as estimated, of pre-tokens and ids that a worker remembers: half of it before it starts afresh, and half from before.
CACHE_BYTES = 64_000_000
_ENTRY_BYTES = 300


class PerfectHash:
    """Minimal perfect hash by hash-and-displace.

    Keys fall into buckets.  Large buckets come first: each takes the first seed
    under which its keys land on free places; a bucket of one key then simply
    names a place that is left (kept as a negative number).
    """

    def __init__(self, keys: list[bytes], load: int = 2):
        self.n, self.buckets = len(keys), max(1, len(keys) // load)
        owned: dict[int, list[int]] = {}
        for k in keys:
            base = xxhash.xxh3_64_intdigest(k)
            owned.setdefault(base % self.buckets, []).append(base)
        self.seeds = [0] * self.buckets
        taken = bytearray(self.n)
        singles = [b for b, own in owned.items() if len(own) == 1]
        for b in sorted((b for b, own in owned.items() if len(own) > 1), key=lambda b: -len(owned[b])):
            if len(set(own := owned[b])) < len(own):
                raise ValueError("keys of the vocabulary must differ")
            seed = 0
            while len(set(places := [self._place(x, seed) for x in own])) < len(own) or any(map(taken.__getitem__, places)):
                seed += 1
            self.seeds[b] = seed
            for p in places:
                taken[p] = 1
        left = (p for p in range(self.n) if not taken[p])
        for b, p in zip(singles, left, strict=False):
            self.seeds[b] = -1 - p

    def _place(self, base: int, seed: int) -> int:
        if seed < 0:
            return -1 - seed
        x = (base ^ (seed * 0x9E3779B97F4A7C15)) & 0xFFFFFFFFFFFFFFFF
        x = ((x ^ (x >> 32)) * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF
        return (x ^ (x >> 29)) % self.n

    def __call__(self, key: bytes) -> int:
        """The key's place, from 0 to n - 1; any place for strangers."""
        base = xxhash.xxh3_64_intdigest(key)
        return self._place(base, self.seeds[base % self.buckets])


class Codec:
    """A vocabulary of byte strings by rank, as encoder and decoder."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, perfect: PerfectHash | None = None):
        self.ranks = ranks
        self.split = regex.compile(pattern)
        self.hash = perfect or PerfectHash(list(ranks))
        self.at: list[tuple[bytes, int]] = [(b"", -1)] * len(ranks)
        for k, rank in ranks.items():
            self.at[self.hash(k)] = (k, rank)
        self.bytes_of = {i: k for k, i in ranks.items()}
        self.digits = {i: str(i) for i in self.bytes_of}
        self.cache: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.held = 0

    def token(self, piece: str) -> tuple[int, ...]:
        raw = piece.encode()
        key, rank = self.at[self.hash(raw)]
        return (rank,) if key == raw else tuple(self.merged(raw))

    def merged(self, raw: bytes) -> list[int]:
        """Merge the leftmost pair of lowest rank until none is in the vocabulary.

        ``after[i]`` is where the part that starts at i ends, 0 once that part
        is swallowed.  An entry of the heap is one number: rank, start, size.
        """
        get, n = self.ranks.get, len(raw)
        bits = n.bit_length()
        mask = (1 << bits) - 1
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [((r << bits | i) << bits) | 2 for i in range(n - 1) if (r := get(raw[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            entry = heapq.heappop(heap)
            i = entry >> bits & mask
            j = after[i]
            if not j or j >= n or (k := after[j]) - i != entry & mask:
                continue  # one side has been merged since
            after[i], after[j] = k, 0
            if k < n:
                before[k] = i
                if (r := get(raw[i : after[k]])) is not None:
                    heapq.heappush(heap, ((r << bits | i) << bits) | after[k] - i)
            if i and (r := get(raw[(h := before[i]) : k])) is not None:
                heapq.heappush(heap, ((r << bits | h) << bits) | k - h)
        ids, i = [], 0
        while i < n:
            ids.append(self.ranks[raw[i : after[i]]])
            i = after[i]
        return ids

    def encode(self, text: str) -> list[int]:
        """The text's ids.  What was used since the cache was last full outlives its next turn, so common pre-tokens are merged once."""
        cache, older, pieces = self.cache, self.older, self.split.findall(text)
        for p in set(pieces).difference(cache):
            cache[p] = own = older.pop(p, None) or self.token(p)
            self.held += _ENTRY_BYTES + len(p) + 8 * len(own)
        ids = list(chain.from_iterable(map(cache.__getitem__, pieces)))
        if self.held > CACHE_BYTES // 2:
            self.cache, self.older, self.held = {}, cache, 0
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def read_ranks(path: str) -> dict[bytes, int]:
    """The byte strings and ranks of a rank file: a base64 string and a rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(k): int(v) for k, v in map(bytes.split, lines)}


_codecs: dict[str, Codec] = {}


def _codec(shipped) -> Codec:
    """The worker's codec for a broadcast vocabulary; made once in each worker."""
    ranks, pattern, perfect, key = shipped.value
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(ranks, pattern, perfect)
    return _codecs[key]


def _shipped(docs: DataFrame, rank_file: str, pattern: str):
    ranks = read_ranks(rank_file)
    key = hashlib.sha256(repr((sorted(ranks.items()), pattern)).encode()).hexdigest()
    return docs.sparkSession.sparkContext.broadcast((ranks, pattern, PerfectHash(list(ranks)), key))


def encode_documents(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and token_ids (array<int>) of every whole text; null texts are empty and have no ids."""
    shipped = _shipped(docs, rank_file, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shipped)
        for batch in batches:
            for row in range(batch.num_rows):  # a batch may hold long texts, so results leave one by one
                ids = codec.encode(batch.column(1)[row].as_py())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, 1), pa.array([ids], pa.list_(pa.int32()))], ["doc_id", "token_ids"])

    return text_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, token_ids array<int>")


def decode_documents(tokens: DataFrame, rank_file: str, pattern: str = "", id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """doc_id and body (binary): the bytes that the ids stand for; null lists are empty."""
    shipped = _shipped(tokens, rank_file, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shipped)
        for batch in batches:
            bodies = [codec.decode(ids.as_py() or []) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bodies, pa.binary())], ["doc_id", "body"])

    return tokens.select(F.col(id_col).cast("long").alias("doc_id"), ids_col).mapInArrow(run, "doc_id long, body binary")


def round_trip(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: each text encoded, and its ids decoded again.

    Digests of ids and bytes are made where they arise, so neither leaves its
    task.  A null or empty text has no tokens.  Repeated rows repeat their result;
    texts of any length are encoded whole; no rows for an empty table; other columns
    are not read, whatever their names.
    """
    shipped = _shipped(docs, rank_file, pattern)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shipped)
        for batch in batches:
            n, made, decoded = [], [], []
            for text in batch.column(1):
                ids = codec.encode(text.as_py())
                n.append(len(ids))
                made.append(hashlib.sha256(" ".join(map(codec.digits.__getitem__, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(made), pa.array(decoded)], schema=schema)

    return text_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
