"""Benchmark decontamination by pigeonhole edit matching.

A test item with an error budget of k edits is cut into k + 1 pieces: within the
budget, at least one piece survives unchanged.  One pass over a text finds all
piece hits, and Myers' bit-parallel distance verifies the passage around each.
Short items have no budget: they are found where they stand as whole words.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm.common import text_of

#: Edits that a copy may have, as a share of the item's letters.
ERROR_RATE = 0.07
#: Items with fewer letters and digits in their normal form must match exactly, as whole words.
MIN_LETTERS = 40
#: Bytes of items that are broadcast at once; more are worked off in blocks.  The pieces of so many take 130 MB of a worker.
BLOCK_BYTES = 2_000_000

_WORD = re.compile(r"[^\W_]+")


def normal(text: str) -> str:
    """Words of letters and digits in lower case, with one space between."""
    return " ".join(_WORD.findall(text.lower()))


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """The item in budget + 1 runs of nearly equal length, each with its offset."""
    n = budget + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers_search(pattern_bits: dict[str, int], m: int, text: str, budget: int) -> tuple[int, int]:
    """(least distance, end) of the pattern anywhere in ``text``, by Myers' bit vectors.

    ``pattern_bits`` has, for each letter, the bits of its places.  Without a
    match within the budget the distance is budget + 1.
    """
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best, end = (m, 0) if m <= budget else (budget + 1, -1)
    get = pattern_bits.get
    for at, letter in enumerate(text):
        x = get(letter, 0) | down
        diag = (((x & up) + up) ^ up) | x
        over = down | ~(diag | up)
        under = up & diag
        if over & top:
            score += 1
        elif under & top:
            score -= 1
        over, under = over << 1, under << 1
        up = (under | ~(diag | over)) & full
        down = over & diag & full
        if score < best:
            best, end = score, at + 1
    return best, end


class Matcher:
    """All pieces of a block of items in one automaton."""

    def __init__(self, items: list[tuple[int | None, str]], error_rate: float, min_letters: int = MIN_LETTERS):
        self.items = []
        hits: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            budget = int(len(text) * error_rate)
            if len(text.replace(" ", "")) < min_letters:
                text, budget = f" {text} ", 0
            bits: dict[str, int] = {}
            for i, letter in enumerate(text):
                bits[letter] = bits.get(letter, 0) | 1 << i
            for offset, piece in pieces(text, budget):
                hits.setdefault(piece, []).append((len(self.items), offset))
            self.items.append((item_id, text, budget, bits))
        self.automaton = ahocorasick.Automaton()
        for piece, places in hits.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item id, distance, start, end) in the normal form: the best passage for each item found."""
        text = f" {text} "
        asked: dict[tuple[int, int], None] = {}
        for end, (size, places) in self.automaton.iter(text):
            for number, offset in places:
                budget = self.items[number][2]
                # hits of a copy lie within the budget of one diagonal; each diagonal band is tried once
                asked[number, (end + 1 - size - offset) // (budget + 1)] = None
        best: dict[int, tuple[int, int, int]] = {}
        for number, band in asked:
            item_id, item, budget, bits = self.items[number]
            start = max(0, band * (budget + 1) - budget)
            window = text[start : (band + 1) * (budget + 1) + len(item) + budget]
            distance, stop = myers_search(bits, len(item), window, budget)
            if distance <= budget and (number not in best or distance < best[number][0]):
                blank = item[0] == " "  # those around a short item don't count
                best[number] = (distance, max(0, start + stop - len(item) - distance - 1 + blank), min(start + stop - 1 - blank, len(text) - 2))
        found: dict[int | None, tuple[int, int, int]] = {}
        for number, x in best.items():
            item_id = self.items[number][0]
            if item_id not in found or x[0] < found[item_id][0]:
                found[item_id] = x
        return [(i, *x) for i, x in found.items()]


def _blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int | None, str]]]:
    """The benchmark's items in normal form, in blocks of BLOCK_BYTES at most."""
    held, size = [], 0
    for row in items.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).toLocalIterator():
        text = normal(row.t)
        if not text:
            continue
        if held and size + len(text) > BLOCK_BYTES:
            yield held
            held, size = [], 0
        held.append((row.i, text))
        size += len(text)
    if held:
        yield held


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", error_rate: float = ERROR_RATE, min_letters: int = MIN_LETTERS) -> DataFrame:
    """doc_id, item_id, distance, start, end: each item that a document holds.

    Texts are compared in normal form (words of letters and digits, lower case,
    single spaces); start and end are places there, start that of the longest
    passage that can have the distance.  ``error_rate`` of an item's length,
    rounded down, is its budget of edits; items of fewer than ``min_letters``
    letters and digits must be there as they stand, as whole words.  Items without
    letters or digits hold nothing to look for.  Items of one id (or none) are one
    item in several forms: the best match counts.  Null texts are empty; repeated
    rows repeat their result; texts of any length are searched whole; no items or
    documents give no rows.  Other columns are not read.  Items are a stated query
    set: they go to all documents in blocks of bounded size.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, distance int, start int, end int"
    rows = text_of(docs, id_col, text_col)
    found = spark.createDataFrame([], schema)
    for block in _blocks(items, item_id_col, item_text_col):
        found = found.union(rows.mapInArrow(_searcher(spark, block, error_rate, min_letters), schema))
    return found


_matchers: dict[str, Matcher] = {}


def _matcher(key: str, shipped, error_rate: float, min_letters: int) -> Matcher:
    """The worker's matcher of a block of items; made once in each worker."""
    if key not in _matchers:
        _matchers.clear()
        _matchers[key] = Matcher(shipped.value, error_rate, min_letters)
    return _matchers[key]


def _searcher(spark: SparkSession, block: list[tuple[int | None, str]], error_rate: float, min_letters: int):
    shipped, key = spark.sparkContext.broadcast(block), uuid.uuid4().hex
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(key, shipped, error_rate, min_letters)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                out += [(doc_id, *x) for x in matcher.find(normal(text.as_py()))]
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)

    return run


def without_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item; rows of one id stay or go together."""
    leaked = find_leaks(docs, items, id_col, text_col, **options).select("doc_id").distinct()
    return docs.join(leaked, docs[id_col].cast("long").eqNullSafe(leaked["doc_id"]), "left_anti")
