"""Fill-in-middle: texts cut at token ends into prefix, middle and suffix, and written in a new order.

A text is a big integer with one bit a byte.  ``bytes.translate`` makes the class
masks, shifted boolean operations mark the byte that ends each token,
``bit_count`` counts tokens and code points, and recursive halving finds the bit
of a given rank.  So a text costs a few passes over its bits and no Python loop
over its tokens.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.common import WHITE, text_of

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Percent of texts that are cut, and of those the percent written suffix first.
CUT_PERCENT, SUFFIX_FIRST_PERCENT = 50, 80
#: UTF-8 text of a task's rows that is cut at a time.
BATCH_BYTES = 32 << 20

_ASCII_WHITE = WHITE.encode()
#: "1" for each byte that is no white space, and for each byte that begins a code point.
_WORD = bytes(48 if b in _ASCII_WHITE else 49 for b in range(256))
_LEAD = bytes(48 if 0x80 <= b < 0xC0 else 49 for b in range(256))
_SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary"


def class_mask(text: bytes, table: bytes) -> int:
    """Bit i is set if ``table`` has "1" for byte i."""
    return int(text.translate(table)[::-1] or b"0", 2)


def token_ends(text: bytes) -> int:
    """Bit i is set if a token ends with byte i.

    A token is a word with the white space before it; white space at the end of
    the text is a token of its own.
    """
    words = class_mask(text, _WORD)
    ends = words & ~(words >> 1)
    return ends | 1 << len(text) - 1 if text and text[-1] in _ASCII_WHITE else ends


def select(bits: int, rank: int) -> int:
    """Place of the set bit with ``rank - 1`` set bits below it; each step halves the bits."""
    place, width = 0, bits.bit_length()
    while width > 1:
        half = width >> 1
        low = bits & (1 << half) - 1
        if rank <= (below := low.bit_count()):
            bits, width = low, half
        else:
            bits, width, rank, place = bits >> half, width - half, rank - below, place + half
    return place


def _after(ends: int, tokens: int) -> int:
    """Bytes in the first ``tokens`` tokens."""
    return select(ends, tokens) + 1 if tokens else 0


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four 32-bit numbers of a document, whatever task asks."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4)]


def transformed(doc_id: int | None, text: bytes, seed: int) -> tuple[int, str, int | None, int | None, bytes]:
    """(tokens, form, code points of prefix, of middle, output) of one text."""
    ends = token_ends(text)
    n = ends.bit_count()
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or h3 % 100 >= CUT_PERCENT or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    low, high = (_after(ends, k) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    leads = class_mask(text, _LEAD)
    before, both = ((leads & (1 << cut) - 1).bit_count() for cut in (low, high))
    prefix, middle, suffix = text[:low], text[low:high], text[high:]
    if h4 % 100 < SUFFIX_FIRST_PERCENT:
        return n, "spm", before, both - before, b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return n, "psm", before, both - before, b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def fill_in_middle(docs: DataFrame, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): each row's text in its form.

    n counts tokens.  ``plain`` texts stay as they are: empty ones, those that hold a
    mark, and those whose id's hash says so.  Others are written with marks as
    prefix, suffix, middle (``psm``) or suffix, prefix, middle (``spm``).  Id and
    seed alone decide, so a task that runs again gives the same.

    A null text is empty and a null id hashes as an empty one; repeated rows give
    equal rows; texts of any length are cut whole; no rows for an empty table;
    other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                whole = text.as_py()
                rows.append((doc_id, *transformed(doc_id, whole, seed)))
                held += len(whole)
                if held >= BATCH_BYTES:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)

    whole = text_of(docs, id_col, text_col).select("doc_id", F.col("text").cast("binary").alias("text"))
    return whole.mapInArrow(run, _SCHEMA).withColumn("output", F.col("output").cast("string"))


_TYPES = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [field.split()[0] for field in _SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names)


def restored(output: Column, form: Column) -> Column:
    """The text that ``fill_in_middle`` was given.  Texts that are cut hold no marks, so those of the output are its own."""
    parts = F.split(output, "<[PSM]>")
    part = lambda i: F.coalesce(F.get(parts, F.lit(i)), F.lit(""))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)


def round_trip(docs: DataFrame, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``fill_in_middle`` with the digests of each output and of the text restored from it."""
    made = fill_in_middle(docs, seed, id_col, text_col)
    back = restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))
