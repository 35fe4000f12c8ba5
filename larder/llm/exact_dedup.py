"""Exact dedup by an extendible-hash index kept in shared files.

Texts are keyed by a 64-bit hash of their normal form.  Texts are dealt by the
directory's leading hash bits to the tasks that own those key ranges; there the
texts of one hash are chained, and the bytes decide whether a text is the link
before it again or a new one.  Each link counts its copies and knows the row that
stays.  A bucket with more than ``capacity`` entries is split by its next bit, and
the directory doubles with it.  Only DataFrame functions run here.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import WHITE, stored, text_of

#: Entries that a bucket of the index may hold before it is split.
CAPACITY = 512
#: Copies of a text that may reach its owner: as many are combined apart before.
SALTS = 16

_TWO64 = "18446744073709551616"
_TOP = "9223372036854775807"


def normalised(text: Column) -> Column:
    """The text without its white space."""
    return F.translate(text, WHITE, "")


def _best(chars: Column, doc_id: Column) -> Column:
    """One number that is largest for the longest text, then for the smallest id.

    As a number it can be pre-aggregated in place before the shuffle.
    """
    return chars.cast("decimal(11,0)") * F.lit(_TWO64).cast("decimal(20,0)") - F.coalesce(doc_id, F.lit(int(_TOP))).cast("decimal(20,0)")


def _best_id() -> Column:
    """The id in the column ``best``."""
    rest = F.expr(f"pmod(best + cast({_TOP} as decimal(20,0)), cast({_TWO64} as decimal(20,0)))")
    return (F.lit(_TOP).cast("decimal(20,0)") - rest).cast("long")


def _hashed(text: Column, hash_bits: int) -> Column:
    """The leading ``hash_bits`` bits of the 64-bit hash, left-aligned."""
    h = F.xxhash64(text)
    return h if hash_bits == 64 else F.shiftleft(F.shiftrightunsigned(h, 64 - hash_bits), 64 - hash_bits)


def _prefix(h: Column, depth: int) -> Column:
    return F.shiftrightunsigned(h, 64 - depth)


def _first_depth(n: int, capacity: int, hash_bits: int) -> int:
    """Leading bits under which ``n`` entries fill half of each bucket on average."""
    return min(hash_bits, max(1, math.ceil(math.log2(max(1, 2 * n / capacity)))))


def split_buckets(entries: DataFrame, depth: int, capacity: int = CAPACITY, hash_bits: int = 64) -> DataFrame:
    """``entries`` with their bucket and its depth: ``bucket`` has the bucket's ``depth`` leading bits, left-aligned.

    Buckets start at ``depth``.  Only those that are overfull are read again and
    split by their next bit, until none is or the hash bits are used up; the rest
    of a bucket is then its chains.
    """
    done, held = None, entries
    while True:
        sized = held.withColumn("bucket", F.shiftleft(_prefix(F.col("h"), depth), 64 - depth))
        placed = stored(sized.join(sized.groupBy("bucket").agg(F.count("*").alias("held")), "bucket"), "exact-buckets")
        full = (F.col("held") > capacity) if depth < hash_bits else F.lit(False)
        fit = placed.filter(~full).withColumn("depth", F.lit(depth)).drop("held")
        done = fit if done is None else done.unionByName(fit)
        held = placed.filter(full).drop("bucket", "held")
        if depth == hash_bits or held.isEmpty():
            return done
        depth += 1


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, hash_bits: int = 64) -> DataFrame:
    """One row for each distinct normal form: bucket, depth, h, chain, sha, group_size, keep_id.

    Copies are combined in each task before they move, so of a text that a third
    of the rows share at most ``SALTS`` copies reach its owner.  The owner sorts
    the texts of a hash and compares each with the one before: ``chain`` numbers
    the links, and size and keeper are taken from the rows of a link.
    """
    rows = text_of(docs, id_col, text_col)
    rows = rows.select(normalised(F.col("text")).alias("body"), _best(F.length("text"), F.col("doc_id")).alias("best"))
    rows = rows.withColumns({"h": _hashed(F.col("body"), hash_bits), "salt": F.pmod(F.xxhash64("best"), F.lit(SALTS))})
    combined = rows.groupBy("h", "body", "salt").agg(F.count("*").alias("n"), F.max("best").alias("best"))
    depth = _first_depth(docs.count(), capacity, hash_bits)
    dealt = combined.withColumn("owner", _prefix(F.col("h"), depth)).repartition("owner")
    chain = Window.partitionBy("owner", "h").orderBy("body")
    new = ~F.coalesce(F.col("body") == F.lag("body").over(chain), F.lit(False))
    links = dealt.withColumn("new", new.cast("int")).withColumn("chain", F.sum("new").over(chain.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    links = links.select("owner", "h", "chain", "n", "best", F.when(F.col("new") == 1, F.sha2(F.encode("body", "utf-8"), 256)).alias("sha"))
    link = Window.partitionBy("owner", "h", "chain")
    entries = links.withColumns({"group_size": F.sum("n").over(link), "best": F.max("best").over(link)}).filter("sha is not null")
    entries = stored(entries.select("h", "chain", "sha", "group_size", _best_id().alias("keep_id")), "exact-entries")
    placed = split_buckets(entries, depth, capacity, hash_bits)
    return stored(placed.repartitionByRange("bucket", "h").sortWithinPartitions("bucket", "h", "chain"), "exact-index")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, hash_bits: int = 64) -> DataFrame:
    """Each row with its group of equal texts and whether it stays.

    Texts are equal when they are identical without white space; null counts as
    empty, and all empty texts are one group.  The longest original text stays
    (code points), then the smallest id; a null id is the largest.  Repeated
    rows each get a row and count in ``group_size``; those that repeat the id of
    the row that stays are ``kept`` too.  Texts of any length are compared whole.
    An empty table gives no rows.  Other columns are not read, whatever their names.
    """
    index = build_index(docs, id_col, text_col, capacity, hash_bits).select("h", "sha", "group_size", "keep_id")
    body = normalised(F.col("text"))
    keyed = text_of(docs, id_col, text_col).select("doc_id", _hashed(body, hash_bits).alias("h"), F.sha2(F.encode(body, "utf-8"), 256).alias("sha"))
    found = keyed.join(index, ["h", "sha"])
    own = F.when(F.col("keep_id") == int(_TOP), None).otherwise(F.col("keep_id"))
    return found.select("doc_id", own.alias("keep_id"), F.col("group_size").cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(own).alias("kept"), F.col("sha").alias("text_sha256"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, that stay; rows that repeat one that stays do too.

    Rows are told apart by id and text, so rows of one id may part.
    """
    gone = exact_dedup(docs, id_col, text_col, **options).filter("not kept").select("doc_id", "text_sha256").distinct()
    sha = F.sha2(F.encode(normalised(F.coalesce(docs[text_col], F.lit(""))), "utf-8"), 256)
    return docs.join(gone, docs[id_col].cast("long").eqNullSafe(gone["doc_id"]) & (sha == gone["text_sha256"]), "left_anti")
