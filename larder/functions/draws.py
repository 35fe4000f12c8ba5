"""One sequence of random numbers that many tasks draw, each its own stretch.

The sequence is the one that ``numpy.random.default_rng(seed)`` gives to a single
program: PCG64's 64-bit words, halves of words for small bounded integers, and
bounded integers by multiplication, where a few halves are refused.  A task jumps
to its stretch (``advance``).  Where that begins depends on the halves refused
before it, so those are counted stretch by stretch and added up.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larder.functions.ordered import numbered
from larder.functions.stored import settled

#: Halves of words that one task makes at a time, and rows whose draws it makes together.
STRETCH, ROWS = 1 << 18, 4096
_HALF = np.uint64(0xFFFFFFFF)


def words(seed: int, first: int, n: int) -> np.ndarray:
    """``n`` 64-bit words of the sequence from number ``first`` on."""
    made = np.random.PCG64(seed)
    made.advance(first)
    return made.random_raw(n)


def halves(seed: int, first: int, n: int, shift: int = 0) -> np.ndarray:
    """``n`` 32-bit halves from number ``first`` on, low halves first; ``shift`` words went elsewhere before them."""
    pairs = words(seed, first // 2 + shift, (first + n + 1) // 2 - first // 2)
    both = np.empty(2 * len(pairs), np.uint64)
    both[0::2], both[1::2] = pairs & _HALF, pairs >> np.uint64(32)
    return both[first % 2 : first % 2 + n]


def unit(word: np.ndarray | int) -> np.ndarray | float:
    """Words as numbers from 0 to 1."""
    return (np.uint64(word) >> np.uint64(11)) * 2.0**-53


def _bounded(half: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(value, refused) of each half for its bound, from 1 to 2^32 - 1."""
    product = half * bound
    return (product >> np.uint64(32)).astype(np.int64), (product & _HALF) < (np.uint64(1 << 32) - bound) % bound


def stretch(seed: int, first: int, bounds: np.ndarray, scenario: int = 0, begins: int = 0) -> tuple[np.ndarray, int]:
    """(values, halves refused): one draw below each bound, from half ``first`` on.

    Each scenario takes one whole word before its draws; ``begins`` is its first
    half, which belongs to the word before that one if it is odd.
    """
    bounds = bounds.astype(np.uint64)
    values, wanted, refused, at = np.empty(len(bounds), np.int64), 0, 0, first
    while wanted < len(bounds):
        n = len(bounds) - wanted
        half = halves(seed, at, n, scenario)
        if at == begins and at % 2 and scenario:
            half[0] = halves(seed, at, 1, scenario - 1)[0]
        value, bad = _bounded(half, bounds[wanted:])
        good = int(np.argmax(bad)) if bad.any() else n
        values[wanted : wanted + good] = value[:good]
        wanted, refused, at = wanted + good, refused + (good < n), at + good + (good < n)
    return values, refused


def resampled(spark: SparkSession, n: int, draws: int, seed: int, size: int = STRETCH) -> DataFrame:
    """(draw, at): row by row ``default_rng(seed).integers(0, n, size=n)``, ``draws`` times; for 1 <= n < 2^32.

    All bounds are the same, so whether a half is refused needs no other half: a first
    pass counts the refused ones, a second makes the rows.
    """
    if not 0 < n < 1 << 32:
        raise ValueError("a draw takes from 1 to 2^32 - 1 places")
    if n == 1:
        return spark.range(draws).select(F.col("id").cast("int").alias("draw"), F.lit(0).cast("long").alias("at"))
    share = ((1 << 32) - n) % n / 2**32
    total = draws * n
    count = math.ceil((total / (1 - share) + 12 * math.sqrt(total * share + 1)) / size) if total else 0
    bound = np.uint64(n)

    def made(first: int) -> tuple[np.ndarray, np.ndarray]:
        return _bounded(halves(seed, first * size, size), bound)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([int(made(i)[1].sum()) for i in ids], pa.int64())], ["id", "refused"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, before in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                value, bad = made(i)
                number = i * size - before + np.arange(len(bad)) - np.cumsum(bad)
                kept = ~bad & (number < total)
                yield pa.RecordBatch.from_arrays([pa.array((number[kept] // n).astype(np.int32)), pa.array(value[kept])], ["draw", "at"])

    stretches = spark.range(count)
    if share:
        each = settled(stretches.mapInArrow(counted, "id long, refused long"))
        before = Window.orderBy("id").rowsBetween(Window.unboundedPreceding, -1)  # one row a stretch
        stretches = each.select("id", F.coalesce(F.sum("refused").over(before), F.lit(0)).alias("before")).repartition("id")
        if count * size - each.agg(F.coalesce(F.sum("refused"), F.lit(0))).first()[0] < total:
            raise RuntimeError("more draws were refused than can be expected")
    else:
        stretches = stretches.withColumn("before", F.lit(0).cast("long"))
    return stretches.mapInArrow(rows, "draw int, at long")


def scenario_draws(items: DataFrame, key: str, scenarios: int, seed: int, rows: int = ROWS) -> tuple[DataFrame, np.ndarray]:
    """Draws of a loop over scenarios and, within each, over items in order of ``key``.

    ``items`` has key, bound (from 1 to 2^32 - 1) and n: each scenario draws one
    number from 0 to 1, then ``n`` integers below ``bound`` for each item; a bound
    of 1 draws nothing and gives zeros.  Returns (key, drawn array<array<long>>: by
    scenario) and the scenarios' numbers from 0 to 1.

    A stretch is a block of items in a scenario.  Halves refused in one shift all
    later ones: stretches are drawn with the shifts known so far, until no further
    one is found.  A half is refused once in 2^32 / bound times, so one round does
    for all but very long sequences; the counts are a row for each stretch with any.
    """
    spark = items.sparkSession
    draws = F.when(F.col("bound") > 1, F.col("n")).otherwise(0).cast("long")
    placed = settled(numbered(items.select(key, "bound", "n", draws.alias("draws")), [F.col(key)], "_number").withColumn("block", F.floor((F.col("_number") - 1) / rows)))
    blocks = placed.groupBy("block").agg(F.sum("draws").alias("size"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    blocks = blocks.select("block", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"))
    each = int(placed.agg(F.coalesce(F.sum("draws"), F.lit(0))).first()[0])
    kind = dict(placed.dtypes)[key]
    known: dict[tuple[int, int], int] = {}
    dealt = placed.join(blocks, "block")
    for _ in range(2 + scenarios * max(1, blocks.count())):
        shifts = _shifts(known, scenarios)
        made = settled(dealt.groupBy("block").applyInArrow(_drawer(key, scenarios, seed, each, shifts), f"{key} {kind}, drawn array<array<long>>, block long, refused array<struct<s:int,n:long>>"))
        found = {(r.s, r.block): r.n for r in made.filter(F.size("refused") > 0).select("block", F.inline("refused").alias("s", "n")).collect()}
        if found == known:
            starts = [s * each + shifts(s, 0)[0] for s in range(scenarios)]
            return made.select(key, "drawn"), np.array([unit(words(seed, s + (at + 1) // 2, 1)[0]) for s, at in enumerate(starts)])
        known = found
    raise RuntimeError("the refused draws did not settle")


def _drawer(key: str, scenarios: int, seed: int, each: int, shifts: Callable[[int, int], tuple[int, int]]) -> Callable[..., pa.Table]:
    """Draws a block's items in every scenario; ``each`` is the number of draws of a scenario."""

    def draw(group: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("_number")
        block, first = int(group[0].as_py()), int(table["before"][0].as_py())
        n, bound = table["n"].to_numpy().astype(np.int64), table["bound"].to_numpy().astype(np.int64)
        bounds = np.repeat(bound, np.where(bound > 1, n, 0))
        out, refused = np.zeros((scenarios, int(n.sum())), np.int64), []
        drawn = np.repeat(bound > 1, n)
        for s in range(scenarios):
            start, here = shifts(s, block)
            out[s, drawn], bad = stretch(seed, s * each + first + start + here, bounds, s + 1, s * each + start)
            refused += [{"s": s, "n": bad}] * (bad > 0)
        ends = np.r_[0, np.cumsum(n)]
        lists = [out[:, a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)]
        told = [refused] + [[] for _ in lists[1:]]
        return pa.table({key: table[key], "drawn": pa.array(lists, pa.list_(pa.list_(pa.int64()))), "block": pa.array([block] * len(lists), pa.int64()), "refused": pa.array(told, pa.list_(pa.struct([("s", pa.int32()), ("n", pa.int64())])))})

    return draw


def _shifts(known: dict[tuple[int, int], int], scenarios: int) -> Callable[[int, int], tuple[int, int]]:
    """(halves refused in earlier scenarios, and in earlier blocks of this one) for a scenario and block."""
    by_scenario = np.zeros(scenarios + 1, np.int64)
    for (s, _), n in known.items():
        by_scenario[s + 1] += n
    before = np.cumsum(by_scenario)
    return lambda s, block: (int(before[s]), sum(n for (t, b), n in known.items() if t == s and b < block))
