"""Spelling variants: words one edit apart, and the common form that a rare word stands for.

A word within one edit of another keeps one of its halves as it is: the first at
its start or the second at its end.  Words are dealt to shards by their first and
by their last letters.  A shard's Aho-Corasick automaton holds the halves of its
words; all words dealt there are scanned, a hit must have the half's place and a
fitting length, and the rest of both words is compared.  No two words meet that
share no half, so pairs grow with the links and not with the vocabulary.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.common import LOWER, UPPER, partitions, stored, text_of

#: A maximal run of these is a word.
LETTERS = "A-Za-zÀ-ÿ"
#: Words of fewer letters or occurrences aren't compared.
LEAST_LETTERS, LEAST_COUNT = 7, 2
#: A form is at least so many times as common as its variant.
FORM_TIMES = 10
#: Letters by which words are dealt to shards: those of the half, but no more than the second number; halves are no shorter than the first.
ROUTE, MOST_ROUTE = 3, 6
#: Words whose halves one automaton holds; where more share a route, blocks of them meet each other.
SHARD_WORDS = 20_000
#: Different words that a task counts before it sends them on, and letters of a text that it cuts at a time.
COUNTED, PIECE = 200_000, 1 << 20
#: Words that are compared one by one; more are told apart by halves of what is left of them.
FEW = 12
#: Forms are at least ten times as common as their variants, so no chain of 64-bit counts has more.
MOST_ROUNDS = 6

_MARK = "\n"
_FOLD = str.maketrans(UPPER, LOWER)
_WORDS, _BREAK = re.compile(f"[{LETTERS}]+"), re.compile(f"[^{LETTERS}]")


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", read_as: Callable[[int | None, str], str] | None = None, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): the words of whole texts with A-Z lower-cased, and how often each occurs.

    ``read_as`` may change a word by its row's id, before letters are counted.  Tasks
    add up before anything moves, so a word in every text is a row for each task.
    Null texts have no words; texts of any length are cut between words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for word, n in _words_of(text.as_py()):
                    word = word.translate(_FOLD)
                    word = word if read_as is None else read_as(doc_id, word)
                    if len(word) >= least_letters:
                        found[word] += n
                if len(found) >= COUNTED:
                    yield _counts(found)
                    found.clear()
        if found:
            yield _counts(found)

    counted = text_of(docs, id_col, text_col).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def _words_of(text: str) -> Iterator[tuple[str, int]]:
    """(word, count) for each piece of a text; pieces end between words."""
    low = 0
    while low < len(text):
        end = _BREAK.search(text, low + PIECE)
        high = end.start() if end else len(text)
        yield from Counter(_WORDS.findall(text, low, high)).items()
        low = high


def _counts(found: Counter[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["word", "n"])


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one letter inserted, deleted or replaced makes one the other."""
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i, c in enumerate(a) if c != b[i]), len(a))
    if len(a) == len(b):
        return i < len(a) and a[i + 1 :] == b[i + 1 :]
    return len(a) + 1 == len(b) and a[i:] == b[i + 1 :]


class Halves:
    """Words of one length that agree in their first ``left`` and last ``right`` letters.

    Few are compared one by one; of more, those are that keep a half of the letters
    between, and so on, so a word is held against few that aren't near it.
    """

    def __init__(self, words: list[str], left: int, right: int):
        self.words, self.left, self.right, self.size = words, left, right, len(words[0])
        self.parts: tuple[dict[str, Halves], dict[str, Halves]] | None = None
        self.cut = left + (self.size - left - right) // 2

    def _split(self) -> tuple[dict[str, Halves], dict[str, Halves]]:
        heads, tails = defaultdict(list), defaultdict(list)
        for w in self.words:
            heads[w[self.left : self.cut]].append(w)
            tails[w[self.cut : self.size - self.right]].append(w)
        self.parts = {k: Halves(v, self.cut, self.right) for k, v in heads.items()}, {k: Halves(v, self.left, self.size - self.cut) for k, v in tails.items()}
        return self.parts

    def near(self, x: str) -> Iterator[str]:
        """Those one edit from ``x``, once each; ``x`` agrees with them where they agree."""
        end = len(x) - self.right
        if len(self.words) <= FEW or self.size - self.left - self.right < 2:
            rest, high = x[self.left : end], self.size - self.right
            for w in self.words:
                if one_edit(w[self.left : high], rest):
                    yield w
            return
        heads, tails = self.parts or self._split()
        head = x[self.left : self.cut]
        if head in heads:
            yield from heads[head].near(x)
        if same := tails.get(x[end - (self.size - self.right - self.cut) : end]):
            for w in same.near(x):
                if w[self.left : self.cut] != head:  # else found by its head
                    yield w


def automaton_of(words: Iterator[str], last: bool) -> ahocorasick.Automaton:
    """The first or last halves of the words; a mark holds a half to its end of a word."""
    groups: dict[str, dict[int, list[str]]] = defaultdict(lambda: defaultdict(list))
    for w in words:
        half = len(w) // 2
        groups[w[half:] + _MARK if last else _MARK + w[:half]][len(w)].append(w)
    made = ahocorasick.Automaton()
    for key, sizes in groups.items():
        made.add_word(key, {n: Halves(own, 0, n - n // 2) if last else Halves(own, n // 2, 0) for n, own in sizes.items()})
    if groups:
        made.make_automaton()
    return made


def near_words(x: str, automaton: ahocorasick.Automaton, last: bool, route: int) -> Iterator[str]:
    """Words of the automaton one edit from ``x`` that are dealt by ``route`` letters.  Those that keep their first half too are left to the other end."""
    for _, sizes in automaton.iter(x + _MARK if last else _MARK + x):
        for n in (len(x) - 1, len(x), len(x) + 1):
            if (own := sizes.get(n)) and min(n - n // 2 if last else n // 2, MOST_ROUTE) == route:
                for w in own.near(x):
                    if not last or w[: n // 2] != x[: n // 2]:
                        yield w


_NEAR = "word string, n_near long, less long, near string"


def _shard(table: pa.Table) -> pa.Table:
    """For each word of a shard that is near any: how many, and the commonest (of equals the first by code point)."""
    rows = table.to_pydict()
    out = []
    for last in (False, True):
        own = [k for k, x in enumerate(rows["last"]) if x == last]
        count = {rows["word"][k]: rows["n"][k] for k in own if rows["held"][k]}
        if not count:
            continue
        automaton = automaton_of(iter(count), last)
        for k in own:
            if rows["scanned"][k]:
                x = rows["word"][k]
                if near := [(-count[w], w) for w in near_words(x, automaton, last, rows["letters"][k])]:
                    out.append((x, len(near), *min(near)))
    types = (pa.string(), pa.int64(), pa.int64(), pa.string())
    columns = zip(*out, strict=True) if out else [[]] * 4
    return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[f.split()[0] for f in _NEAR.split(", ")])


def near_table(counts: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(word, n_near, less, near) for each word of the stored table ``counts`` that is near any; ``less`` is -n of ``near``.

    Words lie where the letters of their halves lead, and are scanned where those of
    words a letter shorter or longer would: two places at each end at most.  A route
    with more than ``shard_words`` rows is cut into blocks by hash, and each
    block's automaton meets each block, so no task holds a hot route.
    """
    spark, size = counts.sparkSession, F.length("word")
    half = lambda n, last: F.least(n - F.floor(n / 2) if last else F.floor(n / 2), F.lit(MOST_ROUTE)).cast("int")

    def places(last: bool) -> Column:
        met = F.filter(F.array_distinct(F.array(*[half(size + d, last) for d in (-1, 0, 1)])), lambda k: k >= ROUTE)
        route = lambda k: F.substring("word", size - k + 1 if last else F.lit(1), k)
        return F.transform(met, lambda k: F.struct(F.lit(last).alias("last"), k.alias("letters"), route(k).alias("route"), (k == half(size, last)).alias("held")))

    rows = counts.withColumn("e", F.explode(F.concat(places(False), places(True)))).select("word", "n", "e.*")
    on = ["last", "letters", "route"]
    full = stored(rows.groupBy(*on).count().filter(F.col("count") > shard_words).select(*on, F.ceil(F.col("count") / shard_words).alias("blocks")), "spelling-routes")
    shards = max(4 * partitions(spark), math.ceil(2 * counts.count() / shard_words))
    rows = rows.join(full, on, "left").withColumn("own", F.pmod(F.xxhash64("word"), F.col("blocks")))
    cell = lambda shard, held, scanned: F.struct(shard.alias("shard"), held.alias("held"), F.lit(scanned).alias("scanned"))
    single = F.array(cell(F.pmod(F.xxhash64("last", "route"), F.lit(shards)), F.col("held"), True))
    blocks = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    scans = F.transform(blocks, lambda j: cell(F.xxhash64(*on, j, F.col("own")), F.col("held") & (j == F.col("own")), True))
    others = F.filter(blocks, lambda j: F.col("held") & (j != F.col("own")))
    holds = F.transform(others, lambda j: cell(F.xxhash64(*on, F.col("own"), j), F.lit(True), False))
    dealt = rows.withColumn("c", F.explode(F.when(F.col("blocks").isNull(), single).otherwise(F.concat(scans, holds))))
    found = dealt.select("c.shard", "last", "letters", "word", "n", "c.held", "c.scanned").groupBy("shard").applyInArrow(_shard, _NEAR)
    best = F.min(F.struct("less", "near")).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", "best.less", "best.near")


def spelling_groups(counts: DataFrame, times: int = FORM_TIMES, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each row of ``counts`` (word, n).

    n_near counts the words one edit away.  The form is the commonest of them (of
    equals the first by code point) if it occurs at least ``times`` as often, else
    null; the root is where forms lead, the word itself without one.

    Words must differ and have at least six letters, so that halves reach a route;
    others of any alphabet and length are compared alike.  Null words are left out,
    a null n counts as 0; no rows for an empty table; other columns are not read.
    """
    if times < 2:
        raise ValueError("a form must be at least twice as common, or chains could be long")
    short = F.raise_error(F.concat(F.lit("too short to be halved: "), F.col("word"))).cast("string")
    words = counts.filter(F.col("word").isNotNull()).select(F.when(F.length("word") >= 2 * ROUTE, F.col("word")).otherwise(short).alias("word"), F.coalesce(F.col("n").cast("long"), F.lit(0).cast("long")).alias("n"))
    words = stored(words, "spelling-words")
    near = near_table(words, shard_words)
    common = -F.col("less") >= times * F.col("n")
    out = stored(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(common, F.col("near")).alias("form"), F.when(common, -F.col("less")).alias("form_n")), "spelling-forms")
    roots = _roots(out.filter("form is not null").select("word", F.col("form").alias("root")))
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): each round doubles the steps that every word has gone, until none goes further."""
    for _ in range(MOST_ROUNDS):
        onward = forms.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = stored(forms.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        forms = moved.drop("moved")
        if moved.filter("moved").isEmpty():
            return forms
    raise RuntimeError("chains of forms did not end")
