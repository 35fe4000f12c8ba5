"""Information-theoretic sanitisation of personal data, with SQL functions alone.

Base patterns find protected entities (mail and network addresses, card and
phone numbers).  Terms near an entity are counted with it over the corpus.  A term
discloses an entity if it leaves little doubt about it, in bits, and if both meet in
more different contexts than chance explains over all pairs of the corpus; so one
meeting, or copies of one passage, show nothing at any size.  Evidence is counted
for the value itself and for its group (mail domain, network, leading digits).  A
disclosing term is generalised to the longest prefix that isn't, or removed where
none is, wherever it stands: beside a value or not.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.common import stored, text_of

KINDS = ("email", "ip", "card", "phone")
#: Bits of doubt about an entity that a term must leave: with less, it discloses the entity.
DOUBT = 1.0
#: Different contexts of an entity that must hold a term.
CONTEXTS = 2
#: Pairs of the whole corpus that may look as close by chance.
CHANCE = 0.05
#: Documents that are thought to be added to those with a term, of which chance alone would give the entity's share.
PRIOR = 1
#: Characters on each side of an entity that count as near, across line ends.
CONTEXT = 80
#: Texts are cut into pieces of so many characters, so that a context is found without reading from the start.
PIECE = 1024
#: Elements that are added up together when offsets are made.
_SUMMED = 64
#: Letters that a term may be generalised to.
PREFIXES = (3, 1)
#: Shortest term, in letters.
MIN_LETTERS = 3

#: Possessive forms of the base patterns: they match the same spans, in linear time.
#: A mail address may start where the last one ended, but never inside a run that has failed.
_LOCAL = "[A-Za-z0-9._%+-]"
_PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A cheap test that every text with a match passes.
_HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9][ -]?[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_OPEN, _SHUT, _BLANK = "\x01", "\x02", "\x03"


def _valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return value.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    if kind == "phone":
        return n.between(9, 15)
    back = F.reverse(digits)
    twice = lambda i: F.substring(back, i, F.lit(1)).cast("int") * (F.lit(2) - i % 2)  # noqa: E731  every second digit from the right
    luhn = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + twice(i) - F.when(twice(i) > 9, 9).otherwise(0))
    return F.when(n.between(13, 19), luhn % 10 == 0).otherwise(F.lit(False))


def _named(value: Column, of) -> Column:
    """The array ``of(value)``, where ``value`` is worked out once however often ``of`` names it."""
    return F.flatten(F.transform(F.array(value), of))


def _sum(sizes: Column, first: Column, n: Column) -> Column:
    return F.aggregate(F.slice(sizes, first, n), F.lit(0), lambda s, x: s + x)


def _offsets(sizes: Column) -> Column:
    """What comes before each element: sums of blocks are added up first, so long arrays take no square of their length."""
    part = F.lit(_SUMMED)

    def of(z: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(z) - 1) / part).cast("int")), lambda b: _sum(z, b * part + 1, part))
        heads = _named(blocks, lambda q: F.transform(q, lambda _, b: _sum(q, F.lit(1), b)))
        within = lambda base, b: _named(F.slice(z, b * part + 1, part), lambda own: F.transform(own, lambda _, i: base + _sum(own, F.lit(1), i)))
        return F.flatten(F.transform(heads, within))

    return _named(sizes, of)


def _spans(text: Column, kind: str) -> Column:
    """Array of (kind, start, end, value) of a kind's valid matches in ``text``.

    The matches are put between two marks that the text doesn't have; the text
    cut at the marks then alternates between what is outside and inside.
    """

    def cut(parts: Column) -> Column:
        def of(starts: Column) -> Column:
            def span(i: Column) -> Column:
                start, value = F.get(starts, i * 2 - 1), F.get(parts, i * 2 - 1)
                return F.struct(F.lit(KINDS.index(kind)).alias("kind"), start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"))

            return F.transform(F.sequence(F.lit(1), F.floor(F.size(parts) / 2).cast("int")), span)

        return F.filter(_named(_offsets(F.transform(parts, lambda p: F.length(p))), of), lambda s: _valid(kind, s["value"]))

    none = F.array().cast("array<struct<kind:int,start:int,end:int,value:string>>")
    held = _named(_parts(text, kind), lambda p: F.when(F.size(p) > 1, cut(p)).otherwise(none))
    return F.when(text.rlike(_HINTS[kind]), held).otherwise(none)


def _parts(text: Column, kind: str) -> Column:
    return F.split(F.regexp_replace(text, f"({_PATTERNS[kind]})", f"{_OPEN}$1{_SHUT}"), f"[{_OPEN}{_SHUT}]", -1)


def _clean(text: Column) -> Column:
    """The text without the marks that are put into it."""
    return F.when(text.rlike(f"[{_OPEN}{_SHUT}]"), F.translate(text, _OPEN + _SHUT, _BLANK * 2)).otherwise(text)


def _masked(text: Column) -> Column:
    """The text with as many marks in place of each mail address: of the base spans, only these hold letters."""
    hidden = F.array_join(F.transform(_parts(_clean(text), "email"), lambda p, i: F.when(i % 2 == 1, F.repeat(F.lit(_OPEN), F.length(p))).otherwise(p)), "")
    return F.when(text.contains("@"), hidden).otherwise(_clean(text))


def base_spans(text: Column) -> Column:
    """All base spans of a text, by kind as listed, then start."""
    return F.concat(*[_spans(_clean(text), k) for k in KINDS])


def found_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row, spans, text): base spans of every row; the text only where there are any.

    ``row`` is a hash of the text, which keeps rows that share an id apart.
    """
    rows = text_of(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("row"), base_spans(F.col("text")).alias("spans"), "text")
    return stored(rows.withColumn("text", F.when(F.size("spans") > 0, F.col("text"))), "pii-spans")


def _entity_keys(s: Column) -> Column:
    """Keys of a span's value and of its group: mail domain, first three parts of an address, leading digits."""
    value, kind = F.lower(s["value"]), s["kind"]
    group = F.when(kind == 0, F.substring_index(value, "@", -1)).when(kind == 1, F.substring_index(value, ".", 3)).otherwise(F.substring(F.regexp_replace(value, "[^0-9]", ""), 1, 6))
    return F.array(F.xxhash64(kind, value), F.xxhash64(kind, F.lit("group"), group))


#: Where a run of letters begins or ends; marks go with letters, so a word that reaches into a span isn't one.
_EDGE = rf"(?<=[\p{{L}}{_OPEN}])(?![\p{{L}}{_OPEN}])|(?<![\p{{L}}{_OPEN}])(?=[\p{{L}}{_OPEN}])"
_TERM = rf"^\p{{L}}{{{MIN_LETTERS},}}$"


def _terms_in(body: Column, cut: Column, last: bool) -> Column:
    """The terms of a piece of text; one where it cuts a word is left out.

    ``cut``: whether the piece may begin (or, if ``last``, end) within a word.
    """

    def of(runs: Column) -> Column:
        inner = F.when(cut, F.slice(runs, 1, F.size(runs) - 1) if last else F.slice(runs, 2, F.size(runs))).otherwise(runs)
        return F.transform(F.filter(inner, lambda w: w.rlike(_TERM)), lambda w: F.lower(w))

    return _named(F.split(body, _EDGE, -1), of)


def contexts(found: DataFrame) -> DataFrame:
    """(row, copies, context, words, entities): for each base span the terms within ``CONTEXT`` characters of it.

    Equal texts are one, with the number of their rows as ``copies``; ``context`` is
    a hash of the terms, in order.
    """
    held = found.filter(F.size("spans") > 0).groupBy("row").agg(F.count("*").alias("copies"), F.first("spans").alias("spans"), F.first("text").alias("text"))

    def near(pieces: Column) -> Column:
        length = (F.size(pieces) - 1) * PIECE + F.length(F.element_at(pieces, -1))
        at = lambda i: F.coalesce(F.get(pieces, i), F.lit(""))

        def cut(low: Column, n: Column) -> Column:
            first = F.floor(low / PIECE).cast("int")
            return F.substring(F.concat(at(first), at(first + 1)), low - first * PIECE + 1, n)

        def one(s: Column) -> Column:
            low = F.greatest(s["start"] - CONTEXT, F.lit(0))
            before = _terms_in(cut(low, s["start"] - low), low > 0, last=False)
            after = _terms_in(cut(s["end"], F.lit(CONTEXT)), s["end"] + CONTEXT < length, last=True)
            return F.struct(_entity_keys(s).alias("entities"), F.concat(before, after).alias("words"))

        return F.transform("spans", one)

    pieces = F.regexp_extract_all(_masked(F.col("text")), F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    each = held.select("row", "copies", F.explode(_named(pieces, near)).alias("c"))
    return each.select("row", "copies", F.xxhash64("c.words").alias("context"), F.array_distinct("c.words").alias("words"), "c.entities")


def term_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n_term): in how many documents of the corpus each term occurs."""
    words = F.array_distinct(F.split(F.lower(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"[^\p{L}]+", " ")), " "))
    terms = docs.select(F.explode(words).alias("word")).filter(F.length("word") >= MIN_LETTERS)
    return terms.groupBy("word").agg(F.count("*").alias("n_term"))


def _discloses(counts: dict[str, Column], n: int, pairs: int, doubt: float) -> Column:
    """Whether a term leaves too little doubt about an entity, and more than chance brought both together.

    The share of an entity among a term's documents starts from what chance would
    give.  Chance brings a term into ``expected`` of the entity's contexts; as many as
    were seen have a probability below Chernoff's bound, which must be small over all pairs.
    """
    both, term, entity, seen, places = (counts[k].cast("double") for k in ("n_both", "n_term", "n_entity", "contexts", "n_contexts"))
    left = -F.log2((both + PRIOR * entity / n) / (F.greatest(term, both) + PRIOR))
    expected = places * F.greatest(term, both) / n
    chance = seen * (1 + F.log(expected / seen)) - expected
    return (left <= doubt) & (seen >= CONTEXTS) & (seen > expected) & (chance <= math.log(CHANCE / max(1, pairs)))


def disclosing_words(docs: DataFrame, found: DataFrame, text_col: str = "text", doubt: float = DOUBT) -> DataFrame:
    """(word, put): terms that give away an entity, and what takes their place.

    ``put`` is the longest prefix, with a star, whose words together don't disclose
    the entity, or nothing; of a word that discloses several, the shortest.  Each
    row is a document, for terms, entities and both alike.
    """
    met = stored(contexts(found).withColumn("entity", F.explode("entities")).drop("entities"), "pii-contexts")
    n = docs.count()
    held = met.groupBy("entity", "row").agg(F.first("copies").alias("copies"), F.count_distinct("context").alias("c")).groupBy("entity").agg(F.sum("copies").alias("n_entity"))
    places = met.select("entity", "context").distinct().groupBy("entity").agg(F.count("*").alias("n_contexts"))
    terms = met.withColumn("word", F.explode("words")).drop("words")
    documents = terms.select("word", "entity", "row", "copies").distinct().groupBy("word", "entity").agg(F.sum("copies").alias("n_both"))
    apart = terms.select("word", "entity", "context").distinct().groupBy("word", "entity").agg(F.count("*").alias("contexts"))
    both = stored(documents.join(apart, ["word", "entity"]), "pii-both")
    pairs = both.count()
    entities = stored(held.join(places, "entity"), "pii-entities")
    words = stored(term_documents(docs, text_col), "pii-words")
    counts = lambda: {k: F.col(k) for k in ("n_both", "n_term", "n_entity", "contexts", "n_contexts")}
    # most pairs have met in one context only, and need no join
    judged = both.filter(F.col("contexts") >= CONTEXTS).join(entities, "entity").join(words, "word").filter(_discloses(counts(), n, pairs, doubt))
    judged, put = stored(judged.select("word", "entity", "n_entity", "n_contexts"), "pii-judged"), F.lit("")
    for letters in reversed(PREFIXES):
        prefix = F.substring("word", 1, letters).alias("prefix")
        wanted = judged.select("word", "entity", "n_entity", "n_contexts", prefix)
        some = wanted.select("prefix").distinct()
        of_all = words.withColumn("prefix", prefix).join(some, "prefix", "left_semi").groupBy("prefix").agg(F.sum("n_term").alias("n_term"))
        of_both = both.withColumn("prefix", prefix).join(wanted.select("prefix", "entity").distinct(), ["prefix", "entity"], "left_semi").groupBy("prefix", "entity").agg(F.sum("n_both").alias("n_both"), F.sum("contexts").alias("contexts"))
        level = wanted.join(of_both, ["prefix", "entity"]).join(of_all, "prefix")
        level = level.select("word", "entity", (~_discloses(counts(), n, pairs, doubt)).alias(f"safe{letters}"))
        judged = judged.join(level, ["word", "entity"])
        put = F.when(F.col(f"safe{letters}") & (F.length("word") > letters), F.concat(F.substring("word", 1, letters), F.lit("*"))).otherwise(put)
    shortest = F.min(F.struct(F.length("put").alias("n"), "put")).alias("least")
    return stored(judged.withColumn("put", put).groupBy("word").agg(shortest).select("word", F.col("least.put").alias("put")), "pii-disclosing")


def disclosing_terms(docs: DataFrame, disclosing: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row, terms): where the words of ``disclosing`` stand, in any document; rows that repeat each other are one.

    ``terms`` has (start, end, put), by start.  Only documents that hold such a word are
    read for its places.
    """
    rows = text_of(docs, id_col, text_col).withColumn("row", F.xxhash64("text"))
    words = F.array_distinct(F.split(F.lower(F.regexp_replace("text", r"[^\p{L}]+", " ")), " "))
    hits = rows.select("doc_id", "row", F.explode(words).alias("word")).join(disclosing, "word").groupBy("doc_id", "row").agg(F.map_from_entries(F.collect_set(F.struct("word", "put"))).alias("puts"))
    hits = stored(hits.withColumnsRenamed({"doc_id": "id2", "row": "row2"}), "pii-hits")

    def places(runs: Column) -> Column:
        def of(starts: Column) -> Column:
            each = F.transform(runs, lambda w, i: F.struct(F.get(starts, i).alias("start"), (F.get(starts, i) + F.length(w)).alias("end"), F.when(w.rlike(_TERM), F.try_element_at(F.col("puts"), F.lower(w))).alias("put")))
            return F.filter(each, lambda t: t["put"].isNotNull())

        return _named(_offsets(F.transform(runs, lambda w: F.length(w))), of)

    held = rows.join(hits, F.col("doc_id").eqNullSafe(F.col("id2")) & (F.col("row") == F.col("row2")))
    located = held.select("doc_id", "row", _named(F.split(_masked(F.col("text")), _EDGE, -1), places).alias("terms"))
    return located.groupBy("doc_id", "row").agg(F.first("terms").alias("terms"))


def _all_spans(docs: DataFrame, id_col: str, text_col: str, **options) -> DataFrame:
    found = found_spans(docs, id_col, text_col)
    terms = disclosing_terms(docs, disclosing_words(docs, found, text_col, **options), id_col, text_col)
    terms = terms.select(F.col("doc_id").alias("id2"), F.col("row").alias("row2"), "terms")
    return found.join(terms, F.col("doc_id").eqNullSafe(F.col("id2")) & (F.col("row") == F.col("row2")), "left").drop("id2", "row2")


def _written(spans: Column, kind) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and decisions of every whole text.

    Spans are kind:start:end in code points, the end exclusive; base kinds come
    first as listed, then ``term`` for what the corpus shows to disclose.
    ``decisions`` has for each term start:end:prefix* where it is generalised and
    start:end: where it is removed.  Null texts are empty; disclosing terms are found
    in all documents, with base spans or without; each row counts as a document, and
    repeated rows repeat their result.  Texts of any length are searched whole; no rows for an empty
    table; other columns are not read, whatever their names.
    """
    found = _all_spans(docs, id_col, text_col, **options)
    names = F.array(*map(F.lit, KINDS))
    base = _written(F.col("spans"), lambda s: F.get(names, s["kind"]))
    terms = _written(F.col("terms"), lambda s: F.lit("term"))
    decisions = F.array_join(F.transform("terms", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"), s["put"])), ",")
    n = [_count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *n, F.sha2(base, 256).alias("base_sha256"), F.concat_ws(",", F.when(base != "", base), F.when(terms != "", terms)).alias("spans"), F.coalesce(decisions, F.lit("")).alias("decisions"))


def _count(kind: int) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id and text without what discloses: entities become [EMAIL], [IP], [CARD] or
    [PHONE], terms a prefix with a star, or nothing.

    Null texts are empty, repeated rows repeat their result, and a null id is an id
    like any other.  Where spans overlap, the one that starts first (then the longer) is replaced
    whole and the others as far as they reach beyond it.
    """
    found = _all_spans(docs, id_col, text_col, **options)
    body = text_of(docs, id_col, text_col).select(F.col("doc_id").alias("id3"), F.xxhash64("text").alias("row3"), F.col("text").alias("body")).distinct()
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    base = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("rank"), s["end"].alias("end"), F.get(names, s["kind"]).alias("put")))
    terms = F.transform(F.coalesce("terms", F.array().cast("array<struct<start:int,end:int,put:string>>")), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("rank"), s["end"].alias("end"), s["put"].alias("put")))
    cuts = F.array_sort(F.concat(base, terms))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        text = F.col("body")
        gap = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        put = F.when(s["end"] > acc["at"], s["put"]).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], gap, put).alias("out"))

    def finish(acc: Column) -> Column:
        return F.concat(acc["out"], F.substring(F.col("body"), acc["at"] + 1, F.length("body")))

    whole = found.join(body, F.col("doc_id").eqNullSafe(F.col("id3")) & (F.col("row") == F.col("row3")))
    return whole.select("doc_id", F.aggregate(cuts, start, step, finish).alias("text"))
