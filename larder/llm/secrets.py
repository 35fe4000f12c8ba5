"""Secret scans: base patterns, and probabilistic automata learnt from credentials.

Credentials that a base pattern labels with a kind are read as strings of letter
classes.  States of their prefix tree are merged where what follows them is
statistically compatible (Hoeffding's bound): first states of one depth, which pools
the few examples that each has seen, then layers a few steps apart, where enough
have passed to tell.  So a format of fixed length or with parts in order keeps both,
and one of free length becomes a loop.  Credentials held out from that, without
their keywords, set how likely a format must be.  Every other run of the credential
alphabet is a candidate, of any length: it is a secret if an automaton finds its
format that likely and clearly likelier than ordinary text is.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import least_by_hash, stored, text_of

#: Most credentials that give one automaton its states: those with the smallest hash.  All that it can read are
#: counted in it, and those that it can't give the next automaton its states, until none is left.
MAX_EXAMPLES = 2_000
#: Letters of these together; a longer credential gives no states.
MAX_LETTERS = 200_000
#: One in so many examples is held out to judge an automaton.
HELD_OUT = 5
#: Layers of different depth are merged if so many examples passed each, and at most so many steps apart.
ENOUGH, STEPS = 30, 8
#: Confidence of the merge test: smaller merges more.
ALPHA = 0.05
#: Bits a letter that a candidate's likelihood may fall short of the least likely example held out.
SLACK = 0.05
#: Bits by which a secret's format must be likelier than that of ordinary text.
MARGIN = 20.0
#: Formats whose verdict a worker remembers, and the longest of them.
_REMEMBERED, _SHORT = 500_000, 256

KINDS = ("assign", "access", "hex")
_KEY = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
_ASSIGN = re.compile(rf"""({_KEY})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: A run of 24 or more is what is left of all runs when shorter ones are dropped.
_HEX = re.compile(r"[0-9a-f]{24,}")
#: Letter classes: digits, a-f and A-F (hexadecimal strings use them), other letters; marks stand for themselves.
_CLASSES = str.maketrans({**dict.fromkeys("0123456789", "d"), **dict.fromkeys("abcdef", "h"), **dict.fromkeys("ghijklmnopqrstuvwxyz", "l"), **dict.fromkeys("ABCDEF", "H"), **dict.fromkeys("GHIJKLMNOPQRSTUVWXYZ", "L")})
_SYMBOLS = "dhlHL+/_.=-"
#: A run of the credential alphabet in a text of classes; dots only within.
_CANDIDATE = re.compile(r"[dhlHL+/_=-]+(?:\.[dhlHL+/_=-]+)*")


#: A text has no assignment without one of these in lower case.
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")


def base_matches(text: str) -> list[tuple[int, int, int, str]]:
    """(start, end, kind's number, credential) of the base patterns' matches; of an assignment, the value alone is the credential."""
    found, low = [], text.lower()
    if any(word in low for word in _WORDS):
        found += [(m.start(), m.end(), 0, m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1, m[0]) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return found + [(m.start(), m.end(), 2, m[0]) for m in _HEX.finditer(text)]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns' matches, by start, then kind as listed."""
    return [(s, e, KINDS[k]) for s, e, k, _ in sorted(base_matches(text), key=lambda x: (x[0], x[2]))]


class Ordinary:
    """How likely the format of an ordinary candidate is: each letter class given the one before, smoothed."""

    SYMBOLS = 13  # five letter classes, seven marks, and the end

    def __init__(self, counts: dict[str, int]):
        """``counts``: formats and how often each was seen."""
        self.pairs: dict[str, int] = {}
        self.firsts: dict[str, int] = {}
        for form, n in counts.items():
            for a, b in zip("^" + form, form + "$", strict=True):
                self.pairs[a + b] = self.pairs.get(a + b, 0) + n
                self.firsts[a] = self.firsts.get(a, 0) + n

    @classmethod
    def of_pairs(cls, pairs: dict[str, int]) -> Ordinary:
        """From how often each pair of classes was seen."""
        made = cls({})
        made.pairs = dict(pairs)
        for pair, n in pairs.items():
            made.firsts[pair[0]] = made.firsts.get(pair[0], 0) + n
        return made

    def bits(self, form: str) -> float:
        """Bits of the whole format."""
        return sum(math.log2((self.firsts.get(a, 0) + self.SYMBOLS) / (self.pairs.get(a + b, 0) + 1)) for a, b in zip("^" + form, form + "$", strict=True))


@dataclass
class State:
    passed: int = 0
    ended: int = 0
    to: dict[str, State] = field(default_factory=dict)
    times: dict[str, int] = field(default_factory=dict)


class Automaton:
    """A probabilistic automaton from a prefix tree with compatible states merged."""

    def __init__(self, examples: list[str], alpha: float = ALPHA, judges: list[str] | None = None):
        """``judges`` set how likely a format must be; the examples themselves without any."""
        self.start = State()
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        words = [x.translate(_CLASSES) for x in examples]
        for word in words:
            at = self.start
            at.passed += 1
            for c in word:
                at.times[c] = at.times.get(c, 0) + 1
                at = at.to.setdefault(c, State())
                at.passed += 1
            at.ended += 1
        self.layers = self._merge_depths()
        self.states = self._merge_layers()
        scores = [x for word in (judges or examples) if (x := self.bits(word.translate(_CLASSES))) < math.inf]
        self.worst = max(scores, default=0.0)

    def __getstate__(self) -> tuple:
        """States by number: a chain of them nests too deep to be sent as it is."""
        number = {id(x): i for i, x in enumerate(self.states)}
        rows = [(x.passed, x.ended, x.times, {c: number[id(t)] for c, t in x.to.items()}) for x in self.states]
        return self.bound, self.worst, number[id(self.start)], rows

    def __setstate__(self, sent: tuple) -> None:
        self.bound, self.worst, start, rows = sent
        self.states = [State(passed, ended, {}, times) for passed, ended, times, _ in rows]
        for x, (*_, to) in zip(self.states, rows, strict=True):
            x.to = {c: self.states[i] for c, i in to.items()}
        self.start, self.layers = self.states[start], []

    def _merge_depths(self) -> list[list[State]]:
        """States of one depth, from the root on: each merges into an earlier compatible one, with all that follows it."""
        layers = [[self.start]]
        while layers[-1]:
            layer: list[State] = []
            for parent in layers[-1]:
                for c in sorted(parent.to):
                    child = parent.to[c]
                    for other in layer:
                        if self._compatible(other, child):
                            parent.to[c] = other
                            self._fold(other, child)
                            break
                    else:
                        layer.append(child)
            layers.append(layer)
        return layers[:-1]

    def _merge_layers(self) -> list[State]:
        """States of near layers, if all that follows both is compatible: known from the last layer backwards."""
        alike: set[tuple[int, int]] = set()
        for deep in range(len(self.layers) - 1, 0, -1):
            for high in range(max(0, deep - STEPS), deep):
                for a in self.layers[high]:
                    for b in self.layers[deep]:
                        if self._alike(a, b) and all(self._same_depth_or(alike, a.to[c], b.to[c]) for c in set(a.to) & set(b.to)):
                            alike.add((id(a), id(b)))
        first: dict[int, State] = {}

        def of(x: State) -> State:
            while id(x) in first:
                x = first[id(x)]
            return x

        order = [x for layer in self.layers for x in layer]
        for deep, layer in enumerate(self.layers):
            for b in layer:
                near = (a for high in range(max(0, deep - STEPS), deep) for a in self.layers[high])
                if match := next((a for a in near if (id(a), id(b)) in alike and min(a.passed, b.passed) >= ENOUGH), None):
                    todo = [(match, b)]
                    while todo:
                        x, y = (of(z) for z in todo.pop())
                        if x is not y:
                            first[id(y)] = x
                            todo += self._add(x, y)
        left = [x for x in order if id(x) not in first]
        for x in left:
            x.to = {c: of(t) for c, t in x.to.items()}
        self.start = of(self.start)
        return left

    @staticmethod
    def _same_depth_or(alike: set[tuple[int, int]], a: State, b: State) -> bool:
        return a is b or (id(a), id(b)) in alike

    def _alike(self, a: State, b: State) -> bool:
        return not self._differ(a.ended, a.passed, b.ended, b.passed) and not any(self._differ(a.times.get(c, 0), a.passed, b.times.get(c, 0), b.passed) for c in set(a.times) | set(b.times))

    def _differ(self, a: int, n: int, b: int, m: int) -> bool:
        return n > 0 and m > 0 and abs(a / n - b / m) > self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def _compatible(self, a: State, b: State) -> bool:
        """Whether two states of one depth, and all that follows both, may be the same."""
        pairs = [(a, b)]
        while pairs:
            x, y = pairs.pop()
            if not self._alike(x, y):
                return False
            pairs += [(x.to[c], y.to[c]) for c in set(x.to) & set(y.to)]
        return True

    @staticmethod
    def _add(x: State, y: State) -> list[tuple[State, State]]:
        """Count what ``y`` saw with ``x``; the states that both lead to by a letter are left to be merged."""
        x.passed, x.ended, met = x.passed + y.passed, x.ended + y.ended, []
        for c, n in y.times.items():
            x.times[c] = x.times.get(c, 0) + n
            if c in x.to:
                met.append((x.to[c], y.to[c]))
            else:
                x.to[c] = y.to[c]
        return met

    def _fold(self, a: State, b: State) -> None:
        """Add the tree below ``b`` to the one below ``a``."""
        todo = [(a, b)]
        while todo:
            todo += self._add(*todo.pop())

    def path(self, form: str) -> list[State] | None:
        """The states from the start to the one that ends a format, None if the automaton can't read it."""
        at, found = self.start, [self.start]
        for c in form:
            to = at.to.get(c)
            if to is None:
                ways = {id(t): t for t in at.to.values()}
                if len(ways) != 1:
                    return None
                to = next(iter(ways.values()))
            found.append(to)
            at = to
        return found if at.ended and form else None

    def recounted(self, counts: dict[tuple[int, str], int]) -> None:
        """Take counts by (state's number, class) instead of the examples' own: "" for all that passed, "$" for those that ended."""
        for i, state in enumerate(self.states):
            ways = list(state.to.values())
            state.passed, state.ended, state.times = counts.get((i, ""), 0), counts.get((i, "$"), 0), {}
            for c in _SYMBOLS:
                if n := counts.get((i, c)):
                    state.times[c] = n
                    state.to.setdefault(c, ways[0] if ways else state)

    def bits(self, form: str) -> float:
        """Bits a letter of a format; infinite if the automaton can't read it.

        A class that was never seen in a state goes where all others go, as half an example would.
        """
        at, total = self.start, 0.0
        for c in form:
            to = at.to.get(c)
            if to is None:
                ways = {id(t): t for t in at.to.values()}
                if len(ways) != 1:
                    return math.inf
                to = next(iter(ways.values()))
            total -= math.log2((at.times.get(c, 0) + 0.5) / (at.passed + 0.5 * Ordinary.SYMBOLS))
            at = to
        return (total - math.log2(at.ended / at.passed)) / len(form) if at.ended and form else math.inf

    def accepts(self, form: str) -> bool:
        """Whether the format is as likely as the examples'."""
        return self.bits(form) <= self.worst + SLACK


@dataclass
class Grammar:
    """Automata by kind, and the formats of ordinary text; scores any candidate."""

    automata: dict[str, Automaton]
    ordinary: Ordinary
    known: dict[str, bool] = field(default_factory=dict)

    def secret(self, form: str) -> bool:
        if (found := self.known.get(form)) is not None:
            return found
        likely = [a.bits(form) for a in self.automata.values() if a.accepts(form)]
        found = bool(likely) and min(likely) * len(form) + MARGIN <= self.ordinary.bits(form)
        if len(form) <= _SHORT:
            if len(self.known) >= _REMEMBERED:
                self.known.clear()
            self.known[form] = found
        return found


def _outside(text: str, spans: list[tuple]) -> Iterator[str]:
    """The pieces of the text between the spans."""
    at = 0
    for start, end, *_ in sorted(spans):
        if start > at:
            yield text[at:start]
        at = max(at, end)
    yield text[at:]


def _gathered(docs: DataFrame, text_col: str) -> DataFrame:
    """(kind, word, n): labelled credentials by kind, and under "ordinary" the pairs of classes in all other candidates, with their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter[tuple[str, str]] = Counter()
            forms: Counter[str] = Counter()
            for value in batch.column(0):
                text = value.as_py()
                base = base_matches(text)
                found.update((KINDS[k], word) for *_, k, word in base)
                forms.update(_CANDIDATE.findall(" ".join(_outside(text, base)).translate(_CLASSES)))
            rows = [*((k, w, n) for (k, w), n in found.items()), *(("ordinary", w, n) for w, n in Ordinary(forms).pairs.items())]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["kind", "word", "n"])

    seen = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, "kind string, word string, n long")
    return seen.groupBy("kind", "word").agg(F.sum("n").alias("n"))


def _examples(words: DataFrame, most: int) -> list[str]:
    """The ``most`` words with the smallest hash, as long as their letters together stay within a bound."""
    least = least_by_hash(words.filter(F.length("word") <= MAX_LETTERS), most, "word")
    upto = F.sum(F.length("word")).over(Window.orderBy(F.xxhash64("word"), "word").rowsBetween(Window.unboundedPreceding, 0))  # at most ``most`` rows
    return [r.word for r in least.withColumn("upto", upto).filter(F.col("upto") <= MAX_LETTERS).collect()]


def _counts(words: DataFrame, automaton: Automaton) -> dict[tuple[int, str], int]:
    """How many of all words pass each state, by what follows; the table has a row for each state and class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {id(x): i for i, x in enumerate(automaton.states)}
        for batch in batches:
            found: Counter[tuple[int, str]] = Counter()
            for word in batch.column(0).to_pylist():
                form = word.translate(_CLASSES)
                if path := automaton.path(form):
                    places = [number[id(x)] for x in path]
                    found.update((i, "") for i in places)
                    found.update(zip(places, [*form, "$"], strict=True))
            rows = [(i, c, n) for (i, c), n in found.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int32(), pa.string(), pa.int64()))], ["state", "letter", "n"])

    counted = words.select("word").mapInArrow(run, "state int, letter string, n long").groupBy("state", "letter").agg(F.sum("n").alias("n"))
    return {(r.state, r.letter): r.n for r in counted.collect()}


def _unread(words: DataFrame, automaton: Automaton) -> DataFrame:
    """The words that the automaton can't read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([automaton.path(w.translate(_CLASSES)) is None for w in batch.column(0).to_pylist()], pa.bool_()))

    return words.select("word").mapInArrow(run, "word string")


def _worst(words: DataFrame, automaton: Automaton) -> float | None:
    """Bits a letter of the least likely word that the automaton can read, of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [x for w in batch.column(0).to_pylist() if (x := automaton.bits(w.translate(_CLASSES))) < math.inf]
            yield pa.RecordBatch.from_arrays([pa.array([max(bits)] if bits else [], pa.float64())], ["bits"])

    return words.select("word").mapInArrow(run, "bits double").agg(F.max("bits")).first()[0]


def grammar_of(docs: DataFrame, text_col: str = "text", most: int = MAX_EXAMPLES, alpha: float = ALPHA) -> Grammar:
    """Automata of each kind's credentials and the formats of ordinary text, from all documents.

    States are merged for at most ``most`` different credentials at a time, those with
    the smallest hash.  All credentials that such an automaton reads are then counted
    in it; those that it can't read give the next one of the kind, until none is left.
    All that are held out set each automaton's threshold, and all ordinary candidates
    count.
    """
    seen = stored(_gathered(docs, text_col), "secret-words")
    ordinary = Ordinary.of_pairs({r.word: r.n for r in seen.filter("kind = 'ordinary'").collect()})  # at most a row for two classes
    made = {}
    for kind in KINDS:
        words = seen.filter(F.col("kind") == kind).select("word")
        apart = F.crc32(F.encode("word", "UTF-8")) % HELD_OUT == 0
        judges, left = words.filter(apart), words.filter(~apart)
        if left.isEmpty():
            left = judges
        while examples := _examples(left, most):
            automaton = Automaton(sorted(examples), alpha)
            if n := left.count() - len(examples):  # words differ
                automaton.recounted(_counts(left, automaton))
            worst = _worst(judges, automaton)
            if (worst := _worst(left, automaton) if worst is None else worst) is not None:
                automaton.worst = worst
            made[kind if kind not in made else f"{kind} {sum(k.split()[0] == kind for k in made) + 1}"] = automaton
            if not n:
                break
            left = stored(_unread(left, automaton), "secret-unread")
    return Grammar(made, ordinary)


def held_out(word: str) -> bool:
    return zlib.crc32(word.encode()) % HELD_OUT == 0


def infer(examples_of: dict[str, list[str]], ordinary: Ordinary, alpha: float = ALPHA) -> Grammar:
    """An automaton of each kind with examples: most are learnt from, the others judge."""
    made = {}
    for kind, words in examples_of.items():
        learnt, judges = sorted(w for w in words if not held_out(w)), sorted(filter(held_out, words))
        if words:
            made[kind] = Automaton(learnt or judges, alpha, judges)
    return Grammar(made, ordinary)


def measured(grammar: Grammar, credentials: list[str], others: list[str]) -> dict[str, float]:
    """Share of credentials (without keywords) that are found, and of other strings that are."""
    share = lambda words: sum(grammar.secret(w.translate(_CLASSES)) for w in words) / max(1, len(words))
    return {"recall": share(credentials), "false_alarms": share(others)} | {f"states_{k}": len(a.states) for k, a in grammar.automata.items()}


def candidates(text: str, base: list[tuple[int, int, str]]) -> Iterator[tuple[int, int, str]]:
    """(start, end, format) of every run of the credential alphabet that no base span touches."""
    taken, at, reach = sorted(base), 0, -1
    for m in _CANDIDATE.finditer(text.translate(_CLASSES)):
        start, end = m.span()
        while at < len(taken) and taken[at][0] < end:
            reach = max(reach, taken[at][1])
            at += 1
        if reach <= start:
            yield start, end, m[0]


def learnt_spans(text: str, grammar: Grammar | None, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Candidates whose format is likelier as a secret's."""
    if grammar is None or not grammar.automata:
        return []
    secret = grammar.secret
    if not any(map(secret, set(_CANDIDATE.findall(text.translate(_CLASSES))))):
        return []
    return [(s, e, "format") for s, e, form in candidates(text, base) if secret(form)]


def written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", grammar: Grammar | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every whole text.

    Base spans stay as matched; the automata (inferred from the documents' own
    base matches unless given) add spans of kind ``format``.  Spans count code
    points, the end exclusive, by start, then kind.  A null text is empty and has
    no spans; repeated rows repeat their result; texts and candidates of any length
    are scored whole; no rows for an empty table; other columns are not read.
    """
    grammar = grammar_of(docs, text_col) if grammar is None else grammar
    shipped = docs.sparkSession.sparkContext.broadcast(grammar)
    order = {k: i for i, k in enumerate((*KINDS, "format"))}
    schema = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learnt = shipped.value
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                base = base_spans(text)
                every = sorted(base + learnt_spans(text, learnt, base), key=lambda x: (x[0], order[x[2]]))
                n = [sum(k == kind for *_, k in base) for kind in KINDS]
                rows.append((doc_id, *n, hashlib.sha256(written(base).encode()).hexdigest(), written(every)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)

    return text_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
