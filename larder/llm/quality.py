"""Quality classifier: a sparse ensemble of rules over text statistics.

Small trees propose conjunctive rules, a lasso logistic regression weighs them,
and the rules with a weight become one Spark column expression.  Fitting uses a
sample of labelled rows of bounded size (``max_rows``); scoring covers every row.
"""

from __future__ import annotations

import math
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.llm.common import least_by_hash, stored

#: Most labelled rows that a model is fitted on: those with the smallest hash of id and text.
MAX_ROWS = 20_000
TREES = 16
DEPTH = 3
LASSO = 0.0005
SEED = 42

#: Characters counted as a share of the text.
_SHARES = {
    "upper": string.ascii_uppercase,
    "digit": string.digits,
    "mark": "#$%&*",
    "bang": "!",
    "bar": "|",
    "stop": ".,;:?",
    "line": "\n",
    "other": "<>{}[]\\/=_~^@+\"()-",
}
NAMES = [*(f"{k}_share" for k in _SHARES), "log_chars", "mean_word", "distinct_words"]
_BYTES = np.zeros((256, len(_SHARES)), np.int64)
for _k, _letters in enumerate(_SHARES.values()):
    _BYTES[list(_letters.encode()), _k] = 1


def text_statistics(text: bytes) -> list[float]:
    """The statistics of a UTF-8 text, in the order of NAMES; those of an empty text are all zero."""
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    chars = int(counts.sum() - counts[0x80:0xC0].sum())  # all but continuation bytes
    words = text.split()
    shares = (counts @ _BYTES) / max(1, chars)
    white = int(counts[9:14].sum() + counts[32])
    return [*shares.tolist(), math.log1p(chars), (chars - white) / max(1, len(words)), len(set(words)) / max(1, len(words))]


def statistics(text: Column) -> Column:
    """A struct of each whole text's statistics; all rules are column expressions over it."""

    @F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in NAMES]))
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([text_statistics(x) for x in batch], columns=NAMES, dtype="float64")

    return of(text.cast("binary"))


@dataclass(frozen=True)
class Rule:
    """All bounds must hold: (statistic, low, high) means low < value <= high."""

    bounds: tuple[tuple[str, float, float], ...]

    def column(self, of: str) -> Column:
        parts = [F.col(f"{of}.{name}") for name, _, _ in self.bounds]
        holds = F.lit(True)
        for value, (_, low, high) in zip(parts, self.bounds, strict=True):
            holds = (holds & (value > low)) if low > -math.inf else holds
            holds = (holds & (value <= high)) if high < math.inf else holds
        return holds


def tree_rules(tree: str, names: list[str]) -> list[Rule]:
    """A rule for each path from the root of a printed tree to a node below it."""
    rules, path = [], []
    for line in tree.splitlines():
        if m := re.match(r"(\s*)(?:If|Else) \(feature (\d+) (<=|>) ([-+.0-9eE]+)\)", line):
            path = path[: len(m[1]) - 2] if len(m[1]) - 2 < len(path) else path
            value = float(m[4])
            path = [*path, (names[int(m[2])], -math.inf, value) if m[3] == "<=" else (names[int(m[2])], value, math.inf)]
            bounds: dict[str, tuple[float, float]] = {}
            for name, low, high in path:
                was = bounds.get(name, (-math.inf, math.inf))
                bounds[name] = (max(was[0], low), min(was[1], high))
            rules.append(Rule(tuple((k, *v) for k, v in sorted(bounds.items()))))
    return rules


@dataclass(frozen=True)
class RuleModel:
    intercept: float
    weighted: tuple[tuple[Rule, float], ...]

    def score(self, of: str = "stats") -> Column:
        """The likelihood of label 1, from a struct column of statistics."""
        margin = F.lit(float(self.intercept))
        for rule, weight in self.weighted:
            margin = margin + F.when(rule.column(of), F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


def held_out(doc_id: Column) -> Column:
    """Rows that no model learns from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_ROWS) -> RuleModel:
    """Rules and weights from the labelled rows that are not held out.

    Rows without id or label are left out.  Where only one label occurs (or
    none), the model has no rules and scores all texts by its share.
    """
    known = labels.select(F.col(id_col).cast("long").alias("__id"), F.col(label_col).cast("double").alias("__label"))
    known = known.filter("__id is not null and __label is not null").filter(~held_out(F.col("__id")))
    sample = least_by_hash(known, max_rows, "__id")  # at most max_rows, so it may be broadcast
    text = F.coalesce(F.col(text_col), F.lit(""))
    taught = docs.select(F.col(id_col).cast("long").alias("__id"), text.alias("__text")).join(F.broadcast(sample), "__id")
    taught = stored(taught.select("__label", "__id", F.xxhash64("__text").alias("__text"), statistics(F.col("__text")).alias("stats")), "quality-taught")
    # an id may have many rows, so rows are bounded too
    taught = stored(least_by_hash(taught, max_rows, "__id", "__text").select("__label", "stats"), "quality-bounded")
    count, ones = taught.agg(F.count("*"), F.coalesce(F.sum("__label"), F.lit(0.0))).first()
    if not 0 < ones < count:
        share = (ones + 1) / (count + 2)
        return RuleModel(math.log(share / (1 - share)), ())
    points = taught.select(F.col("__label").alias("label"), "stats", array_to_vector(F.array(*[f"stats.{n}" for n in NAMES])).alias("features"))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="0.6", maxBins=64).fit(points)
    rules = list(dict.fromkeys(r for t in forest.trees for r in tree_rules(t.toDebugString, NAMES)))
    if not rules:
        return RuleModel(math.log(ones / (count - ones)), ())
    holds = array_to_vector(F.array(*[r.column("stats").cast("double") for r in rules]))
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=LASSO, maxIter=60, standardization=False).fit(points.select("label", holds.alias("features")))
    weights = lasso.coefficients.toArray().tolist()
    return RuleModel(lasso.intercept, tuple((r, w) for r, w in zip(rules, weights, strict=True) if w))


def score_documents(docs: DataFrame, model: RuleModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted for every row.

    A null text is empty, and empty texts are scored by their statistics (all zero)
    like others; texts of any length are read whole; repeated rows repeat their
    result; a null id is never held out; no rows for an empty table; other columns
    are not read, whatever their names.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), statistics(text).alias("stats"))
    scored = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def accepted(docs: DataFrame, model: RuleModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns whatever their names, that score 0.5 or more."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = "stats"
    while own in docs.columns:
        own += "_"
    scored = docs.withColumn(own, statistics(text))
    return scored.filter(model.score(own) >= 0.5).drop(own)
