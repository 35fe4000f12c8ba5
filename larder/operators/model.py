"""A global gradient-boosted model over all SKUs, tuned on expanding folds by WAPE."""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from statistics import median

from pyspark import inheritable_thread_target
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.config import Settings
from larder.functions.exprs import wape
from larder.functions.stored import settled
from larder.operators.features import BASELINES, baseline_forecasts, create_features, feature_names
from larder.operators.forecast import candidate_table, date_folds
from larder.operators.tuning import Range, Sampler

#: Stand for a missing value below and above all others.
LOWEST, HIGHEST = -1e300, 1e300
#: Marks the copy of a feature whose missing values are above all others.
ABOVE = "_missing_above"
#: A bound that boosting doesn't reach: it stops where a fold's error falls by less than a hundredth.
MOST_TREES = 500
#: Trees of a model that no fold has judged.
USUAL_TREES = 30
#: Trials whose settings are drawn before any of them is scored, and fits that run at the same time.
BATCH, FITTED_TOGETHER = 4, 8

SPACE = {
    "maxDepth": Range(2, 6, whole=True), "stepSize": Range(0.05, 0.3, log=True), "subsamplingRate": Range(0.4, 1.0), "featureSubsetStrategy": Range(0.4, 1.0), "minInstancesPerNode": Range(5, 100, whole=True),
    "minInfoGain": Range(1e-8, 1.0, log=True), "minWeightFractionPerNode": Range(1e-8, 0.01, log=True), "maxBins": Range(32, 128, whole=True),
}


def _settings(drawn: dict) -> dict:
    return drawn | {"featureSubsetStrategy": f"{drawn['featureSubsetStrategy']:.4f}"}


def parameter_plan(trials: int, seed: int) -> list[dict]:
    """Settings of trials of which none is scored, the same for a seed: eight of each."""
    sampler = Sampler(SPACE, seed)
    return [_settings(sampler.ask()[1]) for _ in range(trials)]


def prepared(features: DataFrame) -> DataFrame:
    """(sku_id, date, demand, features): a stored table whose vectors serve every fit.

    SKUs are categories in name order.  A split has a default direction for missing
    values: a feature that has any comes twice, with them below and above all others,
    and a split on the one sends them left, on the other right.
    """
    names = [c for c in feature_names(features) if c != "sku_id"]
    gaps = features.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in names]).first()
    rows = features.select("sku_id", "date", F.col("demand").cast("double").alias("demand"), *[F.coalesce(F.col(c).cast("double"), F.lit(LOWEST)).alias(c) for c in names], *[F.coalesce(F.col(c).cast("double"), F.lit(HIGHEST)).alias(c + ABOVE) for c in names if gaps[c]])
    indexed = StringIndexer(inputCol="sku_id", outputCol="sku_index", stringOrderType="alphabetAsc", handleInvalid="keep").fit(rows).transform(rows)
    inputs = ["sku_index", *[c for c in rows.columns if c not in ("sku_id", "date", "demand")]]
    return settled(VectorAssembler(inputCols=inputs, outputCol="features").transform(indexed).select("sku_id", "date", "demand", "features"))


def _attributes(rows: DataFrame) -> dict[int, dict]:
    kinds = rows.schema["features"].metadata["ml_attr"]["attrs"]
    return {a["idx"]: a for own in kinds.values() for a in own}


def train(rows: DataFrame, params: dict, before, seed: int = 42, judged: tuple | None = None) -> GBTRegressionModel:
    """One model over all SKUs from the ``prepared`` days before ``before``.

    ``judged`` are the first and last day of a fold: with them boosting stops where
    the fold's error no longer falls, and the model keeps its best number of trees.
    """
    known = F.col("date") < F.lit(before)
    own = {"maxIter": USUAL_TREES if judged is None else MOST_TREES} | params
    skus = max((len(a["vals"]) for a in _attributes(rows).values() if "vals" in a), default=0)
    own["maxBins"] = max(own.get("maxBins", 64), skus + 1)
    trees = GBTRegressor(labelCol="demand", seed=seed, **own)
    if judged is None:
        return trees.fit(rows.filter(known))
    return trees.setValidationIndicatorCol("judged").fit(rows.filter(known | F.col("date").between(*map(F.lit, judged))).withColumn("judged", ~known))


def predict(model: GBTRegressionModel, rows: DataFrame, first, last) -> DataFrame:
    """(sku_id, date, demand, forecast, model), never below zero."""
    found = model.transform(rows.filter(F.col("date").between(F.lit(first), F.lit(last))))
    return found.select("sku_id", "date", "demand", F.greatest("prediction", F.lit(0.0)).alias("forecast"), F.lit("GBT").alias("model"))


def _folds(rows: DataFrame, settings: Settings) -> list:
    return date_folds(rows, settings).groupBy("fold").agg(F.min("date").alias("first"), F.max("date").alias("last")).orderBy("fold").collect()  # five rows


def trials_of(rows: DataFrame, settings: Settings, trials: int = 8) -> list[tuple[dict, float, int]]:
    """(settings, mean WAPE over folds, median of the folds' best numbers of trees) of each trial.

    Each fold is forecast by a model of the days before it.  Settings are drawn batch
    by batch, each from the scores of those before; folds of a batch are fitted side
    by side, as one small fit leaves most of a cluster idle.
    """
    folds, sampler, found = _folds(rows, settings), Sampler(SPACE, settings.seed), []

    def fit(job: tuple[dict, object]) -> tuple[float | None, int]:
        params, f = job
        model = train(rows, params, f["first"], settings.seed, (f["first"], f["last"]))
        score = predict(model, rows, f["first"], f["last"]).agg(wape(F.col("demand"), F.col("forecast"))).first()[0]
        return score, model.getNumTrees

    with ThreadPoolExecutor(FITTED_TOGETHER) as pool:
        while len(found) < trials:
            batch = [sampler.ask() for _ in range(min(BATCH, trials - len(found)))]
            plan = [(i, _settings(drawn)) for i, drawn in batch]
            done = iter(list(pool.map(inheritable_thread_target(rows.sparkSession)(fit), [(params, f) for _, params in plan for f in folds])))
            for i, params in plan:
                own = [next(done) for _ in folds]
                known = [s for s, _ in own if s is not None]
                score = sum(known) / len(known) if known else float("inf")
                sampler.tell(i, score)
                found.append((params, score, int(median(n for _, n in own)) if own else USUAL_TREES))
    return found


def tune(rows: DataFrame, settings: Settings, trials: int = 8) -> tuple[dict, float]:
    """The settings with the least mean WAPE over folds, with the number of trees that the folds chose."""
    params, score, trees = min(trials_of(rows, settings, trials), key=lambda t: t[1])
    return params | {"maxIter": max(1, trees)}, score


def trial_table(rows: DataFrame, settings: Settings, trials: int = 8) -> DataFrame:
    """(trial, params, wape, trees), one row for each trial."""
    found = [(i + 1, json.dumps(params, sort_keys=True), float(score), trees) for i, (params, score, trees) in enumerate(trials_of(rows, settings, trials))]
    return rows.sparkSession.createDataFrame(found, "trial int, params string, wape double, trees int")


def selection_forecast(rows: DataFrame, params: dict, settings: Settings) -> DataFrame:
    """Out-of-fold forecasts of the selection days."""
    parts = [predict(train(rows, params, f["first"], settings.seed), rows, f["first"], f["last"]) for f in _folds(rows, settings)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def compare_candidates(rows: DataFrame, panel: DataFrame, params: dict, settings: Settings) -> DataFrame:
    """(model, wape, mae, n_obs) of the trees, out of fold, and the baselines on the same days, best first."""
    w = settings.windows
    trees = selection_forecast(rows, params, settings).select("sku_id", "date", F.col("forecast").alias("GBT"))
    base = baseline_forecasts(panel.filter(F.col("date") <= F.lit(w.selection_end)).select("sku_id", "date", "demand"), w.season)
    base = base.filter(F.col("date") > F.date_sub(F.lit(w.selection_end), w.selection_days))
    return candidate_table(base.join(trees, ["sku_id", "date"], "left"), ("GBT", *BASELINES))


def importance(model: GBTRegressionModel, rows: DataFrame) -> list[tuple[str, float]]:
    """Features by importance, largest first; both copies of a feature count together."""
    found: dict[str, float] = {}
    for i, weight in enumerate(model.featureImportances.toArray().tolist()):
        name = _attributes(rows)[i]["name"].removesuffix(ABOVE)
        found[name] = found.get(name, 0.0) + weight
    return sorted(found.items(), key=lambda x: -x[1])


def tuned_forecast(panel: DataFrame, settings: Settings, trials: int = 8) -> DataFrame:
    """Final forecasts of these SKUs by one model with tuned settings, trained before the final window."""
    w, rows = settings.windows, prepared(settled(create_features(panel)))
    params, _ = tune(rows, settings, trials)
    return predict(train(rows, params, w.final_start, settings.seed), rows, w.final_start, panel.agg(F.max("date")).first()[0])


def tuned_comparison(panel: DataFrame, settings: Settings, trials: int = 8) -> DataFrame:
    """The tuned trees against the baselines on the selection days of these SKUs, best first."""
    rows = prepared(settled(create_features(panel)))
    return compare_candidates(rows, panel, tune(rows, settings, trials)[0], settings)
