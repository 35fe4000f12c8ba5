"""The whole analysis of a panel: from checked rows to policies, their risks and actions."""

from __future__ import annotations

import json
from dataclasses import fields
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.config import Settings
from larder.functions.stored import settled
from larder.operators import contract, features, forecast, model, policy, report, uncertainty
from larder.operators.joins import once
from larder.plans.catalog import Book
from larder.sources.artifacts import open_artifacts, provenance, write_artifacts, write_run
from larder.sources.panel import read_panel

#: The tables of a run.
TABLES = (
    "inventory_processed", "sku_class", "sku_metric", "optimization_scope", "class_summary", "model_choice", "best_params", "feature_importance", "validation_forecast", "forecast", "forecast_metrics",
    "policy_candidate_audit", "policy_sku", "old_policy_metric", "new_policy_metric", "policy_sensitivity", "historical_policy_sensitivity", "policy_action", "full_policy_summary", "scenario_uncertainty", "policy_uncertainty",
)
#: Of those, the ones that a run without boosted trees leaves empty.
MAY_BE_EMPTY = ("feature_importance",)
STRATEGIC = "protect_strategic_value"


def group_forecasts(b: Book, params: dict | None, trials: int) -> dict[str, DataFrame]:
    """Forecasts of the SKUs in scope: each intervention's SKUs by the model that wins for them.

    Strategic SKUs also have boosted trees as a candidate.  Only rows up to the
    end of the selection window choose; rows before a window train for it.
    """
    w, spark = b.w, b.spark
    last = b.panel.agg(F.max("date")).first()[0]
    windows = {"calibration": (w.calibration_start, w.calibration_end), "final": (w.final_start, last)}
    parts: dict[str, list[DataFrame]] = {k: [] for k in windows}
    choices, chosen_params, weights = [], params or {}, []
    for name in [r.intervention for r in b.skus.select("intervention").distinct().orderBy("intervention").collect()]:  # three at most
        own = b.panel.join(b.skus.filter(F.col("intervention") == name).select("sku_id"), "sku_id", "left_semi")
        if name == STRATEGIC:
            seen = model.prepared(settled(features.create_features(own)))
            chosen_params = params or model.tune(seen, b.s, trials)[0]
            winner = model.compare_candidates(seen, own, chosen_params, b.s).first()["model"]
        else:
            winner = forecast.pick_baseline(own, b.s)
        choices.append((name, winner))
        for k, (start, end) in windows.items():
            if winner == "GBT":
                fitted = model.train(seen, chosen_params, start, b.s.seed)
                parts[k].append(model.predict(fitted, seen, start, end))
                weights = model.importance(fitted, seen)
            else:
                parts[k].append(forecast.baseline_forecast(own, start, end, winner, b.s))
    out = {}
    for k, frames in parts.items():
        frame = once(forecast.combine(*frames).join(b.classes, "sku_id"), ["sku_id", "date"], k)
        out[k] = settled(frame, {"a forecast is missing": F.col("forecast").isNull(), "forecast must be nonnegative": F.col("forecast") < 0})  # counted while it is written
        if out[k].isEmpty():
            raise ValueError(f"no {k} forecast")
    out["model_choice"] = spark.createDataFrame(choices, "intervention string, model string")
    out["best_params"] = spark.createDataFrame([(json.dumps(chosen_params, sort_keys=True),)], "params string")
    out["feature_importance"] = spark.createDataFrame(weights, "feature string, importance double")
    return out


def tables_of(spark: SparkSession, panel: DataFrame, settings: Settings, params: dict | None = None, trials: int = 8) -> dict[str, DataFrame]:
    """All tables of a run.  ``params`` are those of the boosted trees; without them they are tuned."""
    b = Book(spark, panel=panel, settings=settings)
    contract.require_contract(b.panel)
    if b.skus.isEmpty():
        raise ValueError("no class needs an intervention")
    made = group_forecasts(b, params, trials)
    b.calibration, b.final_forecast = made["calibration"], made["final"]
    contract.require_forecast(b.calibration, b.w.calibration_start, b.w.calibration_end, b.w.final_start)
    contract.require_schedule(b.final_forecast, b.w.final_start)
    uncertainty.require_same_demand(b.old_trace.join(b.chosen.select("sku_id"), "sku_id", "left_semi"), b.new_trace)
    full = report.policy_row(b.old_metric, "current").unionByName(report.policy_row(report.full_portfolio(b.new_metric, b.old_metric), "proposed"))
    return {
        "inventory_processed": b.panel, "sku_class": b.classes, "sku_metric": b.metric, "optimization_scope": b.scope.drop("doi_cut"), "class_summary": report.class_summary(b.metric, b.classes),
        "model_choice": made["model_choice"], "best_params": made["best_params"], "feature_importance": made["feature_importance"], "validation_forecast": b.calibration, "forecast": b.final_forecast,
        "forecast_metrics": forecast.hierarchy_metrics(b.final_forecast.drop("class"), b.classes, b.panel, settings),
        "policy_candidate_audit": b.audit, "policy_sku": b.chosen, "old_policy_metric": b.old_in_scope, "new_policy_metric": b.new_metric, "policy_sensitivity": uncertainty.cost_sensitivity(b.old_in_scope, b.new_metric, settings),
        "historical_policy_sensitivity": report.policy_sensitivity_rows(b.recorded, b.old_metric, b.inferred, b.inferred_metric), "policy_action": b.actions, "full_policy_summary": full,
        "scenario_uncertainty": b.stress, "policy_uncertainty": uncertainty.policy_bootstrap(b.old_in_scope, b.new_metric, seed=settings.seed, kind=settings.draws),
    }


def _row(df: DataFrame) -> dict:
    return df.first().asDict()


def run_summary(b: Book, tables: dict[str, DataFrame]) -> dict:
    """What a run was and found, from its written tables: each is a row or a few."""
    s, w = b.s, b.s.windows
    portfolio = tables["forecast_metrics"].filter("level = 'portfolio'").first()
    savings = tables["policy_sensitivity"].agg(F.count("*").alias("scenario_count"), F.avg((F.col("cost_saving") > 0).cast("int")).alias("positive_share"), F.min("cost_saving").alias("least_saving"), F.max("cost_saving").alias("most_saving"))
    stress = tables["scenario_uncertainty"]
    total = lambda name: tables[name].agg(F.sum("total_cost").alias("cost"), (F.sum("total_sales") / F.sum("total_demand")).alias("fill")).first()
    old, new = total("old_policy_metric"), total("new_policy_metric")
    return {
        "run_id": datetime.now(timezone.utc).isoformat(), "status": "validated_pipeline_run", "windows": {f.name: getattr(w, f.name) for f in fields(w)},
        "settings": {f.name: getattr(s, f.name) for f in fields(s) if f.name != "windows"}, "provenance": provenance(),
        "model_selection": {r.intervention: r.model for r in tables["model_choice"].collect()}, "optimization_scope": {"segments": [r.asDict() for r in tables["optimization_scope"].filter("intervention is not null").select("class", "intervention").orderBy("class").collect()], **_row(report.scope_coverage(tables["inventory_processed"].filter(F.col("date") < F.lit(w.final_start)), tables["sku_class"], tables["optimization_scope"]))},
        "forecast_portfolio": {k: portfolio[k] for k in ("mae", "rmse", "wape", "bias", "mase", "rmsse")},
        "simulation_portfolio": {"old_total_cost": old["cost"], "new_total_cost": new["cost"], "old_fill_rate": old["fill"], "new_fill_rate": new["fill"], "paired_sku_bootstrap": [r.asDict() for r in tables["policy_uncertainty"].collect()], "cost_sensitivity": _row(savings), "stress": {"scenario_count": stress.count(), "quantiles": [r.asDict() for r in uncertainty.stress_quantiles(stress).collect()]}},
        "full_portfolio_simulation": [r.asDict() for r in tables["full_policy_summary"].collect()],
    }


def run(spark: SparkSession, panel: DataFrame, out_dir: str, settings: Settings, params: dict | None = None, trials: int = 8) -> DataFrame:
    """Compute and write all tables and a summary of the run; returns the manifest."""
    manifest = write_artifacts(spark, tables_of(spark, panel, settings, params, trials), out_dir, TABLES)
    written = {name: spark.read.parquet(f"{out_dir}/{name}") for name in TABLES}
    write_run(spark, run_summary(Book(spark, panel=None, settings=settings), written), out_dir)
    return manifest


def open_run(spark: SparkSession, path: str, mode: str = "report") -> dict[str, DataFrame]:
    """``pipeline``: the raw panel at ``path`` once its contract holds; ``report``: the tables of a run that is whole.

    Either fails with all that is wrong, so nothing is computed from or shown of broken data.
    """
    if mode == "pipeline":
        return {"inventory_processed": contract.require_contract(read_panel(spark, path))}
    if mode == "report":
        return open_artifacts(spark, path, TABLES, tuple(name for name in TABLES if name not in MAY_BE_EMPTY))
    raise ValueError(f"unknown mode {mode!r}")
