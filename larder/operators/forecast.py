"""Rolling one-day-ahead forecasts: choosing a baseline, producing and scoring forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.config import Settings
from larder.functions.exprs import at_least_zero, ratio, wape
from larder.operators.features import BASELINES, baseline_forecasts
from larder.operators.joins import with_dimension


def candidate_table(frame: DataFrame, models: tuple[str, ...]) -> DataFrame:
    """(model, wape, mae, n_obs), best first; a missing score is worst, ties go by the order of ``models``."""
    long = frame.unpivot(["sku_id", "date", "demand"], list(models), "model", "forecast").filter("forecast is not null")
    scored = long.groupBy("model").agg(wape(F.col("demand"), F.col("forecast")).alias("wape"), F.avg(F.abs(F.col("demand") - F.col("forecast"))).alias("mae"), F.count("*").alias("n_obs"))
    rank = F.array_position(F.array(*map(F.lit, models)), F.col("model"))
    return scored.orderBy(F.asc_nulls_last("wape"), rank)


def require_no_gap(frame: DataFrame, model: str) -> None:
    if not frame.filter(F.col(model).isNull()).isEmpty():
        raise ValueError(f"{model} has no forecast for some rows")


def between(df: DataFrame, first, last, label: str = "window") -> DataFrame:
    """Rows of an inclusive window of days; an empty one is an error."""
    found = df.filter(F.col("date").between(F.lit(first), F.lit(last)))
    if found.isEmpty():
        raise ValueError(f"no rows in the {label}")
    return found


def date_folds(panel: DataFrame, settings: Settings) -> DataFrame:
    """(date, fold): the last selection days in contiguous folds."""
    w = settings.windows
    days = panel.filter(F.col("date").between(F.date_sub(F.lit(w.selection_end), w.selection_days - 1), F.lit(w.selection_end))).select("date").distinct()
    return days.withColumn("fold", F.ntile(w.folds).over(Window.orderBy("date")))  # one row a day


def pick_baseline(panel: DataFrame, settings: Settings) -> str:
    """The baseline with the least WAPE on the selection days of these SKUs."""
    w = settings.windows
    frame = baseline_forecasts(panel.filter(F.col("date") <= F.lit(w.selection_end)).select("sku_id", "date", "demand"), w.season)
    frame = frame.filter(F.col("date") > F.date_sub(F.lit(w.selection_end), w.selection_days))
    return candidate_table(frame, BASELINES).first()["model"]


def segments(classes: DataFrame, scope: DataFrame) -> DataFrame:
    """(sku_id, class, segment): the group that shares a model, an intervention's SKUs or else those of a class."""
    known = F.broadcast(scope.select("class", "intervention"))  # nine classes at most
    return classes.join(known, "class", "left").select("sku_id", "class", F.coalesce("intervention", "class").alias("segment"))


def baseline_winner(panel: DataFrame, groups: DataFrame, settings: Settings) -> DataFrame:
    """(segment, model, wape, n_obs, rank): all baselines of each segment's SKUs, best first."""
    w = settings.windows
    frame = baseline_forecasts(panel.filter(F.col("date") <= F.lit(w.selection_end)).select("sku_id", "date", "demand"), w.season)
    frame = with_dimension(frame.filter(F.col("date") > F.date_sub(F.lit(w.selection_end), w.selection_days)), groups.select("sku_id", "segment"), ["sku_id"])
    long = frame.unpivot(["segment", "demand"], list(BASELINES), "model", "forecast").filter("forecast is not null")
    scored = long.groupBy("segment", "model").agg(wape(F.col("demand"), F.col("forecast")).alias("wape"), F.count("*").alias("n_obs"))
    order = F.array_position(F.array(*map(F.lit, BASELINES)), F.col("model"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("segment").orderBy(F.asc_nulls_last("wape"), order)))


def baseline_forecast(panel: DataFrame, first, last, model: str, settings: Settings) -> DataFrame:
    """(sku_id, date, demand, forecast, model) of one baseline between two days, never below zero."""
    if model not in BASELINES:
        raise ValueError(f"unknown baseline {model!r}")
    frame = baseline_forecasts(panel.select("sku_id", "date", "demand"), settings.windows.season)
    frame = between(frame, first, last, "forecast window")
    return frame.select("sku_id", "date", "demand", at_least_zero(F.col(model)).alias("forecast"), F.lit(model).alias("model"))


def require_forecasts(frame: DataFrame) -> DataFrame:
    found = frame.agg(F.count("*").alias("n"), F.count("forecast").alias("has")).first()
    if not found["n"] or found["n"] != found["has"]:
        raise ValueError("a forecast is missing")
    return frame


def combine(*frames: DataFrame) -> DataFrame:
    """All forecasts as one table."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def forecast_metrics(forecast: DataFrame, by: str | None = None) -> DataFrame:
    """MAE, RMSE, WAPE, bias, NMAE and bias in percent, over all rows or by a column."""
    error = F.col("forecast") - F.col("demand")
    rows = forecast.filter("demand is not null and forecast is not null")
    found = (rows.groupBy(by) if by else rows.groupBy()).agg(
        F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"), wape(F.col("demand"), F.col("forecast")).alias("wape"), F.avg(error).alias("bias"), F.avg("demand").alias("_mean"), F.count("*").alias("n_obs"),
    )
    return found.withColumns({"nmae": ratio(F.col("mae"), F.col("_mean")), "bias_pct": ratio(F.col("bias"), F.col("_mean")) * 100}).drop("_mean")


def hierarchy_metrics(forecast: DataFrame, classes: DataFrame, panel: DataFrame, settings: Settings) -> DataFrame:
    """Metrics by SKU, class and portfolio.

    Pooled errors come from one aggregation over grouping sets; MASE and RMSSE of
    a class or the portfolio are plain means of its SKUs'.  Their scale is the
    naive error before the final window.
    """
    w = Window.partitionBy("sku_id").orderBy("date")
    step = F.col("demand") - F.lag("demand").over(w)
    past = panel.filter(F.col("date") < F.lit(settings.windows.final_start)).select("sku_id", step.alias("d"))
    scale = past.groupBy("sku_id").agg(F.avg(F.abs("d")).alias("mean_step"), F.avg(F.col("d") * F.col("d")).alias("mean_square"))
    error = F.col("forecast") - F.col("demand")
    rows = with_dimension(forecast.select("sku_id", "date", "demand", "forecast"), classes, ["sku_id"], "left").withColumns({"e": error, "class": F.coalesce("class", F.lit("unclassified"))})
    sets = [[F.col("sku_id"), F.col("class")], [F.col("class")], []]
    pooled = rows.groupingSets(sets, "sku_id", "class").agg(
        F.avg(F.abs("e")).alias("mae"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), wape(F.col("demand"), F.col("forecast")).alias("wape"), F.avg("e").alias("bias"), F.count("*").alias("n_obs"),
        F.grouping("sku_id").alias("g_sku"), F.grouping("class").alias("g_class"),
    )
    pooled = pooled.join(scale, "sku_id", "left")
    pooled = pooled.withColumns({"mase": ratio(F.col("mae"), F.col("mean_step")), "rmsse": ratio(F.col("rmse"), F.sqrt("mean_square"))})
    skus = pooled.filter("g_sku = 0")
    means = skus.rollup("class").agg(F.avg("mase").alias("m"), F.avg("rmsse").alias("r"), F.grouping("class").alias("g"))
    means = means.select(F.when(F.col("g") == 0, F.col("class")).otherwise("portfolio").alias("key"), "m", "r")
    level = F.when(F.col("g_sku") == 0, "sku").when(F.col("g_class") == 0, "class").otherwise("portfolio")
    named = pooled.withColumns({"level": level, "segment": F.when(F.col("g_sku") == 0, F.col("sku_id")).when(F.col("g_class") == 0, F.col("class")).otherwise("portfolio")})
    key = F.when(F.col("g_sku") == 1, F.col("segment"))
    out = named.withColumn("key", key).join(means, "key", "left")
    return out.select("level", "segment", F.when(F.col("g_class") == 0, F.col("class")).alias("class"), "mae", "rmse", "wape", "bias", F.coalesce("mase", "m").alias("mase"), F.coalesce("rmsse", "r").alias("rmsse"), "n_obs")
