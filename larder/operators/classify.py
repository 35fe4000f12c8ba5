"""ABC by economic value, XYZ by forecastability, and the classes to optimise."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.config import Settings
from larder.functions.exprs import demand_value, ratio
from larder.functions.ordered import quantiles, running_total
from larder.functions.stored import settled
from larder.operators.features import BASELINES, baseline_forecasts
from larder.operators.forecast import candidate_table, require_no_gap
from larder.operators.joins import checked_join, with_dimension
from larder.sources.series import place


def sku_value(panel: DataFrame, settings: Settings) -> DataFrame:
    before = panel.filter(F.col("date") < F.lit(settings.windows.calibration_start))
    return before.groupBy("sku_id").agg(F.sum(demand_value(panel.columns, settings.value_basis)).alias("value"))


def series_value(series: DataFrame, settings: Settings) -> DataFrame:
    """The same from series; days without sales add nothing."""
    early = F.filter("sales", lambda d: d["at"] < place(settings.windows.calibration_start))
    days = series.select("sku_id", "unit_price", "unit_cost", F.explode_outer(F.transform(early, lambda d: d["demand"].cast("long"))).alias("demand")).na.fill(0, ["demand"])
    return days.groupBy("sku_id").agg(F.sum(demand_value(days.columns, settings.value_basis)).alias("value"))


def classify_abc(panel: DataFrame, settings: Settings) -> DataFrame:
    """(sku_id, value, share, abc): the SKU that crosses a share belongs to the next class.

    The running share is summed range by range of value; ties go by sku_id.  The
    total economic value must be positive.
    """
    return abc_of(sku_value(panel, settings), settings)


def abc_of(values: DataFrame, settings: Settings) -> DataFrame:
    """The same from (sku_id, value)."""
    running = running_total(values, F.col("value"), [F.desc("value"), F.col("sku_id")], "_run", "_total")
    worthless = F.raise_error(F.lit("the total economic value must be positive")).cast("double")
    share = running.withColumn("share", F.when(F.col("_total") > 0, F.col("_run") / F.col("_total")).otherwise(worthless)).drop("_run", "_total")
    abc = F.when(F.col("share") <= settings.a_share, "A").when(F.col("share") <= settings.b_share, "B").otherwise("C")
    return share.withColumn("abc", abc)


def selection_frame(panel: DataFrame, settings: Settings) -> DataFrame:
    """Baselines on the last selection days."""
    w = settings.windows
    rows = baseline_forecasts(panel.filter(F.col("date") <= F.lit(w.selection_end)).select("sku_id", "date", "demand"), w.season)
    return rows.filter((F.col("date") >= F.lit(w.selection_start)) & (F.col("date") > F.date_sub(F.lit(w.selection_end), w.selection_days)))


def xyz_candidates(panel: DataFrame, settings: Settings) -> DataFrame:
    """(model, wape, mae, n_obs): each baseline on its own rows with a forecast, best first."""
    return candidate_table(selection_frame(panel, settings), BASELINES)


def classify_xyz(panel: DataFrame, settings: Settings) -> DataFrame:
    """(sku_id, mae, mean_demand, nmae, xyz) with the baseline that wins over the portfolio.

    SKUs without demand have no class.  X is up to the lower quantile, Y up to the upper.
    """
    return xyz_of(selection_frame(panel, settings), settings)


def xyz_of(frame: DataFrame, settings: Settings) -> DataFrame:
    """The same from the baselines on the selection days."""
    if frame.select("date").distinct().count() < settings.windows.selection_days:
        raise ValueError("too few selection days")
    winner = candidate_table(frame, BASELINES).first()["model"]  # one name out of three
    require_no_gap(frame, winner)
    each = frame.groupBy("sku_id").agg(F.avg(F.abs(F.col("demand") - F.col(winner))).alias("mae"), F.avg("demand").alias("mean_demand"))
    each = each.filter("mean_demand > 0").withColumn("nmae", ratio(F.col("mae"), F.col("mean_demand")))
    each = settled(each)
    cuts = quantiles(each, "nmae", "sku_id", {"low": settings.x_quantile, "high": settings.z_quantile})
    xyz = F.when(F.col("nmae") <= F.col("low"), "X").when(F.col("nmae") <= F.col("high"), "Y").otherwise("Z")
    return each.crossJoin(F.broadcast(cuts)).withColumn("xyz", xyz).drop("low", "high")  # one row of cuts


def abc_xyz(panel: DataFrame, settings: Settings) -> DataFrame:
    """(sku_id, class)."""
    return classes_of(sku_value(panel, settings), selection_frame(panel, settings), settings)


def classes_of(values: DataFrame, frame: DataFrame, settings: Settings) -> DataFrame:
    """The same from (sku_id, value) and the baselines on the selection days."""
    both = checked_join(abc_of(values, settings).select("sku_id", "abc"), xyz_of(frame, settings).select("sku_id", "xyz"), ["sku_id"], validate="one_to_one")
    return both.select("sku_id", F.concat("abc", "xyz").alias("class"))


def sku_metric(panel: DataFrame, observed_until=None) -> DataFrame:
    """Inventory, demand, sales, cover in days, fill rate, lost sales of totals, and variation."""
    seen = panel if observed_until is None else panel.filter(F.col("date") < F.lit(observed_until))
    each = seen.groupBy("sku_id").agg(
        F.avg("inventory_level").alias("avg_inventory"), F.sum("demand").alias("total_demand"), F.sum("sales_quantity").alias("total_sales"),
        F.countDistinct("date").alias("num_days"), F.avg("demand").alias("_mean"), F.stddev_samp("demand").alias("_std"),
    )
    each = each.withColumn("daily_demand", ratio(F.col("total_demand"), F.col("num_days")))
    return each.select(
        "sku_id", "avg_inventory", "total_demand", "total_sales", "num_days", "daily_demand", ratio(F.col("avg_inventory"), F.col("daily_demand")).alias("doi"),
        ratio(F.col("total_sales"), F.col("total_demand")).alias("fill_rate"), F.greatest(F.col("total_demand") - F.col("total_sales"), F.lit(0)).alias("lost_sales"), ratio(F.col("_std"), F.col("_mean")).alias("cv"),
    )


def class_scope(panel: DataFrame, classes: DataFrame, settings: Settings) -> DataFrame:
    """Per class: size, totals, fill, cover, its share of A value, and its intervention or NULL.

    An earlier reason wins: strategic value, then understock, then overstock.
    """
    before = with_dimension(panel.filter(F.col("date") < F.lit(settings.windows.calibration_start)), classes, ["sku_id"])
    lost = F.greatest(F.col("demand") - F.col("sales_quantity"), F.lit(0))
    each = before.groupBy("class").agg(
        F.countDistinct("sku_id").alias("n_sku"), F.sum("demand").alias("total_demand"), F.sum("sales_quantity").alias("total_sales"), F.sum(lost).alias("lost_sales"),
        F.countDistinct("date").alias("num_days"), F.sum(demand_value(panel.columns, settings.value_basis)).alias("value"),
    )
    daily = before.groupBy("class", "date").agg(F.sum("inventory_level").alias("i")).groupBy("class").agg(F.avg("i").alias("avg_inventory"))
    each = each.join(daily, "class", "left").withColumn("abc", F.substring("class", 1, 1))
    a_value = F.sum(F.when(F.col("abc") == "A", F.col("value"))).over(Window.partitionBy())  # one row per class, nine at most
    each = each.withColumns({
        "fill_rate": ratio(F.col("total_sales"), F.col("total_demand")),
        "doi": ratio(F.col("avg_inventory"), ratio(F.col("total_demand"), F.col("num_days"))),
        "a_share": F.when(F.col("abc") == "A", ratio(F.col("value"), a_value)),
    })
    cut = each.agg(F.percentile("doi", F.lit(settings.overstock_quantile)).alias("doi_cut"))
    each = each.crossJoin(F.broadcast(cut))
    reason = (
        F.when((F.col("abc") == "A") & (F.col("a_share") >= settings.strategic_share), "protect_strategic_value")
        .when((F.col("abc") == "C") & (F.col("fill_rate") < settings.understock_fill), "correct_understock")
        .when((F.col("fill_rate") >= settings.overstock_fill) & (F.col("doi") >= F.col("doi_cut")), "reduce_overstock")
    )
    return each.withColumn("intervention", reason)


def optimization_scope(panel: DataFrame, classes: DataFrame, settings: Settings) -> DataFrame:
    """The classes to optimise, each once."""
    return class_scope(panel, classes, settings).filter("intervention is not null")
