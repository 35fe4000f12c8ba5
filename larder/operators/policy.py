"""Reorder policies: safety stock from residuals, recorded and inferred policies, and the grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.config import Settings
from larder.functions.exprs import at_least_zero, round_up
from larder.functions.stored import settled
from larder.operators.simulate import daily_paths, initial_inventory, priced, quantile_of, refused, run_totals, whole_lead_time


def _lookup(values: dict[str, float], by: str) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for k, v in values.items() for x in (k, float(v))]), F.col(by))


def _target(settings: Settings) -> Column:
    """Service target in percent: by class, else by intervention."""
    return F.coalesce(_lookup(settings.service_by_class, "class"), _lookup(settings.service_by_intervention, "intervention"))


def sku_medians(panel: DataFrame, settings: Settings) -> DataFrame:
    """Medians of what was recorded before the final window."""
    before = panel.filter(F.col("date") < F.lit(settings.windows.final_start))
    cols = ("lead_time", "unit_cost", "unit_price", "order_quantity", "reorder_point", "safety_stock")
    return before.groupBy("sku_id").agg(*[F.median(c).alias(c) for c in cols])


def residual_sums(forecast: DataFrame, medians: DataFrame) -> DataFrame:
    """Per SKU: mean forecast, error figures, and the sorted sums of residuals over the lead time.

    Residuals are demand less forecast; a sum needs a full lead time of days.
    """
    error = F.col("forecast") - F.col("demand")
    each = forecast.groupBy("sku_id").agg(
        F.sqrt(F.avg(error * error)).alias("rmse"), F.avg("forecast").alias("mean_forecast"), F.avg(error).alias("bias"),
        F.array_sort(F.collect_list(F.struct("date", (-error).alias("r")))).alias("days"),
    ).join(medians, "sku_id")
    r, lead = F.col("days.r"), whole_lead_time(["sku_id"]).cast("int")
    sums = F.when(F.size(r) >= lead, F.transform(F.sequence(lead, F.size(r)), lambda i: F.aggregate(F.slice(r, i - lead + 1, lead), F.lit(0.0), lambda s, x: s + x))).otherwise(F.array().cast("array<double>"))
    return each.withColumn("sums", F.array_sort(sums)).drop("days")


def _spread(values: Column) -> Column:
    mean = F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values)
    return F.when(F.size(values) > 1, F.sqrt(F.aggregate(values, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / (F.size(values) - 1)))


def scope_of(classes: DataFrame, scope: DataFrame) -> DataFrame:
    """(sku_id, class, intervention) of the SKUs to optimise."""
    return classes.join(F.broadcast(scope.select("class", "intervention")), "class").select("sku_id", "class", "intervention")  # nine classes at most


def policy_params(forecast: DataFrame, panel: DataFrame, scope: DataFrame, settings: Settings) -> DataFrame:
    """Per SKU in scope: service target, safety stock and reorder point from the calibration residuals."""
    each = residual_sums(forecast, sku_medians(panel, settings)).join(scope, "sku_id").withColumn("target", _target(settings))
    ss = at_least_zero(quantile_of(F.col("sums"), F.col("target") / 100))
    each = each.withColumns({"lead_error_std": _spread(F.col("sums")), "n_lead_errors": F.size("sums").cast("long"), "safety_stock": ss})
    need = F.when(F.col("target").isNull(), F.raise_error(F.lit("no service target for a class or intervention")).cast("double")).otherwise(F.col("mean_forecast") * F.col("lead_time") + F.col("safety_stock"))
    return each.withColumn("rop", need).drop("reorder_point")


RECORDED = ("sku_id", "reorder_point", "order_quantity", "lead_time", "unit_cost", "unit_price")


def _within(column: str, least: float, above: bool, context: str) -> Column:
    """The column, or an error that names the SKU where it isn't finite or is below its least value."""
    value = F.col(column).cast("double")
    low = value > least if above else value >= least
    says = F.concat(F.lit(f"{context}: {column} must be finite and {'positive' if above else 'nonnegative'}; affected: "), F.col("sku_id"))
    return refused(~F.coalesce(low & (value < float("inf")), F.lit(False)), says, value)


def historical_policy(panel: DataFrame, settings: Settings, targets: DataFrame | None = None) -> DataFrame:
    """The recorded policy: medians before the final window.

    Lead times must be positive whole days, reorder points not negative and quantities
    positive; ``targets`` (sku_id) must all have rows before the window.  The error
    names the SKU.
    """
    if missing := sorted(set(RECORDED) - set(panel.columns)):
        raise ValueError(f"the recorded policy is missing columns: {missing}")
    found = sku_medians(panel, settings)
    if targets is not None:
        found = targets.select("sku_id").distinct().join(found.withColumn("_there", F.lit(True)), "sku_id", "left")
        absent = F.concat(F.lit("the recorded policy has no rows before the final window for "), F.col("sku_id"))
        found = found.withColumn("lead_time", refused(F.col("_there").isNull(), absent, F.col("lead_time"))).drop("_there")
    return recorded(found)


def recorded(found: DataFrame) -> DataFrame:
    """One row of recorded numbers a SKU, checked; its reorder point is named as a policy's."""
    checked = {"lead_time": whole_lead_time(["sku_id"]).cast("double"), "reorder_point": _within("reorder_point", 0, False, "recorded policy"), "order_quantity": _within("order_quantity", 0, True, "recorded policy")}
    return found.withColumns(checked).withColumnRenamed("reorder_point", "rop")


def inferred_policy(panel: DataFrame, settings: Settings) -> DataFrame:
    """The policy that receipts show: their median size, and the inventory when they were ordered."""
    before = panel.filter(F.col("date") < F.lit(settings.windows.final_start))
    base = sku_medians(panel, settings)
    receipts = before.filter("order_received > 0").select("sku_id", "date", "order_received")
    ordered = receipts.join(base.select("sku_id", "lead_time"), "sku_id").select("sku_id", F.date_sub("date", F.col("lead_time").cast("int")).alias("date")).distinct()
    at_order = ordered.join(before.select("sku_id", "date", "inventory_level"), ["sku_id", "date"]).groupBy("sku_id").agg(F.median("inventory_level").alias("r"))
    size = receipts.groupBy("sku_id").agg(F.median("order_received").alias("q"))
    low = before.groupBy("sku_id").agg(F.percentile("inventory_level", F.lit(0.2)).alias("low"))
    found = base.join(size, "sku_id", "left").join(at_order, "sku_id", "left").join(low, "sku_id")
    return found.select("sku_id", "lead_time", "unit_cost", "unit_price", F.coalesce("q", "order_quantity").alias("order_quantity"), F.coalesce("r", "low").alias("rop"), "safety_stock")


def with_constraint(skus: DataFrame, panel: DataFrame, column: str, default: float, settings: Settings) -> DataFrame:
    """``skus`` with an order constraint: the median before the final window where the panel has the column, else a default."""
    if column not in panel.columns:
        return skus.withColumn(column, F.lit(float(default)))
    known = panel.filter(F.col("date") < F.lit(settings.windows.final_start)).groupBy("sku_id").agg(F.median(column).alias("_median"))
    checked = F.when(F.col("_median") > 0, F.col("_median")).otherwise(F.raise_error(F.concat(F.lit(f"{column} must be positive for every SKU; affected: "), F.col("sku_id"))).cast("double"))
    return skus.join(known, "sku_id", "left").withColumn(column, checked).drop("_median")


def grid_candidates(forecast: DataFrame, panel: DataFrame, scope: DataFrame, settings: Settings, least: float = 1.0, multiple: float = 1.0) -> DataFrame:
    """One row for each SKU, quantity multiplier and quantile (those of the settings and the SKU's own target).

    Orders keep to a least quantity and a multiple: the panel's columns ``moq`` and
    ``order_multiple`` give them by SKU, otherwise they are the same for all.
    """
    for x in settings.reorder_quantiles:
        if not 0 < x < 1:
            raise ValueError("quantiles must lie between 0 and 1")
    if not settings.quantity_multipliers or min(settings.quantity_multipliers) <= 0:
        raise ValueError("quantity multipliers must be positive")
    each = residual_sums(forecast, sku_medians(panel, settings)).join(scope, "sku_id").withColumn("target", _target(settings))
    quantiles = F.array_distinct(F.concat(F.array(*map(F.lit, sorted(set(settings.reorder_quantiles)))), F.array(F.col("target") / 100)))
    each = each.withColumn("q_multiplier", F.explode(F.array(*map(F.lit, sorted(set(settings.quantity_multipliers)))))).withColumn("quantile", F.explode(quantiles))
    ss = at_least_zero(quantile_of(F.col("sums"), F.col("quantile")))
    each = with_constraint(with_constraint(each, panel, "moq", least, settings), panel, "order_multiple", multiple, settings)
    each = each.withColumns({"order_quantity": round_up(F.col("order_quantity") * F.col("q_multiplier"), F.col("moq"), F.col("order_multiple")), "safety_stock": ss})
    return each.withColumn("rop", F.col("mean_forecast") * F.col("lead_time") + F.col("safety_stock")).drop("sums", "reorder_point")


def service_floor(settings: Settings) -> Column:
    """The least fill rate of a row's intervention, or its service target where settings name no floors at all.

    An intervention that is left out where others have floors is an error, and so is a
    floor that is no share.
    """
    if not settings.floor_by_intervention:
        floor = F.col("target") / 100
    else:
        floor = _lookup(settings.floor_by_intervention, "intervention")
        floor = refused(floor.isNull(), F.concat(F.lit("no service floor for the intervention "), F.coalesce("intervention", F.lit("(none)"))), floor)
    return refused(F.isnan(floor) | (floor < 0) | (floor > 1), "a service floor must lie between 0 and 1", floor)


def policy_grid(forecast: DataFrame, panel: DataFrame, scope: DataFrame, settings: Settings, least: float = 1.0, multiple: float = 1.0) -> DataFrame:
    """Every candidate simulated on the calibration window, with cost, service and feasibility.

    Candidates of a SKU with equal quantity and safety stock are simulated once.
    """
    w = settings.windows
    candidates = grid_candidates(forecast, panel, scope, settings, least, multiple)
    keys = ["sku_id", "order_quantity", "safety_stock"]
    distinct = candidates.dropDuplicates(keys).select(*keys, "lead_time", "rop", "unit_cost", "unit_price", "class")
    paths = daily_paths(forecast.select("sku_id", "date", "demand"), ["sku_id"], forecast)
    totals = settled(run_totals(paths, distinct, initial_inventory(panel, w.calibration_start), keys, dynamic=True))
    metric = priced(totals, distinct, keys, settings.ordering_cost, settings.holding_rate, settings.shortage_multiplier).drop("class")
    out = candidates.join(metric, keys).withColumn("service_floor", service_floor(settings))
    return out.withColumn("service_floor_met", F.col("fill_rate") >= F.col("service_floor"))


def selected_policy(audit: DataFrame, require_feasible: bool = False) -> DataFrame:
    """The cheapest feasible candidate of each SKU, or where there is none the one with the best service."""
    ok = F.coalesce(F.col("service_floor_met"), F.lit(False))
    order = [F.desc(ok), F.when(ok, F.col("total_cost")), F.when(ok, F.col("avg_inventory")), F.desc("fill_rate"), "total_cost", "avg_inventory", "q_multiplier", "quantile"]
    best = audit.withColumn("_rank", F.row_number().over(Window.partitionBy("sku_id").orderBy(*order))).filter("_rank = 1").drop("_rank")
    if require_feasible and not best.filter(~ok).isEmpty():
        raise ValueError("a SKU has no feasible candidate")
    return best.withColumn("selection_status", F.when(ok, "minimum_cost_feasible").otherwise("no_feasible_candidate_best_service"))
