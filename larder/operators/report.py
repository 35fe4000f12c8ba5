"""Reports: portfolio and class summaries, exploration, and the ranked actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.exprs import ratio, valid_number
from larder.functions.ordered import grouped_quantiles, numbered, quantiles
from larder.operators.joins import checked_join

COSTS = ("stockout_cost", "holding_cost", "ordering_cost", "total_cost")


def policy_row(metric: DataFrame, label: str) -> DataFrame:
    """One row of sums for a policy over its SKUs."""
    s = {c: F.sum(c).alias(c) for c in ("total_demand", "total_sales", "total_lost", "avg_inventory", *COSTS)}
    return metric.agg(F.lit(label).alias("policy_label"), F.count("*").alias("n_sku"), *s.values(), ratio(F.sum("total_sales"), F.sum("total_demand")).alias("fill_rate"), ratio(F.sum("cycles_without_stockout"), F.sum("num_cycles")).alias("cycle_service_level"))


def full_portfolio(new: DataFrame, all_current: DataFrame) -> DataFrame:
    """The new policy where there is one, the recorded one for all other SKUs."""
    return new.unionByName(all_current.join(new.select("sku_id"), "sku_id", "left_anti"), allowMissingColumns=True)


def policy_sensitivity_rows(recorded: DataFrame, recorded_metric: DataFrame, inferred: DataFrame, inferred_metric: DataFrame) -> DataFrame:
    """The recorded policy and the one that receipts show: sums, mean and median reorder point."""
    rows = []
    for label, runs, metric in (("recorded", recorded, recorded_metric), ("inferred", inferred, inferred_metric)):
        point = runs.select("sku_id", F.col("rop").cast("double").alias("rop"))
        rows.append(policy_row(metric, label).crossJoin(point.agg(F.avg("rop").alias("mean_rop"))).crossJoin(quantiles(point, "rop", "sku_id", {"median_rop": 0.5})))  # one row each
    return rows[0].unionByName(rows[1])


def policy_by_class(old: DataFrame, new: DataFrame) -> DataFrame:
    """Per class: both policies side by side, rates as ratios of sums."""
    def side(metric: DataFrame, p: str) -> DataFrame:
        return metric.groupBy("class").agg(
            *[F.sum(c).alias(f"{p}_{c}") for c in ("total_demand", "total_sales", "total_lost", "avg_inventory", "total_cost")], ratio(F.sum("total_sales"), F.sum("total_demand")).alias(f"{p}_fill_rate"), F.count("*").alias(f"{p}_n_sku"),
        )

    return side(old, "old").join(side(new, "new"), "class", "left").withColumns({
        "fill_delta_pp": (F.col("new_fill_rate") - F.col("old_fill_rate")) * 100, "inventory_change_pct": (ratio(F.col("new_avg_inventory"), F.col("old_avg_inventory")) - 1) * 100, "cost_change_pct": (ratio(F.col("new_total_cost"), F.col("old_total_cost")) - 1) * 100,
    })


def class_summary(metric: DataFrame, classes: DataFrame) -> DataFrame:
    """Per class: fill as ratio of sums, lost sales and cover as plain means."""
    rows = checked_join(metric, classes, ["sku_id"])
    return rows.groupBy("class").agg(F.count("*").alias("n_sku"), F.sum("total_demand").alias("total_demand"), F.sum("avg_inventory").alias("avg_inventory"), ratio(F.sum("total_sales"), F.sum("total_demand")).alias("fill_rate"), F.avg("lost_sales").alias("lost_sales"), F.avg("doi").alias("doi"))


def portfolio_kpis(metric: DataFrame, medians: DataFrame, slow_days: float = 60.0, risk_fill: float = 0.95) -> DataFrame:
    rows = checked_join(metric, medians.select("sku_id", "unit_cost"), ["sku_id"], "left")
    value = F.sum(F.col("avg_inventory") * F.col("unit_cost"))
    return rows.agg(
        F.count("*").alias("n_sku"), value.alias("inventory_value"), ratio(F.sum("avg_inventory"), F.sum("daily_demand")).alias("doi"), ratio(F.sum(F.col("daily_demand") * 365 * F.col("unit_cost")), value).alias("value_turns"),
        F.count_if(F.col("doi") > slow_days).alias("slow_moving"), F.count_if(F.col("fill_rate") < risk_fill).alias("at_risk"), ratio(F.sum("total_sales"), F.sum("total_demand")).alias("fill_rate"),
    )


def portfolio_summary(panel: DataFrame, before) -> DataFrame:
    """One row over the days before the locked ones: SKUs, categories, days, demand, sales, lost demand and fill."""
    return panel.filter(F.col("date") < F.lit(before)).agg(
        F.countDistinct("sku_id").alias("n_sku"), F.countDistinct("category").alias("n_category"), F.countDistinct("date").alias("n_days"), F.sum("demand").alias("total_demand"),
        F.sum("sales_quantity").alias("total_sales"), F.sum(F.col("demand") - F.col("sales_quantity")).alias("lost_demand"), ratio(F.sum("sales_quantity"), F.sum("demand")).alias("fill_rate"),
    )


def partition_summary(panel: DataFrame, final_start) -> DataFrame:
    """Per part, open for choices or locked: first and last day, and rows."""
    part = F.when(F.col("date") < F.lit(final_start), "development").otherwise("locked")
    return panel.groupBy(part.alias("partition")).agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count("*").alias("n_rows"))


def sku_accuracy(metrics: DataFrame) -> DataFrame:
    """What the drill-down of a SKU shows, for every SKU of the hierarchy's metrics."""
    return metrics.filter("level = 'sku'").select(F.col("segment").alias("sku_id"), "class", "wape", "bias", "mase", "rmsse", "n_obs")


def forecast_of(forecast: DataFrame, sku_id: str) -> DataFrame:
    return forecast.filter(F.col("sku_id") == sku_id).orderBy("date")


def policy_of(policies: DataFrame, sku_id: str) -> DataFrame:
    """The policy of one SKU; an unknown SKU has none."""
    return policies.filter(F.col("sku_id") == sku_id)


def skus_of_class(classes: DataFrame, class_: str) -> DataFrame:
    return classes.filter(F.col("class") == class_).select("sku_id").orderBy("sku_id")


def favourable_share(stress: DataFrame, probability: str | None = None) -> DataFrame:
    """Share of scenarios that save cost, weighed by a column of probabilities if that is sound."""
    known = stress.filter("cost_saving is not null")
    saves = F.col("cost_saving") > 0
    plain = ratio(F.count_if(saves), F.count("*"))
    if probability is None:
        return known.agg(plain.alias("favourable"))
    p = valid_number(F.col(probability))
    sound = (F.count_if(p.isNull() | (p < 0)) == 0) & (F.sum(p) > 0)
    return known.agg(F.when(sound, ratio(F.coalesce(F.sum(F.when(saves, p)), F.lit(0.0)), F.sum(p))).otherwise(plain).alias("favourable"))


def uncertainty_estimate(bootstrap: DataFrame, metric: str, otherwise: float) -> DataFrame:
    """One row: the bootstrap's estimate of a metric, or another number where there is none."""
    return bootstrap.filter(F.col("metric") == metric).agg(F.coalesce(F.max("estimate"), F.lit(float(otherwise))).alias("estimate"))


def inventory_trend(panel: DataFrame) -> DataFrame:
    return panel.groupBy("date").agg(F.sum("inventory_level").alias("inventory_level"))


def inventory_value_by_class(metric: DataFrame, medians: DataFrame, classes: DataFrame) -> DataFrame:
    rows = metric.join(medians.select("sku_id", "unit_cost"), "sku_id").join(classes, "sku_id", "left")
    return rows.groupBy("class").agg(F.sum(F.col("avg_inventory") * F.col("unit_cost")).alias("inventory_value"), F.count("*").alias("n_sku"))


def top_inventory(metric: DataFrame, n: int = 10) -> DataFrame:
    return metric.orderBy(F.desc("avg_inventory"), "sku_id").limit(n)


def abc_xyz_matrix(classes: DataFrame) -> DataFrame:
    letters = classes.select(F.substring("class", 1, 1).alias("abc"), F.substring("class", 2, 1).alias("xyz"))
    return letters.groupBy("abc").pivot("xyz", ["X", "Y", "Z"]).count().na.fill(0)


def scope_coverage(panel: DataFrame, classes: DataFrame, scope: DataFrame) -> DataFrame:
    """How much of SKUs, demand and margin (not clipped here) the scope covers."""
    inside = F.col("intervention").isNotNull()
    margin = F.col("demand") * (F.col("unit_price") - F.col("unit_cost"))
    # a row for each SKU, whose number grows with the panel: Spark chooses the join by its size
    rows = panel.join(classes.join(F.broadcast(scope.select("class", "intervention")), "class", "left"), "sku_id")
    return rows.agg(
        F.countDistinct("sku_id").alias("n_sku"), F.countDistinct(F.when(inside, F.col("sku_id"))).alias("n_in_scope"),
        ratio(F.sum(F.when(inside, F.col("demand")).otherwise(0)), F.sum("demand")).alias("demand_coverage"), ratio(F.sum(F.when(inside, margin).otherwise(0.0)), F.sum(margin)).alias("margin_coverage"),
    )


def monthly_demand(panel: DataFrame) -> DataFrame:
    return panel.groupBy(F.trunc("date", "month").alias("month")).agg(F.sum("demand").alias("demand"), F.sum("sales_quantity").alias("sales_quantity"))


def month_seasonality(panel: DataFrame) -> DataFrame:
    return panel.groupBy(F.month("date").alias("month")).agg(F.avg("demand").alias("mean_demand"))


def category_summary(panel: DataFrame) -> DataFrame:
    return panel.groupBy("category").agg(F.countDistinct("sku_id").alias("n_sku"), F.sum("demand").alias("demand"), F.sum("sales_quantity").alias("sales_quantity"), F.avg("inventory_level").alias("mean_inventory"), ratio(F.sum("sales_quantity"), F.sum("demand")).alias("fill_rate"))


def intermittency(panel: DataFrame) -> DataFrame:
    """Per SKU: shares of days without demand and with lost sales, and days per demand day."""
    days = F.broadcast(panel.agg(F.countDistinct("date").alias("days")))
    each = panel.groupBy("sku_id").agg(F.avg((F.col("demand") == 0).cast("int")).alias("zero_rate"), F.avg((F.col("sales_quantity") < F.col("demand")).cast("int")).alias("censor_rate"), F.count_if(F.col("demand") > 0).alias("nonzero_days"))
    return each.crossJoin(days).withColumn("adi", ratio(F.col("days"), F.col("nonzero_days"))).drop("days")


def receipt_cadence(panel: DataFrame) -> DataFrame:
    """Per SKU: receipts, and the median days between them."""
    w = Window.partitionBy("sku_id").orderBy("date")
    rows = panel.filter("order_received > 0").select("sku_id", F.datediff("date", F.lag("date").over(w)).alias("gap"))
    return rows.groupBy("sku_id").agg(F.count("*").alias("events"), F.median("gap").alias("median_gap"))


def describe(metric: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, deviation, extremes and deciles of each column."""
    long = metric.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "measure", "value")
    each = long.groupBy("measure").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("least"), F.max("value").alias("most"))
    # a measure has a value for every SKU, so its quantiles are taken without a task that holds them all
    places = grouped_quantiles(long, ["measure"], "value", {"p10": 0.1, "p50": 0.5, "p90": 0.9})
    return each.join(F.broadcast(places), "measure", "left").select("measure", "n", "mean", "std", "least", "p10", "p50", "p90", "most")  # one row a measure


def slow_moving(metric: DataFrame, classes: DataFrame, days: float = 60.0) -> DataFrame:
    return metric.filter(F.col("doi") > days).join(classes, "sku_id", "left").select("sku_id", "class", "avg_inventory", "daily_demand", "doi").orderBy(F.desc("doi"), "sku_id")


def stockout_risk(metric: DataFrame, classes: DataFrame, fill: float = 0.95) -> DataFrame:
    return metric.filter(F.col("fill_rate") < fill).join(classes, "sku_id", "left").select("sku_id", "class", "total_demand", "lost_sales", "fill_rate").orderBy("fill_rate", "sku_id")


def model_mix(forecast: DataFrame) -> DataFrame:
    return forecast.groupBy("model").agg(F.countDistinct("sku_id").alias("n_sku"), F.count("*").alias("n_rows"))


def candidate_summary(audit: DataFrame) -> DataFrame:
    return audit.groupBy("sku_id").agg(F.count("*").alias("candidates"), F.sum(F.col("service_floor_met").cast("long")).alias("feasible"), F.min("total_cost").alias("least_cost"), F.max("fill_rate").alias("best_fill"))


def _changed(new: Column, old: Column) -> Column:
    return F.abs(new - old) > F.greatest(F.lit(1.0), F.abs(old) * 0.05)


def policy_action(selected: DataFrame, current: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Per SKU in scope: both policies, what changes, an action in words, and its rank by saving."""
    rows = selected.select("sku_id", "class", "intervention", "lead_time", F.col("order_quantity").alias("new_q"), F.col("rop").alias("new_rop"), F.col("safety_stock").alias("new_ss"), "selection_status", "service_floor")
    rows = checked_join(rows, current.select("sku_id", F.col("order_quantity").alias("old_q"), F.col("rop").alias("old_rop"), F.col("safety_stock").alias("old_ss")), ["sku_id"], validate="one_to_one")
    for p, metric in (("old", old), ("new", new)):
        rows = checked_join(rows, metric.select("sku_id", *[F.col(c).alias(f"{p}_{c}") for c in ("fill_rate", "avg_inventory", "total_cost", "total_lost")]), ["sku_id"], validate="one_to_one")
    delta = {"rop_delta": ("new_rop", "old_rop"), "q_delta": ("new_q", "old_q"), "ss_delta": ("new_ss", "old_ss"), "inventory_delta": ("new_avg_inventory", "old_avg_inventory"), "lost_delta": ("new_total_lost", "old_total_lost"), "expected_saving": ("old_total_cost", "new_total_cost"), "fill_delta": ("new_fill_rate", "old_fill_rate")}
    rows = rows.withColumns({k: F.col(a) - F.col(b) for k, (a, b) in delta.items()})
    rop = F.when(_changed(F.col("new_rop"), F.col("old_rop")), F.when(F.col("rop_delta") > 0, "raise ROP").otherwise("lower ROP"))
    quantity = F.when(_changed(F.col("new_q"), F.col("old_q")), F.when(F.col("q_delta") > 0, "raise Q").otherwise("lower Q"))
    words = F.coalesce(F.nullif(F.concat_ws(" + ", rop, quantity), F.lit("")), F.lit("Keep parameters / monitor"))
    action = F.when(F.col("selection_status") != "minimum_cost_feasible", "Review SLA/grid feasibility").otherwise(words)
    rows = rows.withColumns({"policy_mode": F.lit("dynamic_rop"), "action": action})
    return numbered(rows, [F.desc("expected_saving"), F.desc("fill_delta"), F.col("sku_id")], "priority")


def fallback_action(policy: DataFrame, medians: DataFrame) -> DataFrame:
    """The simpler rule where no action table is at hand: the reorder point alone decides."""
    rows = policy.select("sku_id", F.col("rop").alias("new_rop")).join(medians.select("sku_id", F.col("reorder_point").alias("old_rop")), "sku_id", "left")
    action = F.when(F.col("new_rop") - F.col("old_rop") > F.greatest(F.lit(1.0), F.abs("old_rop") * 0.05), "Increase ROP").when(F.col("old_rop") - F.col("new_rop") > F.greatest(F.lit(1.0), F.abs("old_rop") * 0.05), "Reduce ROP").otherwise("Hold / monitor")
    return rows.withColumn("action", action)


def fallback_table(policy: DataFrame, medians: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """The action table where none was written: recorded parameters against the policy's, both runs, and the rule of ``fallback_action``.

    Every SKU of the policy must have medians and both metrics, once; rows are ranked by saving, then by gain of fill.
    """
    rows = policy.select("sku_id", "class", F.col("target").alias("target_service_level"), F.col("safety_stock").alias("new_ss"), F.col("rop").alias("new_rop"), F.col("order_quantity").alias("new_q"))
    rows = checked_join(rows, medians.select("sku_id", F.col("reorder_point").alias("old_rop"), F.col("safety_stock").alias("old_ss"), F.col("order_quantity").alias("old_q"), "unit_cost"), ["sku_id"], validate="one_to_one")
    for p, metric in (("old", old), ("new", new)):
        rows = checked_join(rows, metric.select("sku_id", *[F.col(c).alias(f"{p}_{c}") for c in ("fill_rate", "avg_inventory", "total_cost")]), ["sku_id"], validate="one_to_one")
    delta = {"rop_delta": F.col("new_rop") - F.col("old_rop"), "ss_delta": F.col("new_ss") - F.col("old_ss"), "fill_delta_pp": (F.col("new_fill_rate") - F.col("old_fill_rate")) * 100, "inventory_delta": F.col("new_avg_inventory") - F.col("old_avg_inventory"), "expected_saving": F.col("old_total_cost") - F.col("new_total_cost")}
    rows = rows.withColumns(delta).withColumn("inventory_value_delta", F.col("inventory_delta") * F.col("unit_cost"))
    material = F.greatest(F.lit(1.0), F.abs("old_rop") * 0.05)
    rows = rows.withColumn("action", F.when(F.col("rop_delta") > material, "Increase ROP").when(F.col("rop_delta") < -material, "Reduce ROP").otherwise("Hold / monitor"))
    return numbered(rows, [F.desc("expected_saving"), F.desc("fill_delta_pp"), F.col("sku_id")], "priority")


def class_report(metric: DataFrame, classes: DataFrame) -> DataFrame:
    """Per class: SKUs and pooled fill rate, mean lost sales and cover, to three places; a half goes to the even digit."""
    rows = checked_join(metric, classes, ["sku_id"], "left").groupBy("class").agg(F.count("sku_id").alias("n_sku"), ratio(F.sum("total_sales"), F.sum("total_demand")).alias("fill_rate"), F.avg("lost_sales").alias("lost_sales"), F.avg("doi").alias("doi"))
    return rows.select("class", "n_sku", *[F.bround(c, 3).alias(c) for c in ("fill_rate", "lost_sales", "doi")])


def classes_in_both(old: DataFrame, new: DataFrame) -> DataFrame:
    """(class): those that both policies have SKUs of."""
    return old.select("class").intersect(new.select("class"))


def spread_of(scenarios: DataFrame, columns: list[str]) -> DataFrame:
    """(metric, least, p05, p50, p95, most) of each column over scenarios."""
    long = scenarios.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "metric", "value")
    return grouped_quantiles(long, ["metric"], "value", {"least": 0.0, "p05": 0.05, "p50": 0.5, "p95": 0.95, "most": 1.0})


def filtered_actions(actions: DataFrame, class_: str | None = None, action: str | None = None) -> DataFrame:
    """The ten columns of the action list, filtered."""
    rows = actions if class_ is None else actions.filter(F.col("class") == class_)
    rows = rows if action is None else rows.filter(F.col("action").contains(action))
    return rows.select("priority", "sku_id", "class", "intervention", "action", "old_rop", "new_rop", "old_q", "new_q", "expected_saving")
