"""Cost sensitivity, stress scenarios and paired bootstrap.

Draws are of two kinds, and a rerun gives the same by either: ``pcg64`` is the one
sequence of numpy's generator, of which tasks draw their own stretches, scenario by
scenario and SKU by SKU; ``hash`` takes each draw from (seed, scenario, SKU, number)
alone, as SQL can too.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.config import Settings
from larder.functions.draws import resampled, scenario_draws
from larder.functions.exprs import percent_change, ratio
from larder.functions.ordered import numbered
from larder.functions.stored import settled
from larder.operators.joins import with_dimension
from larder.operators.simulate import POLICY, folded_totals, initial_inventory, priced, refused, require_costs, whole_lead_time

COSTS = ("stockout_cost", "holding_cost", "ordering_cost", "total_cost")


def hashed_unit(*parts: Column) -> Column:
    """A number from 0 to 1 that only depends on its parts: 32 bits of their MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def require_same_demand(old: DataFrame, new: DataFrame) -> None:
    """Both traces must hold the same keys with the same demand."""
    both = old.select("sku_id", "date", F.col("demand").alias("a")).join(new.select("sku_id", "date", F.col("demand").alias("b")), ["sku_id", "date"], "full")
    if not both.filter("a is null or b is null or abs(a - b) > 1e-8 + 1e-5 * abs(b)").isEmpty():
        raise ValueError("the policies were not simulated on the same demand")


def cost_sensitivity(old: DataFrame, new: DataFrame, settings: Settings) -> DataFrame:
    """Both policies repriced for each combination of costs.

    Costs are linear in their rates, so the metrics' unit costs are summed once
    and only scaled.
    """
    def total(metric: DataFrame, p: str) -> DataFrame:
        return metric.agg(
            F.sum("stockout_unit").alias(f"{p}_shortage_unit"), F.sum("holding_unit").alias(f"{p}_holding_unit"), F.sum("orders").alias(f"{p}_orders"),
            ratio(F.sum("total_sales"), F.sum("total_demand")).alias(f"{p}_fill_rate"), F.sum("avg_inventory").alias(f"{p}_avg_inventory"),
        )

    for name, rates in (("ordering_cost", settings.ordering_costs), ("holding_rate", settings.holding_rates), ("stockout_cost_multiplier", settings.shortage_multipliers)):
        for rate in rates:
            require_costs(**{name: rate})
    spark = old.sparkSession
    grid = [(o, h, m) for o in sorted(settings.ordering_costs) for h in sorted(settings.holding_rates) for m in sorted(settings.shortage_multipliers)]
    rows = spark.createDataFrame([(i + 1, *x) for i, x in enumerate(grid)], "number int, ordering_cost_rate double, holding_rate double, shortage_multiplier double")
    out = rows.crossJoin(total(old, "old")).crossJoin(total(new, "new"))  # one row each
    for p in ("old", "new"):
        out = out.withColumns({f"{p}_stockout_cost": F.col(f"{p}_shortage_unit") * F.col("shortage_multiplier"), f"{p}_holding_cost": F.col(f"{p}_holding_unit") * F.col("holding_rate"), f"{p}_ordering_cost": F.col(f"{p}_orders") * F.col("ordering_cost_rate")})
        out = out.withColumn(f"{p}_total_cost", sum((F.col(f"{p}_{c}") for c in COSTS[1:3]), F.col(f"{p}_{COSTS[0]}")))
    return out.select(
        F.format_string("cost_sensitivity_%03d", "number").alias("scenario_id"), "ordering_cost_rate", "holding_rate", "shortage_multiplier",
        *[f"{p}_{c}" for p in ("old", "new") for c in COSTS], (F.col("old_total_cost") - F.col("new_total_cost")).alias("cost_saving"),
        ((F.col("new_fill_rate") - F.col("old_fill_rate")) * 100).alias("fill_rate_delta_pp"), (F.col("new_avg_inventory") - F.col("old_avg_inventory")).alias("avg_inventory_delta"),
    )


def paired_policies(old: DataFrame, new: DataFrame) -> DataFrame:
    """(sku_id, lead_time, unit_cost, unit_price, old, new): both policies of each SKU, as structs.

    Both must have the same SKUs, once each, with the same positive whole lead time.
    """
    sides = []
    for p, policy in (("old", old), ("new", new)):
        own = policy.select("sku_id", whole_lead_time(["sku_id"]).alias(f"{p}_lead"), F.struct(*[F.col(c).cast("double").alias(c) for c in (*POLICY[1:], "unit_cost", "unit_price")]).alias(p))
        sides.append(own.groupBy("sku_id").agg(F.count("*").alias(f"{p}_rows"), F.first(f"{p}_lead").alias(f"{p}_lead"), F.first(p).alias(p)))
    both = sides[0].join(sides[1], "sku_id", "full")
    unpaired = F.col("old_rows").isNull() | F.col("new_rows").isNull() | (F.col("old_rows") > 1) | (F.col("new_rows") > 1)
    lead = refused(unpaired, F.concat(F.lit("a pair needs the same SKU set on both sides, one row per SKU; not so for "), F.col("sku_id")), F.col("old_lead"))
    lead = refused(F.col("old_lead") != F.col("new_lead"), F.concat(F.lit("stress needs pairs with the same base lead time for "), F.col("sku_id")), lead)
    return both.select("sku_id", lead.alias("lead_time"), "old", "new")


def _multipliers(settings: Settings, scenarios: int, units: np.ndarray | None) -> Column:
    """The lead-time multiplier of each scenario, from its number between 0 and 1 (None: a hash)."""
    cumulative = np.cumsum(np.asarray(settings.lead_probabilities, float))
    if units is not None:
        places = np.searchsorted(cumulative / cumulative[-1], units, side="right")
        return F.element_at(F.array(*[F.lit(float(settings.lead_multipliers[i])) for i in places]), F.col("scenario"))
    u, pick = hashed_unit(F.lit(settings.seed), F.col("scenario"), F.lit("lead")), F.lit(float(settings.lead_multipliers[-1]))
    for m, c in reversed(list(zip(settings.lead_multipliers, cumulative, strict=True))[:-1]):
        pick = F.when(u < float(c), F.lit(float(m))).otherwise(pick)
    return pick


def stress_paths(calibration: DataFrame, schedule: DataFrame, settings: Settings, scenarios: int | None = None, about: DataFrame | None = None) -> DataFrame:
    """(scenario, sku_id, lead_multiplier, first, demand, target, clipped): demand of each scenario.

    Demand is the forecast plus contiguous blocks of calibration residuals, never
    below zero.  A scenario draws one lead-time multiplier for all SKUs.  A SKU's
    row is spread over its scenarios where it lies, with what ``about`` has of it.
    """
    block, seed, count = settings.block_days, F.lit(settings.seed), scenarios or settings.scenarios
    history = calibration.groupBy("sku_id").agg(F.array_sort(F.collect_list(F.struct("date", (F.col("demand") - F.col("forecast")).cast("double").alias("r")))).alias("h"))
    history = history.select("sku_id", F.when(F.size("h") >= block, F.col("h.r")).otherwise(F.raise_error(F.lit("a SKU has fewer residuals than a block"))).alias("residuals"))
    plan = schedule.groupBy("sku_id").agg(F.array_sort(F.collect_list(F.struct("date", F.col("forecast").cast("double").alias("f")))).alias("plan"))
    numbers = schedule.sparkSession.range(1, count + 1).select(F.col("id").cast("int").alias("scenario"))
    each = plan.join(history, "sku_id", "left").withColumn("residuals", refused(F.col("residuals").isNull(), F.concat(F.lit("no calibration residuals for "), F.col("sku_id")), F.col("residuals")))
    each = each if about is None else about.join(each, "sku_id", "left")
    each = each.withColumn("plan", refused(F.col("plan").isNull(), F.concat(F.lit("no final forecast for "), F.col("sku_id")), F.col("plan")))
    n_blocks, last = F.ceil(F.size("plan") / block).cast("int"), F.size("residuals") - block + 1
    if settings.draws == "pcg64":
        each = settled(each)
        drawn, units = scenario_draws(each.select("sku_id", last.cast("long").alias("bound"), n_blocks.alias("n")), "sku_id", count, settings.seed)
        each = each.join(drawn.withColumnRenamed("drawn", "starts"), "sku_id")
        starts = F.element_at("starts", F.col("scenario"))
    else:
        units = None
        starts = F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda k: F.floor(hashed_unit(seed, F.col("scenario"), F.col("sku_id"), k) * last))
    runs = each.crossJoin(F.broadcast(numbers.withColumn("lead_multiplier", _multipliers(settings, count, units))))  # scenarios: a set number
    drawn = F.flatten(F.transform(starts, lambda s: F.slice(F.col("residuals"), s.cast("int") + 1, block)))
    raw = F.transform("plan", lambda d, i: d["f"] + F.get(F.col("drawn"), i))
    target = F.transform("plan", lambda d, i: F.get(F.col("plan"), i + 1)["f"])
    made = runs.withColumn("drawn", drawn).withColumn("raw", raw)
    more = [c for c in ([] if about is None else about.columns) if c != "sku_id"]
    return made.select("scenario", "sku_id", "lead_multiplier", F.col("plan.date")[0].alias("first"), F.transform("raw", lambda x: F.greatest(x, F.lit(0.0))).alias("demand"), target.alias("target"), F.size(F.filter("raw", lambda x: x < 0)).alias("clipped"), *more)


def stress_test(old: DataFrame, new: DataFrame, calibration: DataFrame, schedule: DataFrame, panel: DataFrame, settings: Settings, scenarios: int | None = None) -> DataFrame:
    """One row a scenario: both policies under the same demand and stressed lead time.

    The old policy keeps its reorder point, the new one follows the forecast.
    Both need the same SKUs and lead times.  Each SKU's scenarios are drawn and
    simulated in the task that has it; one row for each run leaves it.
    """
    about = paired_policies(old, new).join(initial_inventory(panel, settings.windows.final_start), "sku_id", "left")
    missing = F.concat(F.lit("no inventory before the final window for "), F.col("sku_id"))
    about = about.withColumn("initial_inventory", refused(F.col("initial_inventory").isNull(), missing, F.col("initial_inventory").cast("double")))
    paths = stress_paths(calibration, schedule, settings, scenarios, about)
    lead = F.greatest(F.lit(1), F.ceil(F.col("lead_time") * F.col("lead_multiplier"))).cast("long")
    sides = F.array(*[F.struct(F.lit(p).alias("side"), F.lit(dynamic).alias("dynamic"), F.col(p).alias("policy")) for p, dynamic in (("old", False), ("new", True))])
    runs = paths.withColumns({"lead_time": lead, "s": F.explode(sides)})
    keys = ["scenario", "lead_multiplier", "sku_id", "side", "clipped", "unit_cost", "unit_price"]
    runs = runs.select("scenario", "lead_multiplier", "sku_id", "s.side", "clipped", "s.policy.unit_cost", "s.policy.unit_price", "first", "demand", "target", "initial_inventory", "lead_time", *[f"s.policy.{c}" for c in POLICY[1:]], "s.dynamic")
    totals = folded_totals(runs, keys)
    spans = schedule.select(F.countDistinct("date").alias("days"))
    metric = priced(totals.drop("first"), None, keys, settings.ordering_cost, settings.holding_rate, settings.shortage_multiplier, spans)
    sums = [F.sum(F.when(F.col("side") == p, F.col(c))).alias(f"{p}_{c}") for p in ("old", "new") for c in ("total_demand", "total_sales", "total_lost", "avg_inventory", *COSTS)]
    out = metric.groupBy("scenario").agg(F.first("lead_multiplier").alias("lead_multiplier"), F.sum(F.when(F.col("side") == "old", F.col("clipped"))).alias("clipped_cells"), *sums)
    fill = lambda p: ratio(F.col(f"{p}_total_sales"), F.col(f"{p}_total_demand"))
    return out.withColumns({
        "scenario_id": F.format_string("policy_stress_%05d", "scenario"), "old_fill_rate": fill("old"), "new_fill_rate": fill("new"), "fill_rate_delta_pp": (fill("new") - fill("old")) * 100,
        "inventory_change_pct": percent_change(F.col("new_avg_inventory"), F.col("old_avg_inventory")), "cost_change_pct": percent_change(F.col("new_total_cost"), F.col("old_total_cost")), "cost_saving": F.col("old_total_cost") - F.col("new_total_cost"),
    }).drop("scenario")


def stress_quantiles(stress: DataFrame) -> DataFrame:
    """(metric, p05, p50, p95, favourable): favourable is the share of scenarios that save cost."""
    names = ("fill_rate_delta_pp", "inventory_change_pct", "cost_change_pct")
    long = stress.unpivot(["cost_saving"], list(names), "metric", "value")
    return long.groupBy("metric").agg(*[F.percentile("value", F.lit(q)).alias(f"p{int(q * 100):02d}") for q in (0.05, 0.5, 0.95)], (F.count_if(F.col("cost_saving") > 0) / F.count("*")).alias("favourable"))


def bootstrap_plan(spark, n: int, draws: int, seed: int, kind: str = "hash") -> DataFrame:
    """(draw, at): ``n`` places from 0 to n - 1 for each draw, with replacement.

    Each row is made in the task that uses it: by ``hash`` from its number alone, by
    ``pcg64`` from the task's stretch of the one sequence.
    """
    if kind == "pcg64":
        return resampled(spark, n, draws, seed)
    draw, pos = F.floor(F.col("id") / n).cast("int"), F.col("id") % n
    at = F.floor(hashed_unit(F.lit(seed), draw, pos) * n).cast("long")
    return spark.range(draws * n).select(draw.alias("draw"), at.alias("at"))


def policy_bootstrap(old: DataFrame, new: DataFrame, draws: int = 2000, seed: int = 42, kind: str = "hash") -> DataFrame:
    """(metric, estimate, ci_2_5, ci_97_5, n_bootstrap): SKUs resampled in pairs.

    Draws meet the SKUs' numbers by place; where those are small enough to be
    broadcast, sums are made in place and only one row for each draw and task moves.
    Both tables must have the same SKUs.
    """
    cols = ("total_sales", "total_demand", "avg_inventory", "total_cost")
    both = old.select("sku_id", *[F.col(c).alias(f"o_{c}") for c in cols]).join(new.select("sku_id", *[F.col(c).alias(f"n_{c}") for c in cols]), "sku_id", "full")
    alone = F.concat(F.lit("both policies must have metrics of the same SKUs; affected: "), F.col("sku_id"))
    both = both.withColumn("o_total_cost", refused(F.col("o_total_cost").isNull() | F.col("n_total_cost").isNull(), alone, F.col("o_total_cost")))
    sums = [F.sum(f"{p}_{c}").alias(f"{p}_{c}") for p in "on" for c in cols]

    def effects(df: DataFrame, *keep: str) -> DataFrame:
        fill = (ratio(F.col("n_total_sales"), F.col("n_total_demand")) - ratio(F.col("o_total_sales"), F.col("o_total_demand"))) * 100
        change = lambda c: percent_change(F.col(f"n_{c}"), F.col(f"o_{c}"))
        return df.select(*keep, fill.alias("fill_rate_delta_pp"), change("avg_inventory").alias("inventory_change_pct"), change("total_cost").alias("cost_change_pct"))

    names = ["fill_rate_delta_pp", "inventory_change_pct", "cost_change_pct"]
    placed = settled(numbered(both, [F.col("sku_id")], "_number").withColumn("at", F.col("_number") - 1).drop("_number", "sku_id"))
    drawn = with_dimension(bootstrap_plan(old.sparkSession, placed.count(), draws, seed, kind), placed, ["at"]).groupBy("draw").agg(*sums)
    spread = effects(drawn, "draw").unpivot(["draw"], names, "metric", "value").groupBy("metric").agg(F.percentile("value", F.lit(0.025)).alias("ci_2_5"), F.percentile("value", F.lit(0.975)).alias("ci_97_5"), F.count("*").alias("n_bootstrap"))
    point = effects(placed.agg(*sums)).unpivot([], names, "metric", "estimate")
    return point.join(spread, "metric")
