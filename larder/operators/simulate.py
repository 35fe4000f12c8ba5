"""Daily lost-sales replenishment with a reorder point and a fixed order quantity.

One row holds one path (a SKU, perhaps of a scenario) with its days as arrays,
and the policies to run on it.  Tasks fold all runs of a batch together, day by
day, in numpy; the number of days in a window is fixed, so a row has bounded
size.  ``simulate`` returns each day, ``run_totals`` one row for each run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.exprs import ratio
from larder.operators.contract import not_whole_days

#: What a run needs besides its keys: days, and one row of policy.
POLICY = ["lead_time", "order_quantity", "rop", "safety_stock"]
#: What a run adds up to, besides its cycles.
SUMS = ("demand", "sales", "lost", "inventory", "orders")
#: Runs that a task folds together.
TOGETHER = 4096


def initial_inventory(panel: DataFrame, start) -> DataFrame:
    """(sku_id, initial_inventory): the last level before a day."""
    return panel.filter(F.col("date") < F.lit(start)).groupBy("sku_id").agg(F.max_by("inventory_level", "date").alias("initial_inventory"))


def next_targets(schedule: DataFrame) -> DataFrame:
    """(sku_id, date, target): the forecast of the next day, known at the end of this one."""
    return schedule.select("sku_id", F.date_sub("date", 1).alias("date"), F.col("forecast").cast("double").alias("target"))


def refused(fault: Column, says: Column | str, value: Column) -> Column:
    """``value``, or an error where ``fault`` holds; ``value``'s type must be a number's or an array's."""
    return F.when(fault, F.raise_error(F.lit(says) if isinstance(says, str) else says)).otherwise(value)


def daily_paths(daily: DataFrame, keys: list[str], schedule: DataFrame | None = None) -> DataFrame:
    """(keys, first, demand, target): each run's first day, and by day demand and the next day's forecast.

    Days must follow one another without gaps or doubles.
    """
    rows = daily.select(*keys, "date", F.col("demand").cast("double").alias("demand"))
    rows = rows.withColumn("target", F.lit(None).cast("double")) if schedule is None else rows.join(next_targets(schedule), ["sku_id", "date"], "left")
    paths = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("date", "demand", "target"))).alias("days"), F.count_if(F.col("date").isNull()).alias("undated"))
    calendar = F.sequence(F.col("days.date")[0], F.element_at("days.date", -1))
    broken = (F.col("undated") > 0) | ~F.coalesce(F.col("days.date") == calendar, F.lit(False))
    says = F.concat(F.lit("daily demand must contain one consecutive row per calendar day; affected: "), F.concat_ws(" ", *keys))
    return paths.select(*keys, F.col("days.date")[0].alias("first"), refused(broken, says, F.col("days.demand")).alias("demand"), F.col("days.target").alias("target"))


def whole_lead_time(keys: list[str]) -> Column:
    """The column lead_time as whole days; an error that names the run where it isn't a positive whole number."""
    says = F.concat(F.lit("lead_time must be a positive integer; affected: "), F.concat_ws(" ", *keys))
    return refused(not_whole_days(F.col("lead_time")), says, F.rint(F.col("lead_time").cast("double")).cast("long"))


def fold(wanted: np.ndarray, ahead: np.ndarray, sizes: np.ndarray, lead: np.ndarray, quantity: np.ndarray, rop: np.ndarray, safety: np.ndarray, start: np.ndarray, dynamic: np.ndarray) -> Iterator[dict[str, np.ndarray]]:
    """Day by day, what happens in all runs at once; days beyond a run's end are to be left out.

    Each day: receive, sell what there is (the rest is lost), then, but on the
    last day, order the fixed quantity if inventory and open orders are at or
    below the reorder point.  An order due after the end counts as open.
    """
    n, most = wanted.shape
    rows = np.arange(n)
    due = np.zeros((n, most + int(lead.max(initial=1)) + 1))
    inventory, open_orders = start.astype(float).copy(), np.zeros(n)
    for p in range(most):
        received = due[:, p].copy()
        inventory = inventory + received
        open_orders = open_orders - received
        sales = np.minimum(wanted[:, p], inventory)
        inventory = inventory - sales
        last = sizes - 1 <= p
        point = np.where(dynamic, ahead[:, p] * lead + safety, rop)
        if (np.isnan(point) & ~last).any():
            raise ValueError("the schedule has no forecast for the day after an order decision")
        point = np.where(last, np.nan, point)
        order = ~last & (inventory + open_orders <= point)
        due[rows[order], p + lead[order]] += quantity[order]
        open_orders = open_orders + np.where(order, quantity, 0)
        yield {"received": received, "sales_quantity": sales, "lost": wanted[:, p] - sales, "inventory": inventory, "inventory_position": inventory + open_orders, "rop_used": point, "order_placed": order}


def _square(lists: pa.ListArray, fill: float) -> tuple[np.ndarray, np.ndarray]:
    """Lists of numbers as rows of one array, and their sizes."""
    offsets = lists.offsets.to_numpy().astype(np.int64)
    sizes = np.diff(offsets)
    out = np.full((len(lists), int(sizes.max(initial=0))), fill)
    out[np.arange(out.shape[1]) < sizes[:, None]] = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).to_numpy(zero_copy_only=False)
    return out, sizes


def _numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.names.index(name)).to_numpy(zero_copy_only=False).astype(float)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Iterator[dict[str, np.ndarray]], np.ndarray, np.ndarray]]:
    """(runs, their days, demand, sizes) for at most TOGETHER runs at a time."""
    for batch in batches:
        for low in range(0, batch.num_rows, TOGETHER):
            part = batch.slice(low, TOGETHER)
            column = lambda name: part.column(part.schema.names.index(name))  # noqa: E731, B023
            wanted, sizes = _square(column("demand"), 0.0)
            ahead, _ = _square(column("target"), np.nan)
            dynamic = column("dynamic").to_numpy(zero_copy_only=False).astype(bool) & ~np.isnan(ahead).all(axis=1)
            yield part, fold(wanted, ahead, sizes, _numbers(part, "lead_time").astype(np.int64), _numbers(part, "order_quantity"), _numbers(part, "rop"), np.nan_to_num(_numbers(part, "safety_stock")), _numbers(part, "initial_inventory"), dynamic), wanted, sizes


def _runs(paths: DataFrame, policy: DataFrame, initial: DataFrame, keys: list[str], dynamic: bool) -> DataFrame:
    """One row for each row of ``policy``: its path and numbers; a policy without days or inventory is an error.

    Policies of one path are gathered first (a SKU's grid has a set size) and spread
    where the path lies, so days are not copied by the joins.
    """
    more = [c for c in POLICY if c not in keys]
    on = [k for k in keys if k in paths.columns]
    own = policy.select(*keys, *more).withColumn("lead_time", whole_lead_time(keys))
    each = [c for c in own.columns if c not in on]
    gathered = own.groupBy(*on).agg(F.collect_list(F.struct(*each)).alias("_each"))
    runs = gathered.join(paths, on, "left").join(initial, "sku_id", "left")
    says = F.concat(F.lit("no daily demand or no inventory before it for target SKU "), F.col("sku_id"))
    runs = runs.withColumn("demand", refused(F.col("demand").isNull() | F.col("initial_inventory").isNull(), says, F.col("demand")))
    runs = runs.select(*on, "first", "demand", "target", F.col("initial_inventory").cast("double").alias("initial_inventory"), F.explode("_each").alias("_one")).select(*on, "first", "demand", "target", "initial_inventory", "_one.*")
    return runs.select(*keys, "first", "demand", "target", "initial_inventory", "lead_time", *[F.col(c).cast("double").alias(c) for c in more if c != "lead_time"], F.lit(dynamic).alias("dynamic"))


_DAILY = ("received", "sales_quantity", "lost", "inventory", "inventory_position", "rop_used", "order_placed")


def simulate(paths: DataFrame, policy: DataFrame, initial: DataFrame, keys: list[str], dynamic: bool = False) -> DataFrame:
    """The trace of each run: one row a day.

    ``dynamic`` runs take the next day's forecast times lead time plus safety
    stock as reorder point; runs without any forecast fall back on ``rop``.
    Lead times must be positive whole days, and each policy needs its days.
    """
    runs = _runs(paths, policy, initial, keys, dynamic)
    kept = [*keys, "first", "initial_inventory", "demand"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, days, wanted, sizes in _chunks(batches):
            days = list(days)
            inside = np.arange(wanted.shape[1]) < sizes[:, None]
            offsets = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.stack([d[k] for d in days], axis=1)[inside].astype(float) if days else np.empty(0))) for k in _DAILY]
            yield pa.RecordBatch.from_arrays([part.column(part.schema.names.index(k)) for k in kept] + lists, [*kept, *_DAILY])

    kinds = dict(runs.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in kept), *(f"{k} array<double>" for k in _DAILY)])
    folded = runs.select(*dict.fromkeys([*kept, "target", *POLICY, "dynamic"])).mapInArrow(run, schema)
    trace = folded.select(*keys, "first", "initial_inventory", F.size("demand").alias("_n"), F.posexplode(F.arrays_zip("demand", *_DAILY)).alias("pos", "d"))
    last, date = F.col("pos") == F.col("_n") - 1, F.date_add("first", F.col("pos"))
    return trace.select(
        *keys, date.alias("date"), F.when(F.col("pos") == 0, F.col("initial_inventory")).alias("initial_inventory"), "d.received", "d.inventory", "d.inventory_position", F.when(~last, F.col("d.rop_used")).alias("rop_used"),
        F.when(~last, F.date_add(date, 1)).alias("forecast_target_date"), (~last).alias("order_decision_eligible"), "d.demand", "d.sales_quantity", "d.lost", F.col("d.order_placed").cast("int").alias("order_placed"),
    )


def _added_up(days: Iterator[dict[str, np.ndarray]], wanted: np.ndarray, sizes: np.ndarray) -> dict[str, np.ndarray]:
    """Sums and cycles of each run; a receipt opens a new cycle, which succeeds if nothing is lost in it."""
    n = len(sizes)
    out = {k: np.zeros(n) for k in SUMS}
    cycles, clean, lost_now, begun = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n, bool)
    for p, day in enumerate(days):
        inside = p < sizes
        ends = inside & begun & (day["received"] > 0)
        cycles += ends
        clean += ends & (lost_now == 0)
        lost_now[ends] = 0
        begun |= inside
        lost_now += np.where(inside, day["lost"], 0)
        for k, v in zip(SUMS, (wanted[:, p], day["sales_quantity"], day["lost"], day["inventory"], day["order_placed"]), strict=True):
            out[k] += np.where(inside, v, 0)
    return out | {"num_cycles": cycles + begun, "cycles_without_stockout": clean + (begun & (lost_now == 0)), "rows": sizes}


_TOTALS = [*((k, "double") for k in SUMS), ("num_cycles", "long"), ("cycles_without_stockout", "long"), ("rows", "long")]


def folded_totals(runs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, first, sums and cycles) of runs: keys, first, demand, target, initial_inventory, POLICY, dynamic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, days, wanted, sizes in _chunks(batches):
            found = _added_up(days, wanted, sizes)
            yield pa.RecordBatch.from_arrays([part.column(part.schema.names.index(k)) for k in (*keys, "first")] + [pa.array(found[k], pa.float64() if t == "double" else pa.int64()) for k, t in _TOTALS], [*keys, "first", *(k for k, _ in _TOTALS)])

    kinds = dict(runs.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in (*keys, "first")), *(f"{k} {t}" for k, t in _TOTALS)])
    return runs.select(*dict.fromkeys([*keys, "first", "demand", "target", "initial_inventory", *POLICY, "dynamic"])).mapInArrow(run, schema)


def run_totals(paths: DataFrame, policy: DataFrame, initial: DataFrame, keys: list[str], dynamic: bool = False) -> DataFrame:
    """What each run of ``simulate`` adds up to, without its days leaving the task."""
    return folded_totals(_runs(paths, policy, initial, keys, dynamic), keys)


def trace_totals(trace: DataFrame, keys: list[str]) -> DataFrame:
    """The same from a trace."""
    w = Window.partitionBy(*keys).orderBy("date")
    cycles = trace.withColumn("cycle", F.sum((F.col("received") > 0).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    each = cycles.groupBy(*keys, "cycle").agg(
        F.min("date").alias("first"), F.sum("demand").alias("demand"), F.sum("sales_quantity").alias("sales"), F.sum("lost").alias("lost"), F.sum("inventory").alias("inventory"), F.sum("order_placed").cast("double").alias("orders"), F.count("*").alias("rows"),
    )
    return each.groupBy(*keys).agg(F.min("first").alias("first"), *[F.sum(c).alias(c) for c in SUMS], F.count("*").alias("num_cycles"), F.count_if(F.col("lost") == 0).alias("cycles_without_stockout"), F.sum("rows").alias("rows"))


def require_costs(**rates: float) -> None:
    """Cost assumptions must be finite numbers, not below zero."""
    if invalid := [k for k, v in rates.items() if not np.isfinite(v) or v < 0]:
        raise ValueError(f"cost assumptions must be finite and nonnegative: {invalid}")


def days_of(totals: DataFrame) -> DataFrame:
    """One row: on how many days there was any run; runs of one first day and length count once."""
    spans = totals.select("first", "rows").distinct()
    return spans.select(F.explode(F.sequence("first", F.date_add("first", F.col("rows").cast("int") - 1))).alias("date")).agg(F.countDistinct("date").alias("days"))


def priced(totals: DataFrame, policy: DataFrame | None, keys: list[str], ordering_cost: float, holding_rate: float, shortage: float = 1.0, days: DataFrame | None = None) -> DataFrame:
    """Service and cost of each run, from its totals and the costs of ``policy`` (None: they are among the keys).

    ``days``: one row with the number of days; those of all runs unless given.
    """
    require_costs(ordering_cost=ordering_cost, holding_rate=holding_rate, stockout_cost_multiplier=shortage)
    days = days_of(totals) if days is None else days
    total = totals.select(*keys, F.col("demand").alias("total_demand"), F.col("sales").alias("total_sales"), F.col("lost").alias("total_lost"), (F.col("inventory") / F.col("rows")).alias("avg_inventory"), "cycles_without_stockout", "num_cycles", F.col("orders").cast("long").alias("orders"))
    if policy is not None:
        total = total.join(policy.select(*keys, *[c for c in ("class", "unit_cost", "unit_price") if c in policy.columns]), keys)
    priced = total.crossJoin(F.broadcast(days))  # one row
    margin = F.col("unit_price") - F.col("unit_cost")
    checked = F.when(margin >= 0, margin).otherwise(F.raise_error(F.lit("negative unit margin")).cast("double"))
    out = priced.withColumns({
        "fill_rate": ratio(F.col("total_sales"), F.col("total_demand")), "cycle_service_level": ratio(F.col("cycles_without_stockout"), F.col("num_cycles")),
        "turnover": ratio(F.col("total_demand"), F.col("avg_inventory")), "doi": ratio(F.col("avg_inventory"), ratio(F.col("total_demand"), F.col("days"))),
        "stockout_cost": F.col("total_lost") * checked * shortage, "holding_cost": F.col("avg_inventory") * F.col("unit_cost") * holding_rate * F.col("days") / 365, "ordering_cost": F.col("orders") * F.lit(float(ordering_cost)),
        # the same before rates, so that they can be priced anew
        "stockout_unit": F.col("total_lost") * checked, "holding_unit": F.col("avg_inventory") * F.col("unit_cost") * F.col("days") / 365,
    }).withColumn("total_cost", F.col("stockout_cost") + F.col("holding_cost") + F.col("ordering_cost"))
    return out.drop("days", "unit_cost", "unit_price")


def policy_metric(trace: DataFrame, policy: DataFrame, keys: list[str], ordering_cost: float, holding_rate: float, shortage: float = 1.0) -> DataFrame:
    """Service and cost of each run of a trace; days are those of the whole trace."""
    days = trace.agg(F.countDistinct("date").alias("days"))
    return priced(trace_totals(trace, keys), policy, keys, ordering_cost, holding_rate, shortage, days)


def quantile_of(values: Column, q: Column) -> Column:
    """Linear quantile of a sorted array, NULL if it is empty."""
    at = q * (F.size(values) - 1)
    low = F.floor(at).cast("int")
    a, b = F.get(values, low), F.get(values, F.ceil(at).cast("int"))
    return a + (b - a) * (at - low)
