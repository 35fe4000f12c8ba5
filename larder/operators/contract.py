"""Checks of the panel: each counts its violations; nothing is repaired."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: The columns that may not be below zero.
NOT_NEGATIVE = ["demand", "sales_quantity", "inventory_level", "order_received", "lead_time", "safety_stock", "reorder_point", "order_quantity", "unit_cost", "unit_price"]


class ContractError(ValueError):
    """The data break their contract."""


def _w() -> WindowSpec:
    return Window.partitionBy("sku_id").orderBy("date")


def not_whole_days(lead: Column) -> Column:
    """A lead time that is missing, not finite, not positive or not a whole number of days."""
    number = lead.try_cast("double")
    return ~F.coalesce((number > 0) & (number < float("inf")) & (F.abs(number - F.rint(number)) <= 1e-8), F.lit(False))


def _missing(df: DataFrame) -> Column:
    kinds = dict(df.dtypes)
    parts = [F.col(c).isNull() | (F.isnan(c) if kinds[c] in ("double", "float") else F.lit(False)) for c in df.columns]
    return reduce(lambda a, b: a | b, parts)


def contract_violations(panel: DataFrame) -> DataFrame:
    """(check_name, violations): one pass over the panel, dealt by SKU."""
    gap = F.datediff("date", F.lag("date").over(_w()))
    before = F.lag("inventory_level").over(_w())
    marked = panel.select(
        "*", F.count("*").over(_w().rangeBetween(0, 0)).alias("_same"), gap.alias("_gap"), before.alias("_before"), _missing(panel).alias("_missing"),
    )
    negative = reduce(lambda a, b: a | b, [F.col(c) < 0 for c in NOT_NEGATIVE])
    flow = F.col("_before") + F.col("order_received") - F.col("sales_quantity")
    checks = {
        "key_not_null": F.col("sku_id").isNull() | F.col("date").isNull(),
        "key_unique": F.col("_same") > 1,
        "no_missing_value": F.col("_missing"),
        "lead_time_whole_days": not_whole_days(F.col("lead_time")),
        "midnight": F.col("date").cast("timestamp") != F.date_trunc("day", F.col("date").cast("timestamp")),
        "continuous_calendar": F.col("_gap") != 1,
        "not_negative": negative,
        "sales_within_demand": F.col("sales_quantity") > F.col("demand"),
        "inventory_balance": F.col("inventory_level") != flow,
    }
    counts = marked.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in checks.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(k).alias("check_name"), F.col(k).alias("violations")) for k in checks])).alias("c")).select("c.*")


def require_contract(panel: DataFrame) -> DataFrame:
    """The panel itself, or an error that names the checks it fails and some bad lead times."""
    broken = {r.check_name: r.violations for r in contract_violations(panel).collect() if r.violations}
    if broken:
        shown = [r.lead_time for r in panel.filter(not_whole_days(F.col("lead_time"))).select("lead_time").limit(5).collect()] if "lead_time_whole_days" in broken else []
        names = broken | ({"duplicate SKU-date": broken["key_unique"]} if "key_unique" in broken else {})
        raise ContractError(f"violations: {names}" + (f"; lead times such as {shown}" if shown else ""))
    return panel


def calendar_audit(panel: DataFrame) -> DataFrame:
    """Per SKU: first and last day, rows, days, and the days there should be."""
    found = panel.groupBy("sku_id").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count("*").alias("n_rows"), F.countDistinct("date").alias("n_dates"))
    return found.withColumn("expected_days", (F.datediff("last_date", "first_date") + 1).cast("long"))


def inventory_balance(panel: DataFrame) -> DataFrame:
    """Per SKU: days checked, and the largest and total gap of the inventory equation."""
    gap = F.col("inventory_level") - (F.lag("inventory_level").over(_w()) + F.col("order_received") - F.col("sales_quantity"))
    return panel.select("sku_id", gap.alias("gap")).groupBy("sku_id").agg(F.count("gap").alias("days_checked"), F.max(F.abs("gap")).alias("largest_gap"), F.sum(F.abs("gap")).alias("total_gap"))


def require_forecast(frame: DataFrame, first, last, final_start) -> DataFrame:
    """A calibration forecast: inside its window, unique, finite, and without gaps per SKU."""
    number = lambda c: F.coalesce(F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf")), F.lit(True))
    gap = F.datediff("date", F.lag("date").over(_w()))
    marked = frame.withColumns({"_gap": gap, "_same": F.count("*").over(Window.partitionBy("sku_id", "date"))})
    found = marked.agg(
        F.count_if((F.col("date") < F.lit(first)) | (F.col("date") > F.lit(last)) | (F.col("date") >= F.lit(final_start))).alias("dates outside the configured window"),
        F.count_if(F.col("_same") > 1).alias("duplicate SKU-date"),
        F.count_if(number("demand") | number("forecast")).alias("values missing or not finite"),
        F.count_if(F.col("demand") < 0).alias("negative demand"),
        F.count_if((F.col("_gap") != 1) & (F.col("_same") == 1)).alias("gaps in the calendar"),
    ).first().asDict()
    if broken := {k: v for k, v in found.items() if v}:
        raise ContractError(f"calibration forecast: {broken}")
    return frame


def require_output(frame: DataFrame) -> DataFrame:
    """A forecast that is to be written: unique by SKU and date, and nonnegative."""
    found = frame.groupBy("sku_id", "date").agg(F.count("*").alias("n"), F.min("forecast").alias("least")).agg(F.max("n").alias("n"), F.min("least").alias("least")).first()
    if (found["n"] or 0) > 1:
        raise ContractError("duplicate SKU-date in forecast")
    if (found["least"] or 0) < 0:
        raise ContractError("forecast must be nonnegative")
    return frame


def require_schedule(schedule: DataFrame, final_start) -> DataFrame:
    """The three columns of a final schedule, after its checks; actual demand can't leak."""
    plan = schedule.select("sku_id", "date", F.col("forecast").cast("double").alias("forecast"))
    each = plan.groupBy("sku_id").agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count("*").alias("n"), F.countDistinct("date").alias("days"), F.count_if(F.col("forecast").isNull() | F.isnan("forecast") | (F.col("forecast") < 0) | (F.col("forecast") == float("inf"))).alias("bad"))
    found = each.agg(F.min("first").alias("first"), F.max("first").alias("late"), F.min("last").alias("last"), F.max("last").alias("end"), F.min("n").alias("least"), F.max("n").alias("most"), F.sum(F.col("n") - F.col("days")).alias("twice"), F.sum("bad").alias("bad")).first()
    if found["first"] is None or found["first"] != final_start:
        raise ContractError("the schedule must begin on the first day of the final window")
    if found["twice"] or found["bad"]:
        raise ContractError("the schedule has duplicate SKU-dates or values that are no finite nonnegative numbers")
    if found["late"] != found["first"] or found["last"] != found["end"] or found["least"] != found["most"]:
        raise ContractError("all SKUs must share one calendar")
    return plan
