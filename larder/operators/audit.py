"""Audits of a run's tables: each is a table of checks with the rows, cells or keys that break them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.config import Settings
from larder.functions.stored import settled

#: What a class code looks like.
CLASS_CODE = "^[ABC][XYZ]$"


def _checks(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(check_name, violations) from one aggregation; a check holds an aggregate that counts what breaks it."""
    counted = df.agg(*[F.coalesce(c, F.lit(0)).cast("long").alias(f"c{i}") for i, c in enumerate(checks.values())])
    return counted.select(F.inline(F.array(*[F.struct(F.lit(k).alias("check_name"), F.col(f"c{i}").alias("violations")) for i, k in enumerate(checks)])))


def _not(holds: Column) -> Column:
    """How many rows don't hold; what is missing doesn't."""
    return F.count_if(~F.coalesce(holds, F.lit(False)))


def _repeats(df: DataFrame, key: str) -> Column:
    """Rows beyond the first of each key, missing ones included."""
    return F.count("*") - F.count_distinct(F.coalesce(F.col(key).cast("string"), F.lit("\0")))


def schema_audit(panel: DataFrame, schema: T.StructType) -> DataFrame:
    """(column, expected, actual, present, matches) for each column of the contract."""
    there = dict(panel.dtypes)
    rows = [(f.name, f.dataType.simpleString(), there.get(f.name), f.name in there, there.get(f.name) == f.dataType.simpleString()) for f in schema]
    return panel.sparkSession.createDataFrame(rows, "column string, expected string, actual string, present boolean, matches boolean")


def key_audit(**tables: DataFrame) -> DataFrame:
    """(dataset, n_rows, n_sku, missing_key_rows, duplicate_key_rows, missing_cells) of each panel.

    Keys are counted before rows are, so a key that many rows share is one row.
    """
    parts = []
    for name, df in tables.items():
        kinds = dict(df.dtypes)
        absent = lambda c: F.col(c).isNull() | F.isnan(c) if kinds[c] in ("double", "float") else F.col(c).isNull()  # noqa: E731, B023
        cells = sum((absent(c).cast("long") for c in df.columns), F.lit(0).cast("long"))
        keys = df.groupBy("sku_id", "date").agg(F.count("*").alias("n"), F.sum(cells).alias("cells"))
        no_key = F.col("sku_id").isNull() | F.col("date").isNull()
        parts.append(keys.agg(
            F.lit(name).alias("dataset"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count_distinct("sku_id").alias("n_sku"), F.coalesce(F.sum(F.when(no_key, F.col("n"))), F.lit(0)).alias("missing_key_rows"),
            F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("duplicate_key_rows"), F.coalesce(F.sum("cells"), F.lit(0)).alias("missing_cells"),
        ))
    return reduce(DataFrame.unionByName, parts)


def content_audit(raw: DataFrame, processed: DataFrame) -> DataFrame:
    """(check_name, violations): columns that one has alone, and rows that one holds more often than the other."""
    columns = [c for c in raw.columns if c in processed.columns]
    odd = len(set(raw.columns) ^ set(processed.columns))
    signed = raw.select(*columns, F.lit(1).alias("_side")).unionByName(processed.select(*columns, F.lit(-1).alias("_side")))
    more = signed.groupBy(*columns).agg(F.abs(F.sum("_side")).alias("n"))
    return more.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.inline(F.array(F.struct(F.lit("columns").alias("check_name"), F.lit(odd).cast("long").alias("violations")), F.struct(F.lit("values").alias("check_name"), F.col("n").alias("violations")))))


def contract_audit(panel: DataFrame, promised: dict) -> DataFrame:
    """(check_name, expected, actual, matches): rows, SKUs and dates of a panel against its written contract."""
    found = panel.agg(F.count("*").cast("string").alias("rows"), F.count_distinct("sku_id").cast("string").alias("skus"), F.min("date").cast("string").alias("date_min"), F.max("date").cast("string").alias("date_max"))
    rows = [F.struct(F.lit(k).alias("check_name"), F.lit(str(promised[k])).alias("expected"), F.col(k).alias("actual"), F.col(k).eqNullSafe(F.lit(str(promised[k]))).alias("matches")) for k in ("rows", "skus", "date_min", "date_max")]
    return found.select(F.inline(F.array(*rows)))


def classification_audit(classes: DataFrame, metric: DataFrame) -> DataFrame:
    """(check_name, violations) of classes and SKU metrics, which must hold the same SKUs once."""
    sides = classes.select("sku_id", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(metric.select("sku_id", F.lit(0).alias("a"), F.lit(1).alias("b")))
    both = sides.groupBy("sku_id").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    shared = _checks(both, {"one_class_per_sku": F.sum(F.greatest(F.col("a") - 1, F.lit(0))), "one_metric_per_sku": F.sum(F.greatest(F.col("b") - 1, F.lit(0))), "same_skus": F.count_if((F.col("a") == 0) | (F.col("b") == 0))})
    codes = _checks(classes, {"class_code": _not(F.col("class").rlike(CLASS_CODE))})
    return shared.unionByName(codes).unionByName(_checks(metric, {"fill_rate_is_a_share": _not(F.col("fill_rate").between(0, 1)), "lost_sales_not_negative": _not(F.col("lost_sales") >= 0)}))


def scope_audit(scope: DataFrame, classes: DataFrame) -> DataFrame:
    """(check_name, violations) of the classes that were picked for an intervention."""
    picked = settled(scope.filter("intervention is not null"))  # nine classes at most
    unknown = _checks(picked.join(classes.select("class").distinct(), "class", "left_anti"), {"class_exists": F.count("*")})
    own = {"one_decision_per_class": _repeats(picked, "class"), "n_sku_positive": _not(F.col("n_sku") > 0), "fill_rate_is_a_share": _not(F.col("fill_rate").between(0, 1)), "doi_not_negative": _not(F.col("doi") >= 0)}
    return _checks(picked, own).unionByName(unknown)


def window_audit(calibration: DataFrame, final: DataFrame, settings: Settings) -> DataFrame:
    """(artifact, expected_start, expected_end, observed_start, observed_end, negative, matches) of the two forecasts; the last window has no end of its own."""
    w, parts = settings.windows, []
    for name, df, start, end in (("calibration", calibration, w.calibration_start, w.calibration_end), ("final", final, w.final_start, None)):
        seen = df.agg(F.min("date").alias("observed_start"), F.max("date").alias("observed_end"), F.count_if(F.col("forecast") < 0).alias("negative"))
        matches = F.coalesce((F.col("observed_start") == F.lit(start)) & (F.lit(True) if end is None else F.col("observed_end") == F.lit(end)), F.lit(False))
        parts.append(seen.select(F.lit(name).alias("artifact"), F.lit(start).alias("expected_start"), F.lit(end).cast("date").alias("expected_end"), "observed_start", "observed_end", "negative", matches.alias("matches")))
    return reduce(DataFrame.unionByName, parts)


def lineage_audit(policy: DataFrame, audit: DataFrame, actions: DataFrame, sensitivity: DataFrame) -> DataFrame:
    """(check_name, violations): where the policies came from, as the tables themselves tell."""
    said = _checks(sensitivity, {"recorded_policy_is_the_baseline": (F.count_if(F.col("policy_label") == "recorded") == 0).cast("int"), "inferred_policy_is_beside_it": (F.count_if(F.col("policy_label") == "inferred") == 0).cast("int")})
    dynamic = _checks(actions, {"proposed_policy_follows_the_forecast": _not(F.col("policy_mode") == "dynamic_rop")})
    kept = [len({"q_multiplier", "order_quantity"} - set(policy.columns)), len({"moq", "order_multiple"} - set(audit.columns))]
    columns = policy.sparkSession.createDataFrame([("quantity_is_from_the_grid", kept[0]), ("audit_keeps_order_constraints", kept[1])], "check_name string, violations long")
    return said.unionByName(dynamic).unionByName(columns)
