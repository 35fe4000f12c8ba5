"""Audits that must find something, checks of recorded policies and floors, and steps that queries share."""

import os
import shutil
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from larder.config import Settings, Windows
from larder.operators import audit, policy, report
from larder.plans import catalog
from larder.sources.panel import PANEL, data_contract

W = Windows(date(2025, 1, 1), date(2025, 5, 30), date(2025, 5, 31), date(2025, 9, 30), date(2025, 10, 1))
S = Settings(windows=W)
ROWS = [(s, date(2025, 9, 1) + timedelta(d), 2, 2, 5, 0, "c", 2, 1, 4, 6, 5.0, 10.0) for s in ("A", "B") for d in range(3)]


def found(df):
    return {r.check_name: r.violations for r in df.collect()}


def test_keys_and_contents(spark):
    raw = spark.createDataFrame(ROWS, PANEL)
    bad = spark.createDataFrame([*ROWS, ROWS[0], (None, *ROWS[1][1:]), (*ROWS[2][:2], None, *ROWS[2][3:12], float("nan"))], PANEL)
    got = {r.dataset: r for r in audit.key_audit(raw=raw, bad=bad, none=raw.limit(0)).collect()}
    assert tuple(got["raw"])[1:] == (6, 2, 0, 0, 0) and tuple(got["bad"])[1:] == (9, 2, 1, 4, 3) and tuple(got["none"])[1:] == (0, 0, 0, 0, 0)
    assert found(audit.content_audit(raw, raw.repartition(3))) == {"columns": 0, "values": 0}
    assert found(audit.content_audit(raw, bad.drop("category"))) == {"columns": 1, "values": 3}
    assert [r.matches for r in audit.schema_audit(raw.withColumn("date", F.col("date").cast("timestamp")).drop("category"), PANEL).collect()].count(False) == 2
    promised = data_contract(raw)
    assert all(r.matches for r in audit.contract_audit(raw, promised).collect())
    assert {r.check_name for r in audit.contract_audit(bad, promised | {"date_max": "2030-01-01"}).collect() if not r.matches} == {"rows", "date_max"}


def test_classes_scope_and_windows(spark):
    classes = spark.createDataFrame([("A", "AX"), ("B", "XA"), ("B", "BZ"), ("C", None)], "sku_id string, class string")
    metric = spark.createDataFrame([("A", 0.5, 1.0), ("B", 1.2, -1.0), ("D", None, 0.0)], "sku_id string, fill_rate double, lost_sales double")
    assert found(audit.classification_audit(classes, metric)) == {"one_class_per_sku": 1, "one_metric_per_sku": 0, "same_skus": 2, "class_code": 2, "fill_rate_is_a_share": 2, "lost_sales_not_negative": 1}
    scope = spark.createDataFrame([("AX", "x", 1, 0.5, 1.0), ("AX", "y", 0, 1.5, -1.0), ("CC", "x", 2, None, None), ("BZ", None, 0, 9.0, 9.0)], "class string, intervention string, n_sku long, fill_rate double, doi double")
    assert found(audit.scope_audit(scope, classes)) == {"one_decision_per_class": 1, "n_sku_positive": 1, "fill_rate_is_a_share": 2, "doi_not_negative": 2, "class_exists": 1}
    days = lambda first, last: spark.createDataFrame([(first, 1.0), (last, -1.0)], "date date, forecast double")
    got = audit.window_audit(days(W.calibration_start, W.calibration_end - timedelta(1)), days(W.final_start, date(2025, 12, 31)), S).collect()
    assert [(r.artifact, r.matches, r.negative) for r in got] == [("calibration", False, 1), ("final", True, 1)]
    assert not audit.window_audit(days(W.calibration_start, W.calibration_end), days(W.final_start, W.final_start).limit(0), S).collect()[1].matches


def test_lineage(spark):
    label, mode = (lambda *x: spark.createDataFrame([(v,) for v in x], "policy_label string")), (lambda x: spark.createDataFrame([(x,)], "policy_mode string"))
    chosen, grid = spark.createDataFrame([(1.0, 2.0)], "q_multiplier double, order_quantity double"), spark.createDataFrame([(1.0, 2.0)], "moq double, order_multiple double")
    assert not any(found(audit.lineage_audit(chosen, grid, mode("dynamic_rop"), label("recorded", "inferred"))).values())
    assert found(audit.lineage_audit(chosen.drop("order_quantity"), grid.drop("moq"), mode("static"), label("other"))) == {"recorded_policy_is_the_baseline": 1, "inferred_policy_is_beside_it": 1, "proposed_policy_follows_the_forecast": 1, "quantity_is_from_the_grid": 1, "audit_keeps_order_constraints": 1}


@pytest.mark.parametrize(("column", "value", "says"), [("reorder_point", -1, "reorder_point must be finite and nonnegative; affected: A"), ("order_quantity", 0, "order_quantity must be finite and positive; affected: A"), ("lead_time", 0, "positive integer; affected: A")])
def test_recorded_policies_are_checked(spark, column, value, says):
    panel = spark.createDataFrame(ROWS, PANEL)
    assert {(r.sku_id, r.rop, r.order_quantity, r.lead_time) for r in policy.historical_policy(panel, S).collect()} == {("A", 4, 6, 2), ("B", 4, 6, 2)}
    with pytest.raises(Exception, match=says):
        policy.historical_policy(panel.withColumn(column, F.when(F.col("sku_id") == "A", value).otherwise(F.col(column))), S).collect()


def test_recorded_policies_of_targets(spark):
    panel = spark.createDataFrame([*ROWS, ("late", date(2025, 10, 1), *ROWS[0][2:])], PANEL)
    targets = lambda *x: spark.createDataFrame([(v,) for v in x], "sku_id string")
    assert [r.sku_id for r in policy.historical_policy(panel, S, targets("A", "A")).collect()] == ["A"]
    with pytest.raises(Exception, match="no rows before the final window for late"):
        policy.historical_policy(panel, S, targets("A", "late")).collect()
    with pytest.raises(ValueError, match="missing columns: \\['unit_cost'\\]"):
        policy.historical_policy(panel.drop("unit_cost"), S)


def test_service_floors(spark):
    rows = spark.createDataFrame([("correct_understock", 90.0), ("other", 80.0)], "intervention string, target double")
    floor = lambda s: [r.f for r in rows.select(policy.service_floor(s).alias("f")).collect()]
    assert floor(Settings(windows=W, floor_by_intervention={})) == [0.9, 0.8]
    assert floor(Settings(windows=W, floor_by_intervention={"correct_understock": 0.5, "other": 1.0})) == [0.5, 1.0]
    for floors, says in ((S.floor_by_intervention, "no service floor for the intervention other"), ({"correct_understock": 0.5, "other": 1.5}, "between 0 and 1")):
        with pytest.raises(Exception, match=says):
            floor(Settings(windows=W, floor_by_intervention=floors))


def test_a_half_goes_to_the_even_digit(spark):
    metric = spark.createDataFrame([("A", 1.0, 2.0, 0.0625, 1.0), ("B", 3.0, 8.0, 0.0635, 2.0)], "sku_id string, total_sales double, total_demand double, lost_sales double, doi double")
    classes = spark.createDataFrame([("A", "AX"), ("B", "AX")], "sku_id string, class string")
    row = report.class_report(metric, classes).first()
    assert (row["class"], row.n_sku, row.fill_rate, row.lost_sales, row.doi) == ("AX", 2, 0.4, 0.063, 1.5)
    one = report.class_report(metric.filter("sku_id = 'A'"), classes).first()
    assert one.lost_sales == 0.062


SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no standard tables")
def test_steps_are_shared_until_an_input_changes(spark, tmp_path):
    for table in ("lineitem", "part"):
        shutil.copytree(f"{SF}/{table}.parquet", tmp_path / f"{table}.parquet") if os.path.isdir(f"{SF}/{table}.parquet") else shutil.copy(f"{SF}/{table}.parquet", tmp_path)
    one, two = catalog.Book(spark, str(tmp_path)), catalog.Book(spark, str(tmp_path))
    assert one.classes is two.classes and catalog.Book(spark, panel=one.panel).classes is not one.classes
    assert catalog.Book(spark, str(tmp_path), settings=Settings(windows=catalog.S.windows, a_share=0.5, draws="hash")).classes is not one.classes
    shutil.rmtree(os.path.dirname(two.classes.inputFiles()[0]).removeprefix("file://").removeprefix("file:"))
    three = catalog.Book(spark, str(tmp_path))
    assert three.panel is one.panel and three.classes is not one.classes and three.classes.count() == 25
    first = next(p for p in [tmp_path / "part.parquet", *(tmp_path / "part.parquet").glob("*.parquet")] if p.is_file())
    os.chmod(first.parent, 0o755)
    os.utime(first, (1, 1))
    assert catalog.Book(spark, str(tmp_path)).panel is not one.panel
