"""Scans, contracts, getters and numbers that reports rely on."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from larder.functions.exprs import percent_change, valid_number
from larder.operators import classify, forecast, model, report
from larder.config import Settings, Windows
from larder.sources.artifacts import artifact_problems, write_artifacts
from larder.functions.stored import CheckError, settled
from larder.operators.features import create_features
from larder.operators.joins import checked_join
from larder.sources.panel import PANEL, data_contract, export_panel, read_artifact, read_tolerant

ROWS = [("A", date(2025, 1, d), 1, 1, 5, 0, "c", 2, 1, 1, 1, 5.0, 10.0) for d in (1, 2, 3)]


def test_contract_of_a_panel(spark):
    got = data_contract(spark.createDataFrame(ROWS, PANEL))
    assert (got["rows"], got["skus"], got["date_min"], got["date_max"]) == (3, 1, "2025-01-01", "2025-01-03") and list(got["columns"]) == PANEL.fieldNames()


def test_a_missing_artifact_is_an_empty_table(spark, tmp_path):
    assert read_artifact(spark, f"{tmp_path}/none.csv", PANEL).collect() == []
    spark.createDataFrame(ROWS, PANEL).write.option("header", True).csv(f"{tmp_path}/some.csv")
    assert read_artifact(spark, f"{tmp_path}/some.csv", PANEL).count() == 3


def test_tables_must_be_those_expected(spark, tmp_path):
    write_artifacts(spark, {"a": spark.range(3), "b": spark.range(2)}, str(tmp_path))
    assert artifact_problems(spark, str(tmp_path), ("a", "b")) == artifact_problems(spark, str(tmp_path)) == []
    assert artifact_problems(spark, str(tmp_path), ("a", "c")) == ["c: not in the manifest", "b: not expected"]


def test_getters(spark):
    df = spark.createDataFrame([("A", "AX", date(2025, 1, 2)), ("B", "AX", date(2025, 1, 1)), ("A", "AX", date(2025, 1, 1))], "sku_id string, class string, date date")
    assert [r.date.day for r in report.forecast_of(df, "A").collect()] == [1, 2] and report.policy_of(df, "Z").collect() == []
    assert [r.sku_id for r in report.skus_of_class(df.dropDuplicates(["sku_id"]), "AX").collect()] == ["A", "B"]
    with pytest.raises(ValueError, match="no rows in the window"):
        forecast.between(df, date(2024, 1, 1), date(2024, 2, 1))


def test_numbers(spark):
    df = spark.createDataFrame([("1.5",), ("x",), ("NaN",), ("Infinity",), (None,)], "v string")
    assert [r.n for r in df.select(valid_number(F.col("v")).alias("n")).collect()] == [1.5, None, None, None, None]
    got = spark.createDataFrame([(15.0, 10.0), (1.0, 0.0), (None, 1.0)], "a double, b double").select(percent_change(F.col("a"), F.col("b")).alias("p"))
    assert [r.p for r in got.collect()] == [pytest.approx(50.0), None, None]


def test_a_panel_without_value_has_no_classes(spark):
    own = Settings(windows=Windows(date(2025, 1, 1), date(2025, 5, 30), date(2025, 5, 31), date(2025, 9, 30), date(2025, 10, 1)))
    panel = spark.createDataFrame(ROWS, PANEL).withColumn("unit_price", F.col("unit_cost"))
    with pytest.raises(Exception, match="total economic value must be positive"):
        classify.classify_abc(panel, own).collect()


def test_a_plan_has_eight_parameters_and_stays_the_same():
    plan = model.parameter_plan(8, 42)
    assert len(plan) == 8 and all(len(x) == 8 for x in plan) and plan == model.parameter_plan(8, 42) != model.parameter_plan(8, 43)


def test_malformed_rows_go_to_quarantine(spark, tmp_path):
    head, good = ",".join(reversed(PANEL.fieldNames())) + ",note", "10.0,5.0,1,1,1,2,c,0,5,1,1,2025-01-01,A,x"
    (tmp_path / "half.csv").write_text("\n".join([head, good, good.replace(",2025-01-01,", ",no day,"), "10.0,oops,1", good.replace("A,x", "B,")]))
    got = read_tolerant(spark, f"{tmp_path}/half.csv", PANEL)
    assert [(r.sku_id, r.unit_price, r.date) for r in got.rows.orderBy("sku_id").collect()] == [("A", 10.0, date(2025, 1, 1)), ("B", 10.0, date(2025, 1, 1))]
    assert got.rows.schema == PANEL and sorted(r.line[:8] for r in got.quarantine.collect()) == ["10.0,5.0", "10.0,oop"] and got.fault.endswith("half.csv: 2 malformed rows")
    assert read_artifact(spark, f"{tmp_path}/half.csv", PANEL).count() == 2


def test_what_cannot_be_read_is_empty_and_named(spark, tmp_path):
    (tmp_path / "short.csv").write_text("sku_id,date\nA,2025-01-01\n")
    (tmp_path / "broken.parquet").write_bytes(b"PAR1 no table")
    (tmp_path / "none.csv").write_text("")
    for name, kind, says in (("short.csv", "csv", "missing columns \\['demand'"), ("broken.parquet", "parquet", "broken.parquet: "), ("none.csv", "csv", "missing columns"), ("nowhere.csv", "csv", "nowhere.csv: ")):
        got = read_tolerant(spark, f"{tmp_path}/{name}", PANEL, kind)
        assert got.rows.schema == PANEL and got.rows.isEmpty() and got.quarantine.isEmpty()
        with pytest.raises(ValueError, match=says):
            raise ValueError(got.fault)


def test_joins_check_their_keys_without_a_job(spark):
    one, two = spark.createDataFrame([("A", 1), ("B", 2)], "k string, x int"), spark.createDataFrame([("A", 3), ("A", 4)], "k string, y int")
    assert checked_join(one, two, ["k"], validate="one_to_many").count() == 2
    for how, side in (("many_to_one", "right"), ("one_to_one", "right")):
        with pytest.raises(Exception, match=f"not unique on the {side} side: A"):
            checked_join(one, two, ["k"], validate=how).collect()
    with pytest.raises(Exception, match="not unique on the left side"):
        checked_join(two, one, ["k"], validate="one_to_many").collect()


def test_checks_are_counted_while_a_table_is_written(spark):
    df = spark.createDataFrame([(1.0,), (-1.0,), (None,)], "v double")
    assert settled(df, {"big": F.col("v") > 5}).count() == 3
    with pytest.raises(CheckError, match="'missing': 1, 'negative': 1"):
        settled(df, {"missing": F.col("v").isNull(), "negative": F.col("v") < 0, "big": F.col("v") > 5})


def test_windows_over_an_export_need_no_exchange(spark):
    rows = [(s, *r[1:]) for s in ("A", "B", "C") for r in ROWS]
    out = export_panel(spark.createDataFrame(rows, PANEL), "exported_panel", 4)
    plan = create_features(out).select("sku_id", "date", "lag_1", "roll_mean_30", "ewm_3")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and out.count() == 9
    assert [tuple(r) for r in out.orderBy("sku_id", "date").collect()] == rows
    spark.sql("DROP TABLE exported_panel")
