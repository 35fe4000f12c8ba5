"""A whole run over a small panel, and its tables against their manifest."""

import shutil
from datetime import date, timedelta

import pytest

from larder.config import Settings, Windows
from larder.operators.contract import ContractError
from larder.plans import run as whole
from larder.sources import artifacts
from larder.sources.panel import PANEL

WINDOWS = Windows(date(2024, 3, 1), date(2024, 3, 20), date(2024, 3, 21), date(2024, 4, 19), date(2024, 4, 20), folds=2, fold_days=10, season=28)
SETTINGS = Settings(windows=WINDOWS, quantity_multipliers=(0.5, 1.0), reorder_quantiles=(0.9,), scenarios=3, holding_rates=(0.25,), ordering_costs=(50.0,), shortage_multipliers=(1.0, 2.0))


def panel_rows():
    """Five SKUs over 130 days: steady ones of high value, erratic ones of low value that run out."""
    rows = []
    for k, (level, swing, price, stock) in enumerate([(40, 2, 30.0, 400), (30, 9, 20.0, 400), (12, 7, 15.0, 200), (6, 6, 10.0, 6), (3, 3, 8.0, 3)]):
        inventory = stock
        for i in range(130):
            demand = level + (i * (k + 3) * 7 + i // 5) % (2 * swing + 1) - swing
            received = stock // 2 + 1 if i % 7 == 0 else 0
            there = inventory + received
            sales = min(demand, there)
            inventory = there - sales
            rows.append((f"S{k}", date(2024, 1, 1) + timedelta(i), demand, sales, inventory, received, f"c{k % 2}", 2 + k % 2, 5, 20, 25, price / 2, price))
    return rows


@pytest.fixture(scope="module")
def done(spark, tmp_path_factory):
    out = f"file://{tmp_path_factory.mktemp('run')}"
    panel = spark.createDataFrame(panel_rows(), PANEL)
    return out, whole.run(spark, panel, out, SETTINGS, params={"maxDepth": 2, "maxIter": 2})


def test_every_table_is_written_and_whole(spark, done):
    out, manifest = done
    assert {r.name for r in manifest.collect()} == set(whole.TABLES)
    assert artifacts.artifact_problems(spark, out, whole.TABLES) == []
    tables = artifacts.read_artifacts(spark, out)
    scope = tables["policy_sku"].count()
    assert scope and tables["policy_action"].count() == tables["old_policy_metric"].count() == tables["new_policy_metric"].count() == scope
    assert tables["forecast"].count() == scope * 20 and tables["validation_forecast"].count() == scope * 30
    assert tables["policy_sensitivity"].count() == 2 and tables["scenario_uncertainty"].count() == 3 and tables["policy_uncertainty"].count() == 3
    assert spark.sql("SELECT count(*) AS n FROM sku_class").first().n == 5


def test_changes_are_noticed(spark, done, tmp_path):
    out = done[0].removeprefix("file://")
    copy = tmp_path / "copy"
    shutil.copytree(out, copy)
    shutil.rmtree(copy / "sku_class")
    spark.read.parquet(f"{out}/sku_metric").limit(3).write.mode("overwrite").parquet(f"{copy}/sku_metric")
    assert artifacts.artifact_problems(spark, str(copy), (*whole.TABLES, "more")) == ["more: not in the manifest", "sku_class: missing or unreadable", "sku_metric: content changed"]
    assert artifacts.artifact_problems(spark, str(tmp_path / "none")) == ["no manifest"]


def test_missing_tables_and_broken_panels_are_refused(spark, tmp_path):
    with pytest.raises(artifacts.ArtifactError, match="missing required artifacts"):
        artifacts.write_artifacts(spark, {}, str(tmp_path), ("forecast",))
    rows = panel_rows()
    with pytest.raises(ContractError, match="duplicate SKU-date"):
        whole.tables_of(spark, spark.createDataFrame([*rows, rows[0]], PANEL), SETTINGS, params={})


def test_single_files_are_told_apart(spark, done, tmp_path):
    """A truncated file, a renamed one, a new one and an empty table; a report opens none of them."""
    copy = tmp_path / "copy"
    shutil.copytree(done[0].removeprefix("file://"), copy)
    assert artifacts.artifact_problems(spark, str(copy), whole.TABLES) == []
    part = lambda name: sorted((copy / name).glob("part-*"))[0]
    cut, moved = part("sku_class"), part("forecast")
    size = cut.stat().st_size
    cut.write_bytes(cut.read_bytes()[: size // 2])
    (copy / "sku_class" / f".{cut.name}.crc").unlink()
    moved.rename(moved.with_name("part-x.parquet"))
    (copy / "policy_sku" / "notes.txt").write_text("no table")
    got = artifacts.artifact_problems(spark, str(copy), whole.TABLES)
    assert got[:2] == [f"sku_class: {cut.name} is truncated, {size // 2} of {size} bytes", f"forecast: {moved.name} was renamed to part-x.parquet"]
    assert got[2:] == ["policy_sku: notes.txt is new"]
    with pytest.raises(artifacts.ArtifactError, match="truncated.*; forecast: .*renamed"):
        whole.open_run(spark, str(copy))
    assert set(whole.open_run(spark, done[0])) == set(whole.TABLES)
    artifacts.write_artifacts(spark, {"a": spark.range(0)}, str(tmp_path / "none"))
    assert artifacts.artifact_problems(spark, str(tmp_path / "none"), ("a",), ("a",)) == ["a: empty"]


def test_a_run_says_what_it_was(spark, done):
    said = artifacts.read_run(spark, done[0])
    assert said["settings"]["scenarios"] == 3 and said["windows"]["final_start"] == "2024-04-20" and set(said["provenance"]["runtime"]) >= {"python", "pyspark", "numpy"}
    assert len(said["provenance"]["source_sha256"]["larder/plans/run.py"]) == 64
    scope, sim = said["optimization_scope"], said["simulation_portfolio"]
    assert 0 < scope["n_in_scope"] <= scope["n_sku"] == 5 and 0 < scope["demand_coverage"] <= 1 and scope["segments"]
    assert sim["old_total_cost"] > 0 and sim["cost_sensitivity"]["scenario_count"] == 2 and sim["stress"]["scenario_count"] == 3 and len(sim["stress"]["quantiles"]) == len(sim["paired_sku_bootstrap"]) == 3
    assert artifacts.read_run(spark, "/nowhere") == {}


def test_modes(spark, tmp_path):
    rows = spark.createDataFrame(panel_rows(), PANEL)
    rows.coalesce(1).write.option("header", True).csv(f"{tmp_path}/good.csv")
    assert whole.open_run(spark, f"{tmp_path}/good.csv", "pipeline")["inventory_processed"].count() == rows.count()
    rows.union(rows.limit(1)).coalesce(1).write.option("header", True).csv(f"{tmp_path}/bad.csv")
    with pytest.raises(ContractError, match="duplicate SKU-date"):
        whole.open_run(spark, f"{tmp_path}/bad.csv", "pipeline")
    with pytest.raises(ValueError, match="unknown mode"):
        whole.open_run(spark, str(tmp_path), "other")
