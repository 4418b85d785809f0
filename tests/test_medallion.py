import json
import os
import re
import time

import pytest

from helpers import asset, values
from pricetide.operators.quality import QualityError
from pricetide.operators.silver import newer_than
from pricetide.plans import medallion
from pricetide.schema import OBSERVATION
from pricetide.session import configure
from pricetide.sinks import TABLES, load_tables
from pricetide.sources import read_landing

MINUTE = 60_000
DAY = 1440 * MINUTE
START = 1_704_067_200_000


def silver(spark, layout):
    return spark.read.schema(OBSERVATION).parquet(layout.silver)


def test_whole_run_and_idempotent_repeat(spark, tmp_path, land):
    layout = medallion.Layout(str(tmp_path))
    for i in range(20):
        assets = [asset("a", "A", str(10 + i % 3)), asset("b", "B", str(5 + i)), asset("c", "C", "None")]
        land(layout.landing, f"s{i}", START + i * MINUTE, assets)
    done = medallion.run(spark, str(tmp_path))
    assert done["bronze_rows"] == 20
    assert done["silver"] == {"rows_in": 60, "rows_dropped": 20, "rows_written": 40}
    assert done["quality"]["total_records"] == 40
    assert set(TABLES) <= set(done["gold"])
    assert (tmp_path / "silver" / "observed_date=2024-01-01").is_dir()

    gold = medallion.gold_tables(spark, layout, TABLES)
    assert gold["price_changes"].count() == 38
    assert gold["top_assets"].count() == 2
    served = load_tables(spark, gold, lambda df, t: df.write.parquet(str(tmp_path / "db" / t)))
    assert served.filter("ok").count() == len(TABLES)

    again = medallion.run(spark, str(tmp_path))
    assert again["bronze_rows"] == 0
    assert again["silver"]["rows_written"] == 0
    assert silver(spark, layout).count() == 40


def test_late_snapshots(spark, tmp_path, land):
    layout = medallion.Layout(str(tmp_path))
    land(layout.landing, "new", START + 10 * MINUTE, [asset()])
    medallion.refresh_bronze(spark, layout)
    medallion.refresh_silver(spark, layout)
    land(layout.landing, "late", START, [asset()])
    land(layout.landing, "newest", START + 20 * MINUTE, [asset()])
    assert medallion.refresh_bronze(spark, layout)["rows"] == 2
    assert medallion.refresh_silver(spark, layout)["rows_written"] == 1
    assert medallion.refresh_silver(spark, layout)["rows_written"] == 0
    assert medallion.refresh_silver(spark, layout, late="admit")["rows_written"] == 1
    assert medallion.refresh_silver(spark, layout, late="admit")["rows_written"] == 0
    assert silver(spark, layout).count() == 3


def test_late_beyond_the_look_back_stays_out(spark, tmp_path, land):
    layout = medallion.Layout(str(tmp_path))
    land(layout.landing, "new", START + 10 * DAY, [asset()])
    medallion.refresh_bronze(spark, layout)
    medallion.refresh_silver(spark, layout)
    land(layout.landing, "late", START, [asset()])
    medallion.refresh_bronze(spark, layout)
    assert medallion.refresh_silver(spark, layout, late="admit")["rows_written"] == 0
    assert medallion.refresh_silver(spark, layout, "admit", lookback_days=11)["rows_written"] == 1


def test_an_unfit_silver_stops_before_gold(spark, tmp_path, land):
    layout = medallion.Layout(str(tmp_path))
    land(layout.landing, "bad", START, [asset(price="None")])
    with pytest.raises(QualityError):
        medallion.run(spark, str(tmp_path))
    assert not (tmp_path / "gold").exists()
    assert spark.read.json(layout.quality).count() == 1


def test_same_content_in_two_files_is_stored_once(spark, tmp_path, land):
    layout = medallion.Layout(str(tmp_path))
    land(layout.landing, "one", START, [asset(price="1")])
    land(layout.landing, "two", START, [asset(price="2")])
    assert medallion.refresh_bronze(spark, layout)["rows"] == 2
    assert medallion.refresh_silver(spark, layout)["rows_written"] == 1
    assert values(silver(spark, layout), "price") == [(2.0,)]


def test_files_of_any_name_are_ingested_once(spark, tmp_path, land):
    layout = medallion.Layout(str(tmp_path))
    for i, name in enumerate(("plain", "a blank", "per%cent", "brackets[1]{2}", "ümlaut")):
        land(layout.landing, name, START + i * MINUTE, [asset()])
    assert medallion.refresh_bronze(spark, layout) == {"rows": 5, "quarantined": 0}
    land(layout.landing, "second", START + 9 * MINUTE, [asset()])
    assert medallion.refresh_bronze(spark, layout, max_files_per_trigger=1)["rows"] == 1
    assert medallion.refresh_bronze(spark, layout)["rows"] == 0
    bronze = medallion.read_bronze(spark, layout)
    assert bronze.select("source_file").distinct().count() == bronze.count() == 6


def test_files_of_old_dates_are_ingested_in_later_runs(spark, tmp_path, land):
    layout = medallion.Layout(str(tmp_path))
    land(layout.landing, "new", START, [asset()])
    assert medallion.refresh_bronze(spark, layout)["rows"] == 1
    for days in (10, 4000):
        land(layout.landing, f"old{days}", START - days * DAY, [asset()])
        then = time.time() - days * 86_400
        os.utime(tmp_path / "landing" / f"old{days}.json", (then, then))
        assert medallion.refresh_bronze(spark, layout)["rows"] == 1
    assert medallion.refresh_bronze(spark, layout)["rows"] == 0


def test_files_of_every_batch_are_counted(spark, tmp_path, land):
    layout = medallion.Layout(str(tmp_path))
    for i in range(5):
        land(layout.landing, f"s{i}", START + i * MINUTE, [asset()])
    (tmp_path / "landing" / "cut.json").write_text("no json")
    os.utime(tmp_path / "landing" / "cut.json", (1, 1))
    kept = spark.conf.get(medallion.PROGRESS_KEPT)
    spark.conf.set(medallion.PROGRESS_KEPT, "2")
    try:
        done = medallion.refresh_bronze(spark, layout, max_files_per_trigger=1)
        assert spark.conf.get(medallion.PROGRESS_KEPT) == "2"
    finally:
        spark.conf.set(medallion.PROGRESS_KEPT, kept)
    assert done == {"rows": 5, "quarantined": 1}


def test_mixed_documents_all_arrive(spark, tmp_path, land):
    layout = medallion.Layout(str(tmp_path))
    land(layout.landing, "array", START, [asset("a", "A"), asset("b", "B")])
    land(layout.landing, "text", START + MINUTE, json.dumps([asset("a", "A"), asset("c", "C")]))
    (tmp_path / "landing" / "cut.json").write_text('{"timestamp": 1704067200000, "data": [{"id": "x"')
    done = medallion.run(spark, str(tmp_path))
    assert (done["bronze_rows"], done["quarantined"]) == (2, 1)
    assert values(silver(spark, layout), "asset_id") == [("a",), ("a",), ("b",), ("c",)]
    assert medallion.read_bronze(spark, layout, corrupt=True).count() == 1
    (tmp_path / "landing" / "again.json").write_text("no json")
    with pytest.raises(ValueError, match="no JSON"):
        medallion.refresh_bronze(spark, layout, on_corrupt="fail")


def test_increments_open_only_recent_dates_of_bronze(spark, tmp_path, land):
    layout = medallion.Layout(str(tmp_path))
    for day in range(3):
        land(layout.landing, f"d{day}", START + day * DAY, [asset()])
    medallion.refresh_bronze(spark, layout)
    medallion.refresh_silver(spark, layout)
    new = newer_than(
        medallion.read_bronze(spark, layout), silver(spark, layout), "ingestion_time", date="ingestion_date"
    )
    plan = new._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*ingestion_date", plan)


def test_bronze_has_few_files_for_each_date(spark, tmp_path, land):
    layout = medallion.Layout(str(tmp_path))
    for i in range(40):
        land(f"{layout.landing}/f{i}", f"s{i}", START + (i % 3) * DAY, [asset()])
    assert medallion.refresh_bronze(spark, layout) == {"rows": 40, "quarantined": 0}
    assert medallion.read_bronze(spark, layout).count() == 40
    assert len(list((tmp_path / "bronze").rglob("*.parquet"))) == 3


def test_many_landing_folders_are_listed_by_few_tasks(spark, tmp_path, land):
    layout = medallion.Layout(str(tmp_path))
    for i in range(200):
        land(f"{layout.landing}/f{i}", "s", START, [asset()])
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("listing", "list the folders")
    try:
        assert len(read_landing(configure(spark), layout.landing).inputFiles()) == 200
        stages = [s for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
        assert 0 < max(tracker.getStageInfo(s).numTasks for s in stages) <= 128
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
