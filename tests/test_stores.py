"""Landing folders, versions, stored keys, late repair, online scores and exact serving."""

import os
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helpers import asset, values
from pricetide.operators import candle_cells, stored_keys
from pricetide.plans import medallion
from pricetide.sinks import versions
from pricetide.sources.folders import folders_to_read
from pricetide.streaming import once, replace_parquet
from pricetide.streaming.online import scores_before
from pricetide.streaming.repair import repair_cells

MINUTE = 60_000


def test_folders_after_the_newest_and_those_still_open():
    landed = ["d1", "d2", "d3", "d4"]
    assert folders_to_read(landed, []) == landed
    assert folders_to_read(landed, ["d1", "d3"]) == ["d2", "d3", "d4"]
    assert folders_to_read(landed, ["d4"], open_folders=1) == ["d4"]
    assert folders_to_read(landed, ["d4"], open_folders=0) == []


def test_landing_by_folder(spark, tmp_path, land):
    layout = medallion.Layout(str(tmp_path))
    day = tmp_path / "landing"
    assert medallion.refresh_bronze_by_folder(spark, layout)["rows"] == 0
    land(day / "arrived=2024-01-01", "a b+c", MINUTE, [asset()])
    land(day / "arrived=2024-01-02", "b", 2 * MINUTE, [asset()])
    assert medallion.refresh_bronze_by_folder(spark, layout) == {"rows": 2, "quarantined": 0}
    assert medallion.refresh_bronze_by_folder(spark, layout)["rows"] == 0
    # An old snapshot, with an old modification time and a name before the others.
    land(day / "arrived=2024-01-02", "a", 0, [asset()])
    os.utime(day / "arrived=2024-01-02" / "a.json", (1, 1))
    (day / "arrived=2024-01-03").mkdir()
    (day / "arrived=2024-01-03" / "bad.json").write_text('{"timestamp": 1, "da')
    assert medallion.refresh_bronze_by_folder(spark, layout) == {"rows": 1, "quarantined": 1}
    assert medallion.read_bronze(spark, layout).count() == 3
    assert medallion.read_bronze(spark, layout, corrupt=True).count() == 1
    # The first folder is closed by now.
    land(day / "arrived=2024-01-01", "late", 0, [asset()])
    assert medallion.refresh_bronze_by_folder(spark, layout)["rows"] == 0
    assert medallion.refresh_bronze_by_folder(spark, layout, open_folders=9)["rows"] == 1
    assert medallion.refresh_silver(spark, layout)["rows_written"] == 3


def test_a_failed_version_is_never_read(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(ValueError, match="no complete version"):
        versions.read_version(spark, path)
    assert versions.write_version(spark.range(3), path) == 1
    broken = spark.range(100).select(F.raise_error(F.lit("disk full")).cast("long").alias("id"))
    with pytest.raises(Exception, match="disk full"):
        versions.write_version(broken, path)
    assert versions.read_version(spark, path).count() == 3
    # A version may read the one it follows.
    assert versions.write_version(versions.read_version(spark, path).union(spark.range(2)), path) == 2
    assert versions.read_version(spark, path).count() == 5
    assert versions.read_version(spark, path, 1).count() == 3
    assert [r["row_count"] for r in versions.versions(spark, path).orderBy("version").collect()] == [3, 5]


def test_keys_of_any_age(spark, tmp_path, obs):
    name, path = f"keys_{os.getpid()}", str(tmp_path / "keys")
    rows = obs([("a", "A", 0, 1.0), (None, "N", 0, 1.0), ("b", "B", 9000, 1.0)])
    rows = rows.withColumn("observed_at", F.col("observed_at").cast("timestamp"))
    keys = stored_keys.open_keys(spark, name, path, 4)
    assert stored_keys.not_in_keys(rows.union(rows), keys).count() == 3
    stored_keys.add_keys(rows, name, path, 4)
    more = obs([("a", "A", 0, 2.0), (None, "N", 0, 1.0), ("a", "A", 1, 1.0)])
    more = more.withColumn("observed_at", F.col("observed_at").cast("timestamp"))
    left = stored_keys.not_in_keys(more, stored_keys.open_keys(spark, name, path, 4))
    assert values(left, "asset_id", "price") == [("a", 1.0)]
    plan = left._jdf.queryExecution().executedPlan().toString()
    stored_side = plan[plan.index("SortMergeJoin") :].split("+- ")[-1]
    assert "Bucketed: true" in plan and "Exchange" not in stored_side


def test_late_rows_repair_candles_and_a_batch_counts_once(spark, tmp_path, obs):
    path = str(tmp_path / "cells")
    batches = [
        obs([("a", "A", 20, 2.0), ("a", "A", 29, 3.0), ("b", "B", 3000, 1.0)]),
        obs([("a", "A", 16, 9.0), ("a", "A", 3000, 4.0)]),
        obs([]),
    ]
    write = repair_cells(path)
    for number, batch in enumerate(batches):
        write(batch, number)
        write(batch, number)  # as after a failure
    direct = candle_cells.candle_cells(batches[0].union(batches[1]))
    names = ["start", "symbol", "open", "close", "low", "high", "n", "total"]
    assert values(spark.read.parquet(path), *names) == values(direct, *names)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.floats(1, 1e6), min_size=1, max_size=40), st.lists(st.integers(1, 9), max_size=6))
def test_scores_against_all_before(prices, cuts):
    prices, found, state, at = np.array(prices), [], (0, 0.0, 0.0), 0
    for size in [*cuts, len(prices)]:
        part = prices[at : at + size]
        at += size
        if len(part):
            z, state = scores_before(part, *state)
            found += z.tolist()
    for i, z in enumerate(found):
        sd = prices[:i].std(ddof=1) if i > 1 else 0.0
        if sd > 1e-3 * prices[:i].mean() if i > 1 else False:
            assert z == pytest.approx((prices[i] - prices[:i].mean()) / sd, rel=1e-6, abs=1e-6)


def test_a_served_batch_that_comes_again(spark, tmp_path, obs):
    replace, ledger = replace_parquet(str(tmp_path)), str(tmp_path / "ledger")
    calls = []

    def half_done(df, table, batch_id):
        replace(df, table, batch_id)
        calls.append(batch_id)
        if len(calls) == 1:
            raise RuntimeError("lost")

    load = once("t", half_done, ledger, "q")
    batch = obs([("a", "A", 0, 1.0)])
    with pytest.raises(RuntimeError):
        load(batch, 0)
    for _ in range(3):
        load(batch, 0)
    load(batch, 1)
    assert calls == [0, 0, 1]
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    once("t", half_done, ledger, "other")(batch, 1)
    assert calls[-1] == 1 and len(calls) == 4
    assert Path(tmp_path, "t", "batch_id=1").is_dir()
