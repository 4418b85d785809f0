"""Gold by date: moments, candle cells and indicators after new and late rows."""

import random
import shutil
from datetime import date, datetime, timedelta
from pathlib import Path

import pytest
from hypothesis import given
from hypothesis import strategies as st

from helpers import T0, values
from pricetide.operators import candle_cells, history, moments
from pricetide.operators.indicators import indicators
from pricetide.plans import dashboard, incremental
from pricetide.plans.medallion import Layout
from pricetide.schema import OBSERVATION
from pricetide.sinks import append_silver
from pricetide.sources.changes import changed_dates, date_versions, mark_seen

NAMES = ("observed_at", "symbol", "price", "prev_price", "ma_7", "ma_14", "ma_30", "rsi", "price_change_pct")


def silver_rows(spark, rows):
    full = []
    for symbol, minute, price in rows:
        at = T0 + timedelta(minutes=minute)
        full.append((symbol, None, symbol, symbol, price, 2.0, price, 0.0, at, None, at.date()))
    return spark.createDataFrame(full, OBSERVATION)


def market(days=6, seed=1):
    rng = random.Random(seed)
    rows = [("A", 1440 * d + 30 * i, rng.uniform(1, 9)) for d in range(days) for i in range(40)]
    # A symbol of one row a day, whose frames reach many days back.
    return rows + [("RARE", 1440 * d + 5, rng.uniform(1, 9)) for d in range(days)]


def assert_close(found, expected, rel):
    assert [r[0] for r in found] == [r[0] for r in expected]
    for a, b in zip(found, expected, strict=True):
        for x, y in zip(a[1:], b[1:], strict=True):
            assert (x is None) == (y is None) and (x is None or x == pytest.approx(y, rel=rel, abs=1e-9))


@pytest.fixture
def layout(tmp_path):
    return Layout(str(tmp_path / "lake"))


def whole(spark, layout):
    silver = spark.read.schema(OBSERVATION).parquet(layout.silver)
    return silver, values(indicators(silver, rows_per_chunk=None), *NAMES)


def stored(spark, layout):
    return values(spark.read.parquet(layout.gold(incremental.INDICATORS)), *NAMES)


def test_new_and_late_rows_give_what_a_full_run_gives(spark, layout):
    rows = market(days=40)
    late = [("A", 1440 * 3 + 31, 5.0), ("NEW", 1440 * 3, 1.0)]
    append_silver(silver_rows(spark, [r for r in rows if r[1] < 1440 * 36]), layout.silver)
    first = incremental.refresh_gold_by_date(spark, layout)
    assert len(first[incremental.INDICATORS]) == 36
    append_silver(silver_rows(spark, [r for r in rows if r[1] >= 1440 * 36]), layout.silver)
    second = incremental.refresh_gold_by_date(spark, layout)
    new = [date(2024, 1, 1) + timedelta(d) for d in range(36, 40)]
    assert all(days == new for days in second.values())
    append_silver(silver_rows(spark, late), layout.silver)
    third = incremental.refresh_gold_by_date(spark, layout)
    assert third[incremental.MOMENTS] == third[incremental.HISTORY] == [date(2024, 1, 4)]
    # The rare symbol's frames of 30 rows reach back to it from 29 days on.
    assert third[incremental.INDICATORS] == [date(2024, 1, 4) + timedelta(d) for d in range(30)]
    silver, expected = whole(spark, layout)
    assert stored(spark, layout) == expected
    assert not any(incremental.refresh_gold_by_date(spark, layout).values())
    for name in ("volatility", "history_stats"):
        full = getattr(history, name)(silver)
        kept = spark.read.parquet(layout.gold(name))
        assert_close(values(kept, *full.columns), values(full, *full.columns), 1e-9)


def test_only_needed_dates_are_read(spark, layout):
    append_silver(silver_rows(spark, [r for r in market(days=12) if r[0] == "A"]), layout.silver)
    incremental.refresh_moments(spark, layout)
    silver = spark.read.schema(OBSERVATION).parquet(layout.silver)
    cells = spark.read.parquet(layout.gold(incremental.MOMENTS))
    rows, written = incremental.indicator_input(silver, cells, [date(2024, 1, 6)])
    # 40 rows a day: the next day looks back to it, and it looks back to the day before.
    assert written == [date(2024, 1, 6), date(2024, 1, 7)]
    assert {r[0] for r in rows.select("observed_date").distinct().collect()} == {date(2024, 1, 5), *written}
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [observed_date" in plan


def test_a_failed_run_comes_again(spark, layout, monkeypatch):
    append_silver(silver_rows(spark, market(3)), layout.silver)
    versions = date_versions(spark, layout.silver)
    ledger = layout.folder("ledger")
    assert len(changed_dates(spark, versions, ledger, "x")) == 3
    mark_seen(spark, versions, [date(2024, 1, 1)], ledger, "x")
    assert changed_dates(spark, versions, ledger, "x") == [date(2024, 1, 2), date(2024, 1, 3)]
    assert len(changed_dates(spark, versions, ledger, "y")) == 3
    append_silver(silver_rows(spark, [("A", 3, 1.0)]), layout.silver)
    versions = date_versions(spark, layout.silver)
    assert len(changed_dates(spark, versions, ledger, "x")) == 3
    mark_seen(spark, versions, list(versions), ledger, "x")
    assert changed_dates(spark, versions, ledger, "x") == []


@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=60), st.integers(1, 7))
def test_candles_of_a_range_are_covered(points, hours):
    start = datetime(2024, 1, 1) + timedelta(seconds=abs(points[0]))
    stop = start + timedelta(hours=hours * 11, seconds=len(points))
    parts = candle_cells.cover(start, stop)
    assert parts[0][1] == start and parts[-1][2] == stop
    assert all(a[2] == b[1] for a, b in zip(parts, parts[1:], strict=False))
    for level, a, b in parts:
        assert a < b
        if level:
            assert not any((t - datetime(1970, 1, 1)).total_seconds() % level for t in (a, b))
    assert len(parts) <= 2 * len(candle_cells.LEVELS) + 1


def test_merged_moments_are_those_of_all_rows(spark):
    rng = random.Random(2)
    rows = [("A", 700 * i, 1e9 + rng.random()) for i in range(50)] + [("B", 0, 3.0), ("C", 0, None), ("C", 1500, None)]
    df = silver_rows(spark, rows)
    merged = moments.summary_of(moments.merge_moments(moments.moment_cells(df)))
    full = history.price_summary(df)
    assert_close(values(merged, *full.columns), values(full, *full.columns), 1e-7)


def test_ranges_from_cells_and_edges(spark, layout):
    df = silver_rows(spark, market(6))
    append_silver(df, layout.silver)
    incremental.refresh_gold_by_date(spark, layout)
    rows = spark.read.parquet(layout.gold(incremental.HISTORY))
    cells = spark.read.parquet(layout.gold(incremental.MOMENTS))
    levels = incremental.candle_levels(spark, layout)
    for start, end in [
        (datetime(2024, 1, 1, 7, 3), datetime(2024, 1, 5, 19, 50, 1)),
        (datetime(2024, 1, 2, 7), datetime(2024, 1, 2, 9)),
        (datetime(2024, 1, 2), datetime(2024, 1, 3)),
        (datetime(2024, 1, 2, 7, 1), datetime(2024, 1, 2, 7, 2)),
    ]:
        direct = dashboard.z_score_series(rows, start, end, digits=6)
        assert values(dashboard.z_score_range(rows, cells, start, end, digits=6), *direct.columns) == values(
            direct, *direct.columns
        )
        seen = dashboard.in_time_range(rows, start, end).selectExpr("symbol", "price", "observed_at").groupBy("symbol")
        want = seen.agg({"price": "max"}).toDF("symbol", "high")
        got = candle_cells.range_candles(levels, rows, start, end)
        assert values(got, "symbol", "high") == values(want, "symbol", "high")


def test_dates_that_are_not_needed_stay_shut(spark, layout):
    append_silver(silver_rows(spark, market(6)), layout.silver)
    incremental.refresh_gold_by_date(spark, layout)
    rows = spark.read.parquet(layout.gold(incremental.HISTORY))
    cells = spark.read.parquet(layout.gold(incremental.MOMENTS))
    for day in ("2024-01-03", "2024-01-04"):  # inside the range: only their cells are read
        for file in Path(layout.gold(incremental.HISTORY), f"observed_date={day}").glob("*.parquet"):
            file.write_bytes(b"not to be read")
    found = moments.range_moments(cells, rows, datetime(2024, 1, 2, 5), datetime(2024, 1, 5, 5))
    assert found.count() == 2
    shutil.rmtree(Path(layout.gold(incremental.HISTORY), "observed_date=2024-01-03"))
