import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from helpers import minutes, values
from pricetide.functions import change_sign, liquidity_band, volatility_band, z_band
from pricetide.operators import history, indicators, snapshot
from pricetide.plans import dashboard


def test_symbol_picker_and_filter(obs):
    rows = obs([("b", "B", 0, 1.0), ("a", "A", 0, 1.0), ("b2", "B", 0, 1.0)])
    assert [r[0] for r in dashboard.symbol_list(rows).collect()] == ["A", "B"]
    assert dashboard.with_symbols(rows, None).count() == 3
    assert dashboard.with_symbols(rows, ["A"]).count() == 1
    assert dashboard.with_symbols(rows, []).count() == 0


def test_time_range_is_inclusive_and_defaults_to_six_hours(obs):
    rows = obs([("a", "A", m, 1.0) for m in (0, 10, 359, 360, 370)])
    ranged = dashboard.in_time_range(rows, minutes(10), minutes(360))
    assert values(ranged, "observed_at") == [(minutes(10),), (minutes(359),), (minutes(360),)]
    assert dashboard.in_time_range(rows, now=minutes(370)).count() == 4


def test_time_range_is_pushed_to_the_scan(spark, obs, tmp_path):
    obs([("a", "A", 0, 1.0)]).write.parquet(str(tmp_path / "t"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    ranged = dashboard.in_time_range(
        spark.read.parquet(str(tmp_path / "t")), datetime(2024, 1, 1), datetime(2024, 1, 2)
    )
    plan = ranged._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(observed_at" in plan and "LessThanOrEqual(observed_at" in plan


def test_totals_and_tables(obs):
    rows = obs([("a", "A", 0, 1.0, 5.0, 2.0), ("b", "B", 0, 1.0, 7.0, 3.0), ("c", "C", 0, 1.0)])
    top = snapshot.top_assets(rows)
    assert values(dashboard.total_market_cap(top), "metric", "value") == [("Total Market Cap", 12.0)]
    assert values(dashboard.total_volume(top), "metric", "value") == [("Total 24h Volume", 5.0)]
    assert [r["symbol"] for r in dashboard.snapshot_table(top).collect()] == ["B", "A", "C"]
    assert [r["symbol"] for r in dashboard.snapshot_table(top, ["C", "A"]).collect()] == ["A", "C"]
    short = dashboard.liquidity_ranking(snapshot.liquidity(rows))
    assert [tuple(r) for r in short.collect()] == [("B", 0.4286), ("A", 0.4), ("C", None)]
    full = dashboard.dominance_ranking(snapshot.market_dominance(rows), detail=True)
    assert full.columns == ["symbol", "name", "market_cap", "market_dominance_pct"]


def test_scores_are_relative_to_the_visible_range(obs):
    rows = obs([("a", "A", m, p) for m, p in ((0, 1.0), (1, 3.0), (2, 1000.0))])
    visible = dashboard.z_score_series(rows, minutes(0), minutes(1))
    assert values(visible, "observed_at", "z_score") == [
        (minutes(0), -0.707), (minutes(1), 0.707),
    ]


def test_series_reducers(obs):
    rows = obs([("a", "A", m, p) for m, p in ((2, 2.0), (0, 5.0), (1, 1.0))])
    averages = indicators.moving_averages(rows, (2,))
    assert values(dashboard.series_last_max_min(averages), "series", "last_value", "max_value", "min_value") == [
        ("ma_2", 1.5, 5.0, 1.5), ("price", 2.0, 5.0, 1.0),
    ]


@pytest.mark.parametrize(
    ("band", "cases"),
    [
        (volatility_band, {4.99: "low", 5.0: "mid", 14.9: "mid", 15.0: "high", None: None}),
        (liquidity_band, {0.0299: "low", 0.03: "mid", 0.1: "high"}),
        (z_band, {-3.0: "normal", 1.49: "normal", 1.5: "watch", 2.0: "anomaly"}),
        (change_sign, {-0.01: "negative", 0.0: "non_negative", None: None}),
    ],
)
def test_bands(spark, band, cases):
    df = spark.createDataFrame([(v,) for v in cases], "v double")
    assert [r[0] for r in df.select(band(F.col("v"))).collect()] == list(cases.values())


def test_feed_has_labels(obs):
    rows = obs([("a", "A", i, 10.0) for i in range(9)] + [("a", "A", 9, 99.0), ("b", "B", 0, 1.0)])
    feed = dashboard.anomaly_feed(rows).collect()
    assert [r["label"] for r in feed[:2]] == ["ANOMALY", "normal"]
    assert feed[-1]["label"] is None


def test_a_time_range_opens_only_its_dates(spark, obs, tmp_path):
    rows = obs([("a", "A", day * 1440, 1.0 + day, 1.0, 1.0) for day in range(9)])
    rows.withColumn("observed_date", F.to_date("observed_at")).write.partitionBy("observed_date").parquet(
        str(tmp_path / "silver")
    )
    silver = spark.read.parquet(str(tmp_path / "silver"))
    start, end = minutes(2 * 1440), minutes(3 * 1440)
    for shown in (
        dashboard.in_time_range(history.price_history(silver), start, end),
        dashboard.candle_series(silver, start=start, end=end),
        dashboard.volume_series(silver, start=start, end=end),
        dashboard.z_score_series(silver, start, end),
    ):
        plan = shown._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"PartitionFilters: \[[^\]]*observed_date", plan)
        assert shown.count() == 2
