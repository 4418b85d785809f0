import math

import pytest
from pyspark.sql import functions as F

from helpers import minutes, values
from pricetide.operators import anomalies, history, indicators, snapshot
from pricetide.plans import kpis


def test_latest_snapshot_is_of_the_whole_table(obs):
    rows = obs([
        ("a", "A", 0, 1.0, 10.0, 1.0), ("b", "B", 0, 1.0, 99.0, 1.0),
        ("a", "A", 1, 2.0, 10.0, 5.0), ("c", "C", 1, 3.0, 30.0, 6.0), ("d", "D", 1, 3.0, None, 6.0),
    ])
    assert values(snapshot.latest_snapshot(rows), "asset_id") == [("a",), ("c",), ("d",)]
    assert [r["asset_id"] for r in snapshot.top_assets(rows).collect()] == ["c", "a", "d"]
    assert [r["asset_id"] for r in snapshot.top_assets(rows, 1).collect()] == ["c"]
    share = snapshot.market_dominance(rows)
    assert values(share, "symbol", "market_dominance_pct") == [
        ("A", 25.0), ("C", 75.0), ("D", None),
    ]


def test_latest_snapshot_reads_the_newest_partition_only(spark, obs, tmp_path):
    rows = obs([("a", "A", 1440 * day + m, 1.0, 5.0) for day in range(5) for m in range(3)])
    dated = rows.withColumn("observed_date", F.to_date("observed_at"))
    dated.write.partitionBy("observed_date").parquet(str(tmp_path / "t"))
    latest = snapshot.latest_snapshot(spark.read.parquet(str(tmp_path / "t")))
    assert values(latest, "observed_at") == [(minutes(4 * 1440 + 2),)]
    latest.collect()
    plan = latest._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(observed_date" in plan
    assert snapshot.market_dominance(spark.read.parquet(str(tmp_path / "t"))).count() == 1


@pytest.mark.parametrize("caps", [(0.0, 0.0), (None, None), (-1.0, 0.5)])
def test_dominance_without_a_positive_total_is_empty(obs, caps):
    rows = obs([("a", "A", 0, 1.0, caps[0]), ("b", "B", 0, 1.0, caps[1])])
    assert snapshot.market_dominance(rows).count() == 0


def test_dominance_sums_to_a_hundred(obs):
    rows = obs([(str(i), str(i), 0, 1.0, float(i * i + 1)) for i in range(17)])
    total = snapshot.market_dominance(rows, digits=None).agg(F.sum("market_dominance_pct")).first()[0]
    assert total == pytest.approx(100.0)


def test_liquidity_of_a_zero_cap_is_null(obs):
    rows = obs([("a", "A", 0, 1.0, 0.0, 5.0), ("b", "B", 0, 1.0, 3.0, 1.0)])
    assert values(snapshot.liquidity(rows), "symbol", "liquidity_ratio") == [
        ("A", None), ("B", 0.3333),
    ]


def test_volatility_and_history(obs):
    rows = obs([("a", "A", 0, 2.0), ("a", "A", 1, 4.0), ("b", "B", 0, 5.0)])
    got = {r["symbol"]: r for r in history.volatility(rows).collect()}
    assert got["A"]["price_stddev"] == pytest.approx(math.sqrt(2))
    assert got["A"]["price_range_pct"] == pytest.approx(200 / 3)
    assert got["A"]["volatility_pct"] == 47.1405
    assert got["B"]["volatility_pct"] is None
    assert values(history.history_stats(rows), "symbol", "avg_price", "max_price", "min_price") == [
        ("A", 3.0, 4.0, 2.0), ("B", 5.0, 5.0, 5.0),
    ]


def test_price_changes_skip_the_first_row_and_a_zero_divisor(obs):
    rows = obs([("a", "A", 2, 3.0), ("a", "A", 0, 0.0), ("a", "A", 1, 2.0), ("b", "B", 0, 1.0)])
    assert values(
        indicators.price_changes(rows), "observed_at", "prev_price", "price_change_pct"
    ) == [(minutes(1), 0.0, None), (minutes(2), 2.0, 50.0)]


def test_time_ties_are_ordered_by_asset(obs):
    rows = obs([("y", "A", 0, 2.0), ("x", "A", 0, 1.0)])
    assert values(indicators.price_changes(rows), "price", "prev_price") == [(2.0, 1.0)]


def test_moving_average_of_a_short_start(obs):
    rows = obs([("a", "A", i, float(i)) for i in range(9)])
    got = values(indicators.moving_averages(rows, (7, 14)), "price", "ma_7", "ma_14")
    assert got[0] == (0.0, 0.0, 0.0)
    assert got[8] == (8.0, 5.0, 4.0)


def test_momentum_needs_all_moves_and_caps_at_a_hundred(obs):
    up = [("a", "A", i, float(i + 1)) for i in range(16)]
    mixed = [("b", "B", i, 10.0 + (i % 2)) for i in range(16)]
    got = values(indicators.momentum(obs(up + mixed)), "symbol", "observed_at", "rsi")
    assert [g[2] for g in got[:14]] == [None] * 14
    assert [g[2] for g in got[14:16]] == [100.0, 100.0]
    assert got[30][2] == 50.0


def test_indicators_equal_their_parts(obs):
    rows = obs([("a", "A", i, float((i * 7) % 5 + 1)) for i in range(40)])
    table = indicators.indicators(rows)
    for name, alone in (
        ("price_changes", indicators.price_changes(rows)),
        ("moving_averages", indicators.moving_averages(rows)),
        ("moving_average_30", indicators.moving_averages(rows, (30,))),
        ("momentum", indicators.momentum(rows)),
    ):
        cut = kpis.from_indicators(table, name)
        assert sorted(cut.columns) == sorted(alone.columns)
        assert values(cut, *sorted(cut.columns)) == values(alone, *sorted(cut.columns))


def test_anomaly_sides_and_degenerate_series(obs):
    rows = obs(
        [("a", "A", i, 10.0) for i in range(9)] + [("a", "A", 9, 100.0)]
        + [("b", "B", i, 100.0) for i in range(9)] + [("b", "B", 9, 10.0)]
        + [("c", "C", i, 7.0) for i in range(3)] + [("d", "D", 0, 7.0)]
    )
    upper = anomalies.anomalies(rows)
    assert values(upper, "symbol", "price", "is_anomaly") == [("A", 100.0, True)]
    both = anomalies.anomalies(rows, side="both")
    assert values(both, "symbol", "price") == [("A", 100.0), ("B", 10.0)]
    with pytest.raises(ValueError):
        anomalies.anomalies(rows, side="lower")


def test_gold_compares_the_rounded_score_and_the_feed_the_exact_one(obs):
    # z is just above 2 before rounding, and 2.0 after.
    rows = obs([("a", "A", 0, 1.0), ("a", "A", 1, 3.0)])
    scored = anomalies.z_scores(rows, digits=None)
    top = max(r["z_score"] for r in scored.collect())
    just_below = top - 1e-6
    assert anomalies.anomalies(rows, threshold=just_below).count() == 0
    flags = anomalies.anomaly_feed(rows, threshold=just_below)
    assert values(flags, "is_anomaly") == [(True,), (True,)]


def test_feed_ranks_all_rows_with_missing_scores_last(obs):
    rows = obs([("a", "A", i, float(i)) for i in range(5)] + [("b", "B", 0, 1.0)])
    feed = anomalies.anomaly_feed(rows, n=6).collect()
    assert feed[-1]["symbol"] == "B" and feed[-1]["z_score"] is None
    assert [abs(r["z_score"]) for r in feed[:5]] == sorted(
        (abs(r["z_score"]) for r in feed[:5]), reverse=True
    )
    assert anomalies.anomaly_feed(rows, n=2).count() == 2


def test_candles(obs):
    rows = obs([("a", "A", m, p) for m, p in ((14, 4.0), (1, 2.0), (7, 9.0), (3, 1.0), (15, 5.0))])
    assert values(history.candles(rows), "window_start", "open", "high", "low", "close") == [
        (minutes(0), 2.0, 9.0, 1.0, 4.0), (minutes(15), 5.0, 5.0, 5.0, 5.0),
    ]
    tied = obs([("y", "A", 0, 2.0), ("x", "A", 0, 1.0), ("z", "A", 0, 3.0)])
    assert values(history.candles(tied, break_ties=True), "open", "close") == [(1.0, 3.0)]
    spread = history.spread(rows, "15 minutes")
    assert values(spread, "window_start", "spread") == [(minutes(0), 8.0), (minutes(15), 0.0)]


def test_all_kpis_are_lazy_tables_by_name(obs):
    rows = obs([("a", "A", i, float(i + 1), 5.0, 1.0) for i in range(3)])
    tables = kpis.all_kpis(rows)
    assert {"top_assets", "momentum", "volatility_rolling", "spread", "anomalies_both"} <= set(tables)
    assert all(t.count() >= 0 for t in tables.values())


def test_candles_bound_their_open_and_close(obs):
    rows = obs([("a", "A", m, float((m * 37) % 101)) for m in range(200)])
    candles = history.candles(rows)
    assert candles.filter("low > open or low > close or high < open or high < close").count() == 0
    assert candles.count() == 14
