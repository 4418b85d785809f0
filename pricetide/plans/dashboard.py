"""The dashboard's read queries, as functions over gold and silver tables."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import UTC, datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide.functions import (
    anomaly_label,
    change_sign,
    liquidity_band,
    volatility_band,
    z_band,
)
from pricetide.operators import anomalies, history
from pricetide.operators.moments import range_moments, summary_of
from pricetide.schema import OBS, Cols
from pricetide.session import stage

DEFAULT_RANGE = timedelta(hours=6)


def symbol_list(top_assets: DataFrame, c: Cols = OBS) -> DataFrame:
    """Choices of the symbol picker, ordered."""
    return top_assets.select(c.symbol).distinct().orderBy(c.symbol)


def with_symbols(df: DataFrame, symbols: Sequence[str] | None, c: Cols = OBS) -> DataFrame:
    """Rows of the chosen symbols; ``None`` means all."""
    return df if symbols is None else df.filter(F.col(c.symbol).isin(list(symbols)))


def in_time_range(
    df: DataFrame,
    start: datetime | None = None,
    end: datetime | None = None,
    now: datetime | None = None,
    c: Cols = OBS,
) -> DataFrame:
    """Rows in ``[start, end]``; without a start, the last six hours up to ``end``.

    The bounds are literals of the column's own type, so they are pushed to the scan. If
    the rows have their date, so are bounds on that: other date partitions stay shut.
    """
    end = end or now or datetime.now(UTC).replace(tzinfo=None)
    start = start or end - DEFAULT_RANGE
    dtype = df.schema[c.time].dataType

    def bound(value: datetime) -> Column:
        return F.lit(value.isoformat(sep=" ")).cast(dtype)

    visible = df.filter(F.col(c.time).between(bound(start), bound(end)))
    if c.date not in df.columns:
        return visible
    return visible.filter(F.col(c.date).between(F.lit(start.date()), F.lit(end.date())))


def _shown(
    df: DataFrame,
    symbols: Sequence[str] | None,
    start: datetime | None,
    end: datetime | None,
    c: Cols,
) -> DataFrame:
    """Rows of the chosen symbols and time range; without either bound, of all times."""
    chosen = with_symbols(df, symbols, c)
    return chosen if start is None and end is None else in_time_range(chosen, start, end, c=c)


def snapshot_table(
    top_assets: DataFrame, symbols: Sequence[str] | None = None, c: Cols = OBS
) -> DataFrame:
    """Current prices, caps, volumes and changes by market cap."""
    columns = (c.symbol, c.name, c.price, c.market_cap, c.volume, c.change)
    return (
        with_symbols(top_assets, symbols, c)
        .select(*columns)
        .orderBy(F.desc_nulls_last(c.market_cap), c.symbol)
    )


def _total(df: DataFrame, column: str, label: str) -> DataFrame:
    total = df.agg(F.sum(column).alias("value"))
    return total.select(F.lit(label).alias("metric"), "value")


def total_market_cap(top_assets: DataFrame, c: Cols = OBS) -> DataFrame:
    """Total of the whole snapshot, whatever symbols are picked."""
    return _total(top_assets, c.market_cap, "Total Market Cap")


def total_volume(top_assets: DataFrame, c: Cols = OBS) -> DataFrame:
    """Total 24 h volume of the whole snapshot, whatever symbols are picked."""
    return _total(top_assets, c.volume, "Total 24h Volume")


def price_ma_series(
    moving_averages: DataFrame,
    symbols: Sequence[str] | None = None,
    c: Cols = OBS,
    start: datetime | None = None,
    end: datetime | None = None,
) -> DataFrame:
    """Price and moving averages by time; the symbol keeps several series apart."""
    averages = [n for n in moving_averages.columns if n.startswith("ma_")]
    return (
        _shown(moving_averages, symbols, start, end, c)
        .select(c.time, c.symbol, c.price, *averages)
        .orderBy(c.time, c.symbol)
    )


def _ranking(
    df: DataFrame, by: str, short: Sequence[str], detail: Sequence[str], full: bool,
    symbols: Sequence[str] | None, c: Cols,
) -> DataFrame:
    columns = detail if full else short
    return (
        with_symbols(df, symbols, c)
        .select(*columns)
        .orderBy(F.desc_nulls_last(by), c.symbol)
    )


def volatility_ranking(
    volatility: DataFrame, detail: bool = False, symbols: Sequence[str] | None = None,
    c: Cols = OBS,
) -> DataFrame:
    short = (c.symbol, "volatility_pct", "price_range_pct")
    full = (*short, "avg_price", "price_stddev")
    return _ranking(volatility, "volatility_pct", short, full, detail, symbols, c)


def dominance_ranking(
    dominance: DataFrame, detail: bool = False, symbols: Sequence[str] | None = None,
    c: Cols = OBS,
) -> DataFrame:
    short = (c.symbol, "market_dominance_pct")
    full = (c.symbol, c.name, c.market_cap, "market_dominance_pct")
    return _ranking(dominance, "market_dominance_pct", short, full, detail, symbols, c)


def liquidity_ranking(
    liquidity: DataFrame, detail: bool = False, symbols: Sequence[str] | None = None,
    c: Cols = OBS,
) -> DataFrame:
    short = (c.symbol, "liquidity_ratio")
    full = (c.symbol, c.name, c.volume, c.market_cap, "liquidity_ratio")
    return _ranking(liquidity, "liquidity_ratio", short, full, detail, symbols, c)


def anomaly_feed(
    observations: DataFrame, symbols: Sequence[str] | None = None, n: int = 50, c: Cols = OBS
) -> DataFrame:
    """The feed's top ``n`` rows by absolute z-score, with the display label."""
    feed = anomalies.anomaly_feed(with_symbols(observations, symbols, c), n, c=c)
    return feed.withColumn("label", anomaly_label(F.col("is_anomaly")))


def z_score_series(
    history_rows: DataFrame,
    start: datetime,
    end: datetime,
    symbols: Sequence[str] | None = None,
    digits: int | None = 3,
    c: Cols = OBS,
) -> DataFrame:
    """Z-scores relative to the visible range only, by time."""
    visible = in_time_range(with_symbols(history_rows, symbols, c), start, end, c=c)
    return anomalies.z_scores(visible, digits, c).orderBy(c.time, c.symbol)


def z_score_range(
    history_rows: DataFrame,
    cells: DataFrame,
    start: datetime,
    end: datetime,
    symbols: Sequence[str] | None = None,
    digits: int | None = 3,
    c: Cols = OBS,
) -> DataFrame:
    """:func:`z_score_series` with statistics from stored moment cells.

    The statistics read rows of the first and the last day only. The rows that come out are
    scored as they are read: nothing passes over the range twice.
    """
    rows = with_symbols(history_rows, symbols, c)
    moments = range_moments(with_symbols(cells, symbols, c), rows, start, end, c)
    summary = stage(summary_of(moments, c), "key-stats")
    visible = in_time_range(rows, start, end, c=c)
    return anomalies.z_scores(visible, digits, c, summary).orderBy(c.time, c.symbol)


def candle_series(
    history_rows: DataFrame,
    duration: str = "15 minutes",
    symbols: Sequence[str] | None = None,
    c: Cols = OBS,
    start: datetime | None = None,
    end: datetime | None = None,
) -> DataFrame:
    """Candles of the rows in the range; one that the range cuts has the rows inside."""
    candles = history.candles(_shown(history_rows, symbols, start, end, c), duration, c=c)
    return candles.orderBy("window_start", c.symbol)


def volume_series(
    history_rows: DataFrame,
    duration: str = "15 minutes",
    digits: int | None = None,
    symbols: Sequence[str] | None = None,
    c: Cols = OBS,
    start: datetime | None = None,
    end: datetime | None = None,
) -> DataFrame:
    rows = _shown(history_rows, symbols, start, end, c)
    bars = history.volume_bars(rows, duration, digits, c)
    return bars.orderBy("window_start", c.symbol)


def history_stats_ranked(
    stats: DataFrame, symbols: Sequence[str] | None = None, c: Cols = OBS
) -> DataFrame:
    return (
        with_symbols(stats, symbols, c)
        .select(c.symbol, "avg_price", "max_price", "min_price")
        .orderBy(F.desc_nulls_last("avg_price"), c.symbol)
    )


def series_last_max_min(
    series: DataFrame, values: Sequence[str] | None = None, c: Cols = OBS
) -> DataFrame:
    """Last, highest and lowest value of each displayed series, one row per series.

    The input is read and shuffled once for all series.
    """
    names = list(values or [n for n in series.columns if n == c.price or n.startswith("ma_")])
    wide = series.groupBy(c.symbol).agg(
        *[
            f(n).alias(f"{n}__{stat}")
            for n in names
            for stat, f in (
                ("last", lambda v: F.max_by(v, c.time)),
                ("max", F.max),
                ("min", F.min),
            )
        ]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(n).alias("series"),
                *[F.col(f"{n}__{stat}").alias(f"{stat}_value") for stat in ("last", "max", "min")],
            )
            for n in names
        ]
    )
    return wide.select(c.symbol, F.inline(rows))


def risk_bands(
    volatility: DataFrame, liquidity: DataFrame, c: Cols = OBS
) -> DataFrame:
    """Volatility and liquidity band of each symbol in the latest snapshot."""
    volatile = volatility.select(
        c.symbol, "volatility_pct", volatility_band(F.col("volatility_pct")).alias("volatility_band")
    )
    liquid = liquidity.select(
        c.symbol, "liquidity_ratio", liquidity_band(F.col("liquidity_ratio")).alias("liquidity_band")
    )
    return volatile.join(liquid, c.symbol)


def move_bands(
    changes: DataFrame, scores: DataFrame, c: Cols = OBS
) -> DataFrame:
    """Sign band of each price change and z band of each score, row counts per symbol."""
    parts = [
        changes.select(c.symbol, change_sign(F.col("price_change_pct")).alias("band")),
        scores.select(c.symbol, z_band(F.col("z_score")).alias("band")),
    ]
    return (
        reduce(DataFrame.unionByName, parts)
        .groupBy(c.symbol, "band")
        .agg(F.count(F.lit(1)).alias("row_count"))
    )
