"""KPIs that aggregate a symbol's history, whole or per time window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide.functions import percent_of, rounded
from pricetide.schema import OBS, Cols


def price_history(df: DataFrame, c: Cols = OBS) -> DataFrame:
    """The time series the read queries work on, with its date if there is one."""
    date = [c.date] if c.date in df.columns else []
    return df.select(c.time, c.symbol, c.price, c.volume, c.market_cap, *date)


def _moments(price: str) -> list[Column]:
    return [
        F.stddev(price).alias("price_stddev"),
        F.avg(price).alias("avg_price"),
        F.max(price).alias("max_price"),
        F.min(price).alias("min_price"),
    ]


def _dispersion(raw_digits: int | None, pct_digits: int | None) -> list[Column]:
    stddev, mean = F.col("price_stddev"), F.col("avg_price")
    spread = F.col("max_price") - F.col("min_price")
    return [
        rounded(stddev, raw_digits).alias("price_stddev"),
        rounded(mean, raw_digits).alias("avg_price"),
        rounded(percent_of(spread, mean), raw_digits).alias("price_range_pct"),
        rounded(percent_of(stddev, mean), pct_digits).alias("volatility_pct"),
    ]


def price_summary(df: DataFrame, c: Cols = OBS) -> DataFrame:
    """Sample deviation, mean, highest and lowest price per symbol.

    Partial aggregation absorbs hot symbols. Volatility, history statistics and z-scores
    are all functions of this table.
    """
    return df.groupBy(c.symbol).agg(*_moments(c.price))


def volatility_of(
    summary: DataFrame,
    raw_digits: int | None = None,
    pct_digits: int | None = 4,
    c: Cols = OBS,
) -> DataFrame:
    return summary.select(c.symbol, *_dispersion(raw_digits, pct_digits))


def history_stats_of(summary: DataFrame, digits: int | None = None, c: Cols = OBS) -> DataFrame:
    mean = rounded(F.col("avg_price"), digits).alias("avg_price")
    return summary.select(c.symbol, mean, "max_price", "min_price")


def volatility(
    df: DataFrame,
    raw_digits: int | None = None,
    pct_digits: int | None = 4,
    c: Cols = OBS,
) -> DataFrame:
    """Sample deviation, mean, range and coefficient of variation per symbol."""
    return volatility_of(price_summary(df, c), raw_digits, pct_digits, c)


def history_stats(df: DataFrame, digits: int | None = None, c: Cols = OBS) -> DataFrame:
    """Mean, highest and lowest price per symbol."""
    return history_stats_of(price_summary(df, c), digits, c)


def _by_window(df: DataFrame, duration: str, aggregates: list[Column], c: Cols) -> DataFrame:
    grouped = df.groupBy(F.window(c.time, duration).alias("_w"), c.symbol).agg(*aggregates)
    values = [n for n in grouped.columns if n not in ("_w", c.symbol)]
    return grouped.select(
        F.col("_w.start").alias("window_start"), c.symbol, *values
    )


def windowed_volatility(
    df: DataFrame,
    duration: str = "1 hour",
    raw_digits: int | None = None,
    pct_digits: int | None = 4,
    c: Cols = OBS,
) -> DataFrame:
    """:func:`volatility` per symbol and tumbling time window."""
    windows = _by_window(df, duration, _moments(c.price), c)
    return windows.select("window_start", c.symbol, *_dispersion(raw_digits, pct_digits))


def spread(
    df: DataFrame, duration: str = "1 day", digits: int | None = None, c: Cols = OBS
) -> DataFrame:
    """Highest minus lowest price per symbol and tumbling time window."""
    high, low = F.max(c.price), F.min(c.price)
    return _by_window(
        df,
        duration,
        [
            high.alias("high"),
            low.alias("low"),
            rounded(high - low, digits).alias("spread"),
        ],
        c,
    )


def candles(
    df: DataFrame, duration: str = "15 minutes", break_ties: bool = False, c: Cols = OBS
) -> DataFrame:
    """Open, high, low and close per symbol and bucket.

    Open and close are the earliest and latest price by time, which keeps the aggregate
    hash-based. ``break_ties`` orders equal times by asset, for symbols that several
    assets share; Spark then aggregates by sorting.
    """
    order = F.struct(*c.order) if break_ties else F.col(c.time)
    return _by_window(
        df,
        duration,
        [
            F.min(c.price).alias("low"),
            F.max(c.price).alias("high"),
            F.min_by(c.price, order).alias("open"),
            F.max_by(c.price, order).alias("close"),
        ],
        c,
    )


def volume_bars(
    df: DataFrame, duration: str = "15 minutes", digits: int | None = None, c: Cols = OBS
) -> DataFrame:
    """Mean volume per symbol and bucket; the input is a rolling 24 h figure."""
    return _by_window(df, duration, [rounded(F.avg(c.volume), digits).alias("volume")], c)
