"""Row-by-row indicators: price change, moving averages and momentum.

All of them share one window per symbol, so :func:`indicators` computes them together
with a single shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from pricetide.functions import percent_of, rounded
from pricetide.operators.frames import CELL_SECONDS, ROWS_PER_CHUNK, over_rows
from pricetide.schema import OBS, Cols

MOVING_AVERAGE_ROWS = (7, 14)
RSI_ROWS = 14


def _series(df: DataFrame, c: Cols) -> DataFrame:
    return df.select(c.time, c.symbol, c.asset_id, c.price)


def _change(digits: int | None, c: Cols) -> Column:
    delta = F.col(c.price) - F.col("prev_price")
    return rounded(percent_of(delta, F.col("prev_price")), digits)


def _prev_price(window: WindowSpec, c: Cols) -> Column:
    return F.lag(c.price, 1).over(window)


def _average(rows: int, window: WindowSpec, digits: int | None, c: Cols) -> Column:
    return rounded(F.avg(c.price).over(window.rowsBetween(1 - rows, 0)), digits)


def _with_rsi(
    df: DataFrame, window: WindowSpec, rows: int, digits: int | None
) -> DataFrame:
    frame = window.rowsBetween(1 - rows, 0)
    gain = F.greatest(F.col("_delta"), F.lit(0.0))
    loss = F.greatest(-F.col("_delta"), F.lit(0.0))
    # greatest() skips NULL, so the missing first delta is masked explicitly.
    known = F.col("_delta").isNotNull()
    averaged = df.withColumns(
        {
            "_gain": F.avg(F.when(known, gain)).over(frame),
            "_loss": F.avg(F.when(known, loss)).over(frame),
            "_deltas": F.count("_delta").over(frame),
        }
    )
    strength = F.try_divide(F.col("_gain"), F.col("_loss"))
    index = F.when(F.col("_loss") == 0, F.lit(100.0)).otherwise(
        F.lit(100.0) - F.try_divide(F.lit(100.0), F.lit(1.0) + strength)
    )
    rsi = F.when(F.col("_deltas") == rows, rounded(index, digits))
    return averaged.withColumn("rsi", rsi).drop("_gain", "_loss", "_deltas")


def price_changes(
    df: DataFrame,
    digits: int | None = 4,
    rows_per_chunk: int | None = ROWS_PER_CHUNK,
    c: Cols = OBS,
) -> DataFrame:
    """Percent change against the previous row; a symbol's first row is left out."""

    def add(rows: DataFrame, window: WindowSpec) -> DataFrame:
        return rows.withColumn("prev_price", _prev_price(window, c))

    framed = over_rows(_series(df, c), add, 1, rows_per_chunk, c)
    return (
        framed.filter(F.col("prev_price").isNotNull())
        .withColumn("price_change_pct", _change(digits, c))
        .drop(c.asset_id)
    )


def moving_averages(
    df: DataFrame,
    rows: tuple[int, ...] = MOVING_AVERAGE_ROWS,
    digits: int | None = 4,
    rows_per_chunk: int | None = ROWS_PER_CHUNK,
    c: Cols = OBS,
    cell_seconds: int = CELL_SECONDS,
) -> DataFrame:
    """Mean of the last n prices for each n; a shorter start averages what exists."""

    def add(series: DataFrame, window: WindowSpec) -> DataFrame:
        return series.withColumns(
            {f"ma_{n}": _average(n, window, digits, c) for n in rows}
        )

    lookback = max(max(rows) - 1, 1)
    return over_rows(_series(df, c), add, lookback, rows_per_chunk, c, cell_seconds).drop(c.asset_id)


def momentum(
    df: DataFrame,
    rows: int = RSI_ROWS,
    digits: int | None = 4,
    rows_per_chunk: int | None = ROWS_PER_CHUNK,
    c: Cols = OBS,
) -> DataFrame:
    """Relative strength index over simple means of the last ``rows`` price moves.

    NULL until ``rows`` moves exist; 100 when none of them is a loss.
    """

    def add(series: DataFrame, window: WindowSpec) -> DataFrame:
        moved = series.withColumn("_delta", F.col(c.price) - _prev_price(window, c))
        return _with_rsi(moved, window, rows, digits).drop("_delta")

    return over_rows(_series(df, c), add, rows, rows_per_chunk, c).drop(c.asset_id)


def rolling_volatility(
    df: DataFrame,
    rows: int = 30,
    digits: int | None = 4,
    rows_per_chunk: int | None = ROWS_PER_CHUNK,
    c: Cols = OBS,
) -> DataFrame:
    """Coefficient of variation of the last ``rows`` prices, in percent."""

    def add(series: DataFrame, window: WindowSpec) -> DataFrame:
        frame = window.rowsBetween(1 - rows, 0)
        ratio = percent_of(F.stddev(c.price).over(frame), F.avg(c.price).over(frame))
        return series.withColumn("rolling_volatility_pct", rounded(ratio, digits))

    framed = over_rows(_series(df, c), add, max(rows - 1, 1), rows_per_chunk, c)
    return framed.drop(c.asset_id)


def indicators(
    df: DataFrame,
    averages: tuple[int, ...] = (*MOVING_AVERAGE_ROWS, 30),
    rsi_rows: int = RSI_ROWS,
    digits: int | None = 4,
    rows_per_chunk: int | None = ROWS_PER_CHUNK,
    c: Cols = OBS,
) -> DataFrame:
    """Previous price, change, moving averages and RSI of every row, in one shuffle."""

    def add(series: DataFrame, window: WindowSpec) -> DataFrame:
        wide = series.withColumns(
            {
                "prev_price": _prev_price(window, c),
                **{f"ma_{n}": _average(n, window, digits, c) for n in averages},
            }
        ).withColumn("_delta", F.col(c.price) - F.col("prev_price"))
        return _with_rsi(wide, window, rsi_rows, digits).drop("_delta")

    lookback = max(max(averages) - 1, rsi_rows)
    framed = over_rows(_series(df, c), add, lookback, rows_per_chunk, c)
    return framed.withColumn("price_change_pct", _change(digits, c)).drop(c.asset_id)
