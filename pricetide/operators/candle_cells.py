"""A hierarchy of candle cells: quarter hours merge into hours, hours into days.

A cell has the first and last price with their times, the extremes, and sums and numbers
of prices and volumes. Cells of any stretches merge without their rows, so candles of any
width come from the widest cells that divide it, and any time range is covered by days
inside, hours and quarter hours at its edges, and rows only beyond those.
"""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide.functions import percent_of, rounded
from pricetide.schema import OBS, Cols

# Seconds of each level; each divides the next, and the last is a date partition.
LEVELS = (900, 3600, 86400)

_EPOCH = datetime(1970, 1, 1)


def bucket_start(time: Column, seconds: int) -> Column:
    """The start of the epoch-aligned stretch of ``seconds`` that holds ``time``."""
    return F.timestamp_seconds(F.floor(time.cast("timestamp").cast("long") / F.lit(seconds)) * F.lit(seconds))


def candle_cells(df: DataFrame, seconds: int = LEVELS[0], c: Cols = OBS) -> DataFrame:
    """Cells of rows, per symbol and stretch of ``seconds``; ``start`` is where it begins."""
    keyed = df.withColumn("start", bucket_start(F.col(c.time), seconds))
    return keyed.groupBy("start", c.symbol).agg(
        F.min(c.time).alias("open_at"),
        F.min_by(c.price, c.time).alias("open"),
        F.max(c.time).alias("close_at"),
        F.max_by(c.price, c.time).alias("close"),
        F.min(c.price).alias("low"),
        F.max(c.price).alias("high"),
        F.count(c.price).alias("n"),
        F.sum(c.price).alias("total"),
        F.count(c.volume).alias("volume_n"),
        F.sum(c.volume).alias("volume_total"),
    )


def _merged() -> list[Column]:
    return [
        F.min("open_at").alias("open_at"),
        F.min_by("open", "open_at").alias("open"),
        F.max("close_at").alias("close_at"),
        F.max_by("close", "close_at").alias("close"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.sum("n").alias("n"),
        F.sum("total").alias("total"),
        F.sum("volume_n").alias("volume_n"),
        F.sum("volume_total").alias("volume_total"),
    ]


def merge_cells(cells: DataFrame, seconds: int | None, c: Cols = OBS) -> DataFrame:
    """Cells of ``seconds`` from cells of a width that divides it; one per symbol for None."""
    if seconds is None:
        return cells.groupBy(c.symbol).agg(*_merged())
    wider = cells.withColumn("start", bucket_start(F.col("start"), seconds))
    return wider.groupBy("start", c.symbol).agg(*_merged())


def level_for(seconds: int) -> int:
    """The widest level that divides ``seconds``."""
    fitting = [level for level in LEVELS if seconds % level == 0]
    if not fitting:
        raise ValueError(f"{seconds} s is no multiple of {LEVELS[0]} s")
    return fitting[-1]


def candles_from_cells(
    levels: dict[int, DataFrame], seconds: int, volume_digits: int | None = None, c: Cols = OBS
) -> DataFrame:
    """Candles and mean volumes of ``seconds``, from the widest fitting level."""
    level = level_for(seconds)
    cells = levels[level] if level == seconds else merge_cells(levels[level], seconds, c)
    volume = rounded(F.try_divide("volume_total", "volume_n"), volume_digits)
    return cells.select(
        F.col("start").alias("window_start"), c.symbol, "low", "high", "open", "close", volume.alias("volume")
    )


def cover(start: datetime, stop: datetime, levels: tuple[int, ...] = LEVELS) -> list[tuple[int | None, datetime, datetime]]:
    """Stretches ``[a, b)`` that make up ``[start, stop)``, each with the widest level whose
    cells fill it; ``None`` stands for rows. At most two stretches of each level but the
    widest, whatever the range."""
    if start >= stop:
        return []
    if not levels:
        return [(None, start, stop)]
    *finer, widest = levels
    step = timedelta(seconds=widest)
    a = _EPOCH - (_EPOCH - start) // step * step
    b = _EPOCH + (stop - _EPOCH) // step * step
    if a >= b:
        return cover(start, stop, tuple(finer))
    return [*cover(start, a, tuple(finer)), (widest, a, b), *cover(b, stop, tuple(finer))]


def range_cells(
    levels: dict[int, DataFrame], rows: DataFrame, start: datetime, end: datetime, c: Cols = OBS
) -> DataFrame:
    """Cells and rows that make up ``[start, end]``, the rows as cells of their own.

    All tables are partitioned by date, and each is read on the dates of its stretches.
    """
    parts = []
    for level, a, b in cover(start, end + timedelta(microseconds=1)):
        source, time = (rows, c.time) if level is None else (levels[level], "start")
        dtype = source.schema[time].dataType
        low, high = (F.lit(t.isoformat(sep=" ")).cast(dtype) for t in (a, b))
        last = (b - timedelta(microseconds=1)).date()
        chosen = source.filter(F.col(c.date).between(F.lit(a.date()), F.lit(last)))
        chosen = chosen.filter((F.col(time) >= low) & (F.col(time) < high))
        parts.append(candle_cells(chosen, c=c) if level is None else chosen.drop(c.date))
    return reduce(DataFrame.unionByName, parts)


def range_candles(
    levels: dict[int, DataFrame],
    rows: DataFrame,
    start: datetime,
    end: datetime,
    digits: int | None = None,
    c: Cols = OBS,
) -> DataFrame:
    """One candle per symbol for ``[start, end]``, with mean price, spread and the range as
    a share of the mean. An empty range has no rows."""
    whole = merge_cells(range_cells(levels, rows, start, end, c), None, c)
    mean, spread = F.try_divide("total", "n"), F.col("high") - F.col("low")
    return whole.select(
        c.symbol,
        "open",
        "high",
        "low",
        "close",
        rounded(mean, digits).alias("avg_price"),
        rounded(spread, digits).alias("spread"),
        rounded(percent_of(spread, mean), digits).alias("price_range_pct"),
        rounded(F.try_divide("volume_total", "volume_n"), digits).alias("volume"),
    )
