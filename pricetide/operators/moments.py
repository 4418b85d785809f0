"""Mergeable price moments: one cell per symbol and day, merged by Chan's rule.

A cell holds the number of prices, their mean, the sum of squared distances from it, and
the extremes. Cells of any days combine into the moments of all their rows, without a look
at the rows: counts add up, means are weighted, and to the squared distances come those of
the cells' means from the common one. Everything that volatility, history statistics and
z-scores need is a function of these cells.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricetide.schema import OBS, Cols

CELL_COLUMNS = ("n_rows", "n", "mean", "m2", "low", "high")


def moment_cells(df: DataFrame, *keys: str, c: Cols = OBS) -> DataFrame:
    """Moments of the prices per key, by default symbol and date.

    ``n_rows`` counts all rows, ``n`` those with a price. A key without any price has the
    mean NULL and no squared distances.
    """
    keys = keys or (c.symbol, c.date)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(c.price).alias("n"),
        F.avg(c.price).alias("mean"),
        F.coalesce(F.var_pop(c.price) * F.count(c.price), F.lit(0.0)).alias("m2"),
        F.min(c.price).alias("low"),
        F.max(c.price).alias("high"),
    )


def merge_moments(cells: DataFrame, *keys: str, c: Cols = OBS) -> DataFrame:
    """The cells of each key, by default a symbol, as one. Nothing is subtracted but means,
    so nothing cancels."""
    keys = keys or (c.symbol,)
    own = Window.partitionBy(*keys)
    total = F.sum("n").over(own)
    centre = F.try_divide(F.sum(F.col("n") * F.col("mean")).over(own), total)
    away = F.col("mean") - F.col("centre")
    spread = F.col("m2") + F.coalesce(F.col("n") * away * away, F.lit(0.0))
    # The aggregate finds the rows dealt by its keys, and adds no shuffle.
    return cells.withColumn("centre", centre).groupBy(*keys).agg(
        F.sum("n_rows").alias("n_rows"),
        F.sum("n").alias("n"),
        F.max("centre").alias("mean"),
        F.sum(spread).alias("m2"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
    )


def summary_of(moments: DataFrame, c: Cols = OBS) -> DataFrame:
    """Moments under the names of :func:`history.price_summary`: sample deviation, mean,
    highest and lowest price. One price has no deviation."""
    deviation = F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1)))
    return moments.select(
        c.symbol,
        deviation.alias("price_stddev"),
        F.col("mean").alias("avg_price"),
        F.col("high").alias("max_price"),
        F.col("low").alias("min_price"),
    )


def range_moments(
    cells: DataFrame, rows: DataFrame, start: datetime, end: datetime, c: Cols = OBS
) -> DataFrame:
    """Moments per symbol of the prices in ``[start, end]``.

    Days that lie inside come from the cells; of ``rows`` only the first and the last day
    are read. Both tables are partitioned by date, so that other days stay shut.
    """
    first, last = start.date(), end.date()
    inside = cells.filter(F.col(c.date).between(F.lit(first + timedelta(1)), F.lit(last - timedelta(1))))
    dtype = rows.schema[c.time].dataType
    between = F.col(c.time).between(*(F.lit(t.isoformat(sep=" ")).cast(dtype) for t in (start, end)))
    edges = rows.filter(F.col(c.date).isin(sorted({first, last})) & between)
    names = (c.symbol, c.date, *CELL_COLUMNS)
    return merge_moments(inside.select(*names).unionByName(moment_cells(edges, c=c).select(*names)), c=c)


def affected_days(cells: DataFrame, changed: list[date], lookback: int, c: Cols = OBS) -> DataFrame:
    """Symbols and days whose row frames reach into one of the ``changed`` days.

    A frame holds a row and ``lookback`` rows before it, so a later day is affected while
    fewer than ``lookback`` rows of its symbol lie between. The changed days are among them.
    """
    in_time = Window.partitionBy(c.symbol).orderBy(c.date)
    earlier = in_time.rowsBetween(Window.unboundedPreceding, -1)
    placed = cells.withColumn("before", F.coalesce(F.sum("n_rows").over(earlier), F.lit(0)))
    is_changed = F.col(c.date).isin(changed)
    end = F.when(is_changed, F.col("before") + F.col("n_rows"))
    gap = F.col("before") - F.max(end).over(earlier)
    return placed.withColumn("gap", gap).filter(is_changed | (F.col("gap") < lookback)).select(c.symbol, c.date)


def needed_days(cells: DataFrame, written: list[date], lookback: int, c: Cols = OBS) -> DataFrame:
    """Symbols and days that the frames of the ``written`` days look back to, and those."""
    in_time = Window.partitionBy(c.symbol).orderBy(c.date)
    earlier = in_time.rowsBetween(Window.unboundedPreceding, -1)
    placed = cells.withColumn("before", F.coalesce(F.sum("n_rows").over(earlier), F.lit(0)))
    is_written = F.col(c.date).isin(written)
    following = F.min(F.when(is_written, F.col("before"))).over(in_time.rowsBetween(1, Window.unboundedFollowing))
    gap = following - F.col("before") - F.col("n_rows")
    return placed.withColumn("gap", gap).filter(is_written | (F.col("gap") < lookback)).select(c.symbol, c.date)
