"""KPIs over the latest snapshot: ranking, dominance and liquidity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetide.functions import percent_of, rounded
from pricetide.operators.newest import latest_partition, newest_time
from pricetide.schema import OBS, Cols


def latest_snapshot(df: DataFrame, c: Cols = OBS) -> DataFrame:
    """Rows at the newest time of the whole table.

    An asset missing from the last poll is not in the result. The newest time is a
    scalar subquery, pushed into the scan; with a date partition, only the newest one
    is read.
    """
    newest = newest_time(df, c.time, c.date).scalar()
    return latest_partition(df, c.date).filter(F.col(c.time) == newest)


def top_assets(df: DataFrame, n: int | None = None, c: Cols = OBS) -> DataFrame:
    """Latest snapshot by market cap, all columns; ``n`` makes it a top-n report."""
    ranked = latest_snapshot(df, c).orderBy(
        F.desc_nulls_last(c.market_cap), F.asc_nulls_last(c.asset_id)
    )
    return ranked if n is None else ranked.limit(n)


def market_dominance(
    df: DataFrame, digits: int | None = 2, c: Cols = OBS
) -> DataFrame:
    """Share of each asset in the latest total market cap, in percent.

    Empty if the total is NULL or not positive.
    """
    snapshot = latest_snapshot(df, c).select(c.symbol, c.name, c.market_cap)
    total = snapshot.agg(F.sum(c.market_cap).alias("total")).scalar()
    share = percent_of(F.col(c.market_cap), total)
    return (
        snapshot.filter(total > F.lit(0))
        .withColumn("market_dominance_pct", rounded(share, digits))
    )


def liquidity(df: DataFrame, digits: int | None = 4, c: Cols = OBS) -> DataFrame:
    """Volume to market cap of the latest snapshot; NULL for a zero cap."""
    ratio = F.try_divide(F.col(c.volume), F.col(c.market_cap))
    return latest_snapshot(df, c).select(
        c.symbol, c.name, c.volume, c.market_cap, rounded(ratio, digits).alias("liquidity_ratio")
    )
