"""The newest time of a table, as a one-row DataFrame for scalar subqueries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_partition(df: DataFrame, date: str) -> DataFrame:
    """Rows of the newest date, if ``df`` has the date column; else ``df``.

    On a table partitioned by that column, only file footers are read to find the date,
    and the scan prunes to its partition at run time.
    """
    if date not in df.columns:
        return df
    last_day = df.agg(F.max(date).alias("last_day")).scalar()
    return df.filter(F.col(date) == last_day)


def newest_time(df: DataFrame, time: str, date: str) -> DataFrame:
    """One row, ``newest``: the greatest ``time``, NULL for an empty table."""
    return latest_partition(df, date).agg(F.max(time).alias("newest"))
