"""Joining per-key statistics back to the rows they describe."""

from __future__ import annotations

from pyspark.sql import DataFrame

from pricetide.session import stage


def with_key_stats(df: DataFrame, stats: DataFrame, key: str) -> DataFrame:
    """``df`` with the columns of ``stats``, which has one row per ``key``.

    The statistics are written once and read back, so Catalyst knows their true size:
    it broadcasts them below the session's threshold, and the rows never shuffle.
    Beyond it, this is a sort-merge join whose hot partitions AQE splits. A window over
    the whole key would sort each key's full history in one task instead.
    """
    return df.join(stage(stats, "key-stats"), key)
