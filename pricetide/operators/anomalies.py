"""Z-score anomalies against per-symbol statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide.functions import rounded, z_score
from pricetide.operators.history import price_summary
from pricetide.operators.keyed import with_key_stats
from pricetide.schema import OBS, Cols

THRESHOLD = 2.0


def price_stats(df: DataFrame, c: Cols = OBS) -> DataFrame:
    """Mean and sample deviation per symbol, under the names the scores use."""
    return stats_of(price_summary(df, c), c)


def stats_of(summary: DataFrame, c: Cols = OBS) -> DataFrame:
    return summary.select(
        c.symbol, F.col("avg_price").alias("global_avg"), F.col("price_stddev").alias("global_std")
    )


def exceeds(z: Column, threshold: float, side: str) -> Column:
    """Whether ``z`` passes the threshold upwards, or in either direction."""
    if side == "upper":
        return z > F.lit(threshold)
    if side == "both":
        return F.abs(z) > F.lit(threshold)
    raise ValueError(f"side must be 'upper' or 'both', not {side!r}")


def _scored(df: DataFrame, c: Cols, summary: DataFrame | None = None) -> DataFrame:
    if summary is None:
        joined = with_key_stats(df, price_stats(df, c), c.symbol)
    else:
        joined = df.join(stats_of(summary, c), c.symbol)
    return joined.withColumn(
        "_z", z_score(F.col(c.price), F.col("global_avg"), F.col("global_std"))
    )


def anomalies(
    df: DataFrame,
    side: str = "upper",
    threshold: float = THRESHOLD,
    z_digits: int | None = 4,
    avg_digits: int | None = None,
    summary: DataFrame | None = None,
    c: Cols = OBS,
) -> DataFrame:
    """Rows whose rounded z-score over the symbol's whole history passes ``threshold``.

    A single-row or constant series has no z-score and no anomalies. ``summary`` is a
    stored :func:`history.price_summary` to use instead of computing one.
    """
    scored = _scored(df, c, summary).withColumn("z_score", rounded(F.col("_z"), z_digits))
    return scored.filter(exceeds(F.col("z_score"), threshold, side)).select(
        c.time,
        c.symbol,
        c.price,
        rounded(F.col("global_avg"), avg_digits).alias("global_avg"),
        "z_score",
        F.lit(True).alias("is_anomaly"),
    )


def anomaly_feed(
    df: DataFrame,
    n: int = 50,
    threshold: float = THRESHOLD,
    c: Cols = OBS,
) -> DataFrame:
    """The ``n`` rows furthest from their symbol's mean, anomalous or not.

    The flag compares the unrounded score. Asset id and time break ties.
    """
    return (
        _scored(df, c)
        .orderBy(F.desc_nulls_last(F.abs("_z")), F.asc(c.time), F.asc(c.asset_id))
        .limit(n)
        .select(
            c.time,
            c.symbol,
            c.price,
            F.round("global_avg", 2).alias("global_avg"),
            F.round("_z", 3).alias("z_score"),
            exceeds(F.col("_z"), threshold, "both").alias("is_anomaly"),
        )
    )


def z_scores(
    df: DataFrame, digits: int | None = 3, c: Cols = OBS, summary: DataFrame | None = None
) -> DataFrame:
    """Z-score of every row against the rows given, so filter the range first, or against a
    stored ``summary``."""
    return _scored(df, c, summary).select(
        c.time, c.symbol, rounded(F.col("_z"), digits).alias("z_score")
    )
