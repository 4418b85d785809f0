"""Z-scores against everything seen before, with running moments in streaming state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pricetide.functions import rounded
from pricetide.operators.anomalies import THRESHOLD, exceeds
from pricetide.schema import OBS, Cols

MOMENTS = T.StructType(
    [
        T.StructField("n", T.LongType()),
        T.StructField("mean", T.DoubleType()),
        T.StructField("m2", T.DoubleType()),
    ]
)
EXPIRY_DAYS = 30
DELAY = "1 day"


def scores_before(
    prices: np.ndarray, n: int, mean: float, m2: float
) -> tuple[np.ndarray, tuple[int, float, float]]:
    """Each price's z-score against the ``n`` before and those ahead of it, and the moments
    after all. NaN where fewer than two came before, or all of them were equal."""
    shift = float(prices.mean())
    y = prices - shift
    # Sums about the batch's mean, so that the squares do not swamp the deviations.
    before_n = n + np.arange(len(y))
    first = n * (mean - shift) + np.concatenate(([0.0], np.cumsum(y)))
    second = m2 + n * (mean - shift) ** 2 + np.concatenate(([0.0], np.cumsum(y * y)))
    with np.errstate(divide="ignore", invalid="ignore"):
        centre = first[:-1] / before_n
        spread = np.sqrt(np.maximum(second[:-1] - first[:-1] * centre, 0.0) / (before_n - 1))
        z = np.where((before_n > 1) & (spread > 0), (y - centre) / spread, np.nan)
    total = n + len(y)
    centre = first[-1] / total
    return z, (total, shift + centre, max(second[-1] - first[-1] * centre, 0.0))


def stream_scores(
    observations: DataFrame, expiry_days: int = EXPIRY_DAYS, delay: str = DELAY, c: Cols = OBS
) -> DataFrame:
    """Every row with a price, with its exact score ``z`` against all earlier ones of its symbol.

    Earlier are the rows of earlier micro-batches, and within one those before it by time
    and asset. State is three numbers per symbol; a symbol that is silent for the expiry, by
    the time of the rows, starts anew. Rows more than ``delay`` behind the newest of earlier
    micro-batches are left out. A micro-batch's rows of one symbol are held by one task, so its size is
    what the source's trigger options allow.
    """
    time, symbol, price, asset_id = c.time, c.symbol, c.price, c.asset_id
    expiry_ms = expiry_days * 86_400_000

    def score(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        batch = pd.concat(list(frames)).sort_values([time, asset_id], kind="stable")
        seen = state.get if state.exists else (0, 0.0, 0.0)
        z, after = scores_before(batch[price].to_numpy(np.float64), *seen)
        state.update(after)
        state.setTimeoutTimestamp(int(batch[time].max().timestamp() * 1000) + expiry_ms)
        yield pd.DataFrame({time: batch[time], symbol: key[0], price: batch[price], "z": z})

    priced = observations.filter(F.col(price).isNotNull() & F.col(symbol).isNotNull())
    rows = priced.select(symbol, time, asset_id, price).withWatermark(time, delay)
    out = T.StructType([rows.schema[n] for n in (time, symbol, price)] + [T.StructField("z", T.DoubleType())])
    return rows.groupBy(symbol).applyInPandasWithState(
        score, out, MOMENTS, "append", GroupStateTimeout.EventTimeTimeout
    )


def stream_anomalies_online(
    observations: DataFrame,
    side: str = "upper",
    threshold: float = THRESHOLD,
    digits: int | None = 4,
    expiry_days: int = EXPIRY_DAYS,
    delay: str = DELAY,
    c: Cols = OBS,
) -> DataFrame:
    """Rows that stand out against all before them, without a batch of statistics."""
    scored = stream_scores(observations, expiry_days, delay, c)
    z = rounded(F.nanvl("z", F.lit(None).cast("double")), digits)
    scored = scored.withColumn("z_score", z).filter(exceeds(F.col("z_score"), threshold, side))
    return scored.select(c.time, c.symbol, c.price, "z_score", F.lit(True).alias("is_anomaly"))
