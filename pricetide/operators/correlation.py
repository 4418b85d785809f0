"""Correlation of every pair of symbols, aligned on time.

Joining a time grid with itself emits every pair of symbols in every grid cell. Here
the grid is tiled instead: a tile holds two blocks of symbols and a slice of the times,
and its pair sums are matrix products. Only one row per pair and tile is shuffled on.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetide.functions import rounded
from pricetide.operators.keyed import with_key_stats
from pricetide.schema import OBS, Cols
from pricetide.session import stage

SYMBOLS_PER_BLOCK = 256
TIMES_PER_TILE = 2048

_PAIR_SUMS = (
    "symbol_a string, symbol_b string, n double, sx double, sy double, "
    "sxx double, syy double, sxy double"
)


def _tile_function() -> Callable[[pd.DataFrame], pd.DataFrame]:
    # Nested, so that Spark ships it by value and executors need not have the package.
    def tile_sums(tile: pd.DataFrame) -> pd.DataFrame:
        """Pair sums of one tile; a pair counts the times at which both symbols exist."""
        grid = tile.pivot(index="t", columns="symbol", values="x")
        names = grid.columns.to_numpy(dtype=object)
        block = tile.drop_duplicates("symbol").set_index("symbol")["block"].reindex(names).to_numpy()
        values = grid.to_numpy(dtype="float64")
        seen = (~np.isnan(values)).astype("float64")
        x = np.nan_to_num(values)
        n, sx, sxx, sxy = seen.T @ seen, x.T @ seen, (x * x).T @ seen, x.T @ x

        # A tile of two blocks owns only the pairs across them.
        owned = np.triu(np.ones_like(n, dtype=bool), 1) & (n > 0)
        if tile["block_a"].iat[0] != tile["block_b"].iat[0]:
            owned &= block[:, None] != block[None, :]
        a, b = np.nonzero(owned)
        return pd.DataFrame(
            {
                "symbol_a": names[a],
                "symbol_b": names[b],
                "n": n[a, b],
                "sx": sx[a, b],
                "sy": sx[b, a],
                "sxx": sxx[a, b],
                "syy": sxx[b, a],
                "sxy": sxy[a, b],
            }
        )

    return tile_sums


def time_grid(df: DataFrame, grid: str | None = None, c: Cols = OBS) -> DataFrame:
    """One price per symbol and time: the mean per ``grid`` window, or per exact time."""
    cell = F.window(c.time, grid)["start"] if grid else F.col(c.time)
    return df.groupBy(F.col(c.symbol).alias("symbol"), cell.alias("t")).agg(
        F.avg(c.price).alias("x")
    )


def correlation_pairs(
    df: DataFrame,
    grid: str | None = None,
    symbols: list[str] | None = None,
    pairs: DataFrame | None = None,
    all_pairs: bool = False,
    digits: int | None = 6,
    symbols_per_block: int = SYMBOLS_PER_BLOCK,
    times_per_tile: int = TIMES_PER_TILE,
    c: Cols = OBS,
) -> DataFrame:
    """Pearson correlation per pair ``symbol_a < symbol_b`` and the times they share.

    NULL for fewer than two shared times or a constant series. ``symbols`` restricts
    the matrix to some, and ``pairs`` (``symbol_a``, ``symbol_b``) to the wanted pairs.
    The whole matrix grows with the square of the symbols: ``all_pairs`` asks for it.
    ``grid`` first averages prices per time window.
    """
    if symbols is None and pairs is None and not all_pairs:
        raise ValueError("name symbols or pairs, or ask for all_pairs")
    if pairs is not None:
        pairs = pairs.select(
            F.least("symbol_a", "symbol_b").alias("symbol_a"),
            F.greatest("symbol_a", "symbol_b").alias("symbol_b"),
        ).distinct()
        wanted = pairs.select(F.col("symbol_a").alias(c.symbol)).union(pairs.select("symbol_b"))
        df = df.join(wanted.distinct(), c.symbol, "left_semi")
    if symbols is not None:
        df = df.filter(F.col(c.symbol).isin(symbols))
    cells = stage(
        time_grid(df, grid, c).filter(F.col("symbol").isNotNull() & F.col("x").isNotNull()),
        "time-grid",
    )
    size = cells.agg(
        F.approx_count_distinct("symbol").alias("symbols"),
        F.approx_count_distinct("t").alias("times"),
    ).first()
    blocks = max(1, -(-size["symbols"] // symbols_per_block))
    slices = max(1, -(-size["times"] // times_per_tile))

    # Sums of deviations lose fewer digits than sums of raw prices.
    means = cells.groupBy("symbol").agg(F.avg("x").alias("_mean"))
    centred = with_key_stats(cells, means, "symbol").withColumn("x", F.col("x") - F.col("_mean"))
    tiles = (
        centred.withColumn("block", F.pmod(F.xxhash64("symbol"), F.lit(blocks)).cast("int"))
        .withColumn("slice", F.pmod(F.xxhash64("t"), F.lit(slices)).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        .select(
            F.least("block", "other").alias("block_a"),
            F.greatest("block", "other").alias("block_b"),
            "slice",
            "block",
            "symbol",
            "t",
            "x",
        )
    )
    sums = tiles.groupBy("block_a", "block_b", "slice").applyInPandas(
        _tile_function(), _PAIR_SUMS
    )
    total = sums.groupBy("symbol_a", "symbol_b").agg(
        *[F.sum(name).alias(name) for name in ("n", "sx", "sy", "sxx", "syy", "sxy")]
    )
    if pairs is not None:
        total = total.join(pairs, ["symbol_a", "symbol_b"])
    n, sx, sy = F.col("n"), F.col("sx"), F.col("sy")
    var_x = n * F.col("sxx") - sx * sx
    var_y = n * F.col("syy") - sy * sy
    # Below the rounding error of the sums, a variance is that of a constant series.
    tiny = F.lit(1e-12)
    varies = (var_x > tiny * n * F.col("sxx")) & (var_y > tiny * n * F.col("syy"))
    corr = F.try_divide(n * F.col("sxy") - sx * sy, F.sqrt(var_x) * F.sqrt(var_y))
    return total.select(
        "symbol_a",
        "symbol_b",
        n.cast("long").alias("n_times"),
        F.when((n >= 2) & varies, rounded(corr, digits)).alias("correlation"),
    )
