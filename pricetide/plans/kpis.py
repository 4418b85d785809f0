"""All KPI tables of a silver table, as lazy DataFrames."""

from __future__ import annotations

from collections.abc import Mapping
from functools import partial

from pyspark.sql import DataFrame

from pricetide.operators import anomalies as anomaly_ops
from pricetide.operators import history, indicators, snapshot
from pricetide.schema import OBS, Cols
from pricetide.session import stage

# Projections of the shared indicator table that are KPI tables of their own.
INDICATOR_TABLES: Mapping[str, tuple[str, ...]] = {
    "price_changes": ("prev_price", "price_change_pct"),
    "moving_averages": ("ma_7", "ma_14"),
    "moving_average_30": ("ma_30",),
    "momentum": ("rsi",),
}


def from_indicators(table: DataFrame, name: str, c: Cols = OBS) -> DataFrame:
    """One KPI table cut out of :func:`indicators.indicators`; no shuffle."""
    columns = INDICATOR_TABLES[name]
    out = table.select(c.time, c.symbol, c.price, *columns)
    return out.filter(out["prev_price"].isNotNull()) if "prev_price" in columns else out


def all_kpis(
    silver: DataFrame,
    indicator_table: DataFrame | None = None,
    summary: DataFrame | None = None,
    c: Cols = OBS,
) -> dict[str, DataFrame]:
    """Every KPI table by name.

    The row-by-row tables are projections of one indicator table, and the per-symbol ones
    functions of one price summary. Pass the written tables when several of their KPIs
    are needed, so that each is computed once. Correlation is not among them: its pairs
    grow with the square of the symbols, so it is computed on request.
    """
    if indicator_table is None:
        indicator_table = indicators.indicators(silver, c=c)
    if summary is None:
        summary = stage(history.price_summary(silver, c), "key-stats")
    cut = partial(from_indicators, indicator_table, c=c)
    return {
        "top_assets": snapshot.top_assets(silver, c=c),
        "price_history": history.price_history(silver, c),
        "volatility": history.volatility_of(summary, c=c),
        **{name: cut(name) for name in INDICATOR_TABLES},
        "market_dominance": snapshot.market_dominance(silver, c=c),
        "liquidity": snapshot.liquidity(silver, c=c),
        "anomalies": anomaly_ops.anomalies(silver, summary=summary, c=c),
        "anomalies_both": anomaly_ops.anomalies(silver, side="both", summary=summary, c=c),
        "history_stats": history.history_stats_of(summary, c=c),
        "volatility_windowed": history.windowed_volatility(silver, c=c),
        "spread": history.spread(silver, c=c),
        "volatility_rolling": indicators.rolling_volatility(silver, c=c),
    }
