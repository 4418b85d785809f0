"""Gold kept up to date by dates: only what new or late rows change is computed again.

``moments`` has one cell for each symbol and date of silver; ``candle_cells`` has those of
quarter hours, hours and days; ``indicators_by_date`` and ``price_history_by_date`` have a
row for each of silver. All are partitioned by date. A run finds the dates of silver with new
files, recomputes their cells, and from the cells' row counts the dates whose row frames
reach into them. It reads those and the rows they look back to, and replaces their
partitions; other dates are neither read nor written. Tables per symbol are merged from the
cells.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetide.operators import history, snapshot
from pricetide.operators.candle_cells import LEVELS, candle_cells, merge_cells
from pricetide.operators.indicators import MOVING_AVERAGE_ROWS, RSI_ROWS, indicators
from pricetide.operators.moments import affected_days, merge_moments, moment_cells, needed_days, summary_of
from pricetide.plans.medallion import Layout
from pricetide.schema import OBS, OBSERVATION, Cols
from pricetide.session import stage
from pricetide.sinks import overwrite_dates, overwrite_parquet
from pricetide.sources import read_table
from pricetide.sources.changes import Versions, changed_dates, date_versions, mark_seen

MOMENTS = "moments"
INDICATORS = "indicators_by_date"
HISTORY = "price_history_by_date"
CANDLES = "candle_cells"
AVERAGES = (*MOVING_AVERAGE_ROWS, 30)
LOOKBACK = max(max(AVERAGES) - 1, RSI_ROWS)


def _ledger(layout: Layout) -> str:
    return layout.folder("_ledgers/silver")


def refresh_moments(
    spark: SparkSession, layout: Layout, versions: Versions | None = None, c: Cols = OBS
) -> list[date]:
    """Recompute the cells of silver's changed dates; returns those dates."""
    versions = versions or date_versions(spark, layout.silver, c.date)
    days = changed_dates(spark, versions, _ledger(layout), MOMENTS)
    if days:
        silver = read_table(spark, layout.silver, OBSERVATION)
        overwrite_dates(moment_cells(silver.filter(F.col(c.date).isin(days)), c=c), layout.gold(MOMENTS), c.date)
        mark_seen(spark, versions, days, _ledger(layout), MOMENTS)
    return days


def _dates(df: DataFrame, c: Cols) -> list[date]:
    """The distinct dates of a table of symbols and dates: as many as the calendar has."""
    return sorted(r[0] for r in df.select(c.date).distinct().collect())


def indicator_input(
    silver: DataFrame, cells: DataFrame, changed: list[date], c: Cols = OBS
) -> tuple[DataFrame, list[date]]:
    """The rows to compute indicators from, and the dates of which they are complete."""
    written = _dates(affected_days(cells, changed, LOOKBACK, c), c)
    needed = stage(needed_days(cells, written, LOOKBACK, c), "needed-days")
    rows = silver.filter(F.col(c.date).isin(_dates(needed, c)))
    # On days that are only looked back to, the symbols that do so.
    symbol = needed.select(F.col(c.symbol).alias("_symbol"), F.col(c.date).alias("_day"))
    same = F.col(c.symbol).eqNullSafe(F.col("_symbol")) & (F.col(c.date) == F.col("_day"))
    return rows.join(symbol, same, "left_semi"), written


def refresh_indicators(
    spark: SparkSession,
    layout: Layout,
    versions: Versions | None = None,
    digits: int | None = 4,
    c: Cols = OBS,
) -> list[date]:
    """Recompute the indicators that silver's changed dates touch; returns the dates written.

    The moments must be up to date, as :func:`refresh_gold_by_date` sees to.
    """
    versions = versions or date_versions(spark, layout.silver, c.date)
    changed = changed_dates(spark, versions, _ledger(layout), INDICATORS)
    if not changed:
        return []
    silver = read_table(spark, layout.silver, OBSERVATION)
    rows, written = indicator_input(silver, read_table(spark, layout.gold(MOMENTS)), changed, c)
    table = indicators(rows, AVERAGES, digits=digits, c=c).withColumn(c.date, F.to_date(c.time))
    overwrite_dates(table.filter(F.col(c.date).isin(written)), layout.gold(INDICATORS), c.date)
    mark_seen(spark, versions, changed, _ledger(layout), INDICATORS)
    return written


def refresh_history(
    spark: SparkSession, layout: Layout, versions: Versions | None = None, c: Cols = OBS
) -> list[date]:
    """Copy the price history of silver's changed dates; returns those dates."""
    versions = versions or date_versions(spark, layout.silver, c.date)
    days = changed_dates(spark, versions, _ledger(layout), HISTORY)
    if days:
        silver = read_table(spark, layout.silver, OBSERVATION)
        changed = history.price_history(silver.filter(F.col(c.date).isin(days)), c)
        overwrite_dates(changed, layout.gold(HISTORY), c.date)
        mark_seen(spark, versions, days, _ledger(layout), HISTORY)
    return days


def refresh_candles(
    spark: SparkSession, layout: Layout, versions: Versions | None = None, c: Cols = OBS
) -> list[date]:
    """Recompute all levels of candle cells of silver's changed dates; returns those dates.

    Each level is merged from the one below, so silver is read once.
    """
    versions = versions or date_versions(spark, layout.silver, c.date)
    days = changed_dates(spark, versions, _ledger(layout), CANDLES)
    if days:
        rows = read_table(spark, layout.silver, OBSERVATION).filter(F.col(c.date).isin(days))
        for level in LEVELS:
            cells = candle_cells(rows, level, c) if level == LEVELS[0] else merge_cells(rows, level, c)
            folder = layout.gold(f"{CANDLES}/{level}")
            overwrite_dates(cells.withColumn(c.date, F.to_date("start")), folder, c.date)
            rows = read_table(spark, folder).filter(F.col(c.date).isin(days)).drop(c.date)
        mark_seen(spark, versions, days, _ledger(layout), CANDLES)
    return days


def candle_levels(spark: SparkSession, layout: Layout) -> dict[int, DataFrame]:
    """The stored candle cells by their seconds."""
    return {level: read_table(spark, layout.gold(f"{CANDLES}/{level}")) for level in LEVELS}


def stored_summary(spark: SparkSession, layout: Layout, c: Cols = OBS) -> DataFrame:
    """The price summary of all silver, merged from the cells."""
    return summary_of(merge_moments(read_table(spark, layout.gold(MOMENTS)), c=c), c)


def refresh_gold_by_date(
    spark: SparkSession, layout: Layout, digits: int | None = 4, c: Cols = OBS
) -> dict[str, list[date]]:
    """Bring all tables up to date; returns the dates written of each dated table.

    The tables per symbol are small and written whole: those of the whole history come from
    the cells, those of the newest snapshot from silver's newest date.
    """
    versions = date_versions(spark, layout.silver, c.date)
    done = {
        MOMENTS: refresh_moments(spark, layout, versions, c),
        INDICATORS: refresh_indicators(spark, layout, versions, digits, c),
        HISTORY: refresh_history(spark, layout, versions, c),
        CANDLES: refresh_candles(spark, layout, versions, c),
    }
    silver = read_table(spark, layout.silver, OBSERVATION)
    summary = stage(stored_summary(spark, layout, c), "key-stats")
    for name, table in (
        ("volatility", history.volatility_of(summary, c=c)),
        ("history_stats", history.history_stats_of(summary, c=c)),
        ("top_assets", snapshot.top_assets(silver, c=c)),
        ("market_dominance", snapshot.market_dominance(silver, c=c)),
        ("liquidity", snapshot.liquidity(silver, c=c)),
    ):
        overwrite_parquet(table, layout.gold(name))
    return done
