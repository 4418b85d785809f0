"""Candles that late rows repair: touched cells are merged and rewritten batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pricetide.operators.candle_cells import LEVELS, candle_cells, merge_cells
from pricetide.schema import OBS, Cols
from pricetide.session import stage
from pricetide.sinks.files import overwrite_dates
from pricetide.sources.tables import read_table_or_none
from pricetide.streaming.queries import start_batches

BATCH = "batch"


def repair_cells(
    path: str, seconds: int = LEVELS[0], c: Cols = OBS
) -> Callable[[DataFrame, int], None]:
    """A batch writer that keeps the candle cells at ``path`` equal to those of all rows so far.

    A batch is reduced to cells first. Only the dates they fall on are read, merged and
    replaced, however late they are, and no row is kept in state. A replaced date carries
    the number of its last batch, so a batch that comes again after a failure leaves out the
    dates that it has already reached.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        cells = candle_cells(batch, seconds, c).withColumn(c.date, F.to_date("start"))
        fresh = stage(cells, "batch-cells")
        days = [r[0] for r in fresh.select(c.date).distinct().collect()]  # few, whatever the rows
        stored = read_table_or_none(spark, path)
        if stored is not None and days:
            stored = stored.filter(F.col(c.date).isin(days))
            done = stored.groupBy(c.date).agg(F.max(BATCH).alias("last")).filter(F.col("last") >= batch_id)
            reached = {r[0] for r in done.collect()}
            days = [d for d in days if d not in reached]
        if not days:
            return
        fresh = fresh.filter(F.col(c.date).isin(days))
        if stored is not None:
            fresh = fresh.unionByName(stored.filter(F.col(c.date).isin(days)).drop(BATCH))
        merged = merge_cells(fresh.drop(c.date), seconds, c).withColumns(
            {BATCH: F.lit(batch_id).cast("long"), c.date: F.to_date("start")}
        )
        # Written apart first, as it is read from the partitions that it replaces.
        overwrite_dates(stage(merged, "merged-cells"), path, c.date)

    return write


def start_repair(
    observations: DataFrame, path: str, checkpoint: str, seconds: int = LEVELS[0], c: Cols = OBS
) -> StreamingQuery:
    """Keep candle cells at ``path`` over everything available now."""
    return start_batches(observations, repair_cells(path, seconds, c), checkpoint)
