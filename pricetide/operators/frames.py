"""Row-frame windows that stay balanced when one symbol holds most rows.

A plain ``Window.partitionBy(symbol)`` sorts a symbol's whole history in one task, and
AQE does not split window partitions. Here a symbol above ``rows_per_chunk`` is cut
into chunks of consecutive cells, which are stretches of time:

1. rows are counted for each symbol and cell, an aggregate with map-side combine;
2. running sums of these counts say which chunk a cell is in, and for which later chunks
   it holds rows that their first frames look back to;
3. rows go to the chunk of their cell, and once more to those that look back to it. The
   window runs per (symbol, chunk), and the rows that were only looked back to are dropped.

The rows are sorted once, whatever the number of chunks, and the result equals the plain
window's. What is added to a chunk is at most the cells that hold ``lookback`` rows before
it, so cells should hold few rows against a chunk.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from pricetide.schema import OBS, Cols
from pricetide.session import stage

# So few that a handful of symbols gives work to all tasks, and many against an hour's rows.
ROWS_PER_CHUNK = 250_000
CELL_SECONDS = 3600

AddColumns = Callable[[DataFrame, WindowSpec], DataFrame]


def time_cell(time: Column, seconds: int) -> Column:
    """The number of the stretch of ``seconds`` that holds ``time``; NULL for NULL."""
    return F.floor(time.cast("timestamp").cast("long") / F.lit(seconds))


def row_counts(df: DataFrame, seconds: int = CELL_SECONDS, c: Cols = OBS) -> DataFrame:
    """Rows per symbol and cell: ``_symbol``, ``_cell``, ``_rows``."""
    cell = time_cell(F.col(c.time), seconds)
    keyed = df.select(F.col(c.symbol).alias("_symbol"), cell.alias("_cell"))
    return keyed.groupBy("_symbol", "_cell").agg(F.count(F.lit(1)).alias("_rows"))


def chunk_cells(counts: DataFrame, rows_per_chunk: int, lookback: int) -> DataFrame:
    """``_chunks`` of the cells of symbols with two chunks of rows or more.

    The first is the cell's own chunk; the others begin less than ``lookback`` rows after
    the cell, so their first frames reach into it.
    """
    symbol = Window.partitionBy("_symbol")
    in_time = symbol.orderBy("_cell")
    before = F.coalesce(F.sum("_rows").over(in_time.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = counts.withColumns({"_before": before, "_all": F.sum("_rows").over(symbol)})
    placed = placed.filter(F.col("_all") >= 2 * rows_per_chunk).withColumns(
        {
            "_chunk": F.floor(F.col("_before") / F.lit(rows_per_chunk)),
            "_end": F.col("_before") + F.col("_rows"),
        }
    )
    following = F.lead("_chunk").over(in_time)
    starts = placed.withColumn("_starts", F.when(following != F.col("_chunk"), following))
    # Frames by the number of rows: the cells that end within the look-back of this one's end.
    near = symbol.orderBy("_end").rangeBetween(0, max(lookback, 1) - 1)
    chunks = F.concat(F.array("_chunk"), F.collect_list("_starts").over(near))
    return starts.select("_symbol", "_cell", chunks.alias("_chunks"))


def over_rows(
    df: DataFrame,
    add_columns: AddColumns,
    lookback: int,
    rows_per_chunk: int | None = ROWS_PER_CHUNK,
    c: Cols = OBS,
    cell_seconds: int = CELL_SECONDS,
) -> DataFrame:
    """``add_columns(df, window)`` for a window over each symbol in time order.

    ``add_columns`` adds window columns that depend on a row and at most ``lookback``
    rows before it. ``rows_per_chunk=None`` forces the plain window. The order (time,
    asset) must be unique within a symbol, which silver's dedupe sees to. Rows of one
    symbol and cell stay together, so a single instant is not cut.
    """
    order = [F.asc(name) for name in c.order]
    plain = Window.partitionBy(c.symbol).orderBy(*order)
    if rows_per_chunk is None:
        return add_columns(df, plain)

    counts = stage(row_counts(df, cell_seconds, c), "row-counts")
    largest = counts.groupBy("_symbol").agg(F.sum("_rows").alias("n")).agg(F.max("n")).first()[0]
    if (largest or 0) < 2 * rows_per_chunk:
        return add_columns(df, plain)

    chunks = stage(chunk_cells(counts, rows_per_chunk, lookback), "chunk-cells")
    same = F.col(c.symbol).eqNullSafe(F.col("_symbol")) & F.col("_at").eqNullSafe(F.col("_cell"))
    placed = df.withColumn("_at", time_cell(F.col(c.time), cell_seconds)).join(chunks, same, "left")
    only = F.array(F.lit(0).cast("long"))
    dealt = placed.select(*df.columns, F.posexplode(F.coalesce("_chunks", only)).alias("_looked_at", "_chunk"))
    local = Window.partitionBy(c.symbol, "_chunk").orderBy(*order)
    return add_columns(dealt, local).filter("_looked_at = 0").drop("_looked_at", "_chunk")
