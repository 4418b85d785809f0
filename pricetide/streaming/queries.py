"""Structured Streaming forms of ingest, dedupe, candles and anomaly flags."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from pricetide.functions import rounded, z_score
from pricetide.operators.anomalies import THRESHOLD, exceeds
from pricetide.operators.bronze import to_bronze
from pricetide.operators.history import candles
from pricetide.schema import OBS, Cols
from pricetide.sinks.serving import WriteTable, rename_columns
from pricetide.sources import read_table_or_none, stream_landing

ReplaceBatch = Callable[[DataFrame, str, int], None]

# Micro-batches that a serving table has whole.
DELIVERED = T.StructType(
    [
        T.StructField("query", T.StringType()),
        T.StructField("table_name", T.StringType()),
        T.StructField("batch_id", T.LongType()),
    ]
)


def start_parquet(
    df: DataFrame, path: str, checkpoint: str, *partition_by: str
) -> StreamingQuery:
    """Append a stream to a Parquet table, over everything available now."""
    return (
        df.writeStream.format("parquet")
        .outputMode("append")
        .partitionBy(*partition_by)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )


def start_batches(
    df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str
) -> StreamingQuery:
    """Hand each micro-batch to ``write(batch, batch_id)``, such as a serving load.

    A batch can come again after a failure, with the same id: ``write`` must replace
    what an earlier attempt left.
    """
    return (
        df.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def start_serving(
    df: DataFrame, table: str, write: WriteTable, checkpoint: str
) -> StreamingQuery:
    """Load each micro-batch into a serving table under the serving column names.

    A writer that overwrites keeps the last batch, as a current-snapshot table wants. One
    that appends delivers at least once: a batch that comes again is appended again.
    """

    def load(batch: DataFrame, batch_id: int) -> None:
        write(rename_columns(batch), table)

    return start_batches(df, load, checkpoint)


def start_serving_once(
    df: DataFrame, table: str, replace: ReplaceBatch, ledger: str, query: str, checkpoint: str
) -> StreamingQuery:
    """As :func:`start_serving`, with each micro-batch delivered exactly once.

    ``replace(batch, table, batch_id)`` puts the rows in the place of what an earlier attempt
    at the same batch left. The ledger notes batches that are complete, by ``query`` and
    number, so that one of them that comes again is not written at all.
    """
    return start_batches(df, once(table, replace, ledger, query), checkpoint)


def once(table: str, replace: ReplaceBatch, ledger: str, query: str) -> Callable[[DataFrame, int], None]:
    """The batch writer of :func:`start_serving_once`."""

    def load(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        done = read_table_or_none(spark, ledger, DELIVERED)
        mine = (F.col("query") == query) & (F.col("table_name") == table) & (F.col("batch_id") == batch_id)
        if done is not None and not done.filter(mine).isEmpty():
            return
        replace(rename_columns(batch), table, batch_id)
        row = spark.createDataFrame([(query, table, batch_id)], DELIVERED)
        row.coalesce(1).write.mode("append").parquet(ledger)

    return load


def replace_parquet(folder: str) -> ReplaceBatch:
    """A writer to Parquet tables below ``folder``, with a partition for each batch."""

    def replace(df: DataFrame, table: str, batch_id: int) -> None:
        # The partition is named by the path, so that an empty batch replaces as well.
        df.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{table}/batch_id={batch_id}")

    return replace


def stream_bronze(
    spark: SparkSession, landing: str, max_files_per_trigger: int | None = None
) -> DataFrame:
    """New landing files as bronze rows; the sink's checkpoint remembers the files."""
    return to_bronze(
        stream_landing(spark, landing, max_files_per_trigger=max_files_per_trigger)
    )


def stream_dedupe(
    observations: DataFrame,
    delay: str = "10 minutes",
    keys: tuple[str, ...] | None = None,
    c: Cols = OBS,
) -> DataFrame:
    """The first row per key; state is kept only as long as the watermark needs it."""
    keys = keys or (c.asset_id, c.time)
    return observations.withWatermark(c.time, delay).dropDuplicatesWithinWatermark(list(keys))


def stream_candles(
    observations: DataFrame,
    duration: str = "15 minutes",
    delay: str = "10 minutes",
    c: Cols = OBS,
) -> DataFrame:
    """Candles, each emitted once its window is past the watermark."""
    return candles(observations.withWatermark(c.time, delay), duration, c=c)


def complete_candles(
    emitted: DataFrame, observations: DataFrame, duration: str = "15 minutes", c: Cols = OBS
) -> DataFrame:
    """The emitted candles, and those of later windows, which the stream holds open.

    The later ones are a batch aggregate of the rows after the last emitted window only.
    """
    last = emitted.agg(F.max("window_start").alias("last"))
    dtype = observations.schema[c.time].dataType
    after = last.select(F.col("last").cast(dtype).alias("last")).scalar()
    open_rows = observations.filter(
        after.isNull() | (F.col(c.time) >= after + F.expr(f"INTERVAL {duration}"))
    )
    rest = candles(open_rows, duration, c=c)
    rest = rest.withColumn("window_start", F.col("window_start").cast(emitted.schema["window_start"].dataType))
    return emitted.unionByName(rest)


def stream_anomalies(
    observations: DataFrame,
    stats: DataFrame,
    side: str = "upper",
    threshold: float = THRESHOLD,
    digits: int | None = 4,
    c: Cols = OBS,
) -> DataFrame:
    """Rows that stand out against the last batch's statistics per symbol.

    ``stats`` is a stored table, so its file size decides whether it is broadcast.
    """
    scored = observations.join(stats, c.symbol).withColumn(
        "z_score",
        rounded(z_score(F.col(c.price), F.col("global_avg"), F.col("global_std")), digits),
    )
    return scored.filter(exceeds(F.col("z_score"), threshold, side)).select(
        c.time, c.symbol, c.price, "z_score", F.lit(True).alias("is_anomaly")
    )
