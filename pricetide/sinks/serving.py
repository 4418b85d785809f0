"""Serving tables: names and the JDBC load."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from datetime import datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricetide.session import observed_counts
from pricetide.sources.tables import read_table_or_none

# Fixed serving column names, for camelCase inputs and for this package's own names.
SERVING_NAMES = {
    "priceUsd": "price_usd",
    "marketCapUsd": "market_cap_usd",
    "volumeUsd24Hr": "volume_usd_24hr",
    "changePercent24Hr": "change_percent_24hr",
    "asset_id": "id",
    "price": "price_usd",
    "market_cap": "market_cap_usd",
    "volume_24h": "volume_usd_24hr",
    "change_pct_24h": "change_percent_24hr",
    "observed_at": "ingestion_time",
}

# Fixed names of the served KPI tables.
TABLES = (
    "top_assets",
    "price_history",
    "volatility",
    "price_changes",
    "moving_averages",
    "market_dominance",
    "liquidity",
    "anomalies",
    "history_stats",
)

# Fixed prefix of the served tables' names.
PREFIX = "crypto_"

# Served tables whose older rows stay as they are while newer ones come, with their time.
GROWING = {
    "price_history": "observed_at",
    "price_changes": "observed_at",
    "moving_averages": "observed_at",
}

WriteTable = Callable[[DataFrame, str], None]

LOAD_RESULT = T.StructType(
    [
        T.StructField("table_name", T.StringType()),
        T.StructField("ok", T.BooleanType()),
        T.StructField("row_count", T.LongType()),
        T.StructField("error", T.StringType()),
    ]
)

# Up to which time a growing table is served; NULL while a load of it is under way.
MARK = T.StructType(
    [
        T.StructField("table_name", T.StringType()),
        T.StructField("served_to", T.TimestampType()),
        T.StructField("set_no", T.LongType()),
    ]
)


def rename_columns(df: DataFrame, names: Mapping[str, str] = SERVING_NAMES) -> DataFrame:
    """Rename the columns that exist; the rest stay."""
    return df.withColumnsRenamed({old: new for old, new in names.items() if old in df.columns})


def jdbc_writer(
    url: str,
    properties: Mapping[str, str],
    mode: str = "overwrite",
    num_partitions: int = 8,
    batch_size: int = 10_000,
) -> WriteTable:
    """A writer of DataFrames to JDBC tables.

    ``overwrite`` truncates, which keeps the table's grants and indexes.
    ``num_partitions`` caps the concurrent connections. Credentials and driver come
    from the caller's ``properties``.
    """

    def write(df: DataFrame, table: str) -> None:
        (
            df.write.mode(mode)
            .option("truncate", mode == "overwrite")
            .option("batchsize", batch_size)
            .option("numPartitions", num_partitions)
            .jdbc(url, table, properties=dict(properties))
        )

    return write


def serving_preview(df: DataFrame, symbol: str = "symbol") -> tuple[list[str], DataFrame]:
    """Dry run of a load: the serving columns, and the distinct symbols."""
    renamed = rename_columns(df)
    return renamed.columns, renamed.select(symbol).distinct()


def load_tables(
    spark: SparkSession,
    tables: Mapping[str, DataFrame],
    write: WriteTable,
    prefix: str = PREFIX,
) -> DataFrame:
    """Write each table under its serving name; one result row per table.

    Every table is tried. Row counts come from the write itself. Use
    :func:`require_loaded` to turn a failed row into an error.
    """
    results = [_load(df, f"{prefix}{name}", write) for name, df in tables.items()]
    return spark.createDataFrame(results, LOAD_RESULT)


def load_new_rows(
    spark: SparkSession,
    tables: Mapping[str, DataFrame],
    write: WriteTable,
    append: WriteTable,
    marks: str,
    prefix: str = PREFIX,
    growing: Mapping[str, str] = GROWING,
) -> DataFrame:
    """As :func:`load_tables`, but growing tables get only rows after the last served time.

    That time is kept in the table ``marks`` and is unset while a load runs. So the first
    load of a growing table, and the one after a failed load, go through ``write`` and
    replace it; others go through ``append``. Where late rows are admitted, older rows
    change as well: use :func:`load_tables` then.
    """
    results = []
    for name, df in tables.items():
        table, time = f"{prefix}{name}", growing.get(name)
        if time is None:
            results.append(_load(df, table, write))
            continue
        served = _served_to(spark, marks, table)
        newest = df.agg(F.max(F.col(time).cast("timestamp"))).first()[0]
        if served is not None and (newest is None or newest <= served):
            results.append((table, True, 0, None))
            continue
        _set_mark(spark, marks, table, None)
        if served is None:
            result = _load(df, table, write)
        else:
            result = _load(df.filter(F.col(time).cast("timestamp") > F.lit(served)), table, append)
        if result[1]:
            _set_mark(spark, marks, table, newest)
        results.append(result)
    return spark.createDataFrame(results, LOAD_RESULT)


def _load(df: DataFrame, table: str, write: WriteTable) -> tuple[str, bool, int | None, str | None]:
    observed = Observation(f"load_{table}")
    counted = rename_columns(df).observe(observed, F.count(F.lit(1)).alias("row_count"))
    try:
        write(counted, table)
    except Exception as error:  # noqa: BLE001 - reported per table
        return table, False, None, str(error)
    return table, True, observed_counts(observed, "row_count")["row_count"], None


def _served_to(spark: SparkSession, marks: str, table: str) -> datetime | None:
    stored = read_table_or_none(spark, marks, MARK)
    if stored is None:
        return None
    own = stored.filter(F.col("table_name") == table)
    return own.agg(F.max_by("served_to", "set_no")).first()[0]


def _set_mark(spark: SparkSession, marks: str, table: str, served_to: datetime | None) -> None:
    # Numbered, as clocks may stand still or go back.
    stored = read_table_or_none(spark, marks, MARK)
    last = None if stored is None else stored.filter(F.col("table_name") == table).agg(F.max("set_no")).first()[0]
    row = spark.createDataFrame([(table, served_to, (last or 0) + 1)], MARK)
    row.write.mode("append").parquet(marks)


def require_loaded(results: DataFrame) -> None:
    """Raise if any table of a load failed."""
    failed = [row["table_name"] for row in results.filter(~F.col("ok")).collect()]
    if failed:
        raise RuntimeError(f"tables not loaded: {failed}")
