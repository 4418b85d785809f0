"""File sinks: Parquet layers, CSV exports and quality reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def append_silver(df: DataFrame, path: str, date: str = "observed_date") -> None:
    """Append, partitioned by date.

    The rebalance gives each writer few dates, and AQE splits a large day between
    several writers by size.
    """
    df.hint("rebalance", date).write.mode("append").partitionBy(date).parquet(path)


def overwrite_dates(df: DataFrame, path: str, date: str = "observed_date") -> None:
    """Replace the dates that ``df`` has rows of; other partitions stay as they are."""
    (
        df.hint("rebalance", date)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(date)
        .parquet(path)
    )


def overwrite_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


# Spark writes milliseconds by default; times keep their microseconds here.
CSV_TIMES = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][XXX]",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]",
}


def export_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """CSV with a header. ``single_file`` has one task write it: for small tables only."""
    out = df.coalesce(1) if single_file else df
    out.write.mode("overwrite").options(header=True, **CSV_TIMES).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table that :func:`export_csv` wrote."""
    return spark.read.schema(schema).options(header=True, **CSV_TIMES).csv(path)


def write_report(report: DataFrame, path: str, fmt: str = "json") -> None:
    """Append a quality report row; reports of all runs stay in one table."""
    report.write.mode("append").format(fmt).save(path)
