"""Bronze: landing snapshots as they came, plus lineage and event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetide.functions import epoch_ms_to_timestamp


def distinct_sources(bronze: DataFrame, source: str = "source_file") -> DataFrame:
    """The files already ingested, one row each."""
    return bronze.select(source).distinct()


def unprocessed(
    landing: DataFrame, bronze: DataFrame | None, source: str = "source_file"
) -> DataFrame:
    """Landing rows whose file is not in bronze yet; all of them on a first run.

    An anti join keeps the list of known files on the executors.
    """
    if bronze is None:
        return landing
    return landing.join(distinct_sources(bronze, source), source, "left_anti")


def to_bronze(landing: DataFrame) -> DataFrame:
    """Add the snapshot time, cut to whole seconds."""
    return landing.withColumn("ingestion_time", epoch_ms_to_timestamp(F.col("timestamp")))
