"""Parquet tables, with a typed answer for tables that do not exist yet."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_table(
    spark: SparkSession, path: str, schema: T.StructType | None = None
) -> DataFrame:
    """A Parquet table; pass ``schema`` where old files may lack columns."""
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    return reader.parquet(path)


def read_table_or_none(
    spark: SparkSession, path: str, schema: T.StructType | None = None
) -> DataFrame | None:
    """As :func:`read_table`, but ``None`` on a first run.

    Only a missing path counts as a first run. Any other failure is raised: taking a
    read error for an empty table would ingest everything again.
    """
    try:
        return read_table(spark, path, schema)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
