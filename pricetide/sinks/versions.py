"""Tables that are replaced whole, of which readers always see a complete version.

Every version has a folder of its own, and a manifest row is written when the folder is
complete. Readers take the newest version with a manifest; a write that fails leaves a
folder without one, which nobody reads.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricetide.session import observed_counts
from pricetide.sources.tables import read_table, read_table_or_none

MANIFEST = T.StructType(
    [
        T.StructField("version", T.LongType()),
        T.StructField("folder", T.StringType()),
        T.StructField("row_count", T.LongType()),
    ]
)


def _manifests(path: str) -> str:
    return f"{path.rstrip('/')}/_manifests"


def versions(spark: SparkSession, path: str) -> DataFrame | None:
    """The complete versions of the table at ``path``; ``None`` before the first."""
    return read_table_or_none(spark, _manifests(path), MANIFEST)


def newest_version(spark: SparkSession, path: str) -> tuple[int, str] | None:
    """Number and folder of the newest complete version."""
    found = versions(spark, path)
    if found is None:
        return None
    row = found.agg(F.max(F.struct("version", "folder")).alias("last")).first()["last"]
    return None if row is None else (row["version"], row["folder"])


def write_version(df: DataFrame, path: str) -> int:
    """Write ``df`` as the next version and publish it; returns its number.

    ``df`` may read the version it follows. Of two writers at once, the one with the greater
    folder name counts, and both are complete.
    """
    spark = df.sparkSession
    last = newest_version(spark, path)
    number = 1 if last is None else last[0] + 1
    folder = f"version={number:08}-{uuid.uuid4().hex}"
    written = Observation(f"version-{uuid.uuid4().hex}")
    df.observe(written, F.count(F.lit(1)).alias("rows")).write.parquet(f"{path.rstrip('/')}/{folder}")
    manifest = (number, folder, observed_counts(written, "rows")["rows"])
    spark.createDataFrame([manifest], MANIFEST).coalesce(1).write.mode("append").parquet(_manifests(path))
    return number


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The newest complete version, or a given one."""
    found = versions(spark, path)
    chosen = None
    if found is not None:
        wanted = found if version is None else found.filter(F.col("version") == version)
        chosen = wanted.agg(F.max(F.struct("version", "folder")).alias("last")).first()["last"]
    if chosen is None:
        raise ValueError(f"no complete version {'' if version is None else version} at {path}".replace("  ", " "))
    return read_table(spark, f"{path.rstrip('/')}/{chosen['folder']}")
