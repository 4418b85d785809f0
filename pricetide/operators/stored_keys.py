"""Deduplication against all of silver, of any age, without shuffling what is stored.

The keys of silver are kept in a table that is bucketed by their hash. A batch is joined
with it bucket by bucket: only the batch is shuffled, into as many partitions as there are
buckets. The join compares the keys themselves, so hashes that meet are told apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetide.operators.silver import dedupe_observations
from pricetide.schema import OBS, Cols

BUCKETS = 64
KEY = "key_hash"


def _key(c: Cols) -> Column:
    return F.xxhash64(c.asset_id, c.time)


def open_keys(
    spark: SparkSession, name: str, path: str, buckets: int = BUCKETS, c: Cols = OBS
) -> DataFrame:
    """The keys stored at ``path``, as the catalog's table ``name``; made where absent."""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({KEY} BIGINT, {c.asset_id} STRING, {c.time} TIMESTAMP) "
        f"USING parquet CLUSTERED BY ({KEY}) SORTED BY ({KEY}) INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    return spark.table(name)


def add_keys(rows: DataFrame, name: str, path: str, buckets: int = BUCKETS, c: Cols = OBS) -> None:
    """Store the keys of rows that were written; each bucket grows by one file."""
    keys = rows.select(_key(c).alias(KEY), c.asset_id, c.time).repartition(buckets, KEY)
    (
        keys.write.mode("append")
        .format("parquet")
        .bucketBy(buckets, KEY)
        .sortBy(KEY)
        .option("path", path)
        .saveAsTable(name)
    )


def not_in_keys(batch: DataFrame, keys: DataFrame, c: Cols = OBS) -> DataFrame:
    """One row for each key of ``batch`` that is not stored, however old the stored one is."""
    unique = dedupe_observations(batch, c=c).withColumn(KEY, _key(c))
    stored = keys.select(
        F.col(KEY).alias("_hash"), F.col(c.asset_id).alias("_id"), F.col(c.time).alias("_time")
    )

    def alike(a: Column, b: Column) -> Column:
        # Spark must not take it for a join key: the table is bucketed by the hash alone.
        return F.coalesce(a == b, a.isNull() & b.isNull())

    same = (
        (F.col(KEY) == F.col("_hash"))
        & alike(F.col(c.asset_id), F.col("_id"))
        & alike(F.col(c.time), F.col("_time"))
    )
    # A merge join uses the buckets as they are; a broadcast would send the stored side.
    return unique.join(stored.hint("merge"), same, "left_anti").drop(KEY)
