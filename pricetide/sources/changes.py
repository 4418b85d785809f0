"""Which dates of a partitioned table have new files since a consumer last read it.

The files are taken from the listing, and none is opened. What a consumer has seen is kept
in a ledger table: for each date the number of files and a digest of their names and sizes.
So late rows, which are new files of an old date, are found as well as new dates.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricetide.sources.tables import read_table_or_none

VERSION = T.StructType(
    [
        T.StructField("day", T.DateType()),
        T.StructField("files", T.LongType()),
        T.StructField("digest", T.LongType()),
    ]
)
LEDGER = T.StructType(
    [T.StructField("consumer", T.StringType()), T.StructField("run", T.LongType()), *VERSION.fields]
)

Versions = dict[date, tuple[int, int]]


def date_versions(spark: SparkSession, path: str, column: str = "observed_date") -> Versions:
    """Number and digest of the files of each date below ``path``, one entry for each date."""
    listed = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.parquet")
        .load(path)
    )
    day = F.regexp_extract("path", f"/{column}=([0-9-]+)/", 1).try_cast("date")
    rows = listed.select(day.alias("day"), F.xxhash64("path", "length").alias("file"))
    versions = rows.groupBy("day").agg(F.count(F.lit(1)).alias("files"), F.bit_xor("file").alias("digest"))
    return {r["day"]: (r["files"], r["digest"]) for r in versions.collect() if r["day"] is not None}


def _newest(ledger: DataFrame, consumer: str) -> DataFrame:
    own = ledger.filter(F.col("consumer") == consumer)
    return own.groupBy("day").agg(F.max_by(F.struct("files", "digest"), "run").alias("seen"), F.max("run").alias("run"))


def changed_dates(spark: SparkSession, versions: Versions, ledger: str, consumer: str) -> list[date]:
    """Dates whose files are not those the consumer saw last, ascending."""
    stored = read_table_or_none(spark, ledger, LEDGER)
    seen = {}
    if stored is not None:
        seen = {r["day"]: tuple(r["seen"]) for r in _newest(stored, consumer).collect()}
    return sorted(day for day, version in versions.items() if seen.get(day) != version)


def mark_seen(
    spark: SparkSession, versions: Versions, days: list[date], ledger: str, consumer: str
) -> None:
    """Note the versions of ``days`` as seen, under the consumer's next run number.

    To be called when the consumer's output is written: after a failure in between, the
    same dates come again.
    """
    if not days:
        return
    stored = read_table_or_none(spark, ledger, LEDGER)
    last = None if stored is None else stored.filter(F.col("consumer") == consumer).agg(F.max("run")).first()[0]
    run = (last or 0) + 1
    rows = [(consumer, run, day, *versions[day]) for day in days]
    spark.createDataFrame(rows, LEDGER).coalesce(1).write.mode("append").parquet(ledger)
