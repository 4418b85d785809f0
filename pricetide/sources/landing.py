"""Landing snapshots: JSON documents of ``{timestamp, data: [asset, ...]}``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricetide.schema import CORRUPT, LANDING, LANDING_TEXT, PAYLOAD

# Fixed mapping of raw payload keys to landing fields, with the text used when the
# key is absent (None keeps NULL).
PAYLOAD_FIELDS = (
    ("id", "id", None),
    ("market_cap_rank", "rank", ""),
    ("symbol", "symbol", ""),
    ("name", "name", None),
    ("current_price", "priceUsd", "0"),
    ("market_cap", "marketCapUsd", "0"),
    ("total_volume", "volumeUsd24Hr", "0"),
    ("price_change_percentage_24h", "changePercent24Hr", "0"),
)
# Text that stands for an explicit JSON null in the fields sent as text.
NULL_TEXT = "None"
# Older than any landing file, compared with the newest one. Spark's own limit of a week
# would skip late files for ever.
MAX_FILE_AGE = "36500d"


def _landing_schema(data_as: str) -> T.StructType:
    if data_as not in ("array", "text"):
        raise ValueError(f"data_as must be 'array' or 'text', not {data_as!r}")
    return LANDING if data_as == "array" else LANDING_TEXT


def _with_corrupt(schema: T.StructType, keep: bool) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())]) if keep else schema


def _with_source(df: DataFrame) -> DataFrame:
    # _metadata gives one URI form for batch and streaming reads alike.
    return df.select("*", F.col("_metadata.file_path").alias("source_file"))


def read_landing(
    spark: SparkSession,
    path: str | list[str],
    data_as: str = "array",
    modified_after: str | None = None,
    keep_corrupt: bool = False,
) -> DataFrame:
    """All snapshots below ``path`` with the URI of the file each came from.

    ``data_as="text"`` keeps ``data`` as JSON text. ``modified_after`` prunes the file
    listing, so an incremental batch does not parse files of earlier runs.
    ``keep_corrupt`` adds the text of files that are no JSON documents.
    """
    reader = (
        spark.read.schema(_with_corrupt(_landing_schema(data_as), keep_corrupt))
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("multiLine", True)
        .option("recursiveFileLookup", True)
    )
    if modified_after:
        reader = reader.option("modifiedAfter", modified_after)
    return _with_source(reader.json(path))


def landing_files(
    spark: SparkSession, path: str | list[str], modified_after: str | None = None
) -> DataFrame:
    """The URIs of the landing files, from the listing; no file is opened."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if modified_after:
        reader = reader.option("modifiedAfter", modified_after)
    return reader.load(path).select(F.col("_metadata.file_path").alias("source_file"))


def stream_landing(
    spark: SparkSession,
    path: str,
    data_as: str = "array",
    max_files_per_trigger: int | None = None,
    keep_corrupt: bool = False,
) -> DataFrame:
    """The streaming form of :func:`read_landing`.

    Files are read whatever their modification time; the driver remembers all of them.
    ``keep_corrupt`` adds the text of files that are no JSON documents, which otherwise
    come as rows of NULLs.
    """
    reader = (
        spark.readStream.schema(_with_corrupt(_landing_schema(data_as), keep_corrupt))
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("multiLine", True)
        .option("recursiveFileLookup", True)
        .option("maxFileAge", MAX_FILE_AGE)
    )
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return _with_source(reader.json(path))


def read_payload(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Raw payload documents ``{timestamp, payload: [{...}, ...]}``."""
    return (
        spark.read.schema(PAYLOAD)
        .option("multiLine", True)
        .option("recursiveFileLookup", True)
        .json(path)
    )


def _payload_text(asset: Column, key: str, absent: str | None) -> Column:
    if absent is None:
        return F.try_element_at(asset, F.lit(key))
    # A JSON null reads as an entry without a value.
    present = F.coalesce(F.try_element_at(asset, F.lit(key)), F.lit(NULL_TEXT))
    if key == "symbol":
        present = F.upper(F.try_element_at(asset, F.lit(key)))
    return F.when(F.map_contains_key(asset, key), present).otherwise(F.lit(absent))


def normalize_payload(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """Raw payload maps to landing ``data`` structs; other columns pass through."""

    def to_asset(asset: Column) -> Column:
        fields = [
            _payload_text(asset, key, absent).alias(field)
            for key, field, absent in PAYLOAD_FIELDS
        ]
        return F.struct(*fields)

    return raw.withColumn("data", F.transform(payload, to_asset)).drop(payload)
