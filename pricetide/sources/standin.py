"""Observations and landing files derived from the benchmark's own tables.

``events`` is a price series per event type. ``lineitem`` joined with ``part`` is a
monthly market: price, volume and cap per brand. ``land_events`` writes ``events`` as
landing snapshots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetide.schema import OBSERVATION
from pricetide.session import configure, scratch_path

EVENTS_PER_SNAPSHOT = 10
SNAPSHOTS_PER_FILE = 250


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def event_observations(events: DataFrame) -> DataFrame:
    """``events`` as observations: one symbol per event type, price = value."""
    value = F.col("value")
    return events.select(
        F.col("event_id").cast("string").alias("asset_id"),
        F.col("event_type").alias("symbol"),
        F.col("event_type").alias("name"),
        value.alias("price"),
        (value * F.lit(1000.0)).alias("market_cap"),
        value.alias("volume_24h"),
        F.col("ts").alias("observed_at"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_observations(table(spark, sf_dir, "events"))


def event_silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as rows of the silver table."""
    rows = events(spark, sf_dir).withColumns(
        {
            "observed_at": F.col("observed_at").cast("timestamp"),
            "observed_date": F.to_date("observed_at"),
        }
    )
    absent = {f.name: F.lit(None).cast(f.dataType) for f in OBSERVATION if f.name not in rows.columns}
    return rows.withColumns(absent).select(*OBSERVATION.fieldNames())


def market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly observations per brand; sums of whole cents make them exact."""

    def cents(name: str) -> Column:
        return F.sum(F.rint(F.col(name) * F.lit(100.0)).cast("long"))

    def units(total: str) -> Column:
        return F.col(total) / F.lit(100.0)

    lineitem = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice")
    monthly = (
        lineitem.join(part, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(
            F.col("p_brand").alias("symbol"),
            F.trunc(F.col("l_shipdate").cast("date"), "month").alias("_month"),
        )
        .agg(
            cents("l_extendedprice").alias("_volume"),
            cents("l_quantity").alias("_quantity"),
            cents("p_retailprice").alias("_retail"),
        )
        .select(
            "symbol",
            F.col("_month").cast("timestamp_ntz").alias("observed_at"),
            units("_volume").alias("volume_24h"),
            units("_quantity").alias("_quantity"),
            (F.col("_retail") * F.lit(10)).cast("double").alias("market_cap"),
        )
    )
    return monthly.select(
        F.col("symbol").alias("asset_id"),
        F.lit(None).cast("int").alias("rank"),
        "symbol",
        F.col("symbol").alias("name"),
        F.try_divide("volume_24h", "_quantity").alias("price"),
        "market_cap",
        "volume_24h",
        F.lit(None).cast("double").alias("change_pct_24h"),
        "observed_at",
    )


def _price_text(event: Column) -> Column:
    # Faulty prices, fixed by the event: text without a number, and a zero.
    number = event["event_id"]
    return (
        F.when(number % 97 == 0, F.lit("None"))
        .when(number % 89 == 0, F.lit("0"))
        .otherwise(event["value"].cast("string"))
    )


def _asset(event: Column) -> Column:
    return F.struct(
        event["user_id"].cast("string").alias("id"),
        event["event_id"].cast("string").alias("rank"),
        F.upper(event["event_type"]).alias("symbol"),
        event["event_type"].alias("name"),
        (event["value"] * F.lit(1000.0)).cast("string").alias("marketCapUsd"),
        event["value"].cast("string").alias("volumeUsd24Hr"),
        _price_text(event).alias("priceUsd"),
        F.lit("0").alias("changePercent24Hr"),
    )


def event_snapshots(events: DataFrame) -> DataFrame:
    """Groups of ten consecutive events: ``snapshot``, epoch-ms ``timestamp``, ``events``."""
    return events.groupBy(
        F.floor(F.col("event_id") / F.lit(EVENTS_PER_SNAPSHOT)).alias("snapshot")
    ).agg(
        F.unix_millis(F.min("ts").cast("timestamp")).alias("timestamp"),
        # A set, so that copies of an event cannot make a snapshot large.
        F.sort_array(
            F.collect_set(F.struct("event_id", "user_id", "event_type", "value"))
        ).alias("events"),
    )


def payload_snapshots(events: DataFrame) -> DataFrame:
    """The same snapshots as raw payload documents.

    The price key is absent from some assets, and an explicit null in others.
    """

    def asset(event: Column) -> Column:
        number = event["event_id"]
        value = event["value"].cast("string")
        price = F.when(number % 97 == 0, F.lit(None)).otherwise(value)
        full = F.create_map(
            F.lit("id"), event["user_id"].cast("string"),
            F.lit("market_cap_rank"), number.cast("string"),
            F.lit("symbol"), event["event_type"],
            F.lit("name"), event["event_type"],
            F.lit("current_price"), price,
            F.lit("total_volume"), value,
        )
        return F.map_filter(full, lambda k, v: (k != "current_price") | (number % 89 != 0))

    return event_snapshots(events).select(
        "snapshot", "timestamp", F.transform("events", asset).alias("payload")
    )


def write_documents(docs: DataFrame, path: str, mode: str = "error") -> None:
    """Write ``(batch, doc)`` rows as JSON files, one array of documents per batch."""
    files = docs.groupBy("batch").agg(
        F.concat(
            F.lit("["), F.array_join(F.sort_array(F.collect_list("doc")), ",\n"), F.lit("]")
        ).alias("value")
    )
    files.write.mode(mode).partitionBy("batch").text(path)


def _batched(snapshots: DataFrame, doc: Column) -> DataFrame:
    number = F.floor(F.col("snapshot") / F.lit(SNAPSHOTS_PER_FILE))
    last = F.col("snapshot") % SNAPSHOTS_PER_FILE == SNAPSHOTS_PER_FILE - 1
    # The last snapshot of each file is delivered again with the next one.
    batches = F.when(last, F.array(number, number + 1)).otherwise(F.array(number))
    # In one select, the explode would strip the field names inside ``doc``.
    docs = snapshots.select("snapshot", doc.alias("doc"))
    exploded = docs.select(F.explode(batches).alias("_batch"), "doc")
    return exploded.select(F.lpad(F.col("_batch").cast("string"), 8, "0").alias("batch"), "doc")


def land_events(spark: SparkSession, sf_dir: str) -> str:
    """Write ``events`` as landing files to the scratch folder; returns the folder."""
    path = scratch_path(spark, "landing")
    snapshots = event_snapshots(table(spark, sf_dir, "events"))
    doc = F.to_json(F.struct("timestamp", F.transform("events", _asset).alias("data")))
    write_documents(_batched(snapshots, doc), path)
    return path


def land_until(spark: SparkSession, sf_dir: str, path: str, cut: str, later: bool) -> None:
    """Add the snapshots before ``cut``, or the ``later`` ones, to the landing folders at
    ``path``, one for each batch. The folder of the cut gets files of both."""
    snapshots = event_snapshots(table(spark, sf_dir, "events"))
    before = F.timestamp_millis("timestamp") < F.lit(cut).cast("timestamp")
    doc = F.to_json(F.struct("timestamp", F.transform("events", _asset).alias("data")))
    write_documents(_batched(snapshots.filter(~before if later else before), doc), path, "append")


def land_mixed(spark: SparkSession, sf_dir: str) -> str:
    """Write ``events`` as a lake's landing folder of mixed documents; returns the lake.

    Every third snapshot has its ``data`` as JSON text. Each fiftieth is cut off in the
    middle, in a file of its own. Folder names have a blank.
    """
    path = scratch_path(spark, "mixed-lake")
    data = F.transform("events", _asset)
    as_array = F.to_json(F.struct("timestamp", data.alias("data")))
    as_text = F.to_json(F.struct("timestamp", F.to_json(data).alias("data")))
    number = F.col("snapshot")
    snapshots = event_snapshots(table(spark, sf_dir, "events"))
    cut = number % 50 == 7
    whole = _batched(snapshots.filter(~cut), F.when(number % 3 == 1, as_text).otherwise(as_array))
    whole = whole.withColumn("batch", F.concat(F.lit("no "), "batch"))
    half = F.substring(as_array, F.lit(1), (F.length(as_array) / 2).cast("int"))
    broken = snapshots.filter(cut).select(F.concat(F.lit("cut-"), number.cast("string")).alias("batch"), half.alias("doc"))
    write_documents(whole.unionByName(broken), f"{path}/landing")
    return path


def land_payloads(spark: SparkSession, sf_dir: str) -> str:
    """Write ``events`` as raw payload files to the scratch folder; returns the folder."""
    path = scratch_path(spark, "payload")
    snapshots = payload_snapshots(table(spark, sf_dir, "events"))
    write_documents(_batched(snapshots, F.to_json(F.struct("timestamp", "payload"))), path)
    return path
