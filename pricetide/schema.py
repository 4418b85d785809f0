"""Explicit schemas for the landing, bronze and observation (silver) layers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Fixed field names of a landing asset; all values arrive as text.
ASSET_FIELDS = (
    "id",
    "rank",
    "symbol",
    "name",
    "supply",
    "maxSupply",
    "marketCapUsd",
    "volumeUsd24Hr",
    "priceUsd",
    "changePercent24Hr",
    "vwap24Hr",
)

ASSET = T.StructType([T.StructField(name, T.StringType()) for name in ASSET_FIELDS])
ASSETS = T.ArrayType(ASSET)

LANDING = T.StructType(
    [T.StructField("timestamp", T.LongType()), T.StructField("data", ASSETS)]
)
# The same document with ``data`` kept as JSON text.
LANDING_TEXT = T.StructType(
    [T.StructField("timestamp", T.LongType()), T.StructField("data", T.StringType())]
)
# A raw payload document: one map per asset, so that an absent key and an explicit
# null stay distinguishable.
PAYLOAD = T.StructType(
    [
        T.StructField("timestamp", T.LongType()),
        T.StructField(
            "payload", T.ArrayType(T.MapType(T.StringType(), T.StringType()))
        ),
    ]
)

# Documents that are not JSON of this shape are kept as they came in this column.
CORRUPT = "_corrupt_record"

BRONZE = T.StructType(
    [
        *LANDING_TEXT.fields,
        T.StructField("source_file", T.StringType()),
        T.StructField("ingestion_time", T.TimestampType()),
    ]
)

OBSERVATION = T.StructType(
    [
        T.StructField("asset_id", T.StringType()),
        T.StructField("rank", T.IntegerType()),
        T.StructField("symbol", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("market_cap", T.DoubleType()),
        T.StructField("volume_24h", T.DoubleType()),
        T.StructField("change_pct_24h", T.DoubleType()),
        T.StructField("observed_at", T.TimestampType()),
        T.StructField("source_file", T.StringType()),
        T.StructField("observed_date", T.DateType()),
    ]
)


@dataclass(frozen=True)
class Cols:
    """Names of the observation columns an operator works on."""

    asset_id: str = "asset_id"
    rank: str = "rank"
    symbol: str = "symbol"
    name: str = "name"
    price: str = "price"
    market_cap: str = "market_cap"
    volume: str = "volume_24h"
    change: str = "change_pct_24h"
    time: str = "observed_at"
    date: str = "observed_date"
    source: str = "source_file"

    @property
    def order(self) -> tuple[str, str]:
        """Unique order within a symbol: time, then asset."""
        return (self.time, self.asset_id)


OBS = Cols()
