"""Silver: one typed, gated and deduplicated row per asset and snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricetide.functions import safe_double, safe_int
from pricetide.operators.newest import newest_time
from pricetide.schema import ASSETS, OBS, Cols


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """``df`` itself, or an error naming the columns it lacks."""
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"missing column(s) {missing}; found {df.columns}")
    return df


def parse_assets(bronze: DataFrame, data: str = "data") -> DataFrame:
    """``data`` as an array of structs, whether it was stored as text or natively."""
    dtype = require_columns(bronze, data).schema[data].dataType
    if isinstance(dtype, T.StringType):
        return bronze.withColumn(data, F.from_json(data, ASSETS))
    if isinstance(dtype, T.ArrayType):
        return bronze
    raise TypeError(f"{data} must be a string or an array, not {dtype.simpleString()}")


def explode_assets(bronze: DataFrame, data: str = "data") -> DataFrame:
    """One row per array element; NULL and empty arrays give none."""
    others = [c for c in bronze.columns if c != data]
    return bronze.select(F.explode(data).alias("asset"), *others)


def flatten_assets(
    exploded: DataFrame, time: str = "ingestion_time", source: str = "source_file"
) -> DataFrame:
    """Struct fields to typed observation columns.

    Malformed numbers become NULL, as do fields the stored struct does not have.
    """
    present = set(exploded.schema["asset"].dataType.fieldNames())

    def field(name: str) -> Column:
        return F.col(f"asset.{name}") if name in present else F.lit(None).cast("string")

    source_col = F.col(source) if source in exploded.columns else F.lit(None).cast("string")
    return exploded.select(
        field("id").alias("asset_id"),
        safe_int(field("rank")).alias("rank"),
        field("symbol").alias("symbol"),
        field("name").alias("name"),
        safe_double(field("priceUsd")).alias("price"),
        safe_double(field("marketCapUsd")).alias("market_cap"),
        safe_double(field("volumeUsd24Hr")).alias("volume_24h"),
        safe_double(field("changePercent24Hr")).alias("change_pct_24h"),
        F.col(time).alias("observed_at"),
        source_col.alias("source_file"),
        F.to_date(F.col(time)).alias("observed_date"),
    )


def passes_gate(c: Cols = OBS, allow_empty_symbol: bool = True) -> Column:
    """True for rows with a symbol and a positive price that is a number."""
    price, symbol = F.col(c.price), F.col(c.symbol)
    ok = (
        price.isNotNull() & symbol.isNotNull() & (price > F.lit(0)) & ~F.isnan(price)
    )
    return ok if allow_empty_symbol else ok & (symbol != F.lit(""))


def quality_gate(
    df: DataFrame,
    c: Cols = OBS,
    allow_empty_symbol: bool = True,
    observation: Observation | None = None,
) -> DataFrame:
    """Drop rows no KPI can use.

    With an ``observation``, ``rows_in`` and ``rows_dropped`` arrive with the first
    action on the result, so no extra pass counts them.
    """
    ok = passes_gate(c, allow_empty_symbol)
    if observation is not None:
        df = df.observe(
            observation,
            F.count(F.lit(1)).alias("rows_in"),
            F.count_if(~F.coalesce(ok, F.lit(False))).alias("rows_dropped"),
        )
    return df.filter(ok)


def dedupe_observations(
    df: DataFrame, keys: tuple[str, ...] | None = None, c: Cols = OBS
) -> DataFrame:
    """One row per key: the one from the greatest source file.

    The remaining columns break ties, so the survivor never depends on row order. It is
    an aggregate, so copies of one key collapse on the map side before the shuffle.
    """
    keys = keys or (c.asset_id, c.time)
    lead = [c.source] if c.source in df.columns and c.source not in keys else []
    rest = [n for n in df.columns if n not in keys and n not in lead]
    best = F.max(F.struct(*lead, *rest)).alias("_best")
    picked = df.groupBy(*keys).agg(best)
    return picked.select(
        *[F.col(n) if n in keys else F.col(f"_best.{n}").alias(n) for n in df.columns]
    )


def newer_than(
    batch: DataFrame,
    stored: DataFrame | None,
    time: str = "observed_at",
    lookback_days: int = 0,
    c: Cols = OBS,
    date: str | None = None,
) -> DataFrame:
    """Rows of ``batch`` after the newest stored time, less the look-back.

    The high-water mark is a scalar subquery, which reaches the Parquet scan as a pushed
    filter. ``date`` names the date column ``batch`` is partitioned by, if it is: earlier
    dates are then not opened.
    """
    if stored is None:
        return batch
    floor = _floor(stored, lookback_days, c)
    newer = batch.filter(F.col(time) > floor.scalar())
    if date is None:
        return newer
    first_day = floor.select(F.to_date("floor").alias("first_day")).scalar()
    return newer.filter(F.col(date) >= first_day)


def _floor(stored: DataFrame, lookback_days: int, c: Cols) -> DataFrame:
    newest = F.col("newest")
    if lookback_days:
        newest = newest - F.make_dt_interval(F.lit(lookback_days))
    # Before any time, so that an empty stored table makes everything new.
    dawn = F.lit("0001-01-01").cast(stored.schema[c.time].dataType)
    found = newest_time(stored, c.time, c.date)
    return found.select(F.coalesce(newest, dawn).alias("floor"))


def not_stored(
    batch: DataFrame,
    stored: DataFrame | None,
    lookback_days: int,
    c: Cols = OBS,
) -> DataFrame:
    """Rows of ``batch`` whose asset and time are not stored within the look-back.

    Only the stored date partitions of the look-back are read.
    """
    if stored is None:
        return batch
    floor = _floor(stored, lookback_days, c)
    recent = stored.filter(F.col(c.time) > floor.scalar())
    if c.date in stored.columns:
        first_day = floor.select(F.to_date("floor").alias("first_day")).scalar()
        recent = recent.filter(F.col(c.date) >= first_day)
    known = recent.select(F.col(c.asset_id).alias("_id"), F.col(c.time).alias("_time"))
    same = F.col(c.asset_id).eqNullSafe(F.col("_id")) & (F.col(c.time) == F.col("_time"))
    return batch.join(known, same, "left_anti")


def since_watermark(
    batch: DataFrame,
    stored: DataFrame | None,
    late: str = "drop",
    lookback_days: int = 1,
    c: Cols = OBS,
) -> DataFrame:
    """Observations of ``batch`` that ``stored`` does not have yet.

    ``late="drop"`` keeps rows strictly newer than the newest stored one, so anything
    that arrives late is lost. ``late="admit"`` looks back ``lookback_days`` further and
    leaves out only the rows already stored under the same asset and time.
    """
    if late == "drop":
        return newer_than(batch, stored, c.time, c=c)
    if late == "admit":
        recent = newer_than(batch, stored, c.time, lookback_days, c)
        return not_stored(recent, stored, lookback_days, c)
    raise ValueError(f"late must be 'drop' or 'admit', not {late!r}")


def to_silver(
    bronze: DataFrame,
    observation: Observation | None = None,
    allow_empty_symbol: bool = True,
) -> DataFrame:
    """Bronze snapshots to clean observations: parse, explode, type, gate, dedupe."""
    flat = flatten_assets(explode_assets(parse_assets(bronze)))
    gated = quality_gate(
        flat, allow_empty_symbol=allow_empty_symbol, observation=observation
    )
    return dedupe_observations(gated)
