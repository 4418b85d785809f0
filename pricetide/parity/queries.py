"""One query per operator, each over its whole input tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetide.functions import anomaly_label, as_ntz, epoch_ms_to_timestamp, safe_double, safe_int
from pricetide.operators import anomalies, bronze, correlation, history, indicators
from pricetide.operators import candle_cells, quality, silver, snapshot, stored_keys
from pricetide.plans import dashboard, incremental, medallion
from pricetide.schema import OBSERVATION
from pricetide.session import configure, scratch_path, sized_shuffles, stage
from pricetide.sinks import (
    append_silver,
    export_csv,
    load_tables,
    read_csv,
    rename_columns,
    serving_preview,
    versions,
    write_report,
)
from pricetide.sources import (
    landing_files,
    normalize_payload,
    read_landing,
    read_payload,
    read_table,
    standin,
)
from pricetide.streaming import (
    complete_candles,
    once,
    replace_parquet,
    start_parquet,
    start_serving_once,
    stream_anomalies,
    stream_bronze,
    stream_candles,
    stream_dedupe,
)
from pricetide.streaming.online import stream_anomalies_online
from pricetide.streaming.repair import start_repair

Query = Callable[[SparkSession, str], DataFrame]

# Digits that hide rounding ties and summation order, which differ between engines.
FINE = 8

RANGE_START, RANGE_END = datetime(2024, 1, 10), datetime(2024, 1, 12, 12)
# Bounds within a day, an hour and a quarter of an hour.
RAGGED_START, RAGGED_END = datetime(2024, 1, 4, 7, 22, 31), datetime(2024, 1, 17, 19, 51, 3)
SILVER_UNTIL = "2024-01-20 00:00:00"
LATE_SYMBOL = "signup"
BRONZE_UNTIL = "2024-01-15 00:00:00"


_folders: dict[tuple, str] = {}


def _written(write: Callable[[SparkSession, str], str]) -> Callable[[SparkSession, str], str]:
    """The input folder ``write`` makes, written once per application and table set."""

    def folder(spark: SparkSession, sf_dir: str) -> str:
        key = (write.__name__, spark.sparkContext.applicationId, sf_dir)
        if key not in _folders:
            _folders[key] = write(spark, sf_dir)
        return _folders[key]

    return folder


landing_folder = _written(standin.land_events)
payload_folder = _written(standin.land_payloads)


def _landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_landing(configure(spark), landing_folder(spark, sf_dir))


def _market(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Written once, as silver would be: the queries read it more than once.
    return stage(standin.market(spark, sf_dir), "market")


def _flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    bronze_rows = bronze.to_bronze(_landed(spark, sf_dir))
    return silver.flatten_assets(silver.explode_assets(bronze_rows))


def _observation_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "asset_id", "rank", "symbol", "name", "price", "market_cap", "volume_24h",
        "change_pct_24h", as_ntz(F.col("observed_at")).alias("observed_at"), "observed_date",
    )


# Sources and bronze


def landing_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _landed(spark, sf_dir).select(
        "timestamp",
        F.size("data").cast("long").alias("n_assets"),
        F.col("source_file").isNotNull().alias("has_source"),
    )


def normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = read_payload(spark, payload_folder(spark, sf_dir))
    assets = normalize_payload(raw).select("timestamp", F.explode("data").alias("a"))
    return assets.select(
        "timestamp",
        F.col("a.id").alias("id"),
        F.col("a.rank").alias("rank"),
        F.col("a.symbol").alias("symbol"),
        F.col("a.name").alias("name"),
        (F.col("a.priceUsd") == "None").alias("price_was_null"),
        safe_double(F.col("a.priceUsd")).alias("price"),
        F.col("a.marketCapUsd").alias("market_cap_text"),
        safe_double(F.col("a.volumeUsd24Hr")).alias("volume"),
        F.col("a.changePercent24Hr").alias("change_text"),
    )


def _file_batch() -> Column:
    return F.regexp_extract("source_file", "batch=([0-9]+)", 1).cast("long")


def bronze_new_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    landing = _landed(spark, sf_dir)
    rows = bronze.to_bronze(landing)
    # Files that hold a snapshot from before the cut were ingested by an earlier run.
    before = F.col("ingestion_time") < F.lit(BRONZE_UNTIL).cast("timestamp")
    earlier = stage(rows.filter(before), "bronze")
    new = bronze.to_bronze(bronze.unprocessed(landing, earlier))
    return new.select(
        _file_batch().alias("batch"),
        "timestamp",
        as_ntz(F.col("ingestion_time")).alias("ingestion_time"),
        F.size("data").cast("long").alias("n_assets"),
    )


def distinct_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = bronze.distinct_sources(bronze.to_bronze(_landed(spark, sf_dir)))
    return files.select(_file_batch().alias("batch"))


def listed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = landing_files(spark, landing_folder(spark, sf_dir))
    return files.select(_file_batch().alias("batch"))


def epoch_to_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = standin.table(spark, sf_dir, "events")
    return events.select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms")).select(
        "event_id", "ms", as_ntz(epoch_ms_to_timestamp(F.col("ms"))).alias("ts_seconds")
    )


# Silver


def incremental_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = standin.events(spark, sf_dir)
    stored = rows.filter(F.col("observed_at") < F.lit(SILVER_UNTIL).cast("timestamp_ntz"))
    new = silver.since_watermark(rows, stored)
    return new.select("asset_id", "symbol", "price", "observed_at")


def late_admit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = standin.events(spark, sf_dir)
    stored = rows.filter(
        (F.col("observed_at") < F.lit(SILVER_UNTIL).cast("timestamp_ntz"))
        & (F.col("symbol") != LATE_SYMBOL)
    )
    new = silver.since_watermark(rows, stored, late="admit", lookback_days=3)
    return new.select("asset_id", "symbol", "price", "observed_at")


def parse_json_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = landing_folder(spark, sf_dir)
    text = read_landing(spark, path, data_as="text")
    assets = silver.explode_assets(silver.parse_assets(text))
    return assets.select("timestamp", "asset.id", "asset.rank", "asset.symbol", "asset.name")


def explode_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    exploded = silver.explode_assets(_landed(spark, sf_dir))
    return exploded.select("timestamp", F.col("asset.rank").alias("rank"))


def flatten_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _observation_columns(_flat(spark, sf_dir))


def safe_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = silver.explode_assets(_landed(spark, sf_dir))
    return texts.select(
        safe_int(F.col("asset.rank")).alias("rank"),
        safe_double(F.col("asset.priceUsd")).alias("price"),
        safe_double(F.col("asset.marketCapUsd")).alias("market_cap"),
        safe_int(F.col("asset.symbol")).alias("symbol_as_int"),
    )


def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _observation_columns(silver.quality_gate(_flat(spark, sf_dir)))


def dedupe_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _observation_columns(silver.to_silver(bronze.to_bronze(_landed(spark, sf_dir))))


# KPIs


def latest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot.latest_snapshot(_market(spark, sf_dir)).select(
        "symbol", "price", "market_cap", "volume_24h", "observed_at"
    )


def top_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot.top_assets(_market(spark, sf_dir))


def price_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.price_history(standin.events(spark, sf_dir))


def volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.volatility(standin.events(spark, sf_dir), raw_digits=6, pct_digits=6)


def price_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indicators.price_changes(standin.events(spark, sf_dir), digits=FINE)


def moving_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indicators.moving_averages(standin.events(spark, sf_dir), digits=FINE)


def moving_averages_chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = standin.events(spark, sf_dir)
    return indicators.moving_averages(rows, digits=FINE, rows_per_chunk=200)


def moving_averages_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = standin.events(spark, sf_dir)
    return indicators.moving_averages(rows, digits=FINE, rows_per_chunk=200, cell_seconds=86400)


def moving_average_30(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indicators.moving_averages(standin.events(spark, sf_dir), (30,), digits=FINE)


def momentum_rsi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indicators.momentum(_market(spark, sf_dir), digits=6)


def momentum_rsi_chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = standin.events(spark, sf_dir)
    return indicators.momentum(rows, digits=6, rows_per_chunk=200)


def rolling_volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indicators.rolling_volatility(standin.events(spark, sf_dir), 30, digits=6)


def indicator_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indicators.indicators(standin.events(spark, sf_dir), digits=6)


def market_dominance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot.market_dominance(_market(spark, sf_dir), digits=6)


def liquidity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot.liquidity(_market(spark, sf_dir), digits=FINE)


def _anomalies(side: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _market(spark, sf_dir)
        return anomalies.anomalies(rows, side=side, z_digits=6, avg_digits=6)

    return run


def anomalies_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anomalies.anomalies(standin.events(spark, sf_dir), z_digits=6, avg_digits=6)


def history_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.history_stats(standin.events(spark, sf_dir), digits=6)


def volatility_windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.windowed_volatility(
        standin.events(spark, sf_dir), "6 hours", raw_digits=7, pct_digits=7
    )


def spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.spread(standin.events(spark, sf_dir), "1 day", digits=6)


def correlation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlation.correlation_pairs(_market(spark, sf_dir), all_pairs=True)


def correlation_wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    brands = standin.table(spark, sf_dir, "part").select(F.col("p_brand").alias("symbol_a")).distinct()
    # Each brand with the one whose number follows.
    number = F.regexp_extract("symbol_a", "([0-9]+)$", 1).cast("int")
    pairs = brands.select("symbol_a", F.concat(F.lit("Brand#"), number + 1).alias("symbol_b"))
    return correlation.correlation_pairs(_market(spark, sf_dir), pairs=pairs)


def correlation_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlation.correlation_pairs(
        standin.events(spark, sf_dir), grid="6 hours", all_pairs=True, symbols_per_block=2, times_per_tile=16
    )


# Quality and serving


def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(_flat(spark, sf_dir), "flat").drop("run_at")


def layer_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    landed = stage(bronze.to_bronze(_landed(spark, sf_dir)), "bronze")
    layers = {"bronze": landed, "silver": silver.to_silver(landed)}
    profile = quality.layer_profile(layers)
    return profile.select("layer", "row_count", "distinct_symbols")


def layer_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = standin.events(spark, sf_dir)
    return quality.layer_symbols(
        {"events": rows, "top_assets": snapshot.top_assets(_market(spark, sf_dir))}
    )


def renamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    served = rename_columns(snapshot.top_assets(_market(spark, sf_dir)))
    return served.select(
        "id", "symbol", "price_usd", "market_cap_usd",
        "volume_usd_24hr", "change_percent_24hr", "ingestion_time",
    )


# Read queries


def symbol_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.symbol_list(snapshot.top_assets(_market(spark, sf_dir)))


def time_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = history.price_history(standin.events(spark, sf_dir))
    return dashboard.in_time_range(rows, RANGE_START, RANGE_END)


def snapshot_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = snapshot.top_assets(_market(spark, sf_dir))
    return dashboard.snapshot_table(top, ["Brand#4", "Brand#12", "Brand#19", "Brand#21"])


def total_market_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = snapshot.top_assets(_market(spark, sf_dir))
    return dashboard.total_market_cap(top).withColumn("value", F.round("value", 2))


def total_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = snapshot.top_assets(_market(spark, sf_dir))
    return dashboard.total_volume(top).withColumn("value", F.round("value", 2))


def price_ma_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    averages = indicators.moving_averages(standin.events(spark, sf_dir), digits=FINE)
    return dashboard.price_ma_series(averages)


def price_ma_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    averages = read_table(spark, gold_lake(spark, sf_dir).gold(incremental.INDICATORS))
    shown = dashboard.price_ma_series(averages.drop("ma_30"), start=RANGE_START, end=RANGE_END)
    return shown.withColumn("observed_at", as_ntz(F.col("observed_at")))


def ohlc_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.candle_series(standin.events(spark, sf_dir), start=RANGE_START, end=RANGE_END)


def volume_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = standin.events(spark, sf_dir)
    return dashboard.volume_series(rows, digits=FINE, start=RANGE_START, end=RANGE_END)


def volatility_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = history.volatility(standin.events(spark, sf_dir), raw_digits=6, pct_digits=6)
    return dashboard.volatility_ranking(rows, detail=True)


def dominance_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = snapshot.market_dominance(_market(spark, sf_dir), digits=6)
    return dashboard.dominance_ranking(rows, detail=True)


def liquidity_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = snapshot.liquidity(_market(spark, sf_dir), digits=FINE)
    return dashboard.liquidity_ranking(rows, detail=True)


def anomaly_feed_top50(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.anomaly_feed(standin.events(spark, sf_dir))


def zscore_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = history.price_history(standin.events(spark, sf_dir))
    return dashboard.z_score_series(rows, RANGE_START, RANGE_END, digits=6)


def ohlc_15m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.candle_series(standin.events(spark, sf_dir))


def volume_15m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.volume_series(standin.events(spark, sf_dir), digits=FINE)


def history_stats_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.history_stats_ranked(history_stats(spark, sf_dir))


def series_last_max_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    averages = indicators.moving_averages(standin.events(spark, sf_dir), digits=FINE)
    return dashboard.series_last_max_min(averages)


def risk_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _market(spark, sf_dir)
    bands = dashboard.risk_bands(
        history.volatility(rows, pct_digits=4), snapshot.liquidity(rows, digits=4)
    )
    return bands.select("symbol", "volatility_band", "liquidity_band")


def move_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = standin.events(spark, sf_dir)
    return dashboard.move_bands(
        indicators.price_changes(rows, digits=FINE), anomalies.z_scores(rows, digits=6)
    )


def anomaly_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = anomalies.z_scores(standin.events(spark, sf_dir), digits=6)
    return scores.withColumn("label", anomaly_label(F.col("z_score") > 2.0))


# Gold by date: silver comes in three loads, the last of them late rows of old dates


def _load_silver(spark: SparkSession, sf_dir: str, refresh: Callable) -> medallion.Layout:
    """A lake whose silver grew load by load, with ``refresh(spark, layout)`` after each."""
    layout = medallion.Layout(scratch_path(configure(spark), "lake"))
    rows = standin.event_silver(spark, sf_dir)
    old = F.col("observed_at") < F.lit(SILVER_UNTIL).cast("timestamp")
    start, end = (F.lit(t.isoformat(sep=" ")).cast("timestamp") for t in (RANGE_START, RANGE_END))
    late = (F.col("symbol") == LATE_SYMBOL) & F.col("observed_at").between(start, end)
    for load in (old & ~late, ~old, late):
        append_silver(rows.filter(load), layout.silver)
        refresh(spark, layout)
    return layout


_lakes: dict[tuple, medallion.Layout] = {}


def gold_lake(spark: SparkSession, sf_dir: str) -> medallion.Layout:
    """The grown lake with all its dated tables, made once per application and table set."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _lakes:

        def refresh(spark: SparkSession, layout: medallion.Layout) -> None:
            incremental.refresh_gold_by_date(spark, layout, digits=FINE)

        _lakes[key] = _load_silver(spark, sf_dir, refresh)
    return _lakes[key]


def moments_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    layout = _load_silver(spark, sf_dir, incremental.refresh_moments)
    summary = stage(incremental.stored_summary(spark, layout), "key-stats")
    stats = history.history_stats_of(summary, 6).drop("avg_price")
    return history.volatility_of(summary, 6, 6).join(stats, "symbol")


def gold_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    def refresh(spark: SparkSession, layout: medallion.Layout) -> None:
        incremental.refresh_moments(spark, layout)
        incremental.refresh_indicators(spark, layout, digits=6)

    table = read_table(spark, _load_silver(spark, sf_dir, refresh).gold(incremental.INDICATORS))
    return table.drop("observed_date").withColumn("observed_at", as_ntz(F.col("observed_at")))


def zscore_range_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    layout = gold_lake(spark, sf_dir)
    rows = read_table(spark, layout.gold(incremental.HISTORY))
    cells = read_table(spark, layout.gold(incremental.MOMENTS))
    scores = dashboard.z_score_range(rows, cells, RANGE_START, RANGE_END, digits=6)
    return scores.withColumn("observed_at", as_ntz(F.col("observed_at")))


def ohlc_from_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = incremental.candle_levels(spark, gold_lake(spark, sf_dir))
    widths = [1800, 6 * 3600, 2 * 86400]
    found = [candle_cells.candles_from_cells(levels, w, FINE).withColumn("seconds", F.lit(w)) for w in widths]
    rows = reduce(DataFrame.unionByName, found)
    return rows.withColumn("window_start", as_ntz(F.col("window_start")))


def range_from_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    layout = gold_lake(spark, sf_dir)
    rows = read_table(spark, layout.gold(incremental.HISTORY))
    levels = incremental.candle_levels(spark, layout)
    return candle_cells.range_candles(levels, rows, RAGGED_START, RAGGED_END, 6)


# Streams: each runs to the end of its input and returns the table it wrote


def _drain(df: DataFrame, source: str) -> DataFrame:
    spark = df.sparkSession
    path = scratch_path(spark, "stream")
    with sized_shuffles(spark, source, spark.sparkContext.defaultParallelism):
        start_parquet(df, f"{path}/table", f"{path}/checkpoint").awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{path}/table")


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Watermarks need a timestamp with time zone; the session zone is UTC.
    schema = standin.table(spark, sf_dir, "events").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
    stream = reader.parquet(sf_dir)
    return standin.event_observations(stream).withColumn(
        "observed_at", F.col("observed_at").cast("timestamp")
    )


def stream_bronze_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = landing_folder(spark, sf_dir)
    written = _drain(stream_bronze(spark, path), path)
    return written.select(
        "timestamp",
        as_ntz(F.col("ingestion_time")).alias("ingestion_time"),
        F.size("data").cast("long").alias("n_assets"),
    )


def stream_dedupe_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = landing_folder(spark, sf_dir)
    flat = silver.flatten_assets(silver.explode_assets(stream_bronze(spark, path)))
    unique = stream_dedupe(flat, keys=("rank", "observed_at"))
    return _observation_columns(_drain(unique, path))


def stream_ohlc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _drain(stream_candles(_event_stream(spark, sf_dir)), f"{sf_dir}/events.parquet")
    return rows.withColumn("window_start", as_ntz(F.col("window_start")))


def stream_ohlc_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return complete_candles(stream_ohlc(spark, sf_dir), standin.events(spark, sf_dir))


mixed_lake = _written(standin.land_mixed)


def _mixed_bronze(spark: SparkSession, sf_dir: str, corrupt: bool) -> DataFrame:
    layout = medallion.Layout(mixed_lake(configure(spark), sf_dir))
    medallion.refresh_bronze(spark, layout)
    return medallion.read_bronze(spark, layout, corrupt)


def bronze_mixed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    assets = silver.explode_assets(silver.parse_assets(_mixed_bronze(spark, sf_dir, False)))
    return assets.select(
        "timestamp",
        F.col("asset.id").alias("asset_id"),
        safe_int(F.col("asset.rank")).alias("rank"),
        F.col("asset.symbol").alias("symbol"),
    )


def bronze_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.regexp_extract("source_file", "cut-([0-9]+)", 1).cast("long")
    return _mixed_bronze(spark, sf_dir, True).select(number.alias("snapshot"))


def stream_bronze_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    layout = medallion.Layout(scratch_path(configure(spark), "folder-lake"))
    for later in (False, True):
        standin.land_until(spark, sf_dir, layout.landing, BRONZE_UNTIL, later)
        medallion.refresh_bronze_by_folder(spark, layout)
    rows = silver.parse_assets(medallion.read_bronze(spark, layout))
    return rows.select(
        "timestamp",
        as_ntz(F.col("ingestion_time")).alias("ingestion_time"),
        F.size("data").cast("long").alias("n_assets"),
    )


def _late_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` in two micro-batches; the second has rows far behind the first's newest."""
    folder = scratch_path(configure(spark), "late-events")
    rows = standin.event_silver(spark, sf_dir)
    late = F.col("symbol") == LATE_SYMBOL
    for load in (~late, late):
        rows.filter(load).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def stream_ohlc_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(configure(spark), "repaired")
    start_repair(_late_stream(spark, sf_dir), f"{folder}/cells", f"{folder}/checkpoint").awaitTermination()
    cells = read_table(spark, f"{folder}/cells")
    return cells.select(as_ntz(F.col("start")).alias("window_start"), "symbol", "low", "high", "open", "close")


def stream_anomalies_online_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = stream_anomalies_online(_event_stream(spark, sf_dir), digits=6)
    rows = _drain(flagged, f"{sf_dir}/events.parquet")
    return rows.withColumn("observed_at", as_ntz(F.col("observed_at")))


def stream_serving_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(configure(spark), "served")
    rows = history.price_history(_event_stream(spark, sf_dir))
    ledger, replace = f"{folder}/ledger", replace_parquet(f"{folder}/tables")
    start_serving_once(rows, "price_history", replace, ledger, "history", f"{folder}/checkpoint").awaitTermination()
    # The first batch comes again, as after a failure; nothing of it is written twice.
    first = read_table(spark, f"{folder}/tables/price_history/batch_id=0")
    once("price_history", replace, ledger, "history")(first, 0)
    served = read_table(spark, f"{folder}/tables/price_history").drop("batch_id")
    return served.withColumn("ingestion_time", as_ntz(F.col("ingestion_time")))


def dedupe_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(configure(spark), "bucketed")
    name = f"stored_keys_{folder.rsplit('-', 1)[-1]}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    gated = silver.quality_gate(_flat(spark, sf_dir))
    cut = F.col("observed_at") < F.lit(BRONZE_UNTIL).cast("timestamp")
    # The whole first load comes again with the second.
    for load in (gated.filter(cut), gated):
        keys = stored_keys.open_keys(spark, name, f"{folder}/keys", buckets)
        new = stage(stored_keys.not_in_keys(load, keys), "new-rows")
        append_silver(new, f"{folder}/silver")
        stored_keys.add_keys(new, name, f"{folder}/keys", buckets)
    return _observation_columns(read_table(spark, f"{folder}/silver", OBSERVATION))


def gold_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch_path(configure(spark), 'versions')}/volatility"
    rows = standin.events(spark, sf_dir)
    old = rows.filter(F.col("observed_at") < F.lit(SILVER_UNTIL).cast("timestamp_ntz"))
    for load in (old, rows):
        versions.write_version(history.volatility(load, raw_digits=6, pct_digits=6), path)
    return versions.read_version(spark, path)


# Sinks, written and read back


def silver_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch_path(configure(spark), 'silver')}/silver"
    append_silver(standin.event_silver(spark, sf_dir), path)
    rows = read_table(spark, path, OBSERVATION)
    return rows.groupBy("observed_date", "symbol").agg(F.count(F.lit(1)).alias("row_count"))


def quality_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch_path(configure(spark), 'reports')}/quality"
    for layer, rows in (("flat", _flat(spark, sf_dir)), ("gated", silver.quality_gate(_flat(spark, sf_dir)))):
        write_report(quality.quality_report(rows, layer), path)
    return spark.read.json(path).select("layer", "total_records", "negative_price_count", "passed")


def csv_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch_path(configure(spark), 'export')}/history"
    export_csv(history.price_history(standin.events(spark, sf_dir)), path)
    schema = "observed_at timestamp_ntz, symbol string, price double, volume_24h double, market_cap double"
    return read_csv(spark, path, schema)


def content_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.content_sample(snapshot.top_assets(_market(spark, sf_dir)), n=1 << 20)
    return rows.withColumn("price", F.round("price", 6))


def serving_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    names, symbols = serving_preview(snapshot.top_assets(_market(spark, sf_dir)))
    return symbols.withColumn("columns", F.lit(",".join(names)))


def load_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(configure(spark), "serving")
    rows = standin.events(spark, sf_dir)
    tables = {
        "price_history": history.price_history(rows),
        "price_changes": indicators.price_changes(rows),
        "history_stats": history.history_stats(rows),
    }
    result = load_tables(spark, tables, lambda df, name: df.write.parquet(f"{folder}/{name}"))
    return result.select("table_name", "ok", "row_count")


def stream_anomalies_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = stage(anomalies.price_stats(standin.events(spark, sf_dir)), "key-stats")
    flagged = stream_anomalies(_event_stream(spark, sf_dir), stats, digits=6)
    rows = _drain(flagged, f"{sf_dir}/events.parquet")
    return rows.withColumn("observed_at", as_ntz(F.col("observed_at")))


QUERIES: dict[str, Query] = {
    "landing_scan": landing_scan,
    "listed_files": listed_files,
    "normalize_payload": normalize,
    "bronze_new_files": bronze_new_files,
    "distinct_sources": distinct_sources,
    "epoch_to_ts": epoch_to_ts,
    "incremental_since": incremental_since,
    "late_admit": late_admit,
    "parse_json_assets": parse_json_assets,
    "explode_assets": explode_assets,
    "flatten_assets": flatten_assets,
    "safe_cast": safe_cast,
    "quality_gate": quality_gate,
    "dedupe_observations": dedupe_observations,
    "latest_snapshot": latest_snapshot,
    "top_assets": top_assets,
    "price_history": price_history,
    "volatility": volatility,
    "price_changes": price_changes,
    "moving_averages": moving_averages,
    "moving_averages_chunked": moving_averages_chunked,
    "moving_averages_by_day": moving_averages_by_day,
    "moving_average_30": moving_average_30,
    "momentum_rsi": momentum_rsi,
    "momentum_rsi_chunked": momentum_rsi_chunked,
    "rolling_volatility": rolling_volatility,
    "indicators": indicator_table,
    "market_dominance": market_dominance,
    "liquidity": liquidity,
    "anomalies_upper": _anomalies("upper"),
    "anomalies_both": _anomalies("both"),
    "anomalies_events": anomalies_events,
    "history_stats": history_stats,
    "volatility_windowed": volatility_windowed,
    "spread": spread,
    "correlation_pairs": correlation_pairs,
    "correlation_grid": correlation_grid,
    "correlation_wanted": correlation_wanted,
    "quality_report": quality_report,
    "layer_profile": layer_profile,
    "layer_symbols": layer_symbols,
    "rename_columns": renamed,
    "symbol_list": symbol_list,
    "time_range": time_range,
    "snapshot_table": snapshot_table,
    "total_market_cap": total_market_cap,
    "total_volume": total_volume,
    "price_ma_series": price_ma_series,
    "price_ma_range": price_ma_range,
    "ohlc_range": ohlc_range,
    "volume_range": volume_range,
    "volatility_ranking": volatility_ranking,
    "dominance_ranking": dominance_ranking,
    "liquidity_ranking": liquidity_ranking,
    "anomaly_feed_top50": anomaly_feed_top50,
    "zscore_in_range": zscore_in_range,
    "ohlc_15m": ohlc_15m,
    "volume_15m": volume_15m,
    "history_stats_ranked": history_stats_ranked,
    "series_last_max_min": series_last_max_min,
    "risk_bands": risk_bands,
    "move_bands": move_bands,
    "anomaly_label": anomaly_labels,
    "moments_merge": moments_merge,
    "gold_incremental": gold_incremental,
    "zscore_range_index": zscore_range_index,
    "ohlc_from_cells": ohlc_from_cells,
    "range_from_cells": range_from_cells,
    "gold_versions": gold_versions,
    "dedupe_bucketed": dedupe_bucketed,
    "silver_dates": silver_dates,
    "quality_log": quality_log,
    "csv_export": csv_export,
    "content_columns": content_columns,
    "serving_symbols": serving_symbols,
    "load_results": load_results,
    "stream_bronze_offsets": stream_bronze_offsets,
    "stream_ohlc_late": stream_ohlc_late,
    "stream_anomalies_online": stream_anomalies_online_query,
    "stream_serving_once": stream_serving_once,
    "stream_bronze": stream_bronze_query,
    "stream_dedupe": stream_dedupe_query,
    "stream_ohlc": stream_ohlc,
    "stream_ohlc_complete": stream_ohlc_complete,
    "bronze_mixed_documents": bronze_mixed_documents,
    "bronze_quarantine": bronze_quarantine,
    "stream_anomalies": stream_anomalies_query,
}
