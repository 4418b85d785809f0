"""SQL equivalents of the registered queries, for a second engine to run."""

from __future__ import annotations

# Observations of the stand-in tables.
_EVENTS = """
obs AS (
  SELECT CAST(event_id AS VARCHAR) AS asset_id, event_type AS symbol, event_type AS name,
         value AS price, value * 1000.0 AS market_cap, value AS volume_24h, ts AS observed_at
  FROM events
)"""

_MARKET = """
monthly AS (
  SELECT p_brand AS symbol, CAST(date_trunc('month', l_shipdate) AS TIMESTAMP) AS observed_at,
         CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS volume_24h,
         CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity,
         CAST(SUM(CAST(p_retailprice AS DECIMAL(18,2)) * 1000) AS DOUBLE) AS market_cap
  FROM lineitem JOIN part ON l_partkey = p_partkey
  GROUP BY 1, 2
),
obs AS (
  SELECT symbol AS asset_id, CAST(NULL AS INTEGER) AS rank, symbol, symbol AS name,
         volume_24h / NULLIF(quantity, 0) AS price, market_cap, volume_24h,
         CAST(NULL AS DOUBLE) AS change_pct_24h, observed_at
  FROM monthly
),
latest AS (SELECT * FROM obs WHERE observed_at = (SELECT MAX(observed_at) FROM obs))"""

_DOCS = """
snap AS (
  SELECT event_id // 10 AS snapshot, epoch_us(MIN(ts)) // 1000 AS timestamp, COUNT(*) AS n_assets
  FROM events GROUP BY 1
),
docs AS (
  SELECT snapshot, snapshot // 250 AS batch, timestamp, n_assets,
         make_timestamp((timestamp // 1000) * 1000000) AS ingestion_time FROM snap
  UNION ALL
  SELECT snapshot, snapshot // 250 + 1, timestamp, n_assets,
         make_timestamp((timestamp // 1000) * 1000000) FROM snap WHERE snapshot % 250 = 249
)"""

_FLAT = (
    _DOCS
    + """,
flat AS (
  SELECT d.batch, d.timestamp, CAST(e.user_id AS VARCHAR) AS asset_id,
         CAST(e.event_id AS INTEGER) AS rank, UPPER(e.event_type) AS symbol,
         e.event_type AS name,
         CASE WHEN e.event_id % 97 = 0 THEN NULL WHEN e.event_id % 89 = 0 THEN 0.0
              ELSE e.value END AS price,
         e.value * 1000.0 AS market_cap, e.value AS volume_24h,
         CAST(0 AS DOUBLE) AS change_pct_24h, d.ingestion_time AS observed_at,
         CAST(d.ingestion_time AS DATE) AS observed_date
  FROM docs d JOIN events e ON e.event_id // 10 = d.snapshot
),
gated AS (SELECT * FROM flat WHERE price IS NOT NULL AND symbol IS NOT NULL AND price > 0)"""
)

_FLAT_COLUMNS = (
    "asset_id, rank, symbol, name, price, market_cap, volume_24h, change_pct_24h, "
    "observed_at, observed_date"
)

_SILVER = (
    _FLAT
    + f""",
silver AS (
  SELECT {_FLAT_COLUMNS} FROM (
    SELECT *, ROW_NUMBER() OVER (
      PARTITION BY asset_id, observed_at ORDER BY batch DESC, rank DESC) AS pick
    FROM gated) WHERE pick = 1
)"""
)

_STATS = """
scored AS (
  SELECT *, AVG(price) OVER (PARTITION BY symbol) AS mean,
         (price - AVG(price) OVER (PARTITION BY symbol))
           / NULLIF(STDDEV_SAMP(price) OVER (PARTITION BY symbol), 0) AS z
  FROM obs
)"""



def _volatility(digits: int) -> str:
    return f"""
  ROUND(STDDEV_SAMP(price), {digits}) AS price_stddev, ROUND(AVG(price), {digits}) AS avg_price,
  ROUND((MAX(price) - MIN(price)) / NULLIF(AVG(price), 0) * 100.0, {digits}) AS price_range_pct,
  ROUND(STDDEV_SAMP(price) / NULLIF(AVG(price), 0) * 100.0, {digits}) AS volatility_pct"""


_HISTORY_STATS = """
  ROUND(AVG(price), 6) AS avg_price, MAX(price) AS max_price, MIN(price) AS min_price"""

_RANGE = (
    "observed_at BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-12 12:00:00'"
)


_BETWEEN = "BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-12 12:00:00'"


def _with(*parts: str, select: str) -> str:
    return "WITH " + ",".join(parts) + "\n" + select


def _average(rows: int, digits: int) -> str:
    return (
        f"ROUND(AVG(price) OVER (PARTITION BY symbol ORDER BY observed_at "
        f"ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW), {digits}) AS ma_{rows}"
    )


_MOVED = """
moved AS (
  SELECT *, price - LAG(price) OVER (PARTITION BY symbol ORDER BY observed_at) AS delta,
         LAG(price) OVER (PARTITION BY symbol ORDER BY observed_at) AS prev_price
  FROM obs
),
averaged AS (
  SELECT *, AVG(CASE WHEN delta > 0 THEN delta WHEN delta <= 0 THEN 0.0 END) OVER f AS gain,
         AVG(CASE WHEN delta < 0 THEN -delta WHEN delta >= 0 THEN 0.0 END) OVER f AS loss,
         COUNT(delta) OVER f AS deltas
  FROM moved
  WINDOW f AS (PARTITION BY symbol ORDER BY observed_at ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)
)"""

_RSI = """ROUND(CASE WHEN deltas < 14 THEN NULL WHEN loss = 0 THEN 100.0
              ELSE 100.0 - 100.0 / (1.0 + gain / loss) END, 6) AS rsi"""

_MOVING_AVERAGES = _with(
    _EVENTS,
    select=f"SELECT observed_at, symbol, price, {_average(7, 8)}, {_average(14, 8)} FROM obs",
)

_CHANGE = "(price - prev_price) / NULLIF(prev_price, 0) * 100.0"


def _rsi(source: str, price: str) -> str:
    return _with(
        source, _MOVED, select=f"SELECT observed_at, symbol, {price}, {_RSI} FROM averaged"
    )


def _anomalies(source: str, condition: str, price: str) -> str:
    return _with(
        source,
        _STATS,
        select=f"""SELECT observed_at, symbol, {price}, ROUND(mean, 6) AS global_avg,
          ROUND(z, 6) AS z_score, TRUE AS is_anomaly FROM scored WHERE {condition}""",
    )


def _candles(where: str = "TRUE") -> str:
    return _with(
        _EVENTS,
        select=f"""SELECT time_bucket(INTERVAL '15 minutes', observed_at) AS window_start, symbol,
          MIN(price) AS low, MAX(price) AS high, ARG_MIN(price, observed_at) AS open,
          ARG_MAX(price, observed_at) AS close FROM obs WHERE {where} GROUP BY 1, 2""",
    )


_PAIR_CORR = """SELECT a.symbol AS symbol_a, b.symbol AS symbol_b,
  CAST(COUNT(*) AS BIGINT) AS n_times, ROUND(CORR(a.price, b.price), 6) AS correlation
  FROM {t} a JOIN {t} b ON a.observed_at = b.observed_at AND a.symbol < b.symbol
  GROUP BY 1, 2"""

_DOMINANCE = """
dominance AS (
  SELECT symbol, name, market_cap,
         ROUND(market_cap / (SELECT SUM(market_cap) FROM latest) * 100.0, 6)
           AS market_dominance_pct
  FROM latest WHERE (SELECT SUM(market_cap) FROM latest) > 0
)"""

_LIQUIDITY = """
liquid AS (
  SELECT symbol, name, volume_24h, market_cap,
         ROUND(volume_24h / NULLIF(market_cap, 0), 8) AS liquidity_ratio FROM latest
)"""

ORACLE: dict[str, str] = {
    "landing_scan": _with(
        _DOCS, select="SELECT timestamp, n_assets, TRUE AS has_source FROM docs"
    ),
    "listed_files": _with(_DOCS, select="SELECT DISTINCT batch FROM docs"),
    "normalize_payload": _with(
        _DOCS,
        select="""SELECT d.timestamp, CAST(e.user_id AS VARCHAR) AS id,
          CAST(e.event_id AS VARCHAR) AS rank, UPPER(e.event_type) AS symbol,
          e.event_type AS name,
          e.event_id % 97 = 0 AND e.event_id % 89 <> 0 AS price_was_null,
          CASE WHEN e.event_id % 89 = 0 THEN 0.0 WHEN e.event_id % 97 = 0 THEN NULL
               ELSE e.value END AS price,
          '0' AS market_cap_text, e.value AS volume, '0' AS change_text
          FROM docs d JOIN events e ON e.event_id // 10 = d.snapshot""",
    ),
    "bronze_new_files": _with(
        _DOCS,
        select="""SELECT batch, timestamp, ingestion_time, n_assets FROM docs
          WHERE batch NOT IN (SELECT batch FROM docs
                              WHERE ingestion_time < TIMESTAMP '2024-01-15 00:00:00')""",
    ),
    "distinct_sources": _with(_DOCS, select="SELECT DISTINCT batch FROM docs"),
    "epoch_to_ts": """SELECT event_id, epoch_us(ts) // 1000 AS ms,
      date_trunc('second', ts) AS ts_seconds FROM events""",
    "incremental_since": _with(
        _EVENTS,
        select="""SELECT asset_id, symbol, price, observed_at FROM obs WHERE observed_at >
          (SELECT MAX(observed_at) FROM obs WHERE observed_at < TIMESTAMP '2024-01-20 00:00:00')""",
    ),
    "late_admit": _with(
        _EVENTS,
        """
stored AS (SELECT * FROM obs WHERE observed_at < TIMESTAMP '2024-01-20 00:00:00'
           AND symbol <> 'signup')""",
        select="""SELECT asset_id, symbol, price, observed_at FROM obs
          WHERE observed_at > (SELECT MAX(observed_at) FROM stored) - INTERVAL '3 days'
          AND NOT EXISTS (SELECT 1 FROM stored s WHERE s.asset_id = obs.asset_id
                          AND s.observed_at = obs.observed_at)""",
    ),
    "parse_json_assets": _with(
        _FLAT,
        select="""SELECT timestamp, asset_id AS id, CAST(rank AS VARCHAR) AS rank, symbol, name
          FROM flat""",
    ),
    "explode_assets": _with(
        _FLAT, select="SELECT timestamp, CAST(rank AS VARCHAR) AS rank FROM flat"
    ),
    "flatten_assets": _with(_FLAT, select=f"SELECT {_FLAT_COLUMNS} FROM flat"),
    "safe_cast": _with(
        _FLAT,
        select="""SELECT rank, price, market_cap, CAST(NULL AS INTEGER) AS symbol_as_int
          FROM flat""",
    ),
    "quality_gate": _with(_FLAT, select=f"SELECT {_FLAT_COLUMNS} FROM gated"),
    "dedupe_observations": _with(_SILVER, select=f"SELECT {_FLAT_COLUMNS} FROM silver"),
    "latest_snapshot": _with(
        _MARKET,
        select=f"SELECT symbol, price, market_cap, volume_24h, observed_at FROM latest",
    ),
    "top_assets": _with(
        _MARKET,
        select=f"""SELECT asset_id, rank, symbol, name, price, market_cap, volume_24h,
          change_pct_24h, observed_at FROM latest ORDER BY market_cap DESC NULLS LAST""",
    ),
    "price_history": _with(
        _EVENTS, select="SELECT observed_at, symbol, price, volume_24h, market_cap FROM obs"
    ),
    "volatility": _with(
        _EVENTS, select=f"SELECT symbol, {_volatility(6)} FROM obs GROUP BY symbol"
    ),
    "price_changes": _with(
        _EVENTS,
        _MOVED,
        select=f"""SELECT observed_at, symbol, price, prev_price,
          ROUND({_CHANGE}, 8) AS price_change_pct FROM moved WHERE prev_price IS NOT NULL""",
    ),
    "moving_averages": _MOVING_AVERAGES,
    "moving_averages_chunked": _MOVING_AVERAGES,
    "moving_average_30": _with(
        _EVENTS, select=f"SELECT observed_at, symbol, price, {_average(30, 8)} FROM obs"
    ),
    "momentum_rsi": _rsi(_MARKET, "price"),
    "momentum_rsi_chunked": _rsi(_EVENTS, "price"),
    "rolling_volatility": _with(
        _EVENTS,
        select="""SELECT observed_at, symbol, price,
          ROUND(STDDEV_SAMP(price) OVER f / NULLIF(AVG(price) OVER f, 0) * 100.0, 6)
            AS rolling_volatility_pct FROM obs
          WINDOW f AS (PARTITION BY symbol ORDER BY observed_at
                       ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""",
    ),
    "indicators": _with(
        _EVENTS,
        _MOVED,
        select=f"""SELECT observed_at, symbol, price, prev_price, {_average(7, 6)},
          {_average(14, 6)}, {_average(30, 6)}, {_RSI},
          ROUND({_CHANGE}, 6) AS price_change_pct FROM averaged""",
    ),
    "market_dominance": _with(_MARKET, _DOMINANCE, select="SELECT * FROM dominance"),
    "liquidity": _with(_MARKET, _LIQUIDITY, select="SELECT * FROM liquid"),
    "anomalies_upper": _anomalies(_MARKET, "ROUND(z, 6) > 2.0", "price"),
    "anomalies_both": _anomalies(_MARKET, "ABS(ROUND(z, 6)) > 2.0", "price"),
    "anomalies_events": _anomalies(_EVENTS, "ROUND(z, 6) > 2.0", "price"),
    "history_stats": _with(
        _EVENTS, select=f"SELECT symbol, {_HISTORY_STATS} FROM obs GROUP BY symbol"
    ),
    "volatility_windowed": _with(
        _EVENTS,
        select=f"""SELECT time_bucket(INTERVAL '6 hours', observed_at) AS window_start, symbol,
          {_volatility(7)} FROM obs GROUP BY 1, 2""",
    ),
    "spread": _with(
        _EVENTS,
        select="""SELECT CAST(date_trunc('day', observed_at) AS TIMESTAMP) AS window_start, symbol,
          MAX(price) AS high, MIN(price) AS low, ROUND(MAX(price) - MIN(price), 6) AS spread
          FROM obs GROUP BY 1, 2""",
    ),
    "correlation_pairs": _with(_MARKET, select=_PAIR_CORR.format(t="obs")),
    "correlation_grid": _with(
        _EVENTS,
        """
cells AS (SELECT symbol, time_bucket(INTERVAL '6 hours', observed_at) AS observed_at,
                 AVG(price) AS price FROM obs GROUP BY 1, 2)""",
        select=_PAIR_CORR.format(t="cells"),
    ),
    "quality_report": _with(
        _FLAT,
        select="""SELECT 'flat' AS layer, COUNT(*) AS total_records,
          COUNT(DISTINCT symbol) + MAX(CASE WHEN symbol IS NULL THEN 1 ELSE 0 END)
            AS distinct_symbols,
          COUNT(*) FILTER (WHERE price IS NULL) AS null_price_count,
          ROUND(COUNT(*) FILTER (WHERE price IS NULL) / COUNT(*) * 100.0, 2) AS null_price_pct,
          COUNT(*) FILTER (WHERE symbol IS NULL) AS null_symbol_count,
          ROUND(COUNT(*) FILTER (WHERE symbol IS NULL) / COUNT(*) * 100.0, 2) AS null_symbol_pct,
          COUNT(*) FILTER (WHERE price < 0) AS negative_price_count,
          COUNT(*) FILTER (WHERE price IS NULL OR symbol IS NULL OR price < 0) = 0 AS passed
          FROM flat""",
    ),
    "layer_profile": _with(
        _SILVER,
        select="""SELECT 'bronze' AS layer, COUNT(*) AS row_count,
            CAST(NULL AS BIGINT) AS distinct_symbols FROM docs
          UNION ALL
          SELECT 'silver', COUNT(*), COUNT(DISTINCT symbol) FROM silver""",
    ),
    "layer_symbols": _with(
        _MARKET,
        select="""SELECT DISTINCT 'top_assets' AS layer, symbol FROM latest
          UNION ALL SELECT DISTINCT 'events', event_type FROM events""",
    ),
    "rename_columns": _with(
        _MARKET,
        select="""SELECT asset_id AS id, symbol, price AS price_usd,
          market_cap AS market_cap_usd, volume_24h AS volume_usd_24hr,
          change_pct_24h AS change_percent_24hr, observed_at AS ingestion_time FROM latest""",
    ),
    "symbol_list": _with(_MARKET, select="SELECT DISTINCT symbol FROM latest ORDER BY 1"),
    "time_range": _with(
        _EVENTS,
        select=f"""SELECT observed_at, symbol, price, volume_24h, market_cap FROM obs
          WHERE {_RANGE}""",
    ),
    "snapshot_table": _with(
        _MARKET,
        select=f"""SELECT symbol, name, price, market_cap, volume_24h, change_pct_24h
          FROM latest WHERE symbol IN ('Brand#4', 'Brand#12', 'Brand#19', 'Brand#21')
          ORDER BY market_cap DESC NULLS LAST""",
    ),
    "total_market_cap": _with(
        _MARKET,
        select="""SELECT 'Total Market Cap' AS metric, ROUND(SUM(market_cap), 2) AS value
          FROM latest""",
    ),
    "total_volume": _with(
        _MARKET,
        select="""SELECT 'Total 24h Volume' AS metric, ROUND(SUM(volume_24h), 2) AS value
          FROM latest""",
    ),
    "price_ma_series": _MOVING_AVERAGES + " ORDER BY observed_at, symbol",
    "volatility_ranking": _with(
        _EVENTS,
        select=f"""SELECT symbol, {_volatility(6)} FROM obs GROUP BY symbol
          ORDER BY volatility_pct DESC NULLS LAST""",
    ),
    "dominance_ranking": _with(
        _MARKET,
        _DOMINANCE,
        select="SELECT * FROM dominance ORDER BY market_dominance_pct DESC NULLS LAST",
    ),
    "liquidity_ranking": _with(
        _MARKET, _LIQUIDITY, select="SELECT * FROM liquid ORDER BY liquidity_ratio DESC NULLS LAST"
    ),
    "anomaly_feed_top50": _with(
        _EVENTS,
        _STATS,
        select="""SELECT observed_at, symbol, price, ROUND(mean, 2) AS global_avg,
          ROUND(z, 3) AS z_score, ABS(z) > 2 AS is_anomaly,
          CASE WHEN ABS(z) > 2 THEN 'ANOMALY' WHEN ABS(z) <= 2 THEN 'normal' END AS label
          FROM scored ORDER BY ABS(z) DESC NULLS LAST, observed_at, asset_id LIMIT 50""",
    ),
    "zscore_in_range": _with(
        _EVENTS,
        f"""
visible AS (SELECT * FROM obs WHERE {_RANGE})""",
        select="""SELECT observed_at, symbol,
          ROUND((price - AVG(price) OVER w) / NULLIF(STDDEV_SAMP(price) OVER w, 0), 6) AS z_score
          FROM visible WINDOW w AS (PARTITION BY symbol)""",
    ),
    "price_ma_range": "SELECT * FROM (" + _MOVING_AVERAGES + ") WHERE observed_at " + _BETWEEN,
    "ohlc_range": _candles("observed_at " + _BETWEEN),
    "volume_range": _with(
        _EVENTS,
        select=f"""SELECT time_bucket(INTERVAL '15 minutes', observed_at) AS window_start, symbol,
          ROUND(AVG(volume_24h), 8) AS volume FROM obs WHERE observed_at {_BETWEEN} GROUP BY 1, 2""",
    ),
    "stream_ohlc_complete": _candles(),
    "bronze_mixed_documents": _with(
        _DOCS,
        select="""SELECT d.timestamp, CAST(e.user_id AS VARCHAR) AS asset_id,
          CAST(e.event_id AS INTEGER) AS rank, UPPER(e.event_type) AS symbol
          FROM docs d JOIN events e ON e.event_id // 10 = d.snapshot WHERE d.snapshot % 50 != 7""",
    ),
    "bronze_quarantine": _with(_DOCS, select="SELECT snapshot FROM snap WHERE snapshot % 50 = 7"),
    "correlation_wanted": _with(
        _MARKET,
        select="""SELECT least(a.symbol, b.symbol) AS symbol_a, greatest(a.symbol, b.symbol) AS symbol_b,
          CAST(COUNT(*) AS BIGINT) AS n_times, ROUND(CORR(a.price, b.price), 6) AS correlation
          FROM obs a JOIN obs b ON a.observed_at = b.observed_at
          AND CAST(substr(b.symbol, 7) AS INTEGER) = CAST(substr(a.symbol, 7) AS INTEGER) + 1
          GROUP BY 1, 2""",
    ),
    "ohlc_15m": _candles(),
    "volume_15m": _with(
        _EVENTS,
        select="""SELECT time_bucket(INTERVAL '15 minutes', observed_at) AS window_start, symbol,
          ROUND(AVG(volume_24h), 8) AS volume FROM obs GROUP BY 1, 2""",
    ),
    "history_stats_ranked": _with(
        _EVENTS,
        select=f"""SELECT symbol, {_HISTORY_STATS} FROM obs GROUP BY symbol
          ORDER BY avg_price DESC NULLS LAST""",
    ),
    "series_last_max_min": "WITH ma AS ("
    + _MOVING_AVERAGES
    + ")"
    + " UNION ALL ".join(
        f"""SELECT symbol, '{v}' AS series, ARG_MAX({v}, observed_at) AS last_value,
          MAX({v}) AS max_value, MIN({v}) AS min_value FROM ma GROUP BY symbol"""
        for v in ("price", "ma_7", "ma_14")
    ),
    "risk_bands": _with(
        _MARKET,
        """
v AS (SELECT symbol, STDDEV_SAMP(price) / NULLIF(AVG(price), 0) * 100.0 AS pct
      FROM obs GROUP BY symbol)""",
        select="""SELECT symbol,
          CASE WHEN pct IS NULL THEN NULL WHEN ROUND(pct, 4) >= 15 THEN 'high'
               WHEN ROUND(pct, 4) >= 5 THEN 'mid' ELSE 'low' END AS volatility_band,
          CASE WHEN market_cap = 0 OR volume_24h IS NULL THEN NULL
               WHEN ROUND(volume_24h / market_cap, 4) >= 0.1 THEN 'high'
               WHEN ROUND(volume_24h / market_cap, 4) >= 0.03 THEN 'mid' ELSE 'low' END
            AS liquidity_band
          FROM latest JOIN v USING (symbol)""",
    ),
    "move_bands": _with(
        _EVENTS,
        _MOVED,
        _STATS,
        """
bands AS (
  SELECT symbol, CASE WHEN prev_price = 0 THEN NULL
                      WHEN ROUND((price - prev_price) / prev_price * 100.0, 8) >= 0
                      THEN 'non_negative' ELSE 'negative' END AS band
  FROM moved WHERE prev_price IS NOT NULL
  UNION ALL
  SELECT symbol, CASE WHEN z IS NULL THEN NULL WHEN ROUND(z, 6) >= 2 THEN 'anomaly'
                      WHEN ROUND(z, 6) >= 1.5 THEN 'watch' ELSE 'normal' END FROM scored
)""",
        select="SELECT symbol, band, COUNT(*) AS row_count FROM bands GROUP BY 1, 2",
    ),
    "anomaly_label": _with(
        _EVENTS,
        _STATS,
        select="""SELECT observed_at, symbol, ROUND(z, 6) AS z_score,
          CASE WHEN ROUND(z, 6) > 2 THEN 'ANOMALY' WHEN ROUND(z, 6) <= 2 THEN 'normal' END AS label
          FROM scored""",
    ),
    "stream_bronze": _with(_DOCS, select="SELECT timestamp, ingestion_time, n_assets FROM docs"),
    "stream_dedupe": _with(_FLAT, select=f"SELECT DISTINCT {_FLAT_COLUMNS} FROM flat"),
    "stream_ohlc": _candles(
        """time_bucket(INTERVAL '15 minutes', observed_at) + INTERVAL '15 minutes'
          <= (SELECT MAX(observed_at) FROM obs) - INTERVAL '10 minutes'"""
    ),
    "stream_anomalies": _with(
        _EVENTS,
        _STATS,
        select="""SELECT observed_at, symbol, price, ROUND(z, 6) AS z_score, TRUE AS is_anomaly
          FROM scored WHERE ROUND(z, 6) > 2.0""",
    ),
}

# Queries that reach the rows of another one in another way.
ORACLE |= {
    "moving_averages_by_day": _MOVING_AVERAGES,
    "gold_incremental": ORACLE["indicators"],
    "zscore_range_index": ORACLE["zscore_in_range"],
    "moments_merge": _with(
        _EVENTS,
        select=f"""SELECT symbol, {_volatility(6)}, MAX(price) AS max_price, MIN(price) AS min_price
          FROM obs GROUP BY symbol""",
    ),
    "ohlc_from_cells": _with(
        _EVENTS,
        select=" UNION ALL ".join(
            f"""SELECT time_bucket(INTERVAL '{seconds} seconds', observed_at, TIMESTAMP '1970-01-01') AS window_start,
          symbol, MIN(price) AS low, MAX(price) AS high, ARG_MIN(price, observed_at) AS open,
          ARG_MAX(price, observed_at) AS close, ROUND(AVG(volume_24h), 8) AS volume,
          CAST({seconds} AS INTEGER) AS seconds FROM obs GROUP BY 1, 2"""
            for seconds in (1800, 6 * 3600, 2 * 86400)
        ),
    ),
    "range_from_cells": _with(
        _EVENTS,
        select="""SELECT symbol, ARG_MIN(price, observed_at) AS open, MAX(price) AS high, MIN(price) AS low,
          ARG_MAX(price, observed_at) AS close, ROUND(AVG(price), 6) AS avg_price,
          ROUND(MAX(price) - MIN(price), 6) AS spread,
          ROUND((MAX(price) - MIN(price)) / NULLIF(AVG(price), 0) * 100.0, 6) AS price_range_pct,
          ROUND(AVG(volume_24h), 6) AS volume FROM obs
          WHERE observed_at BETWEEN TIMESTAMP '2024-01-04 07:22:31' AND TIMESTAMP '2024-01-17 19:51:03'
          GROUP BY symbol""",
    ),
    "stream_bronze_offsets": ORACLE["stream_bronze"],
    "stream_ohlc_late": ORACLE["ohlc_15m"],
    "dedupe_bucketed": ORACLE["dedupe_observations"],
    "gold_versions": ORACLE["volatility"],
    "stream_serving_once": _with(
        _EVENTS,
        select="""SELECT observed_at AS ingestion_time, symbol, price AS price_usd,
          volume_24h AS volume_usd_24hr, market_cap AS market_cap_usd FROM obs""",
    ),
    "stream_anomalies_online": _with(
        _EVENTS,
        """
before AS (SELECT *, AVG(price) OVER w AS mean, STDDEV_SAMP(price) OVER w AS sd FROM obs
  WINDOW w AS (PARTITION BY symbol ORDER BY observed_at, asset_id
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
scores AS (SELECT *, ROUND((price - mean) / NULLIF(sd, 0), 6) AS z_score FROM before)""",
        select="SELECT observed_at, symbol, price, z_score, TRUE AS is_anomaly FROM scores WHERE z_score > 2.0",
    ),
    "silver_dates": _with(
        _EVENTS,
        select="""SELECT CAST(observed_at AS DATE) AS observed_date, symbol, COUNT(*) AS row_count
          FROM obs GROUP BY 1, 2""",
    ),
    "quality_log": _with(
        _FLAT,
        select="""SELECT 'flat' AS layer, COUNT(*) AS total_records,
          COUNT(*) FILTER (price < 0) AS negative_price_count,
          COUNT(*) FILTER (price IS NULL OR symbol IS NULL OR price < 0) = 0 AS passed FROM flat
          UNION ALL SELECT 'gated', COUNT(*), COUNT(*) FILTER (price < 0), TRUE FROM gated""",
    ),
    "csv_export": ORACLE["price_history"],
    "content_columns": _with(_MARKET, select="SELECT symbol, name, ROUND(price, 6) AS price FROM latest"),
    "serving_symbols": _with(
        _MARKET,
        select="""SELECT DISTINCT symbol, 'id,rank,symbol,name,price_usd,market_cap_usd,volume_usd_24hr,'
          || 'change_percent_24hr,ingestion_time' AS columns FROM latest""",
    ),
    "load_results": _with(
        _EVENTS,
        select="""SELECT 'crypto_price_history' AS table_name, TRUE AS ok, COUNT(*) AS row_count FROM obs
          UNION ALL SELECT 'crypto_price_changes', TRUE, COUNT(*) - COUNT(DISTINCT symbol) FROM obs
          UNION ALL SELECT 'crypto_history_stats', TRUE, COUNT(DISTINCT symbol) FROM obs""",
    ),
}
