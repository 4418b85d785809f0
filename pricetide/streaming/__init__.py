from pricetide.streaming.queries import (  # noqa: F401
    complete_candles,
    once,
    replace_parquet,
    start_batches,
    start_parquet,
    start_serving,
    start_serving_once,
    stream_anomalies,
    stream_bronze,
    stream_candles,
    stream_dedupe,
)
