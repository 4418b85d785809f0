from pricetide.functions.columns import (  # noqa: F401
    anomaly_label,
    as_ntz,
    band,
    change_sign,
    epoch_ms_to_timestamp,
    liquidity_band,
    percent_of,
    rounded,
    safe_double,
    safe_int,
    volatility_band,
    z_band,
    z_score,
)
