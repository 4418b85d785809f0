"""Column expressions; all are built-ins, so they stay inside code generation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed display thresholds: lower bound of each band, ascending.
VOLATILITY_BANDS = (("low", None), ("mid", 5.0), ("high", 15.0))
LIQUIDITY_BANDS = (("low", None), ("mid", 0.03), ("high", 0.1))
Z_BANDS = (("normal", None), ("watch", 1.5), ("anomaly", 2.0))
CHANGE_BANDS = (("negative", None), ("non_negative", 0.0))


def epoch_ms_to_timestamp(ms: Column) -> Column:
    """Epoch milliseconds to a timestamp cut to whole seconds."""
    return F.timestamp_seconds((ms / F.lit(1000)).cast("long"))


def as_ntz(ts: Column) -> Column:
    """Wall-clock timestamp without a zone (session zone: UTC)."""
    return ts.cast("timestamp_ntz")


def safe_double(text: Column) -> Column:
    """Text to double; malformed text such as ``None`` becomes NULL."""
    return text.try_cast("double")


def safe_int(text: Column) -> Column:
    """Text to int; malformed text becomes NULL."""
    return text.try_cast("int")


def rounded(value: Column, digits: int | None) -> Column:
    """``round`` to ``digits``; ``None`` leaves the value as it is."""
    return value if digits is None else F.round(value, digits)


def percent_of(part: Column, whole: Column) -> Column:
    """``part / whole * 100``; NULL for a zero or NULL ``whole``."""
    return F.try_divide(part, whole) * F.lit(100.0)


def z_score(value: Column, mean: Column, stddev: Column) -> Column:
    """Standard score; NULL for a zero or NULL standard deviation."""
    return F.try_divide(value - mean, stddev)


def band(value: Column, bands: Sequence[tuple[str, float | None]]) -> Column:
    """Label of the band that holds ``value``; NULL stays NULL."""
    (lowest, _), *upper = bands
    label = F.when(value.isNull(), F.lit(None).cast("string"))
    for name, lower_bound in reversed(upper):
        label = label.when(value >= F.lit(lower_bound), F.lit(name))
    return label.otherwise(F.lit(lowest))


def volatility_band(pct: Column) -> Column:
    return band(pct, VOLATILITY_BANDS)


def liquidity_band(ratio: Column) -> Column:
    return band(ratio, LIQUIDITY_BANDS)


def z_band(z: Column) -> Column:
    return band(z, Z_BANDS)


def change_sign(pct: Column) -> Column:
    return band(pct, CHANGE_BANDS)


def anomaly_label(is_anomaly: Column) -> Column:
    """Boolean flag to the feed's display text; NULL stays NULL."""
    return F.when(is_anomaly, F.lit("ANOMALY")).when(~is_anomaly, F.lit("normal"))
