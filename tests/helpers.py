"""Rows and values that several test modules use."""

from __future__ import annotations

from datetime import datetime, timedelta

T0 = datetime(2024, 1, 1)


def minutes(n: float) -> datetime:
    return T0 + timedelta(minutes=n)


def asset(asset_id="a", symbol="A", price="1.5", rank="1", **extra):
    return {
        "id": asset_id,
        "rank": rank,
        "symbol": symbol,
        "name": asset_id,
        "priceUsd": price,
        "marketCapUsd": "100",
        "volumeUsd24Hr": "10",
        "changePercent24Hr": "0.5",
        **extra,
    }


def values(df, *names):
    """Rows of the given columns as tuples, sorted with NULLs first."""
    rows = (tuple(r) for r in df.select(*names).collect())
    return sorted(rows, key=lambda row: [(v is not None, v) for v in row])
