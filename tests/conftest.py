from __future__ import annotations

import json
import sys
from pathlib import Path

import pytest
from pyspark.sql import DataFrame

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from helpers import minutes  # noqa: E402
from pricetide.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[4]",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


COLUMNS = (
    "asset_id string, symbol string, name string, price double, market_cap double, "
    "volume_24h double, change_pct_24h double, observed_at timestamp_ntz, source_file string"
)


@pytest.fixture
def obs(spark):
    """Observations from short tuples (asset_id, symbol, minute, price, cap, volume, file)."""

    def make(rows) -> DataFrame:
        full = []
        for asset_id, symbol, minute, price, *rest in rows:
            cap, volume, source = (*rest, None, None, None)[:3]
            full.append(
                (asset_id, symbol, symbol, price, cap, volume, 0.0, minutes(minute), source)
            )
        return spark.createDataFrame(full, COLUMNS)

    return make


@pytest.fixture
def land():
    """Write one landing document to its own file."""

    def write(folder, name, timestamp, data, **extra):
        folder = Path(folder)
        folder.mkdir(parents=True, exist_ok=True)
        doc = {"timestamp": timestamp, "data": data, **extra}
        (folder / f"{name}.json").write_text(json.dumps(doc, indent=2))

    return write
