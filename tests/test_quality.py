import pytest
from pyspark.sql import functions as F

from helpers import values
from pricetide.operators import quality
from pricetide.sinks import write_report


def test_report_counts_in_one_row(spark, obs):
    rows = obs([
        ("a", "A", 0, 1.0), ("b", "B", 0, None), ("c", None, 0, -1.0), ("d", "A", 0, 0.0),
    ])
    report = quality.quality_report(rows, "silver")
    got = report.first().asDict()
    assert got.pop("run_at")
    assert got == {
        "layer": "silver", "total_records": 4, "distinct_symbols": 3,
        "null_price_count": 1, "null_price_pct": 25.0, "null_symbol_count": 1,
        "null_symbol_pct": 25.0, "negative_price_count": 1, "passed": False,
    }
    with pytest.raises(quality.QualityError, match="failed for silver"):
        quality.enforce_quality(report)


def test_gate_passes_zero_prices_and_refuses_empty_layers(obs):
    rows = obs([("d", "A", 0, 0.0)])
    assert quality.enforce_quality(quality.quality_report(rows, "x"))["passed"]
    empty = quality.quality_report(rows.filter(F.lit(False)), "x")
    with pytest.raises(quality.QualityError, match="0 records"):
        quality.enforce_quality(empty)


def test_reports_of_all_runs_are_kept(spark, obs, tmp_path):
    report = quality.quality_report(obs([("a", "A", 0, 1.0)]), "silver")
    for _ in range(2):
        write_report(report, str(tmp_path / "reports"))
    assert spark.read.json(str(tmp_path / "reports")).count() == 2


def test_profiles(spark, obs):
    rows = obs([("a", "A", 0, 1.0), ("a", "A", 1, 1.0), ("b", None, 0, 1.0)])
    layers = {"bronze": spark.range(4), "silver": rows}
    profile = quality.layer_profile(layers)
    assert values(profile, "layer", "row_count", "distinct_symbols") == [
        ("bronze", 4, None), ("silver", 3, 2),
    ]
    assert profile.filter("layer = 'bronze'").first()["schema"] == "struct<id:bigint>"
    assert values(quality.layer_symbols(layers), "layer", "symbol") == [
        ("silver", None), ("silver", "A"),
    ]
    assert quality.content_sample(rows, n=2).columns == ["symbol", "name", "price"]
    assert quality.content_sample(rows, n=2).count() == 2
