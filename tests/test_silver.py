import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from helpers import asset, minutes, values
from pricetide.operators import bronze, silver
from pricetide.sources import read_landing


def flat(spark, folder, data_as="array"):
    rows = bronze.to_bronze(read_landing(spark, str(folder), data_as))
    return silver.flatten_assets(silver.explode_assets(silver.parse_assets(rows)))


@pytest.mark.parametrize("data_as", ["array", "text"])
def test_text_and_array_branches_agree(spark, tmp_path, land, data_as):
    land(tmp_path, "a", 60_999, [asset(), asset("b", "B", "None", "x", supply="9")])
    land(tmp_path, "b", 61_000, [])
    rows = flat(spark, tmp_path, data_as)
    assert values(rows, "asset_id", "rank", "symbol", "price") == [
        ("a", 1, "A", 1.5), ("b", None, "B", None),
    ]
    assert rows.first()["observed_at"].timestamp() % 60 == 0


def test_rank_missing_from_the_stored_struct_is_null(spark):
    old = spark.sql(
        "select timestamp '2024-01-01' as ingestion_time, 'f' as source_file, "
        "array(named_struct('id', 'a', 'symbol', 'A', 'priceUsd', '2')) as data"
    )
    row = silver.flatten_assets(silver.explode_assets(old)).first()
    assert (row["rank"], row["price"], row["market_cap"]) == (None, 2.0, None)
    assert dict(silver.flatten_assets(silver.explode_assets(old)).dtypes)["rank"] == "int"


def test_wrong_shapes_are_errors(spark):
    with pytest.raises(ValueError, match="data"):
        silver.parse_assets(spark.range(1))
    with pytest.raises(TypeError, match="bigint"):
        silver.parse_assets(spark.range(1).withColumnRenamed("id", "data"))


def test_gate_drops_what_no_kpi_can_use_and_counts_it(spark, obs):
    rows = obs([
        ("a", "A", 0, 1.0), ("b", "B", 0, None), ("c", "C", 0, 0.0), ("d", "D", 0, -1.0),
        ("e", "E", 0, float("nan")), ("f", None, 0, 1.0), ("g", "", 0, 1.0),
    ])
    seen = Observation("gate")
    kept = silver.quality_gate(rows, observation=seen)
    assert values(kept, "asset_id") == [("a",), ("g",)]
    assert seen.get == {"rows_in": 7, "rows_dropped": 5}
    strict = silver.quality_gate(rows, allow_empty_symbol=False)
    assert values(strict, "asset_id") == [("a",)]


def test_dedupe_prefers_the_greatest_file_and_ignores_row_order(obs):
    rows = [
        ("a", "A", 0, 1.0, None, None, "f1"), ("a", "A", 0, 2.0, None, None, "f2"),
        ("a", "A", 0, 3.0, None, None, "f2"), ("a", "A", 1, 9.0, None, None, "f1"),
        ("b", "A", 0, 5.0, None, None, "f1"),
    ]
    for order in (rows, rows[::-1]):
        kept = silver.dedupe_observations(obs(order))
        assert values(kept, "asset_id", "price", "source_file") == [
            ("a", 3.0, "f2"), ("a", 9.0, "f1"), ("b", 5.0, "f1"),
        ]
        assert kept.columns == obs(rows).columns


def test_watermark_drop_and_admit(obs):
    stored = obs([("a", "A", 0, 1.0), ("a", "A", 1440, 1.0)])
    batch = obs([
        ("a", "A", 1441, 1.0),  # new
        ("b", "B", 1440, 1.0),  # same time as the newest stored row
        ("b", "B", 1000, 1.0),  # late, within the look-back
        ("a", "A", 1440, 1.0),  # already stored
        ("b", "B", -900, 1.0),  # late, beyond the look-back
    ])
    dropped = silver.since_watermark(batch, stored)
    assert values(dropped, "observed_at") == [(minutes(1441),)]
    admitted = silver.since_watermark(batch, stored, late="admit", lookback_days=1)
    assert values(admitted, "asset_id", "observed_at") == [
        ("a", minutes(1441)), ("b", minutes(1000)), ("b", minutes(1440)),
    ]
    with pytest.raises(ValueError):
        silver.since_watermark(batch, stored, late="keep")


def test_watermark_of_no_or_empty_table_takes_everything(obs):
    batch = obs([("a", "A", 0, 1.0)])
    empty = batch.filter(F.lit(False))
    assert silver.since_watermark(batch, None).count() == 1
    assert silver.since_watermark(batch, empty).count() == 1
    assert silver.since_watermark(batch, empty, late="admit").count() == 1


def test_watermark_reaches_the_scan(spark, obs, tmp_path):
    obs([("a", "A", 0, 1.0)]).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    plan = silver.since_watermark(table, table)._jdf.queryExecution().toString()
    assert "GreaterThan(observed_at,ScalarSubquery" in plan
