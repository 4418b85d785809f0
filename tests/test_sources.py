import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from helpers import asset, values
from pricetide.functions import epoch_ms_to_timestamp, safe_double, safe_int
from pricetide.operators import bronze
from pricetide.schema import BRONZE
from pricetide.sources import (
    landing_files,
    normalize_payload,
    read_landing,
    read_payload,
    read_table_or_none,
)


def test_landing_reads_multi_line_documents_with_their_file(spark, tmp_path, land):
    land(tmp_path / "in", "one", 1_000, [asset(), asset("b", "B")])
    land(tmp_path / "in" / "nested", "two", 2_000, [])
    rows = read_landing(spark, str(tmp_path / "in"))
    assert values(rows.select("timestamp", F.size("data").alias("n")), "timestamp", "n") == [
        (1_000, 2), (2_000, 0),
    ]
    files = {r["source_file"] for r in rows.collect()}
    assert {f.rsplit("/", 1)[1] for f in files} == {"one.json", "two.json"}
    assert files == {r["source_file"] for r in landing_files(spark, str(tmp_path / "in")).collect()}


def test_landing_accepts_data_stored_as_text(spark, tmp_path, land):
    land(tmp_path, "text", 1_000, '[{"id": "a", "symbol": "A"}]')
    text = read_landing(spark, str(tmp_path), data_as="text")
    assert text.first()["data"] == '[{"id": "a", "symbol": "A"}]'
    with pytest.raises(ValueError):
        read_landing(spark, str(tmp_path), data_as="map")


def test_missing_table_is_none_but_other_errors_raise(spark, tmp_path):
    assert read_table_or_none(spark, str(tmp_path / "absent"), BRONZE) is None
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "part.parquet").write_text("not parquet")
    with pytest.raises(Exception) as error:
        read_table_or_none(spark, str(tmp_path / "broken"))
    assert not (
        isinstance(error.value, AnalysisException)
        and error.value.getCondition() == "PATH_NOT_FOUND"
    )


def test_normalize_payload_keeps_absent_and_null_apart(spark, tmp_path):
    (tmp_path / "p.json").write_text(
        '{"timestamp": 5, "payload": ['
        '{"id": "a", "symbol": "btc", "name": "n", "market_cap_rank": 1, "current_price": 2.5},'
        '{"id": "b", "symbol": null, "current_price": null, "market_cap": 7},'
        '{"id": "c"}]}'
    )
    rows = normalize_payload(read_payload(spark, str(tmp_path))).select(
        F.explode("data").alias("a")
    ).select("a.*")
    assert values(rows, "id", "rank", "symbol", "name", "priceUsd", "marketCapUsd") == [
        ("a", "1", "BTC", "n", "2.5", "0"),
        ("b", "", None, None, "None", "7"),
        ("c", "", "", None, "0", "0"),
    ]


def test_unprocessed_skips_known_files_and_takes_all_on_a_first_run(spark):
    landing = spark.createDataFrame([("f1", 1), ("f2", 2), ("f2", 3)], "source_file string, n int")
    known = spark.createDataFrame([("f1",), ("f1",)], "source_file string")
    assert values(bronze.unprocessed(landing, known), "n") == [(2,), (3,)]
    assert bronze.unprocessed(landing, None).count() == 3
    assert bronze.distinct_sources(known).count() == 1


def test_epoch_and_safe_casts(spark):
    row = spark.range(1).select(
        epoch_ms_to_timestamp(F.lit(1_700_000_000_999)).cast("string").alias("ts"),
        safe_double(F.lit("None")).alias("bad"),
        safe_double(F.lit("1.5e3")).alias("good"),
        safe_int(F.lit("")).alias("empty"),
        safe_int(F.lit("12")).alias("rank"),
    ).first()
    assert tuple(row) == ("2023-11-14 22:13:20", None, 1500.0, None, 12)
