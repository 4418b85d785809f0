from unittest.mock import MagicMock

import pytest

from helpers import values
from pricetide import sinks


def test_rename_touches_only_existing_columns(spark):
    df = spark.sql("select 1 as priceUsd, 2 as symbol, 3 as volume_24h")
    assert sinks.rename_columns(df).columns == ["price_usd", "symbol", "volume_usd_24hr"]


def test_csv_export_does_what_the_caller_says(spark, tmp_path):
    df = spark.range(100, numPartitions=4)
    sinks.export_csv(df, str(tmp_path / "one"), single_file=True)
    sinks.export_csv(df, str(tmp_path / "many"))
    assert len(list((tmp_path / "one").glob("*.csv"))) == 1
    assert len(list((tmp_path / "many").glob("*.csv"))) > 1
    for name in ("one", "many"):
        back = spark.read.option("header", True).csv(str(tmp_path / name))
        assert (back.columns, back.count()) == (["id"], 100)


def test_overwrite_replaces(spark, tmp_path):
    for n in (5, 3):
        sinks.overwrite_parquet(spark.range(n), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3


def test_load_reports_every_table_and_row_counts(spark, tmp_path):
    def write(df, table):
        if table.endswith("bad"):
            raise RuntimeError("refused")
        df.write.parquet(str(tmp_path / table))

    tables = {
        "top_assets": spark.sql("select 'A' as symbol, 1.0 as price"),
        "bad": spark.range(1),
        "volatility": spark.range(3),
    }
    result = sinks.load_tables(spark, tables, write)
    assert values(result, "table_name", "ok", "row_count", "error") == [
        ("crypto_bad", False, None, "refused"),
        ("crypto_top_assets", True, 1, None),
        ("crypto_volatility", True, 3, None),
    ]
    assert spark.read.parquet(str(tmp_path / "crypto_top_assets")).columns == ["symbol", "price_usd"]
    with pytest.raises(RuntimeError, match="crypto_bad"):
        sinks.require_loaded(result)
    sinks.require_loaded(result.filter("ok"))


def test_growing_tables_get_only_new_rows(spark, tmp_path):
    broken = False

    def writer(mode):
        def write(df, table):
            df.write.mode(mode).parquet(str(tmp_path / table))
            if broken and table.endswith("price_history"):
                raise RuntimeError("lost")

        return write

    def load(minutes):
        times = ", ".join(f"('A', {m}.0, timestamp_seconds({m * 60}))" for m in minutes)
        history = spark.sql(f"select * from values {times} as t(symbol, price, observed_at)")
        tables = {"price_history": history, "volatility": spark.range(2)}
        marks = str(tmp_path / "marks")
        done = sinks.load_new_rows(spark, tables, writer("overwrite"), writer("append"), marks)
        stored = spark.read.parquet(str(tmp_path / "crypto_price_history"))
        assert spark.read.parquet(str(tmp_path / "crypto_volatility")).count() == 2
        row = done.filter("table_name = 'crypto_price_history'").first()
        return row["ok"], row["row_count"], [int(p) for (p,) in values(stored, "price_usd")]

    assert load([1, 2]) == (True, 2, [1, 2])
    assert load([1, 2, 3]) == (True, 1, [1, 2, 3])
    assert load([1, 2, 3]) == (True, 0, [1, 2, 3])
    broken = True
    assert load([1, 2, 3, 4])[0] is False
    broken = False
    # What the failed load left is replaced, not added to.
    assert load([1, 2, 3, 4, 5]) == (True, 5, [1, 2, 3, 4, 5])


def test_jdbc_writer_options():
    df = MagicMock()
    chain = df.write.mode.return_value
    chain.option.return_value = chain
    sinks.jdbc_writer("jdbc:x", {"user": "u"}, num_partitions=3)(df, "crypto_t")
    df.write.mode.assert_called_once_with("overwrite")
    options = {c.args[0]: c.args[1] for c in chain.option.call_args_list}
    assert options == {"truncate": True, "batchsize": 10_000, "numPartitions": 3}
    chain.jdbc.assert_called_once_with("jdbc:x", "crypto_t", properties={"user": "u"})


def test_preview_writes_nothing(spark):
    columns, symbols = sinks.serving_preview(
        spark.sql("select * from values ('A', 1), ('A', 2) as t(symbol, price)")
    )
    assert columns == ["symbol", "price_usd"]
    assert values(symbols, "symbol") == [("A",)]
