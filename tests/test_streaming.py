from helpers import asset, values
from pricetide.operators import anomalies, history
from pricetide.streaming import (
    start_batches,
    start_parquet,
    start_serving,
    stream_anomalies,
    stream_bronze,
    stream_candles,
    stream_dedupe,
)


def drain(df, folder):
    start_parquet(df, str(folder / "table"), str(folder / "ckpt")).awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(str(folder / "table"))


def stream_of(spark, df, folder, files=1):
    df.withColumn("observed_at", df["observed_at"].cast("timestamp")).repartition(files).write.mode(
        "append"
    ).parquet(str(folder))
    return spark.readStream.schema(spark.read.parquet(str(folder)).schema).parquet(str(folder))


def test_a_second_run_adds_only_new_files(spark, tmp_path, land):
    land(tmp_path / "in", "a", 60_500, [asset()])
    bronze = stream_bronze(spark, str(tmp_path / "in"))
    assert drain(bronze, tmp_path).count() == 1
    assert drain(bronze, tmp_path).count() == 1
    land(tmp_path / "in", "b", 120_000, [asset(), asset("b", "B")])
    rows = drain(bronze, tmp_path)
    assert values(rows.selectExpr("size(data) as n", "unix_seconds(ingestion_time) as s"), "s", "n") == [
        (60, 1), (120, 2),
    ]


def test_small_triggers_ingest_everything_once(spark, tmp_path, land):
    for i in range(5):
        land(tmp_path / "in", str(i), i * 1000, [asset()])
    rows = drain(stream_bronze(spark, str(tmp_path / "in"), max_files_per_trigger=2), tmp_path)
    assert rows.select("timestamp").distinct().count() == rows.count() == 5


def test_dedupe_across_runs(spark, tmp_path, obs):
    rows = obs([("a", "A", 0, 1.0), ("a", "A", 0, 1.0), ("b", "B", 0, 2.0)])
    stream = stream_of(spark, rows, tmp_path / "in")
    assert drain(stream_dedupe(stream), tmp_path).count() == 2
    stream_of(spark, obs([("a", "A", 0, 1.0), ("a", "A", 1, 1.0)]), tmp_path / "in")
    assert values(drain(stream_dedupe(stream), tmp_path), "asset_id", "price") == [
        ("a", 1.0), ("a", 1.0), ("b", 2.0),
    ]


def test_closed_candles_equal_the_batch(spark, tmp_path, obs):
    rows = obs([("a", "A", m, float(m % 7)) for m in range(0, 100, 2)])
    streamed = drain(stream_candles(stream_of(spark, rows, tmp_path / "in", 3)), tmp_path)
    batch = history.candles(rows).filter("window_start + interval 15 minutes <= timestamp_ntz'2024-01-01 01:28:00'")
    names = ("symbol", "open", "high", "low", "close")
    got = streamed.withColumn("window_start", streamed["window_start"].cast("timestamp_ntz"))
    assert values(got, "window_start", *names) == values(batch, "window_start", *names)
    assert got.count() == 5


def test_anomalies_against_stored_statistics(spark, tmp_path, obs):
    past = obs([("a", "A", m, 10.0 + m % 2) for m in range(10)])
    anomalies.price_stats(past).write.parquet(str(tmp_path / "stats"))
    stats = spark.read.parquet(str(tmp_path / "stats"))
    new = obs([("a", "A", 20, 30.0), ("a", "A", 21, 10.5), ("a", "A", 22, -9.0), ("z", "Z", 20, 1.0)])
    stream = stream_of(spark, new, tmp_path / "in")
    assert values(drain(stream_anomalies(stream, stats), tmp_path / "up"), "price") == [(30.0,)]
    both = drain(stream_anomalies(stream, stats, side="both"), tmp_path / "both")
    assert values(both, "price") == [(-9.0,), (30.0,)]


def test_batches_reach_the_serving_writer(spark, tmp_path, obs):
    stream = stream_of(spark, obs([("a", "A", m, 1.0) for m in range(4)]), tmp_path / "in")

    def write(batch, batch_id):
        # A repeated batch replaces what its first attempt wrote.
        batch.write.mode("overwrite").parquet(str(tmp_path / "out" / f"batch={batch_id}"))

    start_batches(stream, write, str(tmp_path / "ckpt")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_serving_loads_each_batch_under_serving_names(spark, tmp_path, obs):
    stream = stream_of(spark, obs([("a", "A", 0, 1.0)]), tmp_path / "in")

    def write(batch, table):
        batch.write.mode("overwrite").parquet(str(tmp_path / table))

    start_serving(stream, "crypto_prices", write, str(tmp_path / "ckpt")).awaitTermination()
    served = spark.read.parquet(str(tmp_path / "crypto_prices"))
    assert values(served, "id", "price_usd") == [("a", 1.0)]
