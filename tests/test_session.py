from unittest.mock import MagicMock

import pytest

from pricetide import session


def test_staged_tables_live_below_the_checkpoint_dir(spark):
    base = spark.conf.get(session.CHECKPOINT_DIR, None)
    staged = session.stage(spark.range(3), "ids")
    assert staged.count() == 3
    if base:
        assert all(base in f for f in staged.inputFiles())


def test_scratch_paths_are_never_shared(spark):
    assert session.scratch_path(spark, "x") != session.scratch_path(spark, "x")


def test_a_cluster_needs_a_shared_folder():
    def of(**conf):
        names = {k.replace("_", "."): v for k, v in conf.items()}
        fake = MagicMock()
        fake.conf.get = lambda name, default=None: names.get(name, default)
        return session.scratch_path(fake, "x")

    warehouse = {"spark_sql_warehouse_dir": "file:/tmp/warehouse"}
    assert of(spark_master="local[4]", **warehouse).startswith("file:/tmp/warehouse/_scratch/")
    for master in ("yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="all executors share"):
            of(spark_master=master, **warehouse)
        assert of(spark_master=master, spark_sql_warehouse_dir="hdfs://n/w").startswith("hdfs://n/w/_scratch/")
        assert of(spark_master=master, spark_checkpoint_dir="file:/shared", **warehouse).startswith("file:/shared/")


def test_a_staged_table_is_broadcast_only_below_the_threshold(spark):
    small = session.stage(spark.range(10), "small")

    def plan():
        joined = spark.range(1000, numPartitions=4).join(small, "id")
        return joined._jdf.queryExecution().executedPlan().toString()

    assert "BroadcastHashJoin" in plan()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        assert "SortMergeJoin" in plan()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize(
    ("size", "at_least", "want"),
    [(0, 8, 8), (1 << 30, 8, 32), (100 << 40, 200, 3_276_800)],
)
def test_shuffle_partitions_follow_the_data(size, at_least, want):
    assert session.partitions_for(size, at_least) == want


def test_sized_shuffles_restores_the_setting(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "t"))
    before = spark.conf.get(session.SHUFFLE_PARTITIONS)
    assert session.stored_bytes(spark, str(tmp_path / "t")) > 0
    with pytest.raises(RuntimeError), session.sized_shuffles(spark, str(tmp_path / "t")):
        assert spark.conf.get(session.SHUFFLE_PARTITIONS) == before
        raise RuntimeError
    assert spark.conf.get(session.SHUFFLE_PARTITIONS) == before
