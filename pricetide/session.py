"""Session settings and the shared scratch folder for staged intermediates."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"
SHUFFLE_PARTITIONS = "spark.sql.shuffle.partitions"

# Shuffled bytes per partition, and how much larger rows are in a shuffle than in Parquet.
BYTES_PER_PARTITION = 128 << 20
PARQUET_EXPANSION = 4

# Rows of an Arrow batch, which the JVM and the Python worker of a task each hold whole.
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
MOST_ARROW_ROWS = 1000

# Runtime settings every job relies on. ANSI mode stays at Spark's default (on).
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Spark lists many folders with up to 10,000 tasks, most of them for one folder each.
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "128",
}

# Large keyed streaming state lives in RocksDB instead of on the JVM heap.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in {**RUNTIME_CONF, **STATE_CONF}.items():
        spark.conf.set(key, value)
    return spark


def build_session(
    app_name: str = "pricetide", master: str | None = None, **conf: str
) -> SparkSession:
    """A configured session; cluster sizing stays with ``spark-submit``."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **STATE_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Size of the files below ``path``, from the listing; no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.agg(F.sum("length")).first()[0] or 0


def partitions_for(size: int, at_least: int) -> int:
    """Shuffle partitions that keep ``size`` stored bytes within task memory."""
    needed = -(-size * PARQUET_EXPANSION // BYTES_PER_PARTITION)
    return max(at_least, needed)


@contextmanager
def sized_shuffles(
    spark: SparkSession, path: str, at_least: int | None = None
) -> Iterator[None]:
    """Enough shuffle partitions for jobs over all of ``path``.

    AQE merges the ones that turn out small, but cannot split most of those that turn
    out too large; so by default there are never fewer than the session sets. Streams
    have no AQE, and keep the number they start with: they may pass a lower
    ``at_least``.
    """
    before = spark.conf.get(SHUFFLE_PARTITIONS)
    floor = int(before) if at_least is None else at_least
    needed = partitions_for(stored_bytes(spark, path), floor)
    spark.conf.set(SHUFFLE_PARTITIONS, str(needed))
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_PARTITIONS, before)


def bound_batches(spark: SparkSession) -> None:
    """Have at most ``MOST_ARROW_ROWS`` rows in an Arrow batch from now on.

    Results come as lazy tables, so the setting stays; a lower one is left as it is. Zero
    and negative numbers are no bound.
    """
    if not 0 < int(spark.conf.get(ARROW_ROWS)) <= MOST_ARROW_ROWS:
        spark.conf.set(ARROW_ROWS, str(MOST_ARROW_ROWS))


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process."""
    master = spark.conf.get("spark.master", "local")
    return master == "local" or master.startswith("local[")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder below the cluster's shared checkpoint directory.

    The directory comes from ``spark.checkpoint.dir``; where that is unset, it is a folder
    below the warehouse. On a cluster, a warehouse on the driver's own disk is refused, as
    executors do not share it.
    """
    base = spark.conf.get(CHECKPOINT_DIR, None)
    if not base:
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        if not is_local(spark) and warehouse.startswith(("file:", "/")):
            raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
        base = f"{warehouse.rstrip('/')}/_scratch"
    return f"{base.rstrip('/')}/pricetide/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and return the written table.

    This cuts the lineage, survives lost executors, and gives Catalyst the real file
    size, so a later join broadcasts the table only if it is below
    ``spark.sql.autoBroadcastJoinThreshold``.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def observed_counts(observation: Observation, *names: str) -> dict[str, int]:
    """The counts of an observation whose action has succeeded.

    Spark drops an observation together with a plan it finds empty at run time, and its
    row then has no fields: every count is 0.
    """
    try:
        counts = observation.get
    except Py4JJavaError:
        return dict.fromkeys(names, 0)
    return {name: counts[name] for name in names}
