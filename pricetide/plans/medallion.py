"""Landing to bronze to silver to gold, as ordered batch stages on one session."""

from __future__ import annotations

from contextlib import nullcontext
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricetide.operators.bronze import to_bronze
from pricetide.operators.indicators import indicators
from pricetide.operators.quality import enforce_quality, quality_report
from pricetide.operators.silver import newer_than, not_stored, to_silver
from pricetide.plans.kpis import all_kpis
from pricetide.schema import BRONZE, CORRUPT, OBSERVATION
from pricetide.session import observed_counts, sized_shuffles, stage
from pricetide.sinks import append_silver, overwrite_parquet, write_report
from pricetide.sources import read_landing, read_table, read_table_or_none, stream_landing
from pricetide.sources.folders import (
    OPEN_FOLDERS,
    folder_names,
    folder_of,
    folders_to_read,
    partition_values,
    unread_files,
)
from pricetide.streaming import start_parquet

# Bronze's partition by landing folder, where folders are dates of arrival.
FOLDER = "landing_folder"
PROGRESS_KEPT = "spark.sql.streaming.numRecentProgressUpdates"


@dataclass(frozen=True)
class Layout:
    """Folders of one lakehouse."""

    root: str

    def folder(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    @property
    def landing(self) -> str:
        return self.folder("landing")

    @property
    def bronze(self) -> str:
        return self.folder("bronze")

    @property
    def silver(self) -> str:
        return self.folder("silver")

    @property
    def quality(self) -> str:
        return self.folder("quality_reports")

    def gold(self, table: str) -> str:
        return self.folder(f"gold/{table}")


def refresh_bronze(
    spark: SparkSession,
    layout: Layout,
    on_corrupt: str = "quarantine",
    max_files_per_trigger: int | None = None,
) -> dict[str, int]:
    """Append the snapshots of files not ingested yet; returns ``rows`` and ``quarantined``.

    A stream over what is there now, whose checkpoint remembers the files: each is read
    once, whatever its name and however many there are. ``data`` stays text, whether it
    came as an array or as text. Files that are no JSON documents go to the partition
    ``corrupt=1`` with their text; ``on_corrupt="fail"`` raises after that.
    """
    if on_corrupt not in ("quarantine", "fail"):
        raise ValueError(f"on_corrupt must be 'quarantine' or 'fail', not {on_corrupt!r}")
    landed = stream_landing(spark, layout.landing, "text", max_files_per_trigger, keep_corrupt=True)
    rows = to_bronze(landed).withColumns(
        {
            "corrupt": F.col(CORRUPT).isNotNull().cast("int"),
            "ingestion_date": F.to_date("ingestion_time"),
        }
    )
    counted = rows.observe(
        "ingest", F.count(F.lit(1)).alias("all"), F.sum("corrupt").alias("corrupt")
    )
    # Else each task would write a file for every date that its landing files have.
    dealt = counted.hint("rebalance", "corrupt", "ingestion_date")
    # The counts come from the progress of every batch, of which Spark keeps 100.
    before = spark.conf.get(PROGRESS_KEPT)
    spark.conf.set(PROGRESS_KEPT, str(2**31 - 1))
    try:
        query = start_parquet(
            dealt, layout.bronze, layout.folder("_checkpoints/bronze"), "corrupt", "ingestion_date"
        )
        query.awaitTermination()
    finally:
        spark.conf.set(PROGRESS_KEPT, before)
    found = [p.observedMetrics["ingest"] for p in query.recentProgress if "ingest" in p.observedMetrics]
    total = sum(row["all"] or 0 for row in found)
    bad = sum(row["corrupt"] or 0 for row in found)
    if bad and on_corrupt == "fail":
        raise ValueError(f"{bad} landing file(s) are no JSON; see corrupt=1 in {layout.bronze}")
    return {"rows": total - bad, "quarantined": bad}


def refresh_bronze_by_folder(
    spark: SparkSession,
    layout: Layout,
    open_folders: int = OPEN_FOLDERS,
    on_corrupt: str = "quarantine",
) -> dict[str, int]:
    """:func:`refresh_bronze` for a landing folder with one folder for each arrival date.

    The newest folder in bronze is the offset: only folders after it and the
    ``open_folders`` up to it are listed, and only their part of bronze is compared with.
    Nothing is remembered but bronze itself. A file's name and modification time do not
    matter, nor how old its snapshots are; one that lands in a folder closed long ago is not
    seen. A lake keeps to one of the two ways, as their bronze folders differ.
    """
    if on_corrupt not in ("quarantine", "fail"):
        raise ValueError(f"on_corrupt must be 'quarantine' or 'fail', not {on_corrupt!r}")
    ingested = partition_values(spark, layout.bronze, FOLDER)
    folders = folders_to_read(folder_names(spark, layout.landing), ingested, open_folders)
    if not folders:
        return {"rows": 0, "quarantined": 0}
    paths = [f"{layout.landing}/{name}" for name in folders]
    landed = read_landing(spark, paths, "text", keep_corrupt=True)
    if ingested:
        stored = read_table(spark, layout.bronze, T.StructType([*BRONZE.fields, T.StructField(FOLDER, T.StringType())]))
        landed = unread_files(landed, stored.filter(F.col(FOLDER).isin(folders)))
    rows = to_bronze(landed).withColumns(
        {
            FOLDER: folder_of(),
            "corrupt": F.col(CORRUPT).isNotNull().cast("int"),
            "ingestion_date": F.to_date("ingestion_time"),
        }
    )
    found = Observation("ingest")
    counted = rows.observe(found, F.count(F.lit(1)).alias("all"), F.coalesce(F.sum("corrupt"), F.lit(0)).alias("bad"))
    counted.write.mode("append").partitionBy(FOLDER, "corrupt", "ingestion_date").parquet(layout.bronze)
    counts = observed_counts(found, "all", "bad")
    if counts["bad"] and on_corrupt == "fail":
        raise ValueError(f"{counts['bad']} landing file(s) are no JSON; see corrupt=1 in {layout.bronze}")
    return {"rows": counts["all"] - counts["bad"], "quarantined": counts["bad"]}


def read_bronze(spark: SparkSession, layout: Layout, corrupt: bool = False) -> DataFrame:
    """Ingested snapshots, or with ``corrupt`` the quarantined files; the partition of the
    other kind is not opened."""
    bronze = read_table(spark, layout.bronze, BRONZE)
    return bronze.filter(F.col("corrupt") == int(corrupt)).drop("corrupt")


def refresh_silver(
    spark: SparkSession,
    layout: Layout,
    late: str = "drop",
    lookback_days: int = 1,
    allow_empty_symbol: bool = True,
) -> dict[str, int]:
    """Append clean observations newer than silver, or late but unknown ones.

    Returns ``rows_in`` and ``rows_dropped`` of the gate, and ``rows_written``.
    """
    if late not in ("drop", "admit"):
        raise ValueError(f"late must be 'drop' or 'admit', not {late!r}")
    lookback = 0 if late == "drop" else lookback_days
    bronze = read_bronze(spark, layout)
    stored = read_table_or_none(spark, layout.silver, OBSERVATION)
    # A bronze row is a whole snapshot: the time bound prunes before the explode.
    new = newer_than(
        bronze, stored, "ingestion_time", lookback_days=lookback, date="ingestion_date"
    )
    if new.isEmpty():
        return {"rows_in": 0, "rows_dropped": 0, "rows_written": 0}
    gate, written = Observation("gate"), Observation("silver")
    clean = to_silver(new, gate, allow_empty_symbol)
    if late == "admit":
        clean = not_stored(clean, stored, lookback_days)
    counted = clean.observe(written, F.count(F.lit(1)).alias("rows_written"))
    # A first load shuffles all of bronze; later ones only what is new.
    with sized_shuffles(spark, layout.bronze) if stored is None else nullcontext():
        append_silver(counted, layout.silver)
    return {
        **observed_counts(gate, "rows_in", "rows_dropped"),
        **observed_counts(written, "rows_written"),
    }


def check_silver(spark: SparkSession, layout: Layout) -> dict:
    """Append a quality report for silver, and raise if silver failed it."""
    report = stage(quality_report(read_table(spark, layout.silver, OBSERVATION), "silver"), "report")
    write_report(report, layout.quality)
    return enforce_quality(report)


def refresh_gold(spark: SparkSession, layout: Layout) -> list[str]:
    """Overwrite every KPI table; any failure is raised. Returns the table names."""
    with sized_shuffles(spark, layout.silver):
        silver = read_table(spark, layout.silver, OBSERVATION)
        overwrite_parquet(indicators(silver), layout.gold("indicators"))
        shared = read_table(spark, layout.gold("indicators"))
        kpis = all_kpis(silver, shared)
        for name, table in kpis.items():
            overwrite_parquet(table, layout.gold(name))
    return ["indicators", *kpis]


def gold_tables(spark: SparkSession, layout: Layout, names: tuple[str, ...]) -> dict[str, DataFrame]:
    """Written KPI tables by name, for serving."""
    return {name: read_table(spark, layout.gold(name)) for name in names}


def run(
    spark: SparkSession, root: str, late: str = "drop", on_corrupt: str = "quarantine"
) -> dict:
    """All stages in order; the quality gate stands between silver and gold."""
    layout = Layout(root)
    bronze = refresh_bronze(spark, layout, on_corrupt)
    silver_rows = refresh_silver(spark, layout, late)
    quality = check_silver(spark, layout)
    return {
        "bronze_rows": bronze["rows"],
        "quarantined": bronze["quarantined"],
        "silver": silver_rows,
        "quality": quality,
        "gold": refresh_gold(spark, layout),
    }
