"""A training corpus from ``documents``: five stages, each on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetide.llm.decontamination import find_items
from pricetide.llm.jaccard_join import jaccard_components
from pricetide.llm.language_id import UNKNOWN, identify_languages
from pricetide.llm.line_dedup import dedup_lines
from pricetide.llm.packing import pack_documents
from pricetide.session import bound_batches, stage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in some language; those without any letter go."""
    bound_batches(spark)
    renamed = docs.select(*(F.col(c).alias(f"in_{c}") for c in COLUMNS))
    found = identify_languages(
        renamed, doc_id="in_doc_id", text="in_text", lang="in_lang", columns=tuple(renamed.columns)
    )
    kept = found.filter(F.col("lang_pred") != UNKNOWN)
    return kept.select(*(F.col(f"in_{c}").alias(c) for c in COLUMNS))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts without lines that other documents have as well."""
    bound_batches(spark)
    out = dedup_lines(docs, columns=("lang", "source"))
    return out.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def numbered(df: DataFrame, label: str) -> DataFrame:
    """The rows with a number of their own, written, so that it stays the same. Ids may be
    null or repeated."""
    return stage(df.withColumn("row", F.monotonically_increasing_id()), label)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of similar documents, the one with the smallest id.

    Rows are compared whatever their ids: repeated rows are copies, of which one stays, and
    rows without an id come after all others.
    """
    bound_batches(spark)
    rows = numbered(docs.select(*COLUMNS), "numbered-documents")
    groups = jaccard_components(rows, doc_id="row")
    linked = stage(groups.filter("doc_id != component_id").select("doc_id", "component_id"), "linked")
    roots = linked.select(F.col("component_id").alias("doc_id"), "component_id").distinct()
    members = linked.union(roots).toDF("row", "group")
    ids = members.join(rows.select("row", "doc_id"), "row")
    first = F.min(F.struct(F.isnull("doc_id").alias("absent"), "doc_id", "row"))["row"]
    kept = stage(ids.groupBy("group").agg(first.alias("kept")), "kept")
    gone = members.join(kept, "group").filter("row != kept").select("row")
    return rows.join(stage(gone, "near-copies"), "row", "left_anti").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no item of the benchmark, whatever the ids of either."""
    bound_batches(spark)
    items = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet").select("text")
    rows = numbered(docs.select(*COLUMNS), "numbered-documents")
    leaks = find_items(rows, numbered(items, "numbered-items"), doc_id="row", item_id="row")
    return rows.join(stage(leaks.select("doc_id").distinct().toDF("row"), "leaks"), "row", "left_anti").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their place in a sequence."""
    bound_batches(spark)
    return pack_documents(docs)


STAGES = [
    ("language_id", keep_known_languages),
    ("line_dedup", drop_repeated_lines),
    ("jaccard_join", keep_one_of_each_group),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

# Tokens are beyond SQL; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each but the last is written to the shared scratch folder and reread."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
