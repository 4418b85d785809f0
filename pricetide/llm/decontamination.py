"""Benchmark items inside documents: MinHash containment search, verified exactly.

Items are partitioned by the number of their shingles, and each partition has its own
sketch size: the smallest hashes of an item, one more than may be missing from a document
that contains it. So a document that contains an item holds at least one hash of the
item's sketch, however long it is, and the search misses nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetide.llm.encoding import long_array
from pricetide.llm.text import SHINGLE_WORDS, SIMILARITY_PERCENT, WordHashes, map_arrow, shingles, utf8
from pricetide.session import stage

# Bits of the filter that documents' shingles pass before the search: a fixed 2 MB.
FILTER_BITS = 24
BITMAP_BITS = 32768  # of one of Spark's bitmaps


def sketch_size(n: int, percent: int) -> int:
    """Hashes of which a document with ``percent`` of ``n`` shingles holds at least one."""
    return n - -(-n * percent // 100) + 1 if n else 0


def item_shingles(items: DataFrame, size: int) -> DataFrame:
    """``item_id``, ``n_item`` and the ``shingles`` of every item with words."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes = WordHashes()
        sets = [shingles(t, hashes, size).view(np.int64) for t in utf8(batch.column(1))]
        columns = [batch.column(0), long_array([len(s) for s in sets])]
        columns.append(pa.array(sets, pa.list_(pa.int64())))
        return pa.RecordBatch.from_arrays(columns, names=["item_id", "n_item", "shingles"])

    return map_arrow(items, rows, "item_id long, n_item long, shingles array<long>").filter("n_item > 0")


def sketches(sets: DataFrame, percent: int) -> DataFrame:
    """The size partition and sketch hashes of every item, one row per hash."""
    needed = F.col("n_item") - F.ceil(F.col("n_item") * percent / 100).cast("long") + 1
    # The largest sketch that any size of the partition needs, and no more than all.
    partition = F.floor(F.log2("n_item")).cast("int")
    most = (F.pow(F.lit(2.0), partition + 1) * (100 - percent) / 100).cast("long") + 1
    size = F.least(F.greatest(needed, most), F.col("n_item")).cast("int")
    smallest = F.slice(F.array_sort("shingles"), F.lit(1), size)
    return sets.select("item_id", partition.alias("size_class"), F.explode(smallest).alias("hash"))


def hash_filter(hashes: DataFrame) -> np.ndarray:
    """A bitmap of ``FILTER_BITS`` bits of hashes: at most 512 rows of 4 kB."""
    bit = F.col("hash").bitwiseAND((1 << FILTER_BITS) - 1)
    parts = (
        hashes.select(F.floor(bit / BITMAP_BITS).cast("int").alias("part"), (bit % BITMAP_BITS).alias("bit"))
        .groupBy("part")
        .agg(F.bitmap_construct_agg("bit").alias("bits"))
        .collect()
    )
    out = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for row in parts:
        start = row["part"] * BITMAP_BITS // 8
        out[start : start + BITMAP_BITS // 8] = np.frombuffer(row["bits"], np.uint8)
    return out


def passes(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes have their bit set."""
    bit = hashes & np.uint64((1 << FILTER_BITS) - 1)
    return (bitmap[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 > 0


def find_items(
    df: DataFrame,
    items: DataFrame,
    percent: int = SIMILARITY_PERCENT,
    size: int = SHINGLE_WORDS,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """Documents that contain ``percent`` or more of an item's shingles of five words.

    Returns ``doc_id``, ``item_id``, ``n_item`` (distinct shingles of the item),
    ``n_shared`` (those in the document) and ``containment`` (their ratio), one row per
    pair. Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. A text of fewer words
    has one shingle, the whole sequence, which only equals another whole text; a null or
    empty text, or an item without words, contains and is contained in nothing. Repeated
    rows of a document or of an item give one row per pair (of the larger containment,
    if their texts differ); rows with a null id give none. Other columns are not read.
    """
    spark = df.sparkSession
    docs = df.select(df[doc_id].cast("long").alias("doc_id"), df[text].alias("text"))
    wanted = items.select(items[item_id].cast("long").alias("item_id"), items[item_text].alias("text"))
    # Rows of one item with different texts are told apart by a number of their own.
    sets = item_shingles(wanted.filter("item_id IS NOT NULL"), size)
    sets = stage(sets.distinct().withColumn("item_row", F.monotonically_increasing_id()), "item-shingles")
    index = stage(
        sketches(sets.select(F.col("item_row").alias("item_id"), "n_item", "shingles"), percent),
        "item-sketches",
    )
    bitmap = spark.sparkContext.broadcast(hash_filter(index))

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, bits, ids, found, sets = words(), bitmap.value, [], [], []
        for doc, value in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
            own = shingles(value, hashes, size)
            hits = own[passes(bits, own)]
            if len(hits):
                ids.append(doc)
                found.append(hits.view(np.int64))
                sets.append(own.tobytes())
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.binary()]
        columns = [pa.array(c, k) for c, k in zip((ids, found, sets), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "hits", "own"])

    near = map_arrow(docs.filter("doc_id IS NOT NULL"), rows, "doc_id long, hits array<long>, own binary")
    near = stage(near.withColumn("doc_row", F.monotonically_increasing_id()), "documents-with-hits")
    candidates = (
        near.select("doc_row", F.explode("hits").alias("hash"))
        .join(index.select("item_id", "hash"), "hash")
        .select("doc_row", F.col("item_id").alias("item_row"))
        .distinct()
    )

    def verify(batch: pa.RecordBatch) -> pa.RecordBatch:
        shared = []
        for own, item in zip(batch.column(2).to_pylist(), batch.column(4), strict=True):
            wanted = item.values.to_numpy().view(np.uint64)
            own = np.frombuffer(own, np.uint64)
            at = np.minimum(np.searchsorted(own, wanted), len(own) - 1)
            shared.append(int((own[at] == wanted).sum()))
        columns = [batch.column(0), batch.column(1), batch.column(3), long_array(shared)]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "n_item", "n_shared"])

    pairs = (
        candidates.join(near.select("doc_row", "doc_id", "own"), "doc_row")
        .join(sets, "item_row")
        .select("doc_id", "item_id", "own", "n_item", "shingles")
    )
    checked = map_arrow(pairs, verify, "doc_id long, item_id long, n_item long, n_shared long")
    best = F.max(F.struct((F.col("n_shared") / F.col("n_item")).alias("containment"), "n_shared", "n_item"))
    return (
        checked.filter(F.col("n_shared") * 100 >= F.col("n_item") * percent)
        .groupBy("doc_id", "item_id")
        .agg(best.alias("best"))
        .select("doc_id", "item_id", "best.n_item", "best.n_shared", "best.containment")
    )


_WORDS: list[WordHashes] = []


def words() -> WordHashes:
    """This worker's word hashes."""
    if not _WORDS:
        _WORDS.append(WordHashes())
    return _WORDS[0]
