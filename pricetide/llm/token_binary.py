"""Token ids in 64-bit words: a word's first four bits say how many ids it holds.

Blocks of 1,024 ids are coded on their own, and their first words' places are stored, so
that any block can be read without those before it and all words are unpacked at once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricetide.llm.encoding import encoder, tokenizer_path
from pricetide.llm.text import slices, strings
from pricetide.session import scratch_path

# Ids and bits for each selector. Selector 0 is the escape: its word holds a place in the
# list of ids that need more than 60 bits. Selector 1 is a run of zeros.
COUNTS = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([60, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
BLOCK = 1024
WIDTHS = np.frexp(np.arange(1 << 16))[1].astype(np.uint8)
# How the widest of so many ids comes from two stretches of half as many or more.
HALVES = tuple((n, max(k for k in (1, *COUNTS.tolist()) if n / 2 <= k < n)) for n in sorted({*COUNTS.tolist()} - {1}))
PAYLOAD = np.uint64((1 << 60) - 1)

FILE_SCHEMA = (
    "shard int, first_id long, doc_ids array<long>, lengths array<int>, offsets binary, "
    "words binary, escapes binary"
)
# Ids gathered into one row of the file before it is written; documents are never cut.
ROW_IDS = 1 << 17


def bit_width(ids: np.ndarray) -> np.ndarray:
    """Bits of each id, by a table for those of up to 16."""
    if len(ids) and ids.max() < len(WIDTHS):
        return WIDTHS[ids.astype(np.int64)]
    bits = np.zeros(len(ids), np.uint8)
    rest = ids.copy()
    while rest.any():
        bits[rest > 0] += 1
        rest >>= np.uint64(1)
    return bits


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, the place of each block's first word, and the escaped ids."""
    ids = np.asarray(ids, np.uint64)
    n = len(ids)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.uint32), np.empty(0, np.uint64)
    at = np.arange(n)
    left = np.minimum(BLOCK - at % BLOCK, n - at)  # ids to the end of the block
    # The widest of so many ids from each on. Blocks are rows, with nothing behind their end.
    rows = -(-n // BLOCK)
    width = np.zeros(rows * BLOCK, np.uint8)
    width[:n] = bit_width(ids)
    widest = {1: np.pad(width.reshape(rows, BLOCK), ((0, 0), (0, int(COUNTS.max()))))}
    for count, half in HALVES:
        part, moved = widest[half], widest[half][:, count - half :]
        widest[count] = part.copy()
        np.maximum(part[:, : moved.shape[1]], moved, out=widest[count][:, : moved.shape[1]])
    selector = np.zeros((rows, BLOCK), np.int8)
    for s in range(15, 0, -1):
        selector[widest[int(COUNTS[s])][:, :BLOCK] <= BITS[s]] = s
    selector = selector.ravel()[:n]
    steps = np.minimum(COUNTS[selector], left).tolist()
    starts, i = [], 0
    while i < n:
        starts.append(i)
        i += steps[i]
    starts = np.array(starts)
    chosen = selector[starts]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for s in np.unique(chosen):
        here = np.flatnonzero(chosen == s)
        if s == 0:
            words[here] |= np.arange(len(here), dtype=np.uint64)
            continue
        if s == 1:
            continue
        offset = np.arange(COUNTS[s])
        place = starts[here][:, None] + offset
        inside = offset < left[starts[here]][:, None]
        values = np.where(inside, ids[np.minimum(place, n - 1)], np.uint64(0))
        shifted = values << (offset * BITS[s]).astype(np.uint64)
        words[here] |= np.bitwise_or.reduce(shifted, axis=1)
    offsets = np.searchsorted(starts, np.arange(0, n, BLOCK)).astype(np.uint32)
    return words, offsets, ids[starts[chosen == 0]]


def unpack(words: np.ndarray, offsets: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ids of :func:`pack`."""
    out = np.zeros(n, np.uint64)
    if not n:
        return out
    selector = (words >> np.uint64(60)).astype(np.int64)
    payload = words & PAYLOAD
    counts = COUNTS[selector]
    before = np.cumsum(counts) - counts
    block = np.searchsorted(offsets, np.arange(len(words)), side="right") - 1
    place = before - before[offsets][block] + block * BLOCK
    stop = np.minimum((block + 1) * BLOCK, n)
    for s in np.unique(selector):
        here = np.flatnonzero(selector == s)
        if s == 0:
            out[place[here]] = escapes[payload[here].astype(np.int64)]
            continue
        if s == 1:
            continue
        offset = np.arange(COUNTS[s])
        to = place[here][:, None] + offset
        mask = np.uint64((1 << int(BITS[s])) - 1)
        values = (payload[here][:, None] >> (offset * BITS[s]).astype(np.uint64)) & mask
        inside = to < stop[here][:, None]
        out[to[inside]] = values[inside]
    return out


def unpack_block(words: np.ndarray, offsets: np.ndarray, escapes: np.ndarray, block: int) -> np.ndarray:
    """One block's ids alone; the last block comes with its padding of zeros."""
    end = offsets[block + 1] if block + 1 < len(offsets) else len(words)
    first = np.array([0], np.uint32)
    return unpack(words[offsets[block] : end], first, escapes, BLOCK)


def write_token_file(
    df: DataFrame,
    folder: str,
    end_id: int = 1,
    path: str | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
) -> None:
    """Encode every text, add ``end_id``, and write the ids in ascending ``doc_id`` order.

    The folder holds Parquet rows of about 131,072 ids: the documents' ids and lengths,
    the packed words, their block offsets and escapes, and where the row begins in its
    shard. Shard numbers ascend with ``doc_id``. Rows of one ``doc_id`` are ordered by
    text; null ids come first; a null or empty text has the end id alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path or tokenizer_path("word_bpe_49k.json")).encode
        end = np.array([end_id], np.uint32)
        first, shard, docs, parts, size = 0, 0, [], [], 0

        def row() -> pa.RecordBatch:
            ids = np.concatenate(parts)
            words, offsets, escapes = pack(ids)
            lengths = [len(p) + 1 for p in parts[::2]]
            values = [shard, first, docs, lengths, *(x.tobytes() for x in (offsets, words, escapes))]
            kinds = [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32())]
            kinds += [pa.binary()] * 3
            names = [field.split()[0] for field in FILE_SCHEMA.split(", ")]
            columns = [pa.array([v], k) for v, k in zip(values, kinds, strict=True)]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in slices(batches):
            shard = batch.column(0)[0].as_py()
            for doc, value in zip(batch.column(1).to_pylist(), strings(batch.column(2)), strict=True):
                ids = encode(value)
                docs.append(doc)
                parts += [ids, end]
                size += len(ids) + 1
                if size >= ROW_IDS:
                    yield row()
                    first += size
                    docs, parts, size = [], [], 0
        if docs:
            yield row()

    ordered = (
        df.select(df[doc_id].cast("long").alias("doc_id"), df[text].alias("text"))
        .repartitionByRange("doc_id", F.xxhash64("text"))
        .sortWithinPartitions("doc_id", "text")
    )
    numbered = ordered.select(F.spark_partition_id().alias("shard"), "doc_id", "text")
    numbered.mapInArrow(run, FILE_SCHEMA).write.mode("overwrite").parquet(folder)


def read_token_file(spark: SparkSession, folder: str, keep_ids: bool = False) -> DataFrame:
    """Documents of a token file: ``doc_id``, ``start`` (ids of all documents before it),
    ``n_tokens``, ``ids_crc32`` (of the ids as little-endian 32-bit integers), and with
    ``keep_ids`` the ids as such bytes."""
    schema = "doc_id long, shard int, at long, n_tokens long, ids_crc32 long"
    schema += ", ids binary" if keep_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            shard, first, docs, lengths, offsets, words, escapes = (c[0].as_py() for c in batch.columns)
            words, escapes = (np.frombuffer(x, np.uint64) for x in (words, escapes))
            lengths = np.array(lengths)
            ids = unpack(words, np.frombuffer(offsets, np.uint32), escapes, int(lengths.sum()))
            raw, stops = memoryview(ids.astype("<u4")), np.cumsum(lengths)
            starts = stops - lengths
            own = [raw[a:b] for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
            out = [
                pa.array(docs, pa.int64()),
                pa.array([shard] * len(docs), pa.int32()),
                pa.array(first + starts, pa.int64()),
                pa.array(lengths, pa.int64()),
                pa.array([zlib.crc32(x) for x in own], pa.int64()),
            ]
            if keep_ids:
                out.append(pa.array([x.tobytes() for x in own], pa.binary()))
            names = [field.split()[0] for field in schema.split(", ")]
            yield pa.RecordBatch.from_arrays(out, names=names)

    rows = spark.read.schema(FILE_SCHEMA).parquet(folder)
    # One row per shard, so few that one task can add them up.
    ids = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, b: a + b)
    totals = rows.groupBy("shard").agg(F.sum(ids).alias("ids"))
    before = F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    bases = totals.select("shard", F.coalesce(before, F.lit(0)).alias("base"))
    docs = rows.mapInArrow(run, schema).join(bases, "shard")
    kept = ["ids"] if keep_ids else []
    return docs.select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *kept)


def token_round_trip(df: DataFrame, **options) -> DataFrame:
    """Write a token file to the shared scratch folder and read its documents back."""
    folder = scratch_path(df.sparkSession, "token-file")
    write_token_file(df, folder, **options)
    return read_token_file(df.sparkSession, folder)
