"""Lines found in many documents, dropped from all but one."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from pricetide.llm.encoding import long_array
from pricetide.llm.text import ASCII_SPACE, map_arrow, utf8
from pricetide.session import stage


def line_hashes(text: bytes, min_chars: int) -> list[bytes | None]:
    """A 128-bit hash of each line's key; None for keys that are too short."""
    out: list[bytes | None] = []
    for line in text.split(b"\n"):
        key = line.strip(ASCII_SPACE).lower()
        long = len(key) >= min_chars and (key.isascii() or len(key.decode()) >= min_chars)
        out.append(xxhash.xxh3_128_digest(key) if long else None)
    return out


def line_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """One row for each document and distinct key in it: ``doc_id``, ``high``, ``low``."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, hashes = [], []
        for doc, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
            found = set(line_hashes(text, min_chars))
            found.discard(None)
            ids += [doc] * len(found)
            hashes += found
        halves = np.frombuffer(b"".join(hashes), ">i8").reshape(-1, 2).astype(np.int64)
        columns = [long_array(ids), pa.array(halves[:, 0]), pa.array(halves[:, 1])]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "high", "low"])

    return map_arrow(docs, rows, "doc_id long, high long, low long")


def dedup_lines(
    df: DataFrame,
    min_chars: int = 20,
    min_docs: int = 3,
    doc_id: str = "doc_id",
    text: str = "text",
    columns: tuple[str, ...] = (),
) -> DataFrame:
    """Drop lines whose key is in ``min_docs`` documents or more, but for the largest one.

    A text is split at ``\\n``; a line's key is the line without the characters
    ``[\\x20\\x09-\\x0D]`` at its ends and with A-Z in lower case. Keys of fewer than
    ``min_chars`` code points are left alone. Returns ``doc_id``, ``text`` (the lines that
    stay, joined by ``\\n``), ``n_lines`` (before), ``n_dropped`` and ``kept_sha256``.

    A null or empty text is one empty line. Rows of one ``doc_id`` count as one document
    and each keeps or loses its own lines. Rows with a null id are left as they are and
    count for nothing. Other columns are not read, but those named in ``columns`` come out
    before the rest.
    """
    # Only names made here, so that carried columns can have any.
    carried = [df[c].alias(f"_c{i}") for i, c in enumerate(columns)]
    docs = df.select(df[doc_id].cast("long").alias("doc_id"), df[text].alias("text"), *carried)
    with_id = docs.select("doc_id", "text").filter("doc_id IS NOT NULL")
    keys = stage(line_keys(with_id, min_chars), "line-keys")
    # Grouping by document first splits the rows of a frequent line, and then its count
    # is summed from few partial ones. Written first, small tables are broadcast by their
    # size, and of larger ones AQE can split the rows of a frequent line in the join.
    frequent = (
        keys.groupBy("high", "low", "doc_id")
        .agg(F.lit(1).alias("one"))
        .groupBy("high", "low")
        .agg(F.count("one").alias("n"), F.max("doc_id").alias("keeper"))
        .filter(F.col("n") >= min_docs)
        .select("high", "low", "keeper")
    )
    drops = (
        keys.join(stage(frequent, "frequent-lines"), ["high", "low"])
        .filter("doc_id != keeper")
        .groupBy("doc_id")
        .agg(F.collect_set(F.struct("high", "low")).alias("drops"))
    )

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, drops = utf8(batch.column(1)), batch.column(2)
        kept, lines, dropped = [], [], []
        for at, value in enumerate(texts):
            parts = value.split(b"\n")
            gone: set[bytes] = set()
            if drops[at].is_valid:
                pairs = [(d["high"], d["low"]) for d in drops[at].as_py()]
                gone = {x.tobytes() for x in np.array(pairs, np.int64).astype(">i8")}
                hashes = line_hashes(value, min_chars)
                parts = [p for p, h in zip(parts, hashes, strict=True) if h not in gone]
                lines.append(len(hashes))
            else:
                lines.append(len(parts))
            dropped.append(lines[-1] - len(parts))
            kept.append(b"\n".join(parts))
        out = [
            *batch.columns[3:],
            batch.column(0),
            pa.array(kept, pa.binary()).cast(pa.string()),
            long_array(lines),
            long_array(dropped),
            pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
        ]
        return pa.RecordBatch.from_arrays(out, schema=to_arrow_schema(schema))

    new = "doc_id long, text string, n_lines long, n_dropped long, kept_sha256 string"
    schema = StructType([*df.select(*columns).schema.fields, *StructType.fromDDL(new).fields])
    joined = docs.join(drops, "doc_id", "left")
    names = [f"_c{i}" for i in range(len(columns))]
    return map_arrow(joined.select("doc_id", "text", "drops", *names), rows, schema)
