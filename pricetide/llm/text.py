"""Helpers shared by the text operators: Arrow batches, words and shingles."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

SHINGLE_WORDS = 5
SIMILARITY_PERCENT = 80

# What strips from both ends of a line and parts words: [\x20\x09-\x0D].
ASCII_SPACE = b" \t\n\x0b\x0c\r"

# Rows per slice in which a batch is worked through, so that long texts of one slice fit.
SLICE_ROWS = 256


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches cut to at most ``rows`` rows each, without copying."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def strings(column: pa.Array) -> list[str]:
    """Texts of a string column; null is the empty text."""
    return [value or "" for value in column.to_pylist()]


def utf8(column: pa.Array) -> list[bytes]:
    """UTF-8 texts of a string column; null is the empty text."""
    return [value or b"" for value in column.cast(pa.binary()).to_pylist()]


def map_arrow(
    df: DataFrame, rows: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | StructType
) -> DataFrame:
    """``mapInArrow`` of a function from one slice of rows to one record batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield rows(part)

    return df.mapInArrow(run, schema)


class WordHashes(dict):
    """64-bit hashes of words, remembered; emptied when it holds ``limit`` words."""

    def __init__(self, limit: int = 300_000) -> None:
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def ascii_words(text: bytes) -> list[bytes]:
    """Words of ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased."""
    return text.lower().split()


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that sums of word hashes spread evenly."""
    x = values.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def shingles(text: bytes, hashes: WordHashes, size: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles of ``size`` words.

    A text of fewer words has one shingle, the whole sequence; without words it has none.
    """
    words = ascii_words(text)
    if not words:
        return np.empty(0, np.uint64)
    codes = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    take = min(size, len(words))
    # Horner's rule modulo 2^64 over the words of each window; its length sets it apart.
    total = np.full(len(words) - take + 1, take, np.uint64)
    for at in range(take):
        total = mixed(total) + codes[at : len(words) - take + 1 + at]
    return np.unique(mixed(total))
