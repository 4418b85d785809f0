"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed into dictionary phrases: each is the shortest one not seen before. The
phrase set says what a compressor would learn from the text; its minimum hashes are the
fingerprint, and the share of equal ones estimates how much two texts' phrases overlap.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide.llm.text import slices

HASHES = 128  # a power of two
SHIFT = np.uint64(64 - HASHES.bit_length() + 1)
EDGES = np.arange(HASHES, dtype=np.uint64) << SHIFT
ODD = np.uint64(0x9E3779B97F4A7C15)
# Ranges of ids that rows are dealt by.
MAX_BUCKETS = 10_000
# Stands for a null id; it comes last.
NO_ID = -(1 << 63)


def parse(text: str, phrases: set[str], open_phrase: str = "") -> str:
    """Add the phrases of ``text`` to the set; returns the phrase that is not complete.

    Parsing can go on with more text from that phrase.
    """
    phrase = open_phrase
    for char in text:
        phrase += char
        if phrase not in phrases:
            phrases.add(phrase)
            phrase = ""
    return phrase


def phrase_hashes(phrases: set[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, phrases), np.uint64, len(phrases))


def minima(hashes: np.ndarray) -> np.ndarray:
    """The smallest hash in each of ``HASHES`` equal ranges, cut to 16 bits.

    A range without any takes the next one's, changed by how far away that is, so that
    two texts agree there only if they are alike in the same way.
    """
    if not len(hashes):
        return np.full(HASHES, 0xFFFF, ">u2")
    ordered = np.sort(hashes)
    place = np.searchsorted(ordered, EDGES)
    smallest = ordered[np.minimum(place, len(ordered) - 1)]
    full = np.append(place[1:], len(ordered)) > place
    at = np.flatnonzero(full)
    following = at[np.searchsorted(at, np.arange(HASHES)) % len(at)]
    away = ((following - np.arange(HASHES)) % HASHES).astype(np.uint64)
    # Multiplied, so that the bits kept depend on all of the value.
    return ((((smallest[following] << np.uint64(8)) + away) * ODD) >> np.uint64(48)).astype(">u2")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


class Parsed:
    """The fingerprint of a text, and the state of its parse in the middle."""

    def __init__(self, text: str) -> None:
        self.half = len(text) - len(text) // 2
        self.text = text
        phrases: set[str] = set()
        self.open = parse(text[: self.half], phrases)
        self.first = set(phrases)
        self.first_hashes = phrase_hashes(self.first)
        self.marks = self._finish(text[self.half :], phrases)

    def _finish(self, rest: str, phrases: set[str]) -> np.ndarray:
        last = parse(rest, phrases, self.open)
        new = phrases - self.first
        if last:
            new.add(last)
        return minima(np.concatenate((self.first_hashes, phrase_hashes(new))))

    def edited(self, following: str) -> tuple[str, np.ndarray]:
        """The text with its second half replaced, and that text's fingerprint."""
        rest = following[: len(self.text) - self.half]
        return self.text[: self.half] + rest, self._finish(rest, set(self.first))


def fingerprint(text: str) -> str:
    """The fingerprint of one text, in hexadecimal digits."""
    return Parsed(text).marks.tobytes().hex()


def range_of(number: Column, cuts: list[int]) -> Column:
    """How many of the ascending cuts are not above the number, by binary search."""
    above = F.lit(cuts).cast("array<long>")
    steps = [F.lit(1 << bit) for bit in reversed(range(len(cuts).bit_length()))]

    def advance(found: Column, step: Column) -> Column:
        # Beyond the last cut there is NULL, which is no reason to go on.
        return F.when(F.get(above, found + step - 1) <= number, found + step).otherwise(found)

    return F.aggregate(F.array(*steps), F.lit(0), advance) if cuts else F.lit(0)


OUT_SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double"
)


def fingerprint_documents(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", rows_per_bucket: int = 1024
) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness.

    The edited text has the last ``floor(n_chars / 2)`` characters replaced by the first
    as many (or all) of the next document's, in descending ``doc_id`` order; after the
    last document comes the first. Returns ``doc_id``, ``n_chars``, ``edited_sha256``,
    ``fingerprint``, ``edited_fingerprint``, ``near_edited`` and ``near_next`` (the
    likeness to the next document's fingerprint).

    A null text is empty. An empty text has no phrases, and is alike only to another.
    Rows of one ``doc_id`` follow each other in the order of their texts; rows with a null
    id come last. A single row is its own next one. Other columns are not read.

    Rows are dealt by ranges of ids, so each text is shuffled once. The row after a range
    is sent to it as well.
    """
    docs = df.select(
        F.coalesce(df[doc_id].cast("long"), F.lit(NO_ID)).alias("id"), df[text].alias("text")
    )
    # Ranges from quantiles of the ids alone; where they lie changes no result.
    rows = docs.count()
    buckets = max(1, min(MAX_BUCKETS, -(-rows // rows_per_bucket)))
    shares = [i / buckets for i in range(1, buckets)]
    cuts = docs.agg(F.percentile_approx("id", shares, 10 * buckets)).first()[0] if shares else None
    keyed = docs.withColumn("bucket", range_of(F.col("id"), sorted(set(cuts or ()))))
    # The first row of each range also goes to the next higher range that has rows, and
    # that of the highest to the lowest. There are no more ranges than MAX_BUCKETS.
    tops = sorted(map(tuple, keyed.groupBy("bucket").agg(F.max("id")).collect()))
    top, also = [None] * buckets, [None] * buckets
    for at, (bucket, highest) in enumerate(tops):
        top[bucket], also[bucket] = highest, tops[(at + 1) % len(tops)][0]

    def of_range(values: list[int | None], kind: str) -> Column:
        return F.get(F.lit(values).cast(f"array<{kind}>"), F.col("bucket"))

    own = F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("after"))
    following = F.struct(of_range(also, "int").alias("bucket"), F.lit(1).alias("after"))
    to = F.when(F.col("id") == of_range(top, "long"), F.array(own, following)).otherwise(F.array(own))
    dealt = (
        keyed.select("id", "text", F.explode(to).alias("to"))
        .select("to.bucket", "to.after", "id", "text")
        .repartition("bucket")
        .sortWithinPartitions("bucket", "after", F.desc("id"), "text")
    )
    out = dealt.mapInArrow(_fingerprints, OUT_SCHEMA)
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket; each is finished when the next of its bucket is known."""
    names = [part.split()[0] for part in OUT_SCHEMA.split(", ")]
    held: tuple | None = None  # bucket, id, parsed text
    closed: int | None = None  # the bucket whose following row has come
    for batch in slices(batches):
        out: list[list] = [[] for _ in names]
        for b, after, doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if b == closed:
                continue
            if held is None or held[0] != b:
                held = None
            parsed = Parsed(text or "") if not (after and held is None) else None
            if held is not None:
                _, own_id, own = held
                edited, marks = own.edited(parsed.text)
                row = (
                    own_id,
                    len(own.text),
                    hashlib.sha256(edited.encode()).hexdigest(),
                    own.marks.tobytes().hex(),
                    marks.tobytes().hex(),
                    likeness(own.marks, marks),
                    likeness(own.marks, parsed.marks),
                )
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            if after:
                closed, held = b, None
            else:
                held = (b, doc, parsed)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        columns = [pa.array(c, k) for c, k in zip(out, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(columns, names=names)
