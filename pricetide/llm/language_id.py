"""Language identification by rank-order profiles of character n-grams.

A profile lists a language's most frequent n-grams by rank. A document's own list is
compared with each profile: every n-gram costs the distance between its two ranks, or the
most there is if the profile lacks it. The language with the smallest sum wins.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from pricetide.llm.text import map_arrow, strings
from pricetide.session import stage

PROFILE_SIZE = 300
MAX_GRAM = 3
# Documents per language that profiles are learnt from, at most.
TRAIN_DOCS = 2000
FOLDS = 5
# Bits of the hash that documents are drawn by; a double holds them exactly.
DRAW_BITS = 53
UNKNOWN = "und"

SPACE = 32


def is_held_out(doc_id) -> bool:
    """Whether crc32 of the id as text leaves no remainder modulo ``FOLDS``."""
    return zlib.crc32(str(doc_id).encode()) % FOLDS == 0


def codes(text: str) -> np.ndarray:
    """Lower-case letters and apostrophes as code points; all else is one space."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    return _letters(points)


def _letters(points: np.ndarray) -> np.ndarray:
    kinds, where = np.unique(points, return_inverse=True)
    letter = np.array([chr(p).isalpha() or p == 39 for p in kinds.tolist()], bool)
    out = np.where(letter[where], points, np.uint32(SPACE)) if len(points) else points
    out = np.concatenate(([SPACE], out, [SPACE])).astype(np.uint64)
    return out[(out != SPACE) | np.append(out[1:] != SPACE, True)]


def grams(text: str, most: int = MAX_GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of 1 to ``most`` characters as numbers, with their counts."""
    points = codes(text)
    keys, key = [], np.zeros(len(points), np.uint64)
    for n in range(1, min(most, len(points)) + 1):
        key = (key[: len(points) - n + 1] << np.uint64(21)) | points[n - 1 :]
        keys.append(key[key != SPACE])
    return np.unique(np.concatenate(keys), return_counts=True)


def ranked(keys: np.ndarray, counts: np.ndarray, size: int = PROFILE_SIZE) -> np.ndarray:
    """The most frequent n-grams in the order of their ranks; ties by n-gram."""
    if len(keys) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        kept = counts >= least
        keys, counts = keys[kept], counts[kept]
    return keys[np.lexsort((keys, -counts))][:size]


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


class Profiles:
    """Ranks of all profiles' n-grams, side by side."""

    def __init__(self, lists: dict[str, np.ndarray], size: int = PROFILE_SIZE) -> None:
        self.size = size
        self.languages = sorted(lists)
        self.keys = np.unique(np.concatenate([lists[k] for k in self.languages] or [[]]).astype(np.uint64))
        self.ranks = np.full((len(self.keys), len(self.languages)), -1, np.int32)
        for column, language in enumerate(self.languages):
            place = np.searchsorted(self.keys, lists[language])
            self.ranks[place, column] = np.arange(len(lists[language]))

    def distances(self, own: np.ndarray) -> np.ndarray:
        """Out-of-place distance of a ranked list to each language's profile."""
        place = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
        ranks = self.ranks[place]
        apart = np.abs(ranks - np.arange(len(own))[:, None])
        lacks = (ranks < 0) | (self.keys[place] != own)[:, None]
        return np.where(lacks, self.size, apart).sum(axis=0)

    def predict(self, text: str) -> tuple[str, float]:
        """The nearest language, and how much nearer it is than the next (0 to 1)."""
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        own = ranked(*grams(text), self.size)
        apart = self.distances(own) / (len(own) * self.size)
        best = int(np.argmin(apart))
        others = np.delete(apart, best)
        second = float(others.min()) if len(others) else 1.0
        return self.languages[best], (second - float(apart[best])) / second if second else 0.0


def learn_profiles(
    df: DataFrame, train_docs: int = TRAIN_DOCS, doc_id: str = "doc_id", text: str = "text", lang: str = "lang"
) -> Profiles:
    """Profiles of the languages of the documents that are not held out.

    Counts the n-grams of at most ``train_docs`` documents per language, those with the
    smallest hash of their id; nothing but the profiles' lists comes to the driver.
    """
    labelled = df.select(
        F.crc32(df[doc_id].cast("string").cast("binary")).alias("crc"),
        df[doc_id].cast("string").alias("id"),
        df[text].alias("text"),
        df[lang].alias("lang"),
    ).filter(
        (F.col("crc") % FOLDS != 0) & F.col("text").isNotNull() & F.col("lang").isNotNull()
    )
    # Thinning by the hash while reading leaves about twice as many documents as wanted, so
    # that few texts are shuffled; a language too rare for that keeps all its documents.
    # The sizes are a written table, whose own size decides whether it is broadcast.
    sizes = stage(labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "language-sizes")
    share = F.least(F.lit(1.0), F.lit(2.0 * train_docs) / F.col("n"))
    drawn = labelled.withColumn("order", F.shiftrightunsigned(F.xxhash64("id"), 64 - DRAW_BITS))
    thin = drawn.join(sizes, "lang").filter(F.col("order") < share * float(1 << DRAW_BITS))
    best = Window.partitionBy("lang").orderBy("order", "id")
    chosen = (
        thin.withColumn("place", F.row_number().over(best))
        .filter(F.col("place") <= train_docs)
    )

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs, keys, counts = [], [], []
        for language, value in zip(batch.column(0).to_pylist(), strings(batch.column(1)), strict=True):
            if has_letter(value):
                own, times = grams(value)
                langs += [language] * len(own)
                keys.append(own.view(np.int64))
                counts.append(times)
        flat = [np.concatenate(x) if x else np.empty(0, np.int64) for x in (keys, counts)]
        columns = [pa.array(langs, pa.string()), *(pa.array(x, pa.int64()) for x in flat)]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "gram", "n"])

    totals = (
        map_arrow(chosen.select("lang", "text"), count, "lang string, gram long, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    )
    first = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = totals.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= PROFILE_SIZE)
    lists: dict[str, list] = {}
    for row in top.collect():  # PROFILE_SIZE rows per language
        lists.setdefault(row["lang"], []).append((row["rank"], row["gram"]))
    return Profiles(
        {k: np.array([g for _, g in sorted(v)], np.int64).view(np.uint64) for k, v in lists.items()}
    )


def identify_languages(
    df: DataFrame,
    train: DataFrame | None = None,
    train_docs: int = TRAIN_DOCS,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    columns: tuple[str, ...] = (),
) -> DataFrame:
    """The language of every whole text, from profiles learnt from ``train``.

    ``train`` is ``df`` itself by default; of it, documents with a null text or language
    and held-out ones (crc32 of the id as text, modulo 5, is 0) are left out, and at most
    ``train_docs`` per language are read. Returns ``doc_id``, ``held_out``, ``lang_pred``
    and ``score`` (0 to 1, by how much the next language is farther away).

    A text that is null or has no letter is ``und`` with score 0, as is every text if
    nothing was learnt. Equal distances go to the first language by name. A null id is
    not held out. Repeated rows stay. Other columns are not read, but those named in
    ``columns`` come out before the rest.
    """
    profiles = df.sparkSession.sparkContext.broadcast(
        learn_profiles(df if train is None else train, train_docs, doc_id, text, lang)
    )

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column(0)
        found = [profiles.value.predict(t) for t in strings(batch.column(1))]
        out = [
            *(batch.column(at) for at in places),
            ids,
            pa.array([i is not None and is_held_out(i) for i in ids.to_pylist()], pa.bool_()),
            pa.array([f[0] for f in found], pa.string()),
            pa.array([f[1] for f in found], pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(out, schema=to_arrow_schema(schema))

    new = "doc_id long, held_out boolean, lang_pred string, score double"
    fields = df.select(*columns).schema.fields
    schema = StructType([*fields, *StructType.fromDDL(new).fields])
    # The text goes to Python once, even if it is carried as well.
    others = [c for c in columns if c != text]
    places = [1 if c == text else 2 + others.index(c) for c in columns]
    carried = [df[c].alias(f"_c{i}") for i, c in enumerate(others)]
    docs = df.select(df[doc_id].cast("long").alias("_id"), df[text].alias("_text"), *carried)
    return map_arrow(docs, rows, schema)
