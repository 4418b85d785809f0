"""Repeated passages, by suffix trees of groups that share a prefix.

A suffix's prefix ends where its anchor ends: the rarest-looking eight words among the
first ``window`` words, chosen by their hash. So prefixes vary in length, and suffixes that
agree on ``window`` words have the same prefix. Prefixes that occur once hold no repeat and
are dropped; the suffixes of the others go to one group for each anchor, and each group is
indexed by a suffix tree of its own. Internal nodes at least ``window`` words deep are its
repeats. Groups too large for a task get their longest prefix, the whole window, so that
they fall apart into one group for each repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pricetide.llm.decontamination import BITMAP_BITS
from pricetide.llm.encoding import long_array
from pricetide.llm.text import mixed, slices, utf8
from pricetide.session import stage

WINDOW = 20
ANCHOR_WORDS = 8
# A null doc_id in keys and in the order of documents: it comes last.
NO_ID = (1 << 63) - 1
# Bytes of text that are worked on at once, unless one text alone is longer.
SLICE_BYTES = 2 << 20
# Largest filter that is broadcast (in bits, so 16 MB), with 16 bits or more for each key.
# More keys than fit are joined instead.
FILTER_BITS = 1 << 27
BITS_PER_KEY = 16
# Different pieces of one anchor that one task indexes in one tree.
GROUP_PIECES = 512

PARTS = np.zeros(256, bool)
PARTS[[9, 10, 11, 12, 13, 32]] = True
BASE = 0x9E3779B97F4A7C15


class Powers:
    """Powers of an odd base and of its inverse modulo 2^64, as many as were needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def need(self, n: int) -> None:
        if n > len(self.up):
            size = 1 << n.bit_length()
            self.up, self.down = (_powers(b, size) for b in (BASE, pow(BASE, -1, 1 << 64)))


def _powers(base: int, size: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < size:
        out = np.concatenate((out, out * np.uint64(pow(base, len(out), 1 << 64))))
    return out


POWERS = Powers()


def word_codes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each word of ``[^\\x20\\x09-\\x0D]+`` starts and ends, and its 64-bit hash."""
    raw = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = ~PARTS[raw]
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    codes = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):  # in parts of SLICE_BYTES, so that little memory is used
        a = starts[first]
        last = max(first + 1, int(np.searchsorted(ends, a + SLICE_BYTES, side="right")))
        b = ends[last - 1]
        POWERS.need(int(b - a) + 1)
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum((raw[a:b].astype(np.uint64) + np.uint64(1)) * POWERS.up[: b - a], out=sums[1:])
        s, e = starts[first:last] - a, ends[first:last] - a
        codes[first:last] = mixed((sums[e] - sums[s]) * POWERS.down[s] + (e - s).astype(np.uint64))
        first = last
    return starts, ends, codes


class Pieces:
    """Runs of windows with the same anchor, in texts that are worked on together.

    ``first`` and ``last`` are the first words of a piece's first and last window, counted
    over all texts; ``key`` is the hash of the anchor.
    """

    def __init__(self, texts: list[bytes], window: int) -> None:
        self.data = b"\n".join(texts)
        self.starts, self.ends, codes = word_codes(self.data)
        edges = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.bounds = np.searchsorted(self.starts, edges)  # of each text's words
        size = min(ANCHOR_WORDS, window)
        self.window = window
        empty = np.empty(0, np.int64)
        self.first = self.last = self.doc = empty
        self.key = empty.view(np.int64)
        if len(codes) < window:
            return
        grams = np.zeros(len(codes) - size + 1, np.uint64)
        for at in range(size):
            grams = grams * np.uint64(BASE) + codes[at : len(codes) - size + 1 + at]
        grams = mixed(grams)
        # The least hash among the anchors inside each window, and the first of equal ones.
        inside = np.lib.stride_tricks.sliding_window_view(grams, window - size + 1)
        anchor = np.arange(len(inside)) + inside.argmin(axis=1)
        doc = np.repeat(np.arange(len(texts)), np.diff(self.bounds))
        whole = np.flatnonzero(doc[: len(inside)] == doc[window - 1 :])
        if not len(whole):
            return
        anchor = anchor[whole]
        new = np.flatnonzero((np.diff(anchor) != 0) | (np.diff(whole) != 1)) + 1
        at, to = np.append(0, new), np.append(new, len(whole)) - 1
        self.first, self.last = whole[at], whole[to]
        self.doc = doc[self.first]
        self.key = grams[anchor[at]].view(np.int64)

    def words(self, i: int) -> bytes:
        """The words of piece ``i``, joined by one space."""
        a, b = self.starts[self.first[i]], self.ends[self.last[i] + self.window - 1]
        return b" ".join(self.data[a:b].split())


def text_slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Batches of at most 256 rows and, but for single long texts, ``SLICE_BYTES``."""
    for batch in slices(batches):
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        start, total = 0, 0
        for at, size in enumerate(sizes.tolist()):
            if at > start and total + size > SLICE_BYTES:
                yield batch.slice(start, at - start)
                start, total = at, 0
            total += size
        yield batch.slice(start)


def anchor_counts(docs: DataFrame, window: int) -> DataFrame:
    """How often each anchor occurs: ``key`` and ``n``, added up for each slice of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 0):
            keys, n = np.unique(Pieces(utf8(batch.column(0)), window).key, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n.astype(np.int64))], names=["key", "n"])

    return docs.select("text").mapInArrow(run, "key long, n long")


def key_filter(keys: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of ``bits`` bits (a power of two) of the ``key`` column."""
    bit = F.col("key").bitwiseAND(bits - 1)
    parts = (
        keys.select(F.floor(bit / BITMAP_BITS).cast("int").alias("part"), (bit % BITMAP_BITS).alias("bit"))
        .groupBy("part")
        .agg(F.bitmap_construct_agg("bit").alias("bits"))
        .collect()
    )
    out = np.zeros(bits // 8, np.uint8)
    for row in parts:
        start = row["part"] * BITMAP_BITS // 8
        out[start : start + BITMAP_BITS // 8] = np.frombuffer(row["bits"], np.uint8)
    return out


NUMBERS = "key long, high long, low long, doc long, version long, start long, n long"


def _rows(pieces: Pieces, at: np.ndarray, batch: pa.RecordBatch, with_words: bool) -> pa.RecordBatch:
    """The pieces with the numbers ``at``; the batch begins with ``doc`` and ``version``."""
    words = [pieces.words(i) for i in at]
    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), ">i8").reshape(-1, 2)
    doc = pieces.doc[at]
    out = [pieces.key[at], *both.astype(np.int64).T]
    out += [batch.column(c).to_numpy(zero_copy_only=False)[doc] for c in (0, 1)]
    out += [pieces.first[at] - pieces.bounds[doc], pieces.last[at] - pieces.first[at] + 1]
    columns, names = [pa.array(x, pa.int64()) for x in out], [c.split()[0] for c in NUMBERS.split(", ")]
    if with_words:
        columns.append(pa.array(words, pa.binary()))
        names.append("words")
    return pa.RecordBatch.from_arrays(columns, names=names)


def _in_bitmap(bitmap: np.ndarray, bits: int, codes: np.ndarray) -> np.ndarray:
    bit = codes.view(np.uint64) & np.uint64(bits - 1)
    return (bitmap[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _in_lists(pieces: Pieces, values: np.ndarray, lists: list[list[int]]) -> np.ndarray:
    """Which of the pieces' values are in their document's list."""
    cuts = np.searchsorted(pieces.doc, np.arange(len(lists) + 1))
    found = [np.isin(values[a:b], own) for a, b, own in zip(cuts[:-1], cuts[1:], lists, strict=True)]
    return np.concatenate(found) if found else np.empty(0, bool)


def _bits_for(keys: DataFrame) -> int:
    return max(BITMAP_BITS, 1 << (keys.count() * BITS_PER_KEY).bit_length())


def repeated_pieces(docs: DataFrame, window: int, most_bits: int = FILTER_BITS) -> DataFrame:
    """Pieces whose anchor occurs twice or more, one row for each place they occur at.

    ``high`` and ``low`` are a hash of the piece's words, ``start`` is the number of words
    before it, and ``n`` that of its windows. A filter of the anchors lets a few others pass
    as well.
    """
    repeated = stage(
        anchor_counts(docs, window).groupBy("key").agg(F.sum("n").alias("n")).filter("n > 1").select("key"),
        "repeated-anchors",
    )
    bits = _bits_for(repeated)
    if bits <= most_bits:
        found = docs.select("doc", "version", "text")
        passing = found.sparkSession.sparkContext.broadcast(key_filter(repeated, bits))
    else:
        found, passing = docs.join(_keys_by_document(docs, repeated, window), ["doc", "version"]), None
        found = found.select("doc", "version", "text", "keys")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = None if passing is None else passing.value
        for batch in text_slices(batches, 2):
            pieces = Pieces(utf8(batch.column(2)), window)
            if bitmap is not None:
                good = _in_bitmap(bitmap, bits, pieces.key)
            else:
                good = _in_lists(pieces, pieces.key, batch.column(3).to_pylist())
            yield _rows(pieces, np.flatnonzero(good), batch, False)

    return found.mapInArrow(run, NUMBERS)


# Bits of a piece's place for a filter: the version is a hash, and the product fits 64 bits.
SPREAD = 2654435761


def pieces_with_words(docs: DataFrame, places: DataFrame, window: int, most_bits: int = FILTER_BITS) -> DataFrame:
    """The pieces at the ``places`` (``doc``, ``version``, ``start``), with their words, read
    from the texts once more. A filter lets a few others pass as well."""
    bits = _bits_for(places)
    if bits <= most_bits:
        found = docs.select("doc", "version", "text")
        code = F.col("version").bitwiseXOR(F.col("doc")).bitwiseXOR(F.col("start") * F.lit(SPREAD))
        passing = found.sparkSession.sparkContext.broadcast(key_filter(places.select(code.alias("key")), bits))
    else:
        starts = places.groupBy("doc", "version").agg(F.collect_set("start").alias("starts"))
        found, passing = docs.join(starts, ["doc", "version"]).select("doc", "version", "text", "starts"), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = None if passing is None else passing.value
        for batch in text_slices(batches, 2):
            pieces = Pieces(utf8(batch.column(2)), window)
            start = pieces.first - pieces.bounds[pieces.doc]
            if bitmap is not None:
                doc, version = (batch.column(c).to_numpy(zero_copy_only=False)[pieces.doc] for c in (0, 1))
                good = _in_bitmap(bitmap, bits, (version ^ doc) ^ (start * SPREAD))
            else:
                good = _in_lists(pieces, start, batch.column(3).to_pylist())
            yield _rows(pieces, np.flatnonzero(good), batch, True)

    return found.mapInArrow(run, f"{NUMBERS}, words binary")


def _keys_by_document(docs: DataFrame, repeated: DataFrame, window: int) -> DataFrame:
    """The repeated anchors of each document, found by a join: ``doc``, ``version``, ``keys``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 2):
            pieces = Pieces(utf8(batch.column(2)), window)
            columns = [pa.array(pieces.key)]
            columns += [batch.column(c).take(pa.array(pieces.doc)) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "doc", "version"])

    rows = docs.select("doc", "version", "text").mapInArrow(run, "key long, doc long, version long")
    kept = rows.join(repeated, "key")
    return kept.groupBy("doc", "version").agg(F.collect_set("key").alias("keys"))


class SuffixTree:
    """Suffixes of sequences of words, in a tree whose edges are stretches of sequences."""

    def __init__(self) -> None:
        # Of each node: the sequence and stretch of the edge that leads to it, its depth in
        # words, its children by first word, and the suffixes that end at it.
        self.edge: list[tuple[list, int, int]] = [([], 0, 0)]
        self.depth = [0]
        self.children: list[dict] = [{}]
        self.ending: list[list] = [[]]

    def _node(self, edge: tuple[list, int, int], depth: int) -> int:
        self.edge.append(edge)
        self.depth.append(depth)
        self.children.append({})
        self.ending.append([])
        return len(self.edge) - 1

    def add(self, words: list, start: int, suffix: object) -> None:
        """Add the suffix of ``words`` that begins at ``start``."""
        node, at, stop = 0, start, len(words)
        while at < stop:
            child = self.children[node].get(words[at])
            if child is None:
                child = self._node((words, at, stop), self.depth[node] + stop - at)
                self.children[node][words[at]] = child
                node = child
                break
            source, a, b = self.edge[child]
            n = min(b - a, stop - at)
            if source[a : a + n] != words[at : at + n]:
                same = 1
                while source[a + same] == words[at + same]:
                    same += 1
                n = same
            if n < b - a:  # the edge parts in its middle
                middle = self._node((source, a, a + n), self.depth[node] + n)
                self.children[node][words[at]] = middle
                self.children[middle][source[a + n]] = child
                self.edge[child] = (source, a + n, b)
                child = middle
            node, at = child, at + n
        self.ending[node].append(suffix)

    def deep(self, least: int) -> Iterator[list]:
        """Suffixes below each highest node of ``least`` words or more, if two or more."""
        stack = [0]
        while stack:
            node = stack.pop()
            if self.depth[node] < least:
                stack.extend(self.children[node].values())
                continue
            found, below = [], [node]
            while below:
                at = below.pop()
                found += self.ending[at]
                below.extend(self.children[at].values())
            if len(found) > 1:
                yield found


def later_windows(pieces: list[tuple[bytes, tuple]], window: int) -> list[bytearray]:
    """For each piece (words, first place), which windows also begin at an earlier place."""
    tree, codes = SuffixTree(), {}
    marks = []
    for at, (words, _) in enumerate(pieces):
        numbers = [codes.setdefault(w, len(codes)) for w in words.split(b" ")]
        n = len(numbers) - window + 1
        marks.append(bytearray(n))
        for offset in range(n):
            tree.add(numbers, offset, (at, offset))
    for found in tree.deep(window):
        places = [((*pieces[at][1][:2], pieces[at][1][2] + offset), at, offset) for at, offset in found]
        least = min(places)[0]
        for place, at, offset in places:
            if place > least:
                marks[at][offset] = 1
    return marks


def _grouped_marks(pieces: DataFrame, window: int) -> DataFrame:
    """Marks of pieces by one suffix tree for each anchor: ``high``, ``low``, ``marks``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def finished() -> pa.RecordBatch:
            found = later_windows([(words, place) for _, _, words, place in held], window)
            rows = [(h, low, bytes(m)) for (h, low, _, _), m in zip(held, found, strict=True) if any(m)]
            high, low, marks = zip(*rows, strict=True) if rows else ((), (), ())
            columns = [long_array(high), long_array(low), pa.array(marks, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["high", "low", "marks"])

        for batch in slices(batches, 4096):
            for k, high, low, doc, version, start, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != key:
                    if len(held) > 1:
                        yield finished()
                    key, held = k, []
                held.append((high, low, words, (doc, version, start)))
        if len(held) > 1:
            yield finished()

    dealt = pieces.select("key", "high", "low", "doc", "version", "start", "words")
    dealt = dealt.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "high long, low long, marks binary")


def _split_marks(pieces: DataFrame, window: int) -> DataFrame:
    """The same marks for anchors with too many pieces: each window is a prefix of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            rows: list[tuple] = []
            for high, low, doc, version, start, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts = words.split(b" ")
                n = len(parts) - window + 1
                for at in range(n):
                    digest = xxhash.xxh3_128_digest(b" ".join(parts[at : at + window]))
                    rows.append((digest, high, low, doc, version, start + at, at, n))
            prefix, *numbers = zip(*rows, strict=True) if rows else [()] * 8
            columns = [pa.array(prefix, pa.binary()), *map(long_array, numbers)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "prefix binary, high long, low long, doc long, version long, place long, at long, n long"
    names = [c.split()[0] for c in schema.split(", ")]
    rows = pieces.select("high", "low", "doc", "version", "start", "words").mapInArrow(run, schema)
    windows = stage(rows, "windows")
    place = F.struct("doc", "version", "place")
    least = windows.groupBy("prefix").agg(F.min(place).alias("least"), F.count(F.lit(1)).alias("found"))
    least = stage(least.filter("found > 1").drop("found"), "least-windows")
    later = windows.join(least, "prefix").filter(place > F.col("least"))
    at = F.collect_set("at").alias("found")
    marks = later.groupBy("high", "low").agg(at, F.max("n").alias("n"))
    flags = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.array_contains("found", i))
    digits = F.array_join(F.transform(flags, lambda x: F.when(x, "01").otherwise("00")), "")
    return marks.select("high", "low", F.unhex(digits).alias("marks"))


def _place() -> Column:
    return F.struct("doc", "version", "start")


def repeated_spans(
    docs: DataFrame, window: int = WINDOW, group_pieces: int = GROUP_PIECES, most_bits: int = FILTER_BITS
) -> DataFrame:
    """Windows of each document that also begin at an earlier place.

    ``docs`` has ``doc``, ``version`` and ``text``. Returns ``doc``, ``version``, ``start``
    (words before the piece), ``n`` (its windows) and ``marks`` (a byte for each window, 1
    for a repeated one; null: all are).
    """
    pieces = stage(repeated_pieces(docs, window, most_bits), "pieces")
    # Copies of a piece collapse before the shuffle; only the first one can stay.
    classes = pieces.groupBy("key", "high", "low").agg(F.min(_place()).alias("first"), F.count(F.lit(1)).alias("found"))
    classes = stage(classes, "piece-classes")
    # Groups with different pieces: their windows may agree in part.
    groups = classes.groupBy("key").agg(F.count(F.lit(1)).alias("n_pieces")).filter("n_pieces > 1")
    mixed_classes = classes.join(stage(groups, "anchor-groups"), "key").select("high", "low", "first.*", "n_pieces")
    mixed_classes = stage(mixed_classes, "mixed-classes")
    read = pieces_with_words(docs, mixed_classes.select("doc", "version", "start"), window, most_bits)
    first = read.join(mixed_classes, ["high", "low", "doc", "version", "start"])
    # Repeated rows of one document have the same place.
    first = stage(first.dropDuplicates(["high", "low"]), "first-pieces")
    marks = _grouped_marks(first.filter(F.col("n_pieces") <= group_pieces), window)
    if not first.filter(F.col("n_pieces") > group_pieces).isEmpty():
        marks = marks.unionByName(_split_marks(first.filter(F.col("n_pieces") > group_pieces), window))
    verdicts = classes.join(stage(marks, "marks"), ["high", "low"], "left")
    verdicts = verdicts.filter("marks IS NOT NULL OR found > 1").select("high", "low", "first", "marks")
    found = pieces.drop("key").join(stage(verdicts, "verdicts"), ["high", "low"])
    is_first = _place() == F.col("first")
    found = found.filter(~is_first | F.col("marks").isNotNull())
    return found.select("doc", "version", "start", "n", F.when(is_first, F.col("marks")).alias("marks"))


def dedup_passages(
    df: DataFrame,
    window: int = WINDOW,
    doc_id: str = "doc_id",
    text: str = "text",
    group_pieces: int = GROUP_PIECES,
    most_bits: int = FILTER_BITS,
) -> DataFrame:
    """Remove every word of ``window`` words in a row that also start at an earlier place.

    Earlier is a smaller ``doc_id``, or the same document and an earlier start. Words are
    runs without white space (``[\\x20\\x09-\\x0D]``), taken unchanged. Returns ``doc_id``,
    ``text`` (the words kept, joined by one space), ``n_words``, ``n_removed``,
    ``kept_sha256`` and ``removed``: an array of stretches of words, with their first word
    and the word after them.

    A null or empty text, or one without words, has no words. Rows with a null id come after
    all others. Rows of one id with different texts follow each other in the order of their
    texts' hashes; rows with the same id and text are one document, and all of them come
    out alike. Other columns are not read.
    """
    ids = F.coalesce(df[doc_id].cast("long"), F.lit(NO_ID)).alias("doc")
    docs = df.select(df[doc_id].cast("long").alias("doc_id"), ids, F.xxhash64(df[text]).alias("version"), df[text].alias("text"))
    found = repeated_spans(docs.select("doc", "version", "text"), window, group_pieces, most_bits)
    spans = F.collect_set(F.struct("start", "n", "marks")).alias("spans")
    by_document = found.groupBy("doc", "version").agg(spans)
    joined = docs.join(by_document, ["doc", "version"], "left").select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 1):
            rows = [_kept(t, spans or (), window) for t, spans in zip(utf8(batch.column(1)), batch.column(2).to_pylist(), strict=True)]
            kept, n, removed, stretches = zip(*rows, strict=True)
            columns = [
                batch.column(0),
                pa.array(kept, pa.binary()).cast(pa.string()),
                long_array(n),
                long_array(removed),
                pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
                pa.array(stretches, STRETCHES),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    schema = StructType.fromDDL(OUT_SCHEMA)
    return joined.mapInArrow(run, schema)


OUT_SCHEMA = (
    "doc_id long, text string, n_words long, n_removed long, kept_sha256 string, "
    "removed array<struct<start: long, stop: long>>"
)
STRETCHES = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def _kept(text: bytes, spans: list[dict], window: int) -> tuple[bytes, int, int, list[dict]]:
    """The words kept, the numbers of words and of removed ones, and the stretches removed."""
    words = text.split()
    if not spans:
        return b" ".join(words), len(words), 0, []
    windows = np.zeros(len(words) + 1, np.int32)
    for span in spans:
        at, marks = span["start"], span["marks"]
        windows[at : at + span["n"]] |= 1 if marks is None else np.frombuffer(marks, np.uint8)
    begin = np.flatnonzero(windows)
    cover = np.zeros(len(words) + 1, np.int32)
    np.add.at(cover, begin, 1)
    np.add.at(cover, begin + window, -1)
    gone = np.concatenate(([0], (np.cumsum(cover)[:-1] > 0).astype(np.int8), [0]))
    step = np.diff(gone)
    a, b = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    kept, at = [], 0
    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        kept += words[at:i]
        at = j
    kept += words[at:]
    stretches = [{"start": i, "stop": j} for i, j in zip(a.tolist(), b.tolist(), strict=True)]
    return b" ".join(kept), len(words), len(words) - len(kept), stretches
