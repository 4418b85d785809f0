"""Best-fit packing of documents into fixed-length sequences, mended by local search.

Pieces are placed best-fit in falling length. Then underfull sequences exchange pieces
(one for one, two for one, or one for none) whenever that raises the sum of squared
fills, which fills some and empties others.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetide.llm.encoding import encoder, tokenizer_path
from pricetide.llm.text import map_arrow, strings
from pricetide.session import stage

# Pieces packed together by one task; more tasks cost at most a sequence or so each.
GROUP_PIECES = 50_000


def cut_lengths(n: int, capacity: int) -> list[int]:
    """Lengths of a document's pieces: only the first may be short of ``capacity``."""
    more = (n - 1) // capacity
    return [n - more * capacity] + [capacity] * more


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Places of the sizes by bin: falling sizes, each into the fullest bin with room."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set if a bin has exactly r left
    for item in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[item]
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[at].append(item)
        else:
            room, at = capacity, len(bins)
            bins.append([item])
        by_room[room - size].append(at)
        rooms |= 1 << (room - size)
    return bins


class LocalSearch:
    """Exchanges between underfull bins that raise the sum of squared fills."""

    def __init__(self, sizes: list[int], bins: list[list[int]], capacity: int) -> None:
        self.sizes, self.bins, self.capacity = sizes, bins, capacity
        self.fill = [sum(sizes[i] for i in b) for b in bins]
        self.open = {b for b, f in enumerate(self.fill) if f < capacity}
        # Items of open bins by size, and which sizes there are.
        self.items: list[dict[int, int]] = [{} for _ in range(capacity + 1)]
        self.has = 0
        for b in self.open:
            for item in bins[b]:
                self._add(item, b)

    def _add(self, item: int, at: int) -> None:
        self.items[self.sizes[item]][item] = at
        self.has |= 1 << self.sizes[item]

    def _drop(self, item: int) -> None:
        same = self.items[self.sizes[item]]
        same.pop(item, None)
        if not same:
            self.has &= ~(1 << self.sizes[item])

    def _largest(self, most: int, above: int, target: int) -> tuple[int, int] | None:
        """The largest item in (above, most] of a bin less full than the target."""
        sizes = self.has & ((1 << (most + 1)) - 1) & ~((1 << (above + 1)) - 1)
        while sizes:
            size = sizes.bit_length() - 1
            for item, at in self.items[size].items():
                if at != target and self.fill[at] <= self.fill[target]:
                    return item, at
            sizes &= ~(1 << size)
        return None

    def _exchange(self, target: int, give: list[int], source: int, take: list[int]) -> None:
        gain = sum(self.sizes[i] for i in take) - sum(self.sizes[i] for i in give)
        for a, b, moved in ((target, source, give), (source, target, take)):
            for item in moved:
                self.bins[a].remove(item)
                self.bins[b].append(item)
                self._drop(item)
                self._add(item, b)
        self.fill[target] += gain
        self.fill[source] -= gain
        for b in (target, source):
            if self.fill[b] in (0, self.capacity):
                self.open.discard(b)
                for item in self.bins[b]:
                    self._drop(item)

    def improve(self, target: int, pairs: list[int]) -> bool:
        """Make the exchange that fills the target most; False if none helps."""
        room = self.capacity - self.fill[target]
        best, gain = None, 0
        found = self._largest(room, 0, target)
        if found:
            best, gain = ([], found[1], [found[0]]), self.sizes[found[0]]
        for item in self.bins[target]:
            size = self.sizes[item]
            found = self._largest(min(self.capacity, size + room), size + gain, target)
            if found:
                best, gain = ([item], found[1], [found[0]]), self.sizes[found[0]] - size
        if gain < room:
            for source in pairs:  # two of the least full bins' items for one
                own = self.bins[source] if source != target else []
                if self.fill[source] > self.fill[target] or len(own) < 2:
                    continue
                for item in self.bins[target]:
                    for i, one in enumerate(own):
                        for other in own[i + 1 :]:
                            more = self.sizes[one] + self.sizes[other] - self.sizes[item]
                            if gain < more <= room:
                                best, gain = ([item], source, [one, other]), more
        if best:
            self._exchange(target, *best)
        return bool(best)

    def run(self, rounds: int = 20, neighbours: int = 8) -> list[list[int]]:
        for _ in range(rounds):
            changed = False
            order = sorted(self.open, key=lambda b: (-self.fill[b], b))
            for at, target in enumerate(order):
                pairs = [b for b in order[-neighbours:] if b in self.open][::-1]
                while target in self.open and self.improve(target, pairs):
                    changed = True
            if not changed:
                break
        return [b for b in self.bins if b]


def pack_sizes(sizes: list[int], capacity: int) -> list[list[int]]:
    """Places of the sizes by bin. Sizes above the capacity are an error."""
    if sizes and max(sizes) > capacity:
        raise ValueError(f"a size of {max(sizes)} exceeds {capacity}")
    return LocalSearch(sizes, best_fit(sizes, capacity), capacity).run()


def token_pieces(
    df: DataFrame,
    capacity: int = 1024,
    end_id: int = 2,
    path: str | None = None,
    keep_ids: bool = False,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Every text's ids and ``end_id``, cut into pieces of at most ``capacity``.

    Returns per piece ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``, and
    with ``keep_ids`` the ids as little-endian 32-bit integers.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    schema += ", ids binary" if keep_ids else ""
    names = [field.split()[0] for field in schema.split(", ")]

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode = encoder(path or tokenizer_path("byte_bpe_50k.json")).encode
        end, out = np.array([end_id], np.uint32), [[] for _ in names]
        for doc, value in zip(batch.column(0).to_pylist(), strings(batch.column(1)), strict=True):
            raw = memoryview(np.concatenate((encode(value), end)).astype("<u4"))
            start = 0
            for piece, length in enumerate(cut_lengths(len(raw), capacity)):
                own = raw[start : start + length]
                row = (doc, piece, start, length, zlib.crc32(own), own.tobytes() if keep_ids else None)
                for column, field in zip(out, row, strict=False):
                    column.append(field)
                start += length
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        columns = [pa.array(c, k) for c, k in zip(out, kinds, strict=False)]
        return pa.RecordBatch.from_arrays(columns, names=names)

    return map_arrow(df.select(df[doc_id].cast("long"), df[text]), rows, schema)


def pack_documents(
    df: DataFrame, capacity: int = 1024, group_pieces: int = GROUP_PIECES, **options
) -> DataFrame:
    """Pieces of all documents with their ``sequence_id`` and ``offset`` there.

    Full pieces are sequences of their own. The others are packed in groups of about
    ``group_pieces`` drawn by a hash of the row, so no group grows with a source, a
    length or a text. A null or empty text is its end id. Repeated rows are packed as
    often as they occur; an empty table gives no pieces. ``options`` go to
    :func:`token_pieces`; columns other than the id and the text are not read.
    """
    pieces = stage(
        token_pieces(df, capacity, **options).withColumn("row", F.monotonically_increasing_id()),
        "token-pieces",
    )
    full = F.col("length") == capacity
    short = pieces.filter(~full).select("row", "length")
    groups = max(1, -(-short.count() // group_pieces))

    def place(table: pa.Table) -> pa.Table:
        order = np.argsort(table["row"].to_numpy())
        rows = table["row"].to_numpy()[order]
        sizes = table["length"].to_numpy()[order].tolist()
        group = table["group"][0].as_py()
        sequence, offset = np.empty(len(rows), np.int64), np.empty(len(rows), np.int64)
        for number, items in enumerate(pack_sizes(sizes, capacity)):
            at = 0
            for item in items:
                sequence[item], offset[item] = (group << 32) + number, at
                at += sizes[item]
        return pa.table({"row": rows, "sequence_id": sequence, "offset": offset})

    placed = (
        short.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)))
        .groupBy("group")
        .applyInArrow(place, "row long, sequence_id long, offset long")
    )
    alone = pieces.filter(full).select(
        "*", (-F.col("row") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    packed = pieces.filter(~full).join(placed, "row")
    return packed.unionByName(alone).drop("row")
