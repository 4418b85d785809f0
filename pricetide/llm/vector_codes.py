"""Product codes of vectors: Lloyd's rounds over cover trees of each block of vectors.

Every block of rows gets one cover tree for each part of its vectors. A node knows its
centre, its radius, and the sum of its vectors, which lie in one stretch of the block. A
round compares a node's centre with the codebook: if the nearest entry stays nearest for
all that lies within the radius, the node is assigned whole. Only the others are opened,
down to single vectors, which are compared exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from pricetide.llm.text import slices
from pricetide.session import stage

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
BLOCK_ROWS = 1024
# Nodes of so few vectors are not divided further.
LEAF = 8
# Whole components below it give distances and a block's sums that fit into 64 bits.
LIMIT = 1 << 26


def square(x: np.ndarray) -> np.ndarray:
    """Squared lengths of integer vectors."""
    return np.einsum("...j,...j->...", x, x)


class CoverTree:
    """A cover tree of one block's integer vectors, built level by level.

    A level's reach is half of the one above. A node is divided among centres of its own:
    the centre it has, then one vector after another that no centre reaches yet. So the
    centres of a node are further apart than the reach, and its vectors are within it.

    Nodes are numbered by level, and the children of a node follow each other. ``nodes``
    has a row for each: its centre, the stretch of ``order`` that holds its vectors, its
    first child and the number of children. ``radius`` is the largest distance of a vector
    from the centre. ``sums`` are differences of the cumulative sums in that order.
    """

    def __init__(self, points: np.ndarray) -> None:
        self.points = points
        order = np.arange(len(points))
        away = square(points - points[0])
        levels = [np.array([[0, 0, len(points), 0, 0]])]
        radii = [np.array([away.max()])]
        reach, base = float(np.sqrt(away.max())), 1
        while True:
            level = levels[-1]
            divided = np.flatnonzero(level[:, 2] - level[:, 1] > LEAF)
            if not len(divided) or reach < 1:
                break
            reach /= 2
            size = level[divided, 2] - level[divided, 1]
            owner = np.repeat(np.arange(len(divided)), size)
            place = np.arange(size.sum()) + np.repeat(level[divided, 1] - np.cumsum(size) + size, size)
            child, centre, parent = self._divide(order[place], owner, level[divided, 0], reach)
            # Numbers that ascend with the parent's keep every node in one stretch.
            by_parent = np.argsort(parent, kind="stable")
            number = np.empty_like(by_parent)
            number[by_parent] = np.arange(len(by_parent))
            child = number[child]
            sort = np.argsort(child, kind="stable")
            order[place] = order[place][sort]
            edge = np.flatnonzero(np.diff(child[sort], prepend=-1))
            made = np.zeros((len(edge), 5), np.int64)
            made[:, 0] = centre[by_parent]
            made[:, 1] = place[edge]
            made[:, 2] = place[np.append(edge[1:], len(place)) - 1] + 1
            count = np.bincount(parent, minlength=len(divided))
            level[divided, 3] = base + np.cumsum(count) - count
            level[divided, 4] = count
            base += len(made)
            own = np.repeat(made[:, 0], made[:, 2] - made[:, 1])
            levels.append(made)
            radii.append(np.maximum.reduceat(square(points[order[place]] - points[own]), edge))
        self.order = order
        self.nodes = np.concatenate(levels)
        self.radius = np.sqrt(np.concatenate(radii).astype(np.float64))
        total = np.concatenate((np.zeros((1, points.shape[1]), np.int64), np.cumsum(points[order], axis=0)))
        self.sums = total[self.nodes[:, 2]] - total[self.nodes[:, 1]]

    def _divide(self, rows: np.ndarray, owner: np.ndarray, centres: np.ndarray, reach: float):
        """Each row's child, and the centre and parent of each child."""
        child = np.empty(len(rows), np.int64)
        centre, parent = [], []
        left, made = np.arange(len(rows)), 0
        while len(left):
            first = np.flatnonzero(np.diff(owner[left], prepend=-1))
            owners = owner[left[first]]
            chosen = rows[left[first]] if made else centres[owners]
            own = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(left))))
            near = square(self.points[rows[left]] - self.points[chosen][own]) <= reach * reach
            child[left[near]] = made + own[near]
            centre.append(chosen)
            parent.append(owners)
            made += len(chosen)
            left = left[~near]
        return child, np.concatenate(centre), np.concatenate(parent)

    def packed(self) -> dict[str, bytes]:
        return {
            "points": self.points.astype("<i4").tobytes(),
            "order": self.order.astype("<i4").tobytes(),
            "nodes": self.nodes.astype("<i4").tobytes(),
            "radius": self.radius.astype("<f8").tobytes(),
            "sums": self.sums.astype("<i8").tobytes(),
        }

    @classmethod
    def unpacked(cls, packed: dict[str, bytes], size: int) -> CoverTree:
        tree = cls.__new__(cls)
        tree.order = np.frombuffer(packed["order"], "<i4")
        tree.points = np.frombuffer(packed["points"], "<i4").astype(np.int64).reshape(len(tree.order), size)
        tree.nodes = np.frombuffer(packed["nodes"], "<i4").reshape(-1, 5)
        tree.radius = np.frombuffer(packed["radius"], "<f8")
        tree.sums = np.frombuffer(packed["sums"], "<i8").reshape(len(tree.nodes), size)
        return tree

    def assign(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The nearest entry of each vector (of equal ones the first), the sums of each
        entry's vectors with their number in the last column, and the exact comparisons."""
        codes = np.empty(len(self.order), np.int64)
        total = np.zeros((len(book), book.shape[1] + 1), np.int64)
        front, compared = np.zeros(1, np.int64), 0
        single = []
        while len(front):
            away = np.sqrt(square(self.points[self.nodes[front, 0]][:, None, :] - book[None]).astype(np.float64))
            best = away.argmin(axis=1)
            least = away[np.arange(len(front)), best]
            away[np.arange(len(front)), best] = np.inf
            # Rounding cannot reach the margin, and what it leaves open is compared exactly.
            sure = away.min(axis=1) - least > 2 * self.radius[front] + 1e-6 + 1e-12 * least
            whole, entry = front[sure], best[sure]
            start, stop = self.nodes[whole, 1], self.nodes[whole, 2]
            np.add.at(total[:, :-1], entry, self.sums[whole])
            np.add.at(total[:, -1], entry, stop - start)
            codes[self.order[_stretches(start, stop)]] = np.repeat(entry, stop - start)
            front = front[~sure]
            leaf = self.nodes[front, 4] == 0
            single.append(_stretches(self.nodes[front[leaf], 1], self.nodes[front[leaf], 2]))
            inner = self.nodes[front[~leaf]]
            front = _stretches(inner[:, 3], inner[:, 3] + inner[:, 4])
        rows = self.order[np.concatenate(single)]
        if len(rows):
            own = self.points[rows]
            entry = square(own[:, None, :] - book[None]).argmin(axis=1)
            codes[rows] = entry
            np.add.at(total[:, :-1], entry, own)
            np.add.at(total[:, -1], entry, 1)
            compared = len(rows)
        return codes, total, compared


def _stretches(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The whole numbers of all the stretches, one after another."""
    size = stop - start
    return np.arange(size.sum()) + np.repeat(start - np.cumsum(size) + size, size)


TREES = ArrayType(StructType([StructField(n, BinaryType()) for n in ("points", "order", "nodes", "radius", "sums")]))


def vector_trees(vectors: DataFrame, parts: int, block_rows: int) -> DataFrame:
    """One row for each block of ``vec_id``, ``label`` and ``vector``: those, and a tree for
    each part of the vectors. Blocks do not cross the partitions of ``vectors``."""
    label = vectors.schema["label"].dataType
    schema = StructType(
        [StructField("vec_id", ArrayType(LongType())), StructField("label", ArrayType(label)), StructField("trees", TREES)]
    )

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        vector = table.column("vector").combine_chunks()
        whole = np.floor(vector.values.to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
        if len(whole) and np.abs(whole).max() >= LIMIT:
            raise ValueError(f"components must be below {LIMIT // SCALE} in size")
        whole = whole.astype(np.int64).reshape(len(vector), -1)
        trees = [CoverTree(np.ascontiguousarray(part)).packed() for part in np.split(whole, parts, axis=1)]
        rows = {"vec_id": table.column("vec_id").to_pylist(), "label": table.column("label").to_pylist(), "trees": trees}
        return pa.RecordBatch.from_pylist([rows], to_arrow_schema(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in slices(batches, block_rows):
            while batch.num_rows:
                part = batch.slice(0, block_rows - size)
                batch = batch.slice(part.num_rows)
                held.append(part)
                size += part.num_rows
                if size == block_rows:
                    yield block(held)
                    held, size = [], 0
        if held:
            yield block(held)

    return vectors.mapInArrow(run, schema)


def _round(trees: DataFrame, books: np.ndarray) -> np.ndarray:
    """The books after one round: means of the vectors assigned, rounded down."""
    parts, entries, size = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, entries, size + 1), np.int64)
        for batch in slices(batches, 1):
            for part, packed in enumerate(batch.column(0)[0].as_py()):
                total[part] += CoverTree.unpacked(packed, size).assign(books[part])[1]
        at = np.flatnonzero(total.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], names=["at", "total"])

    rows = trees.select("trees").mapInArrow(run, "at long, total long")
    # As many rows as the books have numbers; decimals hold sums of any number of vectors.
    found = rows.groupBy("at").agg(F.sum(F.col("total").cast("decimal(20,0)")).alias("total")).collect()
    total = np.zeros(parts * entries * (size + 1), object)
    for row in found:
        total[row["at"]] = int(row["total"])
    total = total.reshape(parts, entries, size + 1)
    used = total[:, :, -1] > 0
    out = books.copy()
    out[used] = (total[used][:, :-1] // total[used][:, -1:]).astype(np.int64)
    return out


def code_vectors(
    df: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Code every vector by the nearest entry of each part's codebook.

    Components become ``floor(4096 x)``, and vectors are cut into ``parts`` equal parts. A
    part's codebook starts as that part of the ``entries`` smallest ids' vectors; each round
    replaces an entry by the mean of the parts nearest to it, rounded down. Returns
    ``vec_id``, ``code`` (two hexadecimal digits for each part), ``error`` (squared
    distances summed over the parts), ``label_error`` (errors summed over equal labels,
    nulls together) and ``codebooks_sha256`` (of all entries' components).

    Vectors that are null or hold null or non-finite components are left out, and so are
    those of another length than the first one's, which no codebook fits. A length that the
    parts do not divide, or a component of 16,384 or more, is an error. Rows with one id
    are coded each on its own; those that seed a codebook are ordered by their vectors. A
    null id comes after all others. Fewer vectors than entries make smaller codebooks; none
    give no rows. Other columns are not read.
    """
    finite = F.forall(df[vector], lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    ids = df[vec_id].cast("long").alias("vec_id")
    kept = df.filter(df[vector].isNotNull() & finite).select(ids, df[label].alias("label"), df[vector].alias("vector"))
    first = F.asc_nulls_last("vec_id")
    lead = kept.orderBy(first, "vector").limit(1).collect()
    size = len(lead[0]["vector"]) if lead else 0
    if size % parts:
        raise ValueError(f"vectors of {size} components cannot be cut into {parts} equal parts")
    kept = kept.filter(F.size("vector") == size)
    seeds = [row["vector"] for row in kept.orderBy(first, "vector").limit(entries).select("vector").collect()]
    books = np.floor(np.array(seeds, np.float64).reshape(len(seeds), size) * SCALE).astype(np.int64)
    books = books.reshape(len(seeds), parts, size // parts).transpose(1, 0, 2)

    trees = stage(vector_trees(kept, parts, block_rows), "vector-trees")
    for _ in range(rounds if seeds else 0):
        books = _round(trees, books)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()

    schema = StructType(
        [
            StructField("vec_id", LongType()),
            StructField("label", kept.schema["label"].dataType),
            StructField("code", StringType()),
            StructField("error", LongType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            codes, error = [], 0
            for part, packed in enumerate(batch.column(2)[0].as_py()):
                tree = CoverTree.unpacked(packed, size // parts)
                codes.append(tree.assign(books[part])[0])
                error = error + square(tree.points - books[part][codes[-1]])
            text = np.stack(codes, axis=1).astype(np.uint8).tobytes().hex()
            code = [text[i : i + 2 * parts] for i in range(0, len(text), 2 * parts)]
            columns = [batch.column(0).flatten(), batch.column(1).flatten(), pa.array(code, pa.string()), pa.array(error)]
            yield pa.RecordBatch.from_arrays(columns, schema=to_arrow_schema(schema))

    coded = stage(trees.mapInArrow(run, schema), "vector-codes")
    by_label = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    by_label = stage(by_label.withColumnRenamed("label", "of"), "label-errors")
    joined = coded.join(by_label, coded["label"].eqNullSafe(by_label["of"]))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
