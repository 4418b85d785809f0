"""Documents linked by the Jaccard similarity of their shingle sets.

1. Identical sets become one node. A node's shingles are ordered, the frequent ones last,
   and enough of the first are its keys that two similar nodes share at least one.
2. Nodes of a key are tied to one of them, the pivot. Each node is compared with the pivot
   it shares most keys with; links make components.
3. In a key's group that is not one component yet, an R-tree over count vectors finds the
   pairs of different components that may be similar. A count vector says how many of a
   node's shingles fall into each hash group; the sum of the smaller counts bounds what two
   nodes can share. Boxes have 256 groups; the vectors of two nodes have about as many
   groups as shingles, since few groups bound long texts too loosely. Surviving pairs are
   compared shingle by shingle.

Links inside a component change nothing and are not looked for, so large groups of near
copies never become all their pairs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetide.llm.components import connected_components
from pricetide.llm.decontamination import hash_filter, passes, words
from pricetide.llm.encoding import long_array
from pricetide.llm.text import SHINGLE_WORDS, SIMILARITY_PERCENT, map_arrow, shingles, slices, utf8
from pricetide.session import stage

# Hash groups of the boxes, and the most that one node's vector has.
GROUPS = 256
MOST_GROUPS = 1 << 15
# A shingle in this many of the drawn documents counts as frequent; one in DRAWN is drawn.
FREQUENT = 3
DRAWN = 16
# Frequent shingles that the bitmap takes, the most frequent first: a quarter of its bits.
MOST_FREQUENT = 1 << 22
# A frequent key's nodes are split into so many groups, each with its own pivot.
SALTS = 64
# Members of a mixed group that one task joins; larger groups become pairs of blocks.
BLOCK_NODES = 512
LEAF = 16
# Nodes remembered by a task, so that copies it has met send no keys again.
SEEN = 500_000
FIRST_PARTNERS = 8


def prefix_size(n: int, percent: int = SIMILARITY_PERCENT) -> int:
    """Keys of which two nodes of at least ``percent`` similarity share one."""
    return n - -(-n * percent // 100) + 1 if n else 0


def groups_of(n: int) -> int:
    """Hash groups for a set of ``n`` shingles: a power of two from ``n`` on, in bounds."""
    return min(MOST_GROUPS, max(GROUPS, 1 << max(0, n - 1).bit_length()))


def count_vector(hashes: np.ndarray) -> np.ndarray:
    """How many hashes fall into each group, by bits the keys' order does not depend on.

    As these are the lowest bits, summing halves folds a vector to fewer groups.
    """
    groups = groups_of(len(hashes))
    counts = np.bincount((hashes & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
    return counts.astype(np.uint8 if counts.max() < 256 else np.uint32)


def packed(vector: np.ndarray) -> bytes:
    """A count vector's bytes, Huffman coded: counts are small, and few of them repeat in runs."""
    coder = zlib.compressobj(1, zlib.DEFLATED, -zlib.MAX_WBITS, strategy=zlib.Z_HUFFMAN_ONLY)
    return coder.compress(vector.tobytes()) + coder.flush()


def raw(coded: bytes) -> bytes:
    """The bytes of a count vector from what ``packed`` made of it."""
    return zlib.decompress(coded, -zlib.MAX_WBITS)


def similar(shared, total, percent: int = SIMILARITY_PERCENT):
    """Whether sets of ``total`` elements together, ``shared`` of them in both, link."""
    return 100 * shared >= percent * (total - shared)


def frequent_filter(docs: DataFrame, size: int) -> np.ndarray:
    """A fixed-size bitmap of shingles that many of the drawn documents have.

    It only decides in which order shingles become keys, so a draw does for it. Shingles are
    counted by their whole hashes: in large tables so many share a bit that counts of bits
    would call nearly all of them frequent, and every key of a frequent one is written.
    """

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        known = words()
        found = [shingles(t, known, size) for t in utf8(batch.column(0))]
        keys, counts = np.unique(np.concatenate([np.empty(0, np.uint64), *found]), return_counts=True)
        columns = [pa.array(keys.view(np.int64)), pa.array(counts)]
        return pa.RecordBatch.from_arrays(columns, names=["hash", "n"])

    drawn = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(DRAWN)) == 0).select("text")
    counted = map_arrow(drawn, rows, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    frequent = stage(counted.filter(F.col("n") >= FREQUENT), "frequent")
    bits_of_n = F.length(F.bin("n"))
    sizes = frequent.groupBy(bits_of_n.alias("bits")).agg(F.count(F.lit(1)).alias("shingles")).collect()
    taken, least = 0, FREQUENT
    for bits, shingles_of in sorted(map(tuple, sizes), reverse=True):
        if taken and taken + shingles_of > MOST_FREQUENT:
            least = 1 << bits
            break
        taken += shingles_of
    return hash_filter(frequent.filter(F.col("n") >= least).select("hash"))


def signatures(docs: DataFrame, bitmap, size: int, percent: int) -> DataFrame:
    """Every row's ``doc_id``, ``node`` (a hash of its set; null without words) and ``n``;
    for a node's first row in a task also its ``counts`` and ``keys``, the ``rare`` first
    ones not frequent."""
    schema = "doc_id long, node long, n long, counts binary, keys array<long>, rare int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        bits = bitmap.value
        for batch in slices(batches):
            out: list[list] = [[], [], [], [], []]
            for text in utf8(batch.column(1)):
                own = shingles(text, words(), size)
                node = xxhash.xxh3_64_intdigest(own.tobytes()) if len(own) else None
                row = (node, len(own), None, None, 0)
                if node is not None and node not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(node)
                    common = passes(bits, own)
                    rare = own[~common]
                    keys = np.concatenate((rare, own[common]))[: prefix_size(len(own), percent)]
                    counts = packed(count_vector(own))
                    row = (node, len(own), counts, keys.view(np.int64), min(len(rare), len(keys)))
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            nodes = pa.array(out[0], pa.uint64()).view(pa.int64())
            kinds = (pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.int32())
            columns = [batch.column(0), nodes, *(pa.array(c, k) for c, k in zip(out[1:], kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "node", "n", "counts", "keys", "rare"])

    return docs.mapInArrow(run, schema)


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key, salt and node; ties each node to the first of its group."""
    last: tuple[int, int, int, int] | None = None  # key, salt, pivot, node
    for batch in batches:
        key, salt, node = (c.to_numpy() for c in batch.columns)
        if not len(key):
            continue
        first = np.append(True, (key[1:] != key[:-1]) | (salt[1:] != salt[:-1]))
        again = np.append(False, node[1:] == node[:-1]) & ~first
        goes_on = last is not None and (key[0], salt[0]) == last[:2]
        starts = np.flatnonzero(first)
        pivots = node[starts]
        if goes_on:
            pivots[0] = last[2]
            first[0] = False
            again[0] = node[0] == last[3]
        pivot = pivots[np.cumsum(np.append(True, first[1:])) - 1]
        kept = (~again & ~first) | (first & (salt > 0))
        last = (key[-1], salt[-1], pivot[-1], node[-1])
        columns = [pa.array(x[kept]) for x in (key, salt, pivot, node)]
        yield pa.RecordBatch.from_arrays(columns, names=["key", "salt", "pivot", "node"])


def stars(signed: DataFrame) -> DataFrame:
    """A tree over the nodes of every key that several have: ``key``, ``pivot``, ``node``.

    A frequent key's nodes are split by a salt, and the pivots of its parts are tied to
    each other, so that no task gets all of them.
    """
    salt = F.when(F.col("at") >= F.col("rare"), F.pmod("node", F.lit(SALTS)).cast("int") + 1).otherwise(0)
    rows = signed.filter("keys IS NOT NULL").select("node", "rare", F.posexplode("keys").alias("at", "key"))
    dealt = (
        rows.select("key", salt.alias("salt"), "node")
        .repartition("key", "salt")
        .sortWithinPartitions("key", "salt", "node")
    )
    tied = stage(dealt.mapInArrow(_stars, "key long, salt int, pivot long, node long"), "stars")
    parts = tied.filter("salt > 0").select("key", "pivot").distinct()
    tops = parts.groupBy("key").agg(F.min("pivot").alias("top"))
    between = parts.join(tops, "key").filter("pivot != top")
    return tied.filter("pivot != node").select("key", "pivot", "node").union(
        between.select("key", F.col("top").alias("pivot"), F.col("pivot").alias("node"))
    )


def unpacked(coded: bytes, n: int) -> np.ndarray:
    """A count vector from what ``packed`` made of it, in either width."""
    own = raw(coded)
    return np.frombuffer(own, np.uint8 if len(own) == groups_of(n) else np.uint32)


def folded(vectors: np.ndarray, groups: int) -> np.ndarray:
    """The vectors of the last axis with only so many groups, a power of two."""
    if vectors.shape[-1] == groups:
        return vectors
    whole = vectors.reshape(*vectors.shape[:-1], -1, groups).sum(axis=-2, dtype=np.uint32)
    return whole.astype(np.uint8) if whole.max(initial=0) < 256 else whole


class Counts:
    """Count vectors of several nodes, compared at the coarser of two nodes' groups."""

    def __init__(self, vectors: list[bytes], n: np.ndarray) -> None:
        self.groups = np.array([groups_of(k) for k in n.tolist()], np.int64)
        bytes_each = np.array([len(v) for v in vectors], np.int64)
        # Vectors of one length and width, as one matrix each.
        self._own: list[tuple[np.ndarray, np.ndarray]] = []
        for groups, size in np.unique(np.stack((self.groups, bytes_each)), axis=1).T.tolist():
            rows = np.flatnonzero((self.groups == groups) & (bytes_each == size))
            kind = np.uint8 if size == groups else np.uint32
            whole = np.frombuffer(b"".join([vectors[i] for i in rows]), kind)
            self._own.append((rows, whole.reshape(len(rows), groups)))
        self._known: dict[int, np.ndarray] = {}
        self.coarse = self._at(GROUPS)[1]

    def _at(self, groups: int) -> tuple[np.ndarray, np.ndarray]:
        """Where each node is in the matrix of those with at least so many groups."""
        place = np.cumsum(self.groups >= groups) - 1
        if groups not in self._known:
            parts = [(rows, folded(own, groups)) for rows, own in self._own if own.shape[1] >= groups]
            out = np.empty((int(place[-1]) + 1 if len(place) else 0, groups), np.result_type(np.uint8, *(m for _, m in parts)))
            for rows, matrix in parts:
                out[place[rows]] = matrix
            self._known[groups] = out
        return place, self._known[groups]

    def bounds(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The most that nodes ``i`` and ``j`` can share."""
        out = np.zeros(len(i), np.int64)
        least = np.minimum(self.groups[i], self.groups[j])
        for groups in np.unique(least).tolist():
            place, matrix = self._at(groups)
            here = np.flatnonzero(least == groups)
            for part in np.array_split(here, -(-len(here) * groups // (1 << 22))):
                low = np.minimum(matrix[place[i[part]]], matrix[place[j[part]]])
                out[part] = low.sum(axis=1, dtype=np.int64)
        return out


def possible_pairs(nodes: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs ``u``, ``v`` that their count vectors allow to be similar."""
    thin = nodes.select("node", "n", "counts")

    def bounded(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = [batch.column(i).to_numpy() for i in (4, 5)]
        kept = []
        for a, b, a_n, b_n in zip(*(c.to_pylist() for c in batch.columns[2:6]), strict=True):
            groups = min(groups_of(a_n), groups_of(b_n))
            low = np.minimum(folded(unpacked(a, a_n), groups), folded(unpacked(b, b_n), groups))
            kept.append(int(low.sum(dtype=np.int64)))
        pair = pa.RecordBatch.from_arrays(batch.columns[:2], names=["u", "v"])
        return pair.filter(pa.array(similar(np.array(kept, np.int64), n[0] + n[1], percent), pa.bool_()))

    sides = [
        thin.select(*(F.col(c).alias(f"{side}_{c}") for c in thin.columns)).withColumnRenamed(f"{side}_node", side)
        for side in ("u", "v")
    ]
    every = pairs.join(sides[0], "u").join(sides[1], "v")
    every = every.filter(100 * F.least("u_n", "v_n") >= percent * F.greatest("u_n", "v_n"))
    return map_arrow(every.select("u", "v", "u_counts", "v_counts", "u_n", "v_n"), bounded, "u long, v long")


def link_pairs(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs of nodes ``u``, ``v`` that are similar, compared on their whole texts."""
    spark = docs.sparkSession
    of_u = nodes.select(F.col("node").alias("u"), F.col("doc_id").alias("u_doc"))
    of_v = nodes.select(F.col("node").alias("v"), F.col("doc_id").alias("v_doc"))
    possible = stage(pairs.join(of_u, "u").join(of_v, "v").select("u", "v", "u_doc", "v_doc"), "possible-pairs")
    # Only texts that are needed are shuffled; a fixed-size bitmap of their ids says which.
    needed = possible.select("u_doc").union(possible.select("v_doc"))
    bitmap = spark.sparkContext.broadcast(hash_filter(needed.select(F.xxhash64("u_doc").alias("hash"))))

    @F.pandas_udf("boolean")
    def wanted(hashes: pd.Series) -> pd.Series:
        return pd.Series(passes(bitmap.value, hashes.to_numpy().astype(np.int64).view(np.uint64)))

    texts = docs.filter("doc_id IS NOT NULL").filter(wanted(F.xxhash64("doc_id")))
    left = texts.select(F.col("doc_id").alias("u_doc"), F.col("text").alias("u_text"))
    right = texts.select(F.col("doc_id").alias("v_doc"), F.col("text").alias("v_text"))

    def compare(batch: pa.RecordBatch) -> pa.RecordBatch:
        kept = []
        known: tuple[bytes, np.ndarray] | None = None
        u, v = (c.to_numpy().view(np.uint64) for c in batch.columns[:2])
        for i, (one, other) in enumerate(zip(utf8(batch.column(2)), utf8(batch.column(3)), strict=True)):
            if known is None or known[0] != one:
                known = (one, shingles(one, words(), size))
            a, b = known[1], shingles(other, words(), size)
            shared = len(np.intersect1d(a, b, assume_unique=True))
            # Rows of one id may have different texts: these must be the nodes' own.
            own = [xxhash.xxh3_64_intdigest(x.tobytes()) for x in (a, b)] == [u[i], v[i]]
            kept.append(own and similar(shared, len(a) + len(b), percent))
        pair = pa.RecordBatch.from_arrays(batch.columns[:2], names=["u", "v"])
        return pair.filter(pa.array(kept, pa.bool_()))

    with_texts = possible.join(right, "v_doc").join(left, "u_doc").select("u", "v", "u_text", "v_text")
    return map_arrow(with_texts, compare, "u long, v long")


class Tree:
    """An R-tree over count vectors, loaded by halving on the widest coordinate."""

    __slots__ = ("top", "least_n", "most_n", "component", "rows", "halves")

    def __init__(self, counts: np.ndarray, n: np.ndarray, component: np.ndarray, rows: np.ndarray) -> None:
        own = counts[rows]
        self.top = own.max(axis=0)
        self.least_n, self.most_n = int(n[rows].min()), int(n[rows].max())
        # A box all of whose nodes are in one component needs no pairs with it.
        one = component[rows[0]]
        self.component = one if (component[rows] == one).all() else None
        self.rows, self.halves = rows, ()
        if len(rows) > LEAF:
            if self.component is None and len(np.unique(component[rows])) <= len(rows) // LEAF:
                order = rows[np.argsort(component[rows], kind="stable")]
            else:
                widest = int((self.top - own.min(axis=0)).argmax())
                order = rows[np.argsort(own[:, widest], kind="stable")]
            middle = len(order) // 2
            self.halves = tuple(Tree(counts, n, component, part) for part in (order[:middle], order[middle:]))

    def may_link(self, other: Tree, percent: int) -> bool:
        """Whether some node of the one box may be similar to one of the other."""
        if self.component is not None and self.component == other.component:
            return False
        if 100 * min(self.most_n, other.most_n) < percent * max(self.least_n, other.least_n):
            return False
        bound = int(np.minimum(self.top, other.top).sum())
        return bool(similar(bound, self.least_n + other.least_n, percent))


def tree_pairs(
    counts: Counts,
    n: np.ndarray,
    component: np.ndarray,
    percent: int = SIMILARITY_PERCENT,
    side: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of nodes of different components that may be similar, and the bounds of
    what they share. With ``side``, only pairs of a node on one and one on the other."""
    coarse = counts.coarse.astype(np.int32)
    sides = [np.arange(len(n))] if side is None else [np.flatnonzero(side), np.flatnonzero(~side)]
    left, right, bounds = [], [], []
    todo = []
    if all(map(len, sides)):
        trees = [Tree(coarse, n, component, rows) for rows in sides]
        todo.append((trees[0], trees[-1]))
    while todo:
        a, b = todo.pop()
        if not a.may_link(b, percent):
            continue
        if not a.halves and not b.halves:
            i, j = (x.ravel() for x in np.meshgrid(a.rows, b.rows, indexing="ij"))
            kept = component[i] != component[j]
            if a is b:
                kept &= i < j
            i, j = i[kept], j[kept]
            kept = 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
            kept &= similar(np.minimum(coarse[i], coarse[j]).sum(axis=1), n[i] + n[j], percent)
            i, j = i[kept], j[kept]
            bound = counts.bounds(i, j)
            kept = similar(bound, n[i] + n[j], percent)
            left.append(i[kept])
            right.append(j[kept])
            bounds.append(bound[kept])
        elif a is b:
            one, other = a.halves
            todo += [(one, one), (other, other), (one, other)]
        elif not b.halves or (a.halves and len(a.rows) >= len(b.rows)):
            todo += [(half, b) for half in a.halves]
        else:
            todo += [(a, half) for half in b.halves]
    empty = [np.empty(0, np.int64)]
    return tuple(np.concatenate(x or empty) for x in (left, right, bounds))


def mixed_members(tied: DataFrame, labels: DataFrame, pairs: DataFrame) -> DataFrame | None:
    """Nodes of the groups that hold several components: ``key``, ``node`` and the number
    of ``blocks``; groups of the same nodes come once. None if there are no such groups."""
    label = labels.select(F.col("node").alias("u"), F.col("component").alias("u_component"))
    other = label.toDF("v", "v_component")
    apart = (
        pairs.join(label, "u", "left")
        .join(other, "v", "left")
        .filter(F.coalesce("u_component", "u") != F.coalesce("v_component", "v"))
        .select(F.col("u").alias("pivot"), F.col("v").alias("node"))
    )
    apart = stage(apart, "pairs-apart")
    if apart.isEmpty():
        return None
    keys = tied.join(apart, ["pivot", "node"]).select("key").distinct()
    rows = tied.join(keys, "key")
    members = rows.select("key", "node").union(rows.select("key", "pivot")).distinct()
    members = stage(members, "mixed-members")
    same = ["size", "least", "most", "xor", "total"]
    groups = members.groupBy("key").agg(
        F.count(F.lit(1)).alias("size"),
        F.min("node").alias("least"),
        F.max("node").alias("most"),
        F.bit_xor(F.xxhash64("node")).alias("xor"),
        F.sum(F.shiftright(F.xxhash64("node"), 24)).alias("total"),
    )
    one = groups.groupBy(*same).agg(F.min("key").alias("key"))
    blocks = F.ceil(F.col("size") / BLOCK_NODES).cast("int").alias("blocks")
    return members.join(one.select("key", blocks), "key")


def tree_candidates(
    members: DataFrame, labels: DataFrame, nodes: DataFrame, percent: int, partners: int | None
) -> DataFrame:
    """Pairs ``u``, ``v`` of different components that the groups' trees let through; with
    ``partners`` only so many likeliest ones of each node. A row with a ``key`` instead
    names a group of which pairs were left out for that."""

    def find(rows: list[tuple], across: bool) -> tuple[np.ndarray, np.ndarray, bool]:
        node, component, n, one_side = (np.concatenate([r[i] for r in rows]) for i in range(4))
        counts = Counts([raw(v) for r in rows for v in r[4]], n)
        i, j, bound = tree_pairs(counts, n, component, percent, one_side if across else None)
        every = len(i)
        if partners is not None and len(i):
            # Both ways, each node's partners by what they may share of the whole.
            one, other = np.concatenate((i, j)), np.concatenate((j, i))
            share = np.tile(bound / (n[i] + n[j] - bound), 2)
            order = np.lexsort((node[other], -share, one))
            new = np.append(True, one[order][1:] != one[order][:-1])
            at = np.arange(len(order))
            best = order[at - np.maximum.accumulate(np.where(new, at, 0)) < partners]
            kept = np.unique(best % len(i))
            i, j = i[kept], j[kept]
        return np.minimum(node[i], node[j]), np.maximum(node[i], node[j]), len(i) < every

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        current: tuple | None = None

        def result() -> pa.RecordBatch:
            u, v, cut = find(held, current[1] != current[2])
            more = [None] * cut
            columns = [[*u.tolist(), *more], [*v.tolist(), *more], [None] * len(u) + [current[0]] * cut]
            return pa.RecordBatch.from_arrays([long_array(x) for x in columns], names=["u", "v", "key"])

        for batch in slices(batches, BLOCK_NODES):
            group = np.stack([c.to_numpy() for c in batch.columns[:3]], axis=1)
            edges = np.flatnonzero(np.append(True, (group[1:] != group[:-1]).any(axis=1)))
            node, component, n = (c.to_numpy() for c in batch.columns[3:6])
            counts = batch.column(6).to_pylist()
            one_side = batch.column(7).to_numpy() == group[:, 1]
            for start, stop in zip(edges, np.append(edges[1:], len(group)), strict=True):
                this = tuple(group[start])
                if current is not None and this != current:
                    yield result()
                    held = []
                current = this
                held.append(tuple(x[start:stop] for x in (node, component, n, one_side, counts)))
        if held:
            yield result()

    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    full = (
        members.join(labels, "node", "left")
        .join(nodes.select("node", "n", "counts"), "node")
        .withColumn("own", block)
        .withColumn("other", others)
        .select(
            "key",
            F.least("own", "other").cast("long").alias("first"),
            F.greatest("own", "other").cast("long").alias("second"),
            "node",
            F.coalesce("component", "node").alias("component"),
            "n",
            "counts",
            F.col("own").cast("long").alias("own"),
        )
        .repartition("key", "first", "second")
        .sortWithinPartitions("key", "first", "second")
    )
    return full.mapInArrow(run, "u long, v long, key long").distinct()


def jaccard_components(
    df: DataFrame,
    percent: int = SIMILARITY_PERCENT,
    size: int = SHINGLE_WORDS,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of every document.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a document's set holds its
    distinct shingles of ``size`` words, or its whole sequence if it has fewer. Two
    documents link when ``100 * intersection >= percent * union``, and ``component_id`` is
    the smallest id reachable by links.

    A null or empty text, or one without words, has an empty set and is a component of its
    own. Repeated rows come out as often as they go in; rows of one id with different
    texts may be in different components. Rows with a null id are not compared: they are
    components of their own with a null id. Other columns are not read.
    """
    spark = df.sparkSession
    docs = df.select(df[doc_id].cast("long").alias("doc_id"), df[text].alias("text"))
    bitmap = spark.sparkContext.broadcast(frequent_filter(docs, size))
    signed = stage(signatures(docs.filter("doc_id IS NOT NULL"), bitmap, size, percent), "signatures")
    known = signed.filter("node IS NOT NULL")
    nodes = stage(
        known.groupBy("node").agg(
            F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.max("counts").alias("counts")
        ),
        "nodes",
    )
    tied = stars(signed)
    tally = tied.groupBy("pivot", "node").agg(F.count(F.lit(1)).alias("keys"))
    pairs = stage(tally.select(F.col("pivot").alias("u"), F.col("node").alias("v"), "keys"), "star-pairs")
    likeliest = pairs.groupBy("v").agg(F.max_by("u", F.struct("keys", "u")).alias("u"))
    possible = possible_pairs(nodes, likeliest.select("u", "v"), percent)
    links = stage(link_pairs(docs, nodes, possible, size, percent), "links")
    labels = stage(connected_components(links), "labels")
    members = mixed_members(tied, labels, pairs)
    if members is not None:
        members = stage(members, "members")
        tested = likeliest.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
        for partners in (FIRST_PARTNERS, None):
            found = tree_candidates(members, labels, nodes, percent, partners)
            found = stage(found.join(tested, ["u", "v"], "left_anti"), "candidates")
            new = found.filter("key IS NULL").select("u", "v")
            if not new.isEmpty():
                more = stage(link_pairs(docs, nodes, new, size, percent), "links")
                links = links.union(more)
                labels = stage(connected_components(links), "labels")
                tested = tested.union(new)
            # Links only join components: a group of which no pair was left out has no others.
            rest = found.filter("key IS NOT NULL").select("key").distinct()
            if rest.isEmpty():
                break
            members = members.join(rest, "key", "left_semi")
    least = (
        nodes.select("node", "doc_id")
        .join(labels, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
    )
    smallest = least.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_node = least.join(smallest, "component").select("node", "component_id")
    out = signed.select("doc_id", "node", "n").join(of_node, "node", "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.unionByName(_without_id(docs.filter("doc_id IS NULL"), size))


def _without_id(docs: DataFrame, size: int) -> DataFrame:
    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes = long_array([len(shingles(t, words(), size)) for t in utf8(batch.column(1))])
        columns = [batch.column(0), sizes, batch.column(0)]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "component_id"])

    return map_arrow(docs, rows, "doc_id long, n_shingles long, component_id long")
