"""Ranked search for items in documents, each different bag of terms scored once.

For a block of items, a document matters only by the bag of the items' terms it holds and
by its length's factor m. Documents that agree in both are one class: classes are scored,
and the members of the best ones are listed in the order of their ids.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetide.llm.encoding import long_array
from pricetide.llm.text import map_arrow, slices, utf8
from pricetide.session import stage

BEST = 10
# Items and terms that are searched at once: what a task holds of them has this bound.
BLOCK_ITEMS = 1000
BLOCK_TERMS = 100_000
# Classes that are scored at once.
CLASSES = 1024
# Tasks' best rows are merged in so many parts of a key first, and those parts after that.
MERGE_PARTS = 64
# A null doc_id comes after all others.
NO_ID = (1 << 63) - 1
# Sums below it are exact in doubles.
EXACT = 1 << 53

# Terms are runs of 0-9, A-Z, a-z and all beyond ASCII, which in UTF-8 are bytes from 0x80.
_TERM_BYTES = bytes([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
TO_TERMS = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if b in _TERM_BYTES else 0x20 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """The terms of a text, A-Z in lower case, with repeats."""
    return text.translate(TO_TERMS).split()


def item_terms(items: DataFrame) -> DataFrame:
    """``item`` (its row number), ``term`` and how often it is in the item's text."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [(n, *pair) for n, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True)
                 for pair in Counter(terms(text)).items()]
        item, term, repeats = zip(*found, strict=True) if found else ((), (), ())
        columns = [long_array(item), pa.array(term, pa.binary()), long_array(repeats)]
        return pa.RecordBatch.from_arrays(columns, names=["item", "term", "repeats"])

    return map_arrow(items.select("item", "text"), rows, "item long, term binary, repeats long")


def document_bags(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """``doc``, ``n`` (all its terms with repeats) and ``bag`` of every document with a term.

    A bag is the numbers of the vocabulary's terms found, ascending, then how often each
    was: little-endian 32-bit integers. It is empty where none was found.
    """
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        numbers = known.value
        doc, n, bags = [], [], []
        for i, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
            found = terms(text)
            if not found:
                continue
            counts = Counter(found)
            bag = sorted((numbers[t], counts[t]) for t in counts.keys() & numbers.keys())
            doc.append(i)
            n.append(len(found))
            bags.append(np.array(bag, "<u4").reshape(-1, 2).T.tobytes())
        columns = [long_array(doc), long_array(n), pa.array(bags, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["doc", "n", "bag"])

    return map_arrow(docs.select("doc", "text"), rows, "doc long, n long, bag binary")


def unpacked(bags: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each entry of the bags: whose bag it is in, its term's number, how often."""
    sizes = np.array([len(b) // 8 for b in bags], np.int64)
    values = np.frombuffer(b"".join(bags), "<u4").astype(np.int64)
    row = np.repeat(np.arange(len(bags)), sizes)
    before = np.cumsum(sizes) - sizes
    at = np.arange(len(row)) + before[row]  # each bag has as many counts after its terms
    return row, values[at], values[at + sizes[row]]


def document_frequencies(bags: DataFrame, n_terms: int) -> dict[int, int]:
    """In how many documents each term is; a task adds up its own before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for batch in slices(batches, 4096):
            total += np.bincount(unpacked(batch.column(0).to_pylist())[1], minlength=n_terms)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["term", "df"])

    found = bags.select("bag").mapInArrow(run, "term long, df long")
    # One row for each term of the block, which has a bound.
    return {r["term"]: r["df"] for r in found.groupBy("term").agg(F.sum("df").alias("df")).collect()}


def first_rows(df: DataFrame, key: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key.

    They are found in parts of a key first, so that no task gets all tasks' rows of one.
    """
    out = df.withColumn("part", F.spark_partition_id() % MERGE_PARTS)
    for keys in ([*key, "part"], key):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        out = out.withColumn("place", place).filter(F.col("place") <= n)
    return out.drop("part", "place")


def class_scores(classes: DataFrame, weights: list[tuple[int, int, int]], n_items: int, k: int) -> DataFrame:
    """The best ``k`` classes of each task for each item, by score, then by first member.

    ``weights`` has an item, a term and the term's weight times its repeats in the item.
    """
    weights = sorted(weights, key=lambda w: w[1])
    item, term, weight = np.array(weights, np.int64).reshape(-1, 3).T
    # No impact is over a million, so no score is over this.
    most = int(np.bincount(item, weights=weight, minlength=1).max()) * 1_000_000
    kind = np.float64 if most < EXACT else np.int64
    broadcast = classes.sparkSession.sparkContext.broadcast((item, term, weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item, term, weight = broadcast.value
        best = np.empty((0, 4), np.int64)  # item, score, first member, class
        bar = np.ones(n_items, np.int64)  # what a score must reach
        for batch in slices(batches, CLASSES):
            row, own, tf = unpacked(batch.column(3).to_pylist())
            m = batch.column(1).to_numpy()
            impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[row])
            used, own = np.unique(own, return_inverse=True)
            here = np.zeros((batch.num_rows, len(used)), kind)
            here[row, own] = impact
            a, b = np.searchsorted(term, used), np.searchsorted(term, used, side="right")
            at = np.concatenate([np.arange(x, y) for x, y in zip(a, b, strict=True)]) if len(used) else np.empty(0, np.int64)
            table = np.zeros((len(used), n_items), kind)
            table[np.repeat(np.arange(len(used)), b - a), item[at]] = weight[at]
            scores = (here @ table).astype(np.int64)
            if len(scores) > k:
                bar = np.maximum(bar, np.partition(scores, -k, axis=0)[-k])
            c, i = np.nonzero(scores >= bar)
            new = np.stack((i, scores[c, i], batch.column(2).to_numpy()[c], batch.column(0).to_numpy()[c]), axis=1)
            best = np.concatenate((best, new))
            best = best[np.lexsort((best[:, 2], -best[:, 1], best[:, 0]))]
            place = np.arange(len(best)) - np.searchsorted(best[:, 0], best[:, 0])
            best = best[place < k]
            last = best[place[place < k] == k - 1]
            bar[last[:, 0]] = np.maximum(bar[last[:, 0]], last[:, 1])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in best.T], names=["item", "score", "first", "class"])

    return classes.select("class", "m", "first", "bag").mapInArrow(run, "item long, score long, first long, class long")


def search_block(docs: DataFrame, block: DataFrame, k: int) -> DataFrame:
    """``item``, ``rank``, ``doc`` and ``score`` for the items of one block."""
    pairs = [(r["item"], bytes(r["term"]), r["repeats"]) for r in block.collect()]  # of bounded number
    vocabulary = {t: n for n, t in enumerate(sorted({t for _, t, _ in pairs}))}
    numbers = sorted({i for i, _, _ in pairs})
    place = {i: n for n, i in enumerate(numbers)}

    bags = stage(document_bags(docs, vocabulary), "bags")
    total = bags.agg(F.count(F.lit(1)).alias("docs"), F.sum(F.col("n").cast("decimal(20,0)")).alias("words")).first()
    n_docs, words = total["docs"], int(total["words"] or 0)
    df = document_frequencies(bags, len(vocabulary))
    weights = []
    for i, term, repeats in pairs:
        held = df.get(vocabulary[term], 0)
        w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held + 1)))
        if held and w:
            weights.append((place[i], vocabulary[term], w * repeats))

    # div rounds down, as all of it is positive. In decimals, so that no product overflows.
    share = F.expr(f"(75 * cast(n as decimal(20,0)) * {n_docs}BD) div {max(words, 1)}BD")
    of_documents = bags.filter(F.length("bag") > 0).select("doc", (F.lit(25) + share).alias("m"), "bag")
    of_documents = of_documents.withColumn("hash", F.xxhash64("m", "bag"))
    # Equal hashes alone do not make a class: m and the bag are part of the key.
    classes = of_documents.groupBy("hash", "m", "bag").agg(F.min("doc").alias("first"))
    classes = stage(classes.withColumn("class", F.monotonically_increasing_id()), "bag-classes")

    scored = class_scores(classes, weights, len(numbers), k)
    order = [F.desc("score"), F.asc("first"), F.asc("class")]
    winners = stage(first_rows(scored, ["item"], order, k), "best-classes")
    # At most k classes for each item can give it documents.
    wanted = classes.join(winners.select("class").distinct(), "class").select("class", "hash", "m", "bag")
    wanted = stage(wanted, "wanted-classes")
    # No more hashes than k for each item of a block, so they may be sent to all executors.
    # Members are cut to k of a class before classes are told apart, so none is a hot key.
    near = of_documents.join(F.broadcast(wanted.select("hash").distinct()), "hash", "left_semi")
    members = first_rows(near, ["hash", "m", "bag"], [F.asc("doc")], k).join(wanted, ["hash", "m", "bag"])
    members = stage(members.select("class", "doc"), "members")
    listed = winners.join(members, "class")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc("doc")))
    ranked = listed.withColumn("rank", rank).filter(F.col("rank") <= k)
    names = docs.sparkSession.createDataFrame(list(place.items()), "number long, item long")
    return ranked.join(names, "item").select(F.col("number").alias("item"), "rank", "doc", "score")


def search_items(
    df: DataFrame,
    items: DataFrame,
    k: int = BEST,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    block_items: int = BLOCK_ITEMS,
    block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """The ``k`` documents that score highest for each item, if above 0.

    Terms are runs of ASCII letters, digits and characters beyond ASCII, with A-Z in lower
    case. With N documents that have terms, L terms in all and n in a document, that
    document's m is ``25 + 75 n N div L``. A term in df documents weighs ``w =
    floor(1000 ln((2 N + 2) / (2 df + 1)))``; a document's score is the sum of ``w
    (10^9 tf div (1000 tf + 8 m))`` over the item's terms, repeats included. Returns
    ``item_id``, ``rank`` (from 1), ``doc_id`` and ``score``; equal scores go by ``doc_id``.

    Null and empty texts, and those without terms, are no documents and find nothing.
    Repeated rows are documents of their own. A null ``doc_id`` comes after all others;
    items with a null or repeated id are searched one by one. Other columns are not read.

    Items are searched in blocks of bounded size, and each block reads the documents once.
    """
    docs = df.select(F.coalesce(df[doc_id].cast("long"), F.lit(NO_ID)).alias("doc"), df[text].alias("text"))
    rows = items.select(items[item_id].alias("item_id"), items[item_text].alias("text"))
    rows = stage(rows.withColumn("item", F.monotonically_increasing_id()), "items")
    pairs = stage(item_terms(rows), "item-terms")
    counted = pairs.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("item").alias("items")).first()
    blocks = max(1, -(-counted["items"] // block_items), -(-counted["n"] // block_terms))
    # Hashed numbers fill the blocks evenly.
    in_block = F.pmod(F.xxhash64("item"), F.lit(blocks))
    found = [stage(search_block(docs, pairs.filter(in_block == b), k), "found") for b in range(blocks)]
    out = reduce(DataFrame.unionByName, found).join(rows.select("item", "item_id"), "item")
    return out.select("item_id", F.col("rank").cast("int").alias("rank"), F.nullif("doc", F.lit(NO_ID)).alias("doc_id"), "score")
