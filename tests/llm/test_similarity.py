from __future__ import annotations

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pricetide.llm import decontamination, jaccard_join
from pricetide.llm.components import connected_components
from pricetide.llm.decontamination import find_items, sketch_size
from pricetide.llm.jaccard_join import (
    Counts,
    count_vector,
    folded,
    frequent_filter,
    groups_of,
    jaccard_components,
    prefix_size,
    signatures,
    similar,
    tree_pairs,
    unpacked,
)
from pricetide.llm.text import WordHashes, shingles

WORDS = [f"w{i}" for i in range(4000)]


def word_set(text, size=5):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return set()
    if len(words) < size:
        return {tuple(words)}
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def brute_components(rows):
    sets = [(doc, word_set(text)) for doc, text in rows]
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(sets):
        least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted((doc, len(s), least[find(i)]) for i, (doc, s) in enumerate(sets))


def edited(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        at = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[at] = rng.choice(WORDS)
        elif kind == 1:
            out.insert(at, rng.choice(WORDS))
        elif len(out) > 1:
            del out[at]
    return out


def corpus(seed, bases=25, most=160):
    """Texts of several lengths, chains of edits, copies and a passage many share."""
    rng = random.Random(seed)
    passage = [rng.choice(WORDS) for _ in range(60)]
    rows = []
    for _ in range(bases):
        words = [rng.choice(WORDS) for _ in range(rng.choice([1, 3, 4, 5, 6, 9, 30, 80, most]))]
        if rng.random() < 0.4:
            words = words[:20] + passage + words[20:]
        for _ in range(rng.choice([1, 1, 2, 5, 9])):
            rows.append(" ".join(words))
            words = edited(rng, words, rng.choice([0, 1, 1, 2, 4]))
    rng.shuffle(rows)
    return list(enumerate(rows, 10))


@pytest.mark.parametrize("seed", range(3))
def test_components_are_those_of_all_pairs(docs, seed):
    rows = corpus(seed)
    got = sorted(tuple(r) for r in jaccard_components(docs(rows, 4)).collect())
    assert got == brute_components(rows)


def test_components_with_small_blocks_and_frequent_keys(docs, monkeypatch):
    for name, value in (("BLOCK_NODES", 5), ("FREQUENT", 2), ("DRAWN", 1), ("SALTS", 3), ("FIRST_PARTNERS", 1)):
        monkeypatch.setattr(jaccard_join, name, value)
    rows = corpus(9, bases=12, most=60)
    got = sorted(tuple(r) for r in jaccard_components(docs(rows, 4)).collect())
    assert got == brute_components(rows)


def test_an_empty_round_of_likeliest_partners_does_not_end_the_search(docs, monkeypatch):
    for name, value in (("BLOCK_NODES", 5), ("FREQUENT", 2), ("DRAWN", 1), ("SALTS", 3), ("FIRST_PARTNERS", 0)):
        monkeypatch.setattr(jaccard_join, name, value)
    rounds, search = [], jaccard_join.tree_candidates
    monkeypatch.setattr(jaccard_join, "tree_candidates", lambda *a: rounds.append(a[-1]) or search(*a))
    rows = corpus(9, bases=12, most=60)
    got = sorted(tuple(r) for r in jaccard_components(docs(rows, 4)).collect())
    assert got == brute_components(rows) and rounds == [0, None]


def test_groups_of_which_no_pair_was_left_out_are_searched_once(docs, monkeypatch):
    for name, value in (("BLOCK_NODES", 5), ("FREQUENT", 2), ("DRAWN", 1), ("SALTS", 3), ("FIRST_PARTNERS", 1000)):
        monkeypatch.setattr(jaccard_join, name, value)
    rounds, search = [], jaccard_join.tree_candidates
    monkeypatch.setattr(jaccard_join, "tree_candidates", lambda *a: rounds.append(a[-1]) or search(*a))
    rows = corpus(9, bases=12, most=60)
    got = sorted(tuple(r) for r in jaccard_components(docs(rows, 4)).collect())
    assert got == brute_components(rows) and rounds == [1000]


def test_a_chain_of_edits_is_one_component(docs):
    rng = random.Random(5)
    words, rows = [rng.choice(WORDS) for _ in range(100)], []
    for i in range(30):
        rows.append((100 - i, " ".join(words)))
        words = list(words)
        words[(i * 13) % 100] = f"new{i}"
    found = jaccard_components(docs(rows)).collect()
    assert sorted(tuple(r) for r in found) == brute_components(rows)
    assert {r["component_id"] for r in found} == {71}


def test_odd_rows_of_the_join(odd):
    got = [tuple(r) for r in jaccard_components(odd).collect()]
    assert sorted(got, key=str) == sorted(
        [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (4, 1, 4), (None, 6, None), (5, 1, 5), (6, 1, 6), (7, 1, 7)],
        key=str,
    )


def test_an_empty_table_has_no_components(docs):
    assert jaccard_components(docs([])).count() == 0


@given(st.integers(1, 400))
def test_prefixes_of_linked_sets_meet(n):
    # Two sets of n elements that link share more than n minus the prefix.
    shared = next(s for s in range(n + 1) if similar(s, 2 * n))
    assert n - shared < prefix_size(n)


@given(st.integers(0, 10_000), st.booleans())
@settings(max_examples=20, deadline=None)
def test_tree_pairs_are_all_that_the_bound_allows(seed, across):
    rng = np.random.default_rng(seed)
    sets = []
    for size in (30, 200, 250, 260, 600, 1100):
        base = rng.integers(0, 1 << 63, size, np.uint64)
        for _ in range(20):
            kept = base[rng.random(size) < rng.choice([0.8, 0.95, 1.0])]
            sets.append(np.concatenate((kept, rng.integers(0, 1 << 63, rng.integers(1, 30), np.uint64))))
    n = np.array([len(s) for s in sets])
    component = rng.integers(0, 12, len(sets))
    side = rng.random(len(sets)) < 0.4 if across else None
    own = [count_vector(s) for s in sets]
    i, j, bound = tree_pairs(Counts([v.tobytes() for v in own], n), n, component, side=side)
    got = {(min(a, b), max(a, b)): k for a, b, k in zip(i.tolist(), j.tolist(), bound.tolist(), strict=True)}
    want = {}
    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            groups = min(len(own[a]), len(own[b]))
            low = int(np.minimum(folded(own[a], groups), folded(own[b], groups)).sum())
            assert low >= len(np.intersect1d(sets[a], sets[b]))
            # Boxes of 256 groups may know more of unequal sets than the finer vectors.
            coarse = int(np.minimum(folded(own[a], 256), folded(own[b], 256)).sum())
            apart = component[a] != component[b] and (side is None or side[a] != side[b])
            if apart and similar(min(low, coarse), n[a] + n[b]):
                want[a, b] = low
    assert got == want and len(got) == len(i)


def test_rare_shingles_of_one_bit_are_not_frequent_together(docs, monkeypatch):
    # Four to five shingles a bit, each of one text; two phrases are in three and five texts.
    for module in (decontamination, jaccard_join):
        monkeypatch.setattr(module, "FILTER_BITS", 15, raising=False)
    monkeypatch.setattr(jaccard_join, "DRAWN", 1)
    rows = [(doc, " ".join(f"w{doc}x{k}" for k in range(6000))) for doc in range(24)]
    rows += [(100 + doc, "three of us have these words") for doc in range(3)]
    rows += [(200 + doc, "five texts have this one line here") for doc in range(5)]
    known = WordHashes()
    three, five = ({int(h) & 0x7FFF for h in shingles(rows[at][1].encode(), known)} for at in (24, 27))

    def bits():
        return set(np.flatnonzero(np.unpackbits(frequent_filter(docs(rows, 4), 5), bitorder="little")).tolist())

    assert bits() == three | five
    monkeypatch.setattr(jaccard_join, "MOST_FREQUENT", len(five))
    assert bits() == five


def test_vectors_have_about_as_many_groups_as_shingles():
    assert [groups_of(n) for n in (0, 1, 256, 257, 3000, 1 << 20)] == [256, 256, 256, 512, 4096, 1 << 15]
    crowded = count_vector(np.full(300, 7, np.uint64))
    assert crowded.dtype == np.uint32 and folded(crowded, 256)[7] == 300


def test_count_vectors_travel_in_a_third_of_their_bytes(docs):
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(words)) for words in (1500, 6000)]
    table = docs([(i, text) for i, text in enumerate(texts)])
    bitmap = table.sparkSession.sparkContext.broadcast(np.zeros((1 << decontamination.FILTER_BITS) // 8, np.uint8))
    for row in signatures(table, bitmap, 5, 80).collect():
        own = count_vector(shingles(texts[row["doc_id"]].encode(), WordHashes()))
        assert np.array_equal(unpacked(row["counts"], row["n"]), own)
        assert 3 * len(row["counts"]) < own.nbytes


def test_long_texts_below_the_threshold_are_not_all_compared(docs, monkeypatch):
    # Pages of one template, 120 of 3,030 words, of which any two are alike to about 0.7.
    rng = random.Random(3)
    template = [rng.choice(WORDS) for _ in range(3030)]
    rows = []
    for doc in range(120):
        words = list(template)
        for at in rng.sample(range(3030), 55):
            words[at] = f"own{doc}x{at}"
        rows.append((doc, " ".join(words)))
    rows.append((500, rows[7][1] + " one more"))
    likeness = [len(a & b) / len(a | b) for a, b in ((word_set(rows[i][1]), word_set(rows[i + 1][1])) for i in range(0, 100, 7))]
    assert 0.66 < min(likeness) and max(likeness) < 0.76
    compared, search = [], jaccard_join.link_pairs
    monkeypatch.setattr(jaccard_join, "link_pairs", lambda *a: compared.append(a[2].count()) or search(*a))
    got = sorted(tuple(r) for r in jaccard_components(docs(rows, 4)).collect())
    assert got == brute_components(rows)
    assert sum(compared) < 714


@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40)), max_size=40))
@settings(max_examples=6, deadline=None)
def test_connected_components(spark, edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u != v:
            a, b = find(u), find(v)
            parent[max(a, b)] = min(a, b)
    table = spark.createDataFrame(edges, "u long, v long")
    got = {r["node"]: r["component"] for r in connected_components(table).collect()}
    assert got == {x: find(x) for x in parent}


def test_a_long_chain_has_one_component(spark):
    chain = spark.range(200).selectExpr("id AS u", "id + 1 AS v")
    got = connected_components(chain)
    assert got.count() == 201 and [r[0] for r in got.select("component").distinct().collect()] == [0]


ITEMS = "item_id long, text string"


def test_items_inside_long_documents(spark, docs):
    rng = random.Random(3)
    items = [(i, " ".join(rng.choice(WORDS) for _ in range(n))) for i, n in enumerate([2, 4, 5, 6, 9, 20, 40, 90])]
    items += [(50, None), (51, ""), (52, "  "), (None, "w1 w2 w3 w4 w5 w6")]
    rows = []
    for doc in range(60):
        words = [rng.choice(WORDS) for _ in range(rng.choice([0, 3, 50, 900]))]
        _, text = items[doc % 8]
        inner = edited(rng, text.upper().split(), rng.choice([0, 0, 1, 2, 3])) if doc % 5 else []
        at = rng.randrange(len(words) + 1)
        rows.append((doc, "\n".join(words[:at] + inner + words[at:])))
    rows += [(100 + i, text) for i, text in items if i is not None]
    found = find_items(docs(rows), spark.createDataFrame(items, ITEMS)).collect()
    got = sorted((r["doc_id"], r["item_id"], r["n_item"], r["n_shared"]) for r in found)
    want = []
    for doc, text in rows:
        own = word_set(text)
        for item, wanted in items:
            parts = word_set(wanted)
            if item is not None and parts and 100 * len(own & parts) >= 80 * len(parts):
                want.append((doc, item, len(parts), len(own & parts)))
    assert got == sorted(want) and len(got) > 30


@given(st.integers(1, 500))
def test_a_sketch_cannot_be_missed(n):
    needed = -(-n * 80 // 100)  # shingles that a document must have
    assert n - needed < sketch_size(n, 80) <= n


def test_odd_rows_contain_nothing(spark, odd):
    items = spark.createDataFrame([(1, "nothing of this is anywhere at all"), (1, "one")], ITEMS)
    found = find_items(odd, items.withColumn("doc_id", items["item_id"])).collect()
    assert [(r["doc_id"], r["item_id"], r["containment"]) for r in found] == [(4, 1, 1.0)]


def test_empty_tables_of_items_and_documents(spark, docs):
    none = spark.createDataFrame([], ITEMS)
    some = spark.createDataFrame([(1, "a b c d e f")], ITEMS)
    assert find_items(docs([(1, "a b c d e f")]), none).count() == 0
    assert find_items(docs([]), some).count() == 0
