"""Vector codes, ranked search and repeated passages against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pricetide.llm.lexical_search import search_items, terms
from pricetide.llm.substring_dedup import Pieces, SuffixTree, dedup_passages, later_windows, word_codes
from pricetide.llm.vector_codes import CoverTree, code_vectors

WORDS = [f"w{i}" for i in range(400)]
SPACE = "[^\\x20\\x09-\\x0D]+"


# Vector codes


def brute_codes(rows, parts=8, entries=16, rounds=6):
    kept = [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    whole = [[math.floor(4096 * x) for x in v] for _, v, _ in kept]
    size = len(whole[0]) // parts
    cut = [[v[p * size : (p + 1) * size] for p in range(parts)] for v in whole]
    books = [[list(cut[i][p]) for i in range(min(entries, len(cut)))] for p in range(parts)]

    def nearest(book, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups: dict[int, list] = {}
            for row in cut:
                groups.setdefault(nearest(books[p], row[p])[1], []).append(row[p])
            for k, group in groups.items():
                books[p][k] = [sum(x) // len(group) for x in zip(*group, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out = []
    for (i, _, lab), row in zip(kept, cut, strict=True):
        found = [nearest(books[p], row[p]) for p in range(parts)]
        out.append((i, lab, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
    totals = Counter()
    for _, lab, _, error in out:
        totals[lab] += error
    return sorted(((i, code, error, totals[lab], digest) for i, lab, code, error in out), key=str)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)


@pytest.mark.parametrize("spread", [0.0, 0.01, 1.0])
def test_codes_are_those_of_all_comparisons(spark, spread):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(7, 16))
    rows = []
    for i in range(300):
        v = (centres[i % 7] + spread * rng.normal(size=16)).tolist()
        rows.append((i * 3, v, None if i % 5 == 0 else i % 3))
    rows += [(7, None, 1), (8, [None] * 16, 1), (9, [float("nan")] + [0.0] * 15, 1), (10, [math.inf] * 16, None)]
    rows += [rows[20], rows[20], (None, rows[0][1], 2), (None, [0.0] * 16, 2)]
    got = code_vectors(vectors(spark, rows), block_rows=64).collect()
    assert sorted(map(tuple, got), key=str) == brute_codes(rows)


def test_few_vectors_and_none(spark):
    rows = [(3, [0.5] * 8, 1), (1, [0.25, -0.25] * 4, 1)]
    table = vectors(spark, rows)
    for name in ("trees", "at", "total", "code", "vector", "of"):
        table = table.withColumn(name, table["vec_id"])
    assert sorted(map(tuple, code_vectors(table).collect()), key=str) == brute_codes(rows)
    assert code_vectors(table.limit(0)).count() == 0
    with pytest.raises(ValueError, match="equal parts"):
        code_vectors(vectors(spark, [(1, [1.0] * 9, 1)]))
    assert code_vectors(vectors(spark, [(1, [1.0] * 8, 1), (2, [1.0] * 16, 1), (3, [], 1)])).count() == 1


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 200), st.sampled_from([1, 3, 40, 10**5]))
def test_cover_trees(seed, n, reach):
    rng = np.random.default_rng(seed)
    points = rng.integers(-reach, reach, size=(n, 3))
    tree = CoverTree(points)
    assert sorted(tree.order.tolist()) == list(range(n))
    for (centre, start, stop, first, count), radius, total in zip(tree.nodes, tree.radius, tree.sums, strict=True):
        own = points[tree.order[start:stop]]
        assert (own.sum(axis=0) == total).all() and len(own)
        assert np.isclose(np.sqrt(((own - points[centre]) ** 2).sum(axis=1).max()), radius)
        below = tree.nodes[first : first + count]
        if count:
            assert below[0, 1] == start and below[-1, 2] == stop and (below[1:, 1] == below[:-1, 2]).all()
    book = rng.integers(-reach, reach, size=(5, 3))
    codes, total, compared = CoverTree.unpacked(tree.packed(), 3).assign(book)
    away = ((points[:, None] - book[None]) ** 2).sum(axis=2)
    assert (codes == away.argmin(axis=1)).all()
    assert (total[:, -1] == np.bincount(codes, minlength=5)).all()
    assert all((total[k, :-1] == points[codes == k].sum(axis=0)).all() for k in range(5))
    assert compared <= n


def test_most_vectors_are_assigned_with_their_node():
    rng = np.random.default_rng(1)
    centres = rng.integers(-4000, 4000, size=(8, 8))
    points = centres[rng.integers(0, 8, 2000)] + rng.integers(-20, 20, size=(2000, 8))
    _, _, compared = CoverTree(points).assign(centres)
    assert compared == 0


# Ranked search


def brute_terms(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", lower)


@given(st.text())
def test_terms(text):
    assert [t.decode() for t in terms(text.encode("utf-8", "ignore"))] == brute_terms(text.encode("utf-8", "ignore").decode())


def brute_search(docs, items, k=10):
    bags = [(d, brute_terms(t)) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    n_docs, words = len(bags), sum(len(b) for _, b in bags)
    df = Counter(t for _, b in bags for t in set(b))
    out = []
    for item, text in items:
        scores = []
        for doc, bag in bags:
            tf, m, score = Counter(bag), 25 + 75 * len(bag) * n_docs // words, 0
            for t in brute_terms(text):
                if t in tf:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * (10**9 * tf[t] // (1000 * tf[t] + 8 * m))
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        out += [(item, r, s[3], -s[0]) for r, s in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def some_docs(seed, n=150):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [rng.choice(WORDS[: rng.choice([5, 40, 400])]) for _ in range(rng.choice([0, 1, 2, 30, 200]))]
        rows.append((i * 7 % 1000, rng.choice([" ", "\n", ", "]).join(words).upper() if i % 3 else " ".join(words)))
    copy = "the w1 w2 same w3 text"
    return rows + [(2000 + i, copy) for i in range(40)] + [(None, copy), (2001, copy), (5, None), (6, ""), (7, "-!?")]


@pytest.mark.parametrize("blocks", [{}, {"block_items": 2}, {"block_terms": 9}])
def test_search_is_what_all_scores_give(docs, spark, blocks):
    rows, rng = some_docs(1), random.Random(2)
    items = [(i, " ".join(rng.choice(WORDS[:60]) for _ in range(rng.choice([1, 3, 12])))) for i in range(8)]
    items += [(20, None), (21, ""), (22, "never seen"), (23, "w1 w1 W1 w2"), (None, "w3 same")]
    table = spark.createDataFrame(items, "item_id long, text string")
    for name in ("item", "doc", "rank", "bag", "score"):
        table = table.withColumn(name, table["item_id"])
    got = search_items(docs(rows, 5), table, **blocks).collect()
    assert sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got), key=str) == brute_search(rows, items)


def test_search_of_odd_rows(odd, docs, spark):
    items = spark.createDataFrame([(1, "one 日本語 naïve word x")], "item_id long, text string")
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = search_items(odd, items).collect()
    assert sorted(map(tuple, got), key=str) == brute_search(rows, [(1, "one 日本語 naïve word x")])
    assert search_items(docs(rows[:1]).limit(0), items).count() == 0
    assert search_items(odd, items.limit(0)).count() == 0


# Repeated passages


def brute_passages(rows, window=20):
    """Rows must have different ids. Null ids come last."""
    split = [(d, re.findall(SPACE, t or "")) for d, t in rows]
    seen: dict[tuple, tuple] = {}
    for d, words in sorted(split, key=lambda r: (r[0] is None, r[0] or 0)):
        for i in range(len(words) - window + 1):
            seen.setdefault(tuple(words[i : i + window]), (d, i))
    out = []
    for d, words in split:
        gone = set()
        for i in range(len(words) - window + 1):
            if seen[tuple(words[i : i + window])] != (d, i):
                gone.update(range(i, i + window))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((d, kept, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def passages(seed):
    rng = random.Random(seed)
    shared = [[rng.choice(WORDS) for _ in range(rng.choice([19, 20, 21, 60]))] for _ in range(6)]
    rows, texts = [], []
    for i in range(60):
        words = [rng.choice(WORDS) for _ in range(rng.choice([0, 5, 19, 20, 80, 300]))]
        for _ in range(rng.choice([0, 0, 1, 2])):
            at = rng.randrange(len(words) + 1)
            words[at:at] = rng.choice(shared)
        if i % 9 == 8:
            words = list(texts[rng.randrange(len(texts))])
            if words and rng.random() < 0.5:
                words[rng.randrange(len(words))] = "edited"
        if i % 20 == 5:
            words = ["a", "b"] * 30 + words
        texts.append(words)
        rows.append((1000 - i * 7, rng.choice([" ", "\n", " \t "]).join(words)))
    return [*rows, (None, " ".join(shared[0])), (3, None), (4, ""), (5, "x " * 3000)]


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("how", [{}, {"group_pieces": 2}, {"most_bits": 0}])
def test_passages_are_those_of_all_windows(docs, seed, how):
    rows = passages(seed)
    got = dedup_passages(docs(rows, 4), **how).drop("removed").collect()
    assert sorted(map(tuple, got), key=str) == brute_passages(rows)


def test_passages_of_odd_rows(odd, docs):
    got = {(r["doc_id"], r["n_words"], r["n_removed"]) for r in dedup_passages(odd).collect()}
    assert got == {(1, 0, 0), (2, 0, 0), (3, 0, 0), (4, 1, 0), (None, 10, 0), (5, 5, 0), (6, 20_000, 19_999), (7, 1, 0)}
    copy = " ".join(WORDS[:30])
    # Rows with the same id and text are one document, and rows without an id are the last.
    rows = [(1, copy), (1, copy), (2, copy), (None, copy), (None, copy)]
    got = sorted(((r["doc_id"], r["n_removed"]) for r in dedup_passages(docs(rows)).collect()), key=str)
    assert got == [(1, 0), (1, 0), (2, 30), (None, 30), (None, 30)]
    assert dedup_passages(docs(rows).limit(0)).count() == 0


def test_stretches_name_what_went(docs):
    words = WORDS[:50]
    rows = [(1, " ".join(words)), (2, " ".join(["x", *words[10:40], "y", *words[:20]]))]
    got = {r["doc_id"]: r for r in dedup_passages(docs(rows)).collect()}
    assert got[1]["removed"] == [] and got[1]["text"] == " ".join(words)
    assert [tuple(s) for s in got[2]["removed"]] == [(1, 31), (32, 52)] and got[2]["text"] == "x y"


@given(st.lists(st.sampled_from("abc"), min_size=1, max_size=40), st.integers(2, 6))
def test_suffix_tree_has_all_repeats(words, least):
    tree = SuffixTree()
    for at in range(len(words) - least + 1):
        tree.add(words, at, at)
    groups: dict[tuple, list] = {}
    for at in range(len(words) - least + 1):
        groups.setdefault(tuple(words[at : at + least]), []).append(at)
    assert sorted(map(sorted, tree.deep(least))) == sorted(g for g in groups.values() if len(g) > 1)


def test_later_windows():
    a, b = b"a b c d e", b"x b c d e"
    assert later_windows([(a, (1, 0, 0)), (b, (2, 0, 0))], 3) == [bytearray([0, 0, 0]), bytearray([0, 1, 1])]
    assert later_windows([(a, (3, 0, 0)), (b, (2, 0, 0))], 3) == [bytearray([0, 1, 1]), bytearray([0, 0, 0])]


@given(st.lists(st.text(alphabet="ab \t\n\x0b\x85é", max_size=30), min_size=1, max_size=5))
def test_words_and_their_codes(texts):
    data = "\n".join(texts).encode()
    starts, ends, codes = word_codes(data)
    words = [data[a:b] for a, b in zip(starts, ends, strict=True)]
    assert words == [w.encode() for w in re.findall(SPACE, data.decode())]
    assert len(set(codes.tolist())) == len(set(words))
    pieces = Pieces([t.encode() for t in texts], 3)
    total = sum(max(0, len(re.findall(SPACE, t)) - 2) for t in texts)
    assert (pieces.last - pieces.first + 1).sum() == total
