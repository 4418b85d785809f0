from __future__ import annotations

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pricetide.llm.encoding import NOT_LATIN, Tokenizer, encoder, is_latin, tokenizer_path
from pricetide.llm.packing import best_fit, cut_lengths, pack_documents, pack_sizes
from pricetide.llm.token_binary import (
    BLOCK,
    pack,
    read_token_file,
    token_round_trip,
    unpack,
    unpack_block,
    write_token_file,
)
from pricetide.llm.token_counts import count_tokens, counter

BYTE, WORD = "byte_bpe_50k.json", "word_bpe_49k.json"
PARTS = (
    ["the", " ", "  ", "\n", "\n\n", " \n", "\t", "\r\n", "'re", "'ll", "'s", "x", "É", "ß", "1", "23"]
    + ["!!", "...", "<|endoftext|>", "<|endo", "日本", "🎉", "And", " on", "\xa0", "\x1c", "\x00", "'", "aaaa", "İ"]
)
TEXTS = st.lists(st.sampled_from(PARTS), max_size=14).map("".join) | st.text(max_size=30)


def library(name):
    tokenizer = Tokenizer.from_file(tokenizer_path(name))
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


BYTE_IDS, WORD_IDS = library(BYTE), library(WORD)


@given(TEXTS)
@settings(max_examples=300, deadline=None)
def test_ids_are_the_library_s(text):
    assert encoder(tokenizer_path(BYTE)).encode(text).tolist() == BYTE_IDS(text)
    assert encoder(tokenizer_path(WORD)).encode(text).tolist() == WORD_IDS(text)


def test_what_is_latin_of_every_character():
    for c in map(chr, [*range(0x3000), 0xD7FF, 0xE000, 0xFFFF, 0x1F389]):
        for text in (c, f"a{c}b", f"é{c}"):
            assert is_latin(text) == (NOT_LATIN.search(text) is None)
    assert is_latin("")


@given(TEXTS)
@settings(max_examples=200, deadline=None)
def test_every_prefix_has_its_exact_count(text):
    table = counter(tokenizer_path(BYTE)).table(text)
    assert table.tolist() == [len(BYTE_IDS(text[:k])) for k in range(1, len(text) + 1)]


def test_counts_of_odd_rows(odd):
    got = count_tokens(odd, keep_table=True).collect()
    want = {(r["doc_id"], r["text"] or "") for r in odd.collect()}
    assert len(got) == odd.count()
    by_id = {r["doc_id"]: r for r in got}
    for doc, text in want:
        row = by_id[doc]
        n = len(BYTE_IDS(text))
        assert (row["n_bytes"], row["n_tokens"], row["over_limit"]) == (len(text.encode()), n, n > 512)
        counts = np.frombuffer(row["prefix_counts"], "<u4")
        fits = np.flatnonzero(counts <= 512)  # counts may fall, so this is the last one
        assert row["fit_chars"] == (fits[-1] + 1 if len(fits) else 0)
        assert row["first_tokens"] == len(BYTE_IDS(text[:1000]))


def test_counts_of_an_empty_table(docs):
    assert count_tokens(docs([])).count() == 0


@given(
    st.lists(st.integers(0, 300), max_size=40).flatmap(
        lambda runs: st.tuples(st.just(runs), st.sampled_from([0, 1, 3, 200, 40_000, 2**31, 2**62]))
    )
)
@settings(max_examples=100, deadline=None)
def test_words_round_trip(case):
    runs, top = case
    ids = np.concatenate([np.full(r, (i * 7919) % (top + 1), np.uint64) for i, r in enumerate(runs)] or [[]])
    words, offsets, escapes = pack(ids)
    assert (unpack(words, offsets, escapes, len(ids)) == ids.astype(np.uint64)).all()


def test_a_block_alone():
    ids = np.arange(5000, dtype=np.uint64) * 37 % 49_408
    words, offsets, escapes = pack(ids)
    assert (unpack_block(words, offsets, escapes, 2) == ids[2 * BLOCK : 3 * BLOCK]).all()
    assert len(words) * 8 < len(ids) * 4


def test_token_file_of_odd_rows(odd, spark, tmp_path):
    write_token_file(odd, str(tmp_path / "t"))
    got = read_token_file(spark, str(tmp_path / "t"), keep_ids=True).orderBy("start").collect()
    rows = sorted(
        ((r["doc_id"], r["text"] or "") for r in odd.collect()),
        key=lambda r: (r[0] is not None, r[0] or 0, r[1]),
    )
    start = 0
    for row, (doc, text) in zip(got, rows, strict=True):
        ids = np.array([*WORD_IDS(text), 1], "<u4")
        assert (row["doc_id"], row["start"], row["n_tokens"]) == (doc, start, len(ids))
        assert bytes(row["ids"]) == ids.tobytes() and row["ids_crc32"] == zlib.crc32(ids.tobytes())
        start += len(ids)


def test_token_file_of_an_empty_table(docs):
    assert token_round_trip(docs([])).count() == 0


def test_pieces_but_the_first_are_full():
    assert cut_lengths(1, 8) == [1] and cut_lengths(8, 8) == [8] and cut_lengths(19, 8) == [3, 8, 8]


@given(st.lists(st.integers(1, 64), max_size=60))
@settings(max_examples=150, deadline=None)
def test_local_search_keeps_all_and_never_adds_bins(sizes):
    bins = pack_sizes(sizes, 64)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= 64 for b in bins)
    assert len(bins) <= len(best_fit(sizes, 64))


def test_local_search_empties_bins_that_best_fit_leaves():
    sizes = [44, 24, 24, 22, 21, 17, 8, 8, 6, 6]  # 180 in sequences of 60
    assert len(best_fit(sizes, 60)) == 4 and len(pack_sizes(sizes, 60)) == 3


def test_too_large_sizes_are_refused():
    with pytest.raises(ValueError, match="exceeds"):
        pack_sizes([9], 8)


def check_packing(pieces, rows, capacity):
    by_doc = {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
    want = {}
    for doc, text in rows:
        want.setdefault(doc, []).append([*BYTE_IDS(text or ""), 2])
    assert by_doc.keys() == want.keys()
    for doc, copies in want.items():
        found = sorted((p["start"], p["length"], p["ids_crc32"]) for p in by_doc[doc])
        expected = []
        for ids in copies:
            start = 0
            for length in cut_lengths(len(ids), capacity):
                own = np.array(ids[start : start + length], "<u4")
                expected.append((start, length, zlib.crc32(own.tobytes())))
                start += length
        assert found == sorted(expected)
    sequences = {}
    for p in pieces:
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_packed_odd_rows(odd):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    check_packing(pack_documents(odd).collect(), rows, 1024)


def test_packing_is_tight_over_several_groups(docs):
    rows = [(i, "word " * (i * 37 % 90)) for i in range(400)]
    pieces = pack_documents(docs(rows), capacity=64, group_pieces=150).collect()
    total = sum(p["length"] for p in pieces)
    assert check_packing(pieces, rows, 64) <= -(-total // 64) * 1.03 + 3


def test_packing_an_empty_table(docs):
    assert pack_documents(docs([])).count() == 0
