"""Token counts by prefix: how many tokens every prefix of a text has.

A prefix's byte-pair encoding ends in exactly one token that fits the encoding of what is
before it. So one pass from left to right over a piece of text finds the last token of
each prefix, and from it the number of tokens: ``count[i] = count[i - len(last)] + 1``.
The table of a text answers how many tokens its first k characters have, and how many
characters a budget of tokens holds, without encoding again.
"""

from __future__ import annotations

import json
import re
from array import array
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from pricetide.llm.encoding import (
    BYTE_PIECES,
    NOT_LATIN,
    Tokenizer,
    cut,
    long_array,
    token_bytes,
    tokenizer_path,
)
from pricetide.llm.text import map_arrow, strings

COUNT = np.dtype("<u4")
RUN_BEFORE_WORD = re.compile(r"[ \t-\r]{2,}(?=[^ \t-\r])")
# Pieces share the results of so many first bytes.
HEAD_BYTES = 7
CUT_CONTRACTIONS = ("'re", "'ve", "'ll")


class PrefixCounter:
    """Prefix token counts under a byte-level BPE file without a normaliser."""

    def __init__(self, path: str, max_chunks: int = 250_000, max_pairs: int = 1_000_000) -> None:
        with open(path, encoding="utf-8") as file:
            config = json.load(file)
        pre = config.get("pre_tokenizer") or {}
        if pre.get("type") != "ByteLevel" or not pre.get("use_regex") or config.get("normalizer"):
            raise ValueError("prefix counts need a byte-level tokenizer without a normalizer")
        self.pieces = Tokenizer.from_file(path).pre_tokenizer
        special = [t["content"] for t in config.get("added_tokens", ())]
        self.at_special = re.compile("|".join(map(re.escape, special)) or "(?!)")
        ids = token_bytes(config)
        self.tokens = {i: t for t, i in ids.items()}
        self.bpe = tiktoken.Encoding(
            "prefixes", pat_str=r"[\s\S]+", mergeable_ranks=ids, special_tokens={}
        )
        # Finds every token that ends at a byte, the longest first.
        self.endings = ahocorasick.Automaton()
        for token, i in ids.items():
            self.endings.add_word(token.decode("latin-1"), (i, len(token)))
        self.endings.make_automaton()
        self.max_chunks, self.max_pairs = max_chunks, max_pairs
        self.fits: dict[int, bool] = {}
        self.chunks: dict[str, bytes] = {}
        self.heads: dict[bytes, tuple[list[int], list[int]]] = {}
        self.max_heads = max_chunks // 2

    def adjoin(self, key: int, left: int, right: int) -> bool:
        """Whether the two tokens can stand next to each other in an encoding."""
        if len(self.fits) >= self.max_pairs:
            self.fits.clear()
        both = (self.tokens[left] if left >= 0 else b"") + self.tokens[right]
        ids = self.bpe._encode_single_piece(both)  # the merges of a few bytes
        fits = self.fits[key] = ids == ([left, right] if left >= 0 else [right])
        return fits

    def piece_counts(self, piece: bytes) -> list[int]:
        """Tokens of ``piece[:i]`` for i from 0 to its length."""
        head = piece[:HEAD_BYTES]
        known = self.heads.get(head)
        if known is None:
            if len(self.heads) >= self.max_heads:
                self.heads.clear()
            known = self.heads[head] = self._extend([-1], [0], head)
        return known[1] if len(piece) <= HEAD_BYTES else self._extend(*known, piece)[1]

    def _extend(
        self, last: list[int], counts: list[int], piece: bytes
    ) -> tuple[list[int], list[int]]:
        """Last tokens and counts of all prefixes, from those of the first ones."""
        solved = len(last) - 1
        more = len(piece) - solved
        last, counts = last + [-1] * more, counts + [0] * more
        fits = self.fits
        for end, (token, length) in self.endings.iter(piece.decode("latin-1")):
            if end < solved:
                continue
            start = end + 1 - length
            left = last[start]
            key = (left + 1) << 20 | token
            ok = fits.get(key)
            if ok is None:
                ok = self.adjoin(key, left, token)
            if ok:
                solved = end + 1
                last[solved] = token
                counts[solved] = counts[start] + 1
        return last, counts

    def chunk_counts(self, chunk: str) -> bytes:
        """Tokens of every prefix of a chunk, by characters, as 32-bit integers."""
        if NOT_LATIN.search(chunk):
            spans = [span for _, span in self.pieces.pre_tokenize_str(chunk)]
            pieces = [chunk[start:end] for start, end in spans]
        else:
            pieces = BYTE_PIECES.findall(chunk)
        out: list[int] = []
        before = 0
        for piece in pieces:
            counts = self.piece_counts(piece.encode())
            if piece.isascii():
                ends = counts[1:]
            else:
                ends = [counts[n] for n in accumulate(len(c.encode()) for c in piece)]
            if piece in CUT_CONTRACTIONS:  # cut short, its letter is a piece of its own
                ends = [1, 2, ends[2]]
            out += [before + n for n in ends] if before else ends
            before += counts[-1]
        return array("I", out).tobytes()

    def chunk(self, chunk: str) -> bytes:
        found = self.chunks.get(chunk)
        if found is None:
            if len(self.chunks) >= self.max_chunks:
                self.chunks.clear()
            found = self.chunks[chunk] = self.chunk_counts(chunk)
        return found

    def _plain(self, text: str) -> np.ndarray:
        """The table of a text without special tokens."""
        if not text:
            return np.empty(0, COUNT)
        if NOT_LATIN.search(text):
            return self._by_library(text)
        chunks = cut(text)
        counts = np.frombuffer(b"".join([self.chunk(c) for c in chunks]), COUNT)
        lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
        base = np.cumsum(counts[np.cumsum(lengths) - 1])
        table = counts + np.repeat(np.concatenate(([0], base[:-1])), lengths).astype(COUNT)
        for run in RUN_BEFORE_WORD.finditer(text):
            # At the end of a prefix the whole run is one piece.
            start, end = run.span()
            whole = self.piece_counts(run[0].encode())[-1]
            table[end - 1] = (table[start - 1] if start else 0) + whole
        return table

    def _by_library(self, text: str) -> np.ndarray:
        """The same with the tokenizer's own pieces."""
        table = np.frombuffer(self.chunk_counts(text), COUNT).copy()
        start = 0
        for _, (_, end) in self.pieces.pre_tokenize_str(text):
            # A piece of white space goes on with the first character of the next one.
            run = text[start : end + 1]
            if end < len(text) and len(run) > 1 and self.is_one_piece(run):
                table[end] = (table[start - 1] if start else 0) + self.piece_counts(run.encode())[-1]
            start = end
        return table

    def is_one_piece(self, run: str) -> bool:
        return len(self.pieces.pre_tokenize_str(run)) == 1 and not run[0].isalnum()

    def table(self, text: str) -> np.ndarray:
        """Tokens of ``text[:k]`` at place k - 1, for every k up to the text's length."""
        parts, base, at = [], 0, 0
        for found in self.at_special.finditer(text):
            # Before its last character a special string is ordinary text.
            part = self._plain(text[at : found.end() - 1])
            parts.append(part + np.uint32(base))
            base += (int(part[found.start() - at - 1]) if found.start() > at else 0) + 1
            parts.append(np.array([base], COUNT))
            at = found.end()
        parts.append(self._plain(text[at:]) + np.uint32(base))
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


def count_tokens(
    df: DataFrame,
    limit: int = 512,
    first_chars: int = 1000,
    keep_table: bool = False,
    path: str | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Exact token counts from the prefix table of every text.

    Returns ``doc_id``, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit``
    (``n_tokens > limit``), ``fit_chars`` (characters of the longest prefix of at most
    ``limit`` tokens), ``first_tokens`` (tokens of the first ``first_chars`` characters),
    and with ``keep_table`` the table itself as little-endian 32-bit integers.

    A null or empty text has no tokens. Rows stay one by one, so repeated rows and null
    ids come out as often as they go in; other columns are not read. ``path`` is a
    byte-level tokenizer file on every worker, by default the public 50k one.
    """
    schema = (
        "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long, "
        "first_tokens long" + (", prefix_counts binary" if keep_table else "")
    )

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts = counter(path or tokenizer_path("byte_bpe_50k.json"))
        texts = strings(batch.column(1))
        tables = [counts.table(t) for t in texts]
        totals = [int(t[-1]) if len(t) else 0 for t in tables]
        fits = [np.flatnonzero(t <= limit) for t in tables]
        out = [
            batch.column(0),
            long_array([len(t.encode()) for t in texts]),
            long_array(totals),
            pa.array([n > limit for n in totals]),
            long_array([int(f[-1]) + 1 if len(f) else 0 for f in fits]),
            long_array([int(t[min(len(t), first_chars) - 1]) if len(t) else 0 for t in tables]),
        ]
        if keep_table:
            out.append(pa.array([t.tobytes() for t in tables], pa.binary()))
        names = [part.split()[0] for part in schema.split(", ")]
        return pa.RecordBatch.from_arrays(out, names=names)

    return map_arrow(df.select(df[doc_id].cast("long"), df[text]), rows, schema)
