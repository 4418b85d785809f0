"""Token ids of whole texts, by one dictionary lookup per chunk between white space.

Chunks not seen before are encoded with merges taken from the tokenizer's own file; texts
with a special token's string, with unusual white space or beyond the Latin letters go to
the tokenizer whole.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array

import numpy as np
import pyarrow as pa

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import tiktoken  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

UINT32 = np.dtype("<u4")
# Below this code point letters and numbers are the same in every library, and lower
# case is one to one but for one letter.
LATIN_END = 0x250
NOT_LATIN = re.compile("[^\\x00-\\u024f\\u2010-\\u2027]|[\\x00\\x1c-\\x1f\\x85\\xa0\\u0130]")
# A byte-level tokenizer puts one space in front of what follows; the last character of
# a run of white space before a word stands apart from the run.
SPACED = re.compile(r"[ ]?[^ \t-\r]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+")
# What of these there is in ASCII.
NOT_LATIN_ASCII = ("\0", "\x1c", "\x1d", "\x1e", "\x1f")
END_OF_WORD = "\0"


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _category(kind: str) -> str:
    chars = (c for c in map(chr, range(LATIN_END)) if unicodedata.category(c)[0] == kind)
    return "".join(map(re.escape, chars))


LETTERS, NUMBERS = _category("L"), _category("N")
SUFFIX = "'s|'t|'re|'ve|'m|'ll|'d"
# Pieces inside a chunk without white space but for one leading character.
BYTE_PIECES = re.compile(
    rf"{SUFFIX}| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^ \t-\r{LETTERS}{NUMBERS}]+|[ \t-\r]+"
)
WORD_PIECES = re.compile(rf"{SUFFIX}|[{LETTERS}]+|[{NUMBERS}]|[^ \t-\r{LETTERS}{NUMBERS}]+")


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = sorted(set(range(256)).difference(plain))
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def token_bytes(config: dict) -> dict[bytes, int]:
    """Bytes of each ordinary token to its id; an end of word is a zero byte."""
    letters, end = byte_alphabet(), config["model"].get("end_of_word_suffix") or ""
    special = {t["content"] for t in config.get("added_tokens", ())}

    def as_bytes(token: str) -> bytes:
        tail = end and token.endswith(end) and len(token) > len(end)
        body = token[: -len(end)] if tail else token
        return bytes(letters[c] for c in body) + (END_OF_WORD.encode() if tail else b"")

    return {as_bytes(t): i for t, i in config["model"]["vocab"].items() if t not in special}


def is_latin(text: str) -> bool:
    """No match of ``NOT_LATIN``; ASCII texts are told apart without going through them by it."""
    if text.isascii():
        return not any(c in text for c in NOT_LATIN_ASCII)
    return not NOT_LATIN.search(text)


class ChunkEncoder:
    """Encodes texts as ``Tokenizer.encode(text, add_special_tokens=False)`` does.

    Ids of up to ``max_chunks`` distinct chunks are remembered; then the memory is
    emptied and filled anew.
    """

    def __init__(self, path: str, max_chunks: int = 300_000) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as file:
            config = json.load(file)
        self.special = tuple(t["content"] for t in config.get("added_tokens", ()))
        self.max_chunks = max_chunks
        self.known: dict[str, bytes] = {}
        self.spaced = self.chunkable = False
        pre, model = config.get("pre_tokenizer") or {}, config["model"]
        if model.get("type") != "BPE" or model.get("ignore_merges"):
            return
        if pre.get("type") == "ByteLevel":
            plain = pre.get("use_regex") and not pre.get("add_prefix_space")
            self.spaced = self.chunkable = bool(plain and not config.get("normalizer"))
            pattern = r"[^\r\n]+|[\r\n]+"
        elif pre.get("type") == "Sequence" and model.get("end_of_word_suffix"):
            steps = [n.get("type") for n in (config.get("normalizer") or {}).get("normalizers", ())]
            self.chunkable = steps == ["NFC", "Replace", "Lowercase"]
            pattern = f"[^{END_OF_WORD}]+{END_OF_WORD}"
        if self.chunkable:
            self.bpe = tiktoken.Encoding(
                os.path.basename(path),
                pat_str=BYTE_PIECES.pattern if self.spaced else pattern,
                mergeable_ranks=token_bytes(config),
                special_tokens={},
            )
            if not self.spaced:
                tail = END_OF_WORD.encode()
                self.ends = np.zeros(len(config["model"]["vocab"]), bool)
                self.ends[[i for t, i in token_bytes(config).items() if t.endswith(tail)]] = True

    def whole(self, text: str) -> np.ndarray:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, UINT32)

    def chunk(self, chunk: str) -> bytes:
        return array("I", self.bpe.encode_ordinary(chunk)).tobytes()

    def learn(self, words: list[str]) -> None:
        """Remember the ids of new words, encoded at once and told apart by the tokens that
        end one."""
        if len(self.known) + len(words) > self.max_chunks:
            self.known.clear()
        ids = np.array(self.bpe.encode_ordinary(END_OF_WORD.join(words) + END_OF_WORD), UINT32)
        stops = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
        raw = ids.tobytes()
        for word, a, b in zip(words, [0, *stops], stops, strict=False):
            self.known[word] = raw[a:b]

    def words(self, text: str) -> np.ndarray:
        """The ids of a text whose words are encoded one by one."""
        words = WORD_PIECES.findall(text.lower())
        found = list(map(self.known.get, words))
        new = [at for at, ids in enumerate(found) if ids is None]
        if new:
            self.learn(list({words[at] for at in new}))
            for at in new:
                found[at] = self.known[words[at]]
        return np.frombuffer(b"".join(found), UINT32)

    def encode(self, text: str) -> np.ndarray:
        if (
            not self.chunkable
            or not is_latin(text)
            or ("<|" in text and any(s in text for s in self.special))
        ):
            return self.whole(text)
        if not self.spaced:
            return self.words(text)
        chunks = cut(text)
        known = self.known
        new = set(chunks).difference(known)
        if new:
            if len(known) + len(new) > self.max_chunks:
                known.clear()
                new = set(chunks)
            for chunk in new:
                known[chunk] = self.chunk(chunk)
        return np.frombuffer(b"".join(map(known.__getitem__, chunks)), UINT32)


def cut(text: str) -> list[str]:
    """The text in chunks that begin with their white space."""
    for run in ("  ", "\n\n", " \n", "\n ", "\t", "\r", "\v", "\f"):
        if run in text:
            return SPACED.findall(text)
    chunks = text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")
    return chunks if chunks[0] else chunks[1:]


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """This worker's encoder of a tokenizer file; made once."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def long_array(values) -> pa.Array:
    return pa.array(values, pa.int64())
