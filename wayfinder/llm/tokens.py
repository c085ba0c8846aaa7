"""Exact tokenisation with a word cache.

The tokenizer drops white space and never merges across it, so a text's ids are the ids of its blank-separated pieces
in order. Each distinct piece is encoded once by the tokenizers library and remembered within a bound of bytes; what has
not been asked for lately is forgotten first. Pieces of letters only are encoded many at a time and cut after the ids
that end a word, if there are as many of these as pieces. A tokenizer that always cuts between a letter and punctuation
behind it gets a blank there, so that words are not encoded anew with every mark that follows them.
"""

from __future__ import annotations

import functools
import os
from array import array
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from wayfinder.llm.common import SPACED, SPACED_LOWER, flat_bytes, of_bytes, release, whole, words_in

CACHE_BYTES = 60_000_000
ENTRY_BYTES = 180
#: Pieces of letters that are encoded in one string.
TOGETHER = 256
#: ASCII punctuation but for the apostrophe, which may begin an ending such as 's.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
IS_MARK = np.isin(np.arange(256), np.frombuffer(MARKS.encode(), np.uint8))
IS_LETTER = np.isin(np.arange(256) | 0x20, np.arange(0x61, 0x7B)) & (np.arange(256) < 0x80)
#: Last bytes of the letters U+00C0 to U+00FF, whose first byte is 0xC3.
IS_LATIN_END = (np.arange(256) >= 0x80) & (np.arange(256) < 0xC0) & ~np.isin(np.arange(256), (0x97, 0xB7))
def cut_marks(data: bytes, offsets: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Texts, laid end to end, with a blank between a letter and a mark behind it."""
    flat = np.frombuffer(data, np.uint8)
    marks = np.flatnonzero(IS_MARK[flat])
    before, first = flat[np.maximum(marks - 1, 0)], flat[np.maximum(marks - 2, 0)]
    at = marks[(IS_LETTER[before] | (IS_LATIN_END[before] & (first == 0xC3))) & (marks > 0)]  # a blank at a text's end does no harm
    wide = np.full(len(flat) + len(at), 0x20, np.uint8)
    letters = np.ones(len(wide), bool)
    letters[at + np.arange(len(at))] = False
    wide[letters] = flat
    return wide.tobytes(), offsets + np.searchsorted(at, offsets)


class PieceEncoder:
    """Encodes UTF-8 texts to little-endian unsigned 16-bit ids; vocabularies over 65,536 ids are refused."""

    def __init__(self, tokenizer_path: str, cache_bytes: int = CACHE_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids are kept in 16 bits; this vocabulary is larger")
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = np.zeros(1 << 16, bool)
        vocab = self.tokenizer.get_vocab()
        if suffix and all(c + suffix in vocab for c in ByteLevel.alphabet()):  # no piece is dropped as unknown
            self.ends[[i for x, i in vocab.items() if x.endswith(suffix)]] = True
        self.grouped = bool(self.ends.any())
        # a text that holds an added token is left as it is written, but for blanks
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        same = lambda x, y: self.tokenizer.encode(x, add_special_tokens=False).ids == self.tokenizer.encode(y, add_special_tokens=False).ids
        self.lowers = all(same(chr(c), chr(c).lower()) for c in range(0x41, 0x5B))
        self.cuts = all(same(f"a{c}b", f"a {c}b") for c in MARKS)
        self.generation = cache_bytes // 2
        self.forget()

    def forget(self) -> None:
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.room = self.generation

    def ids_of(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces. New ones enter ``young``; when that is full it becomes ``old`` and the old one goes."""
        out = list(map(self.young.get, pieces))
        missing = [i for i, ids in enumerate(out) if ids is None]
        if missing:
            found = {pieces[i]: self.old.get(pieces[i]) for i in missing}
            found |= self.encode_words([x for x, ids in found.items() if ids is None])
            for i in missing:
                out[i] = found[pieces[i]]
            need = ENTRY_BYTES * len(found) + 3 * sum(map(len, found))
            if need > self.room:
                self.old, self.young, self.room = self.young, {}, self.generation
            self.young |= found
            self.room -= need
        return out

    def encode_words(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids by piece. Each piece ends a word at least once, so equal numbers mean exactly once each."""
        out: dict[str, bytes] = {}
        letters = [x for x in pieces if x.isalpha()] if self.grouped else []
        apart = [x for x in pieces if not x.isalpha()] if self.grouped else list(pieces)
        groups = [letters[i : i + TOGETHER] for i in range(0, len(letters), TOGETHER)]
        joined = self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)
        for group, found in zip(groups, joined, strict=True):
            data = array("H", found.ids).tobytes()
            cuts = (2 * (np.flatnonzero(self.ends[np.frombuffer(data, np.uint16)]) + 1)).tolist()
            if len(cuts) == len(group) and cuts[-1] == len(data):
                out.update(zip(group, map(data.__getitem__, map(slice, [0, *cuts[:-1]], cuts)), strict=True))
            else:
                apart += group
        alone = self.tokenizer.encode_batch_fast(apart, add_special_tokens=False)
        out.update((x, array("H", found.ids).tobytes()) for x, found in zip(apart, alone, strict=True))
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and where each text's begin (with the end of the last); a null has none."""
        texts = whole(texts)
        made = flat_bytes(texts, SPACED_LOWER if self.lowers else SPACED)
        made = of_bytes(*(cut_marks(*made) if self.cuts else made))
        odd = functools.reduce(pc.or_, (pc.match_substring(texts, x, ignore_case=True) for x in self.added), pc.is_null(texts))
        if pc.any(odd).as_py():
            made = pc.if_else(odd, of_bytes(*flat_bytes(texts, SPACED)), made)
        words, which, at = words_in(made)
        known = self.ids_of(words.tolist())
        size = np.fromiter(map(len, known), np.int64, len(known)) // 2
        ids, begin = np.frombuffer(b"".join(known), "<u2"), np.cumsum(size) - size
        of_piece = size[which]
        ends = np.concatenate(([0], np.cumsum(of_piece)))
        flat = ids[np.arange(ends[-1]) + np.repeat(begin[which] - ends[:-1], of_piece)]
        return flat, ends[at]


_encoders: dict[str, PieceEncoder] = {}


@contextmanager
def encoder(tokenizer_path: str) -> Iterator[PieceEncoder]:
    """The tokenizer is loaded once for each Python worker; what it has learned goes with the task, since idle workers stay for later stages."""
    if tokenizer_path not in _encoders:
        _encoders.clear()
        _encoders[tokenizer_path] = PieceEncoder(tokenizer_path)
    try:
        yield _encoders[tokenizer_path]
    finally:
        _encoders[tokenizer_path].forget()
        release()


def squeeze(ids: bytes) -> bytes:
    return pa.compress(ids, codec="zstd", asbytes=True)


def unsqueeze(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, decompressed_size=2 * n, codec="zstd"), dtype="<u2") if n else np.empty(0, "<u2")
