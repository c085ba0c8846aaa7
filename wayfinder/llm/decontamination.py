"""Benchmark decontamination with one Aho-Corasick automaton over normalised benchmark texts.

Every window of ``window`` consecutive item words (an item of fewer words, but not none, is one window) becomes a
pattern; each document is normalised once, scanned once, and the words inside any occurrence are hit. Spans are mapped
back to character offsets of the original text. A word of the benchmark is written as a few digits from alphabets of
their own, so that the automaton has few nodes and matches begin and end with words.

Defined results: a null text has no words, is never contaminated and has no items; null or empty items give no
patterns; repeated items count once; repeated documents each get a row; an empty benchmark hits nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfinder.llm.common import WORD_BYTES, bound_batches, flat_bytes, of_bytes, slices_of, whole, words_in
from wayfinder.shared import materialize

WINDOW = 13
#: Benchmark words in one automaton, which begin as many windows of some 26 nodes at most (50 bytes each); more are scanned in several rounds.
AUTOMATON_WORDS = 120_000
#: Letters of each digit's alphabet.
BASE = 256

SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<start: int, end: int>>"


def normal_words(text: str) -> list[str]:
    return [w for w in text.encode("utf-8").translate(WORD_BYTES).decode("utf-8").split(" ") if w]


class Matcher:
    """The automaton of (item, words) pairs."""

    def __init__(self, items: list[tuple[str, list[str]]], window: int):
        import ahocorasick

        self.number = {w: i for i, w in enumerate(dict.fromkeys(w for _, words in items for w in words))}
        self.width = 2 if len(self.number) <= BASE**2 else 3
        owners: dict[str, tuple[int, set[str]]] = {}
        for item, words in items:
            line = self.written(np.array([self.number[w] for w in words], np.int64))
            for i in range(max(1, len(words) - window + 1) if words else 0):
                n = min(window, len(words))
                owners.setdefault(line[i * self.width : (i + n) * self.width], (n, set()))[1].add(item)
        self.automaton = ahocorasick.Automaton()
        for pattern, (n, who) in owners.items():
            self.automaton.add_word(pattern, (n, tuple(sorted(who))))
        if owners:
            self.automaton.make_automaton()
        self.empty = not owners

    def written(self, numbers: np.ndarray) -> str:
        """Digits of words, each from the alphabet of its place; -1 (a word that no item has) is a letter of none."""
        digits = [np.where(numbers < 0, BASE * self.width, numbers // BASE**k % BASE + BASE * k) for k in range(self.width)]
        return np.stack(digits, axis=1).astype("<u2").tobytes().decode("utf-16-le")

    def scan(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray | None, set[str]]]:
        """Number of words, mask of hit words (None: none) and the items found, by text."""
        words, which, begin = words_in(of_bytes(*flat_bytes(whole(texts), WORD_BYTES)))
        get = self.number.get
        numbers = np.array([get(w, -1) for w in words], np.int64)[which] if len(words) else np.empty(0, np.int64)
        line, known = self.written(numbers), np.concatenate(([0], np.cumsum(numbers >= 0)))
        for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
            mask, found = None, set()
            if not self.empty and known[b] > known[a]:
                for end, (n, who) in self.automaton.iter(line[a * self.width : b * self.width]):
                    if mask is None:
                        mask = np.zeros(b - a, bool)
                    last = end // self.width + 1
                    mask[last - n : last] = True
                    found.update(who)
            yield b - a, mask, found


_matchers: dict[str, Matcher] = {}


def matcher(name: str, sent: Broadcast, window: int) -> Matcher:
    """One automaton for each Python worker, kept from task to task."""
    if name not in _matchers:
        _matchers.clear()
        _matchers[name] = Matcher(sent.value, window)
    return _matchers[name]


def original_spans(text: bytes, mask: np.ndarray) -> list[dict]:
    """Character ranges of runs of hit words in the original text."""
    body = np.frombuffer(text.translate(WORD_BYTES), np.uint8) != 0x20
    edge = np.diff(np.concatenate(([0], body.view(np.int8), [0])))
    begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    runs = np.diff(np.concatenate(([0], mask.view(np.int8), [0])))
    chars = np.cumsum(np.frombuffer(text, np.uint8) & 0xC0 != 0x80)
    return [{"start": int(chars[begins[a]] - 1), "end": int(chars[ends[b - 1] - 1])} for a, b in zip(np.flatnonzero(runs == 1), np.flatnonzero(runs == -1), strict=True)]


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
NAMES = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"]


def rounds_of(benchmark: DataFrame, item_cols: tuple[str, ...], window: int, most_words: int) -> Iterator[list[tuple[str, list[str]]]]:
    """Distinct (item, words) in parts of about most_words, one part at least; longer items are cut where windows overlap. Read as they are asked for."""
    part: list[tuple[str, list[str]]] = []
    held = 0
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.explode(F.array(*item_cols)).alias("text")).where("item is not null and text is not null").distinct()
    for row in items.toLocalIterator():
        words = normal_words(row["text"])
        for a in range(0, max(1, len(words) - window + 1), most_words):
            piece = words[a : a + most_words + window - 1]
            if part and held + len(piece) > most_words:
                yield part
                part, held = [], 0
            part.append((row["item"], piece))
            held += len(piece)
    yield part


def scan_all(docs: DataFrame, benchmark: DataFrame, window: int, item_cols: tuple[str, ...], text_col: str, automaton_words: int):
    """The documents after all parts of the benchmark but the last (a written table if there are several), the names of two
    columns with what these found, and a function for tasks that adds the last part."""
    tag = uuid4().hex
    own = mask_col, items_col = f"__mask_{tag}", f"__items_{tag}"  # they clash with no column
    state = bound_batches(docs).withColumns({mask_col: F.lit(None).cast("binary"), items_col: F.lit(None).cast("array<string>")})

    def scanner(items: list):
        name, sent = uuid4().hex, docs.sparkSession.sparkContext.broadcast(items)

        def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list]]:
            """Slices with words, hit mask (None: no hit) and items of each row, with what earlier parts found."""
            match = matcher(name, sent, window)
            for part in slices_of(batches, text_col):
                text, mask, had = (part.column(part.schema.get_field_index(c)) for c in (text_col, *own))
                out = []
                for (n, hit, found), before, more in zip(match.scan(text), mask.to_pylist(), had.to_pylist(), strict=True):
                    if before is not None:
                        old = np.unpackbits(np.frombuffer(before, np.uint8), count=n).astype(bool)
                        hit = old if hit is None else hit | old
                    out.append((n, hit, found.union(more or ())))
                yield part, out

        return scanned

    last = None
    for items in rounds_of(benchmark, item_cols, window, automaton_words):
        if last is not None:

            def go(batches: Iterator[pa.RecordBatch], scanned=last) -> Iterator[pa.RecordBatch]:
                for part, rows in scanned(batches):
                    found = [pa.array([None if m is None else np.packbits(m).tobytes() for _, m, _ in rows], pa.binary()), pa.array([sorted(f) for *_, f in rows], pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays([*part.drop_columns(list(own)).columns, *found], names=part.schema.names)

            state = materialize(state.mapInArrow(go, state.schema), "decontamination")
        last = scanner(items)
    return state, own, last


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, item_cols: tuple[str, ...] = ("text",), id_col: str = "doc_id", text_col: str = "text", share: int = 20, automaton_words: int = AUTOMATON_WORDS) -> DataFrame:
    """One row per document; contaminated means n_hit > 0 and share * n_hit >= n_words.

    The questions and answers in ``item_cols`` make one automaton of at most ``automaton_words`` words, the bound of what
    is broadcast. A larger benchmark takes several rounds, each of which scans the written state of the one before, so
    that every pattern meets every document and no worker holds more than one automaton.
    """
    rows, _, scanned = scan_all(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), benchmark, window, item_cols, "text", automaton_words)

    def verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in scanned(batches):
            hits = [0 if mask is None else int(mask.sum()) for _, mask, _ in found]
            texts = part.column(1)
            cols = [
                part.column(0), pa.array([n for n, *_ in found], pa.int64()), pa.array(hits, pa.int64()), pa.array([len(who) for *_, who in found], pa.int64()),
                pa.array([hashlib.sha256(",".join(sorted(who)).encode()).hexdigest() for *_, who in found], pa.string()),
                pa.array([hit > 0 and share * hit >= n for hit, (n, *_) in zip(hits, found, strict=True)], pa.bool_()),
                pa.array([original_spans(texts[i].as_py().encode("utf-8"), mask) if mask is not None else [] for i, (_, mask, _) in enumerate(found)], SPANS),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=NAMES)

    return rows.mapInArrow(verdicts, SCHEMA)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, item_cols: tuple[str, ...] = ("text",), share: int = 20, automaton_words: int = AUTOMATON_WORDS) -> DataFrame:
    """The documents that are not contaminated, with all their columns as they are."""
    rows, own, scanned = scan_all(docs, benchmark, window, item_cols, "text", automaton_words)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in scanned(batches):
            clean = [mask is None or share * int(mask.sum()) < n for n, mask, _ in found]
            yield part.drop_columns(list(own)).filter(pa.array(clean, pa.bool_()))

    return rows.mapInArrow(keep, docs.schema)
