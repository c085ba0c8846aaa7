"""Packing along a space-filling curve.

A document's token ids are feature-hashed to a vector, projected to a few dimensions and put on a Hilbert curve; the
documents are range-sorted by their key, so that neighbours on the curve share sequences, and each range is packed
as one stream that is cut at the sequence length. What is left at a range's end is cut into powers of two, which need
no padding.

Defined results: a null text counts as empty (its only id is the end id); repeated rows are packed each; documents with
the same key are split over ranges by their id, so that a hot key can't fill one task; an empty table gives no piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfinder.llm.common import bound_batches, slices_of
from wayfinder.llm.tokens import encoder, squeeze, unsqueeze
from wayfinder.shared import materialize

SEQUENCE = 4096
DIMENSIONS, BITS, FEATURES, SEED = 4, 8, 1024, 7


def hilbert_index(points: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of points (n x d, each coordinate below 2 ** bits), as int64; d * bits <= 62.

    Skilling, "Programming the Hilbert curve", 2004: undo the excess work from the top bit down, then Gray-encode and
    interleave the bits.
    """
    x = points.astype(np.int64).T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(d):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[d - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = key << 1 | (x[i] >> b) & 1
    return key


def curve_keys(docs: list[np.ndarray], dimensions: int = DIMENSIONS, bits: int = BITS, features: int = FEATURES) -> np.ndarray:
    """Hilbert keys of token-id arrays: damped counts of hashed ids, centred per vector, projected by fixed random signs."""
    plane = np.random.default_rng(SEED).choice([-1.0, 1.0], size=(features, dimensions))
    keys = np.empty(len(docs), np.int64)
    for a in range(0, len(docs), 2048):
        part = docs[a : a + 2048]
        m = np.stack([np.bincount((ids.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(22), minlength=features)[:features] for ids in part]).astype(np.float64)
        m = np.log1p(m)
        norm = np.linalg.norm(m, axis=1, keepdims=True)
        flat = (m / np.where(norm > 0, norm, 1)) @ plane
        grid = np.clip((flat / 4 + 0.5) * (1 << bits), 0, (1 << bits) - 1)
        keys[a : a + 2048] = hilbert_index(grid, bits)
    return keys


def tokenize_with_keys(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (ids with the end id), key, ids (compressed 16-bit ids without it)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with encoder(tokenizer_path) as coder:
            for part in slices_of(batches):
                flat, begin = coder.encode(part.column(1))
                arrays = np.split(flat, begin[1:-1])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(begin) + 1), pa.array(curve_keys(arrays), pa.int64()), pa.array([squeeze(x.tobytes()) for x in arrays], pa.binary())], names=["doc_id", "n", "key", "ids"])

    return bound_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(scan, "doc_id long, n long, key long, ids binary")


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long"
NAMES = [x.split()[0] for x in PIECES.split(", ")]


class Packer:
    """Cuts a stream of documents into full sequences; finish() cuts the rest into powers of two."""

    def __init__(self, size: int, first_id: int):
        self.size, self.sequence, self.open, self.fill, self.out = size, first_id, [], 0, []

    def close(self, room: int) -> None:
        for doc, start, ids, total, offset in self.open:
            self.out.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.sequence, offset, room))
        self.sequence, self.open, self.fill = self.sequence + 1, [], 0

    def add(self, doc: int | None, ids: np.ndarray, total: int, start: int = 0, size: int | None = None) -> None:
        size = size or self.size
        at = 0
        while at < len(ids):
            part = ids[at : at + size - self.fill]
            self.open.append((doc, start + at, part, total, self.fill))
            self.fill += len(part)
            at += len(part)
            if self.fill == size:
                self.close(size)

    def finish(self) -> None:
        rest, left = self.open, self.fill
        self.open, self.fill = [], 0
        while left:
            size = 1 << (left.bit_length() - 1)
            more = []
            for doc, start, ids, total, _ in rest:
                take = min(len(ids), size - self.fill) if not more else 0
                if take:
                    self.open.append((doc, start, ids[:take], total, self.fill))
                    self.fill += take
                if take < len(ids):
                    more.append((doc, start + take, ids[take:], total, 0))
            self.close(size)
            rest, left = more, left - size


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, size: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece. sequence_id: the range's number in the upper bits, the sequence within it in the lower 32."""
    found = materialize(tokenize_with_keys(docs, tokenizer_path, end_id, id_col, text_col), "packing")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(size, TaskContext.get().partitionId() << 32)

        def rows() -> pa.RecordBatch:
            cols = list(zip(*packer.out, strict=True)) or [[]] * len(NAMES)
            packer.out = []
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in cols], names=NAMES)

        for batch in batches:
            for doc, n, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "ids")), strict=True):
                packer.add(doc, np.append(unsqueeze(ids, n - 1), np.uint16(end_id)), n)
            yield rows()
        packer.finish()
        yield rows()

    ordered = found.repartitionByRange("key", "doc_id").sortWithinPartitions("key", "doc_id", "n", "ids")
    return ordered.select("doc_id", "n", "ids").mapInArrow(run, PIECES)
