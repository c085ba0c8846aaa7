"""Shared pieces of the training-data operators: word rules, slices of texts and checked joins."""

from __future__ import annotations

import ctypes
import gc
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfinder.shared import BROADCAST_ROWS

UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase

#: Separators of alphanumeric words (ASCII other than digits and lower-case letters, after lower-casing).
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: The same rule on UTF-8 bytes: A-Z become a-z, separators become blanks, bytes over 0x7F stay.
WORD_BYTES = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)

#: A-Z become a-z, all else stays; bytes.split() then cuts at \x20 and \x09-\x0D.
LOWER_BYTES = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


def ascii_lower(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def semi_join_checked(df: DataFrame, ids: DataFrame, key: str, rows: int) -> DataFrame:
    """Rows of df whose key is in ids; ids are broadcast only if their counted rows fit the bound."""
    ids = ids.select(key)
    return df.join(F.broadcast(ids) if rows <= BROADCAST_ROWS else ids, key, "left_semi")


def id_text_crc(id_col: str) -> Column:
    """crc32 of the id as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))


def texts_of(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """Whole texts of a batch as UTF-8 bytes, null as empty."""
    col = batch.column(batch.schema.get_field_index(column))
    return [x or b"" for x in col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()).to_pylist()]


def chunks_of(texts: list[bytes], limit: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Row ranges of about limit bytes of text, so that working memory doesn't follow the batch size."""
    at = held = 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= limit:
            yield at, i + 1
            at, held = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


#: Bytes of one Arrow batch between Spark and Python; the JVM and Python hold some of them at once, for each task.
ARROW_BYTES = 2 << 20


def bound_batches(df: DataFrame) -> DataFrame:
    """Bounds the session's Arrow batches by bytes where they are wider (10,000 long texts are many), and gives df back."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    given = conf.get(name)  # bytes, unless a user wrote a unit
    if not (given.isdigit() and 0 < int(given) <= ARROW_BYTES):
        conf.set(name, ARROW_BYTES)
    return df


def slices_of(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Every row once, in slices of about limit bytes of text, so that what a task builds doesn't follow Arrow's batch size."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(size, (size[at - 1] if at else 0) + limit)) + 1
            yield batch.slice(at, end - at)
            at = end
    release()


def release() -> None:
    """Gives back what a finished task has freed; Python workers outlive their tasks. The C library keeps freed arrays unless told
    otherwise, where it can be told (glibc)."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


#: Bytes by byte: blanks become \x20, in the second A-Z also become a-z.
SPACED = bytes(0x20 if 0x09 <= c <= 0x0D else c for c in range(256))
SPACED_LOWER = SPACED.translate(LOWER_BYTES)


def flat_bytes(texts: pa.Array, table: bytes) -> tuple[bytes, np.ndarray]:
    """All texts (large strings without nulls) translated byte by byte, and where each begins (with the end of the last)."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = bytes(texts.buffers()[2][offsets[0] : offsets[-1]]) if texts.buffers()[2] else b""
    return data.translate(table), offsets - offsets[0]


def of_bytes(data: bytes, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def whole(texts: pa.Array) -> pa.Array:
    """Large strings, null as empty."""
    return pc.fill_null(texts.cast(pa.large_string()), "")


def words_in(spaced: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts whose words are parted by blanks: the distinct words, each word's number among them, and where each text's words begin."""
    cut = pc.split_pattern(spaced, " ")
    pieces = cut.flatten().dictionary_encode()
    words, which = pieces.dictionary.to_numpy(zero_copy_only=False), pieces.indices.to_numpy()
    begin = cut.offsets.to_numpy() - cut.offsets[0].as_py()
    if len(nothing := np.flatnonzero(words == "")):
        keep = which != nothing[0]
        return words, which[keep], np.concatenate(([0], np.cumsum(keep)))[begin]
    return words, which, begin


def hashed_words(texts: pa.Array, table: bytes = SPACED_LOWER) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, text by text, and where each text's begin (with the end of the last)."""
    import xxhash

    words, which, begin = words_in(of_bytes(*flat_bytes(whole(texts), table)))
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))[which], begin


MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def sum_by_text(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Sums of values by text; 0 for a text without any."""
    out = np.zeros(len(begin) - 1, values.dtype)
    if len(full := np.flatnonzero(np.diff(begin))):
        out[full] = np.add.reduceat(values, begin[:-1][full])
    return out
