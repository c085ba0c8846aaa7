"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

Ids are replaced by their rank in the corpus (the most frequent is 0), each rank takes 1 to 4 bytes, and a 2-bit code
for its length goes to a separate stream of control bytes, four to a byte. Readers look the lengths up by control byte
and gather whole files at once.

A shard: magic, documents, ids; doc ids with a null bitmap; ids per document; control bytes; data bytes. ``vocab`` holds the
ids by rank. Shards are named in ascending order of doc_id and replaced whole when a task is retried.

Defined results: a null text counts as empty (only the end id); null doc_ids come first; repeated rows are all kept, in
the order of their ids; an empty table writes no shard.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfinder.llm.common import bound_batches, slices_of
from wayfinder.llm.tokens import encoder, squeeze, unsqueeze
from wayfinder.shared import fresh_path, materialize

MAGIC = b"RVB1"
#: Ids in one shard at least, before the next begins.
SHARD_IDS = 4_000_000

#: Bytes of each of the four values that a control byte describes.
LENGTHS = (((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1).astype(np.uint8)
MASKS = np.array([0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def encode_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    v = np.ascontiguousarray(values, dtype="<u4")
    code = (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    four = np.pad(code, (0, -len(v) % 4)).reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    data = v.view(np.uint8).reshape(-1, 4)[np.arange(4) <= code[:, None]]
    return control.astype(np.uint8).tobytes(), data.tobytes()


def decode_values(control: bytes, data: bytes, n: int) -> np.ndarray:
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    at = np.cumsum(lengths, dtype=np.int64) - lengths
    flat = np.frombuffer(data + b"\0\0\0", np.uint8)
    word = np.zeros(n, np.uint32)
    for k in range(int(lengths.max(initial=1))):
        word |= flat[at + k].astype(np.uint32) << np.uint32(8 * k)
    return word & MASKS[lengths - 1]


def pack_shard(doc_ids: list[int | None], counts: list[int], ranks: np.ndarray) -> bytes:
    control, data = encode_values(ranks)
    known = np.packbits([d is not None for d in doc_ids]).tobytes()
    head = struct.pack("<4sQQQ", MAGIC, len(doc_ids), len(ranks), len(data))
    return b"".join([head, known, np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array(counts, "<u4").tobytes(), control, data])


def unpack_shard(blob: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    magic, docs, ids, size = struct.unpack_from("<4sQQQ", blob)
    if magic != MAGIC:
        raise ValueError("not a shard of ranked ids")
    at = struct.calcsize("<4sQQQ")
    known = np.unpackbits(np.frombuffer(blob, np.uint8, (docs + 7) // 8, at), count=docs)
    at += (docs + 7) // 8
    names = np.frombuffer(blob, "<i8", docs, at)
    counts = np.frombuffer(blob, "<u4", docs, at + 8 * docs)
    at += 12 * docs
    width = (ids + 3) // 4
    ranks = decode_values(blob[at : at + width], blob[at + width : at + width + size], ids)
    return [int(d) if k else None for d, k in zip(names, known, strict=True)], counts, ranks


def write_atomically(folder: str, name: str, blob: bytes) -> None:
    """Through the file system of the folder's address; a reader sees the whole file or none. What a lost attempt left goes first."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    part = f"{path}/.{name}.{TaskContext.get().taskAttemptId() if TaskContext.get() else 0}"
    store.create_dir(path, recursive=True)
    with store.open_output_stream(part) as f:
        f.write(blob)
    if store.get_file_info(f"{path}/{name}").type != fs.FileType.NotFound:
        store.delete_file(f"{path}/{name}")
    store.move(part, f"{path}/{name}")


TOKENS = "doc_id long, n long, ids binary, seen array<int>, times array<long>"


def tokenize(docs: DataFrame, tokenizer_path: str, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n, ids (compressed); and as the last row of each task the ids that it has seen and how often, with all else null."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        rows = lambda doc, n, ids, seen, times: pa.RecordBatch.from_arrays([doc, pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(seen, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int64()))], names=["doc_id", "n", "ids", "seen", "times"])
        with encoder(tokenizer_path) as coder:
            for part in slices_of(batches):
                flat, begin = coder.encode(part.column(1))
                total += np.bincount(flat, minlength=1 << 16)
                cuts = begin.tolist()
                yield rows(part.column(0), np.diff(begin), [squeeze(flat[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], [None] * part.num_rows, [None] * part.num_rows)
        seen = np.flatnonzero(total)
        yield rows(pa.array([None], pa.int64()), [None], [None], [seen.astype(np.int32)], [total[seen]])

    return bound_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(scan, TOKENS)


def ranked_ids(tokens: DataFrame, end_id: int) -> np.ndarray:
    """All ids of the corpus by falling frequency, ties to the smaller id; at most 65,536, as ids have 16 bits."""
    seen = tokens.where("seen is not null").select(F.explode(F.arrays_zip("seen", "times")).alias("x"))
    counts = dict(seen.groupBy("x.seen").agg(F.sum("x.times")).collect())
    if documents := tokens.where("n is not null").count():
        counts[end_id] = counts.get(end_id, 0) + documents
    return np.array(sorted(counts, key=lambda i: (-counts[i], i)), np.uint32)


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = SHARD_IDS) -> DataFrame:
    """Writes shards and ``vocab``; returns one row per shard: file, n_docs, n_tokens."""
    tokens = materialize(tokenize(docs, tokenizer_path, id_col, text_col), "tokens")
    vocab = ranked_ids(tokens, end_id)
    write_atomically(folder, "vocab", vocab.astype("<u4").tobytes())
    rank = np.zeros(1 << 16, np.uint32)
    rank[vocab] = np.arange(len(vocab), dtype=np.uint32)
    sent = tokens.sparkSession.sparkContext.broadcast(rank)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard = TaskContext.get().partitionId(), 0
        names: list[int | None] = []
        rows: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal shard, names, rows, held
            file = f"part-{part:06d}-{shard:06d}.ranked"
            write_atomically(folder, file, pack_shard(names, [len(r) for r in rows], sent.value[np.concatenate(rows)]))
            out = pa.RecordBatch.from_arrays([pa.array([file]), pa.array([len(names)], pa.int64()), pa.array([held], pa.int64())], names=["file", "n_docs", "n_tokens"])
            shard, names, rows, held = shard + 1, [], [], 0
            return out

        for batch in batches:
            for doc, n, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "ids")), strict=True):
                names.append(doc)
                rows.append(np.append(unsqueeze(ids, n), np.uint16(end_id)))
                held += n + 1
                if held >= shard_ids:
                    yield flush()
        if names:
            yield flush()

    # by all that orders rows, so that a repeated id is split over ranges too; a hash stands for the ids, as range bounds are sampled to the driver
    rows = tokens.where("n is not null").select("doc_id", "n", "ids", F.xxhash64("ids").alias("h"))
    ordered = rows.repartitionByRange("doc_id", "n", "h").sortWithinPartitions("doc_id", "n", "h", "ids").drop("h")
    return materialize(ordered.mapInArrow(write, "file string, n_docs long, n_tokens long"), "shards")


def read_token_files(shards: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the shards, decoded from the files."""
    spark = shards.sparkSession
    blobs = lambda glob: spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    vocab = blobs("vocab").select("content").head()  # an empty corpus has an empty list, which reads as no row
    ids = spark.sparkContext.broadcast(np.frombuffer(bytes(vocab[0]) if vocab else b"", "<u4"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, blob in zip(batch.column("file").to_pylist(), batch.column("content").to_pylist(), strict=True):
                docs, counts, ranks = unpack_shard(blob)
                flat = ids.value[ranks]
                ends = np.cumsum(counts, dtype=np.int64)
                crc = [zlib.crc32(flat[e - c : e].tobytes()) for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(docs), pa.string()), pa.array(docs, pa.int64()), pa.array(ends - counts, pa.int64()), pa.array(counts.astype(np.int64)), pa.array(crc, pa.int64())], names=["file", "doc_id", "at", "n_tokens", "ids_crc32"])

    content = blobs("*.ranked").select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    read = content.mapInArrow(decode, "file string, doc_id long, at long, n_tokens long, ids_crc32 long")
    # a window over the files of each part, and one over the parts, of which there are as many as tasks that wrote
    part = F.split("file", "-")[1].cast("int").alias("part")
    sizes = shards.select(part, "file", "n_tokens")
    before = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens")).select("part", before(Window.orderBy("part")).alias("of_part"))
    starts = sizes.select("part", "file", before(Window.partitionBy("part").orderBy(F.length("file"), "file")).alias("of_file")).join(parts, "part")
    return read.join(starts, "file").select("doc_id", (F.col("of_part") + F.col("of_file") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_file_digest(docs: DataFrame, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    folder = fresh_path(docs.sparkSession, "ranked")
    return read_token_files(write_token_files(docs, tokenizer_path, folder, end_id), folder)
