"""Language-model scoring from a log-frequency Bloom filter.

Counts of words and word pairs are gathered over the whole training corpus. A count c is quantised to
1 + floor(log2 c) levels, and an n-gram enters the filter once for each level, so a count is read back by probing levels
until one is missing (Talbot and Osborne, 2007). The filter is broadcast; a word's probability given the one before
interpolates the pair's relative frequency with an add-one unigram estimate.

The filter grows with the corpus without bound, so bits per byte of text, and the rate of false probes, stay alike at
every size. Up to BROADCAST_FILTER_BYTES it is broadcast; a larger one stays in slices in the shared folder, and the
distinct n-grams of blocks of documents are shuffled to the slices and their levels back. Exact word counts (for the
base score) are broadcast only while the counted words fit VOCABULARY_WORDS; a larger vocabulary is joined by shuffle.

Defined results: a null or empty text is the end token alone; repeated rows are learned from and scored each; with
no training rows N and V are 0 and every word is unknown.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfinder.llm.common import bound_batches, chunks_of, hashed_words, id_text_crc, mixed, slices_of, texts_of
from wayfinder.shared import materialize

BROADCAST_FILTER_BYTES = 64 << 20
VOCABULARY_WORDS = 12_000_000
#: Text bytes of the corpus for each reduce group; distinct keys that a task holds before it hands them on.
GROUP_BYTES, HELD_KEYS = 8 << 20, 1_000_000
#: Text bytes that are worked on at once.
CHUNK = 2_000_000
#: Text bytes whose distinct n-grams are shuffled to the slices of a large filter together.
BLOCK = 8_000_000
PROBES = 2
#: Levels of the largest 64-bit count; a trained filter probes no more than its corpus can have entered.
MOST_LEVELS = 64
#: The count that each level stands for.
COUNT_OF = np.array([0.0, 1.0, *(1.44 * 2.0 ** (level - 1) for level in range(2, MOST_LEVELS + 1))])
WEIGHT = 0.7

#: Stands for the end token; no word has it but by the chance of 64 bits.
END = np.uint64(0x9E3779B97F4A7C15)


def token_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens (words, then the end, text by text) and tokens per text."""
    flat, begin = hashed_words(texts)
    return np.insert(flat, begin[1:], END), np.diff(begin) + 1


def pair_keys(tokens: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of each token with the one before (the end token stands before a text's first), and that context."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    first = np.cumsum(n) - n
    before[first] = tokens[n[0] - 1] if len(n) else 0
    return mixed(before * np.uint64(3) + mixed(tokens + np.uint64(0x9E3779B97F4A7C15))), before


def unigram_keys(tokens: np.ndarray) -> np.ndarray:
    return mixed(tokens ^ np.uint64(0xD6E8FEB86659FD93))


class Filter:
    """Bloom filter over (key, level), in ``groups`` slices by the key's upper bits, so that each slice is built on its own."""

    def __init__(self, bits: np.ndarray | None, groups: int, levels: int = MOST_LEVELS):
        """bits: None for a filter that stays in slices."""
        self.bits, self.groups, self.levels = bits, groups, levels
        self.slice_bits = len(bits) * 8 // groups if bits is not None else 0

    @staticmethod
    def group_of(keys: np.ndarray, groups: int) -> np.ndarray:
        return (keys >> np.uint64(64 - (groups.bit_length() - 1))).astype(np.int64) if groups > 1 else np.zeros(len(keys), np.int64)

    @staticmethod
    def places(keys: np.ndarray, level: int, slice_bits: int) -> Iterator[np.ndarray]:
        h = mixed(keys + np.uint64(level * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        step = (h >> np.uint64(32)) | np.uint64(1)
        for i in range(PROBES):
            yield (h + np.uint64(i) * step) % np.uint64(slice_bits)

    @classmethod
    def slice_of(cls, keys: np.ndarray, counts: np.ndarray, slice_bits: int) -> bytes:
        bits = np.zeros(slice_bits, bool)
        level_of = 1 + np.floor(np.log2(np.maximum(counts, 1))).astype(int)
        for level in range(1, int(level_of.max(initial=0)) + 1):
            now = keys[level_of >= level]
            for at in cls.places(now, level, slice_bits):
                bits[at.astype(np.int64)] = True
        return np.packbits(bits, bitorder="little").tobytes()

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """Read-back counts: 0, 1, or the middle of the power of two that the level stands for."""
        return COUNT_OF[self.levels_of(keys)]

    def levels_of(self, keys: np.ndarray) -> np.ndarray:
        base = self.group_of(keys, self.groups).astype(np.uint64) * np.uint64(self.slice_bits)
        out = np.zeros(len(keys), np.uint8)
        left = np.arange(len(keys))
        for level in range(1, self.levels + 1):
            hit = np.ones(len(left), bool)
            for at in self.places(keys[left], level, self.slice_bits):
                at = at + base[left]
                hit &= (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
            left = left[hit]
            if not len(left):
                break
            out[left] = level
        return out


def gather_counts(training: DataFrame, groups: int) -> DataFrame:
    """g, kind (0 words, 1 pairs), keys, counts: binary blocks of distinct keys, one for each task, kind and group."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for kind, parts in enumerate(held):
                if parts:
                    keys, counts = merged([p[0] for p in parts], [p[1] for p in parts])
                    cut = np.searchsorted(Filter.group_of(keys, groups), np.arange(groups + 1))
                    full = [g for g in range(groups) if cut[g] < cut[g + 1]]
                    yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array([kind] * len(full), pa.int32()), pa.array([keys[cut[g] : cut[g + 1]].tobytes() for g in full], pa.binary()), pa.array([counts[cut[g] : cut[g + 1]].astype("<u4").tobytes() for g in full], pa.binary())], names=["g", "kind", "keys", "counts"])
                    parts.clear()

        for part in slices_of(batches, limit=CHUNK):
            tokens, n = token_hashes(part.column(0))
            for kind, keys in ((0, tokens), (1, pair_keys(tokens, n)[0])):
                held[kind].append(np.unique(keys, return_counts=True))
                size += len(held[kind][-1][0])
            if size >= HELD_KEYS:
                yield from flush()
                size = 0
        yield from flush()

    return training.mapInArrow(scan, "g long, kind int, keys binary, counts binary")


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with summed counts."""
    k, c = np.concatenate(keys), np.concatenate(counts).astype(np.int64)
    if not len(k):
        return k, c
    order = np.argsort(k)
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    return k[first], np.add.reduceat(c, first)


def train(training: DataFrame, broadcast_filter_bytes: int = BROADCAST_FILTER_BYTES, group_bytes: int = GROUP_BYTES) -> tuple[Filter, DataFrame]:
    """The filter, and g, keys, counts: blocks of the exact word counts (read from the shared folder). training: column text."""
    size = bound_batches(training).agg(F.sum(F.octet_length("text"))).head()[0] or 0
    groups = 1 << max(2, int(size // group_bytes).bit_length())
    filter_bytes = 1 << max(16, int(size // 16).bit_length())
    slice_bits = filter_bytes * 8 // groups

    def build(key: tuple, table: pa.Table) -> pa.Table:
        kinds = table.column("kind").to_pylist()
        out = []
        for kind in (0, 1):
            rows = [i for i, k in enumerate(kinds) if k == kind]
            read = lambda c, t: [np.frombuffer(table.column(c)[i].as_py(), t) for i in rows]  # noqa: B023, E731
            out.append(merged(read("keys", "<u8"), read("counts", "<u4")) if rows else (np.empty(0, np.uint64), np.empty(0, np.int64)))
        (words, n), (pairs, m) = out
        bits = Filter.slice_of(np.concatenate([mixed_into(words, groups), pairs]), np.concatenate([n, m]), slice_bits)
        return pa.table({"g": [key[0].as_py()], "bits": pa.array([bits], pa.binary()), "keys": pa.array([words.tobytes()], pa.binary()), "counts": pa.array([n.astype("<u8").tobytes()], pa.binary()), "words": pa.array([len(words)], pa.int64()), "tokens": pa.array([int(n.sum())], pa.int64())})

    slices = materialize(gather_counts(training, groups).groupBy("g").applyInArrow(build, "g long, bits binary, keys binary, counts binary, words long, tokens long"), "lm")
    tokens = slices.agg(F.sum("tokens")).head()[0] or 0
    levels = int(tokens).bit_length()
    if filter_bytes > broadcast_filter_bytes:
        return Filter(None, groups, levels), slices
    bits = np.zeros(filter_bytes, np.uint8)
    for row in slices.select("g", "bits").toLocalIterator():
        bits[row["g"] * slice_bits // 8 : (row["g"] + 1) * slice_bits // 8] = np.frombuffer(row["bits"], np.uint8)
    return Filter(bits, groups, levels), slices


def mixed_into(words: np.ndarray, groups: int) -> np.ndarray:
    """Unigram keys that stay in their word's slice: mixed but for the upper bits that name the slice."""
    up = np.uint64(64 - (groups.bit_length() - 1))
    mask = (np.uint64(1) << up) - np.uint64(1)
    return (words & ~mask) | (unigram_keys(words) & mask)


def score(docs: DataFrame, model: tuple[Filter, DataFrame], id_col: str = "doc_id", text_col: str = "text", vocabulary_words: int = VOCABULARY_WORDS, block_bytes: int = BLOCK) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row."""
    lm, slices = model
    spark = docs.sparkSession
    total = slices.agg(F.sum("words").alias("v"), F.sum("tokens").alias("n")).head()
    v, n = total["v"] or 0, total["n"] or 0
    groups = lm.groups
    if lm.bits is not None:
        sent = spark.sparkContext.broadcast((lm.bits.tobytes(), lm.groups, lm.levels))  # bytes are read in place, arrays would be copied
    rows = bound_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    small = v <= vocabulary_words
    width = "<u4" if n < 1 << 32 else "<u8"
    if small:
        blocks = sorted(((r["g"], r["keys"], r["counts"]) for r in slices.select("g", "keys", "counts").toLocalIterator()), key=lambda r: r[0])
        exact = spark.sparkContext.broadcast((b"".join(b[1] for b in blocks), b"".join(np.frombuffer(b[2], "<u8").astype(width).tobytes() for b in blocks)))
        del blocks

    def known_counts(words: np.ndarray) -> np.ndarray:
        keys, counts = (np.frombuffer(x, t) for x, t in zip(exact.value, ("<u8", width), strict=True))
        if not len(keys):
            return np.zeros(len(words))
        at = np.minimum(np.searchsorted(keys, words), len(keys) - 1)
        return np.where(keys[at] == words, counts[at], 0).astype(np.float64)

    def measured(ids: pa.Array, chunks: Iterable[tuple[np.ndarray, np.ndarray]], counts_of: Callable[[np.ndarray], np.ndarray]) -> pa.RecordBatch:
        """Results for texts whose tokens come in chunks (hashes, tokens per text)."""
        parts = []
        for tokens, size in chunks:
            at = np.cumsum(size) - size
            words, place = np.unique(tokens, return_inverse=True)
            pairs, context = pair_keys(tokens, size)
            seen, pair_place = np.unique(pairs, return_inverse=True)
            rough = counts_of(mixed_into(words, groups))
            low = np.minimum((rough + 1) / (n + v + 1), 1.0)[place]  # never over 1, however a probe reads
            of_context = rough[np.searchsorted(words, context)]
            both = np.minimum(counts_of(seen)[pair_place], of_context)
            p = np.where(of_context > 0, WEIGHT * both / np.maximum(of_context, 1) + (1 - WEIGHT) * low, low)
            score = np.add.reduceat(np.log10(p), at)
            if small:
                c = known_counts(words)
                base = np.add.reduceat(np.log10((c + 1) / (n + v + 1))[place], at)
                known = np.add.reduceat((c > 0).astype(np.int64)[place], at)
                parts.append((size, known, base, score))
            else:
                parts.append((size, score, *per_text(tokens, size)))
        cols = [np.concatenate(c) for c in zip(*[p[: 4 if small else 2] for p in parts], strict=True)] if parts else [np.empty(0)] * (4 if small else 2)
        arrays = [ids, pa.array(cols[0].astype(np.int64))]
        if small:
            return pa.RecordBatch.from_arrays([*arrays, pa.array(cols[1].astype(np.int64)), pa.array(cols[2]), pa.array(cols[3])], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])
        entries = [e for p in parts for e in p[2]]
        return pa.RecordBatch.from_arrays([*arrays, pa.array(cols[1]), pa.array(entries, pa.list_(pa.struct([("w", pa.int64()), ("n", pa.int64())])))], names=["doc_id", "n_tokens", "score", "words"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_ = Filter(np.frombuffer(sent.value[0], np.uint8), *sent.value[1:])
        for part in slices_of(batches, limit=CHUNK):
            yield measured(part.column(0), [token_hashes(part.column(1))], filter_.counts)

    def scan_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by block: first the levels of its n-grams in the order of the slices, then its documents."""
        for levels, ids, texts in whole_blocks(batches):
            chunks = [token_hashes(as_strings(texts[a:b])) for a, b in chunks_of(texts, CHUNK)]
            keys = block_keys(chunks, groups)
            if len(keys) != len(levels):
                raise ValueError(f"{len(keys)} n-grams in a block, {len(levels)} levels")
            yield measured(pa.array(ids, pa.int64()), chunks, lambda k: COUNT_OF[levels[np.searchsorted(keys, k)]])  # noqa: B023

    results = "doc_id long, n_tokens long, " + ("n_known long, base_score double, score double" if small else "score double, words array<struct<w: long, n: long>>")
    found = rows.mapInArrow(scan, results) if lm.bits is not None else in_blocks(rows, slices, lm, block_bytes).mapInArrow(scan_blocks, results)
    if not small:
        found = _joined(materialize_scored(found), slices, n, v)
    return found.select("doc_id", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def block_keys(chunks: Iterable[tuple[np.ndarray, np.ndarray]], groups: int) -> np.ndarray:
    """Distinct filter keys of words and pairs, in order."""
    parts = [np.unique(np.concatenate([mixed_into(np.unique(tokens), groups), pair_keys(tokens, n)[0]])) for tokens, n in chunks]
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint64)


BLOCK_ROW = "b long, g long, doc_id long, data binary"


def as_strings(texts: list[bytes]) -> pa.Array:
    return pa.array(texts, pa.large_binary()).cast(pa.large_string())


def block_rows(b: list[int], g: list[int | None], doc_id: list[int | None], data: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array(g, pa.int64()), pa.array(doc_id, pa.int64()), pa.array(data, pa.binary())], names=["b", "g", "doc_id", "data"])


def in_blocks(rows: DataFrame, slices: DataFrame, lm: Filter, block_bytes: int) -> DataFrame:
    """Documents (g null, data the text) in blocks b, each block after the levels of its distinct n-grams (by slice g).

    Blocks are numbered and written once, then their n-grams meet the slices, which are read one at a time."""
    groups, most_levels = lm.groups, lm.levels

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        b, held, parts = TaskContext.get().partitionId() << 32, 0, []

        def keys_of_block() -> pa.RecordBatch:
            keys = np.unique(np.concatenate(parts))
            cut = np.searchsorted(Filter.group_of(keys, groups), np.arange(groups + 1))
            full = [g for g in range(groups) if cut[g] < cut[g + 1]]
            return block_rows([b] * len(full), full, [None] * len(full), [keys[cut[g] : cut[g + 1]].tobytes() for g in full])

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), texts_of(batch, "text")
            for x, y in chunks_of(texts, min(CHUNK, block_bytes)):
                parts.append(block_keys([token_hashes(as_strings(texts[x:y]))], groups))
                held += sum(map(len, texts[x:y]))
                yield block_rows([b] * (y - x), [None] * (y - x), ids[x:y], texts[x:y])
                if held >= block_bytes:
                    yield keys_of_block()
                    b, held, parts = b + 1, 0, []
        if parts:
            yield keys_of_block()

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, one = None, None
        for batch in batches:
            bs, gs, data = (batch.column(c).to_pylist() for c in ("b", "g", "data"))
            out = []
            for b, g, x in zip(bs, gs, data, strict=True):
                if b < 0:
                    at, one = g, Filter(np.frombuffer(x, np.uint8), 1, most_levels)
                else:
                    keys = np.frombuffer(x, "<u8")
                    out.append((b, g, None, (one.levels_of(keys) if at == g else np.zeros(len(keys), np.uint8)).tobytes()))
            if out:
                yield block_rows(*map(list, zip(*out, strict=True)))

    dealt = materialize(rows.mapInArrow(deal, BLOCK_ROW), "blocks")
    none = F.lit(None).cast("long").alias("doc_id")
    keys = dealt.where("g is not null").select("b", "g", none, "data")
    met = slices.select(F.lit(-1).cast("long").alias("b"), "g", none, F.col("bits").alias("data")).unionByName(keys)
    levels = met.repartition("g").sortWithinPartitions("g", "b").mapInArrow(probe, BLOCK_ROW)
    return levels.unionByName(dealt.where("g is null")).repartition("b").sortWithinPartitions("b", F.col("g").asc_nulls_last())


def whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list, list[bytes]]]:
    """Levels, ids and texts of each block, from rows in the order of in_blocks."""
    now, levels, ids, texts = None, [], [], []
    for batch in batches:
        for b, g, i, x in zip(*(batch.column(c).to_pylist() for c in ("b", "g", "doc_id", "data")), strict=True):
            if b != now:
                if ids:
                    yield np.frombuffer(b"".join(levels), np.uint8), ids, texts
                now, levels, ids, texts = b, [], [], []
            if g is None:
                ids.append(i)
                texts.append(x)
            else:
                levels.append(x)
    if ids:
        yield np.frombuffer(b"".join(levels), np.uint8), ids, texts


def materialize_scored(found: DataFrame) -> DataFrame:
    return materialize(found.withColumn("row", F.monotonically_increasing_id()), "scored")


def per_text(tokens: np.ndarray, size: np.ndarray) -> tuple[list]:
    """Distinct words and their number for each text."""
    ends, out = np.cumsum(size), []
    for a, b in zip((ends - size).tolist(), ends.tolist(), strict=True):
        w, n = np.unique(tokens[a:b], return_counts=True)
        out.append([{"w": x, "n": y} for x, y in zip(w.view(np.int64).tolist(), n.tolist(), strict=True)])
    return (out,)


def _joined(scored: DataFrame, slices: DataFrame, n: int, v: int) -> DataFrame:
    """Exact counts by a shuffled join on the word's hash, summed by row."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, counts in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(keys, "<i8")), pa.array(np.frombuffer(counts, "<u8").astype(np.int64))], names=["w", "c"])

    words = slices.select("keys", "counts").mapInArrow(explode, "w long, c long")
    entries = scored.select("row", F.explode("words").alias("e")).select("row", "e.w", "e.n")
    sums = entries.join(words, "w", "left").groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("n_known"), F.sum(F.col("n") * F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(float(n + v + 1)))).alias("base_score"))
    return scored.drop("words").join(sums, "row")


def trains(id_col: str = "doc_id"):
    return id_text_crc(id_col) % 7 != 2


def lm_scores(docs: DataFrame) -> DataFrame:
    """Scores of all documents by a model of those whose crc32 of the id, mod 7, is not 2."""
    model = train(docs.where(trains()).select(F.coalesce("text", F.lit("")).alias("text")))
    return score(docs, model).select("doc_id", (id_text_crc("doc_id") % 7 == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
