"""Source divergence audit: how far the sources of a language are apart in their use of terms.

Occurrences are counted by language, source and term; terms in too few documents of their language are dropped. The rest is
dealt into blocks of terms, each a dense int64 matrix of sources by terms. Within a block all pairs of sources are compared by
broadcasting, which gives a partial matrix of pair sums, and each source keeps a heap of its most over-used terms. Partial
matrices are added up and heaps merged by Spark.

A block has about CELLS cells, whatever the number of sources; where these are many, they are dealt into slices of about CELLS
pairs that each meet the block by themselves. So the memory of a task is bounded. Shares are integers on a scale of 10**9 and found by long division, which stays exact within int64 as long
as a language has fewer than 9 * 10**15 occurrences.

Defined results: null texts, languages and sources count as empty; repeated rows count each; a group without terms is a group;
a language without kept terms has pairs of value 0; the only source of a language has no pairs; ties go to the smaller item by
its UTF-8 bytes; an empty table gives no row.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfinder.llm.common import bound_batches, flat_bytes, of_bytes, slices_of, whole, words_in
from wayfinder.shared import BROADCAST_ROWS, materialize

#: A-Z become a-z, bytes over 0x7F stay, all else parts terms.
TERM_BYTES = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))

MIN_DOCUMENTS, TOP, SCALE, PRIOR = 30, 50, 1_000_000_000, 5
#: Cells of a block's matrix, and of what is compared at once within it.
CELLS = 1 << 16


def counted(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """lang, source, term, n, docs: occurrences and documents, added up within slices; a row with an empty term for each group."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices_of(batches, limit=8_000_000):
            langs, sources = (part.column(i).dictionary_encode() for i in (0, 1))
            group = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
            words, which, begin = words_in(of_bytes(*flat_bytes(whole(part.column(2)), TERM_BYTES)))
            texts = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
            # by text and word, then by group and word
            cell, n = np.unique(texts * len(words) + which, return_counts=True)
            text, word = np.divmod(cell, max(len(words), 1))
            key, back = np.unique(group[text] * len(words) + word, return_inverse=True)
            total, seen = np.bincount(back, n, len(key)).astype(np.int64), np.bincount(back, minlength=len(key))
            of, word = np.divmod(key, max(len(words), 1))
            groups = np.unique(group)
            of = np.concatenate((of, groups))
            terms = pa.concat_arrays([pa.array(words, pa.string()).take(pa.array(word)), pa.array([""] * len(groups), pa.string())])
            none = np.zeros(len(groups), np.int64)
            yield pa.RecordBatch.from_arrays(
                [langs.dictionary.take(pa.array(of // len(sources.dictionary))), sources.dictionary.take(pa.array(of % len(sources.dictionary))), terms, pa.array(np.concatenate((total, none))), pa.array(np.concatenate((seen, none)))],
                names=["lang", "source", "term", "n", "docs"],
            )

    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = bound_batches(docs).select(empty(lang_col).alias("lang"), empty(source_col).alias("source"), F.col(text_col).alias("text"))
    return rows.mapInArrow(scan, "lang string, source string, term string, n long, docs long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(counts: np.ndarray, total: np.ndarray | int, kept: int) -> np.ndarray:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * kept)) by long division, three digits at a time."""
    below = np.asarray(total, np.int64) + PRIOR * kept
    out, rest = np.divmod(counts + PRIOR, below)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, below)
        out = out * 1000 + digits
    return out + 1


def pair_sums(p: np.ndarray, begin: int, end: int, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """i, j, sum over terms of |p[i] - p[j]| for i from begin to end and all j > i; p: sources by terms."""
    size, terms = p.shape
    step = max(1, cells // max(1, size * terms))
    out = np.zeros((end - begin, size), np.int64)
    for a in range(begin, end, step):
        b = min(a + step, end)
        out[a - begin : b - begin] = np.abs(p[a:b, None, :] - p[None, :, :]).sum(axis=2)
    i, j = np.nonzero(np.arange(begin, end)[:, None] < np.arange(size)[None, :])
    return i + begin, j, out[i, j]


def heaps(p: np.ndarray, q: np.ndarray, counts: np.ndarray, terms: list[str], top: int, begin: int, end: int) -> Iterator[tuple[int, str, int]]:
    """(source's place, term, lead) of the first terms of sources from begin to end by lead over the language."""
    names = [t.encode() for t in terms]
    for i in range(begin, end):
        lead = p[i] - q
        found = np.flatnonzero((counts[i] > 0) & (lead > 0))
        if len(found) > top:  # all that reach the lead at the bound, ties included
            found = found[lead[found] >= np.partition(lead[found], len(found) - top)[len(found) - top]]
        for v, k in heapq.nsmallest(top, ((-int(lead[k]), k) for k in found), key=lambda x: (x[0], names[x[1]])):
            yield i, terms[k], -v


TILE = "lang string, part string, a string, b string, value long"


def tile(groups: pa.Table, cells: pa.Table, top: int) -> pa.Table:
    """Partial pair sums (part pair) and heaps (part term) of one block for a slice of the sources. groups: lang, source, total,
    kept, slice, slices of all of the language's sources; cells: source, term, n of the block's terms."""
    lang, kept, slice_, slices = (groups[c][0].as_py() for c in ("lang", "kept", "slice", "slices"))
    order = np.argsort(np.array(groups["source"].to_pylist(), object))
    sources, totals = groups["source"].take(order).combine_chunks(), groups["total"].to_numpy()[order]
    at = cells["term"].combine_chunks().dictionary_encode()
    counts = np.zeros((len(sources), len(at.dictionary)), np.int64)
    counts[pc.index_in(cells["source"], sources).to_numpy(), at.indices.to_numpy()] = cells["n"].to_numpy()
    p = shares(counts, totals[:, None], kept)
    q = shares(counts.sum(axis=0), int(totals.sum()), kept)
    bounds = len(sources) * slice_ // slices, len(sources) * (slice_ + 1) // slices
    i, j, value = pair_sums(p, *bounds)
    first = list(heaps(p, q, counts, at.dictionary.to_pylist(), top, *bounds))
    kinds = pa.array(["pair"] * len(i) + ["term"] * len(first), pa.string())
    a = pa.concat_arrays([sources.take(pa.array(i)), sources.take(pa.array([x[0] for x in first], pa.int64()))])
    b = pa.concat_arrays([sources.take(pa.array(j)), pa.array([x[1] for x in first], pa.string())])
    return pa.table({"lang": pa.repeat(pa.scalar(lang), len(kinds)), "part": kinds, "a": a, "b": b, "value": np.concatenate((value, np.array([x[2] for x in first], np.int64)))})


def divergence(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, top: int = TOP, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", cells: int = CELLS) -> DataFrame:
    """lang, source, part, item, value, rank. Part pair: every other source of the language and how far it is; part term: the
    source's first ``top`` terms by lead over the language's share."""
    counts = materialize(counted(docs, text_col, lang_col, source_col), "terms")
    seen = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= min_documents).select("lang", "term")
    kept = materialize(counts.join(seen, ["lang", "term"], "left_semi").select("lang", "source", "term", "n"), "kept")
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.where("term = ''").select("lang", "source").join(totals, ["lang", "source"], "left").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"))
    sizes = groups.groupBy("lang").agg(F.count("*").alias("n_sources"))
    terms = kept.groupBy("lang", "term").agg(F.lit(1)).groupBy("lang").agg(F.count("*").alias("kept"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("kept") * F.col("n_sources") / cells)).cast("int")
    slices = F.ceil(F.col("n_sources") * F.col("n_sources") / cells).cast("int")
    langs = materialize(sizes.join(terms, "lang", "left").withColumn("kept", F.coalesce("kept", F.lit(0))).select("lang", "kept", blocks.alias("blocks"), slices.alias("slices")), "langs")
    listed = F.broadcast(langs) if langs.count() <= BROADCAST_ROWS else langs

    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = kept.join(listed, "lang").select("lang", "source", "term", "n", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"), numbers("slices").alias("slice"))
    dealt_groups = groups.join(listed, "lang").select("lang", "source", "total", "kept", "slices", numbers("blocks").alias("block")).withColumn("slice", numbers("slices"))
    keys = ["lang", "block", "slice"]
    tiles = dealt_groups.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(lambda g, c: tile(g, c, top), TILE)
    tiles = materialize(tiles, "tiles")

    sums = tiles.where("part = 'pair'").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = F.inline(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = sums.select("lang", F.lit("pair").alias("part"), "value", both)
    leads = tiles.where("part = 'term'").select("lang", "part", "value", F.col("a").alias("source"), F.col("b").alias("item"))
    # heaps of some blocks are merged before those of all, so that no task holds them all
    order = [F.desc("value"), F.asc("item")]
    some = leads.withColumn("n", F.row_number().over(Window.partitionBy("lang", "source", F.pmod(F.xxhash64("item"), F.lit(64))).orderBy(*order))).where(F.col("n") <= top).drop("n")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order)).alias("rank")
    columns = ["lang", "source", "part", "item", "value", rank]
    return pairs.select(*columns).unionByName(some.select(*columns).where(F.col("rank") <= top))
