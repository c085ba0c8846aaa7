"""Approximate nearest neighbours by a permutation index.

Every vector is represented by its nearest pivots in order. Vectors are indexed in segments of bounded size, as search
engines shard by document; a segment posts each vector, with the place that a pivot has in its list, in that pivot's
inverted file. A query adds up, over the files of its own pivots, min(L - place in query, L - place in vector), which ranks
by the footrule distance of the truncated lists (the distance is a constant less twice this sum). The best share of a
segment is reranked exactly.

Defined results: vectors that are null, zero, of another length than most, or that hold null or non-finite components take
no part; equal scores go to the smaller id; repeated ids are candidates of their own, but a query asks once (of several
vectors the smallest) and no row with its id is a candidate of its own; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PIVOTS, LIST, SEGMENT, RERANK = 2048, 64, 8192, 0.07
#: Queries that meet a segment in one task, and that are added up together.
BLOCK, TOGETHER = 32_768, 32
#: Vectors among which pivots are chosen, by hash of the id.
PIVOT_SAMPLE = 8192


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where("id is not null and v is not null")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    return v.where(fine)


def pivot_lists(x: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """The ids of the nearest pivots by cosine, nearest first."""
    near = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ pivots.T
    length = min(length, near.shape[1])
    top = np.argpartition(-near, length - 1, axis=1)[:, :length]
    order = np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable")
    return np.take_along_axis(top, order, 1).astype(np.int16)


class Segment:
    """Inverted files of the pivots over one segment; rows are sorted by id."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, lists: np.ndarray, n_pivots: int):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x, lists = ids[order], x[order], lists[order]
        self.length = lists.shape[1]
        place = np.tile(np.arange(self.length), len(lists))
        by_pivot = np.argsort(lists.ravel(), kind="stable")
        self.rows = np.repeat(np.arange(len(lists)), self.length)[by_pivot]
        self.left = (self.length - place)[by_pivot]
        self.cut = np.searchsorted(lists.ravel()[by_pivot], np.arange(n_pivots + 1))

    def shared(self, lists: np.ndarray) -> np.ndarray:
        """By query and row: what the files of the query's pivots add up to."""
        begin, size = self.cut[lists], np.diff(self.cut)[lists]  # queries x places
        flat = size.ravel()
        at = np.arange(flat.sum()) + np.repeat(begin.ravel() - (np.cumsum(flat) - flat), flat)
        most = np.repeat(np.tile(self.length - np.arange(lists.shape[1]), len(lists)), flat)
        query = np.repeat(np.arange(len(lists)), size.sum(axis=1))
        n = len(self.ids)
        return np.bincount(query * n + self.rows[at], np.minimum(self.left[at], most), len(lists) * n).reshape(len(lists), n)

    def search(self, queries: np.ndarray, x: np.ndarray, lists: np.ndarray, k: int, rerank: float) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids and scores of the best k of the rows nearest by footrule distance, by query."""
        n, out = len(self.ids), []
        most = min(n, max(10 * k, int(rerank * n)))
        for query, v, shared in zip(queries.tolist(), x, self.shared(lists), strict=True):
            rank = shared * (n + 1) - np.arange(n)  # ties go to the smaller id
            rank[self.ids == query] = -np.inf
            near = np.argpartition(-rank, most - 1)[:most] if most < n else np.arange(n)
            near = near[self.ids[near] != query]
            score = (self.x[near] * v).sum(axis=1)  # row by row, so that equal vectors get equal scores
            best = np.lexsort((self.ids[near], -score))[:k]
            out.append((self.ids[near][best], score[best]))
        return out


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", pivots: int = PIVOTS, length: int = LIST, segment: int = SEGMENT, rerank: float = RERANK, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score. Queries meet every segment in blocks of about ``block``; each pair of a segment and a block is a task of bounded size."""
    if pivots > np.iinfo(np.int16).max:
        raise ValueError("pivots are numbered in 16 bits")
    rows, asked = usable(vectors, id_col, vec_col), usable(queries, id_col, vec_col)
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").head()
    schema = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return rows.sparkSession.createDataFrame([], schema)
    rows, asked = rows.where(F.size("v") == sizes["d"]), asked.where(F.size("v") == sizes["d"])
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(PIVOT_SAMPLE).collect()
    kept = np.unique(np.array([r["v"] for r in sample]), axis=0)
    kept = kept[np.random.default_rng(11).permutation(len(kept))[:pivots]]
    sent = rows.sparkSession.sparkContext.broadcast(kept / np.linalg.norm(kept, axis=1, keepdims=True))
    d = sizes["d"]

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):  # so many rows times the pivots are held at once
                part = batch.slice(at, 2048)
                x = np.array(part.column("v").flatten()).reshape(-1, d)
                lists = pivot_lists(x, sent.value, length)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([r.tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in lists], pa.binary())], names=["id", "x", "lists"])

    n_segments = -(-sizes["count"] // segment)
    n_blocks = max(1, -(-asked.count() // block))
    index = rows.mapInArrow(post, "id long, x binary, lists binary").withColumn("seg", F.pmod(F.xxhash64("id", "x"), F.lit(n_segments)))
    probes = asked.groupBy("id").agg(F.min("v").alias("v")).mapInArrow(post, "id long, x binary, lists binary").withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n_blocks)))
    pair_up = lambda df, own, other, n: df.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>")))
    left = pair_up(index, "seg", "block", n_blocks).groupBy("seg", "block")
    right = pair_up(probes, "block", "seg", n_segments).groupBy("seg", "block")

    def probe(a: pa.Table, b: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if a.num_rows and b.num_rows:
            unpack = lambda t, c, kind: np.frombuffer(b"".join(t.column(c).to_pylist()), kind).reshape(t.num_rows, -1)
            part = Segment(a.column("id").to_numpy(), unpack(a, "x", np.float64), unpack(a, "lists", np.int16).astype(np.int32), len(sent.value))
            asking, x, lists = b.column("id").to_numpy(), unpack(b, "x", np.float64), unpack(b, "lists", np.int16).astype(np.int32)
            for i in range(0, len(asking), TOGETHER):
                some = slice(i, i + TOGETHER)
                for q, (ids, score) in zip(asking[some].tolist(), part.search(asking[some], x[some], lists[some], k, rerank), strict=True):
                    out.append((np.full(len(ids), q), ids, score))
        cols = [np.concatenate([o[i] for o in out]) if out else np.empty(0) for i in range(3)]
        return pa.table({"query_id": pa.array(cols[0].astype(np.int64)), "vec_id": pa.array(cols[1].astype(np.int64)), "score": pa.array(cols[2].astype(np.float64))})

    found = left.cogroup(right).applyInArrow(probe, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
