"""An index for vectors that finds exactly what a scan finds, and reads little of it.

Vectors lie twice in a folder, both only ever appended to. ``codes``: a byte for each component, in folders by the nearest of
some coarse centroids, with a bound on what rounding lost; ``vectors``: the vectors themselves, in folders by a hash of the id.
A search reads codes, from which an inner product is known within that bound; a list of codes is passed over if its centroid
and radius show that it can't reach what nearer lists have. Only vectors that the bound can't rule out are read whole, from
the folders of their ids. Bounds prove the result; on vectors without structure all codes are read, a quarter of the bytes.

A later change of a vector, or its removal (null), is a row of a higher number, as in the text index.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfinder.functions.text import cosine_distance
from wayfinder.operators.postings import BUCKETS, bucket_of
from wayfinder.shared import BROADCAST_ROWS, fresh_path, materialize

#: Vectors, by hash of their id, that centroids are made from; centroids at most; rounds; lists that a search reads first.
SAMPLE, CENTROIDS, ROUNDS, FIRST_LISTS = 20_000, 256, 8, 8
#: What float arithmetic may add to a bound.
SLACK = 1e-6
CODES = "entity_id string, change int, code binary, scale double, lost double, list int"
VECTORS = "entity_id string, change int, vector array<float>, bucket int"
LISTS = "list int, radius double, n long"


def unit_rows(vectors: pa.Array, size: int) -> np.ndarray:
    """Rows of length 1 (or 0) as doubles; an error for a vector of another size."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(flat) != size * len(vectors) or any(n != size for n in pa.compute.list_value_length(vectors).unique().to_pylist()):
        raise ValueError(f"vectors of different dimensions, where {size} are indexed")
    x = flat.reshape(-1, size)
    length = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(length > 0, length, 1)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row, and how far it is."""
    square = (x * x).sum(axis=1)[:, None] - 2 * x @ centroids.T + (centroids * centroids).sum(axis=1)[None, :]
    at = square.argmin(axis=1)
    return at, np.sqrt(np.maximum(square[np.arange(len(x)), at], 0))


def coarse_centroids(x: np.ndarray, most: int = CENTROIDS, rounds: int = ROUNDS) -> np.ndarray:
    """Means of groups of a bounded sample, begun from rows spread over it."""
    n = max(1, min(most, int(len(x) ** 0.5)))
    c = x[np.linspace(0, len(x) - 1, n).astype(int)].copy() if len(x) else np.zeros((1, x.shape[1]))
    for _ in range(rounds if len(x) else 0):
        at, _ = nearest(x, c)
        size = np.bincount(at, minlength=n)
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        c[size > 0] = total[size > 0] / size[size > 0, None]
    return c


@dataclass(frozen=True)
class VectorIndex:
    spark: SparkSession
    folder: str
    centroids: np.ndarray
    change: int = -1

    @staticmethod
    def build(embeddings: DataFrame, folder: str | None = None) -> VectorIndex:
        """An index of embeddings (entity_id, vector)."""
        spark = embeddings.sparkSession
        sample = embeddings.where("vector is not null").select("vector", F.xxhash64("entity_id").alias("h")).orderBy("h").limit(SAMPLE).collect()  # SAMPLE at most
        size = len(sample[0]["vector"]) if sample else 1
        x = unit_rows(pa.array([r["vector"] for r in sample], pa.list_(pa.float32())), size) if sample else np.zeros((0, 1))
        return VectorIndex(spark, folder or fresh_path(spark, "vector-index"), coarse_centroids(x)).put(embeddings)

    def put(self, embeddings: DataFrame) -> VectorIndex:
        """The index after vectors (entity_id, vector) were added, changed or, with a null vector, taken away; each id stands once."""
        change, centroids = self.change + 1, self.centroids
        rows = materialize(embeddings.select(F.col("entity_id"), F.lit(change).alias("change"), F.col("vector").cast("array<float>").alias("vector"), bucket_of(F.col("entity_id")).alias("bucket")), "put")
        rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "entity_id").write.mode("append").partitionBy("bucket").parquet(f"{self.folder}/vectors")

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                there = batch.filter(pa.compute.is_valid(batch.column("vector")))
                if there.num_rows:
                    x = unit_rows(there.column("vector"), centroids.shape[1])
                    scale = np.abs(x).max(axis=1) / 127
                    code = np.rint(x / np.where(scale > 0, scale, 1)[:, None]).astype(np.int8)
                    lost = np.sqrt(((x - code * scale[:, None]) ** 2).sum(axis=1)) + SLACK
                    at, far = nearest(x, centroids)
                    yield pa.RecordBatch.from_arrays([there.column("entity_id"), there.column("change"), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(scale), pa.array(lost), pa.array(at.astype(np.int32)), pa.array(far)], names=["entity_id", "change", "code", "scale", "lost", "list", "far"])

        codes = materialize(rows.select("entity_id", "change", "vector").mapInArrow(encode, CODES + ", far double"), "codes")
        codes.drop("far").hint("rebalance", "list").write.mode("append").partitionBy("list").parquet(f"{self.folder}/codes")
        codes.groupBy("list").agg((F.max("far") + SLACK).alias("radius"), F.count("*").alias("n")).coalesce(1).write.mode("append").parquet(f"{self.folder}/lists")
        return VectorIndex(self.spark, self.folder, centroids, change)

    def remove(self, ids: DataFrame) -> VectorIndex:
        """The index without the vectors of ids (entity_id)."""
        return self.put(ids.select("entity_id", F.lit(None).cast("array<float>").alias("vector")))

    def codes(self, lists: list[int]) -> DataFrame:
        """Codes of some lists that no later change replaced; where there was none, ids aren't compared."""
        found = self.spark.read.schema(CODES).parquet(f"{self.folder}/codes").where(F.col("list").isin(lists) & (F.col("change") <= self.change))
        if not self.change:
            return found
        last = self.spark.read.schema(VECTORS).parquet(f"{self.folder}/vectors").where((F.col("change") <= self.change) & (F.col("change") > 0)).groupBy("entity_id").agg(F.max("change").alias("last"))
        return found.join(last, "entity_id", "left").where(F.col("change") == F.coalesce("last", F.col("change"))).drop("last")

    def bounded(self, q: np.ndarray, k: int, lists: list[int]) -> DataFrame:
        """entity_id, least, most: bounds on the inner product with q, of the vectors that may be among the first k of their task."""

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, low, high = [], np.empty(0), np.empty(0)
            for batch in batches:
                code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.int8).reshape(batch.num_rows, -1)
                about = (code @ q) * batch.column("scale").to_numpy()
                lost = batch.column("lost").to_numpy() + SLACK
                ids += batch.column("entity_id").to_pylist()
                low, high = np.concatenate((low, about - lost)), np.concatenate((high, about + lost))
                if len(low) > k:
                    keep = np.flatnonzero(high >= np.partition(low, len(low) - k)[len(low) - k])
                    ids, low, high = [ids[i] for i in keep], low[keep], high[keep]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(low), pa.array(high)], names=["entity_id", "least", "most"])

        return self.codes(lists).select("entity_id", "code", "scale", "lost").mapInArrow(scan, "entity_id string, least double, most double")

    def find(self, vector: list[float], k: int) -> tuple[DataFrame, dict]:
        """entity_id, distance of the k nearest by cosine distance, ties to the smaller id; and what was read: lists and codes of
        all, and vectors. Equal to a scan of all vectors."""
        if len(vector) != self.centroids.shape[1]:
            raise ValueError(f"a vector of {len(vector)} dimensions, where {self.centroids.shape[1]} are indexed")
        q = unit_rows(pa.array([vector], pa.list_(pa.float64())), len(vector))[0]
        sizes = self.spark.read.schema(LISTS).parquet(f"{self.folder}/lists").groupBy("list").agg(F.max("radius").alias("radius"), F.sum("n").alias("n")).collect()  # CENTROIDS at most
        apart = {r["list"]: float(np.sqrt(((self.centroids[r["list"]] - q) ** 2).sum())) for r in sizes}
        # what a list can hold at most: q and its vectors have length 1 (a zero vector has inner product 0)
        reach = {r["list"]: max(0.0, (1 + float(q @ q) - max(0.0, apart[r["list"]] - r["radius"]) ** 2) / 2) + SLACK for r in sizes}
        near = sorted(reach, key=lambda i: apart[i])
        first, rest = near[:FIRST_LISTS], near[FIRST_LISTS:]
        found = materialize(self.bounded(q, k, first), "near")
        floor = self._floor(found, k)
        more = [i for i in rest if floor is None or reach[i] >= floor]
        if more:
            found = materialize(found.unionByName(self.bounded(q, k, more)), "near")
            floor = self._floor(found, k)
        fits = materialize((found if floor is None else found.where(F.col("most") >= floor)).select("entity_id", bucket_of(F.col("entity_id")).alias("bucket")), "fits")
        n = fits.count()
        vectors = self.spark.read.schema(VECTORS).parquet(f"{self.folder}/vectors").where(F.col("change") <= self.change)
        met = vectors.join(F.broadcast(fits) if n <= BROADCAST_ROWS else fits, ["bucket", "entity_id"]).groupBy("entity_id").agg(F.max_by("vector", "change").alias("vector"))
        exact = met.select("entity_id", cosine_distance(F.col("vector"), F.array(*(F.lit(float(x)) for x in vector))).alias("distance")).orderBy("distance", "entity_id").limit(k)
        total = sum(r["n"] for r in sizes)
        return exact, {"lists": len(first) + len(more), "of_lists": len(near), "codes": sum(r["n"] for r in sizes if r["list"] in {*first, *more}), "of_codes": total, "vectors": n}

    @staticmethod
    def _floor(found: DataFrame, k: int) -> float | None:
        """What the k-th best has at least; None for fewer."""
        best = found.orderBy(F.desc("least")).limit(k).agg(F.count("*").alias("n"), F.min("least").alias("least")).head()
        return best["least"] if best["n"] == k else None
