"""N-gram Jaccard join: a size-aware heavy-light join on sets of word shingles.

Two sets of a and b shingles link when they share at least c(a, b) = ceil(t (a + b) / (1 + t)). Light sets (below a
boundary) enumerate their subsets of every such size c: sets that meet in a subset of size c link if a + b is small
enough, so no check is needed and each bucket is a star around its smallest member. Heavy sets (and light ones large
enough to pair with them) are found through inverted lists of the rarest shingles (each list's prefix by the global
order); lists are first scanned against one leader, and only members that are still in different components meet, past
an exact bound from a parity bitmap and before an exact check of both sets. The boundary is the one of least cost by
the histogram of set sizes.

No pairs within a group of linked sets are listed, equal sets are one class, and no member of a list is left out.

Defined results: a null or blank text has an empty set, is linked with nothing and is its own component; fewer words than
n make one shingle; repeated rows each get a row; rows with a null id link and bridge as others do, and a component of such
rows only has a null id; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil, comb, floor
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfinder.llm.common import bound_batches, hashed_words, mixed, semi_join_checked, slices_of
from wayfinder.shared import BROADCAST_ROWS, materialize

N, PERCENT = 5, 80
#: Counters of the frequency sketch that orders shingles: 2 MB for each task and in all, whatever the input.
SKETCH = 1 << 18
BLOCKS = 64
#: 64-bit words of the parity bitmap.
BITMAP = 8
#: Cells in which the shingles of sets from LARGE on are counted, where the bitmap is too full to tell sets apart.
CELLS, LARGE = 1024, 1000
#: What one posting of an inverted list costs, its share of checks and texts read again included, in subset keys.
SCAN_COST = 8
#: Sizes from which enumeration is never cheaper.
MOST_LIGHT = 40


def shared_least(a: int, b: int, percent: int = PERCENT) -> int:
    """The least overlap with which sets of a and b link."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def subset_sizes(n: int, below: int, percent: int = PERCENT) -> list[int]:
    """The overlaps with which a set of n can link to a light set."""
    return sorted({shared_least(n, b, percent) for b in range(max(1, ceil(n * percent / 100)), min(below - 1, floor(n * 100 / percent)) + 1)} & set(range(1, n + 1)))


def boundary(sizes: dict[int, int], percent: int = PERCENT) -> int:
    """Sets below it are light: the cheapest split of the histogram of set sizes."""
    best, at = None, 1
    for x in range(1, MOST_LIGHT + 1):
        light = sum(k * sum(comb(n, c) for c in subset_sizes(n, x, percent)) for n, k in sizes.items() if n < x)
        heavy = sum(k * prefix_length(n, percent) * SCAN_COST for n, k in sizes.items() if n >= x * percent / 100)
        if best is None or light + heavy < best:
            best, at = light + heavy, x
    return at


def shingle_sets(texts: pa.Array, n: int = N) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the n-word shingles of each text."""
    flat, begin = hashed_words(texts)
    rolled = np.zeros(len(flat), np.uint64)
    for k in range(n):
        if len(flat) > k:
            rolled[: len(flat) - k] = mixed(rolled[: len(flat) - k] + flat[k:] + np.uint64(k))
    out = []
    for at, end in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
        if end - at >= n:
            out.append(np.unique(rolled[at : end - n + 1]))
        else:
            short = np.zeros(1, np.uint64)
            for k in range(end - at):
                short = mixed(short + flat[at + k] + np.uint64(k))
            out.append(short + np.uint64(end - at) if end > at else np.empty(0, np.uint64))
    return out


def parity(shingles: np.ndarray) -> np.ndarray:
    """Bits that an odd number of shingles falls on; two bitmaps differ in at most as many bits as the sets do."""
    odd = np.bincount((shingles >> np.uint64(20)) % np.uint64(64 * BITMAP), minlength=64 * BITMAP) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view("<i8")


def cell_counts(shingles: np.ndarray) -> np.ndarray:
    """Shingles by cell; the differences of two sets' cells add up to no more than the sets' difference."""
    return np.bincount((shingles >> np.uint64(34)) % np.uint64(CELLS), minlength=CELLS)


def sketch_counts(rows: DataFrame, n: int) -> np.ndarray:
    """Shingles of all texts, counted by SKETCH hash cells."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH, np.int64)
        for part in slices_of(batches):
            total += np.bincount(np.concatenate(shingle_sets(part.column(0), n)) % np.uint64(SKETCH), minlength=SKETCH)
        yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([x.tobytes() for x in np.split(total, BLOCKS)], pa.binary())], names=["block", "counts"])

    def add(key: tuple, table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64) for x in table.column("counts").to_pylist())
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    found = rows.select("text").mapInArrow(scan, "block int, counts binary").groupBy("block").applyInArrow(add, "block int, counts binary").collect()
    total = np.zeros((BLOCKS, SKETCH // BLOCKS), np.int64)
    for r in found:
        total[r["block"]] = np.frombuffer(r["counts"], np.int64)
    return total.ravel()


KEYED = "id long, rk long, n long, h1 long, h2 long, bitmap array<long>, cells array<int>, keys array<long>"


def keyed_sets(rows: DataFrame, order: np.ndarray, n: int, percent: int) -> DataFrame:
    """Size, two hashes of the whole set, bitmap, and the prefix (sets of up to MOST_LIGHT: all shingles), rarest first."""
    sent = rows.sparkSession.sparkContext.broadcast(order.astype(np.uint32 if order.max(initial=0) < 1 << 32 else np.int64))
    kinds = [pa.int64()] * 3 + [pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64())]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices_of(batches):
            found = shingle_sets(part.column(2), n)
            full = [i for i, s in enumerate(found) if len(s)]
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for s in (found[i] for i in full):
                ranked = s[np.lexsort((s, sent.value[s % np.uint64(SKETCH)]))]
                keep = len(s) if len(s) <= MOST_LIGHT else prefix_length(len(s), percent)
                row = len(s), int(np.bitwise_xor.reduce(mixed(s)).view(np.int64)), int(mixed(s + np.uint64(1)).sum().view(np.int64)), parity(s), cell_counts(s) if len(s) >= LARGE else None, ranked[:keep].view(np.int64)
                for col, x in zip(out, row, strict=True):
                    col.append(x)
            own = part.select([0, 1]).take(pa.array(full, pa.int64()))
            yield pa.RecordBatch.from_arrays([*own.columns, *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=["id", "rk", "n", "h1", "h2", "bitmap", "cells", "keys"])

    return rows.mapInArrow(scan, KEYED)


def light_links(sets: DataFrame, below: int, percent: int) -> DataFrame:
    """a, b: stars within the buckets of light sets' subsets."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for i, n, keys in zip(*(batch.column(c).to_pylist() for c in ("id", "n", "keys")), strict=True):
                whole = np.sort(np.array(keys, np.int64)).view(np.uint64)
                for c in subset_sizes(n, below, percent):
                    for combo in combinations(range(n), c):
                        for col, x in zip(out, (i, n, c, int((mixed(whole[list(combo)]).sum() + np.uint64(c)).view(np.int64))), strict=True):
                            col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["id", "n", "c", "key"])

    subsets = sets.where(F.col("n") < below).select("id", "n", "keys").mapInArrow(scan, "id long, n long, c long, key long")
    least = subsets.groupBy("key", "c").agg(F.min(F.struct("n", "id")).alias("least"), F.count("*").alias("members")).where("members > 1")
    met = subsets.join(least, ["key", "c"]).where((F.col("id") != F.col("least.id")) & (percent * (F.col("n") + F.col("least.n")) <= (100 + percent) * F.col("c")))
    return met.select(F.col("least.id").alias("a"), F.col("id").alias("b"))


def may_link(a: str, b: str, percent: int) -> Column:
    """Bounds that no linked pair breaks: sizes, and bits in which the sets differ against the largest allowed difference."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    bits = sum((F.bit_count(F.col(f"{a}.bitmap")[k].bitwiseXOR(F.col(f"{b}.bitmap")[k])) for k in range(BITMAP)), F.lit(0))
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & ((100 + percent) * bits <= (100 - percent) * (na + nb))


def both_large(a: str, b: str) -> Column:
    return F.least(F.col(f"{a}.n"), F.col(f"{b}.n")) >= LARGE


def within_cells(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of written pairs (a, b, large), those whose cells may link; only pairs of large sets have cells, and only they carry them."""
    cells = sets.where(F.col("cells").isNotNull()).select("id", "n", "cells")
    both = pairs.where("large").join(cells.alias("x"), F.col("a") == F.col("x.id")).join(cells.alias("y"), F.col("b") == F.col("y.id"))
    apart = F.aggregate(F.zip_with("x.cells", "y.cells", lambda x, y: F.abs(x - y)), F.lit(0), lambda t, x: t + x)
    near = both.where((100 + percent) * apart <= (100 - percent) * (F.col("x.n") + F.col("y.n"))).select("a", "b")
    return materialize(pairs.where("not large").select("a", "b").unionByName(near), "near")


def verified(pairs: DataFrame, names: DataFrame, rows: DataFrame, n: int, percent: int) -> DataFrame:
    """Of candidate pairs (a, b), those that link by their whole sets. names: id of each set and rk of a row that has it; the
    sets are made again for the rows in pairs only, once in a task for each rk."""
    ids = materialize(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(names, "id"), "ids")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for part in slices_of(batches):
            new = [i for i, rk in enumerate(part.column(0).to_pylist()) if rk not in done and not done.add(rk)]
            own = part.take(pa.array(new, pa.int64()))
            yield pa.RecordBatch.from_arrays([own.column(0), pa.array([s.view(np.int64) for s in shingle_sets(own.column(1), n)], pa.list_(pa.int64()))], names=["rk", "s"])

    wanted = semi_join_checked(rows, ids, "rk", ids.count()).select("rk", "text").mapInArrow(scan, "rk long, s array<long>")
    sets = materialize(wanted.join(ids, "rk").select("id", "s"), "sets")
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.where((100 + percent) * shared >= percent * (F.size("sa") + F.size("sb"))).select("a", "b").distinct()


def components(links: DataFrame, rounds: int = 40) -> DataFrame:
    """id, component (the smallest id reachable) of every id in links (a, b), by alternating large and small stars."""
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    for _ in range(rounds):
        twice = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = twice.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = twice.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = materialize(small, "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    ends = edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "id")
    return ends.unionByName(ends.select(F.col("component").alias("id"), "component").distinct())


def jaccard_join(docs: DataFrame, n: int = N, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest id that links of Jaccard similarity percent / 100 reach."""
    return grouped_rows(docs, n, percent, id_col, text_col).select("doc_id", "n_shingles", "component_id")


def row_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col).cast("long"), text_col)


def grouped_rows(docs: DataFrame, n: int = N, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, and rk (row_key) and component (a number of the component, null without words) of every row.

    Sets go by the number of their written row (id below), as a doc_id may be null."""
    rows = bound_batches(docs).select(F.col(id_col).cast("long").alias("id"), row_key(id_col, text_col).alias("rk"), F.col(text_col).alias("text"))
    order = sketch_counts(rows, n)
    sets = keyed_sets(rows, order, n, percent).withColumnRenamed("id", "doc")
    sets = materialize(sets.withColumn("id", F.monotonically_increasing_id()), "keyed")
    classes = materialize(sets.groupBy("h1", "h2", "n").agg(F.min("id").alias("rep"), F.min("doc").alias("least")), "classes")
    copies = materialize(sets.select("id", "h1", "h2", "n").join(classes, ["h1", "h2", "n"]).where("id <> rep").select("id"), "copies")
    reps = sets.join(F.broadcast(copies) if copies.count() <= BROADCAST_ROWS else copies, "id", "left_anti")
    names = reps.select("id", "rk")
    sizes = {r["n"]: r["count"] for r in classes.where(F.col("n") <= MOST_LIGHT).groupBy("n").count().collect()}
    below = boundary(sizes, percent)

    by_light = light_links(reps, below, percent)
    prefix = F.slice("keys", 1, (F.col("n") - F.ceil(percent * F.col("n") / 100) + 1).cast("int"))
    postings = reps.where(100 * F.col("n") >= percent * below).select("id", "n", F.posexplode(prefix).alias("pos", "key"))
    lists = postings.groupBy("key").agg(F.count("*").alias("members")).where("members > 1").select("key")
    met = materialize(postings.join(lists, "key"), "lists")
    bounds = reps.select("id", "n", "bitmap")
    # a list's leader is the member that shares most of its shingles: what near copies were made from, rather than one of them
    central = met.groupBy("id").agg((F.count("*") * 1_000_000 / F.min("n")).cast("long").alias("shared"))
    leaders = met.join(central, "id").groupBy("key").agg(F.max(F.struct("shared", -F.col("id"), "n")).alias("l")).select("key", "l.shared", (-F.col("l.col2")).alias("leader"), F.col("l.n").alias("leader_n"))
    # one leader for each member: those of its other lists come with the rest, unless they are in one component by then
    sized = 100 * F.least("n", "leader_n") >= percent * F.greatest("n", "leader_n")
    starred = met.join(leaders, "key").where((F.col("id") != F.col("leader")) & sized).groupBy(F.col("id").alias("b")).agg(F.max(F.struct("shared", -F.col("leader"))).alias("l")).select("b", (-F.col("l.col2")).alias("a"))
    starred = starred.join(bounds.alias("x"), F.col("a") == F.col("x.id")).join(bounds.alias("y"), F.col("b") == F.col("y.id")).where(may_link("x", "y", percent)).select("a", "b", both_large("x", "y").alias("large"))
    first = components(by_light.unionByName(verified(within_cells(materialize(starred, "starred"), sets, percent), names, rows, n, percent)))

    part = materialize(met.select("key", "id", "pos").join(first, "id", "left").withColumn("component", F.coalesce("component", "id")), "part")
    mixed_lists = part.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    rest = materialize(part.join(mixed_lists, "key", "left_semi").join(bounds, "id"), "rest")
    x, y = rest.alias("x"), rest.alias("y")
    # of the shingles that a pair shares, the first leaves room for the whole overlap; later ones that don't are not needed
    room = (100 + percent) * F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos")) >= percent * (F.col("x.n") + F.col("y.n"))
    apart = (F.col("x.key") == F.col("y.key")) & (F.col("x.component") < F.col("y.component")) & room & may_link("x", "y", percent)
    crossed = materialize(x.join(y, apart).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), both_large("x", "y").alias("large")).distinct(), "crossed")
    second = verified(within_cells(crossed, sets, percent), names, rows, n, percent)
    over = part.select("id", "component").distinct()
    merged = components(second.join(over.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a").join(over.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    renamed = merged.select(F.col("id").alias("component"), F.col("component").alias("merged"))
    final = first.join(renamed, "component", "left").select(F.col("id").alias("rep"), F.coalesce("merged", "component").alias("component"))
    final = materialize(final.unionByName(merged.join(first, "id", "left_anti").select(F.col("id").alias("rep"), "component")), "final")

    linked = classes.join(final, "rep")
    names_of = linked.groupBy("component").agg(F.min("least").alias("named"))
    known = classes.join(linked.select("rep", "component").join(names_of, "component"), "rep", "left").select("h1", "h2", "n", F.coalesce("component", "rep").alias("component"), F.when(F.col("component").isNull(), F.col("least")).otherwise(F.col("named")).alias("component_id"))
    members = sets.select("doc", "rk", "n", "h1", "h2").join(known, ["h1", "h2", "n"]).select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", "rk", "component")
    blank = rows.where(F.coalesce(F.regexp_replace("text", r"[\x20\x09-\x0D]+", ""), F.lit("")) == "").select(F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("n_shingles"), F.col("id").alias("component_id"), "rk", F.lit(None).cast("long").alias("component"))
    return members.unionByName(blank)


def keep_one(docs: DataFrame, grouped: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of grouped_rows (that of the smallest id, null last), with all columns; rows without words all stay."""
    found = materialize(grouped.where("component is not null").select("component", "rk", F.col("doc_id").isNull().alias("last"), "doc_id"), "grouped")
    best = found.groupBy("component").agg(F.min(F.struct("last", "doc_id", "rk")).alias("best"))
    judged = found.join(best, "component").select("component", "rk", (F.col("rk") == F.col("best.rk")).alias("kept"))
    gone = materialize(judged.where("not kept").select("rk").distinct(), "gone")
    twice = materialize(judged.where("kept").groupBy("rk").count().where("count > 1").select("rk"), "twice")
    rk = f"__rk_{uuid4().hex}"  # clashes with no column

    def listed(keys: DataFrame) -> DataFrame:
        named = keys.withColumnRenamed("rk", rk)
        return F.broadcast(named) if keys.count() <= BROADCAST_ROWS else named

    left = docs.withColumn(rk, row_key(id_col, text_col)).join(listed(gone), rk, "left_anti")
    again = listed(twice)
    return left.join(again, rk, "left_anti").unionByName(left.join(again, rk, "left_semi").dropDuplicates([rk])).drop(rk)
