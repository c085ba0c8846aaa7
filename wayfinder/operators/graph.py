"""Graph operators: bounded traversal, closure of a selection, degrees, focus and the structural tree."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfinder.operators.ranking import numbered
from wayfinder.schema import EDGE_KINDS
from wayfinder.shared import BROADCAST_ROWS, materialize

# Which edges make the explorer's tree: relation, kinds of parent, kind of child, priority.
TREE = (("contains", ("repo",), "component", 60), ("documented_by", ("repo", "component"), "doc", 55), ("contains", ("component",), "source_unit", 50), ("defines", ("source_unit",), "symbol", 40), ("tested_by", ("source_unit",), "test", 39), ("benchmarked_by", ("source_unit",), "bench", 38))


def rel_order(rel: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, EDGE_KINDS)), rel).cast("int")


def neighbours(edges: DataFrame) -> DataFrame:
    """id, way (0 out, 1 in), rel_at, other: both directions of every edge."""
    out = edges.select(F.col("src_id").alias("id"), F.lit(0).alias("way"), rel_order(F.col("rel")).alias("rel_at"), F.col("dst_id").alias("other"))
    back = edges.select(F.col("dst_id").alias("id"), F.lit(1).alias("way"), rel_order(F.col("rel")).alias("rel_at"), F.col("src_id").alias("other"))
    return out.unionByName(back)


def admitted(entities: DataFrame, kinds: list[str] | None = None, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Entities of the kinds (all for None) whose id holds none of the excluded strings."""
    if kinds is not None:
        entities = entities.where(F.col("kind").isin(kinds))
    return entities.where(~reduce(lambda a, b: a | b, [F.col("id").contains(x) for x in exclude], F.lit(False)))


def traverse(entities: DataFrame, edges: DataFrame, seeds: DataFrame, max_depth: int, max_nodes: int, kinds: list[str] | None = None, exclude: tuple[str, ...] = (), broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """id, depth, ord of breadth-first search from seeds (id, ord), in the order of a queue.

    Each level orders its finds by parent, direction (out first), relation and id; missing or excluded entities cost no
    budget and lead nowhere. A level is a written table whose order is found in ranges; the driver holds counts alone.
    """
    known = materialize(admitted(entities, kinds, exclude).select("id").distinct(), "known")
    links = neighbours(edges)
    listed = lambda df, n: F.broadcast(df) if n <= broadcast_rows else df

    def placed(rows: DataFrame, order: list[Column], depth: int, before: int) -> tuple[DataFrame, int]:
        places = numbered(rows, order, "place", "level").where(F.col("place") <= max_nodes - before)
        level = places.select("id", F.lit(depth).alias("depth"), (F.col("place") - 1 + before).cast("int").alias("ord"))
        return level, level.count()

    first = seeds.groupBy("id").agg(F.min("ord").alias("at")).join(known, "id", "left_semi")
    level, n = placed(first, [F.col("at"), F.col("id")], 0, 0)
    found, total = level, n
    for depth in range(1, max_depth + 1):
        if not n or total >= max_nodes:
            break
        near = links.join(listed(level.select("id", "ord"), n), "id").select(F.col("other").alias("id"), F.struct("ord", "way", "rel_at", "other").alias("key"))
        fresh = near.groupBy("id").agg(F.min("key").alias("key")).join(found.select("id"), "id", "left_anti").join(known, "id", "left_semi")
        level, n = placed(fresh, [F.col("key")], depth, total)
        found, total = found.unionByName(level), total + n
    return found


def drawing_seeds(entities: DataFrame, start: str | None = None) -> DataFrame:
    """id, ord: where a drawing begins: the given entity, or the repository, or, without one, every entity."""
    if start is not None:
        return entities.sparkSession.createDataFrame([(start, 0)], "id string, ord int")
    repo = entities.where("id = 'repo::.'")
    return (entities if repo.isEmpty() else repo).select("id", F.lit(0).alias("ord"))


def depths(entities: DataFrame, edges: DataFrame, seeds: DataFrame, max_depth: int, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """id, depth of all entities within max_depth edges of seeds (id), without a bound on their number.

    Each level is written to the shared folder and only counted on the driver; a frontier is broadcast while its counted
    ids fit the bound, so that a hub's edges stay where they are read."""
    known, links = entities.select("id").distinct(), neighbours(edges)
    level = found = materialize(seeds.select("id").distinct().join(known, "id", "left_semi").withColumn("depth", F.lit(0)), "level")
    for depth in range(1, max_depth + 1):
        n = level.count()
        if not n:
            break
        frontier = level.select("id")
        near = links.join(F.broadcast(frontier) if n <= broadcast_rows else frontier, "id", "left_semi").select(F.col("other").alias("id")).distinct()
        fresh = near.join(found.select("id"), "id", "left_anti").join(known, "id", "left_semi")
        level = materialize(fresh.withColumn("depth", F.lit(depth)), "level")
        found = found.unionByName(level)
    return found


def edges_between(edges: DataFrame, selected: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Edges with both ends in selected (column id). With max_depth (and column depth), those between two nodes at that depth are left out, as they were never expanded."""
    s = selected.withColumnRenamed("id", "src_id")
    d = selected.withColumnRenamed("id", "dst_id")
    if max_depth is None:
        return edges.join(s.select("src_id"), "src_id", "left_semi").join(d.select("dst_id"), "dst_id", "left_semi").select(*edges.columns)
    both = edges.join(s.select("src_id", F.col("depth").alias("sd")), "src_id").join(d.select("dst_id", F.col("depth").alias("dd")), "dst_id")
    return both.where((F.col("sd") < max_depth) | (F.col("dd") < max_depth)).select(*edges.columns)


def degrees(edges: DataFrame) -> DataFrame:
    """id, neighbours (distinct), edges."""
    return neighbours(edges).groupBy("id").agg(F.count_distinct("other").alias("neighbours"), F.count("*").alias("edges"))


def focus(entities: DataFrame, edges: DataFrame, kind_rank: list[str]) -> DataFrame:
    """The entity to draw in the middle: by kind (earlier in the list is better), edges, exported, id."""
    n = neighbours(edges).groupBy("id").count()
    place = F.array_position(F.array(*map(F.lit, kind_rank)), F.col("kind"))
    rank = F.when(place > 0, -place).otherwise(-len(kind_rank) - 1)
    return entities.join(n, "id", "left").agg(F.max_by("id", F.struct(rank, F.coalesce("count", F.lit(0)), F.col("exported"), "id")).alias("id"))


def overview(entities: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The repository at a glance: repo, components, documents and source units with containment and documentation."""
    some = entities.where(F.col("kind").isin("repo", "component", "doc", "source_unit"))
    return some, edges_between(edges.where(F.col("rel").isin("contains", "documented_by")), some.select("id"))


def tree_parents(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """child, parent, rel, priority: for each child the parent of highest priority, ties to the smaller id."""
    e = edges.join(entities.select(F.col("id").alias("src_id"), F.col("kind").alias("pk")), "src_id").join(entities.select(F.col("id").alias("dst_id"), F.col("kind").alias("ck")), "dst_id")
    priority = F.coalesce(*(F.when((F.col("rel") == r) & F.col("pk").isin(list(p)) & (F.col("ck") == c), n) for r, p, c, n in TREE))
    best = e.withColumn("priority", priority).where("priority is not null").groupBy(F.col("dst_id").alias("child")).agg(F.min(F.struct(-F.col("priority"), "src_id", "rel")).alias("b"))
    return best.select("child", F.col("b.src_id").alias("parent"), F.col("b.rel").alias("rel"), (-F.col("b.col1")).alias("priority"))


def descendants(entities: DataFrame, parents: DataFrame, levels: int = 4) -> DataFrame:
    """id, kind, n: descendants in the tree by kind. The tree has at most so many levels, by its rules."""
    up = parents.select("child", F.col("parent").alias("id"))
    all_up = up
    for _ in range(levels - 1):
        up = up.join(parents.select(F.col("child").alias("id"), F.col("parent").alias("above")), "id").select("child", F.col("above").alias("id"))
        all_up = all_up.unionByName(up)
    return all_up.join(entities.select(F.col("id").alias("child"), "kind"), "child").groupBy("id", "kind").agg(F.count("*").alias("n"))


def explorer_search(entities: DataFrame, summaries: DataFrame, query: str, kind_order: list[str], most: int = 12) -> DataFrame:
    """The explorer's own search: all terms must occur; prefixes and hits of the whole query score."""
    whole, terms = " ".join(query.lower().split()), query.lower().split()
    s = summaries.select(F.col("entity_id").alias("id"), F.concat_ws(" ", "short_summary", "detailed_summary").alias("summary"))
    e = entities.join(s, "id", "left").select("id", "name", "kind", F.lower("name").alias("t"), F.lower(F.coalesce("path", F.lit(""))).alias("p"), F.lower("id").alias("i"), F.lower(F.coalesce("summary", F.lit(""))).alias("s"))
    text = F.concat_ws(" ", "t", "p", "i", "kind", "s")
    found = e.where(reduce(lambda a, b: a & b, [text.contains(t) for t in terms], F.lit(bool(terms))))
    # Points for the whole query at the start of a field or anywhere in it.
    points = [("t", "startswith", 120), ("p", "startswith", 95), ("i", "startswith", 80), ("t", "contains", 36), ("p", "contains", 24), ("s", "contains", 12)]
    score = reduce(lambda a, b: a + b, [F.when(getattr(F.col(c), how)(whole), n).otherwise(0) for c, how, n in points])
    order = F.array_position(F.array(*map(F.lit, kind_order)), F.col("kind")) - 1
    w = found.select("id", "name", "kind", (score - 2 * order).cast("long").alias("score"))
    return w.orderBy(F.desc("score"), "name", "id").limit(most)
