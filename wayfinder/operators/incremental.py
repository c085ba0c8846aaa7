"""Incremental maintenance: what changed, what is orphaned, what is stale; and profiles that summaries are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfinder.schema import component_parts


def classify_files(current: DataFrame, stored: DataFrame) -> DataFrame:
    """path, change (new, changed, deleted) of files that differ in hash or component; one full outer join."""
    c = current.select("path", F.col("hash").alias("h1"), F.col("component_id").alias("c1"), F.lit(True).alias("now"))
    s = stored.select("path", F.col("hash").alias("h2"), F.col("component_id").alias("c2"), F.lit(True).alias("then"))
    both = c.join(s, "path", "full_outer")
    same = (F.col("h1") == F.col("h2")) & F.col("c1").eqNullSafe(F.col("c2"))
    change = F.when(F.col("then").isNull(), "new").when(F.col("now").isNull(), "deleted").when(~same, "changed")
    return both.select("path", change.alias("change")).where("change is not null")


def orphaned_components(entities: DataFrame, registry: DataFrame, ecosystem: str) -> DataFrame:
    """Ids of the ecosystem's components that the registry (component_id) no longer lists."""
    own = entities.where((F.col("kind") == "component") & (component_parts(F.col("id"))[0] == ecosystem))
    return own.join(registry.select(F.col("component_id").alias("id")), "id", "left_anti").select("id")


def stale_summaries(fresh: DataFrame, summaries: DataFrame) -> DataFrame:
    """Rows of fresh (entity_id, source_hash) whose summary is missing or made from another source."""
    return fresh.join(summaries.where("source_hash is not null").select("entity_id", "source_hash"), ["entity_id", "source_hash"], "left_anti")


def stale_embeddings(summaries: DataFrame, entities: DataFrame, embeddings: DataFrame, model: str) -> DataFrame:
    """Summaries of existing entities that have no vector of this model."""
    live = summaries.join(entities.select(F.col("id").alias("entity_id"), "kind", "name"), "entity_id")
    return live.join(embeddings.where(F.col("model") == model).select("entity_id"), "entity_id", "left_anti")


def first_values(rows: DataFrame, keys: list[str], value: str, most: int, name: str) -> DataFrame:
    """keys, and the first ``most`` values in order (name); what lies beyond is left out before rows of a key come together."""
    order = F.row_number().over(Window.partitionBy(*keys).orderBy(value))
    some = rows.select(*keys, value).withColumn("__n", order).where(F.col("__n") <= most)
    return some.groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias(name))


def component_profile(entities: DataFrame, most: int | None = None) -> DataFrame:
    """Per component: symbols, tests, benches, source units and documents, and its source and document paths in order (names
    where there is no path): all of them, or the first ``most``, where what lies beyond doesn't come together in a row."""
    owned, at, listed = entities.where("component_id is not null"), F.coalesce("path", "name"), {"sources": "source_unit", "docs": "doc"}
    counts = [F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("symbol", "test", "bench", "source_unit", "doc")]
    if most is None:
        return owned.groupBy("component_id").agg(*counts, *(F.array_sort(F.collect_list(F.when(F.col("kind") == k, at))).alias(name) for name, k in listed.items()))
    first = first_values(owned.where(F.col("kind").isin(*listed.values())).select("component_id", "kind", at.alias("at")), ["component_id", "kind"], "at", most, "values")
    lists = first.groupBy("component_id").agg(*(F.first(F.when(F.col("kind") == k, F.col("values")), True).alias(name) for name, k in listed.items()))
    none = F.array().cast("array<string>")
    return owned.groupBy("component_id").agg(*counts).join(lists, "component_id", "left").withColumns({c: F.coalesce(c, none) for c in listed})


def repo_profile(entities: DataFrame, kinds: tuple[str, ...] = ("component", "source_unit", "symbol", "test", "bench", "doc", "task", "feature"), listed: int = 11) -> DataFrame:
    """One row: entities by kind, and the first names of components and paths of documents (``listed`` at most, in order)."""

    def first(kind: str, name: str, value: Column) -> DataFrame:
        top = entities.where(F.col("kind") == kind).select(value.alias("v")).orderBy("v").limit(listed)
        return top.agg(F.array_sort(F.collect_list("v")).alias(name))

    counts = entities.agg(*(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in kinds))
    rows = counts.unionByName(first("component", "components", F.col("name")), True).unionByName(first("doc", "docs", F.coalesce("path", "name")), True)
    return rows.agg(*(F.max(f"n_{k}").alias(f"n_{k}") for k in kinds), *(F.first(c, True).alias(c) for c in ("components", "docs")))


def related_names(entities: DataFrame, edges: DataFrame, rel: str, sources: DataFrame | None = None, most: int = 11) -> DataFrame:
    """src_id, n, names: how many distinct names the existing entities have that edges of the relation lead to, and the first
    ``most`` of them in order. sources (column id): where edges begin; other edges are left out before anything is joined."""
    some = edges.where(F.col("rel") == rel).select("src_id", "dst_id")
    some = some if sources is None else some.join(sources.select(F.col("id").alias("src_id")), "src_id", "left_semi")
    to = some.join(entities.select(F.col("id").alias("dst_id"), "name"), "dst_id").select("src_id", "name").distinct()
    return to.groupBy("src_id").agg(F.count("*").alias("n")).join(first_values(to, ["src_id"], "name", most, "names"), "src_id")


def work_batches(work: DataFrame, order: Column, size: int, partition: str = "component_id") -> DataFrame:
    """batch numbers within each partition: runs of symbols are cut into batches of size, anything else is alone."""
    w = Window.partitionBy(partition).orderBy(order)
    symbol = (F.col("kind") == "symbol").cast("int")
    run = work.withColumn("new", F.when((symbol == 1) & (F.lag(symbol).over(w) == 1), 0).otherwise(1)).withColumn("run", F.sum("new").over(w))
    at = F.row_number().over(Window.partitionBy(partition, "run").orderBy(order)) - 1
    parts = run.withColumn("part", F.floor(at / size)).withColumn("first", (at % size == 0).cast("int"))
    return parts.withColumn("batch", F.sum("first").over(w)).drop("new", "run", "part", "first")
