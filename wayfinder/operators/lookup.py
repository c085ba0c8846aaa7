"""Lookups, list filters and text filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfinder.functions.text import any_token_in
from wayfinder.schema import Model


def summary_text() -> Column:
    """What keyword search reads: the short summary and the keywords."""
    return F.concat_ws(" ", "short_summary", F.array_join("keywords", " "))


def entities_named(entities: DataFrame, tokens: list[str], kinds: list[str]) -> DataFrame:
    """Entities of the kinds whose name or path holds some token; none for no tokens or kinds."""
    return entities.where(F.col("kind").isin(kinds) & (any_token_in(F.col("name"), tokens) | any_token_in(F.coalesce("path", F.lit("")), tokens)))


def summaries_with(summaries: DataFrame, tokens: list[str]) -> DataFrame:
    return summaries.where(any_token_in(summary_text(), tokens))


def edges_where(edges: DataFrame, src: str | None = None, dst: str | None = None, rel: str | None = None) -> DataFrame:
    """Edges that fit all of the given criteria; one at least must be given."""
    given = [(c, v) for c, v in (("src_id", src), ("dst_id", dst), ("rel", rel)) if v is not None]
    if not given:
        raise ValueError("give src, dst or rel")
    for c, v in given:
        edges = edges.where(F.col(c) == v)
    return edges


def entities_where(entities: DataFrame, component: str | None = None, kind: str | None = None) -> DataFrame:
    """By component, or else by kind, or else all."""
    if component is not None:
        if not component.startswith("component::"):
            raise ValueError(f"not a component id: {component}")
        return entities.where(F.col("component_id") == component)
    return entities.where(F.col("kind") == kind) if kind is not None else entities


def routes_where(routes: DataFrame, task: str | None = None, entity: str | None = None) -> DataFrame:
    """By task, or else by entity; one must be given."""
    if task is None and entity is None:
        raise ValueError("give a task or an entity")
    return routes.where(F.col("task_name") == task) if task is not None else routes.where(F.col("entity_id") == entity)


def file_at(files: DataFrame, path: str) -> DataFrame:
    return files.where(F.col("path") == path)


def vector_meta(embeddings: DataFrame, entity: str | None = None, key: Column | None = None, value: int | None = None) -> DataFrame:
    """What is known of vectors besides the vector: of an entity, or of those whose key has the value."""
    if (entity is None) == (key is None or value is None):
        raise ValueError("give an entity, or a key and its value")
    fits = F.col("entity_id") == entity if entity is not None else key == value
    return embeddings.where(fits).select("entity_id", "model", "dimensions", "updated_at")


def editor_links(entities: DataFrame, root: str, template: str) -> DataFrame:
    """id, link: the template with {abs_path}, {repo_path}, {line}, {column} and {entity_id} filled in."""
    path = F.coalesce("path", F.lit("."))
    whole = F.when(path == ".", F.lit(root)).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))
    link = F.lit(template)
    for name, value in (("{abs_path}", whole), ("{repo_path}", path), ("{line}", F.coalesce("line_start", F.lit(1)).cast("string")), ("{column}", F.lit("1")), ("{entity_id}", F.col("id"))):
        link = F.replace(link, F.lit(name), value)
    return entities.select("id", link.alias("link"))


def entity_view(m: Model, entity_id: str) -> dict[str, DataFrame]:
    """All about one entity."""
    return {
        "entity": m.entities.where(F.col("id") == entity_id),
        "summary": m.summaries.where(F.col("entity_id") == entity_id),
        "routes": m.task_routes.where(F.col("entity_id") == entity_id),
        "out": m.edges.where(F.col("src_id") == entity_id),
        "in": m.edges.where(F.col("dst_id") == entity_id),
    }


def summary_candidates(entities: DataFrame, exported_only: bool = True) -> DataFrame:
    """Entities to be summarised, in the order of work: symbols, then documents, components, the repository; each id once."""
    first = entities.where((F.col("kind") == "symbol") & (F.col("exported") | F.lit(not exported_only)))
    rest = entities.where(F.col("kind").isin("doc", "component", "repo"))
    order = F.array_position(F.array(*map(F.lit, ("symbol", "doc", "component", "repo"))), F.col("kind"))
    return first.unionByName(rest).dropDuplicates(["id"]).withColumn("work_order", order.cast("int")).orderBy("work_order", "id")


def undocumented(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Components without a document."""
    return entities.where("kind = 'component'").join(edges.where("rel = 'documented_by'").select(F.col("src_id").alias("id")), "id", "left_anti")
