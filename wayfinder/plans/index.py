"""The indexing pipeline: a source tree to the tables of the model, whole or incrementally."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfinder.config import Config
from wayfinder.functions.text import basename
from wayfinder.operators.incremental import classify_files, stale_embeddings
from wayfinder.operators.routes import task_routes
from wayfinder.operators.store import check_dimensions, last_wins, upsert_table
from wayfinder.plans.models import Provider, embed_rows
from wayfinder.plans.summarise import stale_work, summarise
from wayfinder.schema import Model
from wayfinder.shared import materialize
from wayfinder.sources.manifests import assign_owners, manifest_facts, member_manifests, read_manifests, registry
from wayfinder.sources.rust import extract_rust
from wayfinder.sources.scan import document_facts, file_kind, scanned_facts, site_facts
from wayfinder.sources.tree import Tree, extracted_from, scan_tree


def whole_entity(df: DataFrame) -> DataFrame:
    given = set(df.columns)
    none = {"language": "string", "line_start": "int", "line_end": "int", "visibility": "string", "n": "int"}
    return df.withColumns({c: F.lit(None).cast(t) for c, t in none.items() if c not in given})


#: Kinds of entities that stem from manifests and folders, not from one file: found anew in each run.
OF_THE_TREE = ("repo", "component", "feature", "site", "task")
MANIFESTS = ("Cargo.toml", "package.json", "mise.toml")


@dataclass(frozen=True)
class Run:
    """A model after a run, the files that were new, changed or deleted (path, change), and those that an extractor looked into (path)."""

    model: Model
    changes: DataFrame
    parsed: DataFrame


def extract(spark: SparkSession, root: str, exclude: tuple[str, ...] = ()) -> Model:
    """All facts of a tree."""
    return facts_of(scan_tree(spark, root, exclude))


def facts_of(tree: Tree) -> Model:
    """All facts of a tree's files."""
    return delta(Model.empty(tree.files.sparkSession), tree).model


def owned_files(tree: Tree) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Manifests, the registry of components, and the files with their owners; each a written table. Manifests are read in every
    run: what a name stands for depends on all of them."""
    listed = tree.files.where(basename(F.col("path")).isin(*MANIFESTS)).withColumn("whole", F.lit(True))
    manifests = materialize(read_manifests(tree.read(listed)), "listed-manifests")
    members = member_manifests(manifests).join(listed.select("path"), "path", "left_anti")
    manifests = materialize(manifests.unionByName(read_manifests(tree.read(members))), "manifests")
    components = materialize(registry(manifests), "registry")
    return manifests, components, materialize(assign_owners(tree.files, components), "owned")


def facts_of_tree(tree: Tree, manifests: DataFrame, components: DataFrame, owned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and edges that no single file gives: of manifests and of sites. Their edges have no provenance."""
    marker = owned.where(F.col("path") == "config.toml").select("path", F.lit(True).alias("whole"))
    sites = site_facts(owned.join(tree.read(marker), "path", "left"))
    found = manifest_facts(manifests, components)
    entities = whole_entity(found[0]).unionByName(whole_entity(sites[0]))
    return entities, found[1].unionByName(sites[1]).distinct()


def facts_of_files(tree: Tree, files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities and edges of files (path, component_id) by themselves, and the paths that were looked into. Each file is opened
    once at most; edges name it as provenance."""
    how = extracted_from(F.col("path"))
    wanted = files.withColumn("how", how).where((F.col("how") == "head") | F.col("path").endswith(".rs"))
    read = materialize(tree.read(wanted.withColumn("whole", F.col("how") == "whole").drop("how", "component_id")), "contents")
    opened = files.join(read, "path")
    parts = [extract_rust(opened), document_facts(opened), scanned_facts(files)]
    entities = reduce(DataFrame.unionByName, (whole_entity(e) for e, _ in parts))
    edges = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (d for _, d in parts))
    entities = last_wins(entities.withColumn("__order", F.struct(F.coalesce("line_start", F.lit(0)), F.coalesce("n", F.lit(0)))), ["id"], "__order").drop("n")
    edges = edges.groupBy("src_id", "rel", "dst_id").agg(F.min(F.struct("provenance_path", "provenance_line")).alias("p")).select("src_id", "rel", "dst_id", "p.*")
    return entities, edges, read.select("path")


def delta(m: Model, tree: Tree) -> Run:
    """Brings a model up to a tree, at the cost of what changed.

    Paths, hashes and owners are compared first; contents are read of new and changed files only. Facts of the other files are
    kept as they are, by anti joins on the path that an entity or an edge stems from. What depends on more than one file (names
    of dependencies, owners, sites) is found anew from manifests and paths: a file whose owner changed counts as changed, so
    that the result is that of a full run. Summaries and vectors stay with entities whose file didn't change.
    """
    manifests, components, owned = owned_files(tree)
    changes = materialize(classify_files(owned, m.files), "changes")
    due = owned.join(changes.where("change <> 'deleted'").select("path"), "path", "left_semi")
    own_entities, own_edges, parsed = facts_of_files(tree, due.select("path", "component_id", *(["size"] if "size" in due.columns else [])))
    tree_entities, tree_edges = facts_of_tree(tree, manifests, components, owned)

    gone = changes.where("change <> 'new'").select("path")
    kept = m.entities.where(~F.col("kind").isin(*OF_THE_TREE)).join(gone, "path", "left_anti").select(*m.entities.columns)
    kept_edges = m.edges.where("provenance_path is not null").join(gone.withColumnRenamed("path", "provenance_path"), "provenance_path", "left_anti")
    entities = materialize(kept.unionByName(own_entities.select(*kept.columns)).unionByName(tree_entities.select(*kept.columns)), "entities")
    edges = kept_edges.unionByName(own_edges).unionByName(tree_edges, allowMissingColumns=True).select(*m.edges.columns)
    # of entities that stay, those of the tree or of a file that didn't change
    live = entities.join(gone, "path", "left_anti").select(F.col("id").alias("entity_id"))
    files = owned.select("path", "component_id", file_kind(F.col("path")).alias("kind"), "hash", F.lit(True).alias("indexed"), F.lit(None).cast("string").alias("ignore_reason"))
    stay = lambda df: df.join(live, "entity_id", "left_semi")
    model = m.with_tables(files=files, entities=entities, edges=edges, task_routes=task_routes(entities), summaries=stay(m.summaries), embeddings=stay(m.embeddings))
    return Run(model, changes, parsed)


def reindex(m: Model, root: str, exclude: tuple[str, ...] = ()) -> tuple[Model, DataFrame]:
    """The model after the tree's changes, and the changes (path, change)."""
    run = delta(m, scan_tree(m.files.sparkSession, root, exclude))
    return run.model, run.changes


def text_contents(tree: Tree, entities: DataFrame) -> DataFrame:
    """path, content: the texts that summaries of these entities are made of; bytes that are not UTF-8 are replaced."""
    named = entities.where("kind in ('symbol', 'doc')").select("path").distinct().join(tree.files, "path").withColumn("whole", F.lit(True))
    return tree.read(named.select("path", "whole")).select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("content"))


def index(spark: SparkSession, root: str, exclude: tuple[str, ...] = (), stored: Model | None = None, config: Config | None = None, summaries: Callable[[], Provider] | None = None, vectors: Callable[[], Provider] | None = None, force: bool = False) -> Model:
    """The whole run: facts (of changed files only where a stored model is given and the run isn't forced), then summaries of
    entities that have none or one of another source, then vectors of summaries that have none of the configured model. The
    tree is listed and hashed once."""
    c = config or Config()
    tree = scan_tree(spark, root, exclude)
    m = facts_of(tree) if stored is None or force else delta(stored, tree).model
    if summaries is not None:
        work = stale_work(m, text_contents(tree, m.entities), c.summary.exported_only)
        made = materialize(summarise(work, summaries, c.summary), "summaries")  # models are asked once
        m = m.with_tables(embeddings=m.embeddings.join(made.select("entity_id"), "entity_id", "left_anti"))
        m = upsert_table(m, "summaries", made)
    if vectors is not None:
        due = stale_embeddings(m.summaries, m.entities, m.embeddings, c.embedding.model)
        made = materialize(embed_rows(due, vectors, c.embedding.model, c.embedding.dimensions, c.embedding.batch_size), "vectors")
        m = upsert_table(m, "embeddings", check_dimensions(made, c.embedding.dimensions))
    return m
