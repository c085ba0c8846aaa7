"""Manifests: components, their dependencies and features, tasks; and ownership of files by the longest prefix."""

from __future__ import annotations

import json
import posixpath
import tomllib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfinder.functions.text import ancestors, basename
from wayfinder.schema import component_id

MANIFEST = "root string, ecosystem string, name string, deps array<struct<name: string, path: string>>, features array<struct<name: string, enables: array<string>>>, members array<string>, tasks array<string>"


def inside(root: str, path: str) -> str | None:
    """A relative path from root in normal form; None if it leaves the repository."""
    p = posixpath.normpath(posixpath.join(root, path))
    return None if p.startswith("..") or p.startswith("/") else "" if p == "." else p


def parse_manifest(path: str, content: bytes) -> dict | None:
    """What a manifest says; None for one that can't be read."""
    root, _, name = path.rpartition("/")
    try:
        data = json.loads(content) if name == "package.json" else tomllib.loads(content.decode("utf-8"))
    except (ValueError, UnicodeDecodeError):
        return None
    out = {"root": root, "name": None, "deps": [], "features": [], "members": [], "tasks": []}
    if name == "package.json":
        given = {d for key in ("dependencies", "devDependencies", "peerDependencies") if isinstance(data.get(key), dict) for d in data[key]}
        spaces = data.get("workspaces")
        return out | {"ecosystem": "npm", "name": data.get("name"), "deps": [{"name": d, "path": None} for d in sorted(given)], "members": [p for m in spaces if isinstance(m, str) and (p := inside(root, m)) is not None] if isinstance(spaces, list) else []}
    if name == "mise.toml":
        return out | {"ecosystem": "mise", "tasks": sorted(data.get("tasks", {}))}
    deps = [(n, d) for key in ("dependencies", "dev-dependencies") for n, d in data.get(key, {}).items()]
    local = [{"name": n, "path": inside(root, d["path"]) if isinstance(d, dict) and "path" in d else None} for n, d in deps if not (isinstance(d, dict) and "path" in d and inside(root, d["path"]) is None)]
    enabled = lambda v: [x for x in v if not x.startswith("dep:") and "/" not in x]
    return out | {"ecosystem": "cargo", "name": data.get("package", {}).get("name"), "deps": local, "features": [{"name": n, "enables": enabled(v)} for n, v in sorted(data.get("features", {}).items())]}


def read_manifests(files: DataFrame) -> DataFrame:
    """One row for each readable manifest of files (path, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"deps": pa.list_(pa.struct([("name", pa.string()), ("path", pa.string())])), "features": pa.list_(pa.struct([("name", pa.string()), ("enables", pa.list_(pa.string()))])), "members": pa.list_(pa.string()), "tasks": pa.list_(pa.string())}
        names = ("root", "ecosystem", "name", "deps", "features", "members", "tasks")
        schema = pa.schema([(n, kinds.get(n, pa.string())) for n in names])
        for batch in batches:
            rows = [parse_manifest(p, c) for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pylist([r for r in rows if r], schema=schema)

    return files.where(basename(F.col("path")).isin("Cargo.toml", "package.json", "mise.toml")).select("path", "content").mapInArrow(run, MANIFEST)


def member_manifests(manifests: DataFrame) -> DataFrame:
    """path, whole: manifests of workspace members, which count even where the listing leaves them out."""
    roots = manifests.select(F.explode("members").alias("root")).distinct()
    return roots.select(F.when(F.col("root") == "", "package.json").otherwise(F.concat("root", F.lit("/package.json"))).alias("path"), F.lit(True).alias("whole"))


def registry(manifests: DataFrame) -> DataFrame:
    """root, name, ecosystem, component_id: one component for each root, npm before cargo."""
    named = manifests.where("name is not null and ecosystem in ('cargo', 'npm')")
    best = named.groupBy("root").agg(F.max_by(F.struct("name", "ecosystem"), F.struct(F.col("ecosystem") == "npm", "name")).alias("b"))
    return best.select("root", "b.name", "b.ecosystem", component_id(F.col("b.ecosystem"), F.col("root")).alias("component_id"))


def assign_owners(files: DataFrame, components: DataFrame) -> DataFrame:
    """files with component_id: that of the deepest root above the path, by an equi-join on the folders above it."""
    above = files.select("path", F.posexplode(ancestors(F.col("path"))).alias("depth", "root"))
    owner = above.join(components.select("root", "component_id"), "root").groupBy("path").agg(F.max_by("component_id", "depth").alias("component_id"))
    return files.drop("component_id").join(owner, "path", "left")


def manifest_facts(manifests: DataFrame, components: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and edges of the repository, components, dependencies, features and tasks."""
    spark = manifests.sparkSession
    own = manifests.join(components.select("root", "ecosystem", "component_id"), ["root", "ecosystem"])
    shown = F.when(F.col("root") == "", ".").otherwise(F.col("root"))
    none = F.lit(None).cast("string")
    repo = spark.range(1).select(F.lit("repo::.").alias("id"), F.lit("repo").alias("kind"), F.lit("repo").alias("name"), none.alias("component_id"), F.lit(".").alias("path"), F.lit(True).alias("exported"))
    component = components.select(F.col("component_id").alias("id"), F.lit("component").alias("kind"), "name", none.alias("component_id"), shown.alias("path"), F.lit(True).alias("exported"))
    features = own.select("component_id", shown.alias("path"), F.explode("features").alias("f"))
    fid = lambda name: F.concat_ws("::", F.lit("feature"), "path", name)
    feature = features.select(fid(F.col("f.name")).alias("id"), F.lit("feature").alias("kind"), F.col("f.name").alias("name"), "component_id", "path", F.lit(True).alias("exported"))
    tasks = manifests.where("ecosystem = 'mise'").select(F.when(F.col("root") == "", "mise.toml").otherwise(F.concat("root", F.lit("/mise.toml"))).alias("path"), F.explode("tasks").alias("name"))
    task = tasks.select(F.concat_ws("::", F.lit("task"), "path", "name").alias("id"), F.lit("task").alias("kind"), "name", none.alias("component_id"), "path", F.lit(True).alias("exported"))
    deps = own.select("component_id", "ecosystem", F.explode("deps").alias("d"))
    by_name = components.groupBy(F.col("name").alias("dep_name")).agg(F.max_by("component_id", "ecosystem").alias("by_name"))
    placed = deps.where("d.path is not null").select(F.concat("d.path", F.lit("/x")).alias("path")).distinct()
    by_path = assign_owners(placed, components).select(F.col("path").alias("dep_path"), F.col("component_id").alias("by_path"))
    met = deps.select("component_id", F.col("d.name").alias("dep_name"), F.concat("d.path", F.lit("/x")).alias("dep_path")).join(by_name, "dep_name", "left").join(by_path, "dep_path", "left")
    target = F.when(F.col("dep_path").isNotNull(), F.col("by_path")).otherwise(F.col("by_name"))
    edge = lambda df, s, r, d: df.select(s.alias("src_id"), F.lit(r).alias("rel"), d.alias("dst_id"))
    root = F.lit("repo::.")
    edges = edge(components, root, "contains", F.col("component_id"))
    for more in (
        edge(met, F.col("component_id"), "depends_on", target).where("dst_id is not null"),
        edge(features, F.col("component_id"), "declares_feature", fid(F.col("f.name"))),
        edge(features.select("path", "f", F.explode("f.enables").alias("on")), fid(F.col("f.name")), "feature_enables", fid(F.col("on"))),
        edge(tasks, root, "owns_task", F.concat_ws("::", F.lit("task"), "path", "name")),
    ):
        edges = edges.unionByName(more)
    return repo.unionByName(component).unionByName(feature).unionByName(task), edges.distinct()
