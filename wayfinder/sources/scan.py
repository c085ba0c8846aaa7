"""Facts of files by their paths: kinds, declarative entities, documents, pages and sites. Edges that stem from one file name it as provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfinder.functions.text import ancestors, basename, extension, glob_regex, stem

# Kinds of files by name and by extension.
NAMED_KINDS = (("config", ("Dockerfile", "docker-compose.yml")), ("build", ("Makefile", "Justfile", "mise.toml", "Cargo.toml", "package.json")))
EXTENSIONS = (
    ("source", "rs ts tsx js jsx py go java c cpp h rb swift kt scala zig hs ex exs erl clj"),
    ("doc", "md txt rst adoc"),
    ("config", "toml yaml yml json ini env"),
    ("build", "lock"),
    ("migration", "sql"),
    ("template", "html hbs astro svelte vue njk tera"),
    ("data", "tla"),
)
# Globs and the kinds of entities that they make; the first that fits holds.
GLOBS = (
    ("**/main.tf", "infra_root"),
    ("Dockerfile*", "containerized"),
    ("docker-compose*.yml", "containerized"),
    ("**/playbooks/*.yml", "command"),
    ("**/migrations/*.sql", "migration"),
    ("**/*.tla", "spec"),
    (".github/workflows/*.{yml,yaml}", "workflow"),
    ("**/.circleci/*.{yml,yaml}", "workflow"),
    ("**/workflows/*.{toml,yml,yaml}", "workflow"),
    ("CLAUDE.md", "agent_config"),
    ("AGENTS.md", "agent_config"),
    ("SKILL.md", "agent_config"),
    ("templates/**/*.html", "template"),
    ("layouts/**/*.html", "template"),
    ("**/*.astro", "template"),
    ("**/*.hbs", "template"),
)
# Relations of the repository to entities of a kind, and folders whose documents are pages.
REPO_EDGES = {"migration": "migrates", "spec": "specifies"}
CONTENT_DIRS = ("content", "pages", "blog")

def file_kind(path: Column) -> Column:
    """Where it lies first, then its name, then its extension."""
    out = F.lit("other")
    for kind, names in reversed(EXTENSIONS):
        out = F.when(extension(path).isin(names.split()), kind).otherwise(out)
    for kind, names in reversed(NAMED_KINDS):
        out = F.when(basename(path).isin(list(names)), kind).otherwise(out)
    return F.when(F.array_contains(F.split(path, "/"), ".github"), "workflow").otherwise(out)


def scanned_kind(path: Column) -> Column:
    """The kind of entity that the first fitting glob makes, else null. A file in the root fits a glob without '/' only by its whole path."""
    return F.coalesce(*(F.when(path.rlike(glob_regex(g)), kind) for g, kind in GLOBS), F.lit(None).cast("string"))


def scanned_facts(files: DataFrame, scan_markdown: bool = False) -> tuple[DataFrame, DataFrame]:
    """Entities and edges of files (path, component_id) by the glob rules; markdown is left to the document rules by default."""
    other = files if scan_markdown else files.where(~F.col("path").endswith(".md"))
    e = other.where(~F.col("path").endswith(".rs") & (basename(F.col("path")) != "mise.toml")).withColumn("kind", scanned_kind(F.col("path"))).where("kind is not null")
    entities = e.select(F.concat_ws("::", "kind", "path").alias("id"), "kind", basename(F.col("path")).alias("name"), "component_id", "path", F.lit(True).alias("exported"))
    rel = F.coalesce(*(F.when(F.col("kind") == k, r) for k, r in REPO_EDGES.items()), F.when(F.col("kind") == "agent_config", "configured_by"))
    src = F.when(F.col("kind") == "agent_config", F.coalesce("component_id", F.lit("repo::."))).otherwise("repo::.")
    edges = entities.select(src.alias("src_id"), rel.alias("rel"), F.col("id").alias("dst_id"), F.col("path").alias("provenance_path")).where("rel is not null")
    return entities, edges


def document_facts(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Markdown files as documents of their component or the repository, and pages with front matter in content folders. files: path, component_id, content."""
    md = files.where(F.col("path").endswith(".md"))
    doc = md.select(F.concat(F.lit("doc::"), "path").alias("id"), F.lit("doc").alias("kind"), basename(F.col("path")).alias("name"), "component_id", "path", F.lit(True).alias("exported"))
    text = F.ltrim(F.substring(F.col("content").cast("string"), 1, 16))  # a cast takes any bytes
    folders = F.slice(F.split("path", "/"), F.lit(1), F.size(F.split("path", "/")) - 1)
    pages = md.where(F.arrays_overlap(folders, F.array(*map(F.lit, CONTENT_DIRS))) & (text.startswith("+++") | text.startswith("---")))
    page = pages.select(F.concat(F.lit("content_page::"), "path").alias("id"), F.lit("content_page").alias("kind"), stem(F.col("path")).alias("name"), "component_id", "path", F.lit(True).alias("exported"))
    edges = doc.select(F.coalesce("component_id", F.lit("repo::.")).alias("src_id"), F.lit("documented_by").alias("rel"), F.col("id").alias("dst_id"), F.col("path").alias("provenance_path"))
    return doc.unionByName(page), edges


def site_facts(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sites by their marker files, joined with the files below their roots by ancestor folder. files: path, component_id, content."""
    name, text = basename(F.col("path")), F.col("content").cast("string")
    hugo_root = (F.col("path") == "config.toml") & (text.contains("baseURL") | text.contains("theme"))
    kind = F.when(name == "site.toml", "site").when(name.startswith("astro.config."), "astro-site").when((name == "hugo.toml") | hugo_root, "hugo-site")
    root = F.element_at(ancestors(F.col("path")), -1)
    sites = files.select(kind.alias("name"), root.alias("root"), "component_id").where("name is not null").dropDuplicates(["root"])
    shown = F.when(F.col("root") == "", ".").otherwise(F.col("root"))
    entities = sites.select(F.concat(F.lit("site::"), shown).alias("id"), F.lit("site").alias("kind"), "name", "component_id", shown.alias("path"), F.lit(True).alias("exported"))
    folders = F.split("path", "/")
    ext = extension(F.col("path"))
    part = (
        F.when(F.arrays_overlap(F.slice(folders, F.lit(1), F.size(folders) - 1), F.array(*map(F.lit, CONTENT_DIRS))) & (ext == "md"), "content_page")
        .when(F.arrays_overlap(folders, F.array(F.lit("templates"), F.lit("layouts"))) & ext.isin("html astro hbs svelte vue njk tera".split()), "template")
        .when(name == "main.tf", "infra_root")
    )
    below = files.select("path", part.alias("part"), F.explode(ancestors(F.col("path"))).alias("root")).where("part is not null")
    met = below.join(sites.select("root"), "root").select(F.concat(F.lit("site::"), shown).alias("site"), "part", F.concat_ws("::", "part", "path").alias("other"))
    template = F.col("part") == "template"
    edges = met.select(F.when(template, F.col("other")).otherwise(F.col("site")).alias("src_id"), F.when(template, "renders").when(F.col("part") == "infra_root", "deploys").otherwise("contains").alias("rel"), F.when(template, F.col("site")).otherwise(F.col("other")).alias("dst_id"))
    return entities, edges
