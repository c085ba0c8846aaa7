"""Queries over a source tree made of the driver's tables: what extraction finds in it, with SQL that states it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfinder.plans.index import delta, facts_of
from wayfinder.projection import Projection, key, text
from wayfinder.shared import materialize
from wayfinder.sources.tree import Tree

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def tree(spark: SparkSession, sf_dir: str, later: bool = False) -> DataFrame:
    """path, hash, content: a crate for each region and, within it, for each nation; a Rust file for each part in a nation's
    crate; a package for each supplier that needs the one before; a task file for each region; a document for each of documents,
    every second as a site's page; a layout for each of pages; an infrastructure root for each of benchmark.

    Later, large parts have one more function, English documents one more line; suppliers in debt have gone, and so have the
    manifests of Asia and of Africa's nations, whose files then belong to Africa's own crate."""
    t = Projection(spark, sf_dir)
    now = lambda condition: F.lit(True) if not later else condition
    more = lambda condition, line: F.when(F.coalesce(condition, F.lit(False)), line).otherwise("") if later else F.lit("")
    regions = t.nations().select("rs").distinct()
    crate = text("crates/", F.col("rs"), "/", F.col("ns"))
    k = key("p_partkey")
    parts = t.table("part").join(F.broadcast(t.nations()), F.col("p_partkey") % 25 == F.col("n_nationkey"))  # nations are a fixed short list
    s = F.col("s_suppkey")
    files = [
        regions.where(now(F.col("rs") != "asia")).select(text("crates/", F.col("rs"), "/Cargo.toml").alias("path"), text('[package]\nname = "', F.col("rs"), '"\n[features]\ndefault = ["std", "dep:x"]\nstd = []\n').alias("content")),
        t.nations().where(now(F.col("rs") != "africa")).select(text(crate, "/Cargo.toml").alias("path"), text('[package]\nname = "', F.col("ns"), '"\n[dependencies]\nup = { path = ".." }\nout = { path = "../../../.." }\nserde = "1"\n').alias("content")),
        parts.select(text(crate, "/src/p", k, ".rs").alias("path"), text("pub struct P", k, ";\nfn hidden() {}\n#[test]\nfn works() {}\nimpl Show for P", k, " {}\npub use other::Thing;\n", more(F.col("p_size") > 40, "pub fn more() {}\n")).alias("content")),
        t.table("supplier").where(now(F.col("s_acctbal") >= 0)).select(text("web/", key("s_suppkey"), "/package.json").alias("path"), text('{"name": "w', key("s_suppkey"), '", "dependencies": {"w', (s - 1).cast("string"), '": "1", "absent": "2"}}').alias("content")),
        regions.select(text("tools/", F.col("rs"), "/mise.toml").alias("path"), text("[tasks.go_", F.col("rs"), ']\nrun = "x"\n').alias("content")),
        t.table("documents").select(F.when(F.col("doc_id") % 2 == 0, text("site/content/", key("doc_id"), ".md")).otherwise(text("notes/", key("doc_id"), ".md")).alias("path"), text("---\n", F.coalesce("text", F.lit("")), more(F.col("lang") == "en", "\nlater")).alias("content")),
        t.table("pages").select(text("site/layouts/", key("page_id"), ".html").alias("path"), F.coalesce("html", F.lit("")).alias("content")),
        t.table("benchmark").select(text("infra/", key("item_id"), "/main.tf").alias("path"), F.lit("").alias("content")),
        spark.range(1).select(F.lit("site/hugo.toml").alias("path"), F.lit("baseURL = 'x'").alias("content")),
    ]
    return reduce(DataFrame.unionByName, files).select("path", F.sha2("content", 256).alias("hash"), F.col("content").cast("binary").alias("content"))


SQL = """
nat AS (SELECT n_nationkey, replace(lower(n_name), ' ', '_') AS ns, replace(lower(r_name), ' ', '_') AS rs FROM nation JOIN region ON n_regionkey = r_regionkey),
reg AS (SELECT DISTINCT rs FROM nat),
own AS (SELECT p_partkey AS k, 'crates/' || rs || '/' || ns AS crate, 'crates/' || rs || '/' || ns || '/src/p' || p_partkey || '.rs' AS path FROM part JOIN nat ON p_partkey % 25 = n_nationkey),
doc AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'site/content/' || doc_id || '.md' ELSE 'notes/' || doc_id || '.md' END AS path FROM documents),
lay AS (SELECT 'site/layouts/' || page_id || '.html' AS path, page_id || '.html' AS name FROM pages),
inf AS (SELECT 'infra/' || item_id || '/main.tf' AS path FROM benchmark)"""


def query(sql: str):
    def add(f: Callable):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(facts_of(Tree.of(materialize(tree(spark, sf_dir), "tree"))))
        ORACLE[f.__name__] = f"WITH {SQL} {sql}"
        return f

    return add


@query("""
SELECT 'repo::.' AS id, 'repo' AS kind, 'repo' AS name, CAST(NULL AS VARCHAR) AS component_id, '.' AS path, true AS exported
UNION ALL SELECT 'component::cargo::crates/' || rs, 'component', rs, NULL, 'crates/' || rs, true FROM reg
UNION ALL SELECT 'component::cargo::crates/' || rs || '/' || ns, 'component', ns, NULL, 'crates/' || rs || '/' || ns, true FROM nat
UNION ALL SELECT 'component::npm::web/' || s_suppkey, 'component', 'w' || s_suppkey, NULL, 'web/' || s_suppkey, true FROM supplier
UNION ALL SELECT 'feature::crates/' || rs || '::' || f, 'feature', f, 'component::cargo::crates/' || rs, 'crates/' || rs, true FROM reg, (VALUES ('default'), ('std')) v(f)
UNION ALL SELECT 'task::tools/' || rs || '/mise.toml::go_' || rs, 'task', 'go_' || rs, NULL, 'tools/' || rs || '/mise.toml', true FROM reg
UNION ALL SELECT 'source_unit::' || path, 'source_unit', path, 'component::cargo::' || crate, path, true FROM own
UNION ALL SELECT 'symbol::' || path || '::P' || k, 'symbol', 'P' || k, 'component::cargo::' || crate, path, true FROM own
UNION ALL SELECT 'symbol::' || path || '::hidden', 'symbol', 'hidden', 'component::cargo::' || crate, path, false FROM own
UNION ALL SELECT 'test::' || path || '::works', 'test', 'works', 'component::cargo::' || crate, path, false FROM own
UNION ALL SELECT 'doc::' || path, 'doc', doc_id || '.md', NULL, path, true FROM doc
UNION ALL SELECT 'content_page::' || path, 'content_page', doc_id || '', NULL, path, true FROM doc WHERE doc_id % 2 = 0
UNION ALL SELECT 'infra_root::' || path, 'infra_root', 'main.tf', NULL, path, true FROM inf
UNION ALL SELECT 'site::site', 'site', 'hugo-site', NULL, 'site', true""")
def extracted_entities(m) -> DataFrame:
    """Entities of every extractor."""
    return m.entities.select("id", "kind", "name", "component_id", "path", "exported")


@query("""
SELECT 'repo::.' AS src_id, 'contains' AS rel, 'component::cargo::crates/' || rs AS dst_id FROM reg
UNION ALL SELECT 'repo::.', 'contains', 'component::cargo::crates/' || rs || '/' || ns FROM nat
UNION ALL SELECT 'repo::.', 'contains', 'component::npm::web/' || s_suppkey FROM supplier
UNION ALL SELECT 'component::cargo::crates/' || rs || '/' || ns, 'depends_on', 'component::cargo::crates/' || rs FROM nat
UNION ALL SELECT 'component::npm::web/' || a.s_suppkey, 'depends_on', 'component::npm::web/' || b.s_suppkey FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey - 1
UNION ALL SELECT 'component::cargo::crates/' || rs, 'declares_feature', 'feature::crates/' || rs || '::' || f FROM reg, (VALUES ('default'), ('std')) v(f)
UNION ALL SELECT 'feature::crates/' || rs || '::default', 'feature_enables', 'feature::crates/' || rs || '::std' FROM reg
UNION ALL SELECT 'repo::.', 'owns_task', 'task::tools/' || rs || '/mise.toml::go_' || rs FROM reg
UNION ALL SELECT 'component::cargo::' || crate, 'contains', 'source_unit::' || path FROM own
UNION ALL SELECT 'source_unit::' || path, 'defines', 'symbol::' || path || '::P' || k FROM own
UNION ALL SELECT 'source_unit::' || path, 'defines', 'symbol::' || path || '::hidden' FROM own
UNION ALL SELECT 'source_unit::' || path, 'tested_by', 'test::' || path || '::works' FROM own
UNION ALL SELECT 'symbol::' || path || '::P' || k, 'implements', 'symbol::' || path || '::Show' FROM own
UNION ALL SELECT 'source_unit::' || path, 'reexports', 'symbol::' || path || '::Thing' FROM own
UNION ALL SELECT 'repo::.', 'documented_by', 'doc::' || path FROM doc
UNION ALL SELECT 'site::site', 'contains', 'content_page::' || path FROM doc WHERE doc_id % 2 = 0
UNION ALL SELECT 'template::' || path, 'renders', 'site::site' FROM lay""")
def extracted_edges(m) -> DataFrame:
    """Edges of every extractor."""
    return m.edges.select("src_id", "rel", "dst_id")


@query("""SELECT path, component_id, kind FROM (
SELECT 'crates/' || rs || '/Cargo.toml' AS path, 'component::cargo::crates/' || rs AS component_id, 'build' AS kind FROM reg
UNION ALL SELECT 'crates/' || rs || '/' || ns || '/Cargo.toml', 'component::cargo::crates/' || rs || '/' || ns, 'build' FROM nat
UNION ALL SELECT path, 'component::cargo::' || crate, 'source' FROM own
UNION ALL SELECT 'web/' || s_suppkey || '/package.json', 'component::npm::web/' || s_suppkey, 'build' FROM supplier
UNION ALL SELECT 'tools/' || rs || '/mise.toml', NULL, 'build' FROM reg
UNION ALL SELECT path, NULL, 'doc' FROM doc UNION ALL SELECT path, NULL, 'template' FROM lay UNION ALL SELECT path, NULL, 'other' FROM inf UNION ALL SELECT 'site/hugo.toml', NULL, 'config')""")
def extracted_files(m) -> DataFrame:
    """Every file with its owner and kind."""
    return m.files.select("path", "component_id", "kind")


#: The tree's state later on.
LATER = """
nat AS (SELECT n_nationkey, replace(lower(n_name), ' ', '_') AS ns, replace(lower(r_name), ' ', '_') AS rs FROM nation JOIN region ON n_regionkey = r_regionkey),
crates AS (SELECT DISTINCT rs AS name, 'crates/' || rs AS root, rs FROM nat WHERE rs <> 'asia' UNION ALL SELECT ns, 'crates/' || rs || '/' || ns, rs FROM nat WHERE rs <> 'africa'),
sup AS (SELECT s_suppkey FROM supplier WHERE s_acctbal >= 0),
own AS (SELECT p_partkey AS k, p_size > 40 AS large, rs, 'component::cargo::crates/' || rs || CASE WHEN rs = 'africa' THEN '' ELSE '/' || ns END AS owner, 'crates/' || rs || '/' || ns || '/src/p' || p_partkey || '.rs' AS path FROM part JOIN nat ON p_partkey % 25 = n_nationkey),
doc AS (SELECT doc_id, lang, CASE WHEN doc_id % 2 = 0 THEN 'site/content/' || doc_id || '.md' ELSE 'notes/' || doc_id || '.md' END AS path FROM documents)"""


def query_of_run(sql: str):
    """Registers a function of the run that brings the model of the tree up to its later state."""

    def add(f: Callable):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            before, after = (Tree.of(materialize(tree(spark, sf_dir, later), "tree")) for later in (False, True))
            return f(delta(facts_of(before), after))

        QUERIES[f.__name__] = run
        ORACLE[f.__name__] = f"WITH {LATER} {sql}"
        return f

    return add


@query_of_run("""
SELECT 'repo::.' AS id, 'repo' AS kind, 'repo' AS name, CAST(NULL AS VARCHAR) AS component_id, '.' AS path, true AS exported
UNION ALL SELECT 'component::cargo::' || root, 'component', name, NULL, root, true FROM crates
UNION ALL SELECT 'component::npm::web/' || s_suppkey, 'component', 'w' || s_suppkey, NULL, 'web/' || s_suppkey, true FROM sup
UNION ALL SELECT 'feature::' || root || '::' || f, 'feature', f, 'component::cargo::' || root, root, true FROM crates, (VALUES ('default'), ('std')) v(f) WHERE name = rs
UNION ALL SELECT DISTINCT 'task::tools/' || rs || '/mise.toml::go_' || rs, 'task', 'go_' || rs, NULL, 'tools/' || rs || '/mise.toml', true FROM nat
UNION ALL SELECT 'source_unit::' || path, 'source_unit', path, owner, path, true FROM own
UNION ALL SELECT 'symbol::' || path || '::P' || k, 'symbol', 'P' || k, owner, path, true FROM own
UNION ALL SELECT 'symbol::' || path || '::hidden', 'symbol', 'hidden', owner, path, false FROM own
UNION ALL SELECT 'symbol::' || path || '::more', 'symbol', 'more', owner, path, true FROM own WHERE large
UNION ALL SELECT 'test::' || path || '::works', 'test', 'works', owner, path, false FROM own
UNION ALL SELECT 'doc::' || path, 'doc', doc_id || '.md', NULL, path, true FROM doc
UNION ALL SELECT 'content_page::' || path, 'content_page', doc_id || '', NULL, path, true FROM doc WHERE doc_id % 2 = 0
UNION ALL SELECT 'infra_root::infra/' || item_id || '/main.tf', 'infra_root', 'main.tf', NULL, 'infra/' || item_id || '/main.tf', true FROM benchmark
UNION ALL SELECT 'site::site', 'site', 'hugo-site', NULL, 'site', true""")
def reindexed_entities(run) -> DataFrame:
    """Entities after an incremental run."""
    return run.model.entities.select("id", "kind", "name", "component_id", "path", "exported")


@query_of_run("""
SELECT 'repo::.' AS src_id, 'contains' AS rel, 'component::cargo::' || root AS dst_id, CAST(NULL AS VARCHAR) AS provenance_path, CAST(NULL AS INTEGER) AS provenance_line FROM crates
UNION ALL SELECT 'repo::.', 'contains', 'component::npm::web/' || s_suppkey, NULL, NULL FROM sup
UNION ALL SELECT 'component::cargo::' || root, 'depends_on', 'component::cargo::crates/' || rs, NULL, NULL FROM crates WHERE name <> rs AND rs <> 'asia'
UNION ALL SELECT 'component::npm::web/' || a.s_suppkey, 'depends_on', 'component::npm::web/' || b.s_suppkey, NULL, NULL FROM sup a JOIN sup b ON b.s_suppkey = a.s_suppkey - 1
UNION ALL SELECT 'component::cargo::' || root, 'declares_feature', 'feature::' || root || '::' || f, NULL, NULL FROM crates, (VALUES ('default'), ('std')) v(f) WHERE name = rs
UNION ALL SELECT 'feature::' || root || '::default', 'feature_enables', 'feature::' || root || '::std', NULL, NULL FROM crates WHERE name = rs
UNION ALL SELECT DISTINCT 'repo::.', 'owns_task', 'task::tools/' || rs || '/mise.toml::go_' || rs, NULL, CAST(NULL AS INTEGER) FROM nat
UNION ALL SELECT owner, 'contains', 'source_unit::' || path, path, NULL FROM own
UNION ALL SELECT 'source_unit::' || path, 'defines', 'symbol::' || path || '::P' || k, path, 1 FROM own
UNION ALL SELECT 'source_unit::' || path, 'defines', 'symbol::' || path || '::hidden', path, 2 FROM own
UNION ALL SELECT 'source_unit::' || path, 'defines', 'symbol::' || path || '::more', path, 7 FROM own WHERE large
UNION ALL SELECT 'source_unit::' || path, 'tested_by', 'test::' || path || '::works', path, 4 FROM own
UNION ALL SELECT 'symbol::' || path || '::P' || k, 'implements', 'symbol::' || path || '::Show', path, 5 FROM own
UNION ALL SELECT 'source_unit::' || path, 'reexports', 'symbol::' || path || '::Thing', path, 6 FROM own
UNION ALL SELECT 'repo::.', 'documented_by', 'doc::' || path, path, NULL FROM doc
UNION ALL SELECT 'site::site', 'contains', 'content_page::' || path, NULL, NULL FROM doc WHERE doc_id % 2 = 0
UNION ALL SELECT 'template::site/layouts/' || page_id || '.html', 'renders', 'site::site', NULL, NULL FROM pages""")
def reindexed_edges(run) -> DataFrame:
    """Edges after an incremental run, with the file and line that each stems from."""
    return run.model.edges


@query_of_run("""
SELECT path, change, change = 'changed' AS parsed FROM (
SELECT path, 'changed' AS change FROM own WHERE large OR rs = 'africa' UNION ALL SELECT path, 'changed' FROM doc WHERE lang = 'en'
UNION ALL SELECT DISTINCT 'crates/asia/Cargo.toml', 'deleted' FROM nat WHERE rs = 'asia' UNION ALL SELECT 'crates/africa/' || ns || '/Cargo.toml', 'deleted' FROM nat WHERE rs = 'africa'
UNION ALL SELECT 'web/' || s_suppkey || '/package.json', 'deleted' FROM supplier WHERE s_acctbal < 0)""")
def reindex_changes(run) -> DataFrame:
    """What changed, and whether an extractor looked into it."""
    both = run.changes.join(run.parsed.withColumn("seen", F.lit(True)), "path", "full_outer")
    return both.select("path", "change", F.coalesce("seen", F.lit(False)).alias("parsed"))
