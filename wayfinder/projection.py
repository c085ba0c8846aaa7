"""The driver's tables put on the model, for queries and benchmarks; and the same as SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfinder.operators.routes import task_routes
from wayfinder.schema import TABLES, LazyModel, Model


def slug(c):
    return F.replace(F.lower(c), F.lit(" "), F.lit("_"))


def text(*parts):
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def key(column: str):
    return F.col(column).cast("string")


class Projection:
    """Makes each table of the model from the driver's tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def nations(self) -> DataFrame:
        regions = self.table("region").select("r_regionkey", slug(F.col("r_name")).alias("rs"))
        # regions and nations are fixed short lists
        return self.table("nation").join(F.broadcast(regions), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", slug(F.col("n_name")).alias("ns"), "rs")

    def suppliers(self) -> DataFrame:
        return self.table("supplier").join(F.broadcast(self.nations()), F.col("s_nationkey") == F.col("n_nationkey"))

    def entities(self) -> DataFrame:
        none, yes = F.lit(None).cast("string"), F.lit(True)
        component, region = text("component::tpch::", F.col("rs")), slug(F.col("r_name"))
        of_doc = text(F.col("source"), "/", F.col("lang"), "/", key("doc_id"))
        brand = text(slug(F.col("p_brand")), "/", slug(F.col("p_type")), "/", key("p_partkey"))
        kinds = [
            (self.spark.range(1), F.lit("repo::."), "repo", F.lit("repo"), none, F.lit("."), yes),
            (self.table("region"), text("component::tpch::", region), "component", F.col("r_name"), none, region, yes),
            (self.nations(), text("source_unit::", F.col("ns")), "source_unit", F.col("n_name"), component, text(F.col("rs"), "/", F.col("ns")), yes),
            (self.suppliers(), text("task::supplier/", key("s_suppkey")), "task", F.col("s_name"), component, text("supplier/", key("s_suppkey")), yes),
            (self.table("part"), text("symbol::part/", key("p_partkey")), "symbol", F.col("p_name"), none, brand, F.col("p_size") % 2 == 0),
            (self.table("documents"), text("doc::", of_doc), "doc", text(F.col("source"), "-", key("doc_id")), none, text("docs/", of_doc), yes),
            (self.table("pages"), text("content_page::", key("page_id")), "content_page", F.col("url"), none, F.col("url"), yes),
            (self.table("benchmark"), text("test::bench/", key("item_id")), "test", text("bench_", key("item_id")), none, text("bench/", key("item_id")), F.lit(False)),
        ]
        rows = [df.select(i.alias("id"), F.lit(k).alias("kind"), n.alias("name"), c.alias("component_id"), p.alias("path"), e.alias("exported")) for df, i, k, n, c, p, e in kinds]
        return reduce(DataFrame.unionByName, rows).withColumns({"language": none, "line_start": F.lit(None).cast("int"), "line_end": F.lit(None).cast("int"), "visibility": none})

    def edges(self) -> DataFrame:
        repo, component, region = F.lit("repo::."), text("component::tpch::", F.col("rs")), slug(F.col("r_name"))
        pairs = [
            (self.table("region"), repo, "contains", text("component::tpch::", region)),
            (self.nations(), component, "contains", text("source_unit::", F.col("ns"))),
            (self.suppliers(), text("source_unit::", F.col("ns")), "owns_task", text("task::supplier/", key("s_suppkey"))),
            (self.table("lineitem").select("l_suppkey", "l_partkey").distinct(), text("task::supplier/", key("l_suppkey")), "defines", text("symbol::part/", key("l_partkey"))),
            (self.table("documents"), repo, "documented_by", text("doc::", F.col("source"), "/", F.col("lang"), "/", key("doc_id"))),
            (self.table("benchmark"), repo, "tested_by", text("test::bench/", key("item_id"))),
        ]
        rows = [df.select(s.alias("src_id"), F.lit(r).alias("rel"), d.alias("dst_id")) for df, s, r, d in pairs]
        return reduce(DataFrame.unionByName, rows).withColumns({"provenance_path": F.lit(None).cast("string"), "provenance_line": F.lit(None).cast("int")})

    def summaries(self) -> DataFrame:
        parts = self.table("part").select(text("symbol::part/", key("p_partkey")).alias("entity_id"), text(F.col("p_name"), " ", F.col("p_type")).alias("short_summary"), F.array("p_brand", "p_type").alias("keywords"))
        docs = self.table("documents").select(text("doc::", F.col("source"), "/", F.col("lang"), "/", key("doc_id")).alias("entity_id"), F.col("text").alias("short_summary"), F.array("lang", "source").alias("keywords"))
        return parts.unionByName(docs).withColumns({"detailed_summary": F.lit(None).cast("string"), "updated_at": F.lit(""), "source_hash": F.sha2("short_summary", 256)})

    def embeddings(self) -> DataFrame:
        return self.table("embeddings").select(text("symbol::part/", key("vec_id")).alias("entity_id"), F.lit("given").alias("model"), F.size("embedding").alias("dimensions"), F.lit("").alias("updated_at"), F.col("embedding").alias("vector"))

    def files(self) -> DataFrame:
        return snapshot(self.table("documents"))

    def task_routes(self) -> DataFrame:
        return task_routes(self.entities())


def project(spark: SparkSession, sf_dir: str) -> Model:
    made = Projection(spark, sf_dir)
    return LazyModel({name: getattr(made, name) for name in TABLES})


def snapshot(documents: DataFrame) -> DataFrame:
    """Documents as files."""
    return documents.select(F.concat(F.lit("docs/"), F.col("doc_id").cast("string")).alias("path"), F.concat(F.lit("component::docs::"), F.col("source")).alias("component_id"), F.lit("doc").alias("kind"), F.sha2("text", 256).alias("hash"), F.lit(True).alias("indexed"), F.lit(None).cast("string").alias("ignore_reason"))


SQL = """
nat AS (SELECT n_nationkey, n_name, replace(lower(n_name), ' ', '_') AS ns, replace(lower(r_name), ' ', '_') AS rs FROM nation JOIN region ON n_regionkey = r_regionkey),
ents AS (
  SELECT 'repo::.' AS id, 'repo' AS kind, 'repo' AS name, CAST(NULL AS VARCHAR) AS component_id, '.' AS path, true AS exported
  UNION ALL SELECT 'component::tpch::' || replace(lower(r_name), ' ', '_'), 'component', r_name, NULL, replace(lower(r_name), ' ', '_'), true FROM region
  UNION ALL SELECT 'source_unit::' || ns, 'source_unit', n_name, 'component::tpch::' || rs, rs || '/' || ns, true FROM nat
  UNION ALL SELECT 'task::supplier/' || s_suppkey, 'task', s_name, 'component::tpch::' || rs, 'supplier/' || s_suppkey, true FROM supplier JOIN nat ON s_nationkey = n_nationkey
  UNION ALL SELECT 'symbol::part/' || p_partkey, 'symbol', p_name, NULL, replace(lower(p_brand), ' ', '_') || '/' || replace(lower(p_type), ' ', '_') || '/' || p_partkey, p_size % 2 = 0 FROM part
  UNION ALL SELECT 'doc::' || source || '/' || lang || '/' || doc_id, 'doc', source || '-' || doc_id, NULL, 'docs/' || source || '/' || lang || '/' || doc_id, true FROM documents
  UNION ALL SELECT 'content_page::' || page_id, 'content_page', url, NULL, url, true FROM pages
  UNION ALL SELECT 'test::bench/' || item_id, 'test', 'bench_' || item_id, NULL, 'bench/' || item_id, false FROM benchmark),
edg AS (
  SELECT 'repo::.' AS src_id, 'contains' AS rel, 'component::tpch::' || replace(lower(r_name), ' ', '_') AS dst_id FROM region
  UNION ALL SELECT 'component::tpch::' || rs, 'contains', 'source_unit::' || ns FROM nat
  UNION ALL SELECT 'source_unit::' || ns, 'owns_task', 'task::supplier/' || s_suppkey FROM supplier JOIN nat ON s_nationkey = n_nationkey
  UNION ALL SELECT DISTINCT 'task::supplier/' || l_suppkey, 'defines', 'symbol::part/' || l_partkey FROM lineitem
  UNION ALL SELECT 'repo::.', 'documented_by', 'doc::' || source || '/' || lang || '/' || doc_id FROM documents
  UNION ALL SELECT 'repo::.', 'tested_by', 'test::bench/' || item_id FROM benchmark),
summ AS (
  SELECT 'symbol::part/' || p_partkey AS entity_id, p_name || ' ' || p_type AS short_summary, [p_brand, p_type] AS keywords FROM part
  UNION ALL SELECT 'doc::' || source || '/' || lang || '/' || doc_id, text, [lang, source] FROM documents),
embs AS (SELECT 'symbol::part/' || vec_id AS entity_id, embedding AS vector FROM embeddings)
"""
