"""Queries over the driver's tables, one for each operator or family, with the same in SQL."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfinder.config import Weights
from wayfinder.functions.text import ancestors, first_of, hit_ratio, one_sentence, truncated, xml_escaped
from wayfinder.operators import graph, incremental, lookup, store
from wayfinder.operators.postings import TextIndex
from wayfinder.operators.ranking import numbered
from wayfinder.operators.routes import task_routes
from wayfinder.operators.vectors import VectorIndex
from wayfinder.plans import evaluate, search, summarise
from wayfinder.projection import SQL, project
from wayfinder.schema import ENTITY_KINDS, Model
from wayfinder.shared import fresh_path, materialize
from wayfinder.sources.manifests import assign_owners
from wayfinder.sources.scan import file_kind, scanned_kind

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
ENTITY = ["id", "kind", "name", "component_id", "path", "exported"]


def query(sql: str | None):
    """Registers a function of the model (and the session and folder) under its name, with its SQL over ents, edg, summ and embs."""

    def add(f: Callable):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(project(spark, sf_dir), spark, sf_dir)
        if sql:
            ORACLE[f.__name__] = sql if sql.lstrip().startswith("WITH") else f"WITH {SQL} {sql}"
        return f

    return add


def long(*names: str):
    return [F.col(n).cast("long").alias(n) for n in names]


def stored(m: Model) -> Model:
    """The model with its entities written, which a search reads several times, and routes made of them; the rest is read once."""
    entities = materialize(m.entities, "entities")
    return m.with_tables(entities=entities, task_routes=task_routes(entities))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


HIT = "CAST((CASE WHEN contains(lower({t}), 'blue') THEN 1 ELSE 0 END) + (CASE WHEN contains(lower({t}), 'bolt') THEN 1 ELSE 0 END) AS DOUBLE) / 2.0"
ANY = "(contains(lower({t}), 'blue') OR contains(lower({t}), 'bolt'))"
TEXT = "(short_summary || ' ' || array_to_string(keywords, ' '))"
SCORED = f"""
kw AS (SELECT entity_id, {HIT.format(t=TEXT)} AS keyword FROM summ WHERE {ANY.format(t=TEXT)}),
nm AS (SELECT id AS entity_id, {HIT.format(t="name")} AS name_match, {HIT.format(t="path")} AS path_match FROM ents
       WHERE kind IN ('component', 'source_unit', 'symbol') AND ({ANY.format(t="name")} OR {ANY.format(t="path")})),
cand AS (SELECT entity_id AS id, max(keyword) AS keyword, max(name_match) AS name_match, max(path_match) AS path_match FROM
         (SELECT entity_id, keyword, NULL AS name_match, NULL AS path_match FROM kw UNION ALL SELECT entity_id, NULL, name_match, path_match FROM nm) GROUP BY entity_id),
scored AS (SELECT e.id, e.kind, e.name, coalesce(keyword, 0) AS keyword, coalesce(name_match, 0) AS name_match, coalesce(path_match, 0) AS path_match,
  0.25 * coalesce(keyword, 0) + 0.20 * coalesce(name_match, 0) + 0.10 * (CASE WHEN kind IN ('component', 'source_unit', 'symbol') THEN 1 ELSE 0 END)
  + 0.10 * (CASE WHEN exported THEN 1 ELSE 0 END) + 0.10 * coalesce(path_match, 0) AS score FROM cand JOIN ents e USING (id))
"""


@query(f"WITH {SQL}, {SCORED} SELECT row_number() OVER (ORDER BY round(score, 6) DESC, id) AS rank, id, kind, name, round(score, 6) AS score, keyword, name_match, path_match FROM scored ORDER BY rank LIMIT 15")
def search_lexical(m: Model, *_) -> DataFrame:
    """The lexical signals merged, scored and ranked."""
    found = search.scored(search.candidates_for(m, [search.Asked("blue bolt", "general")], 45), Weights()).withColumn("final_score", F.round("final_score", 6))
    top = found.orderBy(F.desc("final_score"), "id").limit(15)
    zero = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("keyword", "name_match", "path_match")]
    ranked = top.select(F.row_number().over(Window.orderBy(F.desc("final_score"), "id")).cast("long").alias("rank"), "id", "kind", F.col("final_score").alias("score"), *zero)
    return m.entities.select("id", "name").join(F.broadcast(ranked), "id").select("rank", "id", "kind", "name", "score", "keyword", "name_match", "path_match")


#: Tokens are fix, blue and bolt; the category is debug. Fifteen seeds in turn add at most five neighbours each that are new.
SHARE3 = "CAST((CASE WHEN contains(lower({t}), 'fix') THEN 1 ELSE 0 END) + (CASE WHEN contains(lower({t}), 'blue') THEN 1 ELSE 0 END) + (CASE WHEN contains(lower({t}), 'bolt') THEN 1 ELSE 0 END) AS DOUBLE) / 3.0"
PREFERRED = "kind IN ('source_unit', 'symbol', 'test', 'spec')"
PLAN_SQL = f"""WITH RECURSIVE {SQL},
kw AS (SELECT entity_id AS id, {SHARE3.format(t=TEXT)} AS keyword FROM summ WHERE {SHARE3.format(t=TEXT)} > 0),
nm AS (SELECT id, {SHARE3.format(t="name")} AS name_match, {SHARE3.format(t="coalesce(path, '')")} AS path_match FROM ents WHERE {PREFERRED} AND ({SHARE3.format(t="name")} > 0 OR {SHARE3.format(t="coalesce(path, '')")} > 0)),
rt AS (SELECT id, 60 AS route FROM ents WHERE kind = 'test' UNION ALL SELECT id, 50 FROM ents WHERE kind = 'source_unit'),
ve AS (SELECT entity_id AS id, 1 / (1 + d) AS vector FROM (SELECT entity_id, 1 - list_cosine_similarity(CAST(vector AS DOUBLE[]), CAST((SELECT embedding FROM embeddings WHERE vec_id = 0) AS DOUBLE[])) AS d FROM embs) ORDER BY d, entity_id LIMIT 45),
cand AS MATERIALIZED (SELECT id, keyword, name_match, path_match, route, vector FROM kw FULL JOIN nm USING (id) FULL JOIN rt USING (id) FULL JOIN ve USING (id)),
sc AS MATERIALIZED (SELECT id, keyword, name_match, path_match, route, vector, false AS is_context,
  0.25 * coalesce(route, 0) / 100 * {{route}} + {{keyword}} * coalesce(keyword, 0) + {{name_match}} * coalesce(name_match, 0) + {{vector}} * coalesce(vector, 0) + {{kind}} * (CASE WHEN {PREFERRED} THEN 1 ELSE 0 END) + {{exported}} * (CASE WHEN exported THEN 1 ELSE 0 END) + {{path_match}} * coalesce(path_match, 0) AS score FROM cand JOIN ents USING (id)),
seeds AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY round(score, 12) DESC, id) AS turn FROM sc QUALIFY turn <= 15),
nb AS (SELECT src_id AS id, 0 AS way, rel, dst_id AS other FROM edg UNION ALL SELECT dst_id, 1, rel, src_id FROM edg),
ord AS (SELECT *, list_position(['contains', 'defines', 'depends_on', 'reexports', 'documented_by', 'tested_by', 'benchmarked_by', 'related_to', 'configured_by', 'builds', 'deploys', 'implements', 'owns_task'], rel) AS rel_at FROM nb),
near AS (SELECT turn, other, min(ROW(way, rel_at)) AS place FROM seeds JOIN ord USING (id) WHERE other IN (SELECT id FROM ents) AND other NOT IN (SELECT id FROM sc) GROUP BY turn, other),
lists AS MATERIALIZED (SELECT turn, list(other ORDER BY place, other) AS others FROM (SELECT *, row_number() OVER (PARTITION BY turn ORDER BY place, other) AS n FROM near QUALIFY n <= 75) GROUP BY turn),
fold(turn, added) AS (SELECT 0, CAST([] AS VARCHAR[]) UNION ALL SELECT fold.turn + 1, list_concat(added, list_slice(list_filter(coalesce(others, CAST([] AS VARCHAR[])), lambda x: NOT list_contains(added, x)), 1, 5)) FROM fold LEFT JOIN lists ON lists.turn = fold.turn + 1 WHERE fold.turn < 15),
more AS (SELECT unnest(added) AS id FROM fold WHERE turn = 15),
allrows AS (SELECT * FROM sc UNION ALL SELECT id, NULL, NULL, NULL, NULL, NULL, true, 0.5 * ({{kind}} * (CASE WHEN {PREFERRED} THEN 1 ELSE 0 END) + {{exported}} * (CASE WHEN exported THEN 1 ELSE 0 END)) FROM more JOIN ents USING (id)),
ranked AS (SELECT *, row_number() OVER (ORDER BY round(score, 12) DESC, id) AS rank FROM allrows),
gap AS (SELECT min(rank) AS g FROM (SELECT rank, score, lag(score) OVER (ORDER BY rank) AS before FROM ranked) WHERE rank > 3 AND score / before < 0.8)
SELECT rank, id, kind, name, round(score, 6) AS score, is_context,
  array_to_string(list_filter([CASE WHEN route > 0 THEN 'task route' END, CASE WHEN keyword > 0 THEN 'keyword match' END, CASE WHEN name_match > 0 THEN 'name match' END, CASE WHEN path_match > 0 THEN 'path match' END, CASE WHEN vector > 0 THEN 'semantic similarity' END, CASE WHEN is_context THEN 'graph neighbor' END], lambda x: x IS NOT NULL), ', ') AS reasons
FROM ranked JOIN ents USING (id) WHERE rank <= least(coalesce((SELECT g FROM gap) - 1, 8), 8)"""
W = Weights()
PLAN_SQL = PLAN_SQL.replace("0.25 * coalesce(route, 0) / 100 * {route}", f"{W.task_route} * coalesce(route, 0) / 100").format(keyword=W.keyword, name_match=W.name_match, vector=W.vector, kind=W.kind_preference, exported=W.exported, path_match=W.path_match)


@query(PLAN_SQL)
def search_reading_plan(m: Model, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid search with a query vector, routes, greedy expansion and cutoff over the stored model."""
    vector = table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").head()[0]
    from wayfinder.config import Search

    plan = search.search(stored(m), "fix blue bolt", query_vector=vector, config=Search(cutoff="relative_gap"))
    return plan.entries.select(*long("rank"), "id", "kind", "name", F.round("final_score", 6).alias("score"), "is_context", F.array_join("reasons", ", ").alias("reasons"))


@query(PLAN_SQL[: PLAN_SQL.index("allrows AS")].rstrip().rstrip(",") + " SELECT id FROM more")
def expanded_neighbours(m: Model, spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the fifteen best candidates of the same search add in turn."""
    vector = table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").head()[0]
    m = stored(m)
    found = materialize(search.scored(search.candidates_for(m, [search.Asked("fix blue bolt", vector=vector)], 45), Weights()), "candidates")
    return search.expand(found, m.entities, m.edges, 15).select("id")


@query("SELECT id, kind, name, component_id, path, exported FROM ents")
def scan_entities(m: Model, *_) -> DataFrame:
    return m.entities.select(*ENTITY)


@query("SELECT src_id, rel, dst_id FROM edg")
def scan_edges(m: Model, *_) -> DataFrame:
    return m.edges.select("src_id", "rel", "dst_id")


@query("SELECT entity_id, short_summary, array_to_string(keywords, ',') AS keywords FROM summ")
def scan_summaries(m: Model, *_) -> DataFrame:
    return m.summaries.select("entity_id", "short_summary", F.array_join("keywords", ",").alias("keywords"))


@query("SELECT entity_id, CAST(len(vector) AS BIGINT) AS dimensions FROM embs")
def scan_embedding_metas(m: Model, *_) -> DataFrame:
    return m.embeddings.select("entity_id", *long("dimensions"))


@query("SELECT 'docs/' || doc_id AS path, sha256(text) AS hash FROM documents")
def scan_files(m: Model, *_) -> DataFrame:
    return m.files.select("path", "hash")


@query("SELECT id, kind, name, component_id, path, exported FROM ents WHERE id = 'symbol::part/7'")
def entity_lookup(m: Model, *_) -> DataFrame:
    return lookup.entity_view(m, "symbol::part/7")["entity"].select(*ENTITY)


@query("SELECT id, kind, name, component_id, path, exported FROM ents WHERE component_id = 'component::tpch::asia'")
def entities_by_component(m: Model, *_) -> DataFrame:
    return lookup.entities_where(m.entities, component="component::tpch::asia", kind="symbol").select(*ENTITY)


@query("SELECT id, kind, name, component_id, path, exported FROM ents WHERE kind = 'source_unit'")
def entities_of_kind(m: Model, *_) -> DataFrame:
    return lookup.entities_where(m.entities, kind="source_unit").select(*ENTITY)


@query("SELECT id, kind, name, component_id, path, exported FROM ents WHERE path = 'supplier/3'")
def entities_by_path(m: Model, *_) -> DataFrame:
    return m.entities.where("path = 'supplier/3'").select(*ENTITY)


@query("SELECT src_id, rel, dst_id FROM edg WHERE src_id = 'task::supplier/3' AND rel = 'defines'")
def edges_filtered(m: Model, *_) -> DataFrame:
    return lookup.edges_where(m.edges, src="task::supplier/3", rel="defines").select("src_id", "rel", "dst_id")


@query("SELECT src_id, rel, dst_id FROM edg WHERE dst_id = 'symbol::part/7'")
def edges_to(m: Model, *_) -> DataFrame:
    return lookup.edges_where(m.edges, dst="symbol::part/7").select("src_id", "rel", "dst_id")


@query("SELECT kind, count(*) AS n FROM ents GROUP BY kind")
def entities_by_kind(m: Model, *_) -> DataFrame:
    return m.entities.groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT rel, count(*) AS n FROM edg GROUP BY rel")
def edges_by_rel(m: Model, *_) -> DataFrame:
    return m.edges.groupBy("rel").agg(F.count("*").alias("n"))


@query("SELECT id, kind, name, component_id, path, exported FROM ents WHERE kind IN ('symbol', 'doc') AND (contains(lower(name), 'blue') OR contains(lower(path), 'blue') OR contains(lower(name), 'src1-') OR contains(lower(path), 'src1-'))")
def name_path_search(m: Model, *_) -> DataFrame:
    return lookup.entities_named(m.entities, ["blue", "src1-"], ["symbol", "doc"]).select(*ENTITY)


@query(f"SELECT entity_id, short_summary FROM summ WHERE {ANY.format(t=TEXT)}")
def summary_search(m: Model, *_) -> DataFrame:
    return lookup.summaries_with(m.summaries, ["blue", "bolt"]).select("entity_id", "short_summary")


@query(f"SELECT entity_id, {HIT.format(t=TEXT)} AS ratio FROM summ")
def token_hit_ratio(m: Model, *_) -> DataFrame:
    return m.summaries.select("entity_id", hit_ratio(lookup.summary_text(), ["blue", "bolt"]).alias("ratio"))


ROUTE_SQL = """
base AS (
  SELECT id, unnest(CASE kind
    WHEN 'component' THEN [('understand', 80), ('architecture', 80), ('build', 70), ('implement', 70)]
    WHEN 'source_unit' THEN [('understand', CASE WHEN lower(path) LIKE '%mod.rs' OR lower(path) LIKE '%lib.rs' THEN 60 ELSE 30 END), ('architecture', CASE WHEN lower(path) LIKE '%mod.rs' OR lower(path) LIKE '%lib.rs' THEN 60 ELSE 30 END), ('debug', 50), ('fix', 50), ('build', 40), ('implement', 40)]
    WHEN 'symbol' THEN [('build', 50), ('implement', 50)]
    WHEN 'test' THEN [('test', 80), ('bench', 40), ('debug', 60), ('fix', 60)]
    WHEN 'doc' THEN [('understand', 70), ('architecture', 70)]
    WHEN 'content_page' THEN [('understand', 60), ('build', 40)]
    WHEN 'task' THEN CASE WHEN contains(lower(name), 'deploy') OR contains(lower(name), 'release') OR contains(lower(name), 'ci') THEN [('deploy', 80), ('release', 80)]
                          WHEN contains(lower(name), 'test') THEN [('test', 70), ('bench', 40)] WHEN contains(lower(name), 'build') THEN [('build', 70), ('implement', 40)] ELSE [] END
    ELSE [] END) AS r FROM ents),
late AS (SELECT id, unnest([('configure', 60), ('setup', 60)]) AS r FROM ents WHERE contains(lower(name), 'config') OR contains(lower(coalesce(path, '')), 'config')),
routes AS (SELECT r[1] AS task_name, id AS entity_id, CAST(r[2] AS BIGINT) AS priority FROM late
  UNION ALL SELECT b.r[1], b.id, CAST(b.r[2] AS BIGINT) FROM base b WHERE NOT EXISTS (SELECT 1 FROM late l WHERE l.id = b.id AND l.r[1] = b.r[1]))
"""


@query(f"WITH {SQL}, {ROUTE_SQL} SELECT task_name, entity_id, priority FROM routes")
def routes(m: Model, *_) -> DataFrame:
    return task_routes(m.entities).select("task_name", "entity_id", *long("priority"))


@query(f"WITH {SQL}, {ROUTE_SQL} SELECT entity_id, priority FROM routes WHERE task_name = 'debug'")
def routes_by_task(m: Model, *_) -> DataFrame:
    return lookup.routes_where(m.task_routes, task="debug").select("entity_id", *long("priority"))


@query(f"WITH {SQL}, {ROUTE_SQL} SELECT entity_id, max(priority) AS route_priority FROM routes WHERE task_name IN ('debug', 'fix') AND priority > 0 GROUP BY entity_id")
def route_signal(m: Model, *_) -> DataFrame:
    return search.retrieve_routes(m.task_routes, "debug").select("entity_id", *long("route_priority"))


@query("SELECT e.id, e.name FROM ents e WHERE kind = 'component' AND NOT EXISTS (SELECT 1 FROM edg WHERE rel = 'documented_by' AND src_id = e.id)")
def undocumented_components(m: Model, *_) -> DataFrame:
    return lookup.undocumented(m.entities, m.edges).select("id", "name")


@query(f"""SELECT e.id, t.field, w AS token FROM ents e, (VALUES ('name'), ('path')) t(field), (VALUES ('blue'), ('src1-'), ('1')) v(w)
WHERE contains(lower(CASE WHEN field = 'name' THEN name ELSE coalesce(path, '') END), w) UNION ALL SELECT entity_id, 'summary', w FROM summ, (VALUES ('blue'), ('src1-'), ('1')) v(w) WHERE contains(lower({TEXT}), w)""")
def indexed_substrings(m: Model, *_) -> DataFrame:
    """Substrings of names, paths and summaries by trigram postings; the shortest token scans."""
    return TextIndex.build(m).find(["blue", "src1-", "1"])


@query(f"""SELECT e.id, 'name' AS field FROM ents e WHERE kind <> 'doc' AND contains(lower(CASE WHEN kind = 'symbol' THEN name || ' bolt' ELSE name END), 'bolt')
UNION ALL SELECT id, 'path' FROM ents WHERE contains(lower(coalesce(path, '')), 'bolt') UNION ALL SELECT entity_id, 'summary' FROM summ WHERE contains(lower({TEXT}), 'bolt')""")
def indexed_after_changes(m: Model, *_) -> DataFrame:
    """The index after names of symbols were changed and names of documents taken away, without being built anew."""
    names = m.entities.select(F.lit("name").alias("field"), "id", "kind", F.col("name").alias("text"))
    changed = TextIndex.build(m).put(names.where("kind = 'symbol'").select("field", "id", F.concat("text", F.lit(" Bolt")).alias("text")))
    return changed.remove(names.where("kind = 'doc'")).find(["bolt"]).select("id", "field")


VEC = "SELECT entity_id, 1 - list_cosine_similarity(CAST(vector AS DOUBLE[]), CAST((SELECT embedding FROM embeddings WHERE vec_id = 0) AS DOUBLE[])) AS d FROM embs"


@query(f"SELECT entity_id, round(1 / (1 + d), 6) AS vector FROM ({VEC}) ORDER BY d, entity_id LIMIT 45")
def vector_top_k(m: Model, spark: SparkSession, sf_dir: str) -> DataFrame:
    vector = table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").head()[0]
    return search.retrieve_vectors(m.embeddings, vector, 45).select("entity_id", F.round("vector", 6).alias("vector"))


@query(f"SELECT entity_id, round(1 / (1 + d), 6) AS vector FROM ({VEC}) ORDER BY d, entity_id LIMIT 45")
def indexed_vector_top_k(m: Model, spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same nearest vectors through the index, which reads codes and the few vectors that bounds leave."""
    vector = table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").head()[0]
    return search.retrieve_vectors(m.embeddings, vector, 45, VectorIndex.build(m.embeddings)).select("entity_id", F.round("vector", 6).alias("vector"))


@query(f"WITH {SQL}, {SCORED} , ranked AS (SELECT id, row_number() OVER (ORDER BY round(score, 6) DESC, id) AS rank, round(score, 6) AS score FROM scored), lagged AS (SELECT *, lag(score) OVER (ORDER BY rank) AS before FROM ranked), gap AS (SELECT min(rank) AS g FROM lagged WHERE rank > 3 AND (CASE WHEN before > 0 THEN score / before ELSE 0 END) < 0.95) SELECT id, rank, score FROM ranked WHERE rank <= least(coalesce((SELECT g FROM gap) - 1, 4000), 4000)")
def relative_gap_cutoff(m: Model, *_) -> DataFrame:
    """Over all ranked rows, with a large upper bound so that the gap decides; ranks and gaps are found without a task that holds all rows."""
    found = search.scored(search.candidates_for(m, [search.Asked("blue bolt", "general")], 45), Weights()).withColumn("final_score", F.round("final_score", 6))
    ranked = numbered(found.select("id", "final_score"), [F.desc("final_score"), F.asc("id")])
    return search.cutoff(ranked, "relative_gap", 0.95, 3, 4000).select("id", *long("rank"), F.col("final_score").alias("score"))


@query(f"WITH RECURSIVE {SQL}, walk(id, depth) AS (SELECT 'repo::.', 0 UNION SELECT CASE WHEN e.src_id = w.id THEN e.dst_id ELSE e.src_id END, w.depth + 1 FROM walk w JOIN edg e ON (e.src_id = w.id OR e.dst_id = w.id) WHERE w.depth < 4) SELECT id, CAST(min(depth) AS BIGINT) AS depth FROM walk GROUP BY id")
def traversal_depths(m: Model, spark: SparkSession, sf_dir: str) -> DataFrame:
    """H1 E5: breadth first from the repository along all edges to depth 4, without a bound on nodes."""
    seeds = spark.createDataFrame([("repo::.",)], "id string")
    return graph.depths(m.entities, m.edges, seeds, 4).select("id", *long("depth"))


#: Levels one by one: each numbers its finds by their first parent, way, relation and id, within what is left of 5,000 nodes.
LEVEL = """l{d} AS MATERIALIZED (SELECT id, {d} AS depth, {before} + row_number() OVER (ORDER BY place) - 1 AS ord FROM (SELECT other AS id, min(ROW(ord, way, rel_at, other)) AS place FROM l{p} JOIN nb USING (id)
  WHERE other IN (SELECT id FROM ok) AND other NOT IN ({seen}) GROUP BY other) QUALIFY ord < 5000)"""


def seen_before(d: int) -> str:
    return " UNION ALL ".join(f"SELECT id FROM l{k}" for k in range(d))


LEVELS = ",\n".join(LEVEL.format(d=d, p=d - 1, before=f"(SELECT count(*) FROM ({seen_before(d)}))", seen=seen_before(d)) for d in (1, 2, 3))


@query(f"""WITH {SQL}, ok AS (SELECT id FROM ents WHERE kind IN ('component', 'source_unit', 'task', 'symbol') AND NOT contains(id, 'part/1')),
nb AS (SELECT src_id AS id, 0 AS way, list_position(['contains', 'defines', 'depends_on', 'reexports', 'documented_by', 'tested_by', 'benchmarked_by', 'related_to', 'configured_by', 'builds', 'deploys', 'implements', 'owns_task'], rel) AS rel_at, dst_id AS other FROM edg
  UNION ALL SELECT dst_id, 1, list_position(['contains', 'defines', 'depends_on', 'reexports', 'documented_by', 'tested_by', 'benchmarked_by', 'related_to', 'configured_by', 'builds', 'deploys', 'implements', 'owns_task'], rel), src_id FROM edg),
l0 AS (SELECT 'component::tpch::asia' AS id, 0 AS depth, 0 AS ord),
{LEVELS}
SELECT id, CAST(depth AS BIGINT) AS depth, CAST(ord AS BIGINT) AS ord FROM ({" UNION ALL ".join(f"SELECT * FROM l{d}" for d in range(4))})""")
def traversal_bounded(m: Model, spark: SparkSession, sf_dir: str) -> DataFrame:
    """5,000 nodes in queue order, some kinds only."""
    seeds = spark.createDataFrame([("component::tpch::asia", 0)], "id string, ord int")
    return graph.traverse(m.entities, m.edges, seeds, 3, 5000, ["component", "source_unit", "task", "symbol"], ("part/1",)).select("id", *long("depth", "ord"))


@query("SELECT src_id, rel, dst_id FROM edg WHERE src_id IN (SELECT id FROM ents WHERE kind IN ('repo', 'component', 'source_unit')) AND dst_id IN (SELECT id FROM ents WHERE kind IN ('repo', 'component', 'source_unit'))")
def edges_between(m: Model, *_) -> DataFrame:
    return graph.edges_between(m.edges, m.entities.where("kind in ('repo', 'component', 'source_unit')").select("id")).select("src_id", "rel", "dst_id")


@query("SELECT id, count(DISTINCT other) AS neighbours, count(*) AS edges FROM (SELECT src_id AS id, dst_id AS other FROM edg UNION ALL SELECT dst_id, src_id FROM edg) GROUP BY id")
def node_degrees(m: Model, *_) -> DataFrame:
    return graph.degrees(m.edges)


FOCUS = ["test", "doc", "repo"]


@query(f"SELECT id FROM ents LEFT JOIN (SELECT id, count(*) AS n FROM (SELECT src_id AS id FROM edg UNION ALL SELECT dst_id FROM edg) GROUP BY id) USING (id) ORDER BY coalesce(list_position({FOCUS}, kind), 9), coalesce(n, 0) DESC, exported DESC, id DESC LIMIT 1")
def focus_node(m: Model, *_) -> DataFrame:
    """over all entities, those of kinds that aren't ranked last."""
    return graph.focus(m.entities, m.edges, FOCUS)


@query("SELECT e.src_id, e.rel, e.dst_id FROM edg e WHERE rel IN ('contains', 'documented_by') AND EXISTS (SELECT 1 FROM ents WHERE id = e.src_id AND kind IN ('repo', 'component', 'doc', 'source_unit')) AND EXISTS (SELECT 1 FROM ents WHERE id = e.dst_id AND kind IN ('repo', 'component', 'doc', 'source_unit'))")
def repo_overview(m: Model, *_) -> DataFrame:
    return graph.overview(m.entities, m.edges)[1].select("src_id", "rel", "dst_id")


TREE_SQL = """
tree AS (SELECT child, parent, rel, priority FROM (
  SELECT e.dst_id AS child, e.src_id AS parent, e.rel, CAST(CASE WHEN e.rel = 'contains' AND p.kind = 'repo' AND c.kind = 'component' THEN 60 WHEN e.rel = 'documented_by' AND p.kind IN ('repo', 'component') AND c.kind = 'doc' THEN 55
    WHEN e.rel = 'contains' AND p.kind = 'component' AND c.kind = 'source_unit' THEN 50 END AS BIGINT) AS priority
  FROM edg e JOIN ents p ON p.id = e.src_id JOIN ents c ON c.id = e.dst_id) WHERE priority IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY child ORDER BY priority DESC, parent) = 1)
"""


@query(f"WITH {SQL}, {TREE_SQL} SELECT child, parent, rel, priority FROM tree")
def structure_tree(m: Model, *_) -> DataFrame:
    return graph.tree_parents(m.entities, m.edges).select("child", "parent", "rel", *long("priority"))


@query(f"WITH {SQL}, {TREE_SQL}, up AS (SELECT child, parent AS id FROM tree UNION ALL SELECT t.child, u.parent FROM tree t JOIN tree u ON u.child = t.parent) SELECT up.id, kind, count(*) AS n FROM up JOIN ents ON ents.id = up.child GROUP BY up.id, kind")
def tree_descendants(m: Model, *_) -> DataFrame:
    return graph.descendants(m.entities, graph.tree_parents(m.entities, m.edges))


@query(f"""SELECT id, name, kind, CAST((CASE WHEN starts_with(lower(name), 'blue') THEN 120 ELSE 0 END) + (CASE WHEN starts_with(lower(coalesce(path, '')), 'blue') THEN 95 ELSE 0 END) + (CASE WHEN starts_with(lower(id), 'blue') THEN 80 ELSE 0 END)
 + (CASE WHEN contains(lower(name), 'blue') THEN 36 ELSE 0 END) + (CASE WHEN contains(lower(coalesce(path, '')), 'blue') THEN 24 ELSE 0 END) + (CASE WHEN contains(lower(coalesce(short_summary, '')), 'blue') THEN 12 ELSE 0 END) - 2 * (list_position({ENTITY_KINDS}, kind) - 1) AS BIGINT) AS score
 FROM ents LEFT JOIN summ ON entity_id = id WHERE contains(lower(name) || ' ' || lower(coalesce(path, '')) || ' ' || lower(id) || ' ' || kind || ' ' || lower(coalesce(short_summary, '')), 'blue') ORDER BY score DESC, name, id LIMIT 12""")
def explorer_search(m: Model, *_) -> DataFrame:
    return graph.explorer_search(m.entities, m.summaries, "blue", ENTITY_KINDS)


EVAL_SQL = """
WITH r AS (SELECT lang AS query, CAST(doc_id AS VARCHAR) AS e, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents),
l AS (SELECT lang AS query, CASE WHEN lang = 'en' THEN 'large' ELSE 'small' END AS bucket, CAST(doc_id AS VARCHAR) AS e, CASE WHEN quality = 1 THEN 2 ELSE 1 END AS gain FROM documents JOIN labels USING (doc_id) WHERE quality = 1 OR toxic = 0),
x AS (SELECT r.query, rank, coalesce(gain, 0) AS gain FROM r LEFT JOIN l ON l.query = r.query AND l.e = r.e),
s AS (SELECT query, count(*) FILTER (gain = 2 AND rank <= 5) AS found, min(rank) FILTER (gain = 2 AND rank <= 10) AS first, sum(CASE WHEN rank <= 10 THEN (pow(2, gain) - 1) / log2(rank + 1) ELSE 0 END) AS dcg, avg(CASE WHEN gain = 0 THEN 1.0 ELSE 0.0 END) FILTER (rank > 5) AS noise FROM x GROUP BY query),
w AS (SELECT query, bucket, count(*) FILTER (gain = 2) AS rel, count(*) FILTER (gain = 1) AS acc FROM l GROUP BY query, bucket),
i AS (SELECT query, sum((CASE WHEN p <= rel THEN 3.0 WHEN p <= rel + acc THEN 1.0 ELSE 0 END) / log2(p + 1)) AS ideal FROM (SELECT *, unnest(range(1, 11)) AS p FROM w) GROUP BY query),
m AS (SELECT query, bucket, coalesce(found / nullif(rel, 0), 0.0) AS recall_at_5, coalesce(1.0 / first, 0.0) AS mrr_at_10, coalesce(dcg / nullif(ideal, 0), 0.0) AS ndcg_at_10, coalesce(noise, 0.0) AS noise_tail_rate FROM w JOIN i USING (query) LEFT JOIN s USING (query))
"""
METRICS = ("recall_at_5", "mrr_at_10", "ndcg_at_10", "noise_tail_rate")
ROUNDED = ", ".join(f"CAST(round({c}, 6) AS DOUBLE) AS {c}" for c in METRICS)


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ranked = docs.select(F.col("lang").alias("query"), F.col("doc_id").cast("string").alias("entity_id"), F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id")).alias("rank"))
    labels = docs.join(table(spark, sf_dir, "labels"), "doc_id").where("quality = 1 or toxic = 0").select(F.col("lang").alias("query"), F.when(F.col("lang") == "en", "large").otherwise("small").alias("bucket"), F.col("doc_id").cast("string").alias("entity_id"), F.when(F.col("quality") == 1, 2).otherwise(1).alias("gain"))
    return evaluate.query_metrics(ranked, labels)


@query(f"{EVAL_SQL} SELECT query, bucket, {ROUNDED} FROM m")
def evaluation_by_query(m: Model, spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).select("query", "bucket", *(F.round(c, 6).alias(c) for c in METRICS))


@query(f"{EVAL_SQL} SELECT bucket, {', '.join(f'CAST(round(avg({c}), 6) AS DOUBLE) AS {c}' for c in METRICS)}, count(*) AS queries FROM m GROUP BY GROUPING SETS ((bucket), ())")
def evaluation_summary(m: Model, spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.summary_metrics(_judged(spark, sf_dir)).select("bucket", *(F.round(c, 6).alias(c) for c in METRICS), "queries")


@query("SELECT id, CASE WHEN kind = 'symbol' AND id LIKE '%1' THEN 'new' ELSE name END AS name FROM ents UNION ALL SELECT 'symbol::added', 'new'")
def upsert_entities(m: Model, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed rows replace those of the same key, of several the last wins, new keys come in."""
    changed = m.entities.where("kind = 'symbol' and id like '%1'").withColumn("name", F.lit("new"))
    added = m.entities.where("kind = 'repo'").withColumns({"id": F.lit("symbol::added"), "name": F.lit("new")})
    batch = changed.withColumn("name", F.lit("old")).withColumn("at", F.lit(1)).unionByName(changed.unionByName(added).withColumn("at", F.lit(2)))
    return store.upsert_table(m, "entities", batch, "at").entities.select("id", "name")


GONE = "gone AS (SELECT id FROM ents WHERE component_id = 'component::tpch::asia')"


@query(f"""WITH {SQL}, {ROUTE_SQL}, {GONE},
c AS (SELECT 'entities' AS "table", count(*) AS rows, count(*) FILTER (id IN (SELECT id FROM gone)) AS deleted FROM ents
 UNION ALL SELECT 'edges', count(*), count(*) FILTER (src_id IN (SELECT id FROM gone) OR dst_id IN (SELECT id FROM gone)) FROM edg
 UNION ALL SELECT 'summaries', count(*), count(*) FILTER (entity_id IN (SELECT id FROM gone)) FROM summ UNION ALL SELECT 'embeddings', count(*), count(*) FILTER (entity_id IN (SELECT id FROM gone)) FROM embs
 UNION ALL SELECT 'task_routes', count(*), count(*) FILTER (entity_id IN (SELECT id FROM gone)) FROM routes UNION ALL SELECT 'files', count(*), 0 FROM documents)
SELECT "table", rows - deleted AS rows, deleted FROM c""")
def cascade_delete(m: Model, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of a component go with all that hangs on them, in a stored model; rows and deleted rows
    of all six tables as the tasks that wrote them counted."""
    root = fresh_path(spark, "model")
    before = store.save(m, root)
    after = store.update(spark, root, lambda m: store.cascade_entities(m, materialize(m.entities.where("component_id = 'component::tpch::asia'").select("id"), "gone")))
    return spark.createDataFrame([(n, after.rows[n], before.rows[n] - after.rows[n]) for n in after.rows], "table string, rows long, deleted long")


@query("SELECT id FROM ents WHERE path IS NULL OR path NOT IN ('supplier/1', 'supplier/2')")
def cascade_files(m: Model, spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.cascade_files(m, spark.createDataFrame([("supplier/1",), ("supplier/2",)], "path string")).entities.select("id")


@query("SELECT id FROM ents WHERE component_id IS NULL OR component_id <> 'component::tpch::asia'")
def delete_by_component(m: Model, *_) -> DataFrame:
    return store.delete_where(m.entities, F.col("component_id") == "component::tpch::asia").select("id")


#: All documents are files of both states; English texts are altered, some sources have files that go and others files that come.
DIFF_SQL = """WITH d AS (SELECT doc_id, coalesce(text, '') AS text, lang, source FROM documents),
o AS (SELECT 'docs/' || doc_id AS path, sha256(text) AS h, source FROM d UNION ALL SELECT 'old/' || doc_id, sha256(text), source FROM d WHERE source < 'src3'),
n AS (SELECT 'docs/' || doc_id AS path, sha256(CASE WHEN lang = 'en' THEN text || 'x' ELSE text END) AS h, CASE WHEN lang = 'de' THEN 'moved' ELSE source END AS source FROM d UNION ALL SELECT 'new/' || doc_id, sha256(text), source FROM d WHERE source >= 'src3')
"""


def states(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents as files, and what became of them."""
    text = F.coalesce("text", F.lit(""))
    files = lambda folder, text, source: docs.select(F.concat(F.lit(folder), F.col("doc_id").cast("string")).alias("path"), F.sha2(text, 256).alias("hash"), F.concat(F.lit("component::docs::"), source).alias("component_id"))
    plain = lambda folder, which: files(folder, text, F.col("source")).where(which)
    altered = F.when(F.col("lang") == "en", F.concat(text, F.lit("x"))).otherwise(text)
    now = files("docs/", altered, F.when(F.col("lang") == "de", "moved").otherwise(F.col("source")))
    early = F.col("component_id") < "component::docs::src3"
    return plain("docs/", F.lit(True)).unionByName(plain("old/", early)), now.unionByName(plain("new/", ~early))


@query(f"{DIFF_SQL} SELECT path, CASE WHEN o.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'deleted' ELSE 'changed' END AS change FROM o FULL JOIN n USING (path) WHERE o.h IS DISTINCT FROM n.h OR o.source IS DISTINCT FROM n.source")
def file_changes(m: Model, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two states of the documents that differ by files that came, went, were altered or got another owner."""
    before, now = states(table(spark, sf_dir, "documents"))
    return incremental.classify_files(now, before)


@query("SELECT id FROM ents WHERE kind = 'component' AND id <> 'component::tpch::asia'")
def orphaned_components(m: Model, spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.orphaned_components(m.entities, spark.createDataFrame([("component::tpch::asia",)], "component_id string"), "tpch")


@query("SELECT entity_id FROM summ JOIN ents ON id = entity_id WHERE entity_id NOT IN (SELECT entity_id FROM embs)")
def stale_embeddings(m: Model, *_) -> DataFrame:
    return incremental.stale_embeddings(m.summaries, m.entities, m.embeddings, "given").select("entity_id")


@query("SELECT entity_id FROM summ WHERE entity_id LIKE '%3'")
def stale_summaries(m: Model, *_) -> DataFrame:
    fresh = m.summaries.select("entity_id", F.when(F.col("entity_id").endswith("3"), F.concat("source_hash", F.lit("x"))).otherwise(F.col("source_hash")).alias("source_hash"))
    return incremental.stale_summaries(fresh, m.summaries).select("entity_id")


def one_of(values: list[str]) -> Callable:
    return lambda w: w.isin(values)


@query("""WITH q AS (SELECT conv_id, turn, role, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '') AS ws FROM conversations),
c AS (SELECT q.*, category, k, len(list_filter(ws, lambda w: list_contains(words, w))) AS n FROM q, (VALUES (0, 'debug', ['debug', 'fix', 'bug', 'error', 'panic', 'crash', 'trace']), (1, 'build', ['build', 'implement', 'add', 'create', 'write']), (2, 'test', ['test', 'tests', 'bench', 'verify', 'assert']),
 (3, 'deploy', ['deploy', 'release', 'publish', 'ship', 'prod']), (4, 'configure', ['configure', 'setup', 'settings', 'env', 'config']), (5, 'understand', ['understand', 'how', 'what', 'architecture', 'design', 'overview'])) l(k, category, words))
SELECT conv_id, turn, CASE WHEN max(n) = 0 THEN 'general' ELSE max_by(category, ROW(n, k)) END AS category, max(n) AS words FROM c GROUP BY conv_id, turn, role""")
def classified_queries(m: Model, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of the conversations as a query."""
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    most = F.array_max(F.array(*(F.size(F.filter(words, one_of(x))) for x in search.LEXICON.values())))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", search.classify_column(text).alias("category"), most.cast("long").alias("words"))


@query("SELECT path, CASE WHEN starts_with(path, 'docs/src1/en/') THEN 'component::x::docs/src1/en' WHEN starts_with(path, 'docs/src1/') THEN 'component::x::docs/src1' WHEN starts_with(path, 'docs/') THEN 'component::x::docs' ELSE 'component::x::.' END AS component_id FROM ents WHERE kind IN ('doc', 'task')")
def longest_prefix_owner(m: Model, spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = spark.createDataFrame([(r, f"component::x::{r or '.'}") for r in ("", "docs", "docs/src1", "docs/src1/en", "doc")], "root string, component_id string")
    return assign_owners(m.entities.where("kind in ('doc', 'task')").select("path"), roots).select("path", "component_id")


@query("SELECT id, CAST(len(string_split(path, '/')) AS BIGINT) AS depth FROM ents")
def path_depth(m: Model, *_) -> DataFrame:
    return m.entities.select("id", F.size(ancestors(F.col("path"))).cast("long").alias("depth"))


@query("SELECT component_id, count(*) FILTER (kind = 'symbol') AS n_symbol, count(*) FILTER (kind = 'test') AS n_test, count(*) FILTER (kind = 'bench') AS n_bench, count(*) FILTER (kind = 'source_unit') AS n_source_unit, count(*) FILTER (kind = 'doc') AS n_doc, coalesce(string_agg(CASE WHEN kind = 'source_unit' THEN path END, ',' ORDER BY path), '') AS sources, coalesce(string_agg(CASE WHEN kind = 'doc' THEN path END, ',' ORDER BY path), '') AS docs FROM ents WHERE component_id IS NOT NULL GROUP BY component_id")
def component_profile(m: Model, *_) -> DataFrame:
    """counts of a component's entities and all paths of its sources and documents."""
    return incremental.component_profile(m.entities).withColumns({c: F.array_join(c, ",") for c in ("sources", "docs")})


@query("SELECT count(*) FILTER (kind = 'component') AS n_component, count(*) FILTER (kind = 'source_unit') AS n_source_unit, count(*) FILTER (kind = 'symbol') AS n_symbol, count(*) FILTER (kind = 'test') AS n_test, count(*) FILTER (kind = 'bench') AS n_bench, count(*) FILTER (kind = 'doc') AS n_doc, count(*) FILTER (kind = 'task') AS n_task, count(*) FILTER (kind = 'feature') AS n_feature, (SELECT string_agg(name, ',' ORDER BY name) FROM (SELECT name FROM ents WHERE kind = 'component' ORDER BY name LIMIT 11)) AS components, (SELECT string_agg(path, ',' ORDER BY path) FROM (SELECT path FROM ents WHERE kind = 'doc' ORDER BY path LIMIT 11)) AS docs FROM ents")
def repo_profile(m: Model, *_) -> DataFrame:
    return incremental.repo_profile(m.entities).withColumns({c: F.array_join(c, ",") for c in ("components", "docs")})


@query("SELECT component_id, (SELECT string_agg('- ' || x, chr(10)) FROM (SELECT unnest(s[1:3]) AS x)) || CASE WHEN len(s) > 3 THEN chr(10) || '- …and ' || (len(s) - 3) || ' more' ELSE '' END AS listed FROM (SELECT component_id, list_sort(list(path) FILTER (kind = 'source_unit')) AS s FROM ents WHERE component_id IS NOT NULL GROUP BY component_id)")
def listed_sources(m: Model, *_) -> DataFrame:
    return incremental.component_profile(m.entities, 3).select("component_id", first_of(F.col("sources"), 3, F.col("n_source_unit")).alias("listed"))


@query("""WITH w AS (SELECT p_partkey AS n, p_brand AS component_id, CASE WHEN p_partkey % 7 = 0 THEN 'doc' ELSE 'symbol' END AS kind FROM part),
a AS (SELECT *, CASE WHEN kind = 'symbol' AND lag(kind) OVER (PARTITION BY component_id ORDER BY n) = 'symbol' THEN 0 ELSE 1 END AS new FROM w),
b AS (SELECT *, sum(new) OVER (PARTITION BY component_id ORDER BY n) AS run FROM a),
c AS (SELECT *, CASE WHEN (row_number() OVER (PARTITION BY component_id, run ORDER BY n) - 1) % 4 = 0 THEN 1 ELSE 0 END AS first FROM b)
SELECT n, component_id, CAST(sum(first) OVER (PARTITION BY component_id ORDER BY n) AS BIGINT) AS batch FROM c""")
def work_batches(m: Model, spark: SparkSession, sf_dir: str) -> DataFrame:
    work = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("n"), F.col("p_brand").alias("component_id"), F.when(F.col("p_partkey") % 7 == 0, "doc").otherwise("symbol").alias("kind"))
    return incremental.work_batches(work, F.col("n"), 4).select("n", "component_id", *long("batch"))


@query("SELECT id, CASE WHEN length(name) > 12 THEN substr(name, 1, 9) || '...' ELSE name END AS shown FROM ents")
def truncated_names(m: Model, *_) -> DataFrame:
    return m.entities.select("id", truncated(F.col("name"), 12).alias("shown"))


@query("SELECT id, replace(replace(replace(replace(replace(name, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS shown FROM ents")
def escaped_names(m: Model, *_) -> DataFrame:
    return m.entities.select("id", xml_escaped(F.col("name")).alias("shown"))


PATHS = [".github/x/a.rs", "src/lib.rs", "Dockerfile", "a/Makefile", "a/Cargo.toml", "b.lock", "m/1.sql", "t/x.hbs", "s.tla", "README.md", "none", "infra/main.tf", "x/playbooks/a.yml", "y/migrations/1.sql", ".github/workflows/ci.yml", "templates/a/b.html", "p/q.astro", "AGENTS.md", ".env"]
KINDS_OF_PATHS = dict(zip(PATHS, [("workflow", None), ("source", None), ("config", "containerized"), ("build", None), ("build", None), ("build", None), ("migration", None), ("template", "template"), ("data", "spec"), ("doc", None), ("other", None), ("other", "infra_root"), ("config", "command"), ("migration", "migration"), ("workflow", "workflow"), ("template", "template"), ("template", "template"), ("doc", "agent_config"), ("other", None)], strict=True))


@query("SELECT p_partkey, path, file_kind, entity_kind FROM part JOIN (VALUES " + ", ".join(f"({k}, '{p}', '{a}', {'NULL' if b is None else repr(b)})" for k, (p, (a, b)) in enumerate(KINDS_OF_PATHS.items())) + f") v(k, path, file_kind, entity_kind) ON p_partkey % {len(PATHS)} = k")
def path_rules(m: Model, spark: SparkSession, sf_dir: str) -> DataFrame:
    """File kinds and declarative entities of a path for each part."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.get(F.array(*map(F.lit, PATHS)), (F.col("p_partkey") % len(PATHS)).cast("int")).alias("path"))
    return p.select("p_partkey", "path", file_kind(F.col("path")).alias("file_kind"), scanned_kind(F.col("path")).alias("entity_kind"))


@query("SELECT p_partkey % 10 AS vector_key, count(DISTINCT p_partkey) AS owners FROM part WHERE p_partkey IN (SELECT vec_id FROM embeddings) GROUP BY 1 HAVING count(DISTINCT p_partkey) > 1")
def vector_collisions(m: Model, *_) -> DataFrame:
    return store.vector_collisions(m.embeddings.where(F.col("entity_id").isNotNull()).join(m.entities.select(F.col("id").alias("entity_id")), "entity_id", "left_semi"), F.substring_index("entity_id", "/", -1).cast("long") % 10)


@query("""SELECT entity_id, CASE WHEN s = '' THEN '' WHEN regexp_matches(s, '[.!?]$') THEN s ELSE s || '.' END AS sentence FROM (SELECT entity_id, array_to_string(string_split(regexp_extract(trim(regexp_replace(short_summary, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')), '^([^.!?]*[.!?]?)', 1), ' ')[1:24], ' ') AS s FROM summ)""")
def one_sentence_summaries(m: Model, *_) -> DataFrame:
    return m.summaries.select("entity_id", one_sentence(F.col("short_summary")).alias("sentence"))


@query("SELECT id, kind, CAST(CASE kind WHEN 'symbol' THEN 1 WHEN 'doc' THEN 2 WHEN 'component' THEN 3 ELSE 4 END AS BIGINT) AS work_order FROM ents WHERE (kind = 'symbol' AND exported) OR kind IN ('doc', 'component', 'repo')")
def summary_candidates(m: Model, *_) -> DataFrame:
    return lookup.summary_candidates(m.entities).select("id", "kind", *long("work_order"))


@query("SELECT path, hash, 'component::docs::' || source AS component_id FROM (SELECT 'docs/' || doc_id AS path, sha256(text) AS hash, source FROM documents) WHERE path = 'docs/7'")
def file_lookup(m: Model, *_) -> DataFrame:
    return lookup.file_at(m.files, "docs/7").select("path", "hash", "component_id")


@query("SELECT entity_id, 'given' AS model, CAST(len(vector) AS BIGINT) AS dimensions FROM embs WHERE entity_id = 'symbol::part/7' OR CAST(split_part(entity_id, '/', 2) AS BIGINT) = 9")
def vector_meta(m: Model, *_) -> DataFrame:
    """What is known of a vector, by entity and by key."""
    key = F.substring_index("entity_id", "/", -1).cast("long")
    return lookup.vector_meta(m.embeddings, "symbol::part/7").unionByName(lookup.vector_meta(m.embeddings, key=key, value=9)).select("entity_id", "model", *long("dimensions"))


@query("SELECT src_id, rel, count(*) AS n, array_to_string(list(name ORDER BY name)[1:5], ',') AS names FROM (SELECT DISTINCT src_id, rel, name FROM edg JOIN ents ON id = dst_id WHERE rel IN ('owns_task', 'documented_by', 'defines')) GROUP BY src_id, rel")
def related_names(m: Model, *_) -> DataFrame:
    """The first names of the entities that edges lead to, with how many there are; the repository is a hub of documents."""
    parts = [incremental.related_names(m.entities, m.edges, r, most=5).select("src_id", F.lit(r).alias("rel"), *long("n"), F.array_join("names", ",").alias("names")) for r in ("owns_task", "documented_by", "defines")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT id, 'vscode://file//work/tree' || CASE WHEN path = '.' THEN '' ELSE '/' || path END || ':1:1#' || id AS link FROM ents")
def editor_links(m: Model, *_) -> DataFrame:
    return lookup.editor_links(m.entities, "/work/tree", "vscode://file/{abs_path}:{line}:{column}#{entity_id}")


@query("SELECT 'named' AS start, 'symbol::part/1' AS id, CAST(0 AS BIGINT) AS ord UNION ALL SELECT 'repository', id, 0 FROM ents WHERE id = 'repo::.' UNION ALL SELECT 'none', id, 0 FROM ents WHERE kind <> 'repo'")
def drawing_seeds(m: Model, *_) -> DataFrame:
    """H4: from a given entity, from the repository, and, in a graph without one, from all entities."""
    cases = {"named": graph.drawing_seeds(m.entities, "symbol::part/1"), "repository": graph.drawing_seeds(m.entities), "none": graph.drawing_seeds(m.entities.where("kind <> 'repo'"))}
    rows = [df.select(F.lit(name).alias("start"), "id", *long("ord")) for name, df in cases.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


#: Bytes that begin a character are those that don't go on with one; a character over the bound goes as a whole.
@query("""WITH t AS (SELECT doc_id, array_to_string(string_split(regexp_replace(text, '\\n$', ''), chr(10))[1:120], chr(10)) AS cut, array_to_string(string_split(regexp_replace(text, '\\n$', ''), chr(10))[2:4], chr(10)) AS snippet FROM (SELECT doc_id, replace(text, '. ', '.' || chr(10)) AS text FROM documents)),
b AS (SELECT *, length(regexp_replace(substr(hex(encode(cut)), 1, 12000), '[89AB].|(..)', '\\1', 'g')) // 2 AS begun FROM t)
SELECT doc_id, CASE WHEN strlen(substr(cut, 1, begun)) <= 6000 THEN substr(cut, 1, begun) ELSE substr(cut, 1, begun - 1) END AS excerpt, snippet FROM b""")
def excerpts(m: Model, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounded excerpts and snippets, of documents with a line for each sentence."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit(". "), F.lit(".\n")).alias("text"))
    return docs.select("doc_id", summarise.excerpt(F.col("text")).alias("excerpt"), F.coalesce(summarise.snippet(F.col("text"), F.lit(2), F.lit(4)), F.lit("")).alias("snippet"))


@query("""WITH RECURSIVE w AS (SELECT p_brand AS brand, p_partkey AS n, CASE WHEN p_partkey % 7 = 0 THEN 'doc' ELSE 'symbol' END AS kind, p_size AS t, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r FROM part),
g AS (SELECT brand, n, kind, r, 10 + t + 5 AS used, 1 AS size, 1 AS batch FROM w WHERE r = 1 UNION ALL
 SELECT w.brand, w.n, w.kind, w.r, CASE WHEN apart THEN 10 ELSE used END + w.t + 5, CASE WHEN apart THEN 1 ELSE size + 1 END, CASE WHEN apart THEN batch + 1 ELSE batch END
 FROM (SELECT w.*, g.used, g.size, g.batch, w.kind <> 'symbol' OR g.kind <> 'symbol' OR g.size >= 4 OR g.used + w.t + 5 > 100 AS apart FROM g JOIN w ON w.brand = g.brand AND w.r = g.r + 1) w)
SELECT brand, n, CAST(batch AS BIGINT) AS batch FROM g""")
def budget_batches(m: Model, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of at most four symbols whose tokens, with what is fixed and a reply for each, fit a window."""

    def run(frames):
        import pandas as pd

        rows = (r for f in frames for r in f.itertuples(index=False))
        for brand, own in itertools.groupby(rows, key=lambda r: r.brand):
            for batch, some in enumerate(summarise.in_budget(own, 4, lambda r: r.kind == "symbol", lambda r: r.t, 10, 5, 100), 1):
                yield pd.DataFrame({"brand": [brand] * len(some), "n": [r.n for r in some], "batch": [batch] * len(some)})

    work = table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("n"), F.when(F.col("p_partkey") % 7 == 0, "doc").otherwise("symbol").alias("kind"), F.col("p_size").alias("t"))
    return work.repartition("brand").sortWithinPartitions("brand", "n").mapInPandas(run, "brand string, n long, batch long")


#: Labelled queries over the model: text, tokens, and the labels' rule by p_size.
LABELLED = (("blue bolt", "first"), ("red widget", "first"), ("hot gear", "second"))
SEARCHED = " UNION ALL ".join(f"SELECT '{t}' AS query, '{b}' AS bucket, '{t.split()[0]}' AS t1, '{t.split()[1]}' AS t2" for t, b in LABELLED)
SHARE = "CAST((CASE WHEN contains(lower({t}), t1) THEN 1 ELSE 0 END) + (CASE WHEN contains(lower({t}), t2) THEN 1 ELSE 0 END) AS DOUBLE) / 2.0"
FOUND_SQL = f"""q AS ({SEARCHED}),
kw AS (SELECT query, entity_id AS id, {SHARE.format(t=TEXT)} AS keyword FROM summ, q WHERE contains(lower({TEXT}), t1) OR contains(lower({TEXT}), t2)),
nm AS (SELECT query, id, {SHARE.format(t="name")} AS name_match, {SHARE.format(t="coalesce(path, '')")} AS path_match FROM ents, q WHERE kind IN ('component', 'source_unit', 'symbol') AND (contains(lower(name), t1) OR contains(lower(name), t2) OR contains(lower(coalesce(path, '')), t1) OR contains(lower(coalesce(path, '')), t2))),
ranked AS (SELECT query, e.id, row_number() OVER (PARTITION BY query ORDER BY round(0.25 * coalesce(keyword, 0) + 0.20 * coalesce(name_match, 0) + 0.10 * (CASE WHEN kind IN ('component', 'source_unit', 'symbol') THEN 1 ELSE 0 END) + 0.10 * (CASE WHEN exported THEN 1 ELSE 0 END) + 0.10 * coalesce(path_match, 0), 9) DESC, e.id) AS rank
 FROM kw FULL JOIN nm USING (query, id) JOIN ents e USING (id)),
r AS (SELECT * FROM ranked WHERE rank <= 10),
l AS (SELECT query, bucket, 'symbol::part/' || p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN 2 ELSE 1 END AS gain FROM part JOIN q ON contains(p_name, t1) AND contains(p_name, t2) AND p_size % 3 <> 2)"""


@query(f"""WITH {SQL}, {FOUND_SQL},
x AS (SELECT r.query, rank, coalesce(gain, 0) AS gain FROM r LEFT JOIN l USING (query, id)),
s AS (SELECT query, count(*) FILTER (gain = 2 AND rank <= 5) AS found, min(rank) FILTER (gain = 2) AS first, sum((pow(2, gain) - 1) / log2(rank + 1)) AS dcg, avg(CASE WHEN gain = 0 THEN 1.0 ELSE 0.0 END) FILTER (rank > 5) AS noise FROM x GROUP BY query),
w AS (SELECT q.query, q.bucket, count(*) FILTER (gain = 2) AS rel, count(*) FILTER (gain = 1) AS acc FROM q LEFT JOIN l USING (query) GROUP BY q.query, q.bucket),
i AS (SELECT query, sum((CASE WHEN p <= rel THEN 3.0 WHEN p <= rel + acc THEN 1.0 ELSE 0 END) / log2(p + 1)) AS ideal FROM (SELECT *, unnest(range(1, 11)) AS p FROM w) GROUP BY query),
m AS (SELECT query, bucket, coalesce(found / nullif(rel, 0), 0.0) AS recall_at_5, coalesce(1.0 / first, 0.0) AS mrr_at_10, coalesce(dcg / nullif(ideal, 0), 0.0) AS ndcg_at_10, coalesce(noise, 0.0) AS noise_tail_rate FROM w JOIN i USING (query) LEFT JOIN s USING (query))
SELECT query, bucket, {ROUNDED} FROM m""")
def evaluation_of_search(m: Model, spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search run over labelled queries, without a cutoff, and measured."""
    parts = table(spark, sf_dir, "part")
    # labels are a benchmark file's: as many as the parts that hold both words
    names = [r for r in parts.where("p_size % 3 <> 2").where(F.col("p_name").isin([t for t, _ in LABELLED])).select("p_partkey", "p_name", "p_size").collect()]
    of = lambda text, rest: tuple(f"symbol::part/{r['p_partkey']}" for r in names if r["p_name"] == text and r["p_size"] % 3 == rest)
    queries = [evaluate.LabelledQuery(t, b, of(t, 0), of(t, 1)) for t, b in LABELLED]
    found = evaluate.evaluate(stored(m), queries).by_query
    texts = F.array(*(F.lit(t) for t, _ in LABELLED))
    return found.select(F.get(texts, F.col("query")).alias("query"), "bucket", *(F.round(c, 6).alias(c) for c in METRICS))


@query(f"""WITH {SQL}, {SCORED}, ranked AS (SELECT row_number() OVER (ORDER BY round(score, 9) DESC, id) AS rank, score FROM scored),
gap AS (SELECT min(rank) AS g FROM (SELECT rank, score, lag(score) OVER (ORDER BY rank) AS before FROM ranked) WHERE rank > 3 AND score / before < 0.8),
n AS (SELECT count(*) AS found, (SELECT g FROM gap) AS g FROM ranked), c AS (SELECT * FROM (VALUES (5, 8), (15, 8), (2, 8), (30, 40)) v(lim, most)),
k AS (SELECT lim, least(found, lim) AS whole, least(least(coalesce(g - 1, least(most, lim)), least(most, lim)), lim) AS shown FROM c, n)
SELECT CAST(lim AS BIGINT) AS "limit", CAST(shown AS BIGINT) AS shown, CASE WHEN shown < whole THEN CAST(whole AS BIGINT) END AS total FROM k""")
def plan_totals(m: Model, spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a plan shows after the cutoff, and the total before it where the cutoff kept fewer than the limit lets through."""
    from wayfinder.config import Search

    m = stored(m)
    plans = [(n, search.search(m, "blue bolt", "general", limit=n, config=Search(cutoff="relative_gap", max_results=most))) for n, most in ((5, 8), (15, 8), (2, 8), (30, 40))]
    return spark.createDataFrame([(n, p.entries.count(), p.total_before_cutoff) for n, p in plans], "limit long, shown long, total long")


@query("SELECT src_id, rel, dst_id, CASE WHEN rel = 'contains' THEN 'a/b.rs' WHEN dst_id = 'added' THEN 'new' END AS provenance_path FROM (SELECT src_id, rel, dst_id FROM edg UNION ALL SELECT 'repo::.', 'builds', 'added') WHERE rel <> 'owns_task'")
def upsert_and_delete_edges(m: Model, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges replaced and added by key, then those gone whose provenance is a deleted file."""
    given = m.edges.withColumn("provenance_path", F.when(F.col("rel") == "owns_task", "gone.rs"))
    added = m.edges.where("rel = 'contains' and src_id = 'repo::.'").limit(1).withColumns({"rel": F.lit("builds"), "dst_id": F.lit("added"), "provenance_path": F.lit("new")})
    new = store.upsert_table(m.with_tables(edges=given), "edges", m.edges.where("rel = 'contains'").withColumn("provenance_path", F.lit("a/b.rs")).unionByName(added))
    return store.cascade_files(new, spark.createDataFrame([("gone.rs",)], "path string")).edges.select("src_id", "rel", "dst_id", "provenance_path")


@query("SELECT path, CASE WHEN path LIKE '%5' THEN 'new' ELSE hash END AS hash FROM (SELECT 'docs/' || doc_id AS path, sha256(text) AS hash, source FROM documents) WHERE source <> (SELECT min(source) FROM documents)")
def upsert_and_delete_files(m: Model, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files replaced by path, then those of a component deleted."""
    new = store.upsert_table(m, "files", m.files.where("path like '%5'").withColumn("hash", F.lit("new"))).files
    first = m.files.agg(F.min("component_id")).head()[0]
    return store.delete_where(new, F.col("component_id") == first).select("path", "hash")


@query("SELECT 'summaries' AS \"table\", entity_id AS k, CASE WHEN entity_id LIKE '%7' THEN 'new' ELSE short_summary END AS v FROM summ UNION ALL SELECT 'embeddings', entity_id, CASE WHEN entity_id LIKE '%7' THEN 'new' ELSE 'given' END FROM embs")
def upsert_summaries_and_vectors(m: Model, *_) -> DataFrame:
    """B4 B6."""
    s = store.upsert_table(m, "summaries", m.summaries.where("entity_id like '%7'").withColumn("short_summary", F.lit("new"))).summaries
    e = store.upsert_table(m, "embeddings", m.embeddings.where("entity_id like '%7'").withColumn("model", F.lit("new"))).embeddings
    return s.select(F.lit("summaries").alias("table"), F.col("entity_id").alias("k"), F.col("short_summary").alias("v")).unionByName(e.select(F.lit("embeddings").alias("table"), F.col("entity_id").alias("k"), F.col("model").alias("v")))


@query(f"WITH {SQL}, {ROUTE_SQL} SELECT task_name, entity_id, CASE WHEN task_name = 'debug' THEN 1 ELSE priority END AS priority FROM routes WHERE task_name <> 'build'")
def upsert_and_delete_routes(m: Model, *_) -> DataFrame:
    """Routes replaced by key, others deleted by key."""
    new = store.upsert_table(m, "task_routes", m.task_routes.where("task_name = 'debug'").withColumn("priority", F.lit(1))).task_routes
    return store.delete_keys(new, m.task_routes.where("task_name = 'build'"), ["task_name", "entity_id"]).select("task_name", "entity_id", *long("priority"))


@query("SELECT 'entity' AS part, name AS what FROM ents WHERE id = 'symbol::part/7' UNION ALL SELECT 'summary', short_summary FROM summ WHERE entity_id = 'symbol::part/7' UNION ALL SELECT 'routes', unnest(['build', 'implement']) FROM ents WHERE id = 'symbol::part/7' UNION ALL SELECT 'in', src_id FROM edg WHERE dst_id = 'symbol::part/7' UNION ALL SELECT 'out', dst_id FROM edg WHERE src_id = 'symbol::part/7'")
def entity_view(m: Model, *_) -> DataFrame:
    """H3: all five parts."""
    view, shown = lookup.entity_view(m, "symbol::part/7"), {"entity": "name", "summary": "short_summary", "routes": "task_name", "out": "dst_id", "in": "src_id"}
    return functools.reduce(DataFrame.unionByName, [view[p].select(F.lit(p).alias("part"), F.col(c).alias("what")) for p, c in shown.items()])
