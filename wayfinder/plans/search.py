"""Hybrid search: classify, retrieve by routes, text, names, paths and vectors, score, expand, rerank, cut off, plan."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfinder.config import Search, Weights
from wayfinder.functions.text import cosine_distance, query_tokens
from wayfinder.operators.graph import neighbours
from wayfinder.operators.lookup import summary_text
from wayfinder.operators.postings import TextIndex
from wayfinder.operators.vectors import VectorIndex
from wayfinder.schema import Model
from wayfinder.shared import materialize

# Words that tell a query's category (later categories win ties), routes and kinds by category.
LEXICON = {
    "debug": "debug fix bug error panic crash trace".split(),
    "build": "build implement add create write".split(),
    "test": "test tests bench verify assert".split(),
    "deploy": "deploy release publish ship prod".split(),
    "configure": "configure setup settings env config".split(),
    "understand": "understand how what architecture design overview".split(),
}
ROUTES = {"understand": ["understand", "architecture"], "debug": ["debug", "fix"], "build": ["build", "implement"], "test": ["test", "bench"], "deploy": ["deploy", "release"], "configure": ["configure", "setup"], "general": []}
KINDS = {
    "understand": ["component", "source_unit", "doc", "symbol", "content_page", "agent_config"],
    "debug": ["source_unit", "symbol", "test", "spec"],
    "build": ["component", "source_unit", "symbol", "feature", "template", "migration"],
    "test": ["test", "bench", "source_unit", "spec"],
    "deploy": ["containerized", "infra_root", "task", "command", "site"],
    "configure": ["component", "feature", "infra_root", "agent_config", "workflow"],
    "general": ["component", "source_unit", "symbol"],
}
SIGNALS = ("route_priority", "keyword", "name_match", "path_match", "vector")
PER_SEED = 5
CONTEXT_SHARE = 0.5
# Reasons in the order in which they are listed.
REASONS = (("route_priority", "task route"), ("keyword", "keyword match"), ("name_match", "name match"), ("path_match", "path match"), ("vector", "semantic similarity"))


def classify(query: str) -> str:
    """The category with most words of the query; of equals the later one; general for none."""
    words = query_tokens(query)
    counts = [(sum(w in lexicon for w in words), k, name) for k, (name, lexicon) in enumerate(LEXICON.items())]
    most = max(counts)
    return most[2] if most[0] else "general"


def classify_column(query: Column) -> Column:
    """classify() for a column of queries."""
    words = F.filter(F.split(F.lower(F.trim(query)), r"\s+"), lambda w: w != "")

    def counted(k: int, name: str) -> Column:
        return F.struct(F.size(F.filter(words, lambda w: w.isin(LEXICON[name]))).alias("n"), F.lit(k).alias("k"), F.lit(name).alias("name"))

    best = F.array_max(F.array(*(counted(k, name) for k, name in enumerate(LEXICON))))
    return F.when(best["n"] > 0, best["name"]).otherwise("general")


def retrieve_routes(routes: DataFrame, category: str) -> DataFrame:
    names = ROUTES[category]
    return routes.where(F.col("task_name").isin(names) & (F.col("priority") > 0)).groupBy("entity_id").agg(F.max("priority").alias("route_priority"))


def tokens_in(text: Column, tokens: list[str]) -> Column:
    """Those of the tokens that stand in the text, in any case; the text is lower-cased once for all of them."""
    low = F.lower(text)
    return F.array_compact(F.array(*(F.when(low.contains(t), F.lit(t)) for t in tokens))) if tokens else F.array().cast("array<string>")


def token_matches(m: Model, tokens: list[str], index: TextIndex | None = None) -> DataFrame:
    """id, field (name, path, summary), token: which tokens stand where. One pass over names and paths and one over summaries
    for all queries; with an index, postings are read instead."""
    if index is not None:
        return index.find(tokens)
    named = lambda field: F.transform(tokens_in(F.coalesce(F.col(field), F.lit("")), tokens), lambda t: F.struct(F.lit(field).alias("field"), t.alias("token")))
    names = m.entities.select("id", F.inline(F.concat(named("name"), named("path"))))
    return names.unionByName(m.summaries.select(F.col("entity_id").alias("id"), F.lit("summary").alias("field"), F.explode(tokens_in(summary_text(), tokens)).alias("token")))


def retrieve_vectors(embeddings: DataFrame, query_vector: list[float], k: int, index: VectorIndex | None = None) -> DataFrame:
    """The k nearest by cosine distance; score 1 / (1 + distance). Exact: each task keeps its own k, and only those are merged;
    with an index, bounds rule most vectors out."""
    if index is not None:
        near = index.find(query_vector, k)[0]
    else:
        q = F.array(*(F.lit(float(x)) for x in query_vector))
        near = embeddings.select("entity_id", cosine_distance(F.col("vector"), q).alias("distance")).orderBy("distance", "entity_id").limit(k)
    return near.select("entity_id", (1 / (1 + F.col("distance"))).alias("vector"))


def scored(candidates: DataFrame, w: Weights) -> DataFrame:
    """candidates with kind, exported, signals and preferred (the kinds that their query prefers): breakdown and final_score."""
    s = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    parts = {
        "task_route": s("route_priority") / 100,
        "keyword": s("keyword"),
        "name_match": s("name_match"),
        "vector": s("vector"),
        "kind_preference": F.array_contains("preferred", F.col("kind")).cast("double"),
        "exported": F.col("exported").cast("double"),
        "path_match": s("path_match"),
    }
    total = sum((F.lit(getattr(w, n)) * c for n, c in parts.items()), F.lit(0.0))
    return candidates.withColumns({"breakdown": F.struct(*(c.alias(n) for n, c in parts.items())), "final_score": F.when(F.col("is_context"), CONTEXT_SHARE * total).otherwise(total)})


def expand(candidates: DataFrame, entities: DataFrame, edges: DataFrame, seeds: int, per_seed: int = PER_SEED) -> DataFrame:
    """query, id of neighbours to add to each query's candidates (query, id, final_score, is_context): the best seeds in turn each
    add up to per_seed neighbours (out-edges, then in-edges) that exist and are neither candidates nor added before. The turns
    are one fold over at most ``seeds`` arrays for each query."""
    turn = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("final_score"), "id"))
    top = candidates.where("not is_context").select("query", "id", turn.alias("turn")).where(F.col("turn") <= seeds)
    # as many rows as queries times seeds
    near = neighbours(edges).join(F.broadcast(top), "id").join(entities.select(F.col("id").alias("other")), "other", "left_semi")
    near = near.join(candidates.select("query", F.col("id").alias("other")), ["query", "other"], "left_anti")
    once = near.groupBy("query", "turn", "other").agg(F.min(F.struct("way", "rel_at")).alias("at"))
    # a seed adds per_seed at most, and seeds before it can have taken no more than per_seed each: further neighbours can't matter
    by_turn = Window.partitionBy("query", "turn").orderBy("at", "other")
    some = once.withColumn("n", F.row_number().over(by_turn)).where(F.col("n") <= seeds * per_seed)
    lists = some.groupBy("query", "turn").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "other"))), lambda x: x["other"]).alias("others"))
    turns = lists.groupBy("query").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "others"))), lambda x: x["others"]).alias("turns"))
    added = F.aggregate("turns", F.array().cast("array<string>"), lambda acc, new: F.concat(acc, F.slice(F.array_except(new, acc), 1, per_seed)))
    return turns.select("query", F.explode(added).alias("id"))


def cutoff(ranked: DataFrame, mode: str, threshold: float, least: int, most: int) -> DataFrame:
    """ranked (rank from 1 without gaps, final_score) up to the first gap: the first rank over least whose score falls below
    threshold times the one before (a non-positive one always counts as a gap); at most ``most`` rows, unless there are no more
    than least. A rank meets the one before by an equi-join, so that no task holds them all."""
    if mode != "relative_gap":
        return ranked
    before = ranked.select((F.col("rank") + 1).alias("rank"), F.col("final_score").alias("before"))
    ratio = F.when(F.col("before") > 0, F.col("final_score") / F.col("before")).otherwise(0.0)
    gap = F.when((F.col("rank") > least) & (ratio < threshold), F.col("rank"))
    first, rows = ranked.join(before, "rank", "left").agg(F.min(gap), F.max("rank")).head()
    rows = rows or 0
    return ranked.where(F.col("rank") <= (rows if rows <= least else min(first - 1 if first else most, most)))


def rerank(ranked: DataFrame, summaries: DataFrame, scorer: Callable[[list[str]], list[tuple[int, float]]], top_k: int) -> DataFrame:
    """Second-stage scores for the first top_k rows, which they reorder; the rest stay behind. A scorer that fails changes nothing."""
    head = ranked.where(F.col("rank") <= top_k).join(summaries.select(F.col("entity_id").alias("id"), "short_summary", "keywords"), "id", "left").orderBy("rank")
    rows = head.select("id", "name", "path", "short_summary", "keywords").collect()  # at most top_k
    lines = lambda r: [f"Name: {r['name']}", *([f"Path: {r['path']}"] if r["path"] else []), *([f"Summary: {r['short_summary']}"] if r["short_summary"] else []), *([f"Keywords: {', '.join(r['keywords'])}"] if r["keywords"] else [])]
    try:
        found = scorer(["\n".join(lines(r)) for r in rows])
    except Exception:
        return ranked
    best: dict[int, float] = {}
    for k, s in found:
        if 0 <= k < len(rows):
            best.setdefault(k, float(s))
    if not best:
        return ranked
    new = ranked.sparkSession.createDataFrame([(rows[k]["id"], s) for k, s in best.items()], "id string, second double")
    joined = ranked.join(F.broadcast(new), "id", "left")
    order = Window.orderBy(F.col("second").isNull(), F.desc("second"), "rank")
    return joined.withColumn("rank", F.row_number().over(order)).withColumn("final_score", F.coalesce("second", "final_score")).drop("second")


def reasons() -> Column:
    hits = [F.when(F.coalesce(F.col(c), F.lit(0.0)) > 0, F.lit(text)) for c, text in REASONS] + [F.when(F.col("is_context"), F.lit("graph neighbor"))]
    return F.filter(F.array(*hits), lambda x: x.isNotNull())


@dataclass(frozen=True)
class ReadingPlan:
    query: str
    category: str
    entries: DataFrame
    total_before_cutoff: int | None = None

    def to_json(self) -> str:
        rows = [json.loads(r) for r in self.entries.orderBy("rank").toJSON().collect()]  # at most the limit
        out = {"query": self.query, "category": self.category, "entries": rows}
        return json.dumps(out | ({} if self.total_before_cutoff is None else {"total_before_cutoff": self.total_before_cutoff}), indent=2)

    def to_text(self, verbose: bool = False) -> str:
        rows = self.entries.orderBy("rank").collect()
        more = f" (cutoff from {self.total_before_cutoff})" if self.total_before_cutoff else ""
        lines = [f"Query: {self.query}", f"Category: {self.category}", f"Results: {len(rows)}{more}"]
        for r in rows:
            lines.append(f"{r['rank']}. {r['name']} ({r['kind']}) {r['final_score']:.3f}" + (" [context]" if r["is_context"] else ""))
            lines += [f"   {r['path']}"] if r["path"] else []
            lines += [f"   {', '.join(r['reasons'])}"] if r["reasons"] else []
            lines += ["   " + " ".join(f"{k}={v:.2f}" for k, v in r["breakdown"].asDict().items())] if verbose else []
        return "\n".join(lines)


@dataclass(frozen=True)
class Asked:
    """A query: its text, its category (the classifier's by default) and its vector."""

    text: str
    category: str | None = None
    vector: list[float] | None = None

    def of(self) -> str:
        return self.category or classify(self.text)


def candidates_for(m: Model, asked: list[Asked], k: int, index: TextIndex | None = None, vectors: VectorIndex | None = None) -> DataFrame:
    """query (its place in the list), id, kind, exported, preferred, signals of the entities that some signal finds: all queries in
    one plan, one aggregation of all signals and one join. Texts, names and paths don't leave the scans that match them."""
    spark = m.entities.sparkSession
    words = [(i, t, query_tokens(q.text).count(t), len(query_tokens(q.text))) for i, q in enumerate(asked) for t in dict.fromkeys(query_tokens(q.text))]
    preferred = [(i, KINDS[q.of()], max(1, len(query_tokens(q.text)))) for i, q in enumerate(asked)]
    tokens = spark.createDataFrame([w[:3] for w in words], "query int, token string, times int")
    queries = spark.createDataFrame(preferred, "query int, preferred array<string>, n_tokens int")
    found = token_matches(m, list(dict.fromkeys(w[1] for w in words)), index).join(F.broadcast(tokens), "token")
    parts = [found.select("query", "id", "field", F.col("times").cast("double").alias("value"))]
    routes = [(i, name) for i, q in enumerate(asked) for name in ROUTES[q.of()]]
    if routes:
        names = spark.createDataFrame(routes, "query int, task_name string")
        met = m.task_routes.where(F.col("task_name").isin(sorted({r[1] for r in routes})) & (F.col("priority") > 0)).join(F.broadcast(names), "task_name")
        parts.append(met.groupBy("query", F.col("entity_id").alias("id")).agg(F.lit("route").alias("field"), F.max("priority").cast("double").alias("value")))
    parts += [retrieve_vectors(m.embeddings, q.vector, k, vectors).select(F.lit(i).alias("query"), F.col("entity_id").alias("id"), F.lit("vector").alias("field"), F.col("vector").alias("value")) for i, q in enumerate(asked) if q.vector is not None]
    of = lambda field: F.when(F.col("field") == field, F.col("value"))
    merged = reduce(DataFrame.unionByName, parts).groupBy("query", "id").agg(F.max(of("route")).alias("route_priority"), F.max(of("vector")).alias("vector"), *(F.sum(of(x)).alias(x) for x in ("summary", "name", "path")))
    met = merged.join(m.entities.select("id", "kind", "exported"), "id").join(F.broadcast(queries), "query")
    # names and paths count for the kinds that a query prefers
    named = F.array_contains("preferred", F.col("kind")) & F.coalesce("name", "path").isNotNull()
    share = lambda c: F.coalesce(F.col(c), F.lit(0.0)) / F.col("n_tokens")
    signals = {"keyword": F.when(F.col("summary").isNotNull(), share("summary")), "name_match": F.when(named, share("name")), "path_match": F.when(named, share("path"))}
    wide = met.withColumns(signals).where(F.coalesce("route_priority", "keyword", "name_match", "vector").isNotNull())
    return wide.select("query", "id", "kind", "exported", "preferred", *SIGNALS, F.lit(False).alias("is_context"))


def ranked_entries(m: Model, asked: list[Asked], limit: int | None = None, search: Search | None = None, expansion: bool = True, keep: int | None = None, index: TextIndex | None = None, vectors: VectorIndex | None = None) -> DataFrame:
    """Candidates and their neighbours in each query's order, the first ``keep`` of them (limit by default): query, rank, entity
    columns, signals, score, breakdown, reasons. Candidates are written once, as ids and signals; entities are looked up for
    what is kept."""
    s = search or Search()
    limit = limit or s.default_limit
    first = materialize(scored(candidates_for(m, asked, max(s.default_limit, 15) * 3, index, vectors), s.rerank_weights), "candidates")
    if expansion:
        more = expand(first, m.entities, m.edges, limit)
        kinds = m.entities.sparkSession.createDataFrame([(i, KINDS[q.of()]) for i, q in enumerate(asked)], "query int, preferred array<string>")
        # at most limit times PER_SEED rows for each query
        context = m.entities.select("id", "kind", "exported").join(F.broadcast(more.join(F.broadcast(kinds), "query")), "id").withColumn("is_context", F.lit(True))
        first = first.unionByName(scored(context.withColumns({c: F.lit(None).cast("double") for c in SIGNALS}), s.rerank_weights))
    order = Window.partitionBy("query").orderBy(F.desc("final_score"), "id")
    top = first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= (keep or limit)).drop("preferred", "kind", "exported")
    return m.entities.join(F.broadcast(top), "id").withColumn("reasons", reasons())


def search(m: Model, query: str, category: str | None = None, query_vector: list[float] | None = None, limit: int | None = None, config: Search | None = None, show_all: bool = False, scorer=None, top_k: int = 25, index: TextIndex | None = None, vectors: VectorIndex | None = None) -> ReadingPlan:
    s = config or Search()
    limit, asked = limit or s.default_limit, Asked(query, category, query_vector)
    # neither the rerank nor the cutoff looks further; written, as it is counted and read
    entries = ranked_entries(m, [asked], limit, s, keep=max(limit, top_k if scorer else 0, s.max_results + 1, s.min_results + 1), index=index, vectors=vectors)
    entries = materialize(entries.drop("query"), "entries")
    if scorer is not None:
        entries = rerank(entries, m.summaries, scorer, top_k)
    shown, total = entries.where(F.col("rank") <= limit), None
    if s.cutoff != "none" and not show_all:
        whole = shown.count()
        shown = cutoff(entries, s.cutoff, s.relative_gap_threshold, s.min_results, min(s.max_results, limit)).where(F.col("rank") <= limit)
        total = whole if shown.count() < whole else None
    return ReadingPlan(query, asked.of(), shown, total)
