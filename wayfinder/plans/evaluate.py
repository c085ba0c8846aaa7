"""Ranking quality: recall, reciprocal rank, discounted gain and noise after the head, by query, bucket and overall; of given
rankings or of the search itself over labelled queries."""

from __future__ import annotations

import json
import tomllib
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfinder.config import Search
from wayfinder.operators.postings import TextIndex
from wayfinder.plans.search import Asked, ranked_entries, search
from wayfinder.schema import TASK_CATEGORIES, Model

METRICS = ("recall_at_5", "mrr_at_10", "ndcg_at_10", "noise_tail_rate")


@dataclass(frozen=True)
class LabelledQuery:
    text: str
    bucket: str
    relevant: tuple[str, ...]
    acceptable: tuple[str, ...] = ()
    category: str | None = None


def read_labelled(text: str) -> list[LabelledQuery]:
    """Labelled queries of a TOML text (version 1); an unknown category is left to the classifier."""
    given = tomllib.loads(text)
    if given.get("version") != 1:
        raise ValueError("labelled queries must be of version 1")
    known = lambda c: c if c in TASK_CATEGORIES else None
    return [LabelledQuery(q["text"], q["bucket"], tuple(q["relevant"]), tuple(q.get("acceptable", ())), known(q.get("category"))) for q in given["queries"]]


def label_rows(spark: SparkSession, queries: list[LabelledQuery]) -> DataFrame:
    """query (its place in the list), bucket, entity_id, gain; a row without an entity keeps queries that have no labels."""
    rows = [(i, q.bucket, e, gain) for i, q in enumerate(queries) for e, gain in {"": 0, **dict.fromkeys(q.acceptable, 1), **dict.fromkeys(q.relevant, 2)}.items()]
    return spark.createDataFrame(rows, "query int, bucket string, entity_id string, gain int")


def search_all(m: Model, queries: list[LabelledQuery], limit: int = 10, config: Search | None = None, vector_of: Callable[[str], list[float]] | None = None, scorer: Callable | None = None, index: TextIndex | None = None) -> DataFrame:
    """query, rank, entity_id: what the search finds for each, without a cutoff. All queries are one plan; only a second-stage
    scorer (query and texts to scores) is asked query by query."""
    if scorer is None:
        asked = [Asked(q.text, q.category, vector_of(q.text) if vector_of else None) for q in queries]
        return ranked_entries(m, asked, limit, config, index=index).select("query", "rank", F.col("id").alias("entity_id"))
    found = []
    for i, q in enumerate(queries):
        plan = search(m, q.text, q.category, vector_of(q.text) if vector_of else None, limit, config, show_all=True, scorer=lambda texts, q=q: scorer(q.text, texts), index=index)
        found.append(plan.entries.select(F.lit(i).alias("query"), F.col("rank"), F.col("id").alias("entity_id")))
    return reduce(DataFrame.unionByName, found)


@dataclass(frozen=True)
class Evaluation:
    queries: list[LabelledQuery]
    results: DataFrame
    by_query: DataFrame

    def report(self) -> dict:
        """All figures and rankings; as large as the labelled queries and the limit."""
        rank = {i: [] for i in range(len(self.queries))}
        for r in self.results.orderBy("query", "rank").collect():
            rank[r["query"]].append(r["entity_id"])
        per = [{"text": self.queries[r["query"]].text, "bucket": r["bucket"], **{n: r[n] for n in METRICS}, "results": rank[r["query"]]} for r in self.by_query.orderBy("query").collect()]

        def means(some: list[dict]) -> dict:
            return {n: sum(q[n] for q in some) / len(some) if some else 0.0 for n in METRICS} | {"query_count": len(some)}

        return {"overall": means(per), "by_bucket": {b: means([q for q in per if q["bucket"] == b]) for b in sorted({q["bucket"] for q in per})}, "queries": per}

    def to_json(self) -> str:
        return json.dumps(self.report(), indent=2)

    def to_text(self) -> str:
        found = self.report()
        line = lambda name, x: f"{name}: {x['query_count']} queries, " + ", ".join(f"{n} {x[n]:.3f}" for n in METRICS)
        return "\n".join([line("all", found["overall"]), *(line(b, x) for b, x in found["by_bucket"].items())])


def evaluate(m: Model, queries: list[LabelledQuery], limit: int = 10, config: Search | None = None, vector_of: Callable[[str], list[float]] | None = None, scorer: Callable | None = None) -> Evaluation:
    results = search_all(m, queries, limit, config, vector_of, scorer)
    return Evaluation(queries, results, query_metrics(results, label_rows(m.entities.sparkSession, queries)))


def query_metrics(results: DataFrame, labels: DataFrame, recall_at: int = 5, k: int = 10, head: int = 5) -> DataFrame:
    """results: query, rank, entity_id. labels: query, bucket, entity_id, gain (2 relevant, 1 acceptable). One row per labelled query."""
    rated = results.join(labels.select("query", "entity_id", "gain"), ["query", "entity_id"], "left").withColumn("gain", F.coalesce("gain", F.lit(0)))
    hit = F.col("gain") == 2
    shown = rated.groupBy("query").agg(
        F.count_if(hit & (F.col("rank") <= recall_at)).alias("found"),
        F.min(F.when(hit & (F.col("rank") <= k), F.col("rank"))).alias("first"),
        F.sum(F.when(F.col("rank") <= k, (F.pow(F.lit(2.0), F.col("gain")) - 1) / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"),
        F.avg(F.when(F.col("rank") > head, (F.col("gain") == 0).cast("double"))).alias("noise"),
    )
    wanted = labels.groupBy("query", "bucket").agg(F.count_if(F.col("gain") == 2).alias("relevant"), F.count_if(F.col("gain") == 1).alias("acceptable"))
    places = F.sequence(F.lit(1), F.lit(k))
    ideal = F.aggregate(places, F.lit(0.0), lambda t, r: t + F.when(r <= F.col("relevant"), 3.0).when(r <= F.col("relevant") + F.col("acceptable"), 1.0).otherwise(0.0) / F.log2(r + 1.0))
    joined = wanted.join(shown, "query", "left").withColumn("ideal", ideal)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return joined.select(
        "query", "bucket",
        zero(F.try_divide(F.col("found").cast("double"), F.col("relevant"))).alias("recall_at_5"),
        zero(1.0 / F.col("first")).alias("mrr_at_10"),
        zero(F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal"))).alias("ndcg_at_10"),
        zero(F.col("noise")).alias("noise_tail_rate"),
    )


def summary_metrics(per_query: DataFrame) -> DataFrame:
    """Means by bucket, and over all queries (bucket null), in one pass."""
    return per_query.groupingSets([["bucket"], []], "bucket").agg(*(F.avg(n).alias(n) for n in METRICS), F.count("*").alias("queries"))
