"""Depths without a bound on the nodes."""

from pyspark.sql import functions as F

from wayfinder.operators import graph
from wayfinder.projection import project
from wayfinder.queries import QUERIES


def test_depths_agree_with_plain_python(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("d", "c"), ("d", "e"), ("e", "f"), ("a", "ghost"), ("ghost", "g"), ("x", "y")]
    e = spark.createDataFrame([(i,) for i in "abcdefgxy"], "id string")
    d = spark.createDataFrame([(a, "contains", b) for a, b in pairs * 2], "src_id string, rel string, dst_id string")
    seeds = spark.createDataFrame([("a",), ("a",), ("none",)], "id string")
    for bound in (0, 1_000_000):
        for most, want in ((0, {"a": 0}), (2, {"a": 0, "b": 1, "c": 1, "d": 2}), (9, {"a": 0, "b": 1, "c": 1, "d": 2, "e": 3, "f": 4})):
            assert sorted(map(tuple, graph.depths(e, d, seeds, most, bound).collect())) == sorted(want.items())


def test_traversal_depths_leaves_out_no_node(spark, sf_dir, monkeypatch):
    """More than a million documents hang on the repository."""
    n = 1_100_000
    m = project(spark, sf_dir)
    docs = spark.range(n).select(F.concat(F.lit("doc::"), "id").alias("id"))
    e = docs.union(spark.createDataFrame([("repo::.",)], "id string"))
    d = docs.select(F.lit("repo::.").alias("src_id"), F.lit("documented_by").alias("rel"), F.col("id").alias("dst_id"))
    monkeypatch.setattr("wayfinder.queries.project", lambda *_: m.with_tables(entities=e, edges=d))
    assert sorted(map(tuple, QUERIES["traversal_depths"](spark, sf_dir).groupBy("depth").count().collect())) == [(0, 1), (1, n)]
