"""The projection holds whole texts and all documents."""

import os

import pytest
from pyspark.sql import functions as F

from wayfinder import queries
from wayfinder.projection import project


@pytest.fixture
def far(spark, sf_dir, tmp_path):
    """The tables with other documents: of ten, the fifth has 'Blue' after character 200 only."""
    for name in os.listdir(sf_dir):
        if name != "documents.parquet":
            os.symlink(f"{sf_dir}/{name}", tmp_path / name)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    long = F.when(F.col("doc_id") == 5, F.concat(F.repeat(F.lit("w "), 150), F.lit("Blue sky"))).otherwise(F.lit("none"))
    docs.limit(1).drop("doc_id").crossJoin(spark.range(1, 11).withColumnRenamed("id", "doc_id")).withColumns({"text": long, "lang": F.lit("en"), "source": F.lit("s")}).select(docs.columns).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_search_reads_whole_texts(spark, far):
    doc = "doc::s/en/5"
    ratios = {r["entity_id"]: r["ratio"] for r in queries.QUERIES["token_hit_ratio"](spark, far).collect()}
    assert ratios[doc] == 0.5 and ratios["doc::s/en/4"] == 0.0
    assert doc in {r["entity_id"] for r in queries.QUERIES["summary_search"](spark, far).collect()}
    text = {r["entity_id"]: r["short_summary"] for r in queries.QUERIES["scan_summaries"](spark, far).collect()}[doc]
    assert len(text) == 308 and text.endswith("Blue sky")


def test_source_hash_is_of_the_whole_text(spark, far):
    whole = project(spark, far).summaries.where("entity_id = 'doc::s/en/5'").select(F.col("source_hash") == F.sha2(F.concat(F.repeat(F.lit("w "), 150), F.lit("Blue sky")), 256))
    assert whole.head()[0]


def test_files_are_of_all_documents(spark, far):
    files = queries.QUERIES["scan_files"](spark, far)
    assert sorted(r["path"] for r in files.collect()) == sorted(f"docs/{i}" for i in range(1, 11))
