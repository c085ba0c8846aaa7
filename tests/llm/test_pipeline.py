"""The pipeline's stages against plain versions of their decisions."""

import zlib

import corpus_pipeline
import numpy as np
import test_operators as plain

from wayfinder.llm import secrets, toxicity
from wayfinder.llm.queries import table


def test_stages_decide_like_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns, rows = docs.columns, {r["doc_id"]: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, sf_dir)
        if name == "packing":
            break
        assert found.columns == columns and found.schema == docs.schema
        kept = {r["doc_id"]: r for r in found.collect()}
        if name == "toxicity":
            scores = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, table(spark, sf_dir, "labels")).collect()}
            assert set(kept) == {i for i, s in scores.items() if s < 0.3}
        elif name == "ngram_jaccard_join":
            assert set(kept) == {c for _, _, c in plain.brute_components([(i, r["text"]) for i, r in rows.items()])}
        elif name == "decontamination":
            items = [tuple(r) for r in table(spark, sf_dir, "benchmark").select("item_id", "text").collect()]
            assert set(kept) == {r[0] for r in plain.brute_contamination([(i, r["text"]) for i, r in rows.items()], items) if not r[-1]}
        else:
            assert set(kept) == set(rows) and not any(plain.brute_secrets(r["text"]) for r in kept.values())
            assert all(r == rows[i] for i, r in kept.items() if not plain.brute_secrets(rows[i]["text"]))
        if name != "secrets":
            assert all(r == rows[i] for i, r in kept.items())
        rows, docs = kept, spark.createDataFrame(list(kept.values()), docs.schema)
    ids = dict(plain.plain_ids([(i, r["text"]) for i, r in rows.items()], 2))
    pieces = found.collect()
    assert {p["doc_id"] for p in pieces} == set(ids) and sum(p["length"] for p in pieces) == sum(map(len, ids.values()))
    assert all(zlib.crc32(np.ascontiguousarray(ids[p["doc_id"]][p["start"] : p["start"] + p["length"]]).tobytes()) == p["ids_crc32"] for p in pieces)


def test_run_gives_pieces_of_kept_documents(spark, sf_dir):
    pieces = corpus_pipeline.run(spark, sf_dir)
    assert pieces.select("doc_id").distinct().join(table(spark, sf_dir, "documents"), "doc_id", "left_anti").count() == 0
    assert secrets.RULES and pieces.count() > 0


def test_odd_rows_pass_through(spark):
    rows = [(i, t, None, None, n) for i, t, n in plain.ODD]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
    found = {r["doc_id"] for r in docs.collect()}
    assert {None, 0, 1, 2, 3, 4, 7, 8, 9, 11} <= found and 6 not in found and 10 not in found


def test_an_empty_table_passes_through(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
    assert docs.count() == 0
