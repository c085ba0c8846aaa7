"""The language model's filter at sizes that small corpora do not reach."""

import numpy as np

from wayfinder.llm import lm


def test_counts_over_two_to_the_24_are_told_apart():
    keys, counts = np.arange(1, 4, dtype=np.uint64), np.array([5_000_000, 300_000_000, 5_000_000_000])
    got = lm.Filter(np.frombuffer(lm.Filter.slice_of(keys, counts, 1 << 16), np.uint8), 1).counts(keys)
    assert np.all(got >= counts / 1.5) and np.all(got <= counts * 1.5)


def test_levels_follow_the_corpus(spark):
    model, _ = lm.train(spark.range(100).selectExpr("'a b a' as text"))
    assert model.levels == 9  # 400 tokens


def training(spark, n):
    """n texts whose word pairs are nearly all distinct."""
    return spark.range(n).selectExpr("concat_ws(' ', transform(sequence(0, 99), i -> conv(cast(pmod(xxhash64(id, i), 50000) as string), 10, 36))) as text", "id as doc_id")


def test_a_filter_in_slices_scores_as_a_broadcast_one(spark):
    """Also null ids and texts, repeated rows and words never seen; in one block and in many."""
    docs = training(spark, 3000)
    odd = spark.sql("select cast(null as bigint) as doc_id, cast(null as string) as text union all select 7, '' union all select 7, '' union all select 8, 'x'")
    rows = docs.select("doc_id", "text").unionByName(spark.range(100).selectExpr("-1 - id as doc_id", "concat_ws(' ', transform(sequence(0, 99), i -> concat('new', id, 'q', i))) as text")).unionByName(odd)
    go = lambda train, **k: sorted(map(tuple, lm.score(rows, lm.train(docs.select("text"), **train), **k).collect()), key=repr)
    want = go({"group_bytes": 1 << 15})
    for k in ({}, {"vocabulary_words": 0}, {"block_bytes": 10_000}):
        got = go({"group_bytes": 1 << 15, "broadcast_filter_bytes": 1 << 10}, **k)
        assert [g[:4] for g in got] == [w[:4] for w in want]
        assert np.allclose([g[4:] for g in got], [w[4:] for w in want], rtol=1e-9)


def test_the_filter_keeps_its_bits_for_each_byte_at_any_bound(spark):
    docs = training(spark, 6000)
    size = docs.selectExpr("sum(octet_length(text))").head()[0]
    model, slices = lm.train(docs.select("text"), broadcast_filter_bytes=1 << 10)
    bits = slices.selectExpr("sum(octet_length(bits)) * 8").head()[0]
    assert model.bits is None and bits / size > 0.5
    assert lm.train(docs.select("text"))[0].bits.nbytes * 8 == bits
