"""The engine against small fixtures and plain Python."""

import json
import random

import pytest
from pyspark.sql import functions as F

from wayfinder import config, extraction_queries, queries
from wayfinder.functions.text import glob_regex
from wayfinder.operators import graph, incremental, lookup, store
from wayfinder.operators.postings import TextIndex, searched_texts
from wayfinder.operators.ranking import numbered
from wayfinder.operators.routes import task_routes
from wayfinder.operators.vectors import VectorIndex
from wayfinder.plans import evaluate, index, models, search, summarise
from wayfinder.schema import Model
from wayfinder.sources.rust import rust_facts
from wayfinder.sources.tree import scan_tree
from wayfinder.streaming import changes

E = "id string, kind string, name string, component_id string, path string, exported boolean"
D = "src_id string, rel string, dst_id string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def small(spark, entities, edges, summaries=()):
    m = Model.empty(spark)
    e = spark.createDataFrame([(i, k, n, None, p, x) for i, k, n, p, x in entities], E).withColumns({"language": F.lit(None).cast("string"), "line_start": F.lit(None).cast("int"), "line_end": F.lit(None).cast("int"), "visibility": F.lit(None).cast("string")})
    d = spark.createDataFrame(edges, D).withColumns({"provenance_path": F.lit(None).cast("string"), "provenance_line": F.lit(None).cast("int")})
    s = spark.createDataFrame([(i, t, None, [], "", None) for i, t in summaries], "entity_id string, short_summary string, detailed_summary string, keywords array<string>, updated_at string, source_hash string")
    return m.with_tables(entities=e, edges=d, summaries=s, task_routes=task_routes(e))


def plain_cut(scores, mode, threshold, least, most):
    if mode == "none" or len(scores) <= least:
        return len(scores)
    gaps = [i for i in range(least, len(scores)) if scores[i - 1] <= 0 or scores[i] / scores[i - 1] < threshold]
    return min(gaps[0] if gaps else most, most, len(scores))


def test_cutoff_against_plain_python(spark):
    draw = random.Random(7)
    shapes = [[], [0.0], [0.0] * 6, *([round(draw.random() ** draw.choice([0.2, 1, 4]), 3) for _ in range(n)] for n in (2, 3, 4, 5, 7, 9, 12, 12, 15))]
    for n, scores in enumerate(shapes):
        scores = sorted(scores, reverse=True)
        df = spark.createDataFrame([(i + 1, s) for i, s in enumerate(scores)], "rank int, final_score double")
        mode, threshold, least, most = ("none" if n == 5 else "relative_gap"), draw.choice([0.5, 0.8, 0.95]), draw.choice([1, 3]), draw.choice([4, 6, 20])
        assert search.cutoff(df, mode, threshold, least, most).count() == plain_cut(scores, mode, threshold, least, most), scores


def test_a_plan_tells_its_total_only_if_the_cutoff_kept_fewer(spark):
    """Forty entities of equal score: the limit alone bounds them."""
    m = small(spark, [(f"e{k:02}", "component", f"lamp {k}", f"p{k}", True) for k in range(40)], [("e00", "depends_on", "e01")])
    plan = lambda n, **k: search.search(m, "lamp", limit=n, config=config.Search(cutoff="relative_gap", **k))
    assert (plan(5).entries.count(), plan(5).total_before_cutoff) == (5, None)
    assert (plan(15).entries.count(), plan(15).total_before_cutoff) == (8, 15)
    assert (plan(60, max_results=100).entries.count(), plan(60, max_results=100).total_before_cutoff) == (40, None)


def test_expansion_is_greedy_across_seeds(spark):
    names = ["s1", "s2"] + [f"n{k}" for k in range(12)]
    m = small(spark, [(n, "symbol", n, n, True) for n in names], [("s1", "defines", f"n{k}") for k in range(8)] + [("n3", "defines", "s2"), ("s2", "defines", "n9"), ("s2", "contains", "ghost")])
    c = m.entities.where("id in ('s1', 's2')").withColumns({"query": F.lit(0), "final_score": F.when(F.col("id") == "s1", 2.0).otherwise(1.0), "is_context": F.lit(False)})
    assert [r["id"] for r in search.expand(c, m.entities, m.edges, 15).orderBy("id").collect()] == ["n0", "n1", "n2", "n3", "n4", "n9"]


LAMPS = ([("wick", "symbol", "trim_wick", "lamp/wick.rs", True), ("glass", "symbol", "polish", "lamp/glass.rs", False), ("oil", "component", "oil", "oil", True)], [("wick", "related_to", "glass")], [("wick", "Trims a wick that smokes"), ("oil", "Stores oil")])


def test_search_finds_ranks_and_expands(spark):
    m = small(spark, *LAMPS)
    plan = search.search(m, "trace wick")
    found = plan.entries.orderBy("rank").collect()
    assert plan.category == "debug" and [r["id"] for r in found] == ["wick", "glass"] and found[1]["is_context"] and found[1]["reasons"] == ["graph neighbor"]
    assert found[0]["reasons"] == ["keyword match", "name match", "path match"] and "trim_wick" in plan.to_text(verbose=True) and '"category": "debug"' in plan.to_json()
    assert search.search(m, "trace wick", scorer=lambda t: [(1, 0.9), (0, 0.1), (9, 1.0)]).entries.orderBy("rank").head()["id"] == "glass"


def test_postings_find_what_a_scan_finds(spark):
    """Random texts, tokens of every length, then changes and removals: index and scan agree, and one plan serves many queries."""
    draw = random.Random(5)
    word = lambda: "".join(draw.choice("abAÉ\U0001f600 \n") for _ in range(draw.randrange(9)))
    made = lambda n: [(f"e{k}", "symbol", word(), word() or None, True) for k in range(n)]
    m = small(spark, made(40), [], [(f"e{k}", word() * 3) for k in range(40)])
    tokens = ["a", "ab", "aba", "abab", "aé", "\U0001f600ab", "b a", "é\U0001f600", "aab", "zzz", "abaabaabaaba" * 8]
    held = TextIndex.build(m)
    assert rows(held.find(tokens).select("id", "field", "token")) == rows(search.token_matches(m, tokens).select("id", "field", "token"))
    new = [(f"e{k}", "symbol", word(), word(), True) for k in range(20, 50)]
    later = small(spark, [r for r in made(10)] + new, [], [(f"e{k}", word()) for k in range(30)])
    texts, before = searched_texts(later.entities, later.summaries), searched_texts(m.entities, m.summaries)
    changed = held.put(texts).remove(before.join(texts, ["field", "id"], "left_anti"))
    assert rows(changed.find(tokens).select("id", "field", "token")) == rows(search.token_matches(later, tokens).select("id", "field", "token"))
    assert rows(held.find(tokens)) == rows(TextIndex(spark, held.folder, 0).find(tokens))  # an older state stays readable
    assert held.find([]).count() == 0


def test_many_queries_are_one_plan(spark):
    m = small(spark, *LAMPS)
    asked = [search.Asked("trace wick"), search.Asked("oil", "understand"), search.Asked("zzz"), search.Asked("trace wick")]
    for index in (None, TextIndex.build(m)):
        got = {}
        for r in search.ranked_entries(m, asked, index=index).orderBy("query", "rank").collect():
            got.setdefault(r["query"], []).append((r["id"], r["is_context"], round(r["final_score"], 9), r["reasons"]))
        alone = [search.search(m, q.text, q.category).entries.orderBy("rank").collect() for q in asked]
        assert got == {i: [(r["id"], r["is_context"], round(r["final_score"], 9), r["reasons"]) for r in rows_] for i, rows_ in enumerate(alone) if rows_}
        assert [x[0] for x in got[0]] == ["wick", "glass"] and [x[0] for x in got[1]] == ["oil"] and got[0] == got[3]


def test_indexed_vectors_are_those_of_a_scan(spark):
    """Clustered vectors with ties, a zero vector, changes and removals; most lists and nearly all vectors aren't read."""
    import numpy as np

    rng = np.random.default_rng(4)
    centers = rng.normal(size=(40, 24))
    x = np.repeat(centers, 60, axis=0) + 0.05 * rng.normal(size=(2400, 24))
    x[7] = x[8]
    x[9] = 0
    frame = lambda rows: spark.createDataFrame([(i, None if v is None else [float(a) for a in v]) for i, v in rows], "entity_id string, vector array<float>")
    given = {f"v{k}": x[k] for k in range(2400)}
    held = VectorIndex.build(frame(given.items()))
    changes = {f"v{k}": (None if k % 2 else rng.normal(size=24)) for k in range(60, 90)} | {"new": x[0] * 2}
    later = held.put(frame(changes.items()))
    for index, now in ((held, given), (later, given | changes)):
        left = frame((i, v) for i, v in now.items() if v is not None)
        for q, k in ((x[0], 10), (x[61], 45), (rng.normal(size=24), 5), (-x[300], 3)):
            want = search.retrieve_vectors(left, list(q), k).collect()
            got, read = index.find([float(a) for a in q], k)
            assert [r["entity_id"] for r in got.collect()] == [r["entity_id"] for r in want]
    got, read = held.find([float(a) for a in x[0]], 10)
    assert read["lists"] * 4 <= read["of_lists"] and read["codes"] * 4 <= read["of_codes"] and read["vectors"] < 100, read
    with pytest.raises(ValueError):
        held.find([1.0], 1)
    none = VectorIndex.build(frame([]))
    assert none.find([1.0], 3)[0].count() == 0


def test_places_are_found_in_ranges(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("a"), "id").repartition(5)
    want = sorted(((r["a"], -r["id"]) for r in df.collect()))
    assert [(r["a"], -r["id"]) for r in numbered(df, [F.asc("a"), F.desc("id")]).orderBy("rank").collect()] == want
    assert {r["rank"] for r in numbered(df, [F.col("a"), F.col("id")]).collect()} == set(range(1, 1001))
    assert numbered(df.where("a > 9"), [F.col("id")]).count() == 0


def test_labelled_queries_are_searched_and_measured(spark):
    m = small(spark, *LAMPS)
    text = """version = 1
[[queries]]
text = "trim wick"
bucket = "names"
relevant = ["wick"]
acceptable = ["glass", "wick"]
[[queries]]
text = "oil"
bucket = "names"
category = "understand"
relevant = ["wick"]
[[queries]]
text = "zzz"
bucket = "none"
category = "no such"
relevant = []
"""
    queries_ = evaluate.read_labelled(text)
    assert [q.category for q in queries_] == [None, "understand", None]
    got = evaluate.evaluate(m, queries_)
    report = got.report()
    first, second, third = report["queries"]
    assert first["results"] == ["wick", "glass"] and first["recall_at_5"] == first["mrr_at_10"] == first["ndcg_at_10"] == 1.0
    assert second["results"] == ["oil"] and second["recall_at_5"] == second["mrr_at_10"] == second["ndcg_at_10"] == 0.0
    assert third["results"] == [] and third["noise_tail_rate"] == 0.0
    assert report["overall"]["query_count"] == 3 and report["overall"]["recall_at_5"] == pytest.approx(1 / 3) and report["by_bucket"]["names"]["mrr_at_10"] == 0.5
    assert "names: 2 queries" in got.to_text() and json.loads(got.to_json())["queries"][0]["text"] == "trim wick"
    with pytest.raises(ValueError):
        evaluate.read_labelled("version = 2\nqueries = []")


def test_traversal(spark):
    m = small(spark, [("port", "repo", "port", ".", True), ("pier", "component", "pier", "p", True), ("winch", "symbol", "winch", "w", True), ("buoy::old", "component", "buoy", "o", True)], [("port", "contains", "pier"), ("pier", "defines", "winch"), ("port", "contains", "buoy::old"), ("winch", "related_to", "buoy::old"), ("port", "contains", "nowhere")])
    seeds = spark.createDataFrame([("port", 0)], "id string, ord int")
    go = lambda *a, **k: [r["id"] for r in graph.traverse(m.entities, m.edges, seeds, *a, **k).orderBy("ord").collect()]
    assert go(1, 10) == ["port", "buoy::old", "pier"] and go(10, 2) == ["port", "buoy::old"] and go(10, 10, exclude=("old",)) == ["port", "pier", "winch"] and go(10, 10, ["repo", "component"]) == ["port", "buoy::old", "pier"]


def test_store_round_trip_and_upsert(spark, tmp_path):
    m = small(spark, [("a", "repo", "a", ".", True)], [("ghost", "contains", "other")])
    store.save(m, str(tmp_path))
    new = m.entities.withColumn("name", F.lit("b"))
    store.save(store.upsert_table(store.load(spark, str(tmp_path)), "entities", new), str(tmp_path))
    again = store.load(spark, str(tmp_path))
    assert [r["name"] for r in again.entities.collect()] == ["b"] and again.edges.count() == 1
    assert store.delete_keys(again.entities, spark.createDataFrame([("none",)], "id string"), ["id"]).count() == 1


TREE = {
    "Cargo.toml": '[workspace]\nmembers = ["harbour/*"]',
    "harbour/crane/Cargo.toml": '[package]\nname = "crane"\n[features]\ndefault = ["winch", "dep:rope", "ropes/steel"]\nwinch = []',
    "harbour/crane/src/hoist.rs": "/* lifts /* nested */ fn ghost() {} */\npub fn hoist() {}\n#[bench]\nfn lifts_fast() {}\n",
    "harbour/pilot/Cargo.toml": '[package]\nname = "pilot"\n[dependencies]\nlift = { path = "../crane" }\nradio = "2"',
    "harbour/pilot/src/steer.rs": "fn steer<'a>(c: char) -> bool { c == '{' }\n",
    "harbour/pilots/log.rs": "enum Entry {}",
    "kiosk/Cargo.toml": '[package]\nname = "kiosk-core"',  # two manifests in one root: npm names the component
    "kiosk/package.json": '{"name": "kiosk", "dependencies": {"tickets": "1"}, "workspaces": ["./stalls/a", "missing", 7]}',
    "kiosk/stalls/a/package.json": '{"name": "tickets"}',
    "mise.toml": '[tasks.release_tide]\nrun = "x"',
    "quay/hugo.toml": 'theme = "wave"',
    "quay/blog/first.md": "+++\ntitle = 1\n+++",
    "quay/layouts/frame.html": "<html>",
    "dock/main.tf": "",
    "wreck/sunk.rs": "fn x() {}",
    ".gitignore": "wreck/\n*.bak\n!keep.bak\n/kiosk/stalls\n",
    "quay/.gitignore": "!old.bak\n",
    "quay/old.bak": "x",
    "new.bak": "x",
    "keep.bak": "x",
}


def write_tree(root, files):
    for p, t in files.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(t)


def test_index_a_tree_and_again(spark, tmp_path):
    write_tree(tmp_path, TREE)
    m = index.extract(spark, str(tmp_path), ("*.lock",))
    entities = {r["id"]: r for r in m.entities.collect()}
    edges = {(r["src_id"], r["rel"], r["dst_id"]) for r in m.edges.collect()}
    crane, pilot, kiosk = "component::cargo::harbour/crane", "component::cargo::harbour/pilot", "component::npm::kiosk"
    hoist = "harbour/crane/src/hoist.rs"
    assert {"repo::.", crane, pilot, kiosk, "component::npm::kiosk/stalls/a", "feature::harbour/crane::default", "task::mise.toml::release_tide", f"symbol::{hoist}::hoist", f"bench::{hoist}::lifts_fast", "site::quay", "content_page::quay/blog/first.md", "infra_root::dock/main.tf", "doc::quay/blog/first.md"} <= set(entities)
    assert {(pilot, "depends_on", crane), (kiosk, "depends_on", "component::npm::kiosk/stalls/a"), ("repo::.", "contains", crane), (crane, "contains", f"source_unit::{hoist}"), ("feature::harbour/crane::default", "feature_enables", "feature::harbour/crane::winch"), ("template::quay/layouts/frame.html", "renders", "site::quay"), ("repo::.", "owns_task", "task::mise.toml::release_tide")} <= edges
    owners = {r["path"]: r["component_id"] for r in m.files.collect()}
    assert owners["harbour/pilots/log.rs"] is None and owners[hoist] == crane and "keep.bak" in owners and "quay/old.bak" in owners
    assert not {"wreck/sunk.rs", "new.bak", "kiosk/stalls/a/package.json"} & set(owners)
    assert not any("ghost" in i or "ropes" in i or "dep:" in i or "kiosk-core" in (r["name"] or "") for i, r in entities.items())
    store.save(m, str(tmp_path.parent / "store"))
    kept = store.load(spark, str(tmp_path.parent / "store"))
    write_tree(tmp_path, {hoist: "pub fn hoist() {}\npub fn lower() {}\n"})
    (tmp_path / "harbour/pilot/src/steer.rs").unlink()
    spark.catalog.clearCache()
    now, changes = index.reindex(kept, str(tmp_path), ("*.lock",))
    assert rows(changes) == [(hoist, "changed"), ("harbour/pilot/src/steer.rs", "deleted")]
    full = index.extract(spark, str(tmp_path), ("*.lock",))
    for name in ("entities", "edges", "files", "task_routes"):
        assert rows(getattr(now, name)) == rows(getattr(full, name)), name


def test_rust_items():
    text = '//! x { fn no() }\npub use a::B;\npub(crate) struct Foo<T> { a: T }\npub trait T { fn inner(&self) {} }\nimpl Show for Foo { pub fn show(&self) -> &str { "}" } }\nmod tests { #[tokio::test]\n async fn runs() { fn nested() {} } }\n'
    entities, edges = rust_facts("f.rs", None, text)
    assert [(e["id"], e["line_start"], e["visibility"], e["exported"]) for e in entities[1:]] == [("symbol::f.rs::Foo", 3, "internal", False), ("symbol::f.rs::T", 4, "public", True), ("symbol::f.rs::show", 5, "public", True), ("test::f.rs::runs", 7, None, False)]
    found = {(e["src_id"], e["rel"], e["dst_id"], e["provenance_path"], e["provenance_line"]) for e in edges}
    assert {("symbol::f.rs::Foo", "implements", "symbol::f.rs::Show", "f.rs", 5), ("source_unit::f.rs", "reexports", "symbol::f.rs::B", "f.rs", 2)} <= found


def test_rust_comments_literals_and_macros():
    """Each text holds one item, whatever its comments, literals, lifetimes and macros look like."""
    texts = (
        "/* a /* b */ fn no() {} */ fn yes() {}",
        "/* never closed? /* no */ */ fn yes() {} /* fn no() {}",
        "// fn no() {}\nfn yes() {}",
        'const S: &str = "fn no() { \\" }"; fn yes() {}',
        'const S: &str = r##"fn no() "# {"##; fn yes() {}',
        'const B: &[u8] = br#"{"#; const C: u8 = b\'{\'; fn yes() {}',
        "fn yes<'a, 'static_>(x: &'a str, c: char) -> bool { c == '\\'' || c == '}' || c == '\\u{7b}' }",
        "make!( fn no() {} );\nmake![ struct No; ];\nmake!{ enum No {} }\nfn yes() {}",
        "macro_rules! make { () => { fn no() {} } }\nfn yes() {}",
    )
    for text in texts:
        entities, _ = rust_facts("f.rs", None, text)
        assert [e["name"] for e in entities[1:]] == ["yes"], text


def test_models_fall_back(spark):
    class Flaky(models.OfflineProvider):
        def embed(self, texts):
            if len(texts) > 1 or "bad" in texts[0]:
                raise RuntimeError("no")
            return super().embed(texts)

    work = spark.createDataFrame([("a", "symbol", "good", "fine", ["k"]), ("b", "symbol", "bad", "x", [])], "entity_id string, kind string, name string, short_summary string, keywords array<string>")
    assert [r["entity_id"] for r in models.embed_rows(work, Flaky, "m", 64).collect()] == ["a"]
    assert models.tolerant_json('Sure: ```json\n{"short_summary": "x"}\n```') == {"short_summary": "x"} and models.tolerant_json('{"short_summary": "cut", "keywo') == {"short_summary": "cut"} and models.tolerant_json("none") is None
    for cut, whole in (('{"a": ["x", "y"', {"a": ["x", "y"]}), ('{"a": {"b": 1)', {"a": {"b": 1}}), ('{"a": ["x", "y", "z', {"a": ["x", "y", "z"]}), ('{"a": [1, 2], "b":', {"a": [1, 2]}), ('{"a": "q\\"", "b": [', {"a": 'q"', "b": []})):
        assert models.tolerant_json(cut) == whole, cut
    assert models.make_provider(config.Config(), "", "") is None and isinstance(models.make_provider(config.Config(), "offline", "")(), models.OfflineProvider) and models.make_provider(config.Config(), "ollama", "m")().base_url.startswith("http")
    with pytest.raises(ValueError):
        models.make_provider(config.Config(), "nobody", "")


def notes():
    class Notes:  # within a function, so that it is sent to tasks by value
        """Answers with the ids that it is asked about; leaves one out of a batch, and fails for one batch as a whole."""

        def complete(self, prompt, max_tokens):
            ids = [x.removeprefix("Entity ID: ") for x in prompt.split("\n") if x.startswith("Entity ID: ")]
            if len(ids) > 1 and any("fails" in i for i in ids):
                raise models.RequestFailed("no", False)
            made = [{"entity_id": i, "short_summary": f"{len(ids)} of {i}", "keywords": ["k", 1]} for i in ids if len(ids) == 1 or "left_out" not in i]
            return json.dumps({"summaries": made} if len(ids) > 1 else made[0])

        def embed(self, texts):
            return [[1.0] * 768 for _ in texts]

    return Notes


def test_summaries_come_in_batches_and_one_by_one(spark):
    names = ["a", "b", "left_out", "c", "x_fails", "y"]
    work = spark.createDataFrame([(n, "one", "symbol", f"Entity ID: {n}", "h") for n in names] + [("doc", "one", "doc", "Entity ID: doc", "h")], "entity_id string, component_id string, kind string, prompt string, source_hash string").repartition(1)
    found = {r["entity_id"]: r for r in summarise.summarise(work, notes(), config.Summary(batch_size=3)).collect()}
    assert set(found) == {*names, "doc"} and found["doc"]["short_summary"] == "1 of doc" and found["left_out"]["short_summary"] == "1 of left_out" and found["x_fails"]["short_summary"] == "1 of x_fails"
    assert found["a"]["keywords"] == ["k", "1"] and found["a"]["source_hash"] == "h"


def test_calls_in_flight_are_bounded_and_keep_their_order():
    import threading
    import time

    lock, now, most, taken = threading.Lock(), 0, 0, []

    def call(k):
        nonlocal now, most
        with lock:
            now += 1
            most = max(most, now)
        time.sleep(0.02 if k % 3 else 0.06)
        with lock:
            now -= 1
        if k == 99:
            raise RuntimeError("no")
        return k

    def calls(n):
        for k in range(n):
            taken.append(k)
            yield lambda k=k: call(k)

    for width in (1, 4):
        most, taken[:] = 0, []
        found = models.in_flight(calls(20), width)
        assert next(found) == 0 and len(taken) <= width + 1  # no more is taken than runs
        assert list(found) == list(range(1, 20)) and most == width
    assert list(models.in_flight(iter(()), 3)) == []
    with pytest.raises(RuntimeError):
        list(models.in_flight((lambda k=k: call(k) for k in (1, 99, 2)), 3))


def test_reranking_goes_in_batches():
    class Scores:
        def rerank(self, query, texts):
            seen.append(len(texts))
            return [(i, float(t)) for i, t in enumerate(texts)] + [(99, 1.0)]

    for most in (1, 3):
        seen = []
        score = models.scorer_of(Scores(), "q", config.Reranker(batch_size=3), most)
        assert score([str(k) for k in range(8)]) == [(k, float(k)) for k in range(8)] and sorted(seen) == [2, 3, 3] and score([]) == []


def test_a_provider_that_breaks_costs_its_batch_alone(spark):
    def make():
        class Broken:
            def complete(self, prompt, max_tokens):
                ids = [x.removeprefix("Entity ID: ") for x in prompt.split("\n") if x.startswith("Entity ID: ")]
                if "b" in ids:
                    raise KeyError("choices")
                return json.dumps({"short_summary": ids[0]})

        return Broken()

    work = spark.createDataFrame([(n, "one", "symbol", f"Entity ID: {n}", "h") for n in "abcdef"], "entity_id string, component_id string, kind string, prompt string, source_hash string").repartition(1)
    for width in (1, 4):
        made = summarise.summarise(work, make, config.Summary(batch_size=2, concurrency=width))
        assert {r["entity_id"] for r in made.collect()} == set("acdef")
        assert tuple(summarise.summary_counts(work, made).head()) == (6, 5, 1)


def test_batches_fit_a_budget():
    rows = [("s", 5), ("s", 5), ("s", 50), ("s", 200), ("d", 1), ("s", 1), ("s", 1), ("s", 1), ("s", 1)]
    got = list(summarise.in_budget(rows, 3, lambda r: r[0] == "s", lambda r: r[1], 10, 5, 80))
    assert [len(b) for b in got] == [2, 1, 1, 1, 3, 1] and sum(got, []) == rows
    assert list(summarise.in_budget([], 3, bool, bool, 0, 0, 1)) == []


def test_snippets_and_excerpts_are_bounded(spark):
    text = "\n".join(f"line {k}" for k in range(1, 401)) + "\n"
    odd = spark.createDataFrame([(text, 2, 3), (text, 399, 900), (text, None, None), (text, 401, 402), ("", 1, 1), ("a\r\nb", 2, 2), (text, 5, 4)], "t string, a int, b int")
    got = [tuple(r) for r in odd.select(summarise.snippet(F.col("t"), F.col("a"), F.col("b")), summarise.excerpt(F.col("t"))).collect()]
    assert [g[0] for g in got] == ["line 2\nline 3", "line 399\nline 400", "line 1", None, None, "b", None]
    assert got[0][1].count("\n") == 119 and got[4][1] is None and got[5][1] == "a\nb"
    long = spark.createDataFrame([("x" * 9000,), (" \n \n",)], "t string").select(summarise.excerpt(F.col("t")), summarise.snippet(F.repeat(F.lit("y\n"), 500), F.lit(1), F.lit(500))).collect()
    assert len(long[0][0]) == 6000 and long[1][0] is None and long[0][1].count("y") == 200
    for unit, pad in (("é", ""), ("é", "a"), ("你", "a"), ("\U0001f600", "ab"), ("a", "")):
        text = pad + unit * 7000
        cut = spark.createDataFrame([(text,)], "t string").select(summarise.excerpt(F.col("t"))).head()[0]
        assert text.startswith(cut) and len(cut.encode()) <= 6000 < len(text[: len(cut) + 1].encode())


def test_profiles_list_all_paths_of_a_component(spark, sf_dir):
    kinds = [("source_unit", 30), ("doc", 14), ("symbol", 3), ("task", 2)]
    made = [(f"{k}{n}", k, f"z{n:02}", c, None if n % 7 == 0 else f"p{n:02}", True) for c in ("component::x::a", "component::x::b") for k, most in kinds for n in range(most)]
    made += [("t", "test", "t", "component::x::c", "t", True), ("d", "doc", "d", None, "d", True)]
    paths = lambda most: sorted(f"z{n:02}" if n % 7 == 0 else f"p{n:02}" for n in range(most))
    df = spark.createDataFrame(made, E)
    whole = [(c, 3, 0, 0, 30, 14, paths(30), paths(14)) for c in ("component::x::a", "component::x::b")] + [("component::x::c", 0, 1, 0, 0, 0, [], [])]
    assert rows(incremental.component_profile(df)) == whole
    assert rows(incremental.component_profile(df, 4)) == [(*r[:6], r[6][:4], r[7][:4]) for r in whole]
    nations, regions = ({r[0]: r[1:] for r in spark.read.parquet(f"{sf_dir}/{t}.parquet").select(*c).collect()} for t, c in (("nation", ("n_name", "n_regionkey")), ("region", ("r_regionkey", "r_name"))))
    slug = lambda x: x.lower().replace(" ", "_")
    of = {f"component::tpch::{slug(r)}": ",".join(sorted(f"{slug(r)}/{slug(n)}" for n, (at,) in nations.items() if at == k)) for k, (r,) in regions.items()}
    assert max(x.count(",") for x in of.values()) > 3
    assert {r["component_id"]: r["sources"] for r in queries.QUERIES["component_profile"](spark, sf_dir).collect()} == of


def test_index_run_with_summaries_and_vectors(spark, tmp_path):
    write_tree(tmp_path / "t", TREE)
    c = config.Config()
    m = index.index(spark, str(tmp_path / "t"), ("*.lock",), config=c, summaries=notes(), vectors=notes())
    found = {r["entity_id"]: r["short_summary"] for r in m.summaries.collect()}
    assert {"repo::.", "component::cargo::harbour/crane", "symbol::harbour/crane/src/hoist.rs::hoist", "doc::quay/blog/first.md"} <= set(found)
    assert "symbol::harbour/pilot/src/steer.rs::steer" not in found  # not exported
    assert {r["entity_id"] for r in m.embeddings.collect()} == set(found)
    store.save(m, str(tmp_path / "s"))
    kept = store.load(spark, str(tmp_path / "s"))
    write_tree(tmp_path / "t", {"harbour/crane/src/hoist.rs": "pub fn hoist() -> u8 { 1 }\n"})
    again = index.delta(kept, scan_tree(spark, str(tmp_path / "t"), ("*.lock",)))
    assert rows(again.parsed) == [("harbour/crane/src/hoist.rs",)]
    work = {r["entity_id"] for r in summarise.stale_work(again.model, index.text_contents(scan_tree(spark, str(tmp_path / "t")), again.model.entities)).collect()}
    assert "symbol::harbour/crane/src/hoist.rs::hoist" in work and "doc::quay/blog/first.md" not in work
    forced = index.index(spark, str(tmp_path / "t"), ("*.lock",), kept, force=True)
    assert forced.summaries.count() == 0 and forced.entities.count() > 0


def test_newest_version_is_by_number(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        store.load(spark, str(tmp_path))
    m = small(spark, [("a", "repo", "a", ".", True)], [])
    commits = [store.save(m.with_tables(entities=m.entities.withColumn("name", F.lit(name))), str(tmp_path)) for name in ("one", "two", "three")]
    assert store.load(spark, str(tmp_path)).entities.head()["name"] == "three" and [c.number for c in commits] == [1, 2, 3]
    assert store.load(spark, str(tmp_path), commits[0]).entities.head()["name"] == "one"


def test_two_writers_at_once_lose_nothing(spark, tmp_path):
    """The second publishes while the first still computes; the first then applies its change to what the second left."""
    root = str(tmp_path)
    store.save(small(spark, [("a", "repo", "a", ".", True)], []), root)
    seen = []

    def add(name, meanwhile=None):
        def change(m):
            seen.append(name)
            new = m.with_tables(entities=m.entities.unionByName(m.entities.where("id = 'a'").withColumn("id", F.lit(name))))
            if meanwhile and seen.count(name) == 1:
                meanwhile()
            return new

        return change

    last = store.update(spark, root, add("b", lambda: store.update(spark, root, add("c"))))
    assert seen == ["b", "c", "b"] and last.number == 3 and last.rows["entities"] == 3
    assert {r["id"] for r in store.load(spark, root).entities.collect()} == {"a", "b", "c"}
    log = store.Log(spark, root)
    assert not log.put(store.Commit(3, 5, {})) and log.last() == last
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda n: store.update(spark, root, add(n)), ["w1", "w2", "w3", "w4"]))
    assert {r["id"] for r in store.load(spark, root).entities.collect()} == {"a", "b", "c", "w1", "w2", "w3", "w4"} and log.last().number == 7


def test_an_upsert_rewrites_touched_buckets_alone(spark, tmp_path):
    root = str(tmp_path)
    many = [(f"e{k}", "symbol", f"n{k}", None, True) for k in range(400)]
    first = store.save(small(spark, many, [("e1", "defines", "e2")]), root)
    assert first.rows == {"files": 0, "entities": 400, "edges": 1, "summaries": 0, "task_routes": 800, "embeddings": 0}
    now = store.load(spark, root).entities
    new = now.where("id = 'e7'").withColumn("name", F.lit("x")).unionByName(now.where("id = 'e7'").withColumn("id", F.lit("added")))
    last = store.upsert_stored(spark, root, "entities", new, spark.createDataFrame([("e9",), ("never",)], "id string"))
    got = {r["id"]: r["name"] for r in store.load(spark, root).entities.collect()}
    assert got == {f"e{k}": f"n{k}" for k in range(400) if k != 9} | {"e7": "x", "added": "n7"} and last.rows["entities"] == 400
    changed = {b for b in {*first.tables["entities"], *last.tables["entities"]} if first.tables["entities"].get(b) != last.tables["entities"].get(b)}
    assert 1 <= len(changed) <= 4 and last.tables["edges"] == first.tables["edges"]


def test_a_model_of_version_4_is_read_and_brought_up_to_date(spark, tmp_path):
    """Its edges have no provenance; after migration an incremental run still gives what a full run gives."""
    write_tree(tmp_path / "t", TREE)
    full = index.extract(spark, str(tmp_path / "t"))
    old = full.with_tables(edges=full.edges.withColumns({"provenance_path": F.lit(None).cast("string"), "provenance_line": F.lit(None).cast("int")}))
    for name, df in old.tables().items():
        df.write.parquet(str(tmp_path / "s" / "versions" / "v" / name))
    pointer = "version string, schema_version int, number long"
    spark.createDataFrame([("v", 4, 1)], pointer).write.parquet(str(tmp_path / "s" / "current"))
    read = store.load(spark, str(tmp_path / "s"))
    keys = ("src_id", "rel", "dst_id", "provenance_path")
    assert rows(read.edges.select(*keys)) == rows(full.edges.select(*keys))
    (tmp_path / "t" / "harbour/pilot/src/steer.rs").unlink()
    assert rows(index.reindex(read, str(tmp_path / "t"))[0].edges.select(*keys)) == rows(index.extract(spark, str(tmp_path / "t")).edges.select(*keys))
    store.save(read, str(tmp_path / "s"))  # from now on in the new layout
    assert store.load(spark, str(tmp_path / "s")).edges.count() == full.edges.count()
    spark.createDataFrame([("v", 3, 1)], pointer).write.parquet(str(tmp_path / "o" / "current"))
    for name, df in small(spark, [], []).tables().items():
        df.write.parquet(str(tmp_path / "o" / "versions" / "v" / name))
    with pytest.raises(ValueError, match="schema version 3"):
        store.load(spark, str(tmp_path / "o"))


def test_links_seeds_and_dimensions(spark):
    m = small(spark, [("repo::.", "repo", "r", ".", True), ("b", "symbol", "s", "x/y.rs", True), ("c", "symbol", "n", None, True)], [])
    links = dict(map(tuple, lookup.editor_links(m.entities, "/w/", "e://{abs_path}:{line}:{column} {repo_path} {entity_id}").collect()))
    assert links == {"repo::.": "e:///w/:1:1 . repo::.", "b": "e:///w/x/y.rs:1:1 x/y.rs b", "c": "e:///w/:1:1 . c"}
    assert rows(graph.drawing_seeds(m.entities)) == [("repo::.", 0)] and rows(graph.drawing_seeds(m.entities, "b")) == [("b", 0)] and graph.drawing_seeds(m.entities.where("kind = 'symbol'")).count() == 2
    v = spark.createDataFrame([("a", [1.0, 2.0])], "entity_id string, vector array<float>")
    assert store.check_dimensions(v, 2).count() == 1
    with pytest.raises(Exception, match="dimensions"):
        store.check_dimensions(v, 3).collect()
    with pytest.raises(ValueError):
        lookup.vector_meta(m.embeddings)


def test_stream_of_files(spark, tmp_path):
    """Two rows for a path in one batch: the one of the larger version counts."""
    schema = "path string, hash string, component_id string, version long"
    spark.createDataFrame([("a", "1", None, 1), ("b", "9", None, 2), ("b", "2", None, 1), ("c", "3", None, 1)], schema).write.parquet(str(tmp_path / "in"))
    stored = spark.createDataFrame([("a", "1", None), ("b", "2", None)], "path string, hash string, component_id string")
    seen = []
    changes.stream_changes(spark, spark.readStream.schema(schema).parquet(str(tmp_path / "in")), lambda: stored, lambda df, n: seen.extend(rows(df)), str(tmp_path / "cp"), order="version").awaitTermination()
    assert seen == [("b", "changed"), ("c", "new")]


def test_config():
    assert config.validate(config.read_config("")).search.default_limit == 15 and "{abs_path}" in config.Config().editor_link
    for bad in ("[search]\nrelative_gap_threshold = 2.0", "[search]\nmin_results = 0", "[search.rerank_weights]\nkeyword = 0.9", "[embedding]\nprovider = 'none'", "[summary]\ntemperature = 3.0"):
        with pytest.raises(ValueError):
            config.validate(config.read_config(bad))


def test_globs():
    import re

    for glob, path, fits in (("**/main.tf", "main.tf", True), ("**/main.tf", "a/b/main.tf", True), ("Dockerfile*", "Dockerfile.dev", True), ("*.lock", "a/b.lock", True), (".github/workflows/*.{yml,yaml}", ".github/workflows/x.yaml", True), ("templates/**/*.html", "templates/a.html", True), ("a?c", "abc", True), ("target/**", "src/target", False)):
        assert bool(re.search(glob_regex(glob), path)) == fits, (glob, path)


def test_queries_agree_with_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    every, sql = queries.QUERIES | extraction_queries.QUERIES, queries.ORACLE | extraction_queries.ORACLE
    # the rest is compared by the driver; these are the most involved
    for name in ("search_lexical", "classified_queries", "file_changes", "evaluation_of_search", "structure_tree", "path_rules", "routes", "budget_batches", "excerpts", "entity_view", "repo_profile"):
        df = every[name](spark, sf_dir)
        cur = con.execute(sql[name])
        at = [[d[0] for d in cur.description].index(c) for c in df.columns]
        assert sorted(map(repr, map(tuple, df.collect()))) == sorted(repr(tuple(r[k] for k in at)) for r in cur.fetchall()), name
