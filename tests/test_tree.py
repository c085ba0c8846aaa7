"""Listing, ignore rules, hashes and incremental runs over trees of files."""

import hashlib
import os
import random
import tracemalloc

import pytest
from pyspark.sql import functions as F

from wayfinder import shared
from wayfinder.plans import index
from wayfinder.sources import tree


def write(root, files):
    for p, t in files.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_bytes(t if isinstance(t, bytes) else t.encode())


def listed(spark, root, **more):
    return sorted(r["path"] for r in tree.list_tree(spark, str(root), **more).collect())


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


CASES = [
    ("*.tmp", "a.tmp x/b.tmp", "a.tmpx tmp"),
    ("/only", "only only/y", "x/only"),
    ("out/", "x/out/y", "out2 x/outer"),
    ("deep/**/leaf", "deep/leaf deep/a/b/leaf", "x/deep/leaf deep/leafy"),
    ("**/any/*.c", "any/a.c x/any/b.c", "any/a/b.c"),
    ("all/**", "all/a all/b/c", "x/all/a"),
    ("a?c", "abc x/a-c", "ac a/c"),
    ("[!a]z", "bz", "az"),
    ("\\#note", "#note", "note"),
    ("\\!bang", "!bang", "bang"),
    ("trail   ", "trail", "trail2"),
    ("# no rule", "", "no rule"),
    ("k*\n!k2", "k1 x/k3", "k2 x/k2"),
    ("x\\*", "x*", "xy"),
    ("[", "", "["),
]


@pytest.mark.parametrize("text,left_out,kept", CASES)
def test_rules(text, left_out, kept):
    rules = tree.parse_rules(text)

    def out(path):
        """As a walk sees it: a path is left out with a folder above it."""
        parts = path.split("/")
        return any(tree.verdict(rules, "/".join(parts[:n]), n < len(parts)) for n in range(1, len(parts) + 1))

    for p in left_out.split(" ") if left_out else []:
        assert out(p), p
    for p in kept.split(" "):
        assert not out(p), p


def test_listing_honours_every_source_of_rules(spark, tmp_path):
    root = tmp_path / "r"
    write(tmp_path, {".gitignore": "from_above\n"})
    write(root, {
        ".gitignore": "*.log\nbuild/\n", ".ignore": "!wanted.log\n", ".git/info/exclude": "private\n", ".git/HEAD": "x", ".hidden": "", "empty": "",
        "a.log": "", "wanted.log": "", "build/x": "", "private": "", "everywhere.o": "", "from_above": "",
        "sub/.gitignore": "!a.log\n/own\n", "sub/a.log": "", "sub/own": "", "sub/deep/own": "", "sub/deep/.gitignore": "*\n!own\n", "sub/deep/gone": "",
        "build2/.gitignore": "!x\n", "build2/x": "",
    })
    os.symlink(root / "sub", root / "link_to_folder")
    os.symlink(root / "empty", root / "link_to_file")
    os.symlink(root / "nothing", root / "broken")
    os.symlink(root, root / "sub/loop")
    want = [".git/HEAD", ".git/info/exclude", ".gitignore", ".hidden", ".ignore", "build2/.gitignore", "build2/x", "empty", "link_to_file", "sub/.gitignore", "sub/a.log", "sub/deep/own", "wanted.log"]
    assert listed(spark, root, everywhere="*.o\n") == want
    assert listed(spark, root, everywhere="*.o\n", listed=1) == want  # a folder in each round
    assert len(listed(spark, root, honour_ignores=False)) == 21
    assert {"sub/deep/gone", "private"} <= set(listed(spark, root, honour_ignores=False))
    (tmp_path / "none").mkdir()
    assert listed(spark, tmp_path / "none") == []


def test_many_folders_are_listed_in_rounds(spark, tmp_path):
    want = {f"d{i % 7}/e{i % 31}/f{i}" for i in range(1500)}
    write(tmp_path, dict.fromkeys(want, ""))
    assert set(listed(spark, tmp_path, listed=40)) == want


def test_hashes_hold_a_chunk_at_a_time(spark, tmp_path):
    big = tmp_path / "big"
    with open(big, "wb") as f:
        f.truncate(200 << 20)
    write(tmp_path, {"small": b"\x00\xff", "none": b""})
    got = {r["path"]: (r["size"], r["hash"]) for r in tree.scan_tree(spark, str(tmp_path)).files.collect()}
    whole = hashlib.sha256()
    for _ in range(200):
        whole.update(bytes(1 << 20))
    assert got == {"big": (200 << 20, whole.hexdigest()), "small": (2, hashlib.sha256(b"\x00\xff").hexdigest()), "none": (0, hashlib.sha256(b"").hexdigest())}
    tracemalloc.start()
    with open(big, "rb") as f:
        tree.digest_of(f)
    assert tracemalloc.get_traced_memory()[1] < 8 << 20
    tracemalloc.stop()


def test_contents_are_read_where_asked_for(spark, tmp_path):
    write(tmp_path, {"a.md": "x" * 500, "b.rs": "y" * 500})
    wanted = spark.createDataFrame([("a.md", False), ("b.rs", True), ("gone", True)], "path string, whole boolean")
    assert {r["path"]: len(r["content"]) for r in tree.contents(wanted, str(tmp_path)).collect()} == {"a.md": tree.HEAD, "b.rs": 500}


def test_scopes_leave_nothing_in_the_shared_folder(spark, tmp_path):
    folder = shared.shared_dir(spark).removeprefix("file:").replace("//", "/")
    outer = shared.materialize(spark.range(3), "outer")
    before = set(os.listdir(folder))
    with shared.scratch(spark):
        one = shared.materialize(spark.range(5), "one")
        with shared.scratch(spark):
            shared.materialize(one, "two")
            assert len(set(os.listdir(folder)) - before) == 2
        assert len(set(os.listdir(folder)) - before) == 1
        one.write.parquet(str(tmp_path / "kept"))
        with pytest.raises(RuntimeError), shared.scratch(spark):
            shared.materialize(one, "three")
            raise RuntimeError
    assert set(os.listdir(folder)) == before and outer.count() == 3 and spark.read.parquet(str(tmp_path / "kept")).count() == 5


def random_tree(rng):
    folders = ["", "one", "one/two", "three", "three/content"]
    files = {}
    for f in folders:
        at = f + "/" if f else ""
        if rng.random() < 0.6:
            files[at + "Cargo.toml"] = f'[package]\nname = "c{rng.randrange(3)}"\n[dependencies]\nc{rng.randrange(3)} = "1"\n[features]\nx{rng.randrange(2)} = []\n'
        if rng.random() < 0.4:
            files[at + "package.json"] = f'{{"name": "n{rng.randrange(3)}", "dependencies": {{"n{rng.randrange(3)}": "1"}}}}'
        if rng.random() < 0.3:
            files[at + "hugo.toml"] = "theme = 1"
        if rng.random() < 0.5:
            files[at + "mise.toml"] = f"[tasks.t{rng.randrange(3)}]\nrun = 'x'\n"
        for k in range(3):
            if rng.random() < 0.7:
                files[at + f"s{k}.rs"] = f"pub fn f{rng.randrange(3)}() {{}}\npub use a::B{rng.randrange(2)};\nimpl T for S{rng.randrange(2)} {{}}\n"
            if rng.random() < 0.5:
                files[at + f"d{k}.md"] = rng.choice(["---\nx", "plain", "+++"])
        if rng.random() < 0.4:
            files[at + "main.tf"] = ""
    return files


def test_incremental_runs_give_what_a_full_run_gives(spark):
    """Random trees, each reached from the one before: manifests, owners, names and contents change at once."""
    frame = lambda files: spark.createDataFrame([(p, hashlib.sha256(t.encode()).hexdigest(), t.encode()) for p, t in files.items()], "path string, hash string, content binary")
    rng = random.Random(11)
    before = random_tree(rng)
    m = index.facts_of(tree.Tree.of(frame(before)))
    for _ in range(3):
        after = {p: t for p, t in before.items() if rng.random() > 0.15} | {p: t for p, t in random_tree(rng).items() if rng.random() < 0.3}
        run = index.delta(m, tree.Tree.of(frame(after)))
        full = index.facts_of(tree.Tree.of(frame(after)))
        for name in ("files", "entities", "edges", "task_routes"):
            assert rows(getattr(run.model, name)) == rows(getattr(full, name)), name
        touched = {p for p in {*before, *after} if before.get(p) != after.get(p)}
        changed = {r["path"] for r in run.changes.collect()}
        assert touched <= changed  # and files whose owner changed
        assert {r["path"] for r in run.parsed.collect()} == {p for p in changed & set(after) if p.endswith((".rs", ".md"))}
        before, m = after, run.model


def test_summaries_go_with_changed_files_alone(spark):
    frame = lambda files: spark.createDataFrame([(p, t, t.encode()) for p, t in files.items()], "path string, hash string, content binary")
    old = {"Cargo.toml": '[package]\nname = "c"', "a.rs": "pub fn a() {}", "b.rs": "pub fn b() {}", "c.rs": "pub fn c() {}"}
    m = index.facts_of(tree.Tree.of(frame(old)))
    s = m.entities.select(F.col("id").alias("entity_id"), F.lit("s").alias("short_summary"), F.lit(None).cast("string").alias("detailed_summary"), F.array().cast("array<string>").alias("keywords"), F.lit("").alias("updated_at"), F.lit("h").alias("source_hash"))
    new = index.delta(m.with_tables(summaries=s), tree.Tree.of(frame({k: v for k, v in old.items() if k != "c.rs"} | {"b.rs": "pub fn b() { 1 }"}))).model
    assert {r["entity_id"] for r in new.summaries.collect()} == {"repo::.", "component::cargo::.", "source_unit::a.rs", "symbol::a.rs::a"}
