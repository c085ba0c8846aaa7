"""Source trees: names listed in tasks under inherited ignore rules, hashes read in chunks, contents read where asked for.

Nothing of a tree is held by the driver. Listing goes in rounds: a task walks down from its folders until it has seen
LISTED entries and hands the folders that are left to the next round, which deals them out anew. A task finds the rules that
hold in a folder by reading the ignore files of the folders above it, once each.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfinder.functions.text import basename, glob_regex
from wayfinder.shared import materialize

#: Entries that a task lists before it hands on the rest; rows of one batch that it sends; bytes that are read at once;
#: bytes and files that a task hashes or reads.
LISTED, BATCH_ROWS, CHUNK, TASK_BYTES, TASK_FILES = 20_000, 5_000, 1 << 20, 256 << 20, 2_000
#: Bytes of a document that extraction looks at.
HEAD = 64
# Names of ignore files, those that win first.
IGNORE_FILES = (".ignore", ".gitignore")
REPO_EXCLUDE = ".git/info/exclude"

Rule = tuple[re.Pattern, bool, bool]


@dataclass(frozen=True)
class Tree:
    """files: path, hash (and size, where it is known); read: contents (path, content) of the files whose paths it is given, with
    column whole, which is false where the head of a file is enough."""

    files: DataFrame
    read: Callable[[DataFrame], DataFrame]

    @staticmethod
    def of(rows: DataFrame) -> Tree:
        """A tree that lies in a table (path, hash, content)."""
        return Tree(rows.select("path", "hash"), lambda wanted: rows.join(wanted.select("path"), "path", "left_semi").select("path", "content"))


def ignored(path: Column, patterns: tuple[str, ...]) -> Column:
    """Whether some exclude glob fits the whole path."""
    return reduce(lambda a, b: a | b, [path.rlike(glob_regex(p)) for p in patterns], F.lit(False))


def rule_regex(glob: str) -> str:
    """A regex for a glob of an ignore file: * and ? stay within a name, ** spans folders."""
    out, at = "", 0
    while at < len(glob):
        c = glob[at]
        if glob.startswith("**/", at) and (at == 0 or glob[at - 1] == "/"):
            out, at = out + "(?:[^/]+/)*", at + 3
        elif glob[at:] == "**" and at and glob[at - 1] == "/":
            out, at = out + ".+", at + 2
        elif c == "\\" and at + 1 < len(glob):
            out, at = out + re.escape(glob[at + 1]), at + 2
        elif c == "[":
            if (end := glob.find("]", at + 2)) < 0:
                raise re.error("a class is not closed")
            inner = glob[at + 1 : end].replace("\\", r"\\")
            out, at = out + "(?!/)[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]", end + 1
        else:
            out, at = out + {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)), at + 1
    return out


def parse_rules(text: str) -> list[Rule]:
    """(regex on the path below the file's folder, ignores, folders only) of each line."""
    rules = []
    for line in text.removeprefix("﻿").splitlines():
        line = re.sub(r"(?<!\\)\s+$", "", line)
        if not line or line.startswith("#"):
            continue
        keeps, body = line.startswith("!"), line.removeprefix("!")
        only, body = body.endswith("/"), body.rstrip("/")
        if not body:
            continue
        anchor = "" if "/" in body else "(?:.*/)?"
        try:
            rules.append((re.compile(f"{anchor}{rule_regex(body.lstrip('/'))}", re.S), not keeps, only))
        except re.error:  # a class that is none
            continue
    return rules


def verdict(rules: list[Rule], path: str, folder: bool) -> bool | None:
    """What the last rule that fits says; None if none does."""
    return next((ignores for rx, ignores, only in reversed(rules) if (folder or not only) and rx.fullmatch(path)), None)


class Folders:
    """Lists folders of a store and knows the rules that hold in them."""

    def __init__(self, root: str, honour: bool, everywhere: str):
        self.store, self.base = fs.FileSystem.from_uri(root)
        self.local = self.store.type_name == "local"
        self.honour, self.known = honour, {}
        self.above = []
        if honour and self.local:  # folders above the root, nearest first, with what lies between
            at, below = self.base.rstrip("/"), ""
            while at and at != "/":
                at, _, name = at.rpartition("/")
                below = f"{name}/{below}"
                self.above.append((at or "/", below))
        self.last = [parse_rules(self.text(f"{self.base}/{REPO_EXCLUDE}")), parse_rules(everywhere)] if honour else []

    def text(self, path: str) -> str:
        try:
            with self.store.open_input_stream(path, compression=None) as f:
                return f.read().decode("utf-8", "replace")
        except (FileNotFoundError, IsADirectoryError, OSError):
            return ""

    def rules(self, folder: str, name: str) -> list[Rule]:
        if (folder, name) not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[folder, name] = parse_rules(self.text(f"{folder}/{name}"))
        return self.known[folder, name]

    def ignores(self, folder: str, name: str, is_folder: bool) -> bool:
        """By the nearest folder's rules first, those of one kind of file before the next."""
        if not self.honour:
            return False
        path = f"{folder}/{name}" if folder else name
        parts = folder.split("/") if folder else []
        for kind in IGNORE_FILES:
            for n in range(len(parts), -1, -1):
                at = "/".join(parts[:n])
                found = verdict(self.rules(f"{self.base}/{at}" if at else self.base, kind), path[len(at) + 1 :] if at else path, is_folder)
                if found is not None:
                    return found
            for at, below in self.above:
                found = verdict(self.rules(at, kind), below + path, is_folder)
                if found is not None:
                    return found
        return next((found for rules in self.last if (found := verdict(rules, path, is_folder)) is not None), False)

    def entries(self, folder: str) -> Iterator[tuple[str, bool, int]]:
        """name, whether it is a folder, size. Links to folders are passed over, links to files are files; a folder that has gone is empty."""
        at = f"{self.base}/{folder}" if folder else self.base
        if not self.local:
            for x in self.store.get_file_info(fs.FileSelector(at, allow_not_found=True)):
                if x.type in (fs.FileType.File, fs.FileType.Directory):
                    yield x.base_name, x.type == fs.FileType.Directory, x.size or 0
            return
        try:
            listing = os.scandir(at)
        except (FileNotFoundError, NotADirectoryError):
            return
        with listing:
            for x in listing:
                if x.is_dir(follow_symlinks=False):
                    yield x.name, True, 0
                elif x.is_file():
                    yield x.name, False, x.stat().st_size


LISTING = pa.schema([("path", pa.string()), ("folder", pa.bool_()), ("size", pa.int64())])


def list_tree(spark: SparkSession, root: str, honour_ignores: bool = True, everywhere: str = "", listed: int = LISTED) -> DataFrame:
    """path, size of all files below root that no ignore file leaves out, hidden ones included; a written table."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folders = Folders(root, honour_ignores, everywhere)
        for batch in batches:
            rows, seen, waiting = [], 0, deque(batch.column(0).to_pylist())
            while waiting:
                folder = waiting.popleft()
                for name, is_folder, size in folders.entries(folder):
                    seen += 1
                    try:
                        name.encode()
                    except UnicodeEncodeError:  # a name that is no text can't be a path of the model
                        continue
                    if folders.ignores(folder, name, is_folder):
                        continue
                    path = f"{folder}/{name}" if folder else name
                    if is_folder:
                        waiting.append(path)
                    else:
                        rows.append((path, False, size))
                    if len(rows) >= BATCH_ROWS:
                        yield _rows(rows, LISTING)
                        rows = []
                if seen >= listed:
                    break
            yield _rows(rows + [(x, True, 0) for x in waiting], LISTING)

    found, left = [], spark.createDataFrame([("",)], "path string")
    while True:
        n = left.count()
        if not n:
            break
        tasks = min(n, 4 * spark.sparkContext.defaultParallelism)
        met = materialize(left.repartition(tasks).mapInArrow(walk, "path string, folder boolean, size long"), "listing")
        found.append(met.where("not folder").select("path", "size"))
        left = met.where("folder").select("path")
    return reduce(DataFrame.unionByName, found)


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def in_tasks(files: DataFrame) -> DataFrame:
    """files (with size) dealt out so that a task has a bounded number of bytes and files, but for a file that is larger."""
    n, size = files.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).head()
    return files.repartition(max(1, n // TASK_FILES, size // TASK_BYTES))


def digest_of(stream) -> tuple[int, str]:
    """Size and SHA-256 of a stream, of which a chunk at a time is held."""
    digest, size = hashlib.sha256(), 0
    while chunk := stream.read(CHUNK):
        digest.update(chunk)
        size += len(chunk)
    return size, digest.hexdigest()


def hashed(files: DataFrame, root: str) -> DataFrame:
    """path, size, hash (SHA-256); a file is read once, in chunks, and one that has gone meanwhile is left out."""
    schema = pa.schema([("path", pa.string()), ("size", pa.int64()), ("hash", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            rows = []
            for path in batch.column("path").to_pylist():
                try:
                    with store.open_input_stream(f"{base}/{path}", compression=None) as f:
                        rows.append((path, *digest_of(f)))
                except FileNotFoundError:
                    continue
            yield _rows(rows, schema)

    return in_tasks(files).select("path").mapInArrow(run, "path string, size long, hash string")


def contents(wanted: DataFrame, root: str) -> DataFrame:
    """path, content of wanted (path, whole): one row at a time; only HEAD bytes where whole is false; files that aren't there give no row."""
    schema = pa.schema([("path", pa.string()), ("content", pa.large_binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            for path, whole in zip(batch.column("path").to_pylist(), batch.column("whole").to_pylist(), strict=True):
                try:
                    with store.open_input_stream(f"{base}/{path}", compression=None) as f:
                        data = f.read() if whole else f.read(HEAD)
                except (FileNotFoundError, IsADirectoryError, NotADirectoryError):
                    continue
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([data], pa.large_binary())], schema=schema)

    sized = wanted if "size" in wanted.columns else wanted.withColumn("size", F.lit(0).cast("long"))
    return in_tasks(materialize(sized.select("path", "whole", "size"), "wanted")).select("path", "whole").mapInArrow(run, "path string, content binary")


def global_ignores() -> str:
    """Rules that hold for all of the caller's repositories, in their usual place."""
    home = os.environ.get("XDG_CONFIG_HOME") or os.path.expanduser("~/.config")
    try:
        with open(f"{home}/git/ignore", encoding="utf-8", errors="replace") as f:
            return f.read()
    except OSError:
        return ""


def scan_tree(spark: SparkSession, root: str, exclude: tuple[str, ...] = (), honour_ignores: bool = True, everywhere: str | None = None) -> Tree:
    """The tree below root, listed and hashed once (a written table). everywhere: the text of further ignore rules; the caller's own by default."""
    rules = (global_ignores() if everywhere is None else everywhere) if honour_ignores else ""
    listed = list_tree(spark, root, honour_ignores, rules).where(~ignored(F.col("path"), exclude))
    return Tree(materialize(hashed(listed, root), "hashes"), lambda wanted: contents(wanted, root))


def extracted_from(path: Column) -> Column:
    """Whether an extractor looks into a file: 'whole', 'head' or null."""
    manifest = basename(path).isin("Cargo.toml", "package.json", "mise.toml")
    return F.when(manifest | path.endswith(".rs") | (path == "config.toml"), "whole").when(path.endswith(".md"), "head")
