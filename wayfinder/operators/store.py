"""Keyed tables: upserts, deletes, cascades, and publishing a whole model at once."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from wayfinder.schema import KEYS, SCHEMA_VERSION, TABLES, Model
from wayfinder.shared import materialize


def last_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key: the one that comes last in the order column, which is dropped."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", order)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Whole rows of new replace those of old with the same key. order: a column of new that says which of several wins."""
    fresh = last_wins(new, keys, order) if order else new.dropDuplicates(keys)
    return old.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh)


def delete_keys(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not in gone; a key that isn't there changes nothing."""
    return rows.join(gone.select(*keys).distinct(), keys, "left_anti")


def delete_where(rows: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition is not true; null counts as not true."""
    return rows.where(~F.coalesce(condition, F.lit(False)))


def delete_edges_of(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges that touch none of ids (column id) at either end."""
    gone = ids.select("id").distinct()
    left = edges.join(gone.withColumnRenamed("id", "src_id"), "src_id", "left_anti")
    return left.join(gone.withColumnRenamed("id", "dst_id"), "dst_id", "left_anti").select(*edges.columns)


def cascade_entities(m: Model, gone: DataFrame) -> Model:
    """The model without the entities in gone (column id), their edges, summaries, routes and vectors."""
    own = gone.select("id").distinct()
    by = own.withColumnRenamed("id", "entity_id")
    return m.with_tables(
        entities=m.entities.join(own, "id", "left_anti"),
        edges=delete_edges_of(m.edges, own),
        summaries=m.summaries.join(by, "entity_id", "left_anti"),
        task_routes=m.task_routes.join(by, "entity_id", "left_anti").select(*m.task_routes.columns),
        embeddings=m.embeddings.join(by, "entity_id", "left_anti"),
    )


def cascade_files(m: Model, paths: DataFrame) -> Model:
    """The model without the files in paths (column path), what was found in them, and edges that name them as provenance."""
    own = paths.select("path").distinct()
    left = cascade_entities(m, m.entities.join(own, "path", "left_semi"))
    kept = left.edges.join(own.withColumnRenamed("path", "provenance_path"), "provenance_path", "left_anti").select(*m.edges.columns)
    return left.with_tables(edges=kept, files=left.files.join(own, "path", "left_anti"))


def vector_collisions(embeddings: DataFrame, key: Column) -> DataFrame:
    """Vector keys that two entities share."""
    return embeddings.groupBy(key.alias("vector_key")).agg(F.count_distinct("entity_id").alias("owners")).where("owners > 1")


def check_dimensions(embeddings: DataFrame, dimensions: int) -> DataFrame:
    """The rows, or an error at the first vector of another length."""
    good = F.size("vector") == dimensions
    return embeddings.withColumn("vector", F.when(good, F.col("vector")).otherwise(F.raise_error(F.lit(f"a vector does not have {dimensions} dimensions")).cast("array<float>")))


#: Folders of a table by a hash of its key: an upsert writes those anew that it touches.
BUCKETS = 32
BUCKET = "__bucket"
#: Times that a writer whom others overtake begins again.
TRIES = 20


class Overtaken(RuntimeError):
    """Other writers published each time first."""


@dataclass(frozen=True)
class Commit:
    """An entry of the log: its number, the layout's version, and by table the folder and the rows of each bucket."""

    number: int
    schema_version: int
    tables: dict[str, dict[str, list]]

    @property
    def rows(self) -> dict[str, int]:
        """Rows of each table, as the tasks that wrote them counted."""
        return {name: sum(n for _, n in buckets.values()) for name, buckets in self.tables.items()}

    def folders(self, name: str) -> list[str]:
        return sorted(at for at, _ in self.tables[name].values())


class Log:
    """Numbered commits below root/log. A number is taken by the writer that puts its file first, with its content at once."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self.path = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        self.files = self.path("log").getFileSystem(spark._jsc.hadoopConfiguration())
        self.local = self.files.getScheme() == "file"

    def last(self) -> Commit | None:
        """The newest commit. Only names are listed; one entry is read."""
        if not self.files.exists(self.path("log")):
            return None
        names = [n for f in self.files.listStatus(self.path("log")) if (n := f.getPath().getName()).endswith(".json") and not n.startswith(".")]
        return self.read(max(names)) if names else None

    def read(self, name: str) -> Commit:
        stream = self.files.open(self.path(f"log/{name}"))
        try:
            return Commit(**json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()

    def put(self, commit: Commit) -> bool:
        """False if the number is taken. A local file is linked to its name, elsewhere a file is renamed without replacing, which
        file systems with atomic renames (HDFS) do in one step."""
        name, part = f"log/{commit.number:020d}.json", f"log/.{uuid.uuid4().hex}"
        out = self.files.create(self.path(part), True)
        out.write(bytearray(json.dumps(asdict(commit)).encode()))
        out.close()
        if self.local:
            here = lambda x: self.files.makeQualified(self.path(x)).toUri().getPath()
            try:
                os.link(here(part), here(name))
                return True
            except FileExistsError:
                return False
            finally:
                self.files.delete(self.path(part), False)
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path("log").toUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(getattr(self.spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(self.path(part), self.path(name), none)
            return True
        except Py4JJavaError as e:
            self.files.delete(self.path(part), False)
            if "FileAlreadyExistsException" in e.java_exception.toString():
                return False
            raise


def _write(df: DataFrame, name: str, root: str, only: list[int] | None = None) -> dict[str, list]:
    """Writes a table (or some of its buckets) beside all others; folder and rows of each bucket that has any. Spark splits a large
    bucket over several tasks, and the tasks that write count."""
    at, counted = f"data/{uuid.uuid4().hex}/{name}", Observation()
    rows = df.withColumn(BUCKET, _bucket(name))
    rows = rows if only is None else rows.where(F.col(BUCKET).isin(only))
    rows = rows.hint("rebalance", BUCKET).observe(counted, *(F.count_if(F.col(BUCKET) == k).alias(f"n{k}") for k in range(BUCKETS)))
    rows.write.partitionBy(BUCKET).parquet(f"{root}/{at}")
    found = counted.get
    return {str(k): [f"{at}/{BUCKET}={k}", found[f"n{k}"]] for k in range(BUCKETS) if found[f"n{k}"]}


def _bucket(name: str) -> Column:
    return F.pmod(F.xxhash64(*KEYS[name]), F.lit(BUCKETS)).cast("int")


def save(m: Model, root: str) -> Commit:
    """Publishes a whole model as the newest. Readers see the model before or this one, and no writer's commit is lost: a number
    that another took meanwhile is passed over. To build on what is there, use update()."""
    log, written = Log(m.entities.sparkSession, root), {name: _write(df, name, root) for name, df in m.tables().items()}
    for _ in range(TRIES):
        last = log.last()
        if log.put(commit := Commit((last.number if last else 0) + 1, SCHEMA_VERSION, written)):
            return commit
    raise Overtaken(root)


def update(spark: SparkSession, root: str, change: Callable[[Model], Model]) -> Commit:
    """Publishes change(the newest model). A writer whom another overtook applies its change to what the other published.
    Tables that the change gives back as they are stay in their folders."""
    log = Log(spark, root)
    for _ in range(TRIES):
        last = log.last()
        old = load(spark, root, last)
        new = change(old)
        same = lambda name: last is not None and last.schema_version == SCHEMA_VERSION and getattr(new, name) is getattr(old, name)
        tables = {name: last.tables[name] if same(name) else _write(df, name, root) for name, df in new.tables().items()}
        if log.put(commit := Commit((last.number if last else 0) + 1, SCHEMA_VERSION, tables)):
            return commit
    raise Overtaken(root)


def upsert_stored(spark: SparkSession, root: str, name: str, new: DataFrame, gone: DataFrame | None = None) -> Commit:
    """Replaces and adds rows of a stored table by key, and takes those of gone (key columns) away. Only buckets that hold such a
    key are read and written; the counts of the new commit come from the tasks that write."""
    log, keys = Log(spark, root), KEYS[name]
    new = materialize(new, "new")
    lost = materialize(gone.select(*keys), "gone") if gone is not None else spark.createDataFrame([], new.select(*keys).schema)
    touched = sorted(r[0] for r in new.select(_bucket(name)).union(lost.select(_bucket(name))).distinct().collect())  # BUCKETS at most
    for _ in range(TRIES):
        last = log.last()
        if last is None or last.schema_version != SCHEMA_VERSION:
            raise FileNotFoundError(f"no model of this version is published in {root}")
        have = last.tables[name]
        old = _read(spark, root, name, [have[str(b)][0] for b in touched if str(b) in have])
        rows = upsert(delete_keys(old, lost, keys), new.select(*old.columns), keys)
        kept = {b: x for b, x in have.items() if int(b) not in touched}
        if log.put(commit := Commit(last.number + 1, SCHEMA_VERSION, last.tables | {name: kept | _write(rows, name, root, touched)})):
            return commit
    raise Overtaken(root)


def _read(spark: SparkSession, root: str, name: str, folders: list[str]) -> DataFrame:
    ddl = TABLES[name].replace(" NOT NULL", "")
    return spark.read.schema(ddl).parquet(*(f"{root}/{f}" for f in sorted(folders))) if folders else spark.createDataFrame([], ddl)


def load(spark: SparkSession, root: str, commit: Commit | None = None) -> Model:
    """The newest model, or that of a commit, brought to this version's layout; an error for a later version or where there is none."""
    last = commit or Log(spark, root).last()
    if last is not None:
        version, m = last.schema_version, Model(**{name: _read(spark, root, name, last.folders(name)) for name in TABLES})
    else:
        version, m = _load_4(spark, root)
    while version < SCHEMA_VERSION and version in MIGRATIONS:
        version, m = version + 1, MIGRATIONS[version](m)
    if version != SCHEMA_VERSION:
        raise ValueError(f"schema version {version} can't be read")
    return m


def _load_4(spark: SparkSession, root: str) -> tuple[int, Model]:
    """Version 4 pointed to whole versions by rows of a table."""
    try:
        last = spark.read.schema("version string, schema_version int, number long").parquet(f"{root}/current").orderBy(F.desc("number"), F.desc("version")).head()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        last = None
    if last is None:
        raise FileNotFoundError(f"no model is published in {root}")
    return last["schema_version"], Model(**{name: spark.read.schema(ddl.replace(" NOT NULL", "")).parquet(f"{root}/versions/{last['version']}/{name}") for name, ddl in TABLES.items()})


def with_provenance(m: Model) -> Model:
    """Version 4 to 5: edges that one file gives name it. Their file stands in the id at one of their ends."""
    path = lambda c: F.when(F.split(c, "::")[0].isin("symbol", "test", "bench"), F.regexp_extract(c, "^[^:]+::(.*)::[^:]*$", 1)).otherwise(F.regexp_extract(c, "^[^:]+::(.*)$", 1))
    rel, src, dst = F.col("rel"), F.col("src_id"), F.col("dst_id")
    of_dst = rel.isin("documented_by", "migrates", "specifies", "configured_by") | ((rel == "contains") & dst.startswith("source_unit::"))
    of_src = rel.isin("defines", "tested_by", "benchmarked_by", "implements", "reexports")
    found = F.coalesce("provenance_path", F.when(of_dst, path(dst)).when(of_src, path(src)))
    return m.with_tables(edges=m.edges.withColumn("provenance_path", found))


#: What brings a model of a version to the next.
MIGRATIONS: dict[int, Callable[[Model], Model]] = {4: with_provenance}


def table_counts(m: Model) -> DataFrame:
    """One row for each table with its rows. A stored model's counts are in its commit already."""
    parts = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows") for name, df in m.tables().items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def upsert_table(m: Model, name: str, new: DataFrame, order: str | None = None) -> Model:
    return m.with_tables(**{name: upsert(getattr(m, name), new, KEYS[name], order)})
