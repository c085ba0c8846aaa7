"""Table schemas, enumerated domains and identifiers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION = 5

TABLES = {
    "files": "path STRING NOT NULL, component_id STRING, kind STRING NOT NULL, hash STRING NOT NULL, indexed BOOLEAN NOT NULL, ignore_reason STRING",
    "entities": "id STRING NOT NULL, kind STRING NOT NULL, name STRING NOT NULL, component_id STRING, path STRING, language STRING, line_start INT, line_end INT, visibility STRING, exported BOOLEAN NOT NULL",
    "edges": "src_id STRING NOT NULL, rel STRING NOT NULL, dst_id STRING NOT NULL, provenance_path STRING, provenance_line INT",
    "summaries": "entity_id STRING NOT NULL, short_summary STRING NOT NULL, detailed_summary STRING, keywords ARRAY<STRING>, updated_at STRING NOT NULL, source_hash STRING",
    "task_routes": "task_name STRING NOT NULL, entity_id STRING NOT NULL, priority INT NOT NULL",
    "embeddings": "entity_id STRING NOT NULL, model STRING NOT NULL, dimensions INT NOT NULL, updated_at STRING NOT NULL, vector ARRAY<FLOAT>",
}
KEYS = {"files": ["path"], "entities": ["id"], "edges": ["src_id", "rel", "dst_id"], "summaries": ["entity_id"], "task_routes": ["task_name", "entity_id"], "embeddings": ["entity_id"]}

# The enumerated domains, in declaration order.
ENTITY_KINDS = "repo directory component source_unit symbol doc test bench task feature containerized infra_root command content_page template site migration spec workflow agent_config".split()
EDGE_KINDS = "contains defines depends_on reexports documented_by tested_by benchmarked_by related_to configured_by builds deploys implements owns_task declares_feature feature_enables migrates specifies renders".split()
FILE_KINDS = "source doc config build test migration template workflow data other".split()
VISIBILITIES = "public private internal protected".split()
TASK_CATEGORIES = "understand debug build test deploy configure general".split()


@dataclass(frozen=True)
class Model:
    """The six tables."""

    files: DataFrame
    entities: DataFrame
    edges: DataFrame
    summaries: DataFrame
    task_routes: DataFrame
    embeddings: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}

    def with_tables(self, **changed: DataFrame) -> Model:
        return Model(**(self.tables() | changed))

    @staticmethod
    def empty(spark: SparkSession) -> Model:
        return Model(**{name: spark.createDataFrame([], ddl) for name, ddl in TABLES.items()})

    def register(self) -> None:
        """Temporary views for ad-hoc SQL."""
        for name, df in self.tables().items():
            df.createOrReplaceTempView(name)


class LazyModel(Model):
    """A model whose tables are made when first asked for, so that a query plans only those that it reads."""

    def __init__(self, makers: dict[str, Callable[[], DataFrame]]):
        object.__setattr__(self, "makers", makers)

    def __getattr__(self, name: str) -> DataFrame:
        makers = object.__getattribute__(self, "makers")
        if name not in makers:
            raise AttributeError(name)
        object.__setattr__(self, name, makers[name]())
        return object.__getattribute__(self, name)


def component_id(ecosystem: Column | str, path: Column | str) -> Column:
    """component::{ecosystem}::{path}; the root path is '.'."""
    p = F.lit(path) if isinstance(path, str) else path
    e = F.lit(ecosystem) if isinstance(ecosystem, str) else ecosystem
    return F.concat_ws("::", F.lit("component"), e, F.when(p == "", ".").otherwise(p))


def component_parts(col: Column) -> tuple[Column, Column]:
    """Ecosystem and path; the path keeps later '::'. Null for other ids."""
    good = col.startswith("component::")
    return F.when(good, F.split(col, "::", 3)[1]), F.when(good, F.get(F.split(col, "::", 3), F.lit(2)))


def kind_id(kind: str, *parts: Column) -> Column:
    return F.concat_ws("::", F.lit(kind), *parts)


def checked_kind(col: Column, domain: list[str], what: str) -> Column:
    """The value, or an error for one outside its domain."""
    return F.when(col.isin(domain), col).otherwise(F.raise_error(F.concat(F.lit(f"unknown {what}: "), F.coalesce(col, F.lit("null")))))
