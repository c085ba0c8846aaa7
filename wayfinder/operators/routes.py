"""Task routes: which tasks an entity helps with, by rules on its kind, name and path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Tasks and priorities by kind.
RULES = {
    "component": (("understand", 80), ("architecture", 80), ("build", 70), ("implement", 70)),
    "symbol": (("build", 50), ("implement", 50)),
    "test": (("test", 80), ("bench", 40), ("debug", 60), ("fix", 60)),
    "doc": (("understand", 70), ("architecture", 70)),
    "content_page": (("understand", 60), ("build", 40)),
    "template": (("build", 60), ("understand", 40)),
    "site": (("understand", 70), ("deploy", 70), ("build", 60)),
    "migration": (("build", 60), ("debug", 50)),
    "spec": (("understand", 70), ("test", 60), ("debug", 50)),
    "workflow": (("configure", 60), ("build", 40)),
    "agent_config": (("configure", 70), ("understand", 60)),
    "feature": (("configure", 70), ("setup", 70)),
    "bench": (("test", 80), ("bench", 80)),
    "containerized": (("deploy", 80),),
    "infra_root": (("deploy", 80), ("configure", 70)),
    "command": (("deploy", 70), ("build", 50)),
}
SOURCE_UNIT = (("debug", 50), ("fix", 50), ("build", 40), ("implement", 40))
ENTRY_UNIT, PLAIN_UNIT = 60, 30
TASK_BY_NAME = ((("deploy", "release", "ci"), (("deploy", 80), ("release", 80))), (("test",), (("test", 70), ("bench", 40))), (("build",), (("build", 70), ("implement", 40))))
CONFIG = (("configure", 60), ("setup", 60))


def _array(rules):
    return F.array(*(F.struct(F.lit(t).alias("task_name"), F.lit(p).alias("priority")) for t, p in rules))


def task_routes(entities: DataFrame) -> DataFrame:
    """task_name, entity_id, priority; a rule on names with 'config' overrides one on kinds. No join: the rules are expressions."""
    name, path = F.lower("name"), F.lower(F.coalesce("path", F.lit("")))
    by_kind = F.lit(None).cast("array<struct<task_name:string,priority:int>>")
    for kind, rules in RULES.items():
        by_kind = F.when(F.col("kind") == kind, _array(rules)).otherwise(by_kind)
    first = F.when(path.endswith("mod.rs") | path.endswith("lib.rs"), ENTRY_UNIT).otherwise(PLAIN_UNIT)
    unit = F.concat(F.array(*(F.struct(F.lit(t).alias("task_name"), first.alias("priority")) for t in ("understand", "architecture"))), _array(SOURCE_UNIT))
    task = F.lit(None).cast("array<struct<task_name:string,priority:int>>")
    for words, rules in reversed(TASK_BY_NAME):
        hit = F.lit(False)
        for w in words:
            hit = hit | name.contains(w)
        task = F.when(hit, _array(rules)).otherwise(task)
    general = F.coalesce(F.when(F.col("kind") == "source_unit", unit).when(F.col("kind") == "task", task).otherwise(by_kind), F.array().cast("array<struct<task_name:string,priority:int>>"))
    later = F.when(name.contains("config") | path.contains("config"), _array(CONFIG)).otherwise(F.array().cast("array<struct<task_name:string,priority:int>>"))
    kept = F.filter(general, lambda r: ~F.exists(later, lambda x: x["task_name"] == r["task_name"]))
    return entities.select(F.col("id").alias("entity_id"), F.explode(F.concat(kept, later)).alias("r")).select("r.task_name", "entity_id", "r.priority")
