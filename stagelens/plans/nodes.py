"""Plan nodes of event logs: which nodes ran in which stage, and what they counted there."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..sources import event_log as el
from ..sources.tables import stored

# Names of node metrics.
ROWS_METRIC, SPILL_METRIC = "number of output rows", "spill size"
# Fixed value: nodes a worker holds before it hands them on.
NODES_A_BATCH = 5000

_NODE = [
    ("app_id", pa.string()), ("sql_id", pa.int32()), ("node_id", pa.int32()), ("parent_id", pa.int32()), ("part", pa.int32()),
    ("node_name", pa.string()), ("metrics", pa.list_(pa.struct([("accumulator_id", pa.int64()), ("name", pa.string())]))),
]
_NODE_TYPE = (
    "app_id string, sql_id int, node_id int, parent_id int, part int, node_name string, "
    "metrics array<struct<accumulator_id: bigint, name: string>>"
)


def _starts_part(name: str, parent: str) -> bool:
    """Does a node run in other stages than its parent? Exchanges, subqueries and cached plans do."""
    exchange = name.endswith("Exchange") and name != "ReusedExchange"
    return exchange or name.startswith("Subquery") or parent.startswith("InMemoryTableScan")


def tree_nodes(info: str) -> list[dict]:
    """Nodes of a plan tree in the order of its text, the root first; none for text that is no such tree.

    ``part`` is the first node of the part a node belongs to: what lies between
    two exchanges runs in the same stages. An exchange leads the part that writes it.
    """
    try:
        root = json.loads(info)
    except (ValueError, RecursionError):
        return []
    if not isinstance(root, dict):
        return []
    found: list[dict] = []
    waiting = [(root, None)]
    while waiting:
        node, parent = waiting.pop()
        at, name = len(found), str(node.get("nodeName", ""))
        leads = parent is None or _starts_part(name, parent["node_name"])
        row = {
            "node_id": at,
            "parent_id": None if parent is None else parent["node_id"],
            "part": at if leads else parent["part"],
            "node_name": name,
            "metrics": [
                {"accumulator_id": m["accumulatorId"], "name": m.get("name")}
                for m in node.get("metrics") or []
                if isinstance(m.get("accumulatorId"), int)
            ],
        }
        found.append(row)
        waiting += [(child, row) for child in reversed(node.get("children") or [])]
    return found


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of many plans a batch: a batch for each plan costs far more than its walk."""
    schema, found = pa.schema(_NODE), []
    for batch in batches:
        for row in batch.to_pylist():
            head = {"app_id": row["app_id"], "sql_id": row["sql_id"]}
            found += [{**head, **node} for node in tree_nodes(row["info"])]
            if len(found) >= NODES_A_BATCH:
                yield pa.RecordBatch.from_pylist(found, schema)
                found = []
    yield pa.RecordBatch.from_pylist(found, schema)


def plan_nodes(events: DataFrame) -> DataFrame:
    """Nodes of the last plan of each query: ``app_id, sql_id, node_id, parent_id, part, node_name, metrics``.

    A tree of any depth has no column type, so one plan at a time is walked in
    Python; plans are as many as queries, not as tasks.
    """
    kinds = el.events_of(events, "sql_start", "sql_update")
    info = F.nullif("sparkPlanInfo", F.lit(""))
    last = kinds.groupBy("app_id", F.col("executionId").alias("sql_id")).agg(
        F.max_by(info, F.when(info.isNotNull(), F.col("place"))).alias("info")
    )
    return last.filter("info is not null").mapInArrow(_walk, _NODE_TYPE)


def stage_counters(events: DataFrame) -> DataFrame:
    """Counters of plan nodes that tasks of a stage raised: ``app_id, stage_id, attempt_id, accumulator_id, value``.

    Read from the end of a stage, which lists each counter once however many
    tasks raised it; the value is what all stages so far have counted.
    """
    info = F.col("`Stage Info`")
    listed = el.events_of(events, "stage_completed").select(
        "app_id",
        info["Stage ID"].alias("stage_id"),
        F.coalesce(info["Stage Attempt ID"], F.lit(0)).alias("attempt_id"),
        F.explode(F.filter(info["Accumulables"], lambda a: a["Metadata"] == "sql")).alias("a"),
    )
    return listed.select(
        "app_id", "stage_id", "attempt_id", F.col("a.ID").alias("accumulator_id"), F.expr("try_cast(a.Value as bigint)").alias("value")
    )


def node_metrics(nodes: DataFrame, counters: DataFrame) -> DataFrame:
    """Total of each metric of each node over the whole query; 0 where no task raised it.

    A repeated stage counts again, as it does in Spark's own display.
    """
    metrics = nodes.select("app_id", "sql_id", "node_id", "node_name", F.explode("metrics").alias("m")).select(
        "app_id", "sql_id", "node_id", "node_name", F.col("m.name").alias("metric_name"), F.col("m.accumulator_id").alias("accumulator_id")
    )
    totals = counters.groupBy("app_id", "accumulator_id").agg(F.max("value").alias("value"))
    return metrics.join(totals, ["app_id", "accumulator_id"], "left").select(
        "app_id", "sql_id", "node_id", "node_name", "metric_name", F.coalesce("value", F.lit(0)).alias("value")
    )


def stage_nodes(events: DataFrame) -> DataFrame:
    """Nodes that ran in each stage: ``fact_stage_nodes``, one row for a stage attempt and node.

    A counter ties a stage to a node, and so to the node's part of the plan; all
    nodes of that part ran there, also those that passed no row. An exchange
    counts on both sides of its border, so it ties nothing by itself.
    ``rows_out`` and ``spill_kb`` are the node's totals over the query, null
    where it does not count them.
    """
    # each plan is walked once
    nodes, counters = stored(plan_nodes(events), "plan-nodes"), stage_counters(events)
    ties = nodes.filter(~F.col("node_name").endswith("Exchange")).select(
        "app_id", "sql_id", "part", F.explode("metrics.accumulator_id").alias("accumulator_id")
    )
    stage = ["app_id", "stage_id", "attempt_id"]
    ran = counters.join(ties, ["app_id", "accumulator_id"]).select(*stage, "sql_id", "part").distinct()

    def total(metric: str):
        return F.max(F.when(F.col("metric_name") == metric, F.col("value")))

    totals = node_metrics(nodes, counters).groupBy("app_id", "sql_id", "node_id").agg(
        total(ROWS_METRIC).alias("rows_out"), total(SPILL_METRIC).alias("spill")
    )
    return (
        ran.join(nodes.drop("metrics"), ["app_id", "sql_id", "part"])
        .join(totals, ["app_id", "sql_id", "node_id"], "left")
        .withColumn("spill_kb", F.when(F.col("spill").isNotNull(), sc.to_kb(F.col("spill"))))
    )
