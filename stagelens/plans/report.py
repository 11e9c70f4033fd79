"""The findings table: every rule, ranked, with cause, place in the Spark UI and fix."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources.tables import read_table, write_table
from . import rules
from .mapping import flags_of_plans
from .rules import DEFAULT, Tables, Thresholds

SEVERITIES = ("high", "medium", "low", "info")

# rule -> (root cause, where to see it, what to change)
RULE_TEXT = {
    "data_skew": (
        "A few tasks of this stage got far more data than the others, so the stage waits for them.",
        "Jobs/Stages Tab: in the task summary the maximum duration is far above the median.",
        "Turn on spark.sql.adaptive.skewJoin.enabled, or salt the heavy key before the join or "
        "aggregation.",
    ),
    "spilling_sort_merge_join": (
        "Both sides of a join are sorted, and the data did not fit into memory, so it went to disk.",
        "SQL Tab: a SortMergeJoin node. Jobs/Stages Tab: Spill (Disk) above zero.",
        "Broadcast the smaller side with F.broadcast(df) if its size is known to be small, or "
        "raise spark.sql.shuffle.partitions.",
    ),
    "healthy_broadcast_join": (
        "The small side was sent to every executor, so the large side was not moved: this is good.",
        "SQL Tab: a BroadcastHashJoin node. Jobs/Stages Tab: large input, hardly any shuffle write.",
        "Nothing to change.",
    ),
    "python_memory": (
        "A Python function handles rows outside the JVM and its worker memory spiked.",
        "SQL Tab: a BatchEvalPython or ArrowEvalPython node. Executors Tab: Python memory peak.",
        "Use built-in functions, else a pandas_udf with a smaller "
        "spark.sql.execution.arrow.maxRecordsPerBatch.",
    ),
    "cache_limit": (
        "Cached data filled the storage memory of an executor.",
        "Executors Tab: Storage Memory at its limit. Storage Tab: the cached tables.",
        "Call unpersist() on tables no longer needed, or cache with StorageLevel.DISK_ONLY.",
    ),
    "single_task_stage": (
        "The last stage ran as a single task while the other cores were idle.",
        "Jobs/Stages Tab: the last stage shows 1/1 tasks and most of the run time.",
        "Drop coalesce(1) or limits before wide work, and partition the last step by a key.",
    ),
    "nested_loop_join": (
        "Every row of one table is paired with every row of another.",
        "SQL Tab: a CartesianProduct or BroadcastNestedLoopJoin node.",
        "Join on an equality condition; for ranges, join on a bucket of the range first.",
    ),
    "gc_pressure": (
        "The JVM spent much of the run on collecting short-lived objects.",
        "Executors Tab: GC Time is a large share of Task Time.",
        "Avoid wide explode() fan-outs, or give executors more memory.",
    ),
    "unpartitioned_window": (
        "A running calculation over the whole table is done by one task.",
        "SQL Tab: a Window node above an Exchange SinglePartition. Jobs/Stages Tab: 1/1 tasks.",
        "Add partitionBy(...) to the window, or compute the sum in ranges and add offsets.",
    ),
    "spill": (
        "Data of a sort or aggregation did not fit into executor memory.",
        "Jobs/Stages Tab: Spill (Memory) and Spill (Disk) columns.",
        "Raise spark.sql.shuffle.partitions or executor memory, and drop columns early.",
    ),
}


def _step(df: DataFrame, label: str) -> DataFrame:
    path = scratch_path(df.sparkSession, label)
    write_table(df, path)
    return read_table(df.sparkSession, path)


def all_findings(t: Tables, th: Thresholds = DEFAULT) -> DataFrame:
    """Rows of all rules.

    Plans, stages and metric samples are read once each: into plan flags, stages
    with the flags of their query, and peaks of the metrics the rules ask for.
    These narrow tables are written, and the rules read them.
    """
    t = {**t, "dim_sql_plans": _step(flags_of_plans(t["dim_sql_plans"]), "plan-flags")}
    stage_plans = _step(rules.plans_of_stages(t), "stage-plans")
    peaks = _step(rules.rule_peaks(t), "rule-peaks")
    t = {**t, "fact_stages": stage_plans}
    parts = [
        rules.stage_findings(stage_plans, th),
        rules.nested_loop_join(t, th, stage_plans),
        rules.single_task_stage(t, th),
        rules.spill_ranking(t, th),
        rules.python_memory(t, th, peaks),
        rules.cache_limit(t, th, peaks),
        rules.gc_pressure(t, th, peaks),
    ]
    return reduce(DataFrame.unionByName, parts)


def report(t: Tables, th: Thresholds = DEFAULT) -> DataFrame:
    """One row per finding, worst first within each application."""
    found = all_findings(t, th)
    text = found.sparkSession.createDataFrame(
        [(rule, *words) for rule, words in RULE_TEXT.items()],
        "rule_id string, root_cause string, spark_ui_mapping string, recommended_fix string",
    )
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity"))
    # one row per rule: the text table has a fixed size
    return (
        found.join(F.broadcast(text), "rule_id")
        .withColumn("severity_rank", rank.cast("int"))
        .select(*rules.FINDING, "severity_rank", "root_cause", "spark_ui_mapping", "recommended_fix")
        .orderBy("app_id", "severity_rank", "rule_id", "stage_id")
    )
