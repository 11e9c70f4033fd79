"""Names of hardware metric series."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The metrics the diagnosis reads.
TARGET_METRICS = (
    "jvm_heap_used",
    "jvm_pools_G1_Old_Gen_used",
    "ExecutorMetrics_JVMOffHeapMemory",
    "ExecutorMetrics_ProcessTreePythonRSSMemory",
    "ExecutorMetrics_TotalGCTime",
    "ExecutorMetrics_MajorGCTime",
    "BlockManager_memory_memUsed_MB",
    "BlockManager_disk_diskSpaceUsed_MB",
)


def series_prefix(app_id: Column) -> Column:
    """``spark_<app>_`` with dashes of the application id turned to underscores."""
    return F.concat(F.lit("spark_"), F.translate(app_id, "-", "_"), F.lit("_"))


def _after_prefix(name: Column, app_id: Column) -> Column:
    return F.substring(name, F.length(series_prefix(app_id)) + 1, F.length(name))


def series_parts(name: Column, app_id: Column) -> Column:
    """struct(executor_id, metric_name) of one series name."""
    rest = _after_prefix(name, app_id)
    executor = F.split_part(rest, F.lit("_"), F.lit(1))
    metric = F.substring(rest, F.length(executor) + 2, F.length(rest))
    return F.struct(executor.alias("executor_id"), metric.alias("metric_name"))


def is_target_series(name: Column, app_id: Column) -> Column:
    """Does the series belong to the application and end with a target metric?"""
    rest = _after_prefix(name, app_id)
    ends = F.lit(False)
    for metric in TARGET_METRICS:
        ends = ends | rest.endswith(metric)
    return name.startswith(series_prefix(app_id)) & ends
