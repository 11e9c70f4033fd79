"""Diagnosis rules over the six tables: each yields rows of one findings table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import plan_text as pt
from .mapping import MEMORY_METRIC, flags_of_plans, memory_headroom, rank_stages, stage_metrics, stage_to_plan, top_stages
from .telemetry import metric_peaks

FINDING = ["app_id", "rule_id", "severity", "stage_id", "sql_id", "evidence"]

RSS_METRIC = "ExecutorMetrics_ProcessTreePythonRSSMemory"
GC_METRIC = "ExecutorMetrics_TotalGCTime"


@dataclass(frozen=True)
class Thresholds:
    skew_ratio: float = 5.0  # slowest task over median task
    memory_share: float = 0.9  # storage memory over its limit
    gc_share: float = 0.1  # collection time over application time
    single_task_share: float = 0.5  # one-task stage over all stage time
    rss_ratio: float = 2.0  # Python memory peak over its mean
    shuffle_share: float = 0.01  # shuffle written over input read


Tables = Mapping[str, DataFrame]
DEFAULT = Thresholds()


def _text(col: Column) -> Column:
    return col.cast("string")


def _kb(name: str) -> Column:
    """Evidence value in plain digits with two decimals."""
    return F.col(name).cast("decimal(38,2)").cast("string")


def _evidence(**values: Column) -> Column:
    pairs = [x for k, v in values.items() for x in (F.lit(k), v)]
    return F.create_map(*pairs)


def _finding(
    df: DataFrame, rule: str, severity: Column | str, evidence: Column, sql_id: Column | None = None
) -> DataFrame:
    severity = F.lit(severity) if isinstance(severity, str) else severity
    stage = F.col("stage_id") if "stage_id" in df.columns else F.lit(None).cast("int")
    sql = sql_id if sql_id is not None else F.lit(None).cast("int")
    return df.select(
        "app_id",
        F.lit(rule).alias("rule_id"),
        severity.alias("severity"),
        stage.alias("stage_id"),
        sql.alias("sql_id"),
        evidence.alias("evidence"),
    )


def app_overview(t: Tables) -> DataFrame:
    """Status, duration and the number of stages, jobs and queries per application."""
    stages = t["fact_stages"].groupBy("app_id").agg(
        F.count(F.lit(1)).alias("n_stages"),
        F.sum("executor_run_time_ms").alias("stage_time_ms"),
        F.sum(F.col("num_tasks").cast("bigint")).alias("n_tasks"),
    )
    jobs = t["map_jobs"].groupBy("app_id").agg(F.count(F.lit(1)).alias("n_jobs"))
    queries = t["dim_sql_plans"].groupBy("app_id").agg(F.count(F.lit(1)).alias("n_queries"))
    counts = ["n_stages", "stage_time_ms", "n_tasks", "n_jobs", "n_queries"]
    out = t["dim_applications"].select("app_id", "app_name", "final_status", "duration_ms")
    for part in (stages, jobs, queries):
        out = out.join(part, "app_id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})


# --- rules that look at one stage and its plan ----------------------------------


def with_nodes(stages: DataFrame, t: Tables) -> DataFrame:
    """Stages with the names of the plan nodes that ran in them: ``nodes``, and ``spilling_nodes``, those that spilled.

    Null where they are not known: applications not loaded from event logs, or
    stages outside SQL.
    """
    if {"nodes", "spilling_nodes"} <= set(stages.columns):
        return stages
    if "fact_stage_nodes" not in t:
        unknown = F.lit(None).cast("array<string>")
        return stages.withColumns({"nodes": unknown, "spilling_nodes": unknown})
    by = ["app_id", "stage_id", "attempt_id"]
    # as many names a stage as there are kinds of nodes
    names = t["fact_stage_nodes"].groupBy(*by).agg(
        F.collect_set("node_name").alias("nodes"),
        F.collect_set(F.when(F.col("spill_kb") > 0, F.col("node_name"))).alias("spilling_nodes"),
    )
    return stages.join(names, by, "left")


def plans_of_stages(t: Tables) -> DataFrame:
    return with_nodes(stage_to_plan(t["fact_stages"], t["map_jobs"], t["dim_sql_plans"]), t)


def _ran_here(*flags: str) -> Column:
    """Did one of these nodes run in the stage? Where the nodes of a stage are not known, somewhere in its query."""
    names = F.array(*[F.lit(pt.NODES[flag]) for flag in flags])
    in_query = reduce(Column.__or__, [F.col(flag) for flag in flags])
    return F.coalesce(F.arrays_overlap("nodes", names), in_query)


def _stage_rules(th: Thresholds) -> dict[str, tuple[Column, Column, Column]]:
    """rule -> (condition, severity, evidence) over a stage row with plan flags."""
    median = F.greatest(F.col("task_duration_median_ms"), F.lit(1))
    slowest = F.col("task_duration_max_ms")
    attempt = _text(F.col("attempt_id"))
    return {
        "data_skew": (
            slowest > median * th.skew_ratio,
            F.when(slowest > median * (2 * th.skew_ratio), "high").otherwise("medium"),
            _evidence(
                attempt_id=attempt,
                task_duration_max_ms=_text(slowest),
                task_duration_median_ms=_text(F.col("task_duration_median_ms")),
            ),
        ),
        "spilling_sort_merge_join": (
            _ran_here("has_sort_merge_join") & (F.col("disk_spill_kb") > 0),
            F.lit("high"),
            _evidence(attempt_id=attempt, disk_spill_kb=_kb("disk_spill_kb")),
        ),
        "healthy_broadcast_join": (
            _ran_here("has_broadcast_hash_join")
            & (F.col("input_bytes_kb") > 0)
            & (F.col("shuffle_write_kb") < F.col("input_bytes_kb") * th.shuffle_share),
            F.lit("info"),
            _evidence(
                attempt_id=attempt,
                input_bytes_kb=_kb("input_bytes_kb"),
                shuffle_write_kb=_kb("shuffle_write_kb"),
            ),
        ),
        "unpartitioned_window": (
            F.col("has_unpartitioned_window") & _ran_here("has_window") & (F.col("num_tasks") == 1),
            F.lit("high"),
            _evidence(
                attempt_id=attempt, executor_run_time_ms=_text(F.col("executor_run_time_ms"))
            ),
        ),
    }


def stage_findings(
    stage_plans: DataFrame, th: Thresholds = DEFAULT, only: Sequence[str] | None = None
) -> DataFrame:
    """All rules that need a single stage row, in one pass over the stages."""
    rules = {r: v for r, v in _stage_rules(th).items() if only is None or r in only}
    hits = [
        F.when(
            condition,
            F.struct(
                F.lit(rule).alias("rule_id"), severity.alias("severity"), evidence.alias("evidence")
            ),
        )
        for rule, (condition, severity, evidence) in rules.items()
    ]
    found = F.explode(F.filter(F.array(*hits), lambda hit: hit.isNotNull()))
    return stage_plans.withColumn("hit", found).select(
        "app_id", "hit.rule_id", "hit.severity", "stage_id", "sql_id", "hit.evidence"
    )


def data_skew(t: Tables, th: Thresholds = DEFAULT) -> DataFrame:
    return stage_findings(plans_of_stages(t), th, ["data_skew"])


def spilling_sort_merge_join(t: Tables, th: Thresholds = DEFAULT) -> DataFrame:
    return stage_findings(plans_of_stages(t), th, ["spilling_sort_merge_join"])


def healthy_broadcast_join(t: Tables, th: Thresholds = DEFAULT) -> DataFrame:
    return stage_findings(plans_of_stages(t), th, ["healthy_broadcast_join"])


def unpartitioned_window(t: Tables, th: Thresholds = DEFAULT) -> DataFrame:
    return stage_findings(plans_of_stages(t), th, ["unpartitioned_window"])


def nested_loop_join(
    t: Tables, th: Thresholds = DEFAULT, stage_plans: DataFrame | None = None
) -> DataFrame:
    """Queries that pair all rows and shuffle: reported at their heaviest stage, of those that pair where they are known."""
    stage_plans = plans_of_stages(t) if stage_plans is None else stage_plans
    looped = stage_plans.filter(F.col("has_cartesian") | F.col("has_nested_loop_join"))
    here = _ran_here("has_cartesian", "has_nested_loop_join").alias("here")
    worst = F.max(F.struct(here, F.col("shuffle_write_kb"), (-F.col("stage_id")).alias("neg_stage")))
    per_sql = (
        looped.groupBy("app_id", "sql_id")
        .agg(
            F.sum(F.col("shuffle_write_kb").cast("decimal(24,2)")).alias("shuffle_write_kb"),
            F.max("has_cartesian").alias("cartesian"),
            worst.alias("worst"),
        )
        .filter(F.col("shuffle_write_kb") > 0)
        .withColumn("stage_id", -F.col("worst.neg_stage"))
    )
    node = F.when(F.col("cartesian"), "CartesianProduct").otherwise("BroadcastNestedLoopJoin")
    evidence = _evidence(plan_node=node, shuffle_write_kb=_kb("shuffle_write_kb"))
    return _finding(per_sql, "nested_loop_join", "high", evidence, F.col("sql_id"))


def single_task_stage(t: Tables, th: Thresholds = DEFAULT) -> DataFrame:
    """Applications whose last stage ran as one task and took most of the time."""
    ran = t["fact_stages"].filter(F.col("end_time").isNotNull())
    last = F.max(
        F.struct("end_time", "stage_id", "attempt_id", "num_tasks", "executor_run_time_ms")
    )
    per_app = ran.groupBy("app_id").agg(
        last.alias("last"), F.sum("executor_run_time_ms").alias("total_ms")
    )
    hit = per_app.filter(
        (F.col("last.num_tasks") == 1)
        & (F.col("last.executor_run_time_ms") >= F.col("total_ms") * th.single_task_share)
    ).withColumn("stage_id", F.col("last.stage_id"))
    evidence = _evidence(
        executor_run_time_ms=_text(F.col("last.executor_run_time_ms")),
        stage_time_ms=_text(F.col("total_ms")),
    )
    return _finding(hit, "single_task_stage", "high", evidence)


def spill_ranking(t: Tables, th: Thresholds = DEFAULT) -> DataFrame:
    """All stages that spilled, ranked per application by how much, with the nodes that did where they are known."""
    spilled = t["fact_stages"].filter(F.col("memory_spill_kb") + F.col("disk_spill_kb") > 0)
    ranked = with_nodes(rank_stages(spilled, "spill"), t)
    evidence = _evidence(
        rank=_text(F.col("rank")),
        attempt_id=_text(F.col("attempt_id")),
        memory_spill_kb=_kb("memory_spill_kb"),
        disk_spill_kb=_kb("disk_spill_kb"),
        spilling_nodes=F.array_join(F.array_sort("spilling_nodes"), ", "),
    )
    evidence = F.map_filter(evidence, lambda _, value: value.isNotNull())
    severity = F.when(F.col("disk_spill_kb") > 0, "medium").otherwise("low")
    return _finding(ranked, "spill", severity, evidence)


RULE_METRICS = (RSS_METRIC, GC_METRIC, MEMORY_METRIC)


def rule_peaks(t: Tables) -> DataFrame:
    """Peaks of the metrics the rules read; the others stay in the scan."""
    metrics = t["fact_hardware_metrics"]
    return metric_peaks(metrics.filter(F.col("metric_name").isin(*RULE_METRICS)))


# --- rules that look at hardware metrics -----------------------------------------


def python_memory(
    t: Tables, th: Thresholds = DEFAULT, peaks: DataFrame | None = None
) -> DataFrame:
    """Python memory that spikes in an application with Python in its plans."""
    peaks = rule_peaks(t) if peaks is None else peaks
    spikes = peaks.filter(
        (F.col("metric_name") == RSS_METRIC) & (F.col("peak") > F.col("mean") * th.rss_ratio)
    )
    python = F.col("has_batch_python") | F.col("has_arrow_python")
    users = flags_of_plans(t["dim_sql_plans"]).filter(python).groupBy("app_id").agg(F.min("sql_id").alias("sql_id"))
    evidence = _evidence(executor_id=F.col("executor_id"), peak_kb=_kb("peak"), mean_kb=_kb("mean"))
    return _finding(
        spikes.join(users, "app_id"), "python_memory", "high", evidence, F.col("sql_id")
    )


def cache_limit(t: Tables, th: Thresholds = DEFAULT, peaks: DataFrame | None = None) -> DataFrame:
    """Executors whose storage memory reached its limit."""
    peaks = rule_peaks(t) if peaks is None else peaks
    full = memory_headroom(peaks, t["fact_executors"]).filter(
        F.col("used_share") >= th.memory_share
    )
    evidence = _evidence(
        executor_id=F.col("executor_id"), peak_kb=_kb("peak_kb"), limit_kb=_kb("max_memory_kb")
    )
    return _finding(full, "cache_limit", "medium", evidence)


def gc_pressure(t: Tables, th: Thresholds = DEFAULT, peaks: DataFrame | None = None) -> DataFrame:
    """Executors that spent a large share of the run on garbage collection."""
    peaks = rule_peaks(t) if peaks is None else peaks
    gc = peaks.filter(F.col("metric_name") == GC_METRIC)
    apps = t["dim_applications"].select("app_id", "duration_ms")
    heavy = gc.join(apps, "app_id").filter(
        (F.col("duration_ms") > 0) & (F.col("growth") >= F.col("duration_ms") * th.gc_share)
    )
    evidence = _evidence(
        executor_id=F.col("executor_id"),
        gc_ms=_kb("growth"),
        duration_ms=_text(F.col("duration_ms")),
    )
    return _finding(heavy, "gc_pressure", "medium", evidence)


def bottleneck_metrics(
    t: Tables, k: int = 3, by: str = "duration", bucket_s: int = 60
) -> DataFrame:
    """Hardware metrics of the worst stages only, while they ran."""
    worst = top_stages(t["fact_stages"], k, by)
    return stage_metrics(worst, t["fact_hardware_metrics"], bucket_s)
