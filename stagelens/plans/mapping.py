"""Links between the telemetry tables: stage to plan, stage to metrics, metrics to limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import plan_text as pt
from ..functions import scalars as sc
from ..operators.ordering import top_per_group

MEMORY_METRIC = "BlockManager_memory_memUsed_MB"

# Ranking columns of a bottleneck, worst first.
BOTTLENECK_BY = {
    "spill": ("memory_spill_kb", "disk_spill_kb"),
    "shuffle": ("shuffle_read_kb", "shuffle_write_kb"),
    "duration": ("executor_run_time_ms",),
}


def top_stages(stages: DataFrame, k: int = 3, by: str = "duration") -> DataFrame:
    """The ``k`` worst stages of each application by spill, shuffle or duration."""
    return top_per_group(stages, ["app_id"], _worst_first(by), k)


def _worst_first(by: str) -> list[Column]:
    weight = sum((F.col(c) for c in BOTTLENECK_BY[by]), F.lit(0))
    return [weight.desc(), F.col("stage_id"), F.col("attempt_id")]


def rank_stages(stages: DataFrame, by: str = "duration") -> DataFrame:
    """All stages with their place in their application, the worst first."""
    place = F.row_number().over(Window.partitionBy("app_id").orderBy(*_worst_first(by)))
    return stages.withColumn("rank", place)


def stage_jobs(map_jobs: DataFrame) -> DataFrame:
    """Job and query of each stage.

    A stage skipped by a later job is listed there again; the first job ran it.
    """
    listed = map_jobs.select(
        "app_id", "job_id", "sql_id", F.explode(sc.split_ids(F.col("stage_ids"))).alias("stage_id")
    )
    first = F.min(F.struct("job_id", "sql_id"))
    return (
        listed.groupBy("app_id", "stage_id")
        .agg(first.alias("j"))
        .select("app_id", "stage_id", "j.job_id", "j.sql_id")
    )


def flags_of_plans(plans: DataFrame) -> DataFrame:
    """``app_id, sql_id`` and the plan flags; plans that have their flags already are taken as they are."""
    if set(pt.FLAGS) <= set(plans.columns):
        return plans.select("app_id", "sql_id", *pt.FLAGS)
    return plans.select("app_id", "sql_id", pt.plan_flags(F.col("raw_plan")).alias("f")).select("app_id", "sql_id", "f.*")


def stage_to_plan(
    stages: DataFrame, map_jobs: DataFrame, plans: DataFrame, with_text: bool = False
) -> DataFrame:
    """Stages with their job, query and plan flags (and the plan text on request).

    Flags are taken from the plans before the join, so that the long texts stay
    out of the shuffles unless asked for.
    """
    flags = flags_of_plans(plans)
    if with_text:
        flags = plans.select("app_id", "sql_id", "plan_text", pt.plan_flags(F.col("raw_plan")).alias("f"))
        flags = flags.select("app_id", "sql_id", "f.*", "plan_text")
    # stages outside SQL match no plan; spread them instead of meeting at one null key
    spare = -1 - F.pmod(F.hash("stage_id"), F.lit(1024))
    key = F.coalesce("sql_id", spare).alias("_sql")
    linked = stages.join(stage_jobs(map_jobs), ["app_id", "stage_id"], "left").select("*", key)
    joined = linked.join(flags.withColumnRenamed("sql_id", "_sql"), ["app_id", "_sql"], "left")
    return joined.drop("_sql").withColumns({f: F.coalesce(f, F.lit(False)) for f in pt.FLAGS})


def _bucket(ts: Column, bucket_s: int) -> Column:
    return F.floor(sc.ts_to_epoch_s(ts) / F.lit(bucket_s)).cast("bigint")


def _span_buckets(stages: DataFrame, bucket_s: int) -> DataFrame:
    """Stages once per time bucket they touch; ``_edge`` marks partly covered buckets."""
    first = _bucket(F.col("start_time"), bucket_s)
    last = _bucket(F.col("end_time"), bucket_s)
    return (
        stages.filter(F.col("start_time").isNotNull() & (F.col("end_time") >= F.col("start_time")))
        .withColumn("_bucket", F.explode(F.sequence(first, last)))
        .withColumn("_edge", F.col("_bucket").isin(first, last))
    )


def metrics_during(stages: DataFrame, metrics: DataFrame, bucket_s: int = 60) -> DataFrame:
    """Metric samples taken while a stage ran (both ends included).

    An equi join on application and time bucket, then the exact bounds: a
    sample lies in one bucket, so no pair is met twice, and a long or busy
    application is spread over its buckets.
    """
    spans = _span_buckets(stages, bucket_s).drop("_edge")
    samples = metrics.withColumn("_bucket", _bucket(F.col("timestamp"), bucket_s))
    inside = F.col("timestamp").between(F.col("start_time"), F.col("end_time"))
    return spans.join(samples, ["app_id", "_bucket"]).filter(inside).drop("_bucket")


def stage_metrics(stages: DataFrame, metrics: DataFrame, bucket_s: int = 60) -> DataFrame:
    """Count, peak, mean and growth of each metric per executor while a stage ran.

    Buckets a stage covers completely are joined as one pre-aggregated row per
    series; only the first and last bucket of a stage meet single samples. NaN
    samples are left out.
    """
    by = ["app_id", "executor_id", "metric_name"]
    stage = ["app_id", "stage_id", "attempt_id"]
    v = F.col("value_kb_or_ms")
    point = F.struct("timestamp", "value_kb_or_ms")
    samples = (
        metrics.filter(v.isNotNull() & ~F.isnan(v))
        .withColumn("_bucket", _bucket(F.col("timestamp"), bucket_s))
        .select(
            *by,
            "_bucket",
            "timestamp",
            F.lit(1).cast("bigint").alias("n"),
            v.alias("peak"),
            v.cast("decimal(38,2)").alias("total"),
            point.alias("first"),
            point.alias("last"),
        )
    )
    merge = [
        F.sum("n").alias("n"),
        F.max("peak").alias("peak"),
        F.sum("total").cast("decimal(38,2)").alias("total"),
        F.min("first").alias("first"),
        F.max("last").alias("last"),
    ]
    states = [*by[1:], "n", "peak", "total", "first", "last"]
    per_bucket = samples.groupBy(*by, "_bucket").agg(*merge)
    spans = _span_buckets(stages, bucket_s).select(
        *stage, "start_time", "end_time", "_bucket", "_edge"
    )
    whole = spans.filter(~F.col("_edge")).join(per_bucket, ["app_id", "_bucket"])
    inside = F.col("timestamp").between(F.col("start_time"), F.col("end_time"))
    edges = spans.filter("_edge").join(samples, ["app_id", "_bucket"]).filter(inside)
    both = whole.select(*stage, *states).unionByName(edges.select(*stage, *states))
    return (
        both.groupBy(*stage, "executor_id", "metric_name")
        .agg(*merge)
        .select(
            *stage,
            "executor_id",
            "metric_name",
            F.col("n").alias("n_samples"),
            "peak",
            (F.col("total").cast("double") / F.col("n")).alias("mean"),
            F.bround(F.col("last.value_kb_or_ms") - F.col("first.value_kb_or_ms"), 2).alias("growth"),
        )
    )


def memory_headroom(peaks: DataFrame, executors: DataFrame) -> DataFrame:
    """Peak storage memory of each executor against its limit."""
    used = peaks.filter(F.col("metric_name") == MEMORY_METRIC).select(
        "app_id", "executor_id", F.col("peak").alias("peak_kb")
    )
    limits = executors.groupBy("app_id", "executor_id").agg(
        F.max("max_memory_kb").alias("max_memory_kb")
    )
    return used.join(limits, ["app_id", "executor_id"]).withColumn(
        "used_share", F.try_divide("peak_kb", "max_memory_kb")
    )
