"""The six telemetry tables, from landed documents or from event logs.

Both builders return one lazy plan per table over all applications at once.
Column order is the contract with readers of the store.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import plan_text as pt
from ..functions import scalars as sc
from ..functions import series as se
from ..operators.aggregates import order_stats
from ..sources import event_log as el
from ..sources import landing as ld
from .nodes import stage_nodes

TABLES = {
    "dim_applications": (
        "app_id string, app_name string, start_time timestamp_ntz, end_time timestamp_ntz, "
        "duration_ms bigint, final_status string"
    ),
    "fact_stages": (
        "app_id string, stage_id int, attempt_id int, start_time timestamp_ntz, "
        "end_time timestamp_ntz, num_tasks int, executor_run_time_ms bigint, "
        "input_bytes_kb double, shuffle_read_kb double, shuffle_write_kb double, "
        "memory_spill_kb double, disk_spill_kb double, task_duration_median_ms bigint, "
        "task_duration_max_ms bigint"
    ),
    "fact_executors": (
        "app_id string, executor_id string, host_ip string, total_cores int, "
        "max_memory_kb double, is_active boolean, exit_reason string"
    ),
    "dim_sql_plans": (
        "app_id string, sql_id int, description string, plan_text string, raw_plan string, duration_ms bigint"
    ),
    "fact_hardware_metrics": (
        "app_id string, timestamp timestamp_ntz, executor_id string, metric_name string, "
        "value_kb_or_ms double"
    ),
    "map_jobs": "app_id string, job_id int, sql_id int, stage_ids string",
}

# What only event logs tell; the store keeps it where a load has it.
LOG_TABLES = {
    "fact_stage_nodes": (
        "app_id string, sql_id int, stage_id int, attempt_id int, node_id int, parent_id int, node_name string, "
        "rows_out bigint, spill_kb double"
    ),
}


def conform(df: DataFrame, table: str) -> DataFrame:
    """Columns by name, in contract order and type."""
    types = [part.split() for part in {**TABLES, **LOG_TABLES}[table].split(", ")]
    return df.select(*[F.col(c).cast(t).alias(c) for c, t in types])


# --- building blocks shared by both sources ---------------------------------


def attach_task_quantiles(stages: DataFrame, summaries: DataFrame) -> DataFrame:
    """Median and maximum task time per stage attempt; 0 without a full summary.

    ``summaries`` holds ``app_id, stage_id, attempt_id, quantiles`` with the
    quantiles 0, 0.5 and 1.
    """
    full = F.size("quantiles") >= 3

    def at(i: int) -> Column:
        return F.when(full, F.col("quantiles")[i]).otherwise(0).cast("bigint")

    joined = stages.join(summaries, ["app_id", "stage_id", "attempt_id"], "left")
    return joined.withColumns(
        {"task_duration_median_ms": at(1), "task_duration_max_ms": at(2)}
    ).drop("quantiles")


def build_job_map(jobs: DataFrame, sql_jobs: DataFrame) -> DataFrame:
    """Which query each job ran for.

    ``jobs``: ``app_id, job_id, sql_id, stage_ids``. ``sql_jobs``: ``app_id,
    sql_id, place`` and ``job_ids``, the jobs the query reports. A query's own
    report beats the job's, the last query in list order beats earlier ones,
    and a job known only to a query is added without stages.
    """
    claimed = (
        sql_jobs.select("app_id", "sql_id", "place", F.explode("job_ids").alias("job_id"))
        .groupBy("app_id", "job_id")
        .agg(F.max_by("sql_id", "place").alias("claimed_sql_id"))
    )
    return jobs.join(claimed, ["app_id", "job_id"], "full_outer").select(
        "app_id",
        "job_id",
        F.coalesce("claimed_sql_id", "sql_id").cast("int").alias("sql_id"),
        F.coalesce("stage_ids", F.lit("")).alias("stage_ids"),
    )


def stage_totals(tasks: DataFrame, more: Mapping[str, Column] | None = None) -> DataFrame:
    """Per stage attempt: task count, run time and byte totals (in KB).

    ``more`` adds aggregates of the caller to the same pass.
    """
    by = ["app_id", "stage_id", "attempt_id"]
    return tasks.groupBy(*by).agg(
        F.count(F.lit(1)).cast("int").alias("num_tasks"),
        F.sum("run_time_ms").alias("executor_run_time_ms"),
        sc.to_kb(F.sum("input_bytes")).alias("input_bytes_kb"),
        sc.to_kb(F.sum("shuffle_read_bytes")).alias("shuffle_read_kb"),
        sc.to_kb(F.sum("shuffle_write_bytes")).alias("shuffle_write_kb"),
        sc.to_kb(F.sum("memory_spill_bytes")).alias("memory_spill_kb"),
        sc.to_kb(F.sum("disk_spill_bytes")).alias("disk_spill_kb"),
        *[c.alias(name) for name, c in (more or {}).items()],
    )


def task_quantiles(tasks: DataFrame) -> DataFrame:
    """Quantiles 0, 0.5 (upper median) and 1 of task run time per stage attempt."""
    by = ["app_id", "stage_id", "attempt_id"]
    return order_stats(tasks, by, "run_time_ms").select(
        *by, F.array("lo", "mid", "hi").alias("quantiles")
    )


def last_per_second(samples: DataFrame) -> DataFrame:
    """One sample per second and series: the last; equal times keep the larger value."""
    by = ["app_id", "executor_id", "metric_name"]
    last = F.max(F.struct("timestamp", "value_kb_or_ms"))["value_kb_or_ms"]
    return samples.groupBy(*by, sc.truncate_second(F.col("timestamp")).alias("second")).agg(
        last.alias("value_kb_or_ms")
    ).withColumnRenamed("second", "timestamp")


def fill_seconds(per_second: DataFrame, lookback_s: int = 300, bucket_s: int = 3600) -> DataFrame:
    """One-second grid in which a sample stands until the next one, at most ``lookback_s``.

    ``per_second`` holds at most one sample per second and series. The next
    sample is looked up inside time buckets, and across them among the first
    samples of the buckets, so a long series is spread over its buckets.
    """
    by = ["app_id", "executor_id", "metric_name"]
    at = sc.ts_to_epoch_s(F.col("timestamp"))
    samples = per_second.withColumn("_s", at).withColumn(
        "_bucket", F.floor(F.col("_s") / F.lit(bucket_s)).cast("bigint")
    )
    firsts = samples.groupBy(*by, "_bucket").agg(F.min("_s").alias("_first"))
    following = F.lead("_first").over(Window.partitionBy(*by).orderBy("_bucket"))
    firsts = firsts.select(*by, "_bucket", following.alias("_following"))
    inside = F.lead("_s").over(Window.partitionBy(*by, "_bucket").orderBy("_s"))
    until = F.least(
        F.coalesce("_next", "_following", F.col("_s") + lookback_s + 1) - 1, F.col("_s") + lookback_s
    )
    return (
        samples.withColumn("_next", inside)
        .join(firsts, [*by, "_bucket"])
        .withColumn("_second", F.explode(F.sequence(F.col("_s"), until)))
        .select("app_id", sc.epoch_s_to_ts(F.col("_second")).alias("timestamp"), *by[1:], "value_kb_or_ms")
    )


def clip_to_app(samples: DataFrame, apps: DataFrame, pad_s: int = 5) -> DataFrame:
    """Samples within the run time of their application, padded on both sides."""
    pad = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(pad_s))
    bounds = apps.select(
        "app_id", (F.col("start_time") - pad).alias("_from"), (F.col("end_time") + pad).alias("_to")
    )
    inside = F.col("timestamp").between(F.col("_from"), F.col("_to"))
    return samples.join(bounds, "app_id").filter(inside).drop("_from", "_to")


def metric_peaks(metrics: DataFrame) -> DataFrame:
    """Peak, mean and growth per executor and metric; NaN samples are left out.

    Values have two decimals, so a decimal sum is exact in any order. Growth is
    last minus first, the total for cumulative counters such as GC time.
    """
    v = F.col("value_kb_or_ms")
    clean = metrics.filter(v.isNotNull() & ~F.isnan(v))
    pair = F.struct("timestamp", "value_kb_or_ms")
    return clean.groupBy("app_id", "executor_id", "metric_name").agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.max(v).alias("peak"),
        (F.sum(v.cast("decimal(24,2)")).cast("double") / F.count(F.lit(1))).alias("mean"),
        F.bround(F.max(pair)["value_kb_or_ms"] - F.min(pair)["value_kb_or_ms"], 2).alias("growth"),
    )


# --- landed documents --------------------------------------------------------


def first_attempt(apps: DataFrame) -> DataFrame:
    """The first listed attempt of each application."""
    return apps.withColumn("attempt", F.try_element_at("attempts", F.lit(1)))


def completed_only(apps: DataFrame) -> DataFrame:
    return apps.filter(F.coalesce(F.col("attempt.completed"), F.lit(False)))


def _applications(apps: DataFrame, as_of: Column) -> DataFrame:
    done = F.coalesce(F.col("attempt.completed"), F.lit(False))
    return apps.select(
        F.col("id").alias("app_id"),
        F.col("name").alias("app_name"),
        sc.parse_gmt(F.col("attempt.startTime")).alias("start_time"),
        sc.app_end(done, sc.parse_gmt(F.col("attempt.endTime")), as_of).alias("end_time"),
        F.coalesce("attempt.duration", F.lit(0)).alias("duration_ms"),
        # the documents carry no outcome; this constant is what readers expect
        F.lit("SUCCEEDED").alias("final_status"),
    )


def _stages(stages: DataFrame, summaries: DataFrame) -> DataFrame:
    flat = stages.select(
        "app_id",
        F.col("stageId").alias("stage_id"),
        F.coalesce("attemptId", F.lit(0)).alias("attempt_id"),
        sc.parse_gmt(F.col("submissionTime")).alias("start_time"),
        sc.parse_gmt(F.col("completionTime")).alias("end_time"),
        F.col("numTasks").alias("num_tasks"),
        F.coalesce("executorRunTime", F.lit(0)).alias("executor_run_time_ms"),
        sc.to_kb(F.col("inputBytes")).alias("input_bytes_kb"),
        sc.to_kb(F.col("shuffleReadBytes")).alias("shuffle_read_kb"),
        sc.to_kb(F.col("shuffleWriteBytes")).alias("shuffle_write_kb"),
        # a missing memory spill counts as one byte, which rounds to 0.00 KB
        sc.to_kb(F.coalesce("memoryBytesSpilled", F.lit(1))).alias("memory_spill_kb"),
        sc.to_kb(F.col("diskBytesSpilled")).alias("disk_spill_kb"),
    )
    quantiles = summaries.select(
        "app_id", "stage_id", "attempt_id", F.col("executorRunTime").alias("quantiles")
    )
    return attach_task_quantiles(flat, quantiles)


def _sql_plans(sql: DataFrame, details: DataFrame) -> DataFrame:
    plan = pt.first_plan(F.col("planDescription"), F.col("physicalPlanDescription"))
    cleaned = details.select("app_id", "sql_id", pt.clean_plan(plan).alias("plan_text"), plan.alias("raw_plan"))
    return sql.select("app_id", F.col("id").alias("sql_id"), "description", "duration").join(
        cleaned, ["app_id", "sql_id"], "left"
    ).select(
        "app_id",
        "sql_id",
        F.coalesce("description", F.lit("")).alias("description"),
        F.coalesce("plan_text", F.lit("")).alias("plan_text"),
        F.coalesce("raw_plan", F.lit("")).alias("raw_plan"),
        F.coalesce("duration", F.lit(0)).alias("duration_ms"),
    )


def _job_map(jobs: DataFrame, sql: DataFrame, details: DataFrame) -> DataFrame:
    own = jobs.select(
        "app_id",
        F.col("jobId").alias("job_id"),
        F.col("sqlExecutionId").alias("sql_id"),
        sc.join_ids(F.col("stageIds")).alias("stage_ids"),
    )
    none = F.array().cast("array<int>")
    listed = details.select(
        "app_id",
        "sql_id",
        F.concat(
            *[
                F.coalesce(F.col(c), none)
                for c in ("successJobIds", "failedJobIds", "runningJobIds")
            ]
        ).alias("job_ids"),
    )
    # place in the list where there is one; ids ascend in the list otherwise
    order = sql.select(
        "app_id",
        F.col("id").alias("sql_id"),
        F.struct(F.coalesce("position", F.lit(0)), F.col("id")).alias("place"),
    )
    return build_job_map(own, order.join(listed, ["app_id", "sql_id"]))


def _executors(executors: DataFrame) -> DataFrame:
    return executors.select(
        "app_id",
        F.col("id").alias("executor_id"),
        sc.host_of(F.col("hostPort")).alias("host_ip"),
        F.col("totalCores").alias("total_cores"),
        sc.to_kb(F.col("maxMemory")).alias("max_memory_kb"),
        F.col("isActive").alias("is_active"),
        F.coalesce(F.try_element_at("executorLogs", F.lit("exitReason")), F.lit("N/A")).alias(
            "exit_reason"
        ),
    )


def filter_target_metrics(series: DataFrame) -> DataFrame:
    """Series of the diagnosis metrics of their own application."""
    return series.filter(se.is_target_series(F.col("series"), F.col("app_id")))


def explode_samples(series: DataFrame) -> DataFrame:
    """One row per sample: naive UTC time, executor, metric, value in KB or ms."""
    parts = se.series_parts(F.col("series"), F.col("app_id"))
    sample = F.col("sample")
    value = F.try_element_at(sample, F.lit(2)).try_cast("double")
    epoch = F.try_element_at(sample, F.lit(1)).try_cast("double")
    return (
        series.withColumn("part", parts)
        .withColumn("sample", F.explode("values"))
        .select(
            "app_id",
            sc.epoch_s_to_ts(epoch).alias("timestamp"),
            F.col("part.executor_id").alias("executor_id"),
            F.col("part.metric_name").alias("metric_name"),
            sc.metric_value(F.col("series"), value).alias("value_kb_or_ms"),
        )
    )


def build_telemetry(
    spark: SparkSession,
    landing: str,
    layout: str = "response",
    app_documents: DataFrame | None = None,
    as_of: str | None = None,
) -> dict[str, DataFrame]:
    """Six tables from landed documents of completed applications.

    ``app_documents`` narrows the load to some application documents, as many as
    one load should hold: their ids come to the driver, and only the folders of
    these applications are listed and read. With ``as_of`` unfinished
    applications are kept and end at that time.
    """
    found = ld.read_apps(spark, landing, layout) if app_documents is None else app_documents
    # an application may be listed by several responses
    found = first_attempt(found).dropDuplicates(["id"])
    if as_of is None:
        apps = _applications(completed_only(found), F.lit(None).cast("timestamp_ntz"))
    else:
        apps = _applications(found, F.lit(as_of).cast("timestamp_ntz"))
    ids = apps.select("app_id")
    only = None if app_documents is None else [r["app_id"] for r in ids.distinct().collect()]

    def of_done(df: DataFrame) -> DataFrame:
        return df.join(ids, "app_id", "left_semi")

    sql = of_done(ld.read_sql_list(spark, landing, layout, only))
    details = ld.read_sql_details(spark, landing, layout, only)
    series = filter_target_metrics(ld.read_metric_matrix(spark, landing, layout, only))
    tables = {
        "dim_applications": apps,
        "fact_stages": _stages(
            of_done(ld.read_stages(spark, landing, layout, only)),
            ld.read_task_summaries(spark, landing, layout, only),
        ),
        "fact_executors": _executors(of_done(ld.read_executors(spark, landing, layout, only))),
        "dim_sql_plans": _sql_plans(sql, details),
        "fact_hardware_metrics": clip_to_app(explode_samples(series), apps),
        "map_jobs": _job_map(of_done(ld.read_jobs(spark, landing, layout, only)), sql, details),
    }
    return {name: conform(df, name) for name, df in tables.items()}


# --- event logs ----------------------------------------------------------------

# Metric name -> bytes or milliseconds in the task's executor metrics.
_EXECUTOR_METRICS = {
    "jvm_heap_used": "JVMHeapMemory",
    "ExecutorMetrics_JVMOffHeapMemory": "JVMOffHeapMemory",
    "ExecutorMetrics_ProcessTreePythonRSSMemory": "ProcessTreePythonRSSMemory",
    "ExecutorMetrics_TotalGCTime": "TotalGCTime",
    "ExecutorMetrics_MajorGCTime": "MajorGCTime",
}


def tasks_of(events: DataFrame) -> DataFrame:
    """One row per finished task attempt."""
    m, i = F.col("`Task Metrics`"), F.col("`Task Info`")
    read = m["Shuffle Read Metrics"]
    return el.events_of(events, "task_end").select(
        "app_id",
        F.col("`Stage ID`").alias("stage_id"),
        F.coalesce("`Stage Attempt ID`", F.lit(0)).alias("attempt_id"),
        i["Executor ID"].alias("executor_id"),
        i["Task ID"].alias("task_id"),
        i["Launch Time"].alias("launch_ms"),
        i["Finish Time"].alias("finish_ms"),
        F.coalesce(i["Failed"], F.lit(False)).alias("failed"),
        F.coalesce(m["Executor Run Time"], F.lit(0)).alias("run_time_ms"),
        m["Input Metrics"]["Bytes Read"].alias("input_bytes"),
        (
            F.coalesce(read["Remote Bytes Read"], F.lit(0))
            + F.coalesce(read["Local Bytes Read"], F.lit(0))
        ).alias("shuffle_read_bytes"),
        m["Shuffle Write Metrics"]["Shuffle Bytes Written"].alias("shuffle_write_bytes"),
        m["Memory Bytes Spilled"].alias("memory_spill_bytes"),
        m["Disk Bytes Spilled"].alias("disk_spill_bytes"),
    )


def _log_applications(events: DataFrame) -> DataFrame:
    kinds = el.events_of(events, "app_start", "app_end", "job_end")
    at = F.col("`Timestamp`")
    bounds = kinds.groupBy("app_id").agg(
        F.max(F.when(F.col("kind") == "app_start", F.col("`App Name`"))).alias("app_name"),
        F.min(F.when(F.col("kind") == "app_start", at)).alias("start_ms"),
        F.max(F.when(F.col("kind") == "app_end", at)).alias("end_ms"),
        F.count_if((F.col("kind") == "job_end") & (F.col("`Job Result`.Result") != "JobSucceeded")).alias(
            "failed_jobs"
        ),
    )
    return bounds.filter(F.col("end_ms").isNotNull()).select(
        "app_id",
        "app_name",
        sc.epoch_ms_to_ts(F.col("start_ms")).alias("start_time"),
        sc.epoch_ms_to_ts(F.col("end_ms")).alias("end_time"),
        (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"),
        F.when(F.col("failed_jobs") > 0, "FAILED").otherwise("SUCCEEDED").alias("final_status"),
    )


def _log_stages(events: DataFrame) -> DataFrame:
    """All stages a job planned; skipped ones have neither times nor tasks' totals."""
    by = ["app_id", "stage_id", "attempt_id"]
    fields = ["Stage ID", "Stage Attempt ID", "Number of Tasks", "Submission Time", "Completion Time"]
    listed = el.events_of(events, "job_start").select("app_id", F.explode("`Stage Infos`").alias("s"))
    planned = listed.select("app_id", *[F.col("s")[f].alias(f) for f in fields])
    ran = el.events_of(events, "stage_submitted", "stage_completed").select(
        "app_id", *[F.col("`Stage Info`")[f].alias(f) for f in fields]
    )
    sid, attempt, n_tasks, start, end = [F.col(f"`{f}`") for f in fields]
    seen = (
        planned.unionByName(ran)
        .groupBy("app_id", sid.alias("stage_id"), F.coalesce(attempt, F.lit(0)).alias("attempt_id"))
        .agg(
            F.max(n_tasks).alias("num_tasks"),
            F.max(start).alias("start_ms"),
            F.max(end).alias("end_ms"),
        )
    )
    tasks = tasks_of(events)
    totals = stage_totals(tasks).drop("num_tasks")
    sums = ["executor_run_time_ms", "input_bytes_kb", "shuffle_read_kb", "shuffle_write_kb"]
    sums += ["memory_spill_kb", "disk_spill_kb"]
    joined = seen.join(totals, by, "left")
    joined = sc.with_defaults(joined, {c: 0 for c in sums}).withColumns(
        {
            "start_time": sc.epoch_ms_to_ts(F.col("start_ms")),
            "end_time": sc.epoch_ms_to_ts(F.col("end_ms")),
        }
    )
    return attach_task_quantiles(joined, task_quantiles(tasks.filter(~F.col("failed"))))


def _log_executors(events: DataFrame) -> DataFrame:
    kinds = el.events_of(events, "executor_added", "executor_removed", "block_manager_added")
    executor = F.coalesce("`Executor ID`", "`Block Manager ID`.`Executor ID`")
    found = kinds.groupBy("app_id", executor.alias("executor_id")).agg(
        F.max(F.coalesce("`Executor Info`.Host", "`Block Manager ID`.Host")).alias("host_ip"),
        F.max("`Executor Info`.`Total Cores`").alias("total_cores"),
        sc.to_kb(F.max("`Maximum Memory`")).alias("max_memory_kb"),
        F.max(F.when(F.col("kind") == "executor_removed", F.col("`Removed Reason`"))).alias("reason"),
        F.count_if(F.col("kind") == "executor_removed").alias("removed"),
    )
    return found.select(
        "app_id",
        "executor_id",
        "host_ip",
        F.coalesce("total_cores", F.lit(0)).alias("total_cores"),
        "max_memory_kb",
        (F.col("removed") == 0).alias("is_active"),
        F.coalesce("reason", F.lit("N/A")).alias("exit_reason"),
    )


def _log_sql_plans(events: DataFrame) -> DataFrame:
    """The last adaptive plan of a query, else the plan it started with."""
    kinds = el.events_of(events, "sql_start", "sql_end", "sql_update")
    plan = F.nullif("physicalPlanDescription", F.lit(""))
    latest = kinds.groupBy("app_id", F.col("executionId").alias("sql_id")).agg(
        F.max(F.when(F.col("kind") == "sql_start", F.col("description"))).alias("description"),
        F.max_by(plan, F.when(plan.isNotNull(), F.col("place"))).alias("plan"),
        F.min(F.when(F.col("kind") == "sql_start", F.col("time"))).alias("start_ms"),
        F.max(F.when(F.col("kind") == "sql_end", F.col("time"))).alias("end_ms"),
    )
    return latest.select(
        "app_id",
        "sql_id",
        F.coalesce("description", F.lit("")).alias("description"),
        pt.clean_plan(F.col("plan")).alias("plan_text"),
        F.coalesce("plan", F.lit("")).alias("raw_plan"),
        F.coalesce(F.col("end_ms") - F.col("start_ms"), F.lit(0)).alias("duration_ms"),
    )


def _log_job_map(events: DataFrame) -> DataFrame:
    sql_id = F.try_element_at(F.col("Properties"), F.lit("spark.sql.execution.id"))
    return el.events_of(events, "job_start").select(
        "app_id",
        F.col("`Job ID`").alias("job_id"),
        sql_id.try_cast("int").alias("sql_id"),
        sc.join_ids(F.col("`Stage IDs`")).alias("stage_ids"),
    )


def _executor_readings(events: DataFrame) -> DataFrame:
    """``app_id, executor_id, at`` (epoch ms) and ``m``, the reported executor metrics.

    Tasks report at their end; a stage's peaks per executor count at its
    completion. A reading without any heap in use was never taken.
    """
    tasks = el.events_of(events, "task_end").select(
        "app_id",
        F.col("`Task Info`.`Executor ID`").alias("executor_id"),
        F.col("`Task Info`.`Finish Time`").alias("at"),
        F.col("`Task Executor Metrics`").alias("m"),
    )
    done = el.events_of(events, "stage_completed").select(
        "app_id",
        F.col("`Stage Info`.`Stage ID`").alias("stage_id"),
        F.coalesce("`Stage Info`.`Stage Attempt ID`", F.lit(0)).alias("attempt_id"),
        F.col("`Stage Info`.`Completion Time`").alias("at"),
    )
    stages = el.events_of(events, "stage_metrics").select(
        "app_id",
        F.col("`Stage ID`").alias("stage_id"),
        F.coalesce("`Stage Attempt ID`", F.lit(0)).alias("attempt_id"),
        F.col("`Executor ID`").alias("executor_id"),
        F.col("`Executor Metrics`").alias("m"),
    )
    peaks = stages.join(done, ["app_id", "stage_id", "attempt_id"]).select(
        "app_id", "executor_id", "at", "m"
    )
    return tasks.unionByName(peaks).filter(F.col("m.JVMHeapMemory") > 0)


def _log_metrics(events: DataFrame) -> DataFrame:
    """Executor metrics as samples: the last value per second."""
    m, at = F.col("m"), F.col("at")
    storage = F.coalesce(m["OnHeapStorageMemory"], F.lit(0)) + F.coalesce(
        m["OffHeapStorageMemory"], F.lit(0)
    )
    sources = {name: m[field] for name, field in _EXECUTOR_METRICS.items()}
    sources["BlockManager_memory_memUsed_MB"] = storage
    # one row per executor and second before the metrics are unpivoted
    per_second = _executor_readings(events).groupBy(
        "app_id", "executor_id", F.floor(at / F.lit(1000)).cast("bigint").alias("second")
    ).agg(*[F.max(F.struct(at, value.alias("v")))["v"].alias(name) for name, value in sources.items()])
    long = per_second.unpivot(
        ["app_id", "executor_id", "second"], list(sources), "metric_name", "raw"
    )
    raw = F.col("raw").cast("double")
    value = F.when(F.col("metric_name").contains("Time"), raw).otherwise(sc.to_kb(raw))
    return long.filter(F.col("raw").isNotNull()).select(
        "app_id",
        sc.epoch_s_to_ts(F.col("second")).alias("timestamp"),
        "executor_id",
        "metric_name",
        value.alias("value_kb_or_ms"),
    )


def tables_from_events(events: DataFrame, with_nodes: bool = False) -> dict[str, DataFrame]:
    """Six tables from parsed events, completed applications only; ``with_nodes`` adds ``fact_stage_nodes``."""
    apps = _log_applications(events)
    ids = apps.select("app_id")
    tables: Mapping[str, DataFrame] = {
        "fact_stages": _log_stages(events),
        "fact_executors": _log_executors(events),
        "dim_sql_plans": _log_sql_plans(events),
        "fact_hardware_metrics": _log_metrics(events),
        "map_jobs": _log_job_map(events),
        **({"fact_stage_nodes": stage_nodes(events)} if with_nodes else {}),
    }
    done = {name: df.join(ids, "app_id", "left_semi") for name, df in tables.items()}
    return {name: conform(df, name) for name, df in {"dim_applications": apps, **done}.items()}


def build_from_event_log(
    spark: SparkSession, path: str, staged: bool = True, known: DataFrame | None = None, with_nodes: bool = False
) -> dict[str, DataFrame]:
    """Six tables from a folder of event logs, the last attempt of each application.

    ``staged`` parses the text once into a columnar table in the shared folder;
    without it every table scans the text again, which suits small folders.
    ``known`` (``app_id``, such as ``store.loads``) names applications whose logs are not read.
    ``with_nodes`` adds ``fact_stage_nodes``, by which rules tell the node at fault.
    """
    events = el.stage_event_log(spark, path, known=known) if staged else el.read_event_log(spark, path, known)
    return tables_from_events(events, with_nodes)
