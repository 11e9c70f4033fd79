"""Landing folders and event logs derived from the test tables.

Spark writes them from the derived tasks and samples, so that the readers and
builders run on documents that grow with the data.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..functions import series as se
from ..plans import nodes, rules
from ..plans import telemetry as tel
from ..session import scratch_path
from ..sources import event_log as el
from ..sources.tables import stored
from . import views

_GMT = "yyyy-MM-dd'T'HH:mm:ss.SSS'GMT'"
_BY = ["app_id", "stage_id", "attempt_id"]
# Fixed value: folder of rows whose partition value is null.
_NO_APP = "__HIVE_DEFAULT_PARTITION__"
# Fixed value: a log's lines are alike, so the fastest compression does; gzip takes longer than all else in the writing.
_LOG_COMPRESSION = "lz4"


def _gmt(ms: Column) -> Column:
    return F.date_format(sc.epoch_ms_to_ts(ms), _GMT)


def write_landing(spark: SparkSession, sf: str, kinds: tuple[str, ...] | None = None, layout: str = "lines") -> str:
    """Landing folder; returns its path. In the ``response`` layout only of kinds that are answered once an application."""
    t = views.written_tasks(spark, sf)
    spans = views.app_spans(t)
    jobs = views.jobs(t)
    plans = views.plans(spans)
    raw = t.groupBy(*_BY).agg(
        F.min("launch_ms").alias("s"),
        F.max("finish_ms").alias("e"),
        F.count(F.lit(1)).cast("int").alias("numTasks"),
        F.sum("run_time_ms").alias("executorRunTime"),
        F.sum("input_bytes").alias("inputBytes"),
        F.sum("shuffle_read_bytes").alias("shuffleReadBytes"),
        F.sum("shuffle_write_bytes").alias("shuffleWriteBytes"),
        F.sum("memory_spill_bytes").alias("memoryBytesSpilled"),
        F.sum("disk_spill_bytes").alias("diskBytesSpilled"),
    )
    attempt = F.struct(
        _gmt(F.col("start_ms")).alias("startTime"),
        _gmt(F.col("end_ms")).alias("endTime"),
        F.lit(True).alias("completed"),
        (F.col("end_ms") - F.col("start_ms")).alias("duration"),
    )
    sql_jobs = jobs.filter(F.col("sql_id").isNotNull()).groupBy("app_id", "sql_id").agg(
        F.collect_set("job_id").alias("successJobIds")
    )
    kinds_of = {
        "apps": spans.select(
            F.col("app_id").alias("id"),
            F.concat(F.lit("job of "), F.col("app_id")).alias("name"),
            F.array(attempt).alias("attempts"),
        ),
        "stages": raw.withColumnsRenamed({"stage_id": "stageId", "attempt_id": "attemptId"})
        .withColumns({"submissionTime": _gmt(F.col("s")), "completionTime": _gmt(F.col("e"))})
        .drop("s", "e"),
        "task_summary": tel.task_quantiles(t).withColumnRenamed("quantiles", "executorRunTime"),
        "jobs": jobs.select(
            "app_id", F.col("job_id").alias("jobId"), F.col("stages").alias("stageIds")
        ),
        "sql": plans.select(
            "app_id",
            F.col("sql_id").alias("id"),
            F.concat(F.lit("query "), F.col("sql_id").cast("string")).alias("description"),
            (F.col("sql_id") * 1000).cast("bigint").alias("duration"),
        ),
        "sql_detail": plans.join(sql_jobs, ["app_id", "sql_id"], "left").select(
            "app_id",
            "sql_id",
            F.lit("").alias("planDescription"),
            F.col("raw_plan").alias("physicalPlanDescription"),
            "successJobIds",
        ),
        "executors": views.executors(t).select(
            "app_id",
            F.col("executor_id").alias("id"),
            F.concat(F.lit("10.0.0."), F.col("executor_id"), F.lit(":7077")).alias("hostPort"),
            F.lit(4).alias("totalCores"),
            F.col("max_memory").alias("maxMemory"),
            (F.col("executor_id") != "3").alias("isActive"),
            F.when(
                F.col("executor_id") == "3", F.create_map(F.lit("exitReason"), F.lit("lost"))
            ).alias("executorLogs"),
        ),
        "metrics": matrices(spark, sf, layout),
    }
    path = scratch_path(spark, "landing")
    for kind, df in kinds_of.items():
        if kinds is not None and kind not in kinds:
            continue
        if layout == "lines":
            df.write.json(f"{path}/{kind}")
        else:
            _write_responses(df, f"{path}/{kind}", kind)
    return path


def matrices(spark: SparkSession, sf: str, layout: str = "lines") -> DataFrame:
    """Metric matrices: many series in a document, many samples in a series.

    One document for each application and hour it was asked for, or in the
    ``response`` layout, which has one file for each answer, for each application.
    """
    sample = F.struct(sc.ts_to_epoch(F.col("ts")).alias("at"), F.col("raw_value").alias("value"))
    asked = F.date_trunc("hour", "ts") if layout == "lines" else F.lit(None).cast("timestamp_ntz")
    name = F.concat(se.series_prefix(F.col("app_id")), "executor_id", F.lit("_"), "metric_name")
    series = (
        views.samples(spark, sf)
        .groupBy("app_id", asked.alias("asked"), name.alias("series"))
        .agg(F.array_sort(F.collect_list(sample)).alias("samples"))
    )
    values = F.transform("samples", lambda s: F.array(s["at"].cast("string"), s["value"].cast("string")))
    one = F.struct(F.create_map(F.lit("__name__"), F.col("series")).alias("metric"), values.alias("values"))
    return series.groupBy("app_id", "asked").agg(F.struct(F.collect_list(one).alias("result")).alias("data")).drop("asked")


def _write_responses(df: DataFrame, path: str, kind: str) -> None:
    """One file for each answer: a page of the list of applications, the list of an application's records, its matrix."""
    by = "app_id"
    if kind == "apps":
        by, df = "page", df.withColumn("page", F.pmod(F.xxhash64("id"), F.lit(16)))
    if kind != "metrics":
        record = F.struct(*[c for c in df.columns if c != by])
        df = df.groupBy(by).agg(F.collect_list(record).alias("data"))
    answer = F.struct("data") if kind == "metrics" else F.col("data")
    df.select(by, F.to_json(answer).alias("value")).repartition(by).write.partitionBy(by).text(path)


def _line(event: str, **fields: Column) -> Column:
    """One event as JSON; the event name leads, as in real logs."""
    named = [F.lit(event).alias("Event")]
    named += [c.alias(n.replace("__", " ")) for n, c in fields.items()]
    return F.to_json(F.struct(*named))


def _s(**fields: Column) -> Column:
    return F.struct(*[c.alias(n.replace("__", " ")) for n, c in fields.items()])


_SQL = "org.apache.spark.sql.execution.ui."


def _counter(k: int, value: Column) -> Column:
    """What a stage says of counter ``k`` of the query it ran for; two stages in a row ran for the same one."""
    sql_id = F.floor(F.col("stage_id") / F.lit(2)).cast("bigint") % 8 + 1
    return _s(ID=sql_id * 100 + k, Value=value.cast("string"), Metadata=F.lit("sql"))


def _plan_tree(sql_id: Column, node: Column) -> Column:
    """Plan as a tree: a scan writes an exchange, which the node of the query reads."""

    def named(name: Column, children: Column, **metrics: str) -> Column:
        counted = [_s(name=F.lit(label), accumulatorId=sql_id * 100 + int(k[1:])) for k, label in metrics.items()]
        return _s(nodeName=name, children=children, metrics=F.array(*counted))

    scan = named(F.lit("Scan parquet"), F.array(), n4=nodes.ROWS_METRIC)
    exchange = named(F.lit("Exchange"), F.array(scan), n3="shuffle bytes written")
    work = named(node, F.array(exchange), n1=nodes.ROWS_METRIC, n2=nodes.SPILL_METRIC)
    return named(F.lit("WholeStageCodegen (1)"), F.array(work), n0="duration")


def event_lines(spark: SparkSession, sf: str) -> list[DataFrame]:
    """``app_id, value``: one line (or a few lines kept together) of an event log; task ends, then all other events.

    Rows come in order of their application. The written tasks have few files
    of an application, so their lines need no shuffle.
    """
    t = views.written_tasks(spark, sf)
    # applications and jobs follow from the stages, so the tasks are read once for all three
    info = stored(
        t.groupBy(*_BY).agg(
            F.min("launch_ms").alias("launch_ms"),
            F.max("finish_ms").alias("finish_ms"),
            F.count(F.lit(1)).cast("int").alias("n"),
            F.sum("disk_spill_bytes").alias("spilled"),
        ),
        "stage-info",
    )
    spans = views.app_spans(info)
    zero = F.lit(0).cast("bigint")
    run, quantity = F.col("run_time_ms"), F.col("input_bytes")
    task_end = _line(
        "SparkListenerTaskEnd",
        Stage__ID=F.col("stage_id"),
        Stage__Attempt__ID=F.col("attempt_id"),
        Task__Info=_s(
            Task__ID=F.col("task_id"),
            Executor__ID=F.col("executor_id"),
            Launch__Time=F.col("launch_ms"),
            Finish__Time=F.col("finish_ms"),
            Failed=F.lit(False),
        ),
        Task__Executor__Metrics=_s(
            JVMHeapMemory=quantity * 1000,
            JVMOffHeapMemory=quantity * 10,
            OnHeapStorageMemory=quantity * 300,
            OffHeapStorageMemory=quantity * 20,
            ProcessTreePythonRSSMemory=run * 7,
            TotalGCTime=F.floor(run / F.lit(10)).cast("bigint"),
            MajorGCTime=zero,
        ),
        Task__Metrics=_s(
            Executor__Run__Time=run,
            JVM__GC__Time=zero,
            Memory__Bytes__Spilled=F.col("memory_spill_bytes"),
            Disk__Bytes__Spilled=F.col("disk_spill_bytes"),
            Input__Metrics=_s(Bytes__Read=F.col("input_bytes")),
            Shuffle__Read__Metrics=_s(
                Remote__Bytes__Read=F.col("shuffle_read_bytes") - 131, Local__Bytes__Read=zero + 131
            ),
            Shuffle__Write__Metrics=_s(Shuffle__Bytes__Written=F.col("shuffle_write_bytes")),
        ),
    )
    stage = _s(
        Stage__ID=F.col("stage_id"),
        Stage__Attempt__ID=F.col("attempt_id"),
        Number__of__Tasks=F.col("n"),
        Submission__Time=F.col("launch_ms"),
        Completion__Time=F.col("finish_ms"),
        Accumulables=F.when(F.col("stage_id") % 2 == 1, F.array(_counter(1, F.col("n")), _counter(2, F.col("spilled")))).otherwise(
            F.array(_counter(4, F.col("n")))
        ),
    )
    app_id = F.col("app_id")
    job_failed = (F.split_part(app_id, F.lit("-"), F.lit(2)).cast("bigint") % 5 == 0) & (F.col("job_id") == 3)
    job_lines = F.concat_ws(
        "\n",
        _line(
            "SparkListenerJobStart",
            Job__ID=F.col("job_id"),
            Submission__Time=zero + views.START_MS,
            Stage__IDs=F.col("stages"),
            Properties=F.when(
                F.col("sql_id").isNotNull(),
                F.create_map(F.lit("spark.sql.execution.id"), F.col("sql_id").cast("string")),
            ),
        ),
        _line(
            "SparkListenerJobEnd",
            Job__ID=F.col("job_id"),
            Job__Result=_s(Result=F.when(job_failed, "JobFailed").otherwise("JobSucceeded")),
        ),
    )
    sql_lines = F.concat_ws(
        "\n",
        _line(
            _SQL + "SparkListenerSQLExecutionStart",
            executionId=F.col("sql_id"),
            description=F.concat(F.lit("query "), F.col("sql_id").cast("string")),
            physicalPlanDescription=F.lit("== Initial Plan =="),
            time=zero + views.START_MS,
        ),
        _line(
            _SQL + "SparkListenerSQLAdaptiveExecutionUpdate",
            executionId=F.col("sql_id"),
            physicalPlanDescription=F.col("raw_plan"),
            sparkPlanInfo=_plan_tree(F.col("sql_id"), F.regexp_extract("raw_plan", r"\n   \+- (\w+)", 1)),
        ),
        _line(
            _SQL + "SparkListenerSQLExecutionEnd",
            executionId=F.col("sql_id"),
            time=zero + views.START_MS + F.col("sql_id") * 1000,
        ),
    )
    host = F.concat(F.lit("10.0.0."), F.col("executor_id"))
    executor_lines = F.concat_ws(
        "\n",
        _line(
            "SparkListenerExecutorAdded",
            Timestamp=zero + views.START_MS,
            Executor__ID=F.col("executor_id"),
            Executor__Info=_s(Host=host, Total__Cores=F.lit(4)),
        ),
        _line(
            "SparkListenerBlockManagerAdded",
            Block__Manager__ID=_s(Executor__ID=F.col("executor_id"), Host=host),
            Maximum__Memory=F.col("max_memory"),
        ),
        F.when(
            F.col("executor_id") == "3",
            _line(
                "SparkListenerExecutorRemoved",
                Executor__ID=F.col("executor_id"),
                Removed__Reason=F.lit("lost"),
            ),
        ),
    )
    app_lines = F.concat_ws(
        "\n",
        _line(
            "SparkListenerApplicationStart",
            App__Name=F.concat(F.lit("job of "), app_id),
            App__ID=app_id,
            Timestamp=F.col("start_ms"),
        ),
        _line("SparkListenerEnvironmentUpdate", Unused=F.lit(1)),
        _line("SparkListenerApplicationEnd", Timestamp=F.col("end_ms")),
    )
    parts = [
        info.select("app_id", _line("SparkListenerStageCompleted", Stage__Info=stage).alias("value")),
        views.jobs(info).select("app_id", job_lines.alias("value")),
        views.plans(spans).select("app_id", sql_lines.alias("value")),
        views.executors(t).select("app_id", executor_lines.alias("value")),
        spans.select("app_id", app_lines.alias("value")),
    ]
    rest = reduce(DataFrame.unionByName, parts)
    # narrow task rows are sorted, not their long lines
    ends = _by_app(t).select("app_id", task_end.alias("value"))
    return [ends, _by_app(rest.hint("rebalance", "app_id"))]


def _by_app(df: DataFrame) -> DataFrame:
    """Sorted as a write by application needs it: a column without nulls is taken as it is, and named as the writer names null."""
    return df.withColumn("app_id", F.coalesce("app_id", F.lit(_NO_APP))).sortWithinPartitions("app_id")


def write_event_log(spark: SparkSession, sf: str) -> str:
    """Event logs, one folder per application, compressed as logs are; returns their path."""
    path = scratch_path(spark, "eventlog")
    for lines in event_lines(spark, sf):
        lines.write.mode("append").option("compression", _LOG_COMPRESSION).partitionBy("app_id").text(path)
    return path


def event_log_tables(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return tel.build_from_event_log(spark, write_event_log(spark, sf), with_nodes=table in tel.LOG_TABLES)[table]


def node_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics of each plan node of all logged queries."""
    events = el.stage_event_log(spark, write_event_log(spark, sf))
    return nodes.node_metrics(nodes.plan_nodes(events), nodes.stage_counters(events))


def node_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Findings at the stages that ran the node at fault, and the nodes that spilled."""
    loaded = tel.build_from_event_log(spark, write_event_log(spark, sf), with_nodes=True)
    # all rules read the stages and the nodes that ran in them: these are found once and written
    loaded["fact_stages"] = stored(rules.with_nodes(loaded["fact_stages"], loaded), "stage-nodes")
    found = rules.stage_findings(rules.plans_of_stages(loaded), only=["spilling_sort_merge_join", "healthy_broadcast_join"])
    both = found.unionByName(rules.spill_ranking(loaded))
    names = F.coalesce(F.try_element_at("evidence", F.lit("spilling_nodes")), F.lit(""))
    return both.select("app_id", "rule_id", "stage_id", names.alias("spilling_nodes"))


def event_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """How many events of each kind the reader finds."""
    events = el.read_event_log(spark, write_event_log(spark, sf))
    return events.groupBy("app_id", "kind").agg(F.count(F.lit(1)).alias("n_events"))
