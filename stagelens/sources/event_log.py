"""Spark event logs: JSON lines, one file or rolled folder per application.

Zstandard-compressed logs are decompressed by the text source. Plain logs
split, so one huge log is read by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .tables import read_table

_SQL_PACKAGE = r"org\.apache\.spark\.sql\.execution\.ui\."

# A task reads so many bytes of logs, as they are stored, unless there are fewer tasks than this a core.
TASK_BYTES, TASKS_A_CORE = 16 << 20, 4

# Event name -> short kind; other events are skipped.
KINDS = {
    "SparkListenerApplicationStart": "app_start",
    "SparkListenerApplicationEnd": "app_end",
    "SparkListenerJobStart": "job_start",
    "SparkListenerJobEnd": "job_end",
    "SparkListenerStageSubmitted": "stage_submitted",
    "SparkListenerStageCompleted": "stage_completed",
    "SparkListenerTaskEnd": "task_end",
    "SparkListenerStageExecutorMetrics": "stage_metrics",
    "SparkListenerExecutorAdded": "executor_added",
    "SparkListenerExecutorRemoved": "executor_removed",
    "SparkListenerBlockManagerAdded": "block_manager_added",
    "SparkListenerSQLExecutionStart": "sql_start",
    "SparkListenerSQLExecutionEnd": "sql_end",
    "SparkListenerSQLAdaptiveExecutionUpdate": "sql_update",
}

_STAGE = (
    "struct<`Stage ID`: int, `Stage Attempt ID`: int, `Number of Tasks`: int, "
    "`Submission Time`: bigint, `Completion Time`: bigint, "
    "`Accumulables`: array<struct<`ID`: bigint, `Value`: string, `Metadata`: string>>>"
)

_EXECUTOR_METRICS = (
    "struct<`JVMHeapMemory`: bigint, `JVMOffHeapMemory`: bigint, "
    "`OnHeapStorageMemory`: bigint, `OffHeapStorageMemory`: bigint, "
    "`ProcessTreePythonRSSMemory`: bigint, `TotalGCTime`: bigint, `MajorGCTime`: bigint>"
)

# The fields used from the end of a task.
TASK_END = (
    "`Stage ID` int, `Stage Attempt ID` int, "
    "`Task Info` struct<`Task ID`: bigint, `Executor ID`: string, `Launch Time`: bigint, "
    "`Finish Time`: bigint, `Failed`: boolean>, "
    "`Task Metrics` struct<`Executor Run Time`: bigint, `JVM GC Time`: bigint, "
    "`Memory Bytes Spilled`: bigint, `Disk Bytes Spilled`: bigint, "
    "`Input Metrics`: struct<`Bytes Read`: bigint>, "
    "`Shuffle Read Metrics`: struct<`Remote Bytes Read`: bigint, `Local Bytes Read`: bigint>, "
    "`Shuffle Write Metrics`: struct<`Shuffle Bytes Written`: bigint>>, "
    f"`Task Executor Metrics` {_EXECUTOR_METRICS}"
)

# The union of the fields used from any event; absent fields read as null.
EVENT = (
    "`App ID` string, `App Name` string, `Timestamp` bigint, "
    "`Job ID` int, `Submission Time` bigint, `Stage IDs` array<int>, "
    f"`Stage Infos` array<{_STAGE}>, `Properties` map<string,string>, "
    "`Job Result` struct<`Result`: string>, "
    f"`Stage Info` {_STAGE}, "
    f"{TASK_END}, `Executor Metrics` {_EXECUTOR_METRICS}, "
    "`Executor ID` string, `Executor Info` struct<`Host`: string, `Total Cores`: int>, "
    "`Removed Reason` string, "
    "`Block Manager ID` struct<`Executor ID`: string, `Host`: string>, `Maximum Memory` bigint, "
    "executionId int, description string, physicalPlanDescription string, sparkPlanInfo string, "
    "`time` bigint, errorMessage string"
)


# Fixed value: how Spark starts the line of a task end.
_TASK_END_LINE = '{"Event":"SparkListenerTaskEnd"'


def _event_kind(line: Column) -> Column:
    """Kind of a line from its leading ``Event`` field; null when not used."""
    name = F.regexp_extract(
        line, rf'^\s*\{{\s*"Event"\s*:\s*"(?:{_SQL_PACKAGE})?(SparkListener\w+)"', 1
    )
    pairs = [F.lit(x) for event_and_kind in KINDS.items() for x in event_and_kind]
    # by far the most lines are told by their first bytes, without the pattern
    return F.when(F.startswith(line, F.lit(_TASK_END_LINE)), "task_end").otherwise(F.try_element_at(F.create_map(*pairs), name))


def app_id_of_path(path: Column) -> Column:
    """Application id from an ``app_id=`` folder, a rolled-log folder or a file name."""

    def part(pattern: str) -> Column:
        return F.try_element_at(F.regexp_extract_all(path, F.lit(pattern), F.lit(1)), F.lit(1))

    return F.coalesce(
        part(r"/app_id=([^/]+)/"),
        part(r"/eventlog_v2_([^/]+)/"),
        part(r"/([^/.]+)(?:\.[^/]*)?$"),
    )


def app_and_attempt(log: Column) -> tuple[Column, Column]:
    """Application id and attempt of a log's name; a log without an attempt number is attempt 1."""
    numbered = r"^(application_\d+_\d+|[^_]+)_(\d+)$"
    # a log is named by every line: the pattern is tried only where it may match
    may = F.contains(log, F.lit("_"))
    app = F.when(may, F.nullif(F.regexp_extract(log, numbered, 1), F.lit("")))
    attempt = F.when(may, F.nullif(F.regexp_extract(log, numbered, 2), F.lit(""))).cast("int")
    return F.coalesce(app, log), F.coalesce(attempt, F.lit(1))


def logs_to_read(spark: SparkSession, path: str, known: DataFrame | None = None) -> list[str]:
    """Files of the last attempt of each application, without those of ``known`` applications."""
    return [path for path, _ in _sized_logs(spark, path, known)]


def _sized_logs(spark: SparkSession, path: str, known: DataFrame | None) -> list[tuple[str, int]]:
    """Files to read and their bytes.

    Told from the names, before any text is read; the driver holds the names
    of the files to read, as any scan's does.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    app, attempt = app_and_attempt(app_id_of_path(F.col("path")))
    named = files.select("path", "length", app.alias("app_id"), attempt.alias("attempt"))
    last = named.groupBy("app_id").agg(F.max("attempt").alias("attempt"))
    if known is not None:
        last = last.join(known.select("app_id"), "app_id", "left_anti")
    return [(r["path"], r["length"]) for r in named.join(last, ["app_id", "attempt"], "left_semi").collect()]


def _log_lines(spark: SparkSession, path: str, known: DataFrame | None) -> DataFrame:
    """Lines of the events used: ``app_id, attempt, kind, family, value, place``."""
    logs = _sized_logs(spark, path, known)
    if logs:
        raw = spark.read.text([path for path, _ in logs]).select(
            "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block")
        )
        # a scan takes only a few dozen small files into a task, which then writes files of its own
        tasks = max(TASKS_A_CORE * spark.sparkContext.defaultParallelism, sum(size for _, size in logs) // TASK_BYTES)
        raw = raw.coalesce(tasks)
    else:
        raw = spark.createDataFrame([], "value string, path string, block bigint")
    roll = F.when(F.contains("path", F.lit("/events_")), F.regexp_extract("path", r"/events_(\d+)_[^/]*$", 1))
    place = F.struct(
        F.coalesce(F.nullif(roll, F.lit("")).cast("int"), F.lit(0)).alias("roll"),
        F.col("path"),
        F.col("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    app, attempt = app_and_attempt(F.col("log"))
    return (
        raw.withColumn("place", place)
        .withColumn("kind", _event_kind(F.col("value")))
        .filter(F.col("kind").isNotNull())
        .withColumn("log", app_id_of_path(F.col("path")))
        .select(app.alias("app_id"), attempt.alias("attempt"), "kind", _family(F.col("kind")).alias("family"), "value", "place")
    )


def read_event_log(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    """Parsed events: ``app_id``, ``attempt``, ``kind``, ``e`` (the fields used) and ``place``.

    The last attempt of each application is read; ``known`` (``app_id``) names
    applications to leave out. ``place`` orders the events of one application as
    they stand in its log: number of the rolled file, file, start of the file
    split, row inside it. The kind is cut from the head of a line, so lines of
    other kinds are dropped before any JSON is parsed, and each line is parsed once.
    """
    lines = _log_lines(spark, path, known)
    return lines.select("app_id", "attempt", "kind", "family", F.from_json("value", EVENT).alias("e"), "place")


def _family(kind: Column) -> Column:
    """Task ends, by far the most events, apart from all others."""
    return F.when(kind == "task_end", "tasks").otherwise("rest")


def stage_event_log(
    spark: SparkSession, path: str, out: str | None = None, known: DataFrame | None = None
) -> DataFrame:
    """Events parsed once into a columnar table.

    The six tables read different kinds and fields; over the staged table each
    of them scans only its own columns instead of the text. Two folders, task
    ends and the rest, keep the small tables away from the tasks and leave two
    files per task of this job. Of a task end only the fields of ``TASK_END`` are
    parsed, sorted and stored; the others of ``EVENT`` read as null.
    """
    out = out or scratch_path(spark, "events")
    lines, ends = _log_lines(spark, path, known), F.col("kind") == "task_end"
    parsed = lines.select(
        "app_id",
        "attempt",
        "kind",
        "family",
        F.from_json(F.when(ends, F.col("value")), TASK_END).alias("t"),
        F.from_json(F.when(~ends, F.col("value")), EVENT).alias("e"),
        "place",
    )
    parsed.write.mode("overwrite").option("compression", "zstd").partitionBy("family").parquet(out)
    return _staged_events(read_table(spark, out))


def _staged_events(stored: DataFrame) -> DataFrame:
    """Staged rows as ``read_event_log`` returns them; a filter on ``family`` leaves one of the two folders."""
    event, task = stored.schema["e"].dataType, {f.name for f in stored.schema["t"].dataType}
    fields = [F.col("t")[f.name] if f.name in task else F.lit(None).cast(f.dataType) for f in event]
    ends = F.struct(*[c.alias(f.name) for c, f in zip(fields, event, strict=True)])

    def of(family: str, e: Column) -> DataFrame:
        return stored.filter(F.col("family") == family).select("app_id", "attempt", "kind", F.lit(family).alias("family"), e.alias("e"), "place")

    return of("tasks", ends).unionByName(of("rest", F.col("e")))


def events_of(events: DataFrame, *kinds: str) -> DataFrame:
    """Events of some kinds with their fields flattened."""
    families = {"tasks" if k == "task_end" else "rest" for k in kinds}
    wanted = F.col("kind").isin(*kinds) & F.col("family").isin(*families)
    return events.filter(wanted).select("app_id", "kind", "place", "e.*")
