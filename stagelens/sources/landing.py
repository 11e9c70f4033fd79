"""Landed monitoring documents: one folder per kind below a landing folder.

Two layouts hold the same records:

``response``  one file per REST response, kept as received (a JSON array or a
              single object, pretty-printed or not). The application, and for
              per-stage and per-query responses the stage or query, is part of
              the path: ``stages/app_id=<id>/x.json``,
              ``task_summary/app_id=<id>/stage_id=<n>/attempt_id=<n>/x.json``,
              ``sql_detail/app_id=<id>/sql_id=<n>/x.json``.
``lines``     one record per line, so a large file splits over many tasks; the
              ids above are either fields of the record or part of the path.

Schemas are always stated: a missing key reads as null and gets its default
later, whatever the other documents hold.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import path_exists

APPS = (
    "id string, name string, attempts array<struct<startTime: string, endTime: string, "
    "completed: boolean, duration: bigint>>"
)
STAGES = (
    "stageId int, attemptId int, submissionTime string, completionTime string, numTasks int, "
    "executorRunTime bigint, inputBytes bigint, shuffleReadBytes bigint, "
    "shuffleWriteBytes bigint, memoryBytesSpilled bigint, diskBytesSpilled bigint"
)
TASK_SUMMARY = "executorRunTime array<double>"
JOBS = "jobId int, sqlExecutionId int, stageIds array<int>"
SQL = "id int, description string, duration bigint"
SQL_DETAIL = (
    "planDescription string, physicalPlanDescription string, successJobIds array<int>, "
    "failedJobIds array<int>, runningJobIds array<int>"
)
EXECUTORS = (
    "id string, hostPort string, totalCores int, maxMemory bigint, isActive boolean, "
    "executorLogs map<string,string>"
)
METRICS = (
    "data struct<result: array<struct<metric: map<string,string>, "
    "values: array<array<string>>>>>"
)

LAYOUTS = ("response", "lines")


def app_folders(spark: SparkSession, path: str, apps: Sequence[str]) -> dict[str, str]:
    """Application id -> its folder below ``path``, for those that have one; asks for these folders only."""
    return {app: folder for app, folder in _folders(spark, path, apps) if path_exists(spark, folder)}


def _folders(spark: SparkSession, path: str, apps: Sequence[str]) -> Iterator[tuple[str, str]]:
    escape = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    return ((app, f"{path}/app_id={escape(app)}") for app in dict.fromkeys(apps))


def _all_folders(spark: SparkSession, path: str, apps: Sequence[str]) -> list[str]:
    """Folders of all applications; none if one application has none, which the first one mostly tells."""
    folders = []
    for _, folder in _folders(spark, path, apps):
        if not path_exists(spark, folder):
            return []
        folders.append(folder)
    return folders


def _documents(
    spark: SparkSession, landing: str, kind: str, schema: str, ids: str, layout: str, apps: Sequence[str] | None = None
) -> DataFrame:
    """Records of one kind: id columns, document fields, ``position`` in the response.

    ``position`` is null in the lines layout, where records have no list order.
    With ``apps`` only the folders of these applications are listed and read.
    Records outside such folders (``lines`` only) are found by reading all and
    joining the ids: a list of them in a filter is compared one by one with each record.
    """
    if layout not in LAYOUTS:
        raise ValueError(f"layout must be one of {LAYOUTS}")
    path = f"{landing}/{kind}"
    paths, reader, outside = [path], spark.read, False
    if apps is not None:
        folders = list(app_folders(spark, path, apps).values()) if layout == "response" else _all_folders(spark, path, apps)
        outside = bool(apps) and layout == "lines" and not folders
        if not outside:
            paths, reader = folders, spark.read.option("basePath", path)
    if not paths or not path_exists(spark, path):
        # nothing of this kind was answered: no rows, same columns
        return spark.createDataFrame([], f"{ids + ', ' if ids else ''}{schema}, position int")
    names = [part.split()[0] for part in ids.split(",")] if ids else []
    if layout == "lines":
        full = f"{ids}, {schema}" if ids else schema
        found = reader.schema(full).json(paths).withColumn("position", F.lit(None).cast("int"))
        if apps is None:
            return found
        if not outside:
            return found.filter(F.col("app_id").isNotNull())
        wanted = spark.createDataFrame(pa.table({"app_id": pa.array(dict.fromkeys(apps), pa.string())}))
        return found.join(wanted, "app_id", "left_semi").select(found.columns)
    raw = reader.schema(f"value string{', ' + ids if ids else ''}").text(paths, wholetext=True)
    records = F.from_json("value", f"array<struct<{schema}>>")
    return raw.select(*names, F.posexplode(records).alias("position", "doc")).select(
        *names, "doc.*", "position"
    )


def read_apps(spark: SparkSession, landing: str, layout: str = "response") -> DataFrame:
    return _documents(spark, landing, "apps", APPS, "", layout)


def read_stages(spark: SparkSession, landing: str, layout: str = "response", apps: Sequence[str] | None = None) -> DataFrame:
    return _documents(spark, landing, "stages", STAGES, "app_id string", layout, apps)


def read_task_summaries(spark: SparkSession, landing: str, layout: str = "response", apps: Sequence[str] | None = None) -> DataFrame:
    ids = "app_id string, stage_id int, attempt_id int"
    return _documents(spark, landing, "task_summary", TASK_SUMMARY, ids, layout, apps)


def read_jobs(spark: SparkSession, landing: str, layout: str = "response", apps: Sequence[str] | None = None) -> DataFrame:
    return _documents(spark, landing, "jobs", JOBS, "app_id string", layout, apps)


def read_sql_list(spark: SparkSession, landing: str, layout: str = "response", apps: Sequence[str] | None = None) -> DataFrame:
    return _documents(spark, landing, "sql", SQL, "app_id string", layout, apps)


def read_sql_details(spark: SparkSession, landing: str, layout: str = "response", apps: Sequence[str] | None = None) -> DataFrame:
    return _documents(spark, landing, "sql_detail", SQL_DETAIL, "app_id string, sql_id int", layout, apps)


def read_executors(spark: SparkSession, landing: str, layout: str = "response", apps: Sequence[str] | None = None) -> DataFrame:
    return _documents(spark, landing, "executors", EXECUTORS, "app_id string", layout, apps)


def read_metric_matrix(spark: SparkSession, landing: str, layout: str = "response", apps: Sequence[str] | None = None) -> DataFrame:
    """One row per series: ``app_id``, ``series`` name, ``values`` as [epoch, value] texts."""
    docs = _documents(spark, landing, "metrics", METRICS, "app_id string", layout, apps)
    return docs.select("app_id", F.explode("data.result").alias("r")).select(
        "app_id", F.element_at("r.metric", "__name__").alias("series"), F.col("r.values").alias("values")
    )
