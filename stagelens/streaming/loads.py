"""Incremental load: applications enter the store as their documents land."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.caching import cached
from ..plans.store import load_tables, loads, new_apps, other_loads
from ..plans.telemetry import build_telemetry, completed_only, first_attempt
from ..sources.landing import APPS, read_apps

FILES_A_BATCH = 1000
APPS_A_LOAD = 1000


def load_landed(spark: SparkSession, landing: str, out: str, layout: str = "response", apps_a_load: int = APPS_A_LOAD) -> int:
    """Load the landed, completed applications that the store does not hold yet; returns how many loads that took.

    New applications are found from the application documents alone. Each load
    takes the next ``apps_a_load`` of them by id and reads their folders only.
    """
    number = 0
    while True:
        done = completed_only(first_attempt(read_apps(spark, landing, layout))).dropDuplicates(["id"])
        fresh = new_apps(done.withColumn("app_id", F.col("id")), loads(spark, out))
        with cached(fresh.select("id", "name", "attempts").orderBy("id").limit(apps_a_load)) as todo:
            if todo.isEmpty():
                return number
            load_tables(build_telemetry(spark, landing, layout, app_documents=todo), out, uuid.uuid4().hex)
        number += 1


def _stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id a stream keeps in its checkpoint: another one for a fresh checkpoint, whatever its path."""
    text = spark.read.text(f"{checkpoint}/metadata", wholetext=True)
    return text.select(F.get_json_object("value", "$.id")).first()[0]


def _load_batch(batch: DataFrame, batch_id: int, landing: str, out: str, checkpoint: str, layout: str) -> None:
    spark = batch.sparkSession
    load_id = f"{_stream_id(spark, checkpoint)}-{batch_id}"
    if layout == "response":
        docs = batch.select(F.explode(F.from_json("value", f"array<struct<{APPS}>>")).alias("d"))
        batch = docs.select("d.*")
    # a batch that is run again must not see its own earlier attempt as loaded
    earlier = other_loads(spark, out, load_id)
    done = completed_only(first_attempt(batch)).dropDuplicates(["id"])
    fresh = new_apps(done.withColumn("app_id", F.col("id")), earlier)
    with cached(fresh.select("id", "name", "attempts")) as todo:
        if not todo.isEmpty():
            tables = build_telemetry(spark, landing, layout, app_documents=todo)
            load_tables(tables, out, load_id)


def stream_load(
    spark: SparkSession,
    landing: str,
    out: str,
    checkpoint: str,
    layout: str = "response",
    available_now: bool = True,
    files_a_batch: int = FILES_A_BATCH,
) -> StreamingQuery:
    """Start the job. An application document must land after its other documents.

    A batch takes at most ``files_a_batch`` application documents and reads the
    folders of their applications only, so its cost follows what is new and not
    what has landed before.

    A load is named after the stream's id and the batch number, so a repeated
    batch overwrites its own folders, no other writer's, and each application is
    in the store exactly once.
    """
    apps = f"{landing}/apps"
    reader = spark.readStream.option("maxFilesPerTrigger", files_a_batch)
    if layout == "response":
        stream = reader.schema("value string").text(apps, wholetext=True)
    else:
        stream = reader.schema(APPS).json(apps)
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, batch_id: _load_batch(batch, batch_id, landing, out, checkpoint, layout)
    )
    if available_now:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime="30 seconds").start()
