"""Metric samples as a stream: last value and peak per second and series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import scalars as sc

SAMPLES = "app_id string, executor_id string, metric_name string, ts_ms bigint, value double"

# Samples later than this are dropped; the batch load pads run times by as much.
LATE = "5 seconds"


def per_second(samples: DataFrame, late: str = LATE) -> DataFrame:
    """Streaming counterpart of the batch resampling to a one-second grid.

    State is one row per series and open second; the watermark closes a second
    once the stream has moved past it by ``late``.
    """
    event_time = F.timestamp_millis("ts_ms")
    value = sc.metric_value(F.col("metric_name"), F.col("value"))
    return (
        samples.filter(F.col("value").isNotNull() & ~F.isnan("value"))
        .withColumns({"ts": event_time, "value_kb_or_ms": value})
        .withWatermark("ts", late)
        .groupBy(F.window("ts", "1 second"), "app_id", "executor_id", "metric_name")
        .agg(
            F.max(F.struct("ts_ms", "value_kb_or_ms"))["value_kb_or_ms"].alias("last_value"),
            F.max("value_kb_or_ms").alias("peak"),
            F.count(F.lit(1)).alias("n_samples"),
        )
        .select(
            "app_id",
            "executor_id",
            "metric_name",
            F.unix_seconds("window.start").alias("second"),
            "last_value",
            "peak",
            "n_samples",
        )
    )


def stream_metrics(
    spark: SparkSession,
    in_dir: str,
    out: str,
    checkpoint: str,
    available_now: bool = True,
    files_per_batch: int | None = None,
) -> StreamingQuery:
    """Start the job: JSON-lines samples from ``in_dir``, closed seconds to ``out``.

    Set ``files_per_batch`` for a long backlog whose files are in time order.
    """
    reader = spark.readStream.schema(SAMPLES)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    writer = (
        per_second(reader.json(in_dir))
        .writeStream.outputMode("append")
        .format("parquet")
        .option("checkpointLocation", checkpoint)
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(
        processingTime="1 second"
    )
    return writer.start(out)
