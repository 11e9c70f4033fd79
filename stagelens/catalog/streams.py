"""Streaming queries, run to the end of their input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..plans.store import loads, read_store
from ..session import scratch_path
from ..streaming.loads import stream_load
from ..streaming.metrics import stream_metrics
from . import Query, landed, views
from .views import with_views

QUERIES: dict[str, Query] = {}

# Far after any sample: moves the watermark on, so that every second is closed.
SENTINEL_MS = 4102444800000


def _stream_metrics(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.samples(spark, sf).select(
        "app_id",
        "executor_id",
        "metric_name",
        sc.ts_to_epoch_ms(F.col("ts")).alias("ts_ms"),
        F.col("raw_value").alias("value"),
    )
    end = spark.createDataFrame(
        [("", "", "end", SENTINEL_MS, 0.0)],
        "app_id string, executor_id string, metric_name string, ts_ms bigint, value double",
    )
    base = scratch_path(spark, "stream-metrics")
    rows.unionByName(end).write.json(f"{base}/in")
    job = stream_metrics(spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint")
    job.awaitTermination()
    return spark.read.parquet(f"{base}/out").filter(F.col("metric_name") != "end")


QUERIES["stream_metrics"] = Query(
    _stream_metrics,
    with_views(
        "select app_id, executor_id, metric_name, epoch_us(ts) // 1000000 as second, "
        f"max({{'t': epoch_us(ts) // 1000, 'v': v}}).v as last_value, max(v) as peak, count(*) as n_samples "
        f"from (select *, {views.METRIC_VALUE_SQL} as v from v_samples) "
        "group by app_id, executor_id, metric_name, epoch_us(ts) // 1000000"
    ),
)


def _stream_load(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs over the same landing folder: the second finds nothing new."""
    landing = landed.write_landing(spark, sf)
    base = scratch_path(spark, "stream-load")
    for _ in range(2):
        job = stream_load(spark, landing, f"{base}/store", f"{base}/checkpoint", "lines")
        job.awaitTermination()
    stored = read_store(spark, f"{base}/store")
    stages = stored["fact_stages"].groupBy("app_id").agg(
        F.count(F.lit(1)).alias("n_stages"),
        F.sum("executor_run_time_ms").alias("stage_time_ms"),
        F.sum(F.col("disk_spill_kb").cast("decimal(24,2)")).cast("double").alias("disk_spill_kb"),
    )
    return loads(spark, f"{base}/store").select("app_id").join(stages, "app_id")


QUERIES["stream_load"] = Query(
    _stream_load,
    with_views(
        "select app_id, count(*) as n_stages, cast(sum(executor_run_time_ms) as bigint) as stage_time_ms, "
        "cast(sum(cast(disk_spill_kb as decimal(24,2))) as double) as disk_spill_kb from fact_stages group by app_id"
    ),
)
