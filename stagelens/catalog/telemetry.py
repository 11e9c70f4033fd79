"""Telemetry queries: building blocks, landed documents, event logs, the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import plan_text as pt
from ..functions import scalars as sc
from ..functions import series as se
from ..plans import mapping as mp
from ..plans import store as st
from ..plans import telemetry as tel
from ..session import scratch_path
from . import Query, landed, views
from .views import with_views

QUERIES: dict[str, Query] = {}

_TOTALS = (
    "app_id, stage_id, attempt_id, num_tasks, executor_run_time_ms, input_bytes_kb, shuffle_read_kb, "
    "shuffle_write_kb, memory_spill_kb, disk_spill_kb"
)

QUERIES["tele_stage_totals"] = Query(
    lambda spark, sf: tel.stage_totals(views.tasks(spark, sf)),
    with_views(f"select {_TOTALS} from fact_stages"),
)


def _quantiles(spark: SparkSession, sf: str) -> DataFrame:
    q = F.col("quantiles")
    return tel.task_quantiles(views.tasks(spark, sf)).select(
        "app_id", "stage_id", "attempt_id", q[0].alias("lo"), q[1].alias("mid"), q[2].alias("hi")
    )


QUERIES["tele_task_quantiles"] = Query(
    _quantiles,
    with_views(
        "select app_id, stage_id, attempt_id, min(run_time_ms) as lo, max(v) as mid, max(run_time_ms) as hi "
        "from v_tasks join v_median using (app_id, stage_id, attempt_id) group by all"
    ),
)


def _attach_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    """Retries are left out of the summaries, as if those were never answered."""
    t = views.tasks(spark, sf)
    stages = t.groupBy("app_id", "stage_id", "attempt_id").agg(F.count(F.lit(1)).alias("n_tasks"))
    summaries = tel.task_quantiles(t.filter(F.col("attempt_id") == 0))
    return tel.attach_task_quantiles(stages, summaries)


QUERIES["tele_attach_quantiles"] = Query(
    _attach_quantiles,
    with_views(
        "select app_id, stage_id, attempt_id, cast(num_tasks as bigint) as n_tasks, "
        "case when attempt_id = 0 then task_duration_median_ms else 0 end as task_duration_median_ms, "
        "case when attempt_id = 0 then task_duration_max_ms else 0 end as task_duration_max_ms from fact_stages"
    ),
)


def _job_map(spark: SparkSession, sf: str) -> DataFrame:
    """Jobs know no query; query 7 comes last and also claims jobs 6 and 99."""
    t = views.tasks(spark, sf)
    jobs = views.jobs(t)
    own = jobs.select(
        "app_id", "job_id", F.lit(None).cast("int").alias("sql_id"), sc.join_ids(F.col("stages")).alias("stage_ids")
    )
    claims = F.when(F.col("sql_id") == 7, F.array(F.lit(7), F.lit(6), F.lit(99))).otherwise(F.array("sql_id"))
    queries = views.plans(views.app_spans(t)).select(
        "app_id", "sql_id", F.col("sql_id").alias("place"), claims.alias("job_ids")
    )
    out = tel.build_job_map(own, queries)
    return out.withColumn("sql_id", F.coalesce("sql_id", F.lit(-1)))


QUERIES["tele_job_map"] = Query(
    _job_map,
    with_views(
        "select app_id, job_id, coalesce(c.sql_id, -1) as sql_id, coalesce(m.stage_ids, '') as stage_ids "
        "from map_jobs m full outer join (select app_id, job_id, max(sql_id) as sql_id from "
        "(select app_id, sql_id, unnest(case when sql_id = 7 then [7, 6, 99] else [sql_id] end) as job_id "
        "from dim_sql_plans) group by app_id, job_id) c using (app_id, job_id)"
    ),
)

QUERIES["tele_map_jobs"] = Query(
    lambda spark, sf: views.tables(spark, sf)["map_jobs"].withColumn(
        "sql_id", F.coalesce("sql_id", F.lit(-1))
    ),
    with_views("select app_id, job_id, coalesce(sql_id, -1) as sql_id, stage_ids from map_jobs"),
)

QUERIES["tele_metric_units"] = Query(
    lambda spark, sf: views.metrics(spark, sf),
    with_views("select * from fact_hardware_metrics"),
)


def _parse_series(spark: SparkSession, sf: str) -> DataFrame:
    s = views.samples(spark, sf)
    name = F.concat(se.series_prefix(F.col("app_id")), "executor_id", F.lit("_"), "metric_name")
    return s.select(
        "app_id", "ts", name.alias("series"), se.series_parts(name, F.col("app_id")).alias("p")
    ).select("app_id", "ts", "series", "p.executor_id", "p.metric_name")


_SERIES_SQL = "'spark_' || replace(app_id, '-', '_') || '_' || executor_id || '_' || metric_name"

QUERIES["tele_parse_series"] = Query(
    _parse_series,
    with_views(
        "select app_id, ts, series, split_part(rest, '_', 1) as executor_id, "
        "substring(rest, length(split_part(rest, '_', 1)) + 2) as metric_name from (select *, "
        "substring(series, length('spark_' || replace(app_id, '-', '_') || '_') + 1) as rest from "
        f"(select app_id, ts, {_SERIES_SQL} as series from v_samples))"
    ),
)


def _target_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Purchases get a name no rule reads, so they drop out."""
    s = views.samples(spark, sf)
    metric = F.when(F.col("metric_name").contains("memUsed"), "jvm_threads").otherwise(F.col("metric_name"))
    name = F.concat(se.series_prefix(F.col("app_id")), "executor_id", F.lit("_"), metric)
    named = s.select("app_id", "ts", name.alias("series"))
    return tel.filter_target_metrics(named)


_TARGETS = "|".join(se.TARGET_METRICS)

QUERIES["tele_target_filter"] = Query(
    _target_filter,
    with_views(
        "select app_id, ts, series from (select app_id, ts, 'spark_' || replace(app_id, '-', '_') || '_' || "
        "executor_id || '_' || case when contains(metric_name, 'memUsed') then 'jvm_threads' else metric_name "
        f"end as series from v_samples) where regexp_matches(series, '^spark_' || replace(app_id, '-', '_') || "
        f"'_.*({_TARGETS})$')"
    ),
)

QUERIES["tele_resample_1s"] = Query(
    lambda spark, sf: tel.last_per_second(views.metrics(spark, sf)),
    with_views(
        "select app_id, executor_id, metric_name, date_trunc('second', timestamp) as timestamp, "
        "max({'t': timestamp, 'v': value_kb_or_ms}).v as value_kb_or_ms from fact_hardware_metrics "
        "group by app_id, executor_id, metric_name, date_trunc('second', timestamp)"
    ),
)


LOOKBACK = 20


def _fill(spark: SparkSession, sf: str) -> DataFrame:
    return tel.fill_seconds(tel.last_per_second(views.metrics(spark, sf)), LOOKBACK)


QUERIES["tele_fill_seconds"] = Query(
    _fill,
    with_views(
        "select app_id, s + to_seconds(k) as timestamp, executor_id, metric_name, value_kb_or_ms from "
        "(select *, unnest(range(n)) as k from (select *, coalesce(least("
        "cast(date_diff('second', s, lead(s) over (partition by app_id, executor_id, metric_name order by s)) as bigint), "
        f"{LOOKBACK + 1}), {LOOKBACK + 1}) as n from (select app_id, executor_id, metric_name, "
        "date_trunc('second', timestamp) as s, max({'t': timestamp, 'v': value_kb_or_ms}).v as value_kb_or_ms "
        "from fact_hardware_metrics group by app_id, executor_id, metric_name, date_trunc('second', timestamp))))"
    ),
)


def _clip(spark: SparkSession, sf: str) -> DataFrame:
    t = views.tables(spark, sf)
    return tel.clip_to_app(t["fact_hardware_metrics"], t["dim_applications"])


QUERIES["tele_clip"] = Query(
    _clip,
    with_views(
        "select m.* from fact_hardware_metrics m join dim_applications a using (app_id) "
        "where m.timestamp between a.start_time - interval 5 second and a.end_time + interval 5 second"
    ),
)

QUERIES["tele_metric_peaks"] = Query(
    lambda spark, sf: tel.metric_peaks(views.metrics(spark, sf)),
    with_views(
        "select app_id, executor_id, metric_name, count(*) as n_samples, max(value_kb_or_ms) as peak, "
        "cast(sum(cast(value_kb_or_ms as decimal(24,2))) as double) / count(*) as mean, "
        "round_even(max({'t': timestamp, 'v': value_kb_or_ms}).v - min({'t': timestamp, 'v': value_kb_or_ms}).v, 2) "
        "as growth from fact_hardware_metrics group by app_id, executor_id, metric_name"
    ),
)


# --- plan text --------------------------------------------------------------------------

QUERIES["tele_plan_lines"] = Query(
    lambda spark, sf: views.table_of(spark, sf, "documents").select(
        "doc_id", pt.clean_plan(F.col("text")).alias("plan_text")
    ),
    f"select doc_id, {views.clean_plan_sql('text')} as plan_text from documents",
)


def _order_plans(spark: SparkSession, sf: str) -> DataFrame:
    """One generated plan per order; the node depends on the priority."""
    orders = views.table_of(spark, sf, "orders")
    return orders.select(
        "o_orderkey", views.raw_plan(F.col("o_orderkey"), F.col("o_orderpriority")).alias("raw_plan")
    )


_ORDER_PLAN_SQL = views.RAW_PLAN_SQL.format(i="o_orderkey", node="o_orderpriority")

QUERIES["tele_clean_plan"] = Query(
    lambda spark, sf: _order_plans(spark, sf).select(
        "o_orderkey", pt.clean_plan(F.col("raw_plan")).alias("plan_text")
    ),
    f"select o_orderkey, {views.clean_plan_sql('raw_plan')} as plan_text from "
    f"(select o_orderkey, {_ORDER_PLAN_SQL} as raw_plan from orders)",
)


def _plan_flags(spark: SparkSession, sf: str) -> DataFrame:
    plans = views.tables(spark, sf)["dim_sql_plans"]
    text = F.col("raw_plan")
    return plans.select(
        "app_id", "sql_id", pt.plan_flags(text).alias("f"), pt.plan_node_count(text, "Exchange").alias("n_exchange")
    ).select("app_id", "sql_id", "f.*", F.col("n_exchange").cast("int"))


QUERIES["tele_plan_flags"] = Query(
    _plan_flags,
    with_views(
        "select app_id, sql_id, "
        + ", ".join(f"regexp_matches(ran, '\\b{node}\\b') as {flag}" for flag, node in pt.NODES.items())
        + ", regexp_matches(ran, '(?m)^ +.- Window .*\\n +.- Exchange SinglePartition') as has_unpartitioned_window, "
        "cast(len(regexp_extract_all(raw_plan, '\\bExchange\\b')) as int) as n_exchange "
        f"from (select *, {views.ran_plan_sql('raw_plan')} as ran from dim_sql_plans)"
    ),
)


# --- links between the tables ----------------------------------------------------------

DAY = 86400


def _metrics_during(spark: SparkSession, sf: str) -> DataFrame:
    t = views.tables(spark, sf)
    during = mp.metrics_during(t["fact_stages"], t["fact_hardware_metrics"], DAY)
    return during.groupBy("app_id", "stage_id", "attempt_id", "metric_name").agg(
        F.count(F.lit(1)).alias("n_samples"), F.max("value_kb_or_ms").alias("peak")
    )


_DURING = (
    "from fact_stages s join fact_hardware_metrics m on s.app_id = m.app_id "
    "and m.timestamp between s.start_time and s.end_time "
)

QUERIES["tele_metrics_during"] = Query(
    _metrics_during,
    with_views(
        "select s.app_id, stage_id, attempt_id, metric_name, count(*) as n_samples, max(value_kb_or_ms) as peak "
        + _DURING
        + "group by s.app_id, stage_id, attempt_id, metric_name"
    ),
)


def _stage_metrics(spark: SparkSession, sf: str) -> DataFrame:
    t = views.written_tables(spark, sf, ("fact_stages", "fact_hardware_metrics"))
    return mp.stage_metrics(t["fact_stages"], t["fact_hardware_metrics"], DAY // 4)


STAGE_METRICS_SQL = (
    "select s.app_id, stage_id, attempt_id, executor_id, metric_name, count(*) as n_samples, "
    "max(value_kb_or_ms) as peak, cast(sum(cast(value_kb_or_ms as decimal(24,2))) as double) / count(*) as mean, "
    "round_even(max({'t': timestamp, 'v': value_kb_or_ms}).v - min({'t': timestamp, 'v': value_kb_or_ms}).v, 2) "
    "as growth " + _DURING + "group by s.app_id, stage_id, attempt_id, executor_id, metric_name"
)

QUERIES["tele_stage_metrics"] = Query(_stage_metrics, with_views(STAGE_METRICS_SQL))


def _headroom(spark: SparkSession, sf: str) -> DataFrame:
    t = views.tables(spark, sf)
    return mp.memory_headroom(tel.metric_peaks(t["fact_hardware_metrics"]), t["fact_executors"])


QUERIES["tele_memory_headroom"] = Query(
    _headroom,
    with_views(
        "select app_id, executor_id, max(value_kb_or_ms) as peak_kb, max(max_memory_kb) as max_memory_kb, "
        "max(value_kb_or_ms) / max(max_memory_kb) as used_share from fact_hardware_metrics "
        f"join fact_executors using (app_id, executor_id) where metric_name = '{mp.MEMORY_METRIC}' "
        "group by app_id, executor_id"
    ),
)


# --- landed documents and event logs, table by table ------------------------------------------

_NEEDS = {
    "dim_applications": ("apps",),
    "fact_stages": ("apps", "stages", "task_summary"),
    "fact_executors": ("apps", "executors"),
    "dim_sql_plans": ("apps", "sql", "sql_detail"),
    "fact_hardware_metrics": ("apps", "metrics"),
    "map_jobs": ("apps", "jobs", "sql", "sql_detail"),
}


def _shown(df: DataFrame) -> DataFrame:
    """Nullable integers as -1, so that every engine returns whole numbers."""
    return df.withColumn("sql_id", F.coalesce("sql_id", F.lit(-1))) if "stage_ids" in df.columns else df


def _landed(table: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        path = landed.write_landing(spark, sf, _NEEDS[table])
        return _shown(tel.build_telemetry(spark, path, "lines")[table])

    return run


_ALL = {name: f"select * from {name}" for name in tel.TABLES}
_ALL["map_jobs"] = QUERIES["tele_map_jobs"].sql.rsplit("\n", 1)[1]
_LANDED = dict(_ALL)
_LANDED["fact_hardware_metrics"] = (
    "select m.* from fact_hardware_metrics m join dim_applications a using (app_id) "
    "where m.timestamp between a.start_time - interval 5 second and a.end_time + interval 5 second"
)

for _name, _sql in _LANDED.items():
    QUERIES[f"landed_{_name}"] = Query(_landed(_name), with_views(_sql))



def _answered(table: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        path = landed.write_landing(spark, sf, _NEEDS[table], "response")
        return tel.build_telemetry(spark, path)[table]

    return run


# the tables whose answers come once an application
for _name in ("dim_applications", "fact_executors", "fact_hardware_metrics"):
    QUERIES[f"answers_{_name}"] = Query(_answered(_name), with_views(_LANDED[_name]))

_LOGGED = dict(_ALL)
_LOGGED["dim_applications"] = (
    "select * replace (case when cast(split_part(app_id, '-', 2) as bigint) % 5 = 0 and app_id in "
    "(select app_id from map_jobs where job_id = 3) then 'FAILED' else 'SUCCEEDED' end as final_status) "
    "from dim_applications"
)
_LOG_METRICS = {
    "jvm_heap_used": "input_bytes * 1000",
    "ExecutorMetrics_JVMOffHeapMemory": "input_bytes * 10",
    "ExecutorMetrics_ProcessTreePythonRSSMemory": "run_time_ms * 7",
    "ExecutorMetrics_TotalGCTime": "run_time_ms // 10",
    "ExecutorMetrics_MajorGCTime": "0",
    "BlockManager_memory_memUsed_MB": "input_bytes * 320",
}
_LOGGED["fact_hardware_metrics"] = (
    "select app_id, epoch_ms(second * 1000) as timestamp, executor_id, metric_name, "
    f"case when contains(metric_name, 'Time') then cast(v as double) else {views.kb('v')} end as value_kb_or_ms "
    "from ("
    + " union all ".join(
        f"select app_id, executor_id, finish_ms // 1000 as second, '{m}' as metric_name, "
        f"max({{'t': finish_ms, 'v': cast({x} as bigint)}}).v as v from v_tasks group by app_id, executor_id, finish_ms // 1000"
        for m, x in _LOG_METRICS.items()
    )
    + ")"
)


def _logged(table: str):
    return lambda spark, sf: _shown(landed.event_log_tables(spark, sf, table))


for _name, _sql in _LOGGED.items():
    QUERIES[f"eventlog_{_name}"] = Query(_logged(_name), with_views(_sql))

QUERIES["eventlog_kinds"] = Query(
    landed.event_kinds,
    with_views(
        "select app_id, kind, count(*) as n_events from ("
        "select app_id, 'task_end' as kind from v_tasks union all "
        "select app_id, 'stage_completed' from fact_stages union all "
        "select app_id, unnest(['job_start', 'job_end']) from map_jobs union all "
        "select app_id, unnest(['sql_start', 'sql_update', 'sql_end']) from dim_sql_plans union all "
        "select app_id, unnest(['executor_added', 'block_manager_added']) from fact_executors union all "
        "select app_id, 'executor_removed' from fact_executors where executor_id = '3' union all "
        "select app_id, unnest(['app_start', 'app_end']) from dim_applications) group by app_id, kind"
    ),
)


# --- the store ---------------------------------------------------------------------------------


def _store_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Load all applications, offer them again, read the store."""
    tables = views.written_tables(spark, sf)
    out = scratch_path(spark, "store")
    st.load_tables(tables, out, "first")
    st.load_new(spark, tables, out)
    stored = st.read_store(spark, out)
    stages = stored["fact_stages"].groupBy("app_id").agg(
        F.count(F.lit(1)).alias("n_stages"), F.sum("executor_run_time_ms").alias("stage_time_ms")
    )
    samples = stored["fact_hardware_metrics"].groupBy("app_id").agg(F.count(F.lit(1)).alias("n_samples"))
    out_df = stored["dim_applications"].select("app_id", "duration_ms").join(stages, "app_id")
    return out_df.join(samples, "app_id", "left").withColumn(
        "n_samples", F.coalesce("n_samples", F.lit(0))
    )


QUERIES["store_roundtrip"] = Query(
    _store_roundtrip,
    with_views(
        "select app_id, duration_ms, n_stages, stage_time_ms, coalesce(n_samples, 0) as n_samples "
        "from dim_applications join (select app_id, count(*) as n_stages, "
        "cast(sum(executor_run_time_ms) as bigint) as stage_time_ms from fact_stages group by app_id) "
        "using (app_id) left join (select app_id, count(*) as n_samples from fact_hardware_metrics "
        "group by app_id) using (app_id)"
    ),
)


def _new_apps(spark: SparkSession, sf: str) -> DataFrame:
    """Landed applications when those with more than 500 samples are loaded."""
    t = views.tables(spark, sf)
    sampled = t["fact_hardware_metrics"].groupBy("app_id").agg(F.count(F.lit(1)).alias("n"))
    loaded = sampled.filter(F.col("n") > 500)
    return st.new_apps(t["dim_applications"], loaded).select("app_id", "duration_ms")


QUERIES["incremental_new_apps"] = Query(
    _new_apps,
    with_views(
        "select app_id, duration_ms from dim_applications where app_id not in "
        "(select app_id from fact_hardware_metrics group by app_id having count(*) > 500)"
    ),
)
