"""Diagnosis queries over the derived telemetry tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import plan_text as pt
from ..plans import mapping as mp
from ..plans import rules
from ..plans.report import RULE_TEXT, SEVERITIES, report
from . import Query, views
from .telemetry import DAY, STAGE_METRICS_SQL
from .views import with_views

# Thresholds that fit the derived data
TH = rules.Thresholds(skew_ratio=4.0, rss_ratio=3.5)

QUERIES: dict[str, Query] = {}


def _order_sql(by: str) -> str:
    return " + ".join(mp.BOTTLENECK_BY[by]) + " desc, stage_id, attempt_id"


def _top_stages(by: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        top = mp.top_stages(views.tables(spark, sf)["fact_stages"], 3, by)
        return top.select("app_id", "stage_id", "attempt_id", "rank")

    return Query(
        run,
        with_views(
            "select * from (select app_id, stage_id, attempt_id, cast(row_number() over (partition by app_id "
            f"order by {_order_sql(by)}) as int) as rank from fact_stages) where rank <= 3"
        ),
    )


for _by in mp.BOTTLENECK_BY:
    QUERIES[f"diag_top_stages_{_by}"] = _top_stages(_by)

STAGE_PLANS = (
    "select s.*, j.job_id, j.sql_id, coalesce(p.plan_text, '') as plan_text, " + views.ran_plan_sql("coalesce(p.raw_plan, '')") + " as ran_plan from fact_stages s left join "
    "(select app_id, stage_id, min(job_id) as job_id, arg_min(coalesce(sql_id, -1), job_id) as sql_id from "
    "(select app_id, job_id, sql_id, cast(unnest(string_split(stage_ids, ',')) as int) as stage_id from map_jobs) "
    "group by app_id, stage_id) j using (app_id, stage_id) left join dim_sql_plans p using (app_id, sql_id)"
)


def _has(node: str) -> str:
    return f"regexp_matches(ran_plan, '\\b{node}\\b')"


_WINDOW = "regexp_matches(ran_plan, '(?m)^ +.- Window .*\\n +.- Exchange SinglePartition')"


def _stage_to_plan(spark: SparkSession, sf: str) -> DataFrame:
    t = views.tables(spark, sf)
    linked = mp.stage_to_plan(t["fact_stages"], t["map_jobs"], t["dim_sql_plans"], with_text=True)
    return linked.select(
        "app_id",
        "stage_id",
        "attempt_id",
        "job_id",
        F.coalesce("sql_id", F.lit(-1)).alias("sql_id"),
        F.coalesce("plan_text", F.lit("")).alias("plan_text"),
        *pt.FLAGS,
    )


QUERIES["diag_stage_to_plan"] = Query(
    _stage_to_plan,
    with_views(
        "select app_id, stage_id, attempt_id, job_id, sql_id, plan_text, "
        + ", ".join(f"{_has(node)} as {flag}" for flag, node in pt.NODES.items())
        + f", {_WINDOW} as has_unpartitioned_window from stage_plans",
        stage_plans=STAGE_PLANS,
    ),
)

QUERIES["diag_app_overview"] = Query(
    lambda spark, sf: rules.app_overview(views.tables(spark, sf)),
    with_views(
        "select app_id, app_name, final_status, duration_ms, n_stages, stage_time_ms, n_tasks, n_jobs, n_queries "
        "from dim_applications join (select app_id, count(*) as n_stages, cast(sum(executor_run_time_ms) as bigint) "
        "as stage_time_ms, cast(sum(num_tasks) as bigint) as n_tasks from fact_stages group by app_id) using (app_id) "
        "join (select app_id, count(*) as n_jobs from map_jobs group by app_id) using (app_id) "
        "join (select app_id, count(*) as n_queries from dim_sql_plans group by app_id) using (app_id)"
    ),
)


# --- rules: common columns plus the evidence that identifies a finding ------------------------

_KB = "cast(cast({0} as decimal(38,2)) as varchar)"

# rule -> (Spark rule, evidence key shown, SQL returning app_id, severity, stage_id, sql_id, evidence)
_RULES: dict[str, tuple[Callable, str, str]] = {
    "data_skew": (
        rules.data_skew,
        "task_duration_max_ms",
        f"select app_id, case when task_duration_max_ms > {2 * TH.skew_ratio} * greatest(task_duration_median_ms, 1) "
        "then 'high' else 'medium' end as severity, stage_id, sql_id, "
        "cast(task_duration_max_ms as varchar) as shown from stage_plans "
        f"where task_duration_max_ms > {TH.skew_ratio} * greatest(task_duration_median_ms, 1)",
    ),
    "spilling_sort_merge_join": (
        rules.spilling_sort_merge_join,
        "disk_spill_kb",
        f"select app_id, 'high' as severity, stage_id, sql_id, {_KB.format('disk_spill_kb')} as shown "
        f"from stage_plans where {_has('SortMergeJoin')} and disk_spill_kb > 0",
    ),
    "healthy_broadcast_join": (
        rules.healthy_broadcast_join,
        "input_bytes_kb",
        f"select app_id, 'info' as severity, stage_id, sql_id, {_KB.format('input_bytes_kb')} as shown "
        f"from stage_plans where {_has('BroadcastHashJoin')} and input_bytes_kb > 0 "
        f"and shuffle_write_kb < input_bytes_kb * {TH.shuffle_share}",
    ),
    "unpartitioned_window": (
        rules.unpartitioned_window,
        "executor_run_time_ms",
        "select app_id, 'high' as severity, stage_id, sql_id, cast(executor_run_time_ms as varchar) as shown "
        f"from stage_plans where {_WINDOW} and num_tasks = 1",
    ),
    "nested_loop_join": (
        rules.nested_loop_join,
        "shuffle_write_kb",
        "select app_id, 'high' as severity, arg_max(stage_id, {'w': shuffle_write_kb, 's': -stage_id}) as stage_id, "
        "sql_id, cast(cast(sum(cast(shuffle_write_kb as decimal(24,2))) as decimal(38,2)) as varchar) as shown "
        f"from stage_plans where {_has('CartesianProduct')} or {_has('BroadcastNestedLoopJoin')} "
        "group by app_id, sql_id having sum(shuffle_write_kb) > 0",
    ),
    "single_task_stage": (
        rules.single_task_stage,
        "executor_run_time_ms",
        "select app_id, 'high' as severity, last.stage_id as stage_id, -1 as sql_id, "
        "cast(last.run as varchar) as shown from (select app_id, max({'e': end_time, 'stage_id': stage_id, "
        "'a': attempt_id, 'n': num_tasks, 'run': executor_run_time_ms}) as last, sum(executor_run_time_ms) as total "
        f"from fact_stages group by app_id) where last.n = 1 and last.run >= total * {TH.single_task_share}",
    ),
    "spill": (
        rules.spill_ranking,
        "rank",
        "select app_id, case when disk_spill_kb > 0 then 'medium' else 'low' end as severity, stage_id, -1 as sql_id, "
        "cast(rank as varchar) as shown from (select *, row_number() over (partition by app_id order by "
        f"{_order_sql('spill')}) as rank from fact_stages where memory_spill_kb + disk_spill_kb > 0)",
    ),
    "python_memory": (
        rules.python_memory,
        "executor_id",
        "select app_id, 'high' as severity, -1 as stage_id, sql_id, executor_id as shown from peaks join "
        f"(select app_id, min(sql_id) as sql_id from (select *, {views.ran_plan_sql('raw_plan')} as ran_plan from dim_sql_plans) where {_has('BatchEvalPython')} "
        f"or {_has('ArrowEvalPython')} group by app_id) using (app_id) "
        f"where metric_name = '{rules.RSS_METRIC}' and peak > mean * {TH.rss_ratio}",
    ),
    "cache_limit": (
        rules.cache_limit,
        "executor_id",
        "select app_id, 'medium' as severity, -1 as stage_id, -1 as sql_id, executor_id as shown "
        "from peaks join fact_executors using (app_id, executor_id) "
        f"where metric_name = '{mp.MEMORY_METRIC}' and peak / max_memory_kb >= {TH.memory_share}",
    ),
    "gc_pressure": (
        rules.gc_pressure,
        "executor_id",
        "select app_id, 'medium' as severity, -1 as stage_id, -1 as sql_id, executor_id as shown "
        "from peaks join dim_applications using (app_id) "
        f"where metric_name = '{rules.GC_METRIC}' and duration_ms > 0 and growth >= duration_ms * {TH.gc_share}",
    ),
}

_EXTRA = {
    "stage_plans": STAGE_PLANS,
    "peaks": "select app_id, executor_id, metric_name, max(value_kb_or_ms) as peak, "
    "cast(sum(cast(value_kb_or_ms as decimal(24,2))) as double) / count(*) as mean, "
    "round_even(max({'t': timestamp, 'v': value_kb_or_ms}).v - min({'t': timestamp, 'v': value_kb_or_ms}).v, 2) "
    "as growth from fact_hardware_metrics group by app_id, executor_id, metric_name",
}


def _shown(found: DataFrame, key: str) -> DataFrame:
    return found.select(
        "app_id",
        "rule_id",
        "severity",
        F.coalesce("stage_id", F.lit(-1)).alias("stage_id"),
        F.coalesce("sql_id", F.lit(-1)).alias("sql_id"),
        F.col("evidence")[key].alias("shown"),
    )


def _rule(name: str) -> Query:
    rule, key, sql = _RULES[name]
    return Query(
        lambda spark, sf: _shown(rule(views.tables(spark, sf), TH), key),
        with_views(
            f"select app_id, '{name}' as rule_id, severity, stage_id, coalesce(sql_id, -1) as sql_id, shown "
            f"from ({sql})",
            **_EXTRA,
        ),
    )


for _name in _RULES:
    QUERIES[f"diag_{_name}"] = _rule(_name)


def _bottleneck_metrics(spark: SparkSession, sf: str) -> DataFrame:
    t = views.written_tables(spark, sf, ("fact_stages", "fact_hardware_metrics"))
    return rules.bottleneck_metrics(t, 3, "duration", DAY // 4)


QUERIES["diag_bottleneck_metrics"] = Query(
    _bottleneck_metrics,
    with_views(
        STAGE_METRICS_SQL.replace("from fact_stages s", "from worst s"),
        worst="select * from (select *, row_number() over (partition by app_id order by "
        f"{_order_sql('duration')}) as rank from fact_stages) where rank <= 3",
    ),
)


def _report(spark: SparkSession, sf: str) -> DataFrame:
    found = report(views.written_tables(spark, sf), TH)
    return found.select(
        "app_id",
        "rule_id",
        "severity",
        "severity_rank",
        F.coalesce("stage_id", F.lit(-1)).alias("stage_id"),
        F.coalesce("sql_id", F.lit(-1)).alias("sql_id"),
        F.to_json(F.map_from_entries(F.array_sort(F.map_entries("evidence")))).alias("evidence"),
        "root_cause",
        "spark_ui_mapping",
        "recommended_fix",
    )


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_TEXT_ROWS = ", ".join(
    f"({_quoted(r)}, {', '.join(_quoted(w) for w in words)})" for r, words in RULE_TEXT.items()
)
_RANKS = " ".join(f"when '{s}' then {i + 1}" for i, s in enumerate(SEVERITIES))

QUERIES["diag_report"] = Query(
    lambda spark, sf: _report(spark, sf).drop("evidence"),
    with_views(
        f"select app_id, rule_id, severity, cast(case severity {_RANKS} end as int) as severity_rank, stage_id, "
        "coalesce(sql_id, -1) as sql_id, root_cause, spark_ui_mapping, recommended_fix from ("
        + " union all ".join(
            f"select app_id, '{n}' as rule_id, severity, stage_id, sql_id from ({sql})"
            for n, (_, _, sql) in _RULES.items()
        )
        + f") join (values {_TEXT_ROWS}) t(rule_id, root_cause, spark_ui_mapping, recommended_fix) using (rule_id)",
        **_EXTRA,
    ),
)
