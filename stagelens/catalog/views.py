"""Telemetry derived from the test tables, in Spark and as DuckDB CTEs.

Applications, stages and tasks grow with the data: 750 orders are one
application, 30 orders one stage, every line item one task, every event one
hardware sample. Text that both engines run unchanged is stated once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..plans import telemetry as tel
from ..session import scratch_path
from ..sources.tables import read_table, spread, write_table

# 2024-01-01 00:00:00 UTC in epoch milliseconds
START_MS = 1704067200000

TASKS_SQL = f"""
select app_id, stage_id, attempt_id, executor_id, task_id, launch_ms,
       launch_ms + run_time_ms as finish_ms, run_time_ms, input_bytes, shuffle_read_bytes,
       shuffle_write_bytes, memory_spill_bytes, disk_spill_bytes
from (
  select concat('app-', cast(app_no as string)) as app_id, stage_id,
         case when stage_id = 0 and l_linenumber = 7 then 1 else 0 end as attempt_id,
         cast(l_linenumber % 4 as string) as executor_id,
         l_orderkey * 10 + l_linenumber as task_id,
         {START_MS} + stage_id * cast(86400000 as bigint) + l_linenumber * 21600000 as launch_ms,
         cast(floor(l_extendedprice) as bigint)
           * case when stage_id = 25 then 5000
                  when l_orderkey % 97 = 0 and l_linenumber = 1 then 10 else 1 end as run_time_ms,
         cast(floor(l_quantity * 1000) as bigint) as input_bytes,
         cast(floor(l_quantity) as bigint) * 131 as shuffle_read_bytes,
         case when stage_id = 7 then 10 else cast(floor(l_discount * 100) as bigint) * 257 end
           as shuffle_write_bytes,
         case when l_returnflag = 'R' then cast(floor(l_quantity) as bigint) * 512 else 0 end
           as memory_spill_bytes,
         case when l_returnflag = 'R' then cast(floor(l_tax * 100) as bigint) * 131 else 0 end
           as disk_spill_bytes
  from (select *, cast(floor(l_orderkey / 750.0) as bigint) as app_no,
               case when l_orderkey % 750 = 749 then 25
                    else cast(floor((l_orderkey % 750) / 30.0) as int) end as stage_id
        from lineitem) l
) t
"""


def _floor_div(x: str, n: int) -> str:
    return f"(({x} - pmod({x}, {n})) div {n})"


# of Spark: whole numbers divided as such, where a decimal quotient of each row costs more than all the rest
_APP_NO = _floor_div("l_orderkey", 750)
_SPARK_TASKS_SQL = TASKS_SQL.replace("floor(l_orderkey / 750.0)", _APP_NO).replace("floor((l_orderkey % 750) / 30.0)", _floor_div("(l_orderkey % 750)", 30))

# what TASKS_SQL reads
TASK_ITEMS = ("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag")

SAMPLES_SQL = """
select concat('app-', cast(cast(floor(user_id * 2 / 15.0) as bigint) as string)) as app_id, ts,
       cast(user_id % 4 as string) as executor_id,
       case event_type when 'click' then 'jvm_heap_used' when 'view' then 'ExecutorMetrics_TotalGCTime'
            when 'purchase' then 'BlockManager_memory_memUsed_MB'
            when 'error' then 'BlockManager_disk_diskSpaceUsed_MB'
            else 'ExecutorMetrics_ProcessTreePythonRSSMemory' end as metric_name,
       case when event_type = 'view' then value * 4000000 else value end as raw_value
from events
"""

# job -> plan node; jobs 0 and 5 run outside SQL
PLAN_NODES = {
    1: "SortMergeJoin",
    2: "BroadcastHashJoin",
    3: "CartesianProduct",
    4: "BroadcastNestedLoopJoin",
    6: "BatchEvalPython",
    7: "FileScan",
    8: "Window",
}

# a stage listed by a later job again
SKIPPED_STAGE, RELISTED_BY = 3, 6

EXECUTOR_KB = 250000


# Schemas of the test tables, so that opening one runs no job.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
    "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, "
    "props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
}


def table_of(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf}/{name}.parquet")


def _view(spark: SparkSession, sf: str, table: str, sql: str, *by: str) -> DataFrame:
    # test tables come in one small file each
    source = spread(table_of(spark, sf, table), spark.sparkContext.defaultParallelism, *by)
    return spark.sql(sql.replace(f"from {table}", "from {src}"), src=source)


def tasks(spark: SparkSession, sf: str) -> DataFrame:
    return _view(spark, sf, "lineitem", _SPARK_TASKS_SQL, "l_orderkey", "l_linenumber")


def written_tasks(spark: SparkSession, sf: str) -> DataFrame:
    """The derived tasks written out, for queries that read them many times.

    Line items move once, to those of their application, and become tasks there:
    they are narrower. Totals by application or stage then combine in the tasks
    that read them, and little is shuffled.
    """
    path = scratch_path(spark, "tasks")
    items = table_of(spark, sf, "lineitem").select(*TASK_ITEMS)
    moved = items.withColumn("app_no", F.expr(_APP_NO)).hint("rebalance", "app_no").drop("app_no")
    # in order of their orders, items are in order of application and stage; one number sorts faster than texts
    moved = moved.sortWithinPartitions("l_orderkey")
    derived = spark.sql(_SPARK_TASKS_SQL.replace("from lineitem", "from {src}"), src=moved)
    write_table(derived, path)
    return read_table(spark, path)


def samples(spark: SparkSession, sf: str) -> DataFrame:
    return _view(spark, sf, "events", SAMPLES_SQL, "event_id")


def metrics(spark: SparkSession, sf: str) -> DataFrame:
    value = sc.metric_value(F.col("metric_name"), F.col("raw_value"))
    return samples(spark, sf).select(
        "app_id", F.col("ts").alias("timestamp"), "executor_id", "metric_name",
        value.alias("value_kb_or_ms"),
    )


def app_spans(t: DataFrame) -> DataFrame:
    return t.groupBy("app_id").agg(
        F.min("launch_ms").alias("start_ms"), F.max("finish_ms").alias("end_ms")
    )


def jobs(t: DataFrame) -> DataFrame:
    """``app_id, job_id, sql_id, stages array<int>``; at most four stages per job."""
    job = F.floor(F.col("stage_id") / F.lit(3.0)).cast("int")
    again = F.when(F.col("stage_id") == SKIPPED_STAGE, F.array(job, F.lit(RELISTED_BY))).otherwise(
        F.array(job)
    )
    listed = t.groupBy("app_id", "stage_id").agg(F.lit(1).alias("_one")).select(
        "app_id", "stage_id", F.explode(again).alias("job_id")
    )
    sql_id = F.when(F.col("job_id") % 5 != 0, F.col("job_id"))
    return listed.groupBy("app_id", "job_id").agg(
        F.sort_array(F.collect_set("stage_id")).alias("stages")
    ).withColumn("sql_id", sql_id)


def plans(apps: DataFrame) -> DataFrame:
    """``app_id, sql_id, raw_plan``: the same seven queries for every application."""
    rows = F.array(
        *[
            F.struct(F.lit(i).alias("sql_id"), F.lit(node).alias("node"))
            for i, node in PLAN_NODES.items()
        ]
    )
    return apps.select("app_id", F.explode(rows).alias("p")).select(
        "app_id", "p.sql_id", raw_plan(F.col("p.sql_id"), F.col("p.node")).alias("raw_plan")
    )


# more lines than the cleaner keeps, then a plan that never ran
FILLER_LINE = "   :  +- Filter (x#3 > 1)"
FILLER_LINES = 60
FILLER = f"\n{FILLER_LINE}" * FILLER_LINES
INITIAL = "\n== Initial Plan ==\n"


def raw_plan(sql_id, node):
    """Plan text with the noise the cleaner removes, longer than it keeps, with an initial plan."""
    i = sql_id.cast("string")
    columns = [x for c in "abcdef" for x in (F.lit(f"{c}#"), i, F.lit(", "))]
    return F.concat(
        F.lit("== Physical Plan ==\n*("), i, F.lit(") Project ["), *columns,
        F.lit("g#"), i, F.lit("L] [codegen id : "), i, F.lit("]\n   +- "), node,
        F.lit(" [x#1]\n      +- Exchange SinglePartition\nplain words"),
        F.lit(FILLER), F.lit(INITIAL), F.lit("      +- CartesianProduct\n\n(7) Sort\nInput: late"),
    )


RAW_PLAN_SQL = (
    "concat('== Physical Plan ==', chr(10), '*(', {i}, ') Project [', "
    + "".join(f"'{c}#', {{i}}, ', ', " for c in "abcdef")
    + "'g#', {i}, 'L] [codegen id : ', {i}, ']', chr(10), '   +- ', {node}, "
    "' [x#1]', chr(10), '      +- Exchange SinglePartition', chr(10), 'plain words', "
    + f"repeat(chr(10) || '{FILLER_LINE}', {FILLER_LINES}), chr(10), '== Initial Plan ==', chr(10), "
    "'      +- CartesianProduct', chr(10), chr(10), '(7) Sort', chr(10), 'Input: late')"
)


def executors(t: DataFrame) -> DataFrame:
    return t.groupBy("app_id", "executor_id").agg(F.lit(1).alias("_one")).select(
        "app_id",
        "executor_id",
        ((F.lit(EXECUTOR_KB) + 1000 * F.col("executor_id").cast("int")) * 1024)
        .cast("bigint")
        .alias("max_memory"),
    )


def tables(spark: SparkSession, sf: str, t: DataFrame | None = None) -> dict[str, DataFrame]:
    """The six telemetry tables straight from the derived tasks and samples."""
    t = tasks(spark, sf) if t is None else t
    spans = {
        "start_time": sc.epoch_ms_to_ts(F.min("launch_ms")),
        "end_time": sc.epoch_ms_to_ts(F.max("finish_ms")),
    }
    stages = tel.attach_task_quantiles(tel.stage_totals(t, spans), tel.task_quantiles(t))
    apps = app_spans(t)
    out = {
        "dim_applications": apps.select(
            "app_id",
            F.concat(F.lit("job of "), F.col("app_id")).alias("app_name"),
            sc.epoch_ms_to_ts(F.col("start_ms")).alias("start_time"),
            sc.epoch_ms_to_ts(F.col("end_ms")).alias("end_time"),
            (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"),
            F.lit("SUCCEEDED").alias("final_status"),
        ),
        "fact_stages": stages,
        "fact_executors": executors(t).select(
            "app_id",
            "executor_id",
            F.concat(F.lit("10.0.0."), F.col("executor_id")).alias("host_ip"),
            F.lit(4).alias("total_cores"),
            sc.to_kb(F.col("max_memory")).alias("max_memory_kb"),
            (F.col("executor_id") != "3").alias("is_active"),
            F.when(F.col("executor_id") == "3", "lost").otherwise("N/A").alias("exit_reason"),
        ),
        "dim_sql_plans": plans(apps).select(
            "app_id",
            "sql_id",
            F.concat(F.lit("query "), F.col("sql_id").cast("string")).alias("description"),
            tel.pt.clean_plan(F.col("raw_plan")).alias("plan_text"),
            "raw_plan",
            (F.col("sql_id") * 1000).cast("bigint").alias("duration_ms"),
        ),
        "fact_hardware_metrics": metrics(spark, sf),
        "map_jobs": jobs(t).select(
            "app_id", "job_id", "sql_id", sc.join_ids(F.col("stages")).alias("stage_ids")
        ),
    }
    return {name: tel.conform(df, name) for name, df in out.items()}


def written_tables(spark: SparkSession, sf: str, names: tuple[str, ...] = tuple(tel.TABLES)) -> dict[str, DataFrame]:
    """The derived tables written out first, as rules find them in a store.

    For queries that use a table more than once, which would otherwise derive
    it from the tasks each time.
    """
    out = {}
    for name, df in tables(spark, sf, written_tasks(spark, sf)).items():
        if name in names:
            path = scratch_path(spark, name)
            write_table(df, path)
            out[name] = read_table(spark, path)
    return out


# --- DuckDB counterparts ----------------------------------------------------------


def kb(x: str) -> str:
    return f"round_even(cast(coalesce({x}, 0) as double) / 1024, 2)"


METRIC_VALUE_SQL = (
    "case when contains(metric_name, 'Time') then round_even(raw_value, 2) "
    "when contains(metric_name, '_MB') then round_even(raw_value * 1024, 2) "
    "else round_even(raw_value / 1024, 2) end"
)

_MARKED = " or ".join(f"contains(l, '{m}')" for m in tel.pt.LINE_MARKS)
_SPACES = " || ".join(f"chr({ord(c)})" for c in tel.pt.WHITESPACE)


def keep_lines_sql(text: str) -> str:
    return (
        f"coalesce(array_to_string(list_transform(list_filter(string_split({text}, chr(10)), "
        f"lambda l: {_MARKED}), lambda l: trim(l, {_SPACES}))[1:{tel.pt.MAX_LINES}], chr(10)), '')"
    )


# one list item holds no "]" and no ", "
_ITEM = r"(?:[^,\]\n]|,+[^, \]\n])*,*"
LONG_LIST = rf"\[({_ITEM}, {_ITEM}, {_ITEM})(?:, {_ITEM}){{2,}}, ({_ITEM})\]"


def clean_plan_sql(text: str) -> str:
    masked = (
        f"regexp_replace(regexp_replace(coalesce({text}, ''), "
        r"'\[codegen id : \d+\]', '', 'g'), '#\d+', '#ID', 'g')"
    )
    short = f"regexp_replace({masked}, '{LONG_LIST}', '[\\1, ..., \\2]', 'g')"
    return keep_lines_sql(short)


def ran_plan_sql(text: str) -> str:
    """Without initial plans, and without the one section of details no tree names."""
    return f"regexp_replace(regexp_replace({text}, '(?s)== Initial Plan ==.*?(\\n\\n|$)', '\\1', 'g'), '\\n\\n\\(7\\)(?s:.*)$', '')"


def median_sql(group: str, value: str, source: str) -> str:
    """Element floor(n / 2) of each sorted group."""
    return (
        f"select {group}, {value} as v from (select {group}, {value}, "
        f"row_number() over (partition by {group} order by {value}) as rn, "
        f"count(*) over (partition by {group}) as n from {source}) where rn = n // 2 + 1"
    )


PLAN_ROWS = ", ".join(f"({i}, '{n}')" for i, n in PLAN_NODES.items())
_BY = "app_id, stage_id, attempt_id"

CTES = {
    "v_tasks": TASKS_SQL,
    "v_samples": SAMPLES_SQL,
    "v_apps": "select app_id, min(launch_ms) as start_ms, max(finish_ms) as end_ms "
    "from v_tasks group by app_id",
    "v_listed": f"select app_id, stage_id, stage_id // 3 as job_id from "
    "(select distinct app_id, stage_id from v_tasks) union all "
    f"select distinct app_id, stage_id, {RELISTED_BY} from v_tasks where stage_id = {SKIPPED_STAGE}",
    "dim_applications": "select app_id, 'job of ' || app_id as app_name, epoch_ms(start_ms) as start_time, "
    "epoch_ms(end_ms) as end_time, end_ms - start_ms as duration_ms, 'SUCCEEDED' as final_status "
    "from v_apps",
    "v_median": median_sql(_BY, "run_time_ms", "v_tasks"),
    "fact_stages": f"select {_BY}, epoch_ms(min(launch_ms)) as start_time, "
    "epoch_ms(max(finish_ms)) as end_time, cast(count(*) as int) as num_tasks, "
    "cast(sum(run_time_ms) as bigint) as executor_run_time_ms, "
    f"{kb('sum(input_bytes)')} as input_bytes_kb, "
    f"{kb('sum(shuffle_read_bytes)')} as shuffle_read_kb, "
    f"{kb('sum(shuffle_write_bytes)')} as shuffle_write_kb, "
    f"{kb('sum(memory_spill_bytes)')} as memory_spill_kb, "
    f"{kb('sum(disk_spill_bytes)')} as disk_spill_kb, "
    "max(v) as task_duration_median_ms, max(run_time_ms) as task_duration_max_ms "
    f"from v_tasks join v_median using ({_BY}) group by {_BY}",
    "fact_executors": "select distinct app_id, executor_id, '10.0.0.' || executor_id as host_ip, "
    f"4 as total_cores, cast({EXECUTOR_KB} + 1000 * cast(executor_id as int) as double) as max_memory_kb, "
    "executor_id <> '3' as is_active, "
    "case when executor_id = '3' then 'lost' else 'N/A' end as exit_reason from v_tasks",
    "dim_sql_plans": "select app_id, i as sql_id, 'query ' || i as description, "
    + clean_plan_sql(RAW_PLAN_SQL.format(i="i", node="node"))
    + " as plan_text, " + RAW_PLAN_SQL.format(i="i", node="node") + " as raw_plan, cast(i * 1000 as bigint) as duration_ms "
    f"from v_apps, (values {PLAN_ROWS}) p(i, node)",
    "fact_hardware_metrics": f"select app_id, ts as timestamp, executor_id, metric_name, {METRIC_VALUE_SQL} "
    "as value_kb_or_ms from v_samples",
    "map_jobs": "select app_id, cast(job_id as int) as job_id, "
    "case when job_id % 5 <> 0 then cast(job_id as int) end as sql_id, "
    "array_to_string(list_sort(list(distinct stage_id)), ',') as stage_ids "
    "from v_listed group by app_id, job_id",
}


def with_views(body: str, **extra: str) -> str:
    """``body`` below the derived views it may name, plus further CTEs."""
    parts = [f"{name} as ({sql})" for name, sql in {**CTES, **extra}.items()]
    return "with " + ",\n".join(parts) + "\n" + body
