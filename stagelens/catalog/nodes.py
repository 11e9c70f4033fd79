"""Plan nodes of the derived event logs: their metrics, the stages they ran in, and what rules make of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import Query, landed, views
from .diagnosis import STAGE_PLANS
from .views import with_views

# stages as the derived logs tie them to queries: odd ones read the exchange, even ones write it
_SIDES = (
    "select app_id, stage_id, attempt_id, count(*) as n, sum(disk_spill_bytes) as spilled, stage_id % 2 = 1 as reads, "
    "cast((stage_id // 2) % 8 + 1 as int) as sql_id from v_tasks group by app_id, stage_id, attempt_id"
)
_TREE = (
    "select app_id, i as sql_id, k as node_id, k - 1 as parent_id, k < 2 as reads, case k when 0 then 'WholeStageCodegen (1)' "
    f"when 1 then node when 2 then 'Exchange' else 'Scan parquet' end as node_name from v_apps, (values {views.PLAN_ROWS}) p(i, node), "
    "(values (0), (1), (2), (3)) t(k)"
)
_TOTALS = "select app_id, sql_id, reads, max(n) as total_n, max(spilled) as total_spilled from v_sides group by app_id, sql_id, reads"
_CTES = {"v_sides": _SIDES, "v_tree": _TREE, "v_totals": _TOTALS}

QUERIES: dict[str, Query] = {}


def _stage_nodes(spark: SparkSession, sf: str) -> DataFrame:
    found = landed.event_log_tables(spark, sf, "fact_stage_nodes")
    return found.withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("parent_id", "rows_out", "spill_kb")})


QUERIES["eventlog_fact_stage_nodes"] = Query(
    _stage_nodes,
    with_views(
        "select app_id, sql_id, stage_id, attempt_id, node_id, parent_id, node_name, "
        "case when node_id in (1, 3) then total_n else -1 end as rows_out, "
        f"case when node_id = 1 then {views.kb('total_spilled')} else cast(-1 as double) end as spill_kb "
        "from v_sides join v_tree using (app_id, sql_id, reads) join v_totals using (app_id, sql_id, reads)",
        **_CTES,
    ),
)

QUERIES["eventlog_node_metrics"] = Query(
    landed.node_totals,
    with_views(
        "select app_id, sql_id, node_id, node_name, m as metric_name, cast(coalesce(case when m = 'number of output rows' "
        "then total_n when m = 'spill size' then total_spilled end, 0) as bigint) as value from v_tree join (values "
        "(0, 'duration'), (1, 'number of output rows'), (1, 'spill size'), (2, 'shuffle bytes written'), "
        "(3, 'number of output rows')) c(node_id, m) using (node_id) left join v_totals using (app_id, sql_id, reads)",
        **_CTES,
    ),
)

# a stage whose nodes are not known is judged by the plan of its query
_HERE = "case when node is null then regexp_matches(ran_plan, '\\b{0}\\b') else reads and node = '{0}' end"

QUERIES["eventlog_node_findings"] = Query(
    landed.node_findings,
    with_views(
        "select app_id, 'spilling_sort_merge_join' as rule_id, stage_id, '' as spilling_nodes from v_judged "
        f"where {_HERE.format('SortMergeJoin')} and disk_spill_kb > 0 "
        "union all select app_id, 'healthy_broadcast_join', stage_id, '' from v_judged "
        f"where {_HERE.format('BroadcastHashJoin')} and input_bytes_kb > 0 and shuffle_write_kb < input_bytes_kb * 0.01 "
        "union all select app_id, 'spill', stage_id, case when reads and total_spilled > 0 then node else '' end "
        "from v_judged where memory_spill_kb + disk_spill_kb > 0",
        **_CTES,
        stage_plans=STAGE_PLANS,
        v_nodes="select s.app_id, s.stage_id, s.attempt_id, node, total_spilled, reads from v_sides s join "
        f"(values {views.PLAN_ROWS}) p(i, node) on sql_id = i join v_totals t using (app_id, sql_id, reads)",
        v_judged="select * from stage_plans left join v_nodes using (app_id, stage_id, attempt_id)",
    ),
)
