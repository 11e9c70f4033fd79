"""Applications with a known flaw, run with event logging on, must be diagnosed as such."""

import json
import subprocess
import sys
from pathlib import Path

import pytest

from stagelens.functions import plan_text as pt
from stagelens.plans import mapping, nodes, report, rules
from stagelens.plans import store as st
from stagelens.plans import telemetry as tel
from stagelens.sources import event_log as el


def run_apps(tmp_path_factory, form, *names):
    logs = tmp_path_factory.mktemp(f"logs-{form}")
    script = Path(__file__).parent / "labelled_apps.py"
    subprocess.run(
        [sys.executable, str(script), str(logs), form, *names],
        check=True, timeout=300, stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL,
    )
    return str(logs)


@pytest.fixture(scope="module")
def logged(spark, tmp_path_factory):
    tables = tel.build_from_event_log(spark, run_apps(tmp_path_factory, "plain"), with_nodes=True)
    return {n: df.checkpoint() for n, df in tables.items()}


@pytest.fixture(scope="module")
def names(logged):
    return {r.app_id: r.app_name for r in logged["dim_applications"].collect()}


EXPECTED = {
    "skew": "data_skew",
    "sort_merge": "spilling_sort_merge_join",
    "broadcast": "healthy_broadcast_join",
    "window": "unpartitioned_window",
    "pairs": "nested_loop_join",
    "single": "single_task_stage",
}


def test_every_flaw_is_found(logged, names):
    found = report.report(logged).collect()
    by_app = {}
    for f in found:
        by_app.setdefault(names[f.app_id], set()).add(f.rule_id)
        assert f.root_cause and f.spark_ui_mapping and f.recommended_fix
    for app, rule in EXPECTED.items():
        assert rule in by_app.get(app, set()), (app, by_app)
    # the healthy join gets no complaint
    assert by_app["broadcast"] == {"healthy_broadcast_join"}


def test_the_spill_is_ranked(logged, names):
    spilled = {names[r.app_id] for r in rules.spill_ranking(logged).collect()}
    assert "sort_merge" in spilled


def test_findings_stand_at_the_stage_of_their_node(logged, names):
    joins = rules.spilling_sort_merge_join(logged).collect()
    assert {names[r.app_id] for r in joins} == {"sort_merge"}
    # without the nodes the join of the query is blamed for the spill of a later sort
    plain = {n: df for n, df in logged.items() if n != "fact_stage_nodes"}
    assert "sort_after_join" in {names[r.app_id] for r in rules.spilling_sort_merge_join(plain).collect()}
    spilled = {names[r.app_id]: r.evidence for r in rules.spill_ranking(logged).collect()}
    assert spilled["sort_after_join"]["spilling_nodes"] == "Sort"
    assert all("spilling_nodes" not in r.evidence for r in rules.spill_ranking(plain).collect())


def test_the_healthy_join_is_found_where_it_joins(logged, names):
    found = [r for r in rules.healthy_broadcast_join(logged).collect() if names[r.app_id] == "broadcast"]
    nodes_at = {(r.app_id, r.stage_id) for r in logged["fact_stage_nodes"].collect() if r.node_name == "BroadcastHashJoin"}
    # not the stage that reads the small side to send it
    assert found and {(r.app_id, r.stage_id) for r in found} <= nodes_at


def test_nodes_hold_their_rows(logged, names):
    rows = [r for r in logged["fact_stage_nodes"].collect() if names[r.app_id] == "sort_after_join"]
    joins = {(r.rows_out, r.stage_id) for r in rows if r.node_name == "SortMergeJoin"}
    assert {n for n, _ in joins} == {3000} and len(joins) == 1
    sorts = [r for r in rows if r.node_name == "Sort" and r.spill_kb]
    # the join's own sorts ran in its stage and did not spill
    assert sorts and {r.stage_id for r in sorts}.isdisjoint({s for _, s in joins})
    generated = {r.rows_out for r in rows if r.node_name == "Generate"}
    assert generated == {120000}


def test_the_store_keeps_nodes(spark, logged, tmp_path):
    out = str(tmp_path / "store")
    st.load_new(spark, logged, out, "first")
    stored = st.read_store(spark, out)
    assert stored["fact_stage_nodes"].count() == logged["fact_stage_nodes"].count() > 0
    st.load_tables({n: logged[n] for n in tel.TABLES}, str(tmp_path / "plain"), "first")
    assert set(st.read_store(spark, str(tmp_path / "plain"))) == set(tel.TABLES)


def node(name, *children, **metrics):
    counted = [{"name": n, "accumulatorId": i, "metricType": "sum"} for n, i in metrics.items()]
    return {"nodeName": name, "children": list(children), "metrics": counted}


def test_plan_trees_fall_into_parts():
    tree = node("Join", node("Sort", node("Exchange", node("Scan", rows=3), written=2), spill=1),
                node("InMemoryTableScan", node("Filter", rows=4)), node("ReusedExchange"), node("Subquery", node("Scan", rows=5)))
    rows = nodes.tree_nodes(json.dumps(tree))
    assert [(r["node_name"], r["parent_id"], r["part"]) for r in rows] == [
        ("Join", None, 0), ("Sort", 0, 0), ("Exchange", 1, 2), ("Scan", 2, 2), ("InMemoryTableScan", 0, 0),
        ("Filter", 4, 5), ("ReusedExchange", 0, 0), ("Subquery", 0, 7), ("Scan", 7, 7),
    ]
    assert rows[1]["metrics"] == [{"accumulator_id": 1, "name": "spill"}]
    deep = node("Scan")
    for _ in range(200):
        deep = node("Project", deep)
    assert len(nodes.tree_nodes(json.dumps(deep))) == 201
    for text in ("", "not json", "[]", "null", "3", "[" * 100000):
        assert nodes.tree_nodes(text) == []
    assert nodes.tree_nodes("{}") == [{"node_id": 0, "parent_id": None, "part": 0, "node_name": "", "metrics": []}]


def test_nodes_that_passed_no_row_are_tied_by_their_part(spark, tmp_path):
    sql = "org.apache.spark.sql.execution.ui."
    first = node("Guess", rows=99)
    tree = node("SortMergeJoin", node("Sort", node("Exchange", node("Scan", **{"number of output rows": 3}), written=2), **{"spill size": 1}),
                **{"number of output rows": 4})

    def done(stage, *counters):
        listed = [{"ID": i, "Name": "n", "Value": v, "Metadata": "sql"} for i, v in counters]
        listed += [{"ID": 1, "Name": "internal.metrics.x", "Value": [], "Internal": True}]
        return event("SparkListenerStageCompleted", Stage__Info={"Stage ID": stage, "Stage Attempt ID": 0, "Number of Tasks": 1, "Accumulables": listed})

    lines = [
        event("SparkListenerApplicationStart", App__Name="n", App__ID="n", Timestamp=1000),
        event(sql + "SparkListenerSQLExecutionStart", executionId=0, description="q", physicalPlanDescription="(a)", time=1, sparkPlanInfo=first),
        event(sql + "SparkListenerSQLAdaptiveExecutionUpdate", executionId=0, physicalPlanDescription="(b)", sparkPlanInfo=tree),
        done(0, (3, "7"), (2, "50")), done(1, (1, "2048"), (2, "51")), done(2),
        event(sql + "SparkListenerSQLExecutionStart", executionId=1, description="no tree", physicalPlanDescription="(c)", time=1),
        event("SparkListenerApplicationEnd", Timestamp=9000),
    ]
    (tmp_path / "n").write_text("\n".join(lines))
    tables = tel.build_from_event_log(spark, str(tmp_path), with_nodes=True)
    got = {(r.stage_id, r.node_name): (r.rows_out, r.spill_kb) for r in tables["fact_stage_nodes"].collect()}
    assert got == {(0, "Exchange"): (None, None), (0, "Scan"): (7, None), (1, "SortMergeJoin"): (0, None), (1, "Sort"): (None, 2.0)}


def test_status_and_overview(logged, names):
    rows = {names[r.app_id]: r for r in rules.app_overview(logged).collect()}
    assert rows["failing"].final_status == "FAILED"
    assert all(r.final_status == "SUCCEEDED" for n, r in rows.items() if n != "failing")
    assert all(r.n_stages > 0 and r.n_jobs > 0 and r.n_queries > 0 for r in rows.values())


def test_plans_are_the_final_ones_and_link_to_stages(logged, names):
    linked = mapping.stage_to_plan(
        logged["fact_stages"], logged["map_jobs"], logged["dim_sql_plans"], with_text=True
    ).collect()
    python = [r for r in linked if names[r.app_id] == "python" and r.has_batch_python]
    assert python and any("Final Plan" in r.plan_text for r in python)
    outside = [r for r in linked if r.sql_id is None]
    assert outside and all(r.plan_text is None and not r.has_exchange for r in outside)


def test_skipped_stages_have_no_times(logged, names):
    rows = [r for r in logged["fact_stages"].collect() if names[r.app_id] == "window" and r.start_time is None]
    assert rows and all(r.end_time is None and r.executor_run_time_ms == 0 for r in rows)


def test_tables_follow_the_contract(logged):
    for name, df in logged.items():
        assert ", ".join(f"{c} {k}" for c, k in df.dtypes) == {**tel.TABLES, **tel.LOG_TABLES}[name]


def test_rolled_compressed_logs_and_direct_scan(spark, tmp_path_factory):
    logs = run_apps(tmp_path_factory, "zstd", "broadcast")
    staged = tel.build_from_event_log(spark, logs)
    direct = tel.build_from_event_log(spark, logs, staged=False)
    for name in tel.TABLES:
        assert sorted(map(str, staged[name].collect())) == sorted(map(str, direct[name].collect()))
    app = staged["dim_applications"].first()
    assert app.app_name == "broadcast" and app.app_id.startswith("local-")
    assert staged["fact_executors"].first().max_memory_kb > 0


def event(name, **fields):
    return json.dumps({"Event": name, **{k.replace("__", " "): v for k, v in fields.items()}})


@pytest.fixture()
def handmade(tmp_path):
    metrics = {"JVMHeapMemory": 2048, "TotalGCTime": 30, "OnHeapStorageMemory": 1024, "OffHeapStorageMemory": 512}
    sql = "org.apache.spark.sql.execution.ui."

    def task(i, run, finish, failed=False, executor="1", **more):
        return event(
            "SparkListenerTaskEnd", Stage__ID=0, Stage__Attempt__ID=0,
            Task__Info={"Task ID": i, "Executor ID": executor, "Finish Time": finish, "Failed": failed},
            Task__Metrics={"Executor Run Time": run, "Disk Bytes Spilled": 640,
                           "Shuffle Read Metrics": {"Remote Bytes Read": 1000, "Local Bytes Read": 24}},
            Task__Executor__Metrics=more.get("metrics", {}),
        )

    stage = {"Stage ID": 0, "Stage Attempt ID": 0, "Number of Tasks": 3}
    lines = [
        event("SparkListenerApplicationStart", App__Name="hand", App__ID="app-9", Timestamp=1000),
        event("SparkListenerJobStart", Job__ID=0, Stage__IDs=[0, 4], Properties={"spark.sql.execution.id": "2"},
              Stage__Infos=[stage, {"Stage ID": 4, "Stage Attempt ID": 0, "Number of Tasks": 9}]),
        event(sql + "SparkListenerSQLExecutionStart", executionId=2, description="q", physicalPlanDescription="(a)", time=1100),
        event(sql + "SparkListenerSQLAdaptiveExecutionUpdate", executionId=2, physicalPlanDescription="(z) first"),
        event(sql + "SparkListenerSQLAdaptiveExecutionUpdate", executionId=2, physicalPlanDescription="(b) last"),
        event("SparkListenerExecutorAdded", Executor__ID="1", Executor__Info={"Host": "h", "Total Cores": 4}),
        event("SparkListenerBlockManagerAdded", Block__Manager__ID={"Executor ID": "1", "Host": "h"}, Maximum__Memory=128),
        task(0, 10, 3100, metrics=metrics),
        task(1, 30, 3900, metrics={**metrics, "TotalGCTime": 70}),
        task(2, 20, 4000, metrics={**metrics, "JVMHeapMemory": 0}),
        task(3, 999, 4100, failed=True),
        event("SparkListenerStageExecutorMetrics", Executor__ID="1", Stage__ID=0, Stage__Attempt__ID=0,
              Executor__Metrics={**metrics, "JVMHeapMemory": 4096}),
        event("SparkListenerStageCompleted", Stage__Info={**stage, "Submission Time": 2000, "Completion Time": 5000}),
        event("SparkListenerExecutorRemoved", Executor__ID="1", Removed__Reason="lost"),
        event("SparkListenerNewKindOfEvent", Whatever=1),
        "not json",
        event("SparkListenerApplicationEnd", Timestamp=9000),
    ]
    (tmp_path / "app-9").write_text("\n".join(lines))
    (tmp_path / "app-8.inprogress").write_text(lines[0])
    return str(tmp_path)


def test_handmade_log(spark, handmade):
    t = tel.build_from_event_log(spark, handmade, staged=False)
    app = t["dim_applications"].collect()
    assert [(r.app_id, r.app_name, r.duration_ms) for r in app] == [("app-9", "hand", 8000)]
    stages = {r.stage_id: r for r in t["fact_stages"].collect()}
    s = stages[0]
    # totals hold all attempts of tasks, quantiles the successful ones
    assert (s.num_tasks, s.executor_run_time_ms, s.task_duration_median_ms, s.task_duration_max_ms) == (3, 1059, 20, 30)
    assert (s.shuffle_read_kb, s.disk_spill_kb) == (4.0, 2.5)
    assert (stages[4].num_tasks, stages[4].start_time) == (9, None)
    e = t["fact_executors"].first()
    assert tuple(e)[1:] == ("1", "h", 4, 0.12, False, "lost")
    plan = t["dim_sql_plans"].first()
    assert (plan.sql_id, plan.plan_text, plan.duration_ms) == (2, "(b) last", 0)
    assert tuple(t["map_jobs"].first())[1:] == (0, 2, "0,4")
    samples = {(r.timestamp.second, r.metric_name): r.value_kb_or_ms for r in t["fact_hardware_metrics"].collect()}
    # two readings in one second: the later; no heap: no reading; stage peaks at completion
    assert {s for s, _ in samples} == {3, 5}
    assert samples[(3, "ExecutorMetrics_TotalGCTime")] == 70.0
    assert samples[(3, "BlockManager_memory_memUsed_MB")] == 1.5
    assert samples[(5, "jvm_heap_used")] == 4.0


def test_kinds_filter_before_parsing(spark, handmade):
    kinds = {r.kind for r in el.read_event_log(spark, handmade).select("kind").collect()}
    assert kinds <= set(el.KINDS.values()) and "task_end" in kinds


def test_flags_of_a_formatted_plan(logged, names):
    plans = logged["dim_sql_plans"].select("app_id", pt.plan_flags(logged["dim_sql_plans"].raw_plan).alias("f"))
    flags = {names[r.app_id]: r.f for r in plans.collect() if names[r.app_id] != "failing"}
    assert flags["pairs"].has_cartesian and flags["sort_merge"].has_sort_merge_join
    assert flags["broadcast"].has_broadcast_hash_join and not flags["broadcast"].has_sort_merge_join


def attempt_log(folder, name, app, number, stages):
    lines = [{"Event": "SparkListenerApplicationStart", "App Name": "job", "App ID": app, "App Attempt ID": str(number), "Timestamp": 1000}]
    for stage in range(stages):
        info = {"Stage ID": stage, "Stage Attempt ID": 0, "Number of Tasks": 1, "Submission Time": 1000, "Completion Time": 2000}
        lines.append({"Event": "SparkListenerStageCompleted", "Stage Info": info})
    lines.append({"Event": "SparkListenerApplicationEnd", "Timestamp": 5000})
    (folder / name).write_text("\n".join(json.dumps(x) for x in lines))


def test_the_last_attempt_of_an_application_counts(spark, tmp_path):
    attempt_log(tmp_path, "application_17_0001_1", "application_17_0001", 1, 1)
    attempt_log(tmp_path, "application_17_0001_2", "application_17_0001", 2, 3)
    attempt_log(tmp_path, "application_17_0002", "application_17_0002", 1, 2)
    (tmp_path / "eventlog_v2_application_17_0003_1").mkdir()
    attempt_log(tmp_path / "eventlog_v2_application_17_0003_1", "events_1_application_17_0003_1", "application_17_0003", 1, 1)
    events = el.read_event_log(spark, str(tmp_path))
    seen = {(r.app_id, r.attempt) for r in events.select("app_id", "attempt").distinct().collect()}
    assert seen == {("application_17_0001", 2), ("application_17_0002", 1), ("application_17_0003", 1)}
    tables = tel.build_from_event_log(spark, str(tmp_path))
    counts = {r.app_id: r["count"] for r in tables["fact_stages"].groupBy("app_id").count().collect()}
    assert counts == {"application_17_0001": 3, "application_17_0002": 2, "application_17_0003": 1}


def test_logs_of_known_applications_are_not_read(spark, tmp_path):
    for i in range(3):
        attempt_log(tmp_path, f"application_17_000{i}", f"application_17_000{i}", 1, 1)
    known = spark.createDataFrame([("application_17_0000",), ("application_17_0002",)], "app_id string")
    assert [p.rsplit("/", 1)[1] for p in el.logs_to_read(spark, str(tmp_path), known)] == ["application_17_0001"]
    tables = tel.build_from_event_log(spark, str(tmp_path), known=known)
    assert [r.app_id for r in tables["dim_applications"].collect()] == ["application_17_0001"]
    every = known.unionByName(spark.createDataFrame([("application_17_0001",)], "app_id string"))
    assert tel.build_from_event_log(spark, str(tmp_path), staged=False, known=every)["fact_stages"].collect() == []
