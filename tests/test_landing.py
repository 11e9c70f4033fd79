"""Landed documents to six tables: every default and rule on hand-made responses."""

import datetime as dt
import json

import pytest

from stagelens.plans import store as st
from stagelens.plans import telemetry as tel
from stagelens.sources import landing as ld

A, B = "app-1-0001", "app-2"


def put(root, path, doc):
    target = root / path
    target.mkdir(parents=True, exist_ok=True)
    (target / "response.json").write_text(json.dumps(doc, indent=1))


def write_app(root, app_id, documents):
    for path, doc in documents.items():
        kind, *rest = path.split("/")
        put(root, "/".join([kind, f"app_id={app_id}", *rest]), doc)


def series(name, *values):
    return {"metric": {"__name__": name, "job": "x"}, "values": [list(v) for v in values]}


PLAN = "== Physical Plan ==\n +- Scan [a#1, b#2, c#3, d#4, e#5, f#6]\nnoise"

DOCS_A = {
    "stages": [
        {
            "stageId": 0, "attemptId": 0, "numTasks": 4, "executorRunTime": 900, "inputBytes": 128,
            "submissionTime": "2024-01-01T00:00:01.000GMT", "completionTime": "2024-01-01T00:00:05.500GMT",
            "shuffleReadBytes": 640, "shuffleWriteBytes": 2048, "memoryBytesSpilled": 1024, "diskBytesSpilled": 384,
        },
        {"stageId": 0, "attemptId": 1, "numTasks": 2},
        {"stageId": 1, "numTasks": 1, "submissionTime": None},
    ],
    "task_summary/stage_id=0/attempt_id=0": {"executorRunTime": [1.0, 20.9, 300.0]},
    "task_summary/stage_id=0/attempt_id=1": {"executorRunTime": [1.0, 2.0]},
    "jobs": [
        {"jobId": 0, "stageIds": [0, 1]},
        {"jobId": 1, "sqlExecutionId": 0, "stageIds": [2]},
        {"jobId": 2, "sqlExecutionId": 0},
        {"jobId": 3, "sqlExecutionId": 5, "stageIds": []},
    ],
    # list order decides, not the id: query 1 stands last
    "sql": [{"id": 2, "description": "second", "duration": 7}, {"id": 0}, {"id": 1, "description": "last"}],
    "sql_detail/sql_id=0": {"planDescription": "", "physicalPlanDescription": PLAN, "successJobIds": [1]},
    "sql_detail/sql_id=1": {"planDescription": "(1) Scan", "successJobIds": [2], "failedJobIds": [9]},
    "sql_detail/sql_id=2": {"successJobIds": [2], "runningJobIds": [1]},
    "executors": [
        {"id": "driver", "hostPort": "10.0.0.1:4040", "totalCores": 0, "maxMemory": 640, "isActive": True},
        {
            "id": "1", "hostPort": "worker:7078", "totalCores": 4, "maxMemory": 1024, "isActive": False,
            "executorLogs": {"exitReason": "killed", "stdout": "url"},
        },
        {"id": "2", "hostPort": "worker:7079", "totalCores": 4, "maxMemory": 128, "isActive": True, "executorLogs": {}},
    ],
    "metrics": {
        "data": {
            "result": [
                series("spark_app_1_0001_driver_jvm_heap_used", [1704067200, "640"], [1704067194.5, "1"]),
                series("spark_app_1_0001_0_ExecutorMetrics_TotalGCTime", [1704067201.5, "12.345"]),
                series("spark_app_1_0001_1_BlockManager_memory_memUsed_MB", [1704067215, "1.5"], [1704067215.1, "9"]),
                series("spark_app_1_0001_1_jvm_threads", [1704067201, "5"]),
                series("spark_app_1_0001_2_jvm_heap_used", [1704067202, "NaN"]),
            ]
        }
    },
}

DOCS_B = {"stages": [{"stageId": 7, "numTasks": 1}], "metrics": {"data": {"result": []}}, "jobs": []}


def apps(*ids, running=()):
    def attempt(completed):
        start = {"startTime": "2024-01-01T00:00:00.000GMT", "completed": completed}
        return {**start, "endTime": "2024-01-01T00:00:10.000GMT", "duration": 10000} if completed else start

    out = [{"id": i, "name": f"name {i}", "attempts": [attempt(True), attempt(False)]} for i in ids]
    return out + [{"id": i, "name": i, "attempts": [attempt(False), attempt(True)]} for i in running]


@pytest.fixture()
def landing(tmp_path):
    put(tmp_path, "apps", apps(A, B, running=["app-3"]))
    write_app(tmp_path, A, DOCS_A)
    write_app(tmp_path, B, DOCS_B)
    write_app(tmp_path, "app-3", {"stages": [{"stageId": 1, "numTasks": 1}]})
    return tmp_path


def by_key(df, n):
    return {tuple(r)[:n]: tuple(r)[n:] for r in df.collect()}


def t(second, micro=0):
    return dt.datetime(2024, 1, 1, 0, 0, second, micro)


def test_tables_follow_the_contract(spark, landing):
    tables = tel.build_telemetry(spark, str(landing))
    assert list(tables) == list(tel.TABLES)
    for name, df in tables.items():
        assert ", ".join(f"{c} {k}" for c, k in df.dtypes) == tel.TABLES[name]


def test_applications(spark, landing):
    got = by_key(tel.build_telemetry(spark, str(landing))["dim_applications"], 1)
    row = (t(0), t(10), 10000, "SUCCEEDED")
    assert got == {(A,): (f"name {A}", *row), (B,): (f"name {B}", *row)}


def test_unfinished_applications_end_now(spark, landing):
    tables = tel.build_telemetry(spark, str(landing), as_of="2024-01-01 00:00:42")
    got = by_key(tables["dim_applications"], 1)
    assert got[("app-3",)] == ("app-3", t(0), t(42), 0, "SUCCEEDED")
    assert ("app-3", 1, 0) in by_key(tables["fact_stages"], 3)


def test_stages(spark, landing):
    got = by_key(tel.build_telemetry(spark, str(landing))["fact_stages"], 3)
    assert got == {
        # 128 and 640 bytes are ties: to the even digit
        (A, 0, 0): (t(1), t(5, 500000), 4, 900, 0.12, 0.62, 2.0, 1.0, 0.38, 20, 300),
        # two quantiles are not enough; a missing memory spill is one byte, 0.00 KB
        (A, 0, 1): (None, None, 2, 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0, 0),
        (A, 1, 0): (None, None, 1, 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0, 0),
        (B, 7, 0): (None, None, 1, 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0, 0),
    }


def test_executors(spark, landing):
    got = by_key(tel.build_telemetry(spark, str(landing))["fact_executors"], 2)
    assert got == {
        (A, "driver"): ("10.0.0.1", 0, 0.62, True, "N/A"),
        (A, "1"): ("worker", 4, 1.0, False, "killed"),
        (A, "2"): ("worker", 4, 0.12, True, "N/A"),
    }


def test_sql_plans(spark, landing):
    got = by_key(tel.build_telemetry(spark, str(landing))["dim_sql_plans"], 2)
    assert got == {
        (A, 0): ("", "== Physical Plan ==\n+- Scan [a#ID, b#ID, c#ID, ..., f#ID]",
                 "== Physical Plan ==\n +- Scan [a#1, b#2, c#3, d#4, e#5, f#6]\nnoise", 0),
        (A, 1): ("last", "(1) Scan", "(1) Scan", 0),
        (A, 2): ("second", "", "", 7),
    }


def test_a_query_without_detail_has_no_plan(spark, landing):
    put(landing, f"sql/app_id={B}", [{"id": 3, "description": "lost", "duration": 1}])
    got = by_key(tel.build_telemetry(spark, str(landing))["dim_sql_plans"], 2)
    assert got[(B, 3)] == ("lost", "", "", 1)


def test_job_map(spark, landing):
    got = by_key(tel.build_telemetry(spark, str(landing))["map_jobs"], 2)
    assert got == {
        (A, 0): (None, "0,1"),
        # claimed by queries 2 and 0: query 0 stands later in the list
        (A, 1): (0, "2"),
        (A, 2): (1, ""),
        (A, 3): (5, ""),
        # known to a query only
        (A, 9): (1, ""),
    }


def test_metrics(spark, landing):
    got = {tuple(r) for r in tel.build_telemetry(spark, str(landing))["fact_hardware_metrics"].collect()}
    got = {r if r[4] == r[4] else (*r[:4], "NaN") for r in got}
    assert got == {
        (A, t(0), "driver", "jvm_heap_used", 0.62),
        (A, t(1, 500000), "0", "ExecutorMetrics_TotalGCTime", 12.34),
        # five seconds after the end is inside, 5.1 is not; 5.5 before the start is not
        (A, t(15), "1", "BlockManager_memory_memUsed_MB", 1536.0),
        (A, t(2), "2", "jvm_heap_used", "NaN"),
    }


def test_samples_stand_until_the_next(spark):
    rows = [("a", "1", "m", t(s), v) for s, v in ((1, 1.0), (3, 3.0), (20, 20.0), (59, 59.0))]
    df = spark.createDataFrame(rows, "app_id string, executor_id string, metric_name string, timestamp timestamp_ntz, value_kb_or_ms double")
    want = {1: 1, 2: 1, 3: 3, 4: 3, 5: 3, 6: 3, 20: 20, 21: 20, 22: 20, 23: 20, 59: 59}
    for bucket in (2, 10, 3600):
        got = {r.timestamp: r.value_kb_or_ms for r in tel.fill_seconds(df, 3, bucket).collect()}
        later = {dt.datetime(2024, 1, 1, 0, 1, s): 59 for s in range(3)}
        assert got == {**{t(s): v for s, v in want.items()}, **later}


def test_peaks_leave_nan_out(spark, landing):
    metrics = tel.build_telemetry(spark, str(landing))["fact_hardware_metrics"]
    assert {r.executor_id for r in tel.metric_peaks(metrics).collect()} == {"driver", "0", "1"}


def test_lines_layout_gives_the_same_tables(spark, landing, tmp_path_factory):
    lines = tmp_path_factory.mktemp("lines")
    for kind in ("apps", "stages", "task_summary", "jobs", "sql", "sql_detail", "executors", "metrics"):
        for i, path in enumerate((landing / kind).rglob("response.json")):
            ids = dict(p.split("=") for p in path.parts if "=" in p)
            doc = json.loads(path.read_text())
            target = lines / kind
            target.mkdir(exist_ok=True)
            with open(target / f"{i}.json", "w") as out:
                for record in doc if isinstance(doc, list) else [doc]:
                    numbers = {k: int(v) if k != "app_id" else v for k, v in ids.items()}
                    out.write(json.dumps({**numbers, **record}) + "\n")
    a, b = tel.build_telemetry(spark, str(landing)), tel.build_telemetry(spark, str(lines), "lines")
    for name in tel.TABLES:
        left, right = ({tuple(map(str, r)) for r in x[name].collect()} for x in (a, b))
        if name == "map_jobs":
            # without list order the highest query id wins
            left = {r for r in left if r[1] != "1" and r[1] != "2"}
            right = {r for r in right if r[1] != "1" and r[1] != "2"}
        assert left == right


def test_missing_kinds_are_empty(spark, tmp_path):
    put(tmp_path, "apps", apps(A))
    tables = tel.build_telemetry(spark, str(tmp_path))
    assert {n: df.count() for n, df in tables.items()} == {n: int(n == "dim_applications") for n in tel.TABLES}


def test_unknown_layout(spark, tmp_path):
    with pytest.raises(ValueError):
        ld.read_apps(spark, str(tmp_path), "other")


# --- store -----------------------------------------------------------------------------------


def contents(tables):
    return {n: sorted(str(tuple(r)) for r in df.collect()) for n, df in tables.items()}


def only(tables, *ids):
    return {n: df.filter(df.app_id.isin(*ids)) for n, df in tables.items()}


def test_store_returns_what_was_loaded(spark, landing, tmp_path):
    out = str(tmp_path / "store")
    assert all(df.count() == 0 for df in st.read_store(spark, out).values())
    tables = tel.build_telemetry(spark, str(landing))
    st.load_tables(tables, out, "first")
    assert contents(st.read_store(spark, out)) == contents(tables)
    st.load_tables(tables, out, "first")
    assert contents(st.read_store(spark, out)) == contents(tables)


def test_loading_a_then_both_equals_loading_both(spark, landing, tmp_path):
    tables = tel.build_telemetry(spark, str(landing))
    st.load_new(spark, only(tables, A), str(tmp_path / "two"))
    st.load_new(spark, tables, str(tmp_path / "two"))
    assert contents(st.read_store(spark, str(tmp_path / "two"))) == contents(tables)
    loads = dict(map(tuple, st.loads(spark, str(tmp_path / "two")).collect()))
    assert loads.keys() == {A, B} and loads[A] != loads[B]


def test_a_load_that_died_is_not_seen(spark, landing, tmp_path):
    out = str(tmp_path / "store")
    tables = tel.build_telemetry(spark, str(landing))
    st.load_tables(only(tables, A), out, "first")
    # second load stops after its first tables, before the marker
    st._write(only(tables, B)["fact_stages"], out, "fact_stages", "second")
    assert contents(st.read_store(spark, out)) == contents(only(tables, A))
    st.load_new(spark, tables, out)
    assert contents(st.read_store(spark, out)) == contents(tables)


def test_a_reload_replaces_the_application(spark, landing, tmp_path):
    out = str(tmp_path / "store")
    tables = tel.build_telemetry(spark, str(landing))
    st.load_tables(tables, out, "first")
    fewer = {**only(tables, A), "fact_stages": only(tables, A)["fact_stages"].filter("stage_id = 0")}
    fewer["fact_hardware_metrics"] = fewer["fact_hardware_metrics"].filter("false")
    st.load_tables(fewer, out, "another")
    stored = st.read_store(spark, out)
    assert by_key(stored["fact_stages"], 3).keys() == {(A, 0, 0), (A, 0, 1), (B, 7, 0)}
    assert stored["fact_hardware_metrics"].count() == 0
