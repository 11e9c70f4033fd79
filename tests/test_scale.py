"""Steps that must grow no faster than their input: what is written, moved and asked for."""

import json
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from conftest import plan_of

from pyspark.sql import functions as F

from stagelens.catalog import landed, telemetry, views
from stagelens.functions import plan_text
from stagelens.operators.aggregates import select_rank, value_counts
from stagelens.plans import nodes
from stagelens.sources import event_log
from stagelens.sources import landing as ld


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """Line items of 41 applications and one without an order, and some events."""
    sf = str(tmp_path_factory.mktemp("made"))
    n = F.col("id")
    item = {
        "l_orderkey": F.when(n != 77, n * 7919 % 30750),
        "l_partkey": n % 50,
        "l_suppkey": n % 5,
        "l_linenumber": (n % 7 + 1).cast("int"),
        "l_quantity": (n % 50 + 1).cast("double"),
        "l_extendedprice": (n % 9000 + 100).cast("double"),
        "l_discount": (n % 10 / 100).cast("double"),
        "l_tax": (n % 8 / 100).cast("double"),
        "l_returnflag": F.when(n % 3 == 0, "R").otherwise("N"),
        "l_linestatus": F.lit("O"),
        "l_shipdate": F.lit("2024-01-01").cast("timestamp_ntz"),
    }
    event = {
        "event_id": n,
        "ts": F.timestamp_millis(views.START_MS + n * 1000).cast("timestamp_ntz"),
        "user_id": n % 300,
        "event_type": F.element_at(F.array(F.lit("click"), F.lit("view"), F.lit("error")), (n % 3 + 1).cast("int")),
        "value": (n % 100).cast("double"),
        "props": F.lit("{}"),
    }
    for name, rows, columns in (("lineitem", 20000, item), ("events", 2000, event)):
        spark.range(rows).select(*[c.alias(k) for k, c in columns.items()]).write.parquet(f"{sf}/{name}.parquet")
    return sf


def test_written_tasks_of_an_application_lie_together(spark, made):
    written = views.written_tasks(spark, made)
    files = written.groupBy("app_id").agg(F.countDistinct(F.col("_metadata.file_path")).alias("n")).collect()
    assert len(files) == 42 and all(r.n == 1 for r in files)
    assert sorted(map(str, written.collect())) == sorted(map(str, views.tasks(spark, made).collect()))


def test_line_items_move_before_they_become_tasks(spark, made, monkeypatch):
    plans = []
    monkeypatch.setattr(views, "write_table", lambda df, path: plans.append(plan_of(df)))
    monkeypatch.setattr(views, "read_table", lambda spark, path: None)
    views.written_tasks(spark, made)
    # the tasks' columns are made above the only exchange
    assert plans[0].count("Exchange ") == 1 and plans[0].index(" AS shuffle_write_bytes#") < plans[0].index("Exchange ")


def test_staged_events_are_stored_tightly(spark, made, tmp_path):
    event_log.stage_event_log(spark, landed.write_event_log(spark, made), str(tmp_path / "events"))
    files = list((tmp_path / "events").rglob("*.parquet"))
    assert files and {pq.ParquetFile(f).metadata.row_group(0).column(0).compression for f in files} == {"ZSTD"}


def test_counts_of_single_values_are_not_summed_again(spark):
    rows = spark.range(5000).select((F.col("id") % 7).alias("k"), (F.col("id") * 7919 % 3001).alias("v"))
    counts = value_counts(rows, ["k"], "v")
    found = select_rank(counts, ["k"], F.floor(F.col("_n") / F.lit(2)))
    # only the rows of a group are summed, in two steps
    assert plan_of(found).count("HashAggregate(") == 2
    want = {}
    for r in rows.collect():
        want.setdefault(r.k, []).append(r.v)
    assert {r.k: (r.lo, r.mid, r.hi) for r in found.collect()} == {k: (min(v), sorted(v)[len(v) // 2], max(v)) for k, v in want.items()}


def test_logs_are_compressed_and_hold_all_events(spark, made):
    path = Path(landed.write_event_log(spark, made))
    text = spark.read.text(str(path))
    assert text.filter("value like '{\"Event\":\"SparkListenerTaskEnd\"%'").count() == 20000
    logs = [f for f in path.rglob("part-*") if f.is_file()]
    assert {f.parent.name for f in logs} == {"app_id=__HIVE_DEFAULT_PARTITION__", *(f"app_id=app-{i}" for i in range(41))}
    # task ends in one file, the rest in another one
    assert len(logs) == 2 * 42
    size = text.agg(F.sum(F.length("value"))).first()[0]
    assert sum(f.stat().st_size for f in logs) * 5 < size


def test_long_lines_of_logs_are_not_sorted(spark, made):
    ends, _ = landed.event_lines(spark, made)
    plan = plan_of(ends)
    # the line is made above the only sort, and nothing moves
    assert plan.count("Sort [") == 1 and plan.index(" AS value#") < plan.index("Sort [") and "Exchange" not in plan


def test_the_store_is_offered_written_tables(spark, made, monkeypatch):
    read = []
    load = telemetry.st.load_tables

    def seen(tables, out, load_id):
        read.extend(f for df in tables.values() for f in df.inputFiles())
        load(tables, out, load_id)

    monkeypatch.setattr(telemetry.st, "load_tables", seen)
    rows = telemetry.QUERIES["store_roundtrip"].run(spark, made).collect()
    # neither load derives a table from the line items or events again
    assert len(rows) == 41 and read and not [f for f in read if made in f]


def test_records_outside_folders_meet_a_batch_by_join(spark, tmp_path, monkeypatch):
    folder = tmp_path / "stages"
    folder.mkdir()
    (folder / "all.json").write_text("\n".join(json.dumps({"app_id": f"a{i % 900}", "stageId": i}) for i in range(1800)))
    asked = []
    exists = ld.path_exists
    monkeypatch.setattr(ld, "path_exists", lambda s, p: asked.append(p) or exists(s, p))
    some = [f"a{i}" for i in range(0, 900, 2)]
    found = ld.read_stages(spark, str(tmp_path), "lines", [*some, "a0", None, "other"])
    # the first application tells that there are no folders
    assert len(asked) == 2
    plan = plan_of(found)
    assert "LeftSemi" in plan and " IN " not in plan and "INSET" not in plan
    rows = found.collect()
    assert sorted(r.stageId for r in rows) == list(range(0, 1800, 2)) and {r.app_id for r in rows} == set(some)
    assert found.columns[0] == "app_id" and found.columns[-1] == "position"
    assert ld.read_stages(spark, str(tmp_path), "lines", []).collect() == []


def test_orders_are_dealt_to_applications_in_whole_numbers(spark, tmp_path):
    keys = [-1501, -1500, -751, -750, -749, -31, -30, -1, 0, 29, 30, 748, 749, 750, 1499, 9 * 10**15, None]
    item = "k as l_orderkey, 7 as l_linenumber, 10.5d as l_extendedprice, 3d as l_quantity, 0.1d as l_discount, 0.1d as l_tax, 'R' as l_returnflag"
    spark.createDataFrame([(k,) for k in keys], "k bigint").selectExpr(*item.split(", ")).write.parquet(str(tmp_path / "lineitem.parquet"))
    for derived in (views.tasks(spark, str(tmp_path)), views.written_tasks(spark, str(tmp_path))):
        want = spark.sql(views.TASKS_SQL.replace("from lineitem", "from {src}"), src=spark.read.parquet(str(tmp_path / "lineitem.parquet")))
        assert derived.dtypes == want.dtypes
        assert sorted(map(str, derived.collect())) == sorted(map(str, want.collect()))
    assert "decimal" not in plan_of(views.tasks(spark, str(tmp_path)))


def test_staged_task_ends_hold_their_own_fields(spark, made, tmp_path):
    path = landed.write_event_log(spark, made)
    staged, read = event_log.stage_event_log(spark, path, str(tmp_path / "events")), event_log.read_event_log(spark, path)
    assert staged.schema.simpleString() == read.schema.simpleString()
    columns = [c for c in read.columns if c != "place"]
    for family in ("tasks", "rest"):
        a, b = (sorted(map(str, df.filter(F.col("family") == family).select(*columns).collect())) for df in (staged, read))
        assert a and a == b
    # nothing of other events is stored for a task, and a step reads one of the two folders
    task = next((tmp_path / "events" / "family=tasks").glob("*.parquet"))
    assert pq.read_table(task, columns=["e"])["e"].null_count == pq.ParquetFile(task).metadata.num_rows
    for kind in ("task_end", "job_end"):
        plan = plan_of(event_log.events_of(staged, kind).select("app_id", F.col("`Task Info`.`Executor ID`")))
        assert plan.count("FileScan") == 1 and "JVMHeapMemory" not in plan


def test_small_logs_share_a_task(spark, made, monkeypatch):
    path = landed.write_event_log(spark, made)
    size = sum(f.stat().st_size for f in Path(path).rglob("part-*"))
    monkeypatch.setattr(event_log, "TASKS_A_CORE", 0)
    monkeypatch.setattr(event_log, "TASK_BYTES", size // 2)
    lines = event_log._log_lines(spark, path, None)
    assert lines.rdd.getNumPartitions() == 2 and lines.filter("kind = 'task_end'").count() == 20000


def test_lines_are_told_with_and_without_the_pattern(spark):
    lines = {
        '{"Event":"SparkListenerTaskEnd","Stage ID":1}': "task_end",
        ' { "Event" : "SparkListenerTaskEnd"}': "task_end",
        '{"Event":"SparkListenerTaskEndOther"}': None,
        '{"Event":"SparkListenerJobEnd"}': "job_end",
        '{"X":1,"Event":"SparkListenerTaskEnd"}': None,
        "": None,
    }
    got = spark.createDataFrame([(x,) for x in lines], "line string").select("line", event_log._event_kind(F.col("line")).alias("kind"))
    assert {r.line: r.kind for r in got.collect()} == lines


def test_plans_are_walked_many_a_batch(monkeypatch):
    tree = json.dumps({"nodeName": "Sort", "children": [{"nodeName": "Exchange", "children": [], "metrics": []}], "metrics": []})
    plans = pa.RecordBatch.from_pylist([{"app_id": f"a{i}", "sql_id": i, "info": tree} for i in range(300)])
    found = list(nodes._walk(iter([plans])))
    assert len(found) == 1 and found[0].num_rows == 600
    monkeypatch.setattr(nodes, "NODES_A_BATCH", 100)
    assert [b.num_rows for b in nodes._walk(iter([plans]))] == [100] * 6 + [0]


def test_findings_read_stages_once(spark, made):
    found = landed.node_findings(spark, made)
    # stages and the nodes that ran in them are read as written; plans and jobs come from the rest of the events
    plan = plan_of(found)
    assert "value-counts" not in plan and "plan-nodes" not in plan and plan.count("/stage-nodes-") == 2
    assert found.count() > 0


def test_groups_of_few_values_are_ordered_at_once(spark):
    rows = [("few", v * 2**30) for v in (5, -3, 5, 5, 11, 8)] + [(None, 2**40), (None, 1), ("two", 7), ("two", 9)]
    counts = value_counts(spark.createDataFrame(rows, "k string, v bigint"), ["k"], "v")
    half = F.floor(F.col("_n") / F.lit(2))
    plan = plan_of(select_rank(counts, ["k"], half, digit=3))
    assert "Join" not in plan and plan.count("Window [") == 1
    more = rows + [("many", v * 77) for v in range(-40, 61)] + [("edge", v) for v in range(8)]
    counts = value_counts(spark.createDataFrame(more, "k string, v bigint"), ["k"], "v")
    want = {}
    for k, v in more:
        want.setdefault(k, []).append(v)
    got = select_rank(counts, ["k"], half, digit=3)
    assert {r.k: (r.lo, r.mid, r.hi) for r in got.collect()} == {k: (min(v), sorted(v)[len(v) // 2], max(v)) for k, v in want.items()}


def test_plans_without_a_window_have_none_to_partition(spark):
    texts = ["", "Sort\n+- Exchange SinglePartition", "Window\n+- Exchange SinglePartition", "WindowGroupLimit\n+- Exchange SinglePartition"]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select("t", plan_text.has_unpartitioned_window(F.col("t")).alias("w"))
    assert {r.t: r.w for r in found.collect()} == dict(zip(texts, [False, False, True, False], strict=True))


def test_tasks_are_read_once_for_stages_jobs_and_applications(spark, made):
    _, rest = landed.event_lines(spark, made)
    plan = plan_of(rest)
    # executors come from the tasks, all else from the stages
    assert plan.count("/tasks-") == 1 and plan.count("/stage-info-") == 4
