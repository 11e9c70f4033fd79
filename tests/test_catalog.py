"""Every registered query against its SQL counterpart on the smallest test tables."""

import re
import sys
from pathlib import Path

import duckdb
import pytest
from conftest import ROOT

from stagelens.catalog import all_queries

sys.path.insert(0, str(ROOT / "tools"))
from check_oracle import rows_of  # noqa: E402

QUERIES = all_queries()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in Path(sf).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, sf, duck, name):
    query = QUERIES[name]
    df = query.run(spark, sf)
    cur = duck.execute(query.sql)
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, df.collect()) == rows_of(names, cur.fetchall())


def test_entry(spark, sf):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_no_query_crosses_tables(spark, sf):
    """Pairing all rows is never part of a plan."""
    from conftest import plan_of

    for name in ("work_cross_join", "work_cartesian_size", "work_skewed_self_join", "work_running_total", "tele_metrics_during",
                 "diag_bottleneck_metrics", "diag_report"):
        plan = plan_of(QUERIES[name].run(spark, sf))
        # operators start a plan line; the names also occur inside the rules' own expressions
        nodes = re.findall(r"^[\s:+\-*()\d]*([A-Z]\w+)", plan, re.MULTILINE)
        assert len(nodes) > 3 and not {"CartesianProduct", "BroadcastNestedLoopJoin"} & set(nodes), name


def test_report_reads_each_fact_table_once(spark, sf, tmp_path, monkeypatch):
    from conftest import plan_of

    from stagelens.catalog import views
    from stagelens.plans import report

    tables = {}
    for name, df in views.tables(spark, sf).items():
        df.write.parquet(str(tmp_path / name))
        tables[name] = spark.read.parquet(str(tmp_path / name))
    plans, step = [], report._step
    monkeypatch.setattr(report, "_step", lambda df, label: (plans.append(plan_of(df)), step(df, label))[1])
    monkeypatch.setattr(report, "scratch_path", lambda spark, label: str(tmp_path / "steps" / label))
    length = spark.conf.get("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    try:
        found = report.report(tables)
        plans.append(plan_of(found))
    finally:
        spark.conf.set("spark.sql.maxMetadataStringLength", length)
    for name in ("fact_stages", "fact_hardware_metrics", "dim_sql_plans", "map_jobs"):
        assert sum(plan.count(f"/{name}]") for plan in plans) == 1, name
    assert found.count() > 0
