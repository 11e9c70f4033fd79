import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from stagelens.functions import plan_text as pt
from stagelens.functions import scalars as sc
from stagelens.functions import series as se

RAW = """== Physical Plan ==
*(2) HashAggregate(keys=[a#12L], functions=[count(1)]) [codegen id : 2]
   +- FileScan parquet [a#1,b#2, c#3, d#4, e#5, f#6, g#7] Batched: true
plain line
 +- X [a, b, c, d, e]  """

CLEAN = """== Physical Plan ==
*(2) HashAggregate(keys=[a#IDL], functions=[count(1)])
+- FileScan parquet [a#ID,b#ID, c#ID, d#ID, ..., g#ID] Batched: true
+- X [a, b, c, d, e]"""

PLANS = {
    RAW: CLEAN,
    None: "",
    "": "",
    "[a, b, c, d, e, f]: [x, [b, c, d, e, f, g]": "[a, b, c, ..., f]: [x, [b, c, ..., g]",
    ": [a,, b, c, d,, , e, f]": ": [a,, b, c, ..., f]",
    "( [a, b,\nc, d, e, f]": "( [a, b,",
    " \x1c +- y　": "+- y",
    ": []": ": []",
}


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_clean_plan(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(PLANS)], "i int, p string")
    got = {r.i: r.c for r in df.select("i", pt.clean_plan(F.col("p")).alias("c")).collect()}
    assert [got[i] for i in range(len(PLANS))] == list(PLANS.values())


def test_clean_plan_keeps_fifty_lines(spark):
    text = "\n".join(f": {i}" for i in range(60))
    cleaned = one(spark, pt.clean_plan(F.lit(text)))[0]
    assert cleaned == "\n".join(f": {i}" for i in range(50))


LISTS = {
    "[]": "[]",
    "[a, b, c, d, e]": "[a, b, c, d, e]",
    "[a, b, c, d, e, f]": "[a, b, c, ..., f]",
    "x [a, b, c, d, e, f] y [1, 2] z": "x [a, b, c, ..., f] y [1, 2] z",
    "[a, [b, c, d, e, f]": "[a, [b, c, ..., f]",
    "[a, b, c,\nd, e, f, g]": "[a, b, c,\nd, e, f, g]",
    "a, b, c, d, e, f, g": "a, b, c, d, e, f, g",
    "[a, b, c, d, e, f": "[a, b, c, d, e, f",
    "]] [a,b, c,d, e,f, g, h, , i]": "]] [a,b, c,d, e,f, ..., i]",
    "[" + ", ".join(f"c{i}" for i in range(60)) + "]": "[c0, c1, c2, ..., c59]",
    "[" + ", ".join(f"c{i}" for i in range(5000)) + "] +- [x]": "[c0, c1, c2, ..., c4999] +- [x]",
    "[" + "y" * 100_000 + ", a, b, c, d, e]": "[" + "y" * 100_000 + ", a, b, ..., e]",
    "[" * 30_000: "[" * 30_000,
    "[a, b] " * 16_000: "[a, b] " * 16_000,
    "[a, b, c, d, e, f, g] " * 16_000: "[a, b, c, ..., g] " * 16_000,
    "[a, b, c, d, e, f " * 4_000: "[a, b, c, d, e, f " * 4_000,
    "[" * 16_000 + "]" * 16_000: "[" * 16_000 + "]" * 16_000,
}


def test_list_shortening(spark):
    df = spark.createDataFrame(list(enumerate(LISTS)), "i int, p string")
    got = {r.i: r.c for r in df.select("i", pt.shorten_lists(F.col("p")).alias("c")).collect()}
    assert [got[i] for i in range(len(LISTS))] == list(LISTS.values())


FORMATTED = """== Physical Plan ==
AdaptiveSparkPlan (9)
+- == Final Plan ==
   * Project (5)
   +- Window (4)
      +- * Sort (3)
         +- AQEShuffleRead (2)
            +- ShuffleQueryStage (1), Statistics(sizeInBytes=1)
               +- Exchange (6)
                  +- BroadcastHashJoin Inner (10)
+- == Initial Plan ==
   Project (7)
   +- SortMergeJoin Inner (8)

(6) Exchange
Input [1]: [a#1]
Arguments: {partitioning}, ENSURE_REQUIREMENTS

(8) SortMergeJoin
Left keys [1]: [a#1]

(4) Window
Arguments: [sum(a#1)]
"""


def test_flags_come_from_the_plan_that_ran(spark):
    flags = one(spark, pt.plan_flags(F.lit(FORMATTED.format(partitioning="SinglePartition"))))[0]
    assert flags.has_broadcast_hash_join and flags.has_unpartitioned_window and flags.has_single_partition
    assert not flags.has_sort_merge_join
    flags = one(spark, pt.plan_flags(F.lit(FORMATTED.format(partitioning="hashpartitioning(a#1, 200)"))))[0]
    assert flags.has_window and not flags.has_unpartitioned_window and not flags.has_single_partition


def test_window_with_a_key_under_a_global_aggregate(spark):
    text = (
        "== Physical Plan ==\nHashAggregate(keys=[])\n+- Exchange SinglePartition, ENSURE_REQUIREMENTS\n   +- Window [sum(a#1)]\n"
        "      +- Sort [a#1]\n         +- Exchange hashpartitioning(a#1, 200)"
    )
    flags = one(spark, pt.plan_flags(F.lit(text)))[0]
    assert flags.has_window and flags.has_single_partition and not flags.has_unpartitioned_window


def test_window_over_a_long_plan(spark):
    tree = [f"{' ' * 3 * i}+- Project [a#{i}]" for i in range(80)]
    tree += [f"{' ' * 240}+- Window [row_number()]", f"{' ' * 243}+- *(2) Sort [a#1]", f"{' ' * 246}+- Exchange SinglePartition"]
    flags = one(spark, pt.plan_flags(F.lit("\n".join(tree))))[0]
    assert flags.has_unpartitioned_window


def test_plan_flags_match_whole_node_names(spark):
    flags = one(spark, pt.plan_flags(F.lit("+- SortMergeJoin\n+- BroadcastExchange\n+- WindowGroupLimit")))[0]
    assert flags.has_sort_merge_join
    assert not (flags.has_sort or flags.has_exchange or flags.has_window)
    assert one(spark, pt.plan_node_count(F.lit("Exchange x Exchange BroadcastExchange"), "Exchange"))[0] == 2


@pytest.mark.parametrize("n,kb", [(128, 0.12), (640, 0.62), (1, 0.0), (None, 0.0), (1024, 1.0)])
def test_to_kb_rounds_ties_to_even(spark, n, kb):
    assert one(spark, sc.to_kb(F.lit(n).cast("bigint")))[0] == kb


@pytest.mark.parametrize(
    "name,value,want",
    [
        ("x_TotalGCTime", 5.126, 5.13),
        ("x_Time_MB", 2.0, 2.0),
        ("x_memUsed_MB", 1.5, 1536.0),
        ("jvm_heap_used", 128.0, 0.12),
    ],
)
def test_metric_units(spark, name, value, want):
    assert one(spark, sc.metric_value(F.lit(name), F.lit(value)))[0] == want


def test_times(spark):
    row = one(
        spark,
        sc.parse_gmt(F.lit("2024-03-10T02:30:00.123GMT")),
        sc.parse_gmt(F.lit("junk")),
        sc.parse_gmt(F.lit(None).cast("string")),
        sc.epoch_ms_to_ts(F.lit(1704067200123)),
        sc.epoch_s_to_ts(F.lit(1704067200.5)),
        sc.truncate_second(sc.epoch_ms_to_ts(F.lit(1704067200999))),
        sc.ts_to_epoch_ms(sc.epoch_ms_to_ts(F.lit(1704067200123))),
        sc.ts_to_epoch_ms(sc.epoch_ms_to_ts(F.lit(1720000000999))),
        sc.ts_to_epoch_s(sc.epoch_ms_to_ts(F.lit(1720000000999))),
    )
    assert list(row) == [
        dt.datetime(2024, 3, 10, 2, 30, 0, 123000),
        None,
        None,
        dt.datetime(2024, 1, 1, 0, 0, 0, 123000),
        dt.datetime(2024, 1, 1, 0, 0, 0, 500000),
        dt.datetime(2024, 1, 1),
        1704067200123,
        1720000000999,
        1720000000,
    ]


def test_times_do_not_depend_on_the_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        test_times(spark)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_app_end(spark):
    end, now = F.lit("a"), F.lit("b")
    assert list(one(spark, sc.app_end(F.lit(True), end, now), sc.app_end(F.lit(False), end, now))) == ["a", "b"]


def test_ids(spark):
    ids = F.array(F.lit(3), F.lit(10))
    row = one(
        spark,
        sc.join_ids(ids),
        sc.join_ids(F.lit(None).cast("array<int>")),
        sc.split_ids(F.lit("3,10")),
        sc.split_ids(F.lit("")),
        sc.host_of(F.lit("10.0.0.1:7077")),
    )
    assert list(row) == ["3,10", "", [3, 10], [], "10.0.0.1"]


def test_with_defaults(spark):
    df = spark.createDataFrame([(None, None), (1, "x")], "a int, b string")
    assert [tuple(r) for r in sc.with_defaults(df, {"a": 0, "b": "N/A"}).collect()] == [(0, "N/A"), (1, "x")]


def test_series_names(spark):
    cases = [
        ("app-1-0001", "spark_app_1_0001_driver_jvm_heap_used", "driver", "jvm_heap_used", True),
        ("app-1-0001", "spark_app_1_0001_0_ExecutorMetrics_TotalGCTime", "0", "ExecutorMetrics_TotalGCTime", True),
        ("app-1-0001", "spark_app_1_0001_2_jvm_threads", "2", "jvm_threads", False),
        ("app-1-0001", "spark_app_9_0001_2_jvm_heap_used", None, None, False),
        # prefix and metric must not share characters
        ("a-jvm", "spark_a_jvm_heap_used", None, None, False),
    ]
    df = spark.createDataFrame(cases, "app string, name string, executor string, metric string, hit boolean")
    parts = se.series_parts(F.col("name"), F.col("app"))
    for r in df.select("*", parts.alias("p"), se.is_target_series(F.col("name"), F.col("app")).alias("got")).collect():
        assert r.got == r.hit
        if r.executor is not None:
            assert (r.p.executor_id, r.p.metric_name) == (r.executor, r.metric)


def test_uniform_is_a_fixed_function_of_the_id(spark):
    ids = spark.range(1, 100001)
    u = sc.uniform(F.col("id"), "promo")
    row = ids.agg(F.sum((u * 4294967296).cast("bigint")), F.count_if(u < 0.8)).first()
    assert list(row) == [214192377142619, 80111]
    again = ids.repartition(3).agg(F.sum((u * 4294967296).cast("bigint"))).first()
    assert again[0] == row[0]
